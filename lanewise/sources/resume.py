"""Work that goes on where it ended: an append-only log of JSON lines holds the result of every finished item."""

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

from lanewise.sources.commits import path_exists

PROBES = 4
BITS_EACH = 16
LEAST_BITS, MOST_BITS = 1 << 16, 1 << 26      # the filter takes 8 MB at most; beyond, it lets more through to the exact join


def read_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Finished items. A line that was cut short, as by a writer that died, is left out."""
    if not path_exists(spark, path):
        return spark.createDataFrame([], schema)
    ddl = T.StructType([*T.StructType.fromDDL(schema).fields, T.StructField("_bad", T.StringType())])
    line = F.from_json("value", ddl, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return spark.read.text(path).select(line.alias("r")).where("r IS NOT NULL AND r._bad IS NULL").select("r.*").drop("_bad")


def _positions(h: np.ndarray, bits: int) -> list[np.ndarray]:
    low, high = h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF
    return [(low + k * (high | 1)) & (bits - 1) for k in range(PROBES)]


def done_filter(done: DataFrame, key: str) -> np.ndarray | None:
    """Bits of the finished keys, about BITS_EACH a key within the limits; None where nothing is finished.

    The bits are gathered as 64-bit words, so at most MOST_BITS / 64 rows come to the driver.
    """
    n = done.count()
    if not n:
        return None
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (n * BITS_EACH - 1).bit_length()))
    h = F.xxhash64(F.col(key).cast("string"))
    low, high = h.bitwiseAND(0xFFFFFFFF), F.shiftrightunsigned(h, 32).bitwiseOR(F.lit(1))
    places = F.array(*[(low + F.lit(k) * high).bitwiseAND(bits - 1) for k in range(PROBES)])
    words = (done.select(F.explode(places).alias("at")).groupBy(F.shiftright("at", 6).alias("word"))
             .agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (F.col("at") % 64).cast("int"))).alias("bits")).toPandas())
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def maybe_done(words: np.ndarray):
    """Column function: False for keys that are certainly not in the filter."""
    bits = len(words) * 64

    @arrow_udf(T.BooleanType())
    def probe(h: pa.Array) -> pa.Array:
        found = np.ones(len(h), bool)
        for at in _positions(h.to_numpy(zero_copy_only=False), bits):
            found &= (words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
        return pa.array(found)

    return probe


def unfinished(items: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Items whose key is not among the finished ones. Most new items are told by the filter and are not shuffled; the others meet
    the finished keys in an exact anti join. Items without a key were never finished."""
    words = done_filter(done, key)
    if words is None:
        return items
    tagged = items.withColumn("_maybe", maybe_done(words)(F.xxhash64(F.col(key).cast("string"))) & F.col(key).isNotNull())
    fresh = tagged.where("NOT _maybe")
    rest = tagged.where("_maybe").join(done.select(key).distinct(), key, "left_anti")
    return fresh.unionByName(rest).drop("_maybe")


def process(items: DataFrame, work: Callable[[DataFrame], DataFrame], path: str, key: str, schema: str, chunks: int = 8,
            stop: Callable[[int], bool] = lambda chunk: False) -> DataFrame:
    """Results (``schema``, with the key) of every item, from the log. Items go in ``chunks`` by hash of the key; a chunk's results
    appear in the log together, when its job commits. ``stop`` ends a run before a chunk. A run that ended anywhere goes on with what
    the log lacks; repeated keys among the items are worked on once."""
    spark = items.sparkSession
    todo = unfinished(items.where(F.col(key).isNotNull()).dropDuplicates([key]), read_log(spark, path, schema), key)
    for k in range(chunks):
        if stop(k):
            break
        part = todo.where(F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit(7)), F.lit(chunks)) == k)
        work(part).write.mode("append").json(path)
    return read_log(spark, path, schema)
