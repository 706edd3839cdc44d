"""Two-pass external shuffle into shards of equal row counts, in DataFrame functions only.

Pass one scatters records uniformly into memory-sized buckets by a seeded hash. Pass two takes one bucket at a time,
orders it by key, permutes it by Spark's ``shuffle`` (an in-place Fisher-Yates) and deals the running numbers out to the
shards. Bucket offsets are prefix sums over one count for each bucket. Law: ``rows``, counts at most one apart.
"""

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import input_splits, query, shared_folder, table

SHARDS = 24
SEED = 20_240_501
BUCKET_BYTES = 16 << 20        # of records in a bucket, about: a task holds one bucket, some times over


def record_size(text: Column) -> Column:
    """UTF-8 bytes of the text (null: none) plus 8 for the key."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 8


def total_bytes(docs: DataFrame) -> int:
    """Bytes of all records, about: texts and nested values by their length, other columns 8 each."""
    def size(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        if kind.startswith(("array", "struct", "map")):
            c = F.to_json(F.struct(c))
        elif kind not in ("string", "binary"):
            return F.lit(8)
        return F.coalesce(F.octet_length(c), F.lit(0)) + 8
    each = sum((size(c, kind).cast("long") for c, kind in docs.dtypes), F.lit(0))
    return docs.agg(F.sum(each)).first()[0] or 0


def shuffled_shards(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, splits_per_bucket: int = 1) -> DataFrame:
    """All rows of ``docs`` with shard (0 to shards-1) and slot (gapless from 0), written once to the shared folder.

    A bucket is about as large as ``splits_per_bucket`` input splits, and no larger than as many times BUCKET_BYTES, however large the
    splits; every bucket has a task of its own. Hash and order use every column, so repeated rows
    and null keys are dealt out as any others and a bucket's order does not depend on how rows arrived; fully identical
    rows share a bucket, which ``salt`` splits by the row's place in its input partition. Null texts count as empty. An
    empty table gives an empty result. The columns of ``docs`` are kept in a struct ``record``, so their names cannot clash.
    The permutation of a bucket is fixed by being written: readers of the result all see the same one.
    """
    spark = docs.sparkSession
    buckets = max(1, -(-input_splits(docs) // splits_per_bucket), -(-total_bytes(docs) // (BUCKET_BYTES * splits_per_bucket)))
    record = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    # the salt differs between rows next to each other, so that one repeated row does not fill one bucket
    scattered = docs.select(record.alias("record"), F.pmod(F.monotonically_increasing_id(), F.lit(1 << 20)).alias("salt"))
    scattered = scattered.withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "record", "salt"), F.lit(buckets)).cast("int"))
    # dealt before they are gathered: a task that gathers what it reads would hold a whole split or row group, buckets or not
    held = scattered.repartitionById(buckets, "bucket").groupBy("bucket").agg(F.sort_array(F.collect_list(F.struct("salt", "record"))).alias("rows"))
    dealt = held.select("bucket", F.posexplode(F.shuffle("rows", F.lit(seed))).alias("place", "row"))
    path = f"{shared_folder(spark)}/llm-shards-{uuid.uuid4().hex}"
    dealt.select("bucket", F.col("place").cast("long").alias("place"), "row.record").write.option("compression", "zstd").parquet(path)
    written = spark.read.parquet(path) if docs.columns else dealt
    counts = written.groupBy("bucket").agg(F.count("*").alias("n"))
    before = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)     # one row for each bucket, 16 bytes for an input split
    offsets = counts.select("bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    number = F.col("offset") + F.col("place")
    return written.join(F.broadcast(offsets), "bucket").select("record", F.pmod(number, F.lit(shards)).cast("int").alias("shard"),
                                                  F.floor(number / shards).cast("long").alias("slot"))


@query("op5_sharding")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard and slot; see ``shuffled_shards``."""
    out = shuffled_shards(table(spark, sf_dir, "documents"))
    text = F.coalesce(F.col("record.text"), F.lit(""))
    return out.select("record.doc_id", record_size(F.col("record.text")).alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
                      F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
