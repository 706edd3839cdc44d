"""Conflict-constrained best-fit packing of documents into training sequences.

A document is as long as its words (and one end mark). It is cut into pieces of CAPACITY; whole pieces fill bins of their own,
the remainder is packed. Documents are packed in windows of WINDOW consecutive rows of the stored order, across files, so a task
holds one window. Bins are ordered by residual and carry bitmaps of the sources and duplicate clusters they hold. An item, longest
first, looks for the successor of its length among the residuals and goes on until the tightest compatible bin is found: no
bin holds two documents of one duplicate cluster, or more than PER_SOURCE of one source. Without one, it opens a new bin.

A document is in the cluster of its exact text and in those of MARKS minimum hashes of its five-word shingles: two documents of
similarity s share one of them with probability 1 - (1 - s)^MARKS, 98 % at 0.75. All clusters of a document count.
"""

from bisect import bisect_left, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import binary_buffers, mix64, pieces, query, seeds, shingle_hashes, table, word_hashes
from lanewise.operators.scale import running_total

CAPACITY = 2048
WINDOW = 4096
PER_SOURCE = 4
MARKS = 3
MULTIPLIERS, ADDENDS = seeds(MARKS, 61) | np.uint64(1), seeds(MARKS, 62)
ORDER_ROWS = 1 << 14      # rows of a range when positions are counted, about


def best_fit(lengths: list[int], clusters: list[int | tuple[int, ...]], sources: list[int], capacity: int = CAPACITY, per_source: int = PER_SOURCE) -> list[tuple[int, int]]:
    """(bin, place in the bin) of each item. ``clusters`` (one or several for each item) and ``sources`` are small numbers, negative: in
    conflict with nothing."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    open_bins: list[tuple[int, int]] = []                    # (residual, bin), ascending
    cluster_bits, source_bits, held, out = [], [], [], [(0, 0)] * len(lengths)
    for i in order:
        n, c, s = lengths[i], clusters[i], sources[i]
        cbit, sbit = 0, (1 << s if s >= 0 else 0)
        for x in (c,) if isinstance(c, int) else c:
            cbit |= 1 << x if x >= 0 else 0
        at = bisect_left(open_bins, (n, -1))
        while at < len(open_bins):
            b = open_bins[at][1]
            if not cluster_bits[b] & cbit and not source_bits[b][-1] & sbit:
                break
            at += 1
        if at < len(open_bins):
            residual, b = open_bins.pop(at)
        else:
            residual, b = capacity, len(held)
            cluster_bits.append(0)
            source_bits.append([0] * per_source)             # plane k: sources that are there more than k times
            held.append(0)
        cluster_bits[b] |= cbit
        planes = source_bits[b]
        planes[next((k for k in range(per_source) if not planes[k] & sbit), per_source - 1)] |= sbit
        out[i] = (b, held[b])
        held[b] += 1
        insort(open_bins, (residual - n, b))
    return out


def marks_of(part: np.ndarray, o: np.ndarray) -> tuple[np.ndarray, list[list[int]]]:
    """Words of every text, and its minimum hashes; none for texts without words."""
    h, _, _, bounds = word_hashes(part, o)
    shingles, ends = shingle_hashes(h, bounds)
    some = np.flatnonzero(np.diff(ends))
    out: list[list[int]] = [[] for _ in range(len(o) - 1)]
    if len(some):
        least = np.stack([np.minimum.reduceat(shingles * m + a, ends[some]) for m, a in zip(MULTIPLIERS, ADDENDS)], axis=1)
        least = mix64(least ^ np.arange(MARKS, dtype=np.uint64)).view(np.int64)
        for k, row in zip(some.tolist(), least.tolist()):
            out[k] = row
    return np.diff(bounds), out


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """key, source, file, row, marks (of its duplicate clusters) and n_words of every row, by whole texts; null texts have no words."""
    base = docs.select(F.col("doc_id").cast("long").alias("key"), F.col("source").cast("string").alias("source"), *_place(docs),
                       F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("same"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            raw, offs = binary_buffers(batch.column(5))
            n, marks, same = np.zeros(batch.num_rows, np.int64), [], batch.column(4).to_pylist()
            for i, j, part, o in pieces(raw, offs):
                n[i:j], found = marks_of(part, o)
                marks += [[e, *m] for e, m in zip(same[i:j], found)]
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in range(4)], pa.array(marks, pa.list_(pa.int64())), pa.array(n)],
                                             names=["key", "source", "file", "row", "marks", "n_words"])

    return base.mapInArrow(count, "key long, source string, file string, row long, marks array<long>, n_words long")


def _place(docs: DataFrame) -> list:
    """Where a row is stored; a table that is not read from files is dealt to windows by a hash."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index").schema
        return [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    except AnalysisException:
        return [F.lit("").alias("file"), F.monotonically_increasing_id().alias("row")]


def packed(docs: DataFrame, capacity: int = CAPACITY, window: int = WINDOW, per_source: int = PER_SOURCE) -> DataFrame:
    """One row for each piece: doc_id, piece, first_word, n_tokens (the last piece counts the end mark), bin, place.

    A text without words has its end mark only; copies of it are one duplicate cluster as other copies are. Null sources are in conflict
    with nothing. Repeated rows are packed as often as they occur, in different bins. Nothing is dropped. An empty table gives an
    empty result.
    """
    order = measured(docs).withColumns({"at": F.struct("file", "row"), "one": F.lit(1)})
    rows = running_total(order, "at", ["one"], descending=False, window_rows=ORDER_ROWS).withColumn("position", F.col("cum_one") - 1)
    rows = rows.withColumns({"n": F.col("n_words") + 1, "window": F.floor(F.col("position") / window).cast("long")})
    rows = rows.withColumn("whole", F.floor((F.col("n") - 1) / capacity).cast("long"))
    full = rows.where("whole > 0").select("key", "position", F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    full = full.select(F.col("key").alias("doc_id"), "piece", (F.col("piece") * capacity).alias("first_word"), F.lit(capacity).cast("long").alias("n_tokens"),
                       F.concat_ws(":", F.lit("row"), F.col("position").cast("string"), F.col("piece").cast("string")).alias("bin"), F.lit(0).alias("place"))

    def fit(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("position").reset_index(drop=True)
        rest = (f["n"] - f["whole"] * capacity).to_numpy()
        owner = np.repeat(np.arange(len(f)), f["marks"].map(len))
        mark, many = np.unique(np.concatenate(f["marks"].to_numpy()), return_inverse=True, return_counts=True)[1:]
        shared = many[mark] > 1                      # a mark of one document is in conflict with nothing
        number = np.unique(mark[shared], return_inverse=True)[1].tolist()
        clusters: list[tuple[int, ...]] = [()] * len(f)
        for k, x in zip(owner[shared].tolist(), number):
            clusters[k] += (x,)
        found = best_fit(rest.tolist(), clusters, pd.factorize(f["source"])[0].tolist(), capacity, per_source)
        name = f["window"].iloc[0]
        return pd.DataFrame({"doc_id": f["key"], "piece": f["whole"], "first_word": f["whole"] * capacity, "n_tokens": rest,
                             "bin": [f"{name}:{b}" for b, _ in found], "place": np.array([p for _, p in found], np.int32)})

    last = rows.select("key", "source", "position", "window", "marks", "n", "whole").groupBy("window").applyInPandas(
        fit, "doc_id long, piece long, first_word long, n_tokens long, bin string, place int")
    return full.unionByName(last)


@query("op10_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins of all documents."""
    return packed(table(spark, sf_dir, "documents"))
