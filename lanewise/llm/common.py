"""Shared helpers: reading tables, durable intermediate tables, word and byte hashing of whole Arrow columns."""

import os
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``, with its SQL twin if there is one."""
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; one is set only where the session names none, as in tests."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        named = tempfile.mkdtemp(prefix="lanewise-")
        spark.sparkContext.setCheckpointDir(named)
    return named


def durable(df: DataFrame, name: str, partition_by: list[str] | None = None, compression: str = "zstd") -> DataFrame:
    """Write ``df`` to a fresh table in the shared folder and read it again: lost executors cost no recomputation."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path, partitionBy=partition_by)
    return spark.read.schema(df.schema).parquet(path)


def input_splits(df: DataFrame) -> int:
    """How many pieces Spark reads ``df`` in: a measure of its size that costs no job."""
    return max(1, df.rdd.getNumPartitions())


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64 over uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def seeds(n: int, salt: int = 0) -> np.ndarray:
    """``n`` fixed pseudo-random uint64."""
    return mix64((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(salt << 32)) * np.uint64(0x9E3779B97F4A7C15))


def binary_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary Arrow array without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    kind = np.int64 if wide else np.int32
    offs = np.frombuffer(offsets, kind)[column.offset: column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw, offs


def pieces(raw: np.ndarray, offs: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut a column into runs of rows (first, end, bytes, offsets from 0) of about ``most`` bytes; a longer row stands alone."""
    n, i = len(offs) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        yield i, j, raw[offs[i]: offs[j]], offs[i: j + 1] - offs[i]
        i = j


SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BYTE_CODES = seeds(256, 7)[LOWER]        # A-Z hash as a-z
BASE = 0x9E3779B97F4A7C15                # odd, so it has an inverse modulo 2^64
BASE_INVERSE = pow(BASE, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64; kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(max(n, 1 << 20), base & (2 ** 64 - 1), np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if len(have) <= 1 << 22:
            _powers[base] = have
    return have[:n]


def word_hashes(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words ``[^\\x20\\x09-\\x0D]+`` of every row, A-Z lower-cased: (hash, first byte, end byte, word offsets by row)."""
    n = len(raw)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    inside = ~SPACE[raw]
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cuts = offs[(offs > 0) & (offs < n)]
    first[cuts] |= inside[cuts]
    last[cuts - 1] |= inside[cuts - 1]
    s, e = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(BYTE_CODES[raw] * powers(BASE, n), out=total[1:])
    h = (total[e] - total[s]) * powers(BASE_INVERSE, n)[s]
    return mix64(h ^ (e - s).astype(np.uint64)), s, e, np.searchsorted(s, offs)


WORDS = 5
SLOTS = seeds(WORDS, 11)


def shingle_hashes(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the five-word shingles of every row and their offsets by row; with fewer words, the whole sequence is one."""
    count = np.diff(bounds)
    n = np.where(count >= WORDS, count - WORDS + 1, (count > 0).astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(n)])
    padded = np.concatenate([words, np.zeros(WORDS, np.uint64)])
    at = np.repeat(bounds[:-1] - ends[:-1], n) + np.arange(ends[-1])
    h = np.zeros(len(at), np.uint64)
    short = np.repeat(np.where(count < WORDS, count, WORDS), n)
    for k in range(WORDS):
        part = mix64(padded[at + k] + SLOTS[k])
        h = (h ^ np.where(short > k, part, np.uint64(0))) * np.uint64(0xD6E8FEB86659FD93)
    return mix64(h ^ short.astype(np.uint64)), ends


def renamed(df: DataFrame, **columns: str) -> DataFrame:
    """The needed columns only, under fixed names, so that extra columns of any name cannot clash."""
    return df.select(*[F.col(f"`{c}`").alias(n) for n, c in columns.items()])


def cpu_threads() -> None:
    """One thread for numerical libraries: Spark runs one task for each core."""
    os.environ.setdefault("OMP_NUM_THREADS", "1")
