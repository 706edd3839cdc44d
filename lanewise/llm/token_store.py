"""Token ids of whole texts in a keyed binary store.

The store is a table of segments, written by Spark to the shared folder. A segment holds the records of a run of ascending
keys: the raw ids as little-endian uint32 (``ids``), the end of each record (``ends``, int64), the keys (``keys``, int64) and
a minimal perfect hash of its distinct keys (``levels``: one bitmap for each level; the rank of a key's set bit is its slot).
``slots`` has for each slot a 32-bit fingerprint of the key, its first record and its number of records. A lookup hashes the
key, finds the slot, compares the fingerprint and cuts the record out: constant time, and a key that is absent is answered
by no record but for one chance in 2^32, which the stored key then excludes.

A segment ends after SEGMENT_IDS ids, so a task holds one segment and not its partition. All records of one key stay in one
segment. A null key is kept as the lowest number and given back as null; null texts are empty and hold the end id only.
"""

import os
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import compress
from operator import not_

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import input_splits, mix64, query, renamed, seeds, shared_folder, table

SEGMENT_IDS = 1 << 20
END_ID = 1
NULL_KEY = -(1 << 63)
WORD_CACHE, CORE_CACHE = 400_000, 800_000       # bounds of the caches of a Python worker, emptied when full; they do not change results
LONGEST_CACHED = 64
TAIL = b".,!?%$&#*|"
LEVEL_SEEDS = seeds(64, 21)
SEGMENT = pa.schema([("part", pa.int64()), ("segment", pa.int64()), ("n_records", pa.int64()), ("n_ids", pa.int64()), ("least", pa.int64()), ("greatest", pa.int64()),
                     ("ids", pa.binary()), ("ends", pa.binary()), ("keys", pa.binary()), ("levels", pa.list_(pa.binary())), ("slots", pa.binary())])
SEGMENT_DDL = ("part long, segment long, n_records long, n_ids long, least long, greatest long, ids binary, ends binary, keys binary, "
               "levels array<binary>, slots binary")

_tokenizers: dict = {}


def tokenizer(path: str):
    """The tokenizer of a file, its ids that end a word, a cache of words and one of cores, kept by the Python worker."""
    if path not in _tokenizers:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        tok = Tokenizer.from_file(path)
        ends = np.zeros(tok.get_vocab_size(), bool)
        ends[[i for t, i in tok.get_vocab().items() if t.endswith("</w>")]] = True
        _tokenizers[path] = (tok, ends, {}, {})
    return _tokenizers[path]


def halves(word: bytes) -> tuple[bytes, bytes]:
    """A word as core and tail of punctuation, each of which has its own ids: the vocabulary splits between letters or digits and
    punctuation, and reads A-Z as a-z. Words where that may not hold stay whole."""
    if b"<|" in word:
        return word, b""
    core = word.rstrip(TAIL)
    if core.isalpha() or (word.isascii() and core[-1:].isalnum()) or letters_only(core.decode("utf-8", "replace")):
        return core.lower(), word[len(core):]
    return word, b""


def letters_only(text: str) -> bool:
    """Letters that are still letters when composed and in lower case: a capital dotted I becomes an i and a mark, which goes with the
    punctuation behind it, as does the mark of a letter that composition takes apart."""
    return text.isalpha() and unicodedata.normalize("NFC", text).lower().isalpha()


def encode_cores(cores: list[bytes], tok, ends: np.ndarray) -> dict[bytes, bytes]:
    """uint32 ids of each core. Cores of letters alone have one end of word each, so many are encoded as one text and cut there."""
    out, letters, rest = {}, [], []
    for c in cores:
        (letters if c.isalpha() or letters_only(c.decode("utf-8", "replace")) else rest).append(c)
    lots = [letters[i: i + 500] for i in range(0, len(letters), 500)]
    for lot, e in zip(lots, tok.encode_batch_fast([b" ".join(lot).decode() for lot in lots], add_special_tokens=False)):
        ids = np.array(e.ids, "<u4")
        stop = (np.flatnonzero(ends[ids]) + 1) * 4
        if len(stop) != len(lot):
            rest += lot
            continue
        raw, at = ids.tobytes(), 0
        for c, z in zip(lot, stop.tolist()):
            out[c] = raw[at:z]
            at = z
    for c, e in zip(rest, tok.encode_batch_fast([c.decode("utf-8", "replace") for c in rest], add_special_tokens=False)):
        out[c] = np.array(e.ids, "<u4").tobytes()
    return out


def encode(texts: list[bytes], path: str) -> list[bytes]:
    """uint32 ids of each text without the end id. The vocabulary drops white space before it splits, so the ids of a text are
    those of its words one after the other; each distinct core of a word is encoded once, each word is looked up once."""
    tok, ends, words, cores = tokenizer(path)
    if len(words) > WORD_CACHE:
        words.clear()
    if len(cores) > CORE_CACHE:
        cores.clear()
    split = [t.split() for t in texts]
    found = [list(map(words.get, ws)) for ws in split]
    gaps = [list(compress(range(len(ws)), map(not_, ids))) for ws, ids in zip(split, found)]      # missing, or words without ids
    new, heads, tails = list({ws[k] for ws, at in zip(split, gaps) for k in at}), [], []
    for w in new:
        c = w.rstrip(TAIL)
        c, t = (c.lower(), w[len(c):]) if c.isalpha() else halves(w)
        heads.append(c)
        tails.append(t)
    missing = set(heads).union(tails).difference(cores)
    missing.discard(b"")
    fresh = encode_cores(list(missing), tok, ends)
    cores.update((w, x) for w, x in fresh.items() if len(w) <= LONGEST_CACHED)
    cores[b""] = b""
    fresh = {w: x for w, x in fresh.items() if len(w) > LONGEST_CACHED}
    if fresh:
        held = {x: cores[x] if x in cores else fresh[x] for x in {*heads, *tails}}
        words.update((w, held[c] + held[t]) for w, c, t in zip(new, heads, tails))
    else:
        words.update((w, cores[c] + cores[t]) for w, c, t in zip(new, heads, tails))
    for ws, ids, at in zip(split, found, gaps):
        for k in at:
            ids[k] = words[ws[k]]
    if fresh:
        for w in new:
            if len(w) > LONGEST_CACHED:
                del words[w]
    return [b"".join(ids) for ids in found]


def build_index(keys: np.ndarray) -> tuple[list[bytes], np.ndarray]:
    """Minimal perfect hash of distinct int64 keys: bitmaps by level, and the slot of each key."""
    h = mix64(keys.astype(np.uint64))
    slot, left, levels, base = np.zeros(len(keys), np.int64), np.arange(len(keys)), [], 0
    while len(left):
        size = np.uint64(max(64, 2 * len(left)))
        at = (mix64(h[left] ^ LEVEL_SEEDS[len(levels) % 64] ^ np.uint64(len(levels))) % size).astype(np.int64)
        alone = np.bincount(at, minlength=int(size))[at] == 1
        bits = np.zeros(int(size), bool)
        bits[at[alone]] = True
        slot[left[alone]] = base + np.cumsum(bits)[at[alone]] - 1
        base += int(alone.sum())
        levels.append(int(size).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes())
        left = left[~alone]
    return levels, slot


def find_slots(levels: list[bytes], keys: np.ndarray) -> np.ndarray:
    """Slot of each key, -1 where no level has its bit."""
    h = mix64(keys.astype(np.uint64))
    slot, left, base = np.full(len(keys), -1, np.int64), np.arange(len(keys)), 0
    for k, level in enumerate(levels):
        size = int.from_bytes(level[:8], "little")
        bits = np.unpackbits(np.frombuffer(level, np.uint8, offset=8), bitorder="little", count=size).astype(bool)
        at = (mix64(h[left] ^ LEVEL_SEEDS[k % 64] ^ np.uint64(k)) % np.uint64(size)).astype(np.int64)
        hit = bits[at]
        slot[left[hit]] = base + np.cumsum(bits)[at[hit]] - 1
        base += int(bits.sum())
        left = left[~hit]
    return slot


def fingerprint(keys: np.ndarray) -> np.ndarray:
    return (mix64(keys.astype(np.uint64) ^ np.uint64(0xA5A5A5A5A5A5A5A5)) >> np.uint64(32)).astype("<u4")


def make_segment(part: int, number: int, keys: list[int], records: list[bytes]) -> pa.RecordBatch:
    ks = np.array(keys, np.int64)
    ends = np.cumsum([len(r) // 4 for r in records]).astype("<i8")
    distinct, first, count = np.unique(ks, return_index=True, return_counts=True)
    levels, slot = build_index(distinct)
    slots = np.zeros((len(distinct), 3), "<u4")
    slots[slot] = np.stack([fingerprint(distinct), first, count], axis=1)
    row = [part, number, len(ks), int(ends[-1]), int(ks[0]), int(ks[-1]), b"".join(records), ends.tobytes(), ks.astype("<i8").tobytes(), levels, slots.tobytes()]
    return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SEGMENT)], schema=SEGMENT)


def records_of(row: dict, keys: np.ndarray) -> Iterator[tuple[int, int, bytes]]:
    """(key, first id within the segment, raw ids) of every record of the keys, found through the index."""
    slot = find_slots(row["levels"], keys)
    slots = np.frombuffer(row["slots"], "<u4").reshape(-1, 3)
    ends, stored = np.frombuffer(row["ends"], "<i8"), np.frombuffer(row["keys"], "<i8")
    marks = fingerprint(keys)
    for key, s, mark in zip(keys.tolist(), slot.tolist(), marks.tolist()):
        if s < 0 or slots[s, 0] != mark or stored[slots[s, 1]] != key:
            continue
        for r in range(slots[s, 1], slots[s, 1] + slots[s, 2]):
            start = int(ends[r - 1]) if r else 0
            yield key, start, row["ids"][4 * start: 4 * int(ends[r])]


def write_store(docs: DataFrame, tokenizer_path: str, key: str = "doc_id", text: str = "text", end_id: int = END_ID) -> str:
    """Encode every text, append ``end_id`` and write the store in ascending key order; its path. Repeated keys keep all their rows."""
    import uuid
    spark = docs.sparkSession
    rows = renamed(docs, key=key, text=text).withColumn("key", F.coalesce(F.col("key").cast("long"), F.lit(NULL_KEY).cast("long")))
    ordered = rows.repartitionByRange(2 * input_splits(docs), "key").sortWithinPartitions("key", "text")
    end = np.array([end_id], "<u4").tobytes()

    def segments(batches):
        part, number, keys, records, held = TaskContext.get().partitionId(), 0, [], [], 0
        for batch in batches:
            ids, column = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())
            for i in range(0, len(ids), 256):
                texts = [t or b"" for t in column.slice(i, 256).to_pylist()]
                for k, r in zip(ids[i: i + 256], encode(texts, tokenizer_path)):
                    if held >= SEGMENT_IDS and k != keys[-1]:
                        yield make_segment(part, number, keys, records)
                        number, keys, records, held = number + 1, [], [], 0
                    keys.append(k)
                    records.append(r + end)
                    held += len(r) // 4 + 1
        if keys:
            yield make_segment(part, number, keys, records)

    path = f"{shared_folder(spark)}/llm-tokens-{uuid.uuid4().hex}"
    (ordered.mapInArrow(segments, SEGMENT_DDL).write.option("compression", "zstd").option("parquet.block.size", 32 << 20)
     .option("parquet.block.size.row.check.min", 1).option("parquet.page.size.row.check.min", 1).parquet(path))
    return path


RECORD_DDL = "key long, part long, segment long, start long, n_tokens long, ids_crc32 long"


def digest(row: dict, keys: np.ndarray) -> pd.DataFrame:
    found = [(k, row["part"], row["segment"], s, len(b) // 4, zlib.crc32(b)) for k, s, b in records_of(row, keys)]
    return pd.DataFrame(found, columns=["key", "part", "segment", "start", "n_tokens", "ids_crc32"])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """Every record, found through the index by the stored keys: key, part, segment, start within the segment, n_tokens, ids_crc32."""
    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                keys = np.unique(np.frombuffer(row["keys"], "<i8"))
                yield pa.RecordBatch.from_pandas(digest(row, keys), preserve_index=False)

    return spark.read.parquet(path).mapInArrow(read, RECORD_DDL)


def lookup(spark: SparkSession, path: str, keys: DataFrame, key: str = "doc_id") -> DataFrame:
    """Records of the given keys only. The bounds of the segments (24 bytes for each 4 MB of ids) are held by every task."""
    store = spark.read.parquet(path)
    bounds = sorted((r["least"], r["part"], r["segment"]) for r in store.select("least", "part", "segment").toLocalIterator())
    least = np.array([b[0] for b in bounds], np.int64)
    wanted = renamed(keys, key=key).select(F.coalesce(F.col("key").cast("long"), F.lit(NULL_KEY).cast("long")).alias("key")).distinct()

    def route(frames):
        for f in frames:
            at = np.searchsorted(least, f["key"].to_numpy(), "right") - 1
            f = f[at >= 0].assign(part=[bounds[i][1] for i in at if i >= 0], segment=[bounds[i][2] for i in at if i >= 0])
            yield f

    routed = wanted.mapInPandas(route, "key long, part long, segment long")

    def read(asked: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        if not len(asked) or not len(held):
            return pd.DataFrame({c: pd.Series(dtype="int64") for c in ("key", "part", "segment", "start", "n_tokens", "ids_crc32")})
        return digest(held.iloc[0].to_dict(), asked["key"].to_numpy())

    return routed.groupBy("part", "segment").cogroup(store.groupBy("part", "segment")).applyInPandas(read, RECORD_DDL)


def with_global_start(spark: SparkSession, path: str, records: DataFrame) -> DataFrame:
    """Add the ids of all segments before. One window runs within a part, one over a row for each part."""
    sizes = spark.read.parquet(path).select("part", "segment", "n_ids")
    before = (Window.unboundedPreceding, -1)
    inner = sizes.withColumn("inner", F.coalesce(F.sum("n_ids").over(Window.partitionBy("part").orderBy("segment").rowsBetween(*before)), F.lit(0)))
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n"))
    outer = parts.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(*before)), F.lit(0)).alias("outer"))
    offset = inner.join(outer, "part").select("part", "segment", (F.col("inner") + F.col("outer")).alias("offset"))
    return records.join(offset, ["part", "segment"]).withColumn("start", F.col("start") + F.col("offset"))


@query("op4_token_store")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write and read back all documents."""
    import public_tokenizers
    path = write_store(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    out = with_global_start(spark, path, read_store(spark, path))
    return out.select(F.when(F.col("key") != NULL_KEY, F.col("key")).alias("doc_id"), "start", "n_tokens", "ids_crc32")
