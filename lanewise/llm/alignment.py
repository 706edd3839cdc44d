"""Cross-tokenizer alignment: where the tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

Both read space + text; A is given it, B puts the space before the text itself. The character offsets of the tokenizers library and the
spans of sentencepiece's proto are coarse cuts: a token whose span touches its neighbours' without overlap, and whose decoded bytes are as
many as the span's, ends where its span ends. Tokens that share a character (parts of one multi-byte character, byte fallback) are refined:
their ends follow from the last sure cut by the lengths of their decoded bytes. Texts whose decoded bytes differ from space + text on
either side have no tokens; nor have null and empty texts.

Neither side has a token across a space that follows a character other than white space, so texts are encoded in chunks that begin at
such spaces, and a Python worker encodes each distinct chunk once. Nothing is cut where the vocabulary of B has a piece with a space inside.

Byte offsets where tokens of both end cut the tokens into groups. A token of A and one of B are linked where their bytes overlap. Each byte
range between neighbouring ends of either side lies in one token of A and one of B, and is one link.

Statistics over the corpus go in flushes: a task packs the distinct id pairs of FLUSH entries (document, pair) into one row, pairs in
ascending order with their documents and occurrences. Only the pairs of each flush, counted, are shuffled to be added up, so a pair that is
in all documents is one row for each flush. The totals come back to the flush by its number and are spread over its documents. The links
of one id of A are at most as many pairs as B has ids.

Rows stand alone: repeated rows, null ids and extra columns of any name stay as they are; each row counts as a document of its own. An empty
table gives an empty result.
"""

import hashlib
import itertools
import os
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lanewise.llm.common import binary_buffers, durable, pieces, query, table

FLUSH = 1 << 20           # entries (document, pair) of a flush, about; a longer text stands alone
FLUSH_DOCS = 1 << 16      # documents of a flush, at most
PAIR_BITS = 20            # ids are below 2^20
BATCH = 1 << 20           # bytes of text aligned at once; a longer text stands alone
HELD_TOKENS = 1 << 23     # tokens of chunks that a Python worker remembers
COMMA, BAR, SEMICOLON = (ord(c) for c in ",|;")
DOUBLE = re.compile(r"\s ")
CUT = re.compile(r"(?<=\S)(?= )")


class Vocabulary:
    """Decoded bytes of every id in one flat array."""

    def __init__(self, entries: list[bytes]):
        self.length = np.array([len(e) for e in entries], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.bytes = np.frombuffer(b"".join(entries) or b"\0", np.uint8)

    def decoded(self, ids: np.ndarray) -> np.ndarray:
        n = self.length[ids]
        return self.bytes[np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(n.sum())]


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones for themselves, the others from 256 on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


@dataclass
class Side:
    """Tokens of one side over several documents: ids, byte ends in the joined documents, offsets of the documents' tokens."""
    ids: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray


def refined(begin: np.ndarray, end: np.ndarray, length: np.ndarray, bounds: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Byte ends of tokens with coarse byte spans begin to end and ``length`` decoded bytes; texts begin at ``starts``."""
    first = np.zeros(len(end), bool)
    some = np.flatnonzero(np.diff(bounds))
    first[bounds[some]] = True
    before = np.empty(len(end), np.int64)
    before[1:] = end[:-1]
    before[first] = starts[some]
    touches = begin == before                      # no overlap with the token before
    follows = np.ones(len(end), bool)
    follows[:-1] = touches[1:] | first[1:]         # nor with the one behind
    sure = touches & follows & (end - before == length)
    total = np.cumsum(length)
    anchor = np.maximum.accumulate(np.where(sure, np.arange(len(end)), -1))
    text_first = np.repeat(bounds[:-1], np.diff(bounds))
    text_start = np.repeat(starts, np.diff(bounds))
    held = anchor >= text_first
    at = np.maximum(anchor, 0)
    base_end = np.where(held, end[at], text_start)
    base_total = np.where(held, total[at], total[text_first] - length[text_first])
    return base_end + total - base_total


class Column:
    """A growing array of numbers below 2^31."""

    def __init__(self):
        self.data, self.size = np.zeros(1 << 12, np.int32), 0

    def add(self, x: np.ndarray) -> None:
        need = self.size + len(x)
        if need > len(self.data):
            self.data = np.concatenate([self.data[: self.size], np.zeros(need - self.size + len(self.data) // 2, np.int32)])
        self.data[self.size: need] = x
        self.size = need


class Encoder:
    """Both tokenizers with the chunks that a Python worker has seen: their tokens, and byte ends within the chunk.

    The chunks are bounds of memory, not of results: when they hold more than HELD_TOKENS tokens they are forgotten.
    """

    def __init__(self, a_file: str, b_file: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        table_, entries = byte_of_character(), [b""] * (max(self.a.get_vocab().values()) + 1)
        for piece, i in self.a.get_vocab().items():
            entries[i] = bytes(table_[c] for c in piece) if all(c in table_ for c in piece) else piece.encode()
        b = self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        names = [b.id_to_piece(i) for i in range(b.get_piece_size())]
        assert max(len(entries), len(names)) <= 1 << PAIR_BITS
        self.words = Vocabulary(entries), Vocabulary([bytes([int(n[3:5], 16)]) if b.is_byte(i) else n.replace("▁", " ").encode() for i, n in enumerate(names)])
        self.cuts = not any("▁" in n.lstrip("▁") for n in names)
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.good, self.size = Column(), Column()
        self.start, self.count, self.ids, self.ends = ([Column(), Column()] for _ in range(4))

    def chunks(self, spaced: str) -> list[str]:
        """The text in pieces that both sides encode on their own; each begins with a space and holds more than that."""
        if not self.cuts:
            return [spaced]
        if not DOUBLE.search(spaced):
            found = spaced.split(" ")
            return [" " + x for x in found[1:]] if found[-1] else [spaced]
        found = CUT.split(spaced)
        return found if found[-1] != " " else [spaced]

    def learn(self, new: list[str]) -> None:
        """Encode chunks that were not seen before."""
        whole = [t.encode() for t in new]
        raw = np.frombuffer(b"".join(whole), np.uint8)
        sizes = np.array([len(w) for w in whole], np.int64)
        starts = np.cumsum(sizes) - sizes

        found = self.a.encode_batch(new, add_special_tokens=False)
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int64)
        ids = np.fromiter(itertools.chain.from_iterable(x.ids for x in found), np.int64, bounds[-1])
        spans = np.fromiter(itertools.chain.from_iterable(itertools.chain.from_iterable(x.offsets for x in found)), np.int64, 2 * bounds[-1]).reshape(-1, 2)
        point = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))          # byte of each character
        spans = point[spans + np.repeat(np.searchsorted(point, starts), np.diff(bounds))[:, None]]
        one = Side(ids, refined(spans[:, 0], spans[:, 1], self.words[0].length[ids], bounds, starts), bounds)

        protos = [x.pieces for x in self.b.encode([t[1:] for t in new], return_type="proto")]
        bounds = np.concatenate([[0], np.cumsum([len(x) for x in protos])]).astype(np.int64)
        flat = np.array([x for here in protos for p in here for x in (p.id, p.end)], np.int64)
        ids, end = flat[::2], flat[1::2] + 1 + np.repeat(starts, np.diff(bounds))        # 1: the space
        begin = np.empty(len(end), np.int64)
        begin[1:] = end[:-1]                                                       # pieces follow each other
        some = np.flatnonzero(np.diff(bounds))
        begin[bounds[some]] = starts[some]
        two = Side(ids, refined(begin, end, self.words[1].length[ids], bounds, starts), bounds)

        good = np.ones(len(new), bool)
        for k, side in enumerate((one, two)):
            owner = np.repeat(np.arange(len(new)), np.diff(side.bounds))
            fits = np.bincount(owner, self.words[k].length[side.ids], len(new)).astype(np.int64) == sizes
            joined = self.words[k].decoded(side.ids[fits[owner]])
            row = np.repeat(np.arange(len(new)), sizes * fits)
            good &= fits
            good[row[joined != raw[np.repeat(fits, sizes)]]] = False
            self.start[k].add(self.ids[k].size + side.bounds[:-1])
            self.count[k].add(np.diff(side.bounds))
            self.ids[k].add(side.ids)
            self.ends[k].add(side.ends - starts[owner])
        self.good.add(good)
        self.size.add(sizes)
        self.number.update(zip(new, range(len(self.number), len(self.number) + len(new))))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, Side, Side]:
        """Which of the texts (none empty) have tokens, the byte ends of those joined, and their tokens on both sides."""
        if max(c.size for c in self.ids) > HELD_TOKENS:
            self.forget()
        split = [self.chunks(" " + t) for t in texts]
        new = list(dict.fromkeys(c for s in split for c in s if c not in self.number))
        if new:
            self.learn(new)
        per = np.array([len(s) for s in split], np.int64)
        at = np.fromiter(map(self.number.__getitem__, itertools.chain.from_iterable(split)), np.int64, per.sum())
        owner = np.repeat(np.arange(len(texts)), per)
        good = np.bincount(owner, self.good.data[at] == 0, len(texts)) == 0
        at, owner, per = at[good[owner]], owner[good[owner]], per[good]
        sizes = self.size.data[at].astype(np.int64)
        place = np.cumsum(sizes) - sizes
        first = np.cumsum(per) - per
        ends = np.cumsum(sizes)[first + per - 1] if len(per) else np.zeros(0, np.int64)
        sides = []
        for k in range(2):
            n = self.count[k].data[at].astype(np.int64)
            upto = np.cumsum(n)
            token = np.repeat(self.start[k].data[at] - (upto - n), n) + np.arange(upto[-1] if len(n) else 0)
            bounds = np.concatenate([[0], upto[first + per - 1]]) if len(per) else np.zeros(1, np.int64)
            sides.append(Side(self.ids[k].data[token].astype(np.int64), self.ends[k].data[token] + np.repeat(place, n), bounds))
        return good, ends, *sides


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(a_file: str, b_file: str) -> Encoder:
    """Once for each Python worker."""
    if (a_file, b_file) not in _encoders:
        _encoders[a_file, b_file] = Encoder(a_file, b_file)
    return _encoders[a_file, b_file]


def merged(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ends of two ascending lists, whether both have each, and the token of either list that covers the bytes before it."""
    both = np.concatenate([one, two])
    order = np.argsort(both, kind="stable")
    both, first = both[order], order < len(one)
    last = np.append(both[1:] != both[:-1], True)
    a, b = np.cumsum(first), np.cumsum(~first)
    twice = np.zeros(len(both), bool)
    twice[1:] = both[1:] == both[:-1]
    # an end of the list itself belongs to its token, else to the next one
    a_here = (first | twice)[last]
    b_here = (~first)[last]
    return both[last], twice[last], a[last] - a_here, b[last] - b_here


DIGITS = (np.arange(100_000)[:, None] // 10 ** np.arange(4, -1, -1) % 10 + 48).astype(np.uint8)
SHOWN = np.arange(5)[None, :] >= 5 - np.maximum(1, np.ceil(np.log10(np.arange(100_000) + 1)).astype(int))[:, None]


def group_texts(one: Side, two: Side, common: np.ndarray, a_token: np.ndarray, b_token: np.ndarray) -> list[bytes]:
    """For each document ``a1,a2|b1;a3|b2,b3``: the ids of each group on both sides, from the links of ``merged``."""
    n = len(one.ids) + len(two.ids)
    a_upto, b_upto = a_token[common] + 1, b_token[common] + 1           # tokens up to the end of each group
    a_size, b_size = np.diff(a_upto, prepend=0), np.diff(b_upto, prepend=0)
    ids, mark = np.empty(n, np.int64), np.full(n, COMMA, np.uint8)
    ids[np.arange(len(one.ids)) + np.repeat(b_upto - b_size, a_size)] = one.ids
    ids[np.arange(len(two.ids)) + np.repeat(a_upto, b_size)] = two.ids
    mark[a_upto + b_upto - b_size - 1] = BAR
    mark[a_upto + b_upto - 1] = SEMICOLON
    last = one.bounds[1:] + two.bounds[1:] - 1
    text, shown = np.empty((n, 6), np.uint8), np.ones((n, 6), bool)
    text[:, :5], text[:, 5] = DIGITS[ids], mark
    shown[:, :5] = SHOWN[ids]
    shown[last, 5] = False
    flat = text[shown].tobytes()
    cuts = np.concatenate([[0], np.cumsum(shown.sum(axis=1))[last]])
    return [flat[x:y] for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist())]


@dataclass
class Aligned:
    """Numbers of every text of a batch, and links (document, id of A, id of B) of those with tokens."""
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    n_links: np.ndarray
    sha: list[str]
    doc: np.ndarray
    pair: np.ndarray


def align(texts: list[str | None], a_file: str, b_file: str) -> Aligned:
    at = np.array([k for k, t in enumerate(texts) if t], np.int64)
    out = Aligned(*(np.zeros(len(texts), np.int64) for _ in range(4)), [""] * len(texts), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if not len(at):
        return out
    good, ends, one, two = encoder(a_file, b_file).encode([texts[k] for k in at])
    at = at[good]
    if not len(at):
        return out
    cuts, common, a_token, b_token = merged(one.ends, two.ends)
    behind = np.searchsorted(cuts, ends, "right")
    n_links = np.diff(behind, prepend=0)
    out.n_a[at], out.n_b[at], out.n_links[at] = np.diff(one.bounds), np.diff(two.bounds), n_links
    out.n_groups[at] = np.diff(np.cumsum(common)[behind - 1], prepend=0)
    for k, text in zip(at.tolist(), group_texts(one, two, common, a_token, b_token)):
        out.sha[k] = hashlib.sha256(text).hexdigest()
    out.doc = np.repeat(at, n_links)
    out.pair = one.ids[a_token] << PAIR_BITS | two.ids[b_token]
    return out


def text_runs(column: pa.Array) -> Iterator[tuple[int, int, list[str | None]]]:
    raw, offs = binary_buffers(column)
    for i, j, _, _ in pieces(raw, offs, BATCH):
        yield i, j, column.slice(i, j - i).to_pylist()


SPANS = "a_ids array<int>, a_ends array<long>, b_ids array<int>, b_ends array<long>, group_ends array<long>"


def spans(docs: DataFrame, a_file: str, b_file: str, text: str = "text") -> DataFrame:
    """``row`` (struct of all columns of ``docs`` but the text), ids and byte ends in space + text on both sides, and the group ends.
    Without tokens the arrays are empty."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")])
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))

    def run(batches):
        for b in batches:
            parts: list[list] = [[] for _ in range(5)]
            for _, _, texts in text_runs(b.column(1)):
                at = [k for k, t in enumerate(texts) if t]
                good, ends, one, two = encoder(a_file, b_file).encode([texts[k] for k in at]) if at else (np.zeros(0, bool), np.zeros(0, np.int64), None, None)
                place = {at[k]: d for d, k in enumerate(np.flatnonzero(good))}
                begins = np.concatenate([[0], ends[:-1]]) if len(ends) else ends
                for k in range(len(texts)):
                    d = place.get(k)
                    found = [[]] * 5
                    if d is not None:
                        x, y = slice(*one.bounds[d: d + 2]), slice(*two.bounds[d: d + 2])
                        a_ends, b_ends = one.ends[x] - begins[d], two.ends[y] - begins[d]
                        found = [one.ids[x], a_ends, two.ids[y], b_ends, np.intersect1d(a_ends, b_ends, assume_unique=True)]
                    for p, f in zip(parts, found):
                        p.append(f)
            kinds = [pa.list_(t) for t in (pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64())]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(p, k) for p, k in zip(parts, kinds)]],
                                             names=["row", "a_ids", "a_ends", "b_ids", "b_ends", "group_ends"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {SPANS}")


def counted(x: np.ndarray, in_order: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values and their counts, by sorting."""
    x = x if in_order else np.sort(x)
    first = np.flatnonzero(np.append(True, x[1:] != x[:-1])) if len(x) else np.zeros(0, np.int64)
    return x[first], np.diff(np.append(first, len(x)))


NUMBERS = ["n_a", "n_b", "n_groups", "n_links"]
FLUSHES = ("flush long, doc_id array<long>, " + ", ".join(f"{c} array<long>" for c in NUMBERS)
           + ", sha array<string>, a array<int>, b array<int>, n array<int>, docs binary, times binary")


def _packed(x: np.ndarray) -> bytes:
    """Unsigned numbers in as few bytes as the largest needs."""
    return x.astype(np.min_scalar_type(int(x.max(initial=0)))).tobytes()


def _unpacked(blob: bytes, n: int) -> np.ndarray:
    return np.frombuffer(blob, f"u{len(blob) // n}").astype(np.int64) if n else np.zeros(0, np.int64)


def flushes(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Documents (doc_id, text) in flushes: their numbers, and the distinct pairs of the flush with number of documents, the
    documents (position in the flush) and how often each has the pair linked."""
    def run(batches):
        part, number = TaskContext.get().partitionId(), itertools.count()
        ids, made, doc, pair, times, held = [], [], [], [], [], 0

        def put():
            d, p, t = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (doc, pair, times))
            order = np.argsort(p, kind="stable")
            distinct, n = counted(p[order], in_order=True)
            numbers = [np.concatenate([getattr(m, c) for m in made]).tolist() for c in NUMBERS]
            sha = [s for m in made for s in m.sha]
            cells = [[(part << 33) + next(number)], [ids], *[[x] for x in numbers], [sha], [distinct >> PAIR_BITS], [distinct & ((1 << PAIR_BITS) - 1)],
                     [n], [_packed(d[order])], [_packed(t[order])]]
            kinds = [pa.int64(), pa.list_(pa.int64()), *[pa.list_(pa.int64())] * 4, pa.list_(pa.string()), *[pa.list_(pa.int32())] * 3, pa.binary(), pa.binary()]
            names = ["flush", "doc_id", *NUMBERS, "sha", "a", "b", "n", "docs", "times"]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cells, kinds)], names=names)

        for b in batches:
            keys = b.column(0).to_pylist()
            for i, j, texts in text_runs(b.column(1)):
                for lo in range(0, len(texts), FLUSH_DOCS):
                    some = texts[lo: lo + FLUSH_DOCS]
                    if ids and (held > FLUSH or len(ids) + len(some) > FLUSH_DOCS):
                        yield put()
                        ids, made, doc, pair, times, held = [], [], [], [], [], 0
                    m = align(some, a_file, b_file)
                    entry, t = counted(m.doc << 2 * PAIR_BITS | m.pair)
                    doc.append((entry >> 2 * PAIR_BITS) + len(ids))
                    pair.append(entry & ((1 << 2 * PAIR_BITS) - 1))
                    times.append(t)
                    held += len(t)
                    ids += keys[i + lo: i + lo + len(some)]
                    m.doc = m.pair = np.zeros(0, np.int64)
                    made.append(m)
        if ids:
            yield put()

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, FLUSHES)


def with_counts(flushed: DataFrame) -> DataFrame:
    """One row a document: doc_id, its numbers, sha, n_best and count_sum over all documents of ``flushed`` (a stored table)."""
    pairs = flushed.select("flush", F.posexplode(F.arrays_zip("a", "b", "n")).alias("at", "p")).select("flush", "at", "p.a", "p.b", "p.n")
    totals = pairs.groupBy("a", "b").agg(F.sum("n").alias("count"))
    totals = totals.withColumn("best", F.col("count") == F.max("count").over(Window.partitionBy("a")))       # one row an id of B
    known = pairs.select(F.col("flush").alias("of"), "at", "a", "b").join(totals, ["a", "b"]).select("of", "at", "count", "best")

    def spread(left: pa.Table, right: pa.Table) -> pa.Table:
        at = right.column("at").to_numpy()
        count, best = np.zeros(len(at), np.int64), np.zeros(len(at), bool)
        count[at], best[at] = right.column("count").to_numpy(), right.column("best").to_numpy()
        row = left.slice(0, 1).to_pylist()[0] if left.num_rows else None
        n = np.array(row["n"], np.int64)
        size = int(n.sum())
        doc, times = _unpacked(row["docs"], size), _unpacked(row["times"], size)
        which = np.repeat(np.arange(len(n)), n)
        n_best, total = np.zeros(len(row["doc_id"]), np.int64), np.zeros(len(row["doc_id"]), np.int64)
        np.add.at(n_best, doc, times * best[which])
        np.add.at(total, doc, times * count[which])
        cells = [pa.array(row["doc_id"], pa.int64()), *[pa.array(row[c], pa.int64()) for c in NUMBERS], pa.array(row["sha"], pa.string()), pa.array(n_best), pa.array(total)]
        return pa.Table.from_arrays(cells, names=["doc_id", *NUMBERS, "sha", "n_best", "count_sum"])

    ddl = "doc_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", sha string, n_best long, count_sum long"
    light = flushed.drop("a", "b")
    return light.groupBy("flush").cogroup(known.groupBy("of")).applyInArrow(spread, ddl)


@query("op11_alignment")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of tokens, groups and links of every document, corpus-wide counts of its links, and a digest of its groups."""
    import public_tokenizers
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    stored = durable(flushes(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")), "alignment")
    out = with_counts(stored)
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", F.col("sha").alias("groups_sha256"))
