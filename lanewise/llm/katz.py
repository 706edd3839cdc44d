"""Katz backoff language model of words, learned and evaluated in partitioned tables.

Tokens are the words of a text, A-Z lower-cased, and one end. Unigram counts cover every word of the training texts; with
Good-Turing discounts for counts up to K and the mass so freed for unknown words they add up to one. Bigrams run over the same
words: P(w | v) is the discounted share of the bigram where (v, w) was seen, else alpha(v) P(w), and alpha(v) makes the sum over all
words exactly one. The first token's history is the end. P(w) in turn falls back to the unknown mass.

Every token is a history once, as the end is that of the first. So the log of a text is the sum of log alpha(x) P(x) over its
tokens x, and of log P(w | v) / (alpha(v) P(w)) over its seen bigrams; the cells give the one by word, the other by bigram.

Tokens are exchanged in packed rows, a row for each flush (the texts a task has read together) and cell: distinct keys, how
often each occurs and in which documents. Frequent words come together in a flush before they are shuffled. Bigrams are counted in
the cell of the second word, then held and scored in that of the first; where that word is one of the frequent ones, whose numbers
every task has, the cell is that of the bigram, and no word's bigrams fill a cell. A cell returns sums by document of the flush.
Packed numbers are compressed by the byte, with bigrams in the order of their codes, so that an exchange writes little.
"""

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import binary_buffers, durable, input_splits, mix64, pieces, query, table, word_hashes

K = 5
VOCABULARY = 65_535           # most frequent words whose numbers every task has; results do not depend on it
FLUSH_TOKENS = 1 << 22
SEGMENT = 1 << 20             # tokens of a flush whose bigrams are packed at once: 64-bit keys take memory
END = np.uint64(0x0E0D0E0D0E0D0E0D)
PARTIAL = "part long, flush long, row binary, base binary, known binary, log binary"
PARTIAL_NAMES = ["part", "flush", "row", "base", "known", "log"]


def discounts(n: list[int]) -> np.ndarray:
    """Katz's discount of counts 0 to K from the numbers of types seen 1 to K+1 times; where it is not between 0 and 1, (r - 1/2) / r."""
    out = np.array([1.0] + [(r - 0.5) / r for r in range(1, K + 1)])
    if n[0] > 0 and all(x > 0 for x in n):
        common = (K + 1) * n[K] / n[0]
        for r in range(1, K + 1):
            d = ((r + 1) * n[r] / n[r - 1] / r - common) / (1 - common) if common < 1 else -1.0
            if 0 < d < 1:
                out[r] = d
    return out


def discounted(c: np.ndarray, d: np.ndarray) -> np.ndarray:
    return c * d[np.where(c <= K, c, 0)]


def flushes(batches, column: int):
    """(number, rows, tokens, tokens of each row, Arrow batches of the rows) of about FLUSH_TOKENS tokens."""
    number, held, tokens, counts, parts = 0, 0, [], [], []
    for b in batches:
        raw, offs = binary_buffers(b.column(column))
        for i, j, part, o in pieces(raw, offs):
            h, _, _, bounds = word_hashes(part, o)
            tokens.append(np.insert(h, bounds[1:], END))
            counts.append(np.diff(bounds) + 1)
            parts.append(b.slice(i, j - i))
            held += len(tokens[-1])
            if held >= FLUSH_TOKENS:
                yield number, np.concatenate(tokens), np.concatenate(counts), parts
                number, held, tokens, counts, parts = number + 1, 0, [], [], []
    if parts:
        yield number, np.concatenate(tokens), np.concatenate(counts), parts


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, their numbers, and the order of the keys."""
    order = np.argsort(key, kind="stable")
    k = key[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
    return k[first], np.diff(np.r_[first, len(k)]), order


def cell_of(key: np.ndarray, cells: int) -> np.ndarray:
    return ((mix64(key.astype(np.uint64)) >> np.uint64(11)) % np.uint64(cells)).astype(np.int64)


def pair_keys(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    """64-bit hash of two words in their order."""
    return mix64(mix64(v ^ np.uint64(0x94D049BB133111EB)) + w)


def histories(tokens: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The token (or its class) before each one; the first of a row follows the end, which is the last token of all."""
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[np.cumsum(counts) - counts] = tokens[-1]
    return before


def by_cell(cell: np.ndarray):
    """(cell, where it is in ``cell``) for each cell that has any."""
    order = np.argsort(cell, kind="stable")
    for at in np.split(order, np.flatnonzero(np.diff(cell[order])) + 1) if len(order) else []:
        yield int(cell[at[0]]), at


def packed_cells(key: np.ndarray, row: np.ndarray, place, rank=None):
    """(cell, where the distinct keys first are, numbers, rows) for each cell that has any; ``place`` gives the cells of keys first seen
    there, ``rank`` what their order within a cell is by."""
    distinct, n, order = grouped(key)
    start = np.cumsum(n) - n
    first = order[start]
    for cell, at in by_cell(place(distinct, first)):
        if rank is not None:
            at = at[np.argsort(rank(first[at]))]
        pick = np.repeat(start[at] - (np.cumsum(n[at]) - n[at]), n[at]) + np.arange(n[at].sum())
        yield cell, first[at], squeezed(n[at].astype("<u4")), squeezed(row[order[pick]])


def squeezed(x: np.ndarray) -> bytes:
    """Little-endian numbers as their first bytes, their second bytes and so on, compressed, behind the size of one and of all. None: empty."""
    if not len(x):
        return b""
    planes = x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()
    return bytes([x.itemsize]) + len(planes).to_bytes(8, "little") + pa.compress(planes, codec="zstd", asbytes=True)


def loosened(raw: bytes, kind: str) -> np.ndarray:
    """The numbers that ``squeezed`` gave."""
    if not raw:
        return np.zeros(0, kind)
    planes = pa.decompress(memoryview(raw)[9:], int.from_bytes(raw[1:9], "little"), codec="zstd")
    return np.ascontiguousarray(np.frombuffer(planes, np.uint8).reshape(raw[0], -1).T).view(kind).ravel()


def codes(i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return i.astype("<u4") << 16 | j.astype("<u4")


def joined(column, kind: str) -> np.ndarray:
    return np.concatenate([np.zeros(0, kind), *[loosened(raw, kind) for raw in column]])


def found_at(have: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key in ascending ``have``, and whether it is there."""
    if not len(have):
        return np.zeros(len(key), np.int64), np.zeros(len(key), bool)
    at = np.searchsorted(have, key).clip(max=len(have) - 1)
    return at, have[at] == key


PAIRS = "cell long, code binary, rest binary, n binary, p binary"


@dataclass
class Model:
    """Statistics of the model: at most VOCABULARY numbers of each kind, for the frequent words; all others are in the tables."""
    total: int
    types: int
    unigrams: DataFrame | None          # word, n
    pairs: DataFrame | None             # packed bigrams: cell, code, rest, n, p (probability of w where it is not frequent)
    cells: int
    d1: np.ndarray
    d2: np.ndarray
    scale1: float
    unknown: float
    words: np.ndarray                   # hashes of the frequent words, ascending
    counts: np.ndarray
    log_alpha: np.ndarray               # by frequent word
    log_share: np.ndarray               # log scale / (tokens of the history * alpha)

    def p_word(self, c: np.ndarray) -> np.ndarray:
        return np.where(c > 0, discounted(c, self.d1) * self.scale1 / max(self.total, 1), self.unknown)

    def other(self) -> float:
        return max(1.0 - float(self.p_word(self.counts).sum()), 1e-300)

    def classes(self, h: np.ndarray) -> np.ndarray:
        """Place of each word among the frequent ones, behind them all for any other; 16 bits."""
        at, known = found_at(self.words, h)
        return np.where(known, at, len(self.words)).astype(np.uint16)

    def cell_of_pairs(self, word: np.ndarray, cls: np.ndarray, key: np.ndarray) -> np.ndarray:
        """Cell of bigrams that meet by ``word`` of class ``cls``."""
        return np.where(cls < len(self.words), cell_of(key, self.cells), cell_of(word, self.cells))

    def coded(self, v: np.ndarray, w: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[bytes, bytes]:
        """Bigrams of classes ``i`` and ``j`` as two numbers of frequent words in 32 bits, and the 64-bit hashes of all sides that are not frequent."""
        c, x = np.stack([i, j], 1), np.stack([v, w], 1)
        return squeezed(codes(i, j)), squeezed(x[c == len(self.words)].astype("<u8"))

    def decoded(self, code, rest) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(v, w, class of v, class of w) of what ``coded`` gave."""
        c = joined(code, "<u4").view("<u2").reshape(-1, 2)[:, ::-1]
        x = np.r_[self.words, np.uint64(0)].astype(np.uint64)[c]
        x[c == len(self.words)] = joined(rest, "<u8")
        return x[:, 0], x[:, 1], c[:, 0], c[:, 1]

    def p_second(self, cls: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Probability of words by class, with that of each one that is not frequent."""
        out = np.r_[self.p_word(self.counts), 0.0][cls]
        out[cls == len(self.words)] = p
        return out

    def weights(self, c: np.ndarray, mass: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(scale, alpha) of histories with ``c`` tokens, discounted ``mass`` and seen words of probability ``p``."""
        share = mass / c
        left = np.maximum(1 - share, 1 / (c + 1))
        return (1 - left) / share, left / np.maximum(1 - p, self.unknown)

    def of_cell(self, f: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Of the ``pairs`` of a cell: ascending keys, and what a seen bigram adds to log alpha(v) P(w); words that are not frequent, counts, log alpha."""
        v, w, i, j = self.decoded(f["code"], f["rest"])
        n, p = joined(f["n"], "<i8"), self.p_second(j, joined(f["p"], "<f8"))
        d, share = discounted(n, self.d2), np.r_[self.log_share, 0.0][i]
        rare = np.flatnonzero(i == len(self.words))
        words, at = np.unique(v[rare], return_inverse=True)
        c = np.bincount(at, n[rare], len(words))
        scale, alpha = self.weights(c, np.bincount(at, d[rare], len(words)), np.bincount(at, p[rare], len(words)))
        share[rare] = np.log10(scale / (c * alpha))[at]
        key = pair_keys(v, w)
        order = np.argsort(key)
        return key[order], (share + np.log10(d) - np.log10(p))[order], words, c.astype(np.int64), np.log10(alpha)

    def without_tables(self) -> "Model":
        return Model(**{**{k: v for k, v in self.__dict__.items() if k in self.__dataclass_fields__}, "unigrams": None, "pairs": None})

    # ---- the counts added up by classes: each frequent word, and all other words as one. Nothing is scored by them.
    @cached_property
    def bigrams(self) -> DataFrame:
        """keys (class of the history times 65536 plus class of the word) and counts, packed."""
        def run(frames):
            for f in frames:
                for code, n in zip(f["code"], f["n"]):
                    distinct, at = np.unique(joined([code], "<u4").astype(np.int64), return_inverse=True)
                    yield pd.DataFrame({"key": distinct, "n": np.bincount(at, joined([n], "<i8")).astype(np.int64)})

        def pack(frames):
            for f in frames:
                yield pd.DataFrame({"keys": [f["key"].to_numpy().astype("<u4").tobytes()], "counts": [f["n"].to_numpy().astype("<i8").tobytes()]})

        sums = self.pairs.select("code", "n").mapInPandas(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        return sums.mapInPandas(pack, "keys binary, counts binary")

    @cached_property
    def _of_classes(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rows, size = self.bigrams.collect(), len(self.words) + 1
        key, c = np.frombuffer(b"".join(r["keys"] for r in rows), "<u4").astype(np.int64), np.frombuffer(b"".join(r["counts"] for r in rows), "<i8")
        p = np.r_[self.p_word(self.counts), self.other()]
        c_, mass, p_ = (np.bincount(key >> 16, x, size) for x in (c, discounted(c, self.d2), p[key & 65535]))
        scale, alpha, full = np.ones(size), np.ones(size), 1 - p_ <= 1e-12
        at = np.flatnonzero(c_)
        scale[at], alpha[at] = self.weights(c_[at], mass[at], p_[at])
        full &= c_ > 0
        scale[full], alpha[full] = c_[full] / mass[full], 0.0
        return c_, scale, alpha

    history = property(lambda self: self._of_classes[0])
    scale = property(lambda self: self._of_classes[1])
    alpha = property(lambda self: self._of_classes[2])


def fit(texts: DataFrame) -> Model:
    """Learn from every row of ``texts`` (text). No rows: a model that gives every token to the unknown."""
    spark, cells = texts.sparkSession, input_splits(texts)

    def count(batches):
        for _, tokens, _, _ in flushes(batches, 0):
            distinct, n, _ = grouped(tokens)
            yield pa.RecordBatch.from_arrays([pa.array(distinct.astype(np.int64)), pa.array(n)], names=["word", "n"])

    unigrams = durable(texts.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")), "unigrams")
    low = unigrams.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0)), *[F.count_if(F.col("n") == r) for r in range(1, K + 2)]).first()
    types, total, n = low[0], low[1], list(low[2:])
    # the threshold: counts by their leading seven bits, so a few thousand rows at most
    size = F.floor(F.log2("n") * 1.0)
    unit = F.greatest(F.lit(1.0), F.pow(F.lit(2.0), size - 6))
    edges = sorted(unigrams.groupBy((F.floor(F.col("n") / unit) * unit).cast("long").alias("least")).agg(F.count("*").alias("k")).collect(), reverse=True)
    threshold, taken = 1 << 62, 0
    for e in edges:
        if taken + e["k"] > VOCABULARY:
            break
        threshold, taken = e["least"], taken + e["k"]
    top = unigrams.where(F.col("n") >= threshold).collect()                       # VOCABULARY rows at most
    words, held = np.array([r["word"] for r in top], np.int64).astype(np.uint64), np.array([r["n"] for r in top], np.int64)
    order = np.argsort(words)
    d1 = discounts(n)
    seen = (total - sum((1 - d1[r]) * r * n[r - 1] for r in range(1, K + 1))) / max(total, 1)
    unknown = max(1 - seen, 1 / (total + 1))
    model = Model(total, types, None, None, cells, d1, np.ones(K + 1), (1 - unknown) / seen if total else 0.0, unknown, words[order], held[order],
                  np.zeros(len(words)), np.zeros(len(words)))
    sent = spark.sparkContext.broadcast(model)

    def count_bigrams(batches):
        for _, tokens, counts, _ in flushes(batches, 0):
            m = sent.value
            before, cls = histories(tokens, counts), m.classes(tokens)
            key, num, order = grouped(pair_keys(before, tokens))
            first = order[np.cumsum(num) - num]
            v, w, i, j = before[first], tokens[first], histories(cls, counts)[first], cls[first]
            del order, first, before
            for cell, at in by_cell(m.cell_of_pairs(w, j, key)):
                at = at[np.argsort(codes(i[at], j[at]))]
                packed = *m.coded(v[at], w[at], i[at], j[at]), squeezed(num[at].astype("<u4"))
                yield pa.RecordBatch.from_arrays([pa.array([cell]), *[pa.array([x], pa.binary()) for x in packed]], names=["cell", "code", "rest", "n"])

    def place(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(cell_of(b.column(0).to_numpy().astype(np.uint64), cells)), b.column(0), b.column(1)], names=["cell", "word", "n"])

    def add(f: pd.DataFrame, rare: pd.DataFrame) -> pd.DataFrame:
        """Counts of the bigrams that meet by their second word, with its probability, dealt to the cells of the first."""
        m = sent.value
        v, w, before, cls = m.decoded(f["code"], f["rest"])
        key, num, at = grouped(pair_keys(v, w))
        if not len(key):
            return pd.DataFrame({c: [] for c in ("cell", "code", "rest", "n", "p")})
        first = np.cumsum(num) - num
        n, v, w, cls = np.add.reduceat(joined(f["n"], "<u4").astype(np.int64)[at], first), v[at[first]], w[at[first]], cls[at[first]]
        before = before[at[first]]
        word = rare["word"].to_numpy().astype(np.int64).astype(np.uint64)
        order, seldom, p = np.argsort(word), cls == len(m.words), np.zeros(len(w))
        p[seldom] = m.p_word(rare["n"].to_numpy().astype(np.int64)[order][np.searchsorted(word[order], w[seldom])])      # each is there
        rows = []
        for cell, pick in by_cell(m.cell_of_pairs(v, before, key)):
            pick = pick[np.lexsort((v[pick], codes(before[pick], cls[pick])))]
            rows.append((cell, *m.coded(v[pick], w[pick], before[pick], cls[pick]), squeezed(n[pick].astype("<i8")), squeezed(p[pick[seldom[pick]]])))
        return pd.DataFrame(rows, columns=["cell", "code", "rest", "n", "p"])

    tagged = unigrams.where(F.col("n") < threshold).mapInArrow(place, "cell long, word long, n long")      # the frequent words are in the model
    counted = texts.select("text").mapInArrow(count_bigrams, "cell long, code binary, rest binary, n binary")
    pairs = durable(counted.groupBy("cell").cogroup(tagged.groupBy("cell")).applyInPandas(add, PAIRS), "bigrams")

    names = ["c", "p", *[f"n{r}" for r in range(1, K + 2)]]

    def by_history(frames):
        """Sums by frequent history; -1 for all others together."""
        m = sent.value
        for f in frames:
            for code, n, p in zip(f["code"], f["n"], f["p"]):
                code, n = joined([code], "<u4").astype(np.int64), joined([n], "<i8")
                used, at = np.unique(code >> 16, return_inverse=True)
                sums = [np.bincount(at, n), np.bincount(at, m.p_second(code & 65535, joined([p], "<f8"))), *[np.bincount(at, n == r) for r in range(1, K + 2)]]
                yield pd.DataFrame({"v": np.where(used < len(m.words), used, -1), **dict(zip(names, sums))})

    ddl = "v long, " + ", ".join(f"{c} double" for c in names)
    sums = pairs.select("code", "n", "p").mapInPandas(by_history, ddl).groupBy("v").agg(*[F.sum(c).alias(c) for c in names]).collect()    # VOCABULARY + 1 rows at most
    model.d2 = discounts([sum(r[f"n{k}"] for r in sums) for k in range(1, K + 2)])
    often = [r for r in sums if r["v"] >= 0]
    if often:
        at, c, p = (np.array([r[x] for r in often]) for x in ("v", "c", "p"))
        mass = c - sum((1 - model.d2[k]) * k * np.array([r[f"n{k}"] for r in often]) for k in range(1, K + 1))
        scale, alpha = model.weights(c, mass, p)
        model.log_alpha[at], model.log_share[at] = np.log10(alpha), np.log10(scale / (c * alpha))
    model.unigrams, model.pairs = unigrams, pairs
    return model


def by_row(rows: np.ndarray, *sums: np.ndarray) -> list[bytes]:
    """Sums by row, for the rows that occur."""
    used, at = np.unique(rows, return_inverse=True)
    return [squeezed(used.astype("<u4")), *[squeezed(np.bincount(at, s, len(used)).astype("<f8")) for s in sums]]


def score(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The ``keep`` columns of every row of ``docs`` (text and they) with n_tokens, n_known, base_score and score.

    Null texts are empty and hold the end alone. Repeated rows are scored each. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model.without_tables())
    texts = docs.select("text", *[F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(keep)])

    def heads(batches):
        """Each row once, with what its frequent words add."""
        m = sent.value
        gain, log = np.r_[np.log10(m.counts + 1.0), 0.0], np.r_[np.log10(m.p_word(m.counts)) + m.log_alpha, 0.0]
        for number, tokens, counts, parts in flushes(batches, 0):
            cls = m.classes(tokens)
            known = cls < len(m.words)
            row = np.repeat(np.arange(len(counts)), counts)
            t = pa.Table.from_batches(parts).combine_chunks()
            n = len(counts)
            yield from pa.table([pa.array(np.full(n, TaskContext.get().partitionId())), pa.array(np.full(n, number)), pa.array(np.arange(n)), pa.array(counts),
                                 pa.array(np.bincount(row, known, n)), pa.array(np.bincount(row, gain[cls], n)), pa.array(np.bincount(row, log[cls], n)), *[t.column(1 + i) for i in range(len(keep))]],
                                names=["part", "flush", "row", "n_tokens", "known", "base", "log", *[f"k{i}" for i in range(len(keep))]]).to_batches()

    def exchange(batches):
        """Words that are not frequent, and all bigrams, to their cells; reads the same columns as ``heads``, so rows fall alike."""
        m, b = sent.value, b""

        def packed(*columns):
            return pa.RecordBatch.from_arrays([*[pa.array([v], pa.int64()) for v in columns[:3]], *[pa.array([v], pa.binary()) for v in columns[3:]]],
                                              names=["cell", "part", "flush", "words", "code", "rest", "num", "rows"])

        for number, tokens, counts, _ in flushes(batches, 0):
            me, row = (TaskContext.get().partitionId(), number), np.repeat(np.arange(len(counts), dtype="<u2" if len(counts) < 1 << 16 else "<u4"), counts)
            cls = m.classes(tokens)
            at = np.flatnonzero(cls == len(m.words))
            words = tokens[at]
            for cell, first, num, rows in packed_cells(words, row[at], lambda key, _: cell_of(key, m.cells)):
                yield packed(cell, *me, squeezed(words[first].astype("<u8")), b, b, num, rows)
            before, behind = histories(tokens, counts), histories(cls, counts)
            for k in range(0, len(tokens), SEGMENT):
                v, w, i, j = (x[k: k + SEGMENT] for x in (before, tokens, behind, cls))
                for cell, first, num, rows in packed_cells(pair_keys(v, w), row[k: k + SEGMENT], lambda key, first: m.cell_of_pairs(v[first], i[first], key),
                                                           lambda first: codes(i[first], j[first])):
                    yield packed(cell, *me, b, *m.coded(v[first], w[first], i[first], j[first]), num, rows)

    def settle(f: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        m, out = sent.value, []
        have, gain, word, n, alpha = m.of_cell(held)
        for r in f.itertuples(index=False):
            num, rows = loosened(r.num, "<u4"), loosened(r.rows, f"<u{r.rows[0]}")
            if r.words:
                at, known = found_at(word, loosened(r.words, "<u8"))
                c, a = (np.where(known, x[at], 0) for x in (n, alpha)) if len(word) else (np.zeros(len(num), np.int64), np.zeros(len(num)))
                out.append((r.part, r.flush, *by_row(rows, *[np.repeat(x, num) for x in (np.log10(c + 1.0), (c > 0).astype(float), np.log10(m.p_word(c)) + a)])))
                continue
            at, known = found_at(have, pair_keys(*m.decoded([r.code], [r.rest])[:2]))
            if known.any():
                rows, log = rows[np.repeat(known, num)], np.repeat(gain[at[known]], num[known])
                out.append((r.part, r.flush, *by_row(rows, np.zeros(len(rows)), np.zeros(len(rows)), log)))
        return pd.DataFrame(out, columns=PARTIAL_NAMES)

    packed = texts.mapInArrow(exchange, "cell long, part long, flush long, words binary, code binary, rest binary, num binary, rows binary")
    both = packed.groupBy("cell").cogroup(model.pairs.groupBy("cell")).applyInPandas(settle, PARTIAL)

    kinds = dict(texts.dtypes)
    ddl = "part long, flush long, row long, n_tokens long, known double, base double, log double" + "".join(f", k{i} {kinds[f'k{i}']}" for i in range(len(keep)))
    head = texts.mapInArrow(heads, ddl)

    def finish(f: pd.DataFrame, partial: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("row").reset_index(drop=True)
        base, known, log = (f[c].to_numpy().copy() for c in ("base", "known", "log"))
        for r in partial.itertuples(index=False):
            rows = loosened(r.row, "<u4")
            for total, part in ((base, r.base), (known, r.known), (log, r.log)):
                total[rows] += loosened(part, "<f8")
        m = sent.value
        out = f[[f"k{i}" for i in range(len(keep))]].copy()
        out["n_tokens"], out["n_known"] = f["n_tokens"], np.rint(known).astype(np.int64)
        out["base_score"], out["score"] = base - f["n_tokens"] * np.log10(m.total + m.types + 1.0), log
        return out

    ddl = ", ".join(f"k{i} {kinds[f'k{i}']}" for i in range(len(keep))) + ", n_tokens long, n_known long, base_score double, score double"
    out = head.groupBy("part", "flush").cogroup(both.groupBy("part", "flush")).applyInPandas(finish, ddl)
    return out.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(keep)], "n_tokens", "n_known", "base_score", "score")


@query("op6_katz")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of the documents whose crc32 modulo 7 is not 2."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(7)) == 2, F.lit(False))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held.alias("held_out"))
    model = fit(docs.where("NOT held_out").select("text"))
    out = score(docs, model, ["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.total).cast("long").alias("train_tokens"), "base_score", "score")
