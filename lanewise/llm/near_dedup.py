"""MinHash near-duplicates with sequential Bayesian verification, then exact sets.

Texts with equal shingle sets are one class, told by a 128-bit digest; its least doc_id stands for it. Representatives meet in
BANDS bands of ROWS minimum hashes. A candidate pair compares its signatures in batches: after each, the posterior of a
similarity of at least SIMILARITY (uniform prior) is bounded, and the pair goes once that falls under MISS. Survivors are
confirmed on their full sets, in whole numbers.

A bucket never turns into all its pairs. First every representative is compared with the least one it shares a bucket with.
Buckets whose members are then in one component are done; that covers groups of copies of any size. In what is then still open,
members of the largest component of a group meet all others block by block, with their full sets; a pair
is confirmed where it meets, pairs of components that are joined by then are passed over, and only links that join two components
come out. So the rows between the steps follow the members, not their pairs.

A node is a pair of doc_id and text, so rows that share a doc_id but not the text are told apart.
"""

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import binary_buffers, durable, input_splits, mix64, pieces, query, seeds, shingle_hashes, table, word_hashes
from lanewise.llm.components import components

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
PERCENT = 75
BATCHES = (32, 64, 96, 128)
MISS = 1e-6
PLACES = "array<struct<kind:int,i:int,j:int,side:int>>"
PAIRS_HELD, PAIRS_COMPARED = 1 << 18, 1 << 13       # pairs of rows in memory, and those whose signatures are gathered at once
SET_BLOCK = 2048        # members of a block that is compared with full sets
SET_BYTES = 6
MULTIPLIERS = seeds(HASHES, 31) | np.uint64(1)
ADDENDS = seeds(HASHES, 32)


def least_matches(n: int, similarity: float = PERCENT / 100, miss: float = MISS) -> int:
    """Fewest matches of n hashes at which the posterior (uniform prior) of ``similarity`` or more is at least ``miss``."""
    p = 0.0
    for m in range(n + 1):          # the Beta tail is a binomial sum
        p += math.comb(n + 1, m) * similarity ** m * (1 - similarity) ** (n + 1 - m)
        if p >= miss:
            return m
    return n


BOUNDS = [least_matches(n) for n in BATCHES]


def signature(shingles: np.ndarray) -> np.ndarray:
    """HASHES minimum hashes (uint32) of a non-empty set, in runs that stay in cache."""
    best = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(shingles), 256):
        x = shingles[i: i + 256, None] * MULTIPLIERS + ADDENDS
        best = np.minimum(best, (x >> np.uint64(32)).astype(np.uint32).min(axis=0))
    return best


def sets_of(column: pa.Array):
    """The shingle set of every text, ascending uint64."""
    raw, offs = binary_buffers(column)
    for _, _, part, o in pieces(raw, offs):
        h, _, _, bounds = word_hashes(part, o)
        shingles, ends = shingle_hashes(h, bounds)
        for k in range(len(ends) - 1):
            yield np.unique(shingles[ends[k]: ends[k + 1]])


def sketches(docs: DataFrame) -> DataFrame:
    """doc, id, n (size of the set), digest h1 and h2 of the set, bands: keys of its buckets, of rows (doc, id, text)."""
    def run(batches):
        for b in batches:
            n, h1, h2, keys = [], [], [], []
            for s in sets_of(b.column(2)):
                n.append(len(s))
                h1.append(int(np.add.reduce(mix64(s))))
                h2.append(int(np.bitwise_xor.reduce(mix64(s ^ np.uint64(0x5555555555555555)))) if len(s) else 0)
                if len(s):
                    rows = signature(s).reshape(BANDS, ROWS).astype(np.uint64)
                    key = np.arange(1, BANDS + 1, dtype=np.uint64)
                    for k in range(ROWS):
                        key = mix64(key * np.uint64(0x9E3779B97F4A7C15) ^ rows[:, k])
                    keys.append(key.astype(np.int64).tolist())
                else:
                    keys.append([])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(np.array(h1, np.uint64).astype(np.int64)),
                                              pa.array(np.array(h2, np.uint64).astype(np.int64)), pa.array(keys, pa.list_(pa.int64()))], names=["doc", "id", "n", "h1", "h2", "bands"])

    return docs.mapInArrow(run, "doc long, id long, n long, h1 long, h2 long, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """doc, sig (HASHES uint32) and the full set (ascending, SET_BYTES for each shingle) of texts that have words."""
    def run(batches):
        for b in batches:
            sig, sets = [], []
            for s in sets_of(b.column(1)):
                low = np.unique(s & np.uint64((1 << 8 * SET_BYTES) - 1))
                sig.append(signature(s).tobytes() if len(s) else b"")
                sets.append(low.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SET_BYTES].tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sig, pa.binary()), pa.array(sets, pa.binary())], names=["doc", "sig", "items"])

    return docs.mapInArrow(run, "doc long, sig binary, items binary")


def _items(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // SET_BYTES, 8), np.uint8)
    out[:, :SET_BYTES] = np.frombuffer(b, np.uint8).reshape(-1, SET_BYTES)
    return out.view("<u8").ravel()


def likely(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row by row of two signature matrices: not pruned after any batch; matches so far."""
    alive, matches, done = np.ones(len(a), bool), np.zeros(len(a), np.int64), 0
    for n, least in zip(BATCHES, BOUNDS):
        at = np.flatnonzero(alive)
        matches[at] += (a[at, done:n] == b[at, done:n]).sum(axis=1)
        alive[at] = matches[at] >= least
        done = n
    return alive, matches


def confirmed(pairs: DataFrame, full: DataFrame) -> DataFrame:
    """The ``pairs`` (a, b) that are links: pruned by their signatures, survivors confirmed on their full sets."""
    def prune(batches):
        for t in batches:
            if t.num_rows:
                sigs = [np.frombuffer(b"".join(t.column(k).to_pylist()), "<u4").reshape(-1, HASHES) for k in (2, 3)]
                yield t.filter(pa.array(likely(*sigs)[0])).select([0, 1])

    def check(batches):
        for t in batches:
            ok = []
            for x, y in zip(t.column(2).to_pylist(), t.column(3).to_pylist()):
                x, y = _items(x), _items(y)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            yield t.filter(pa.array(ok, pa.bool_())).select([0, 1])

    def beside(rows, what):
        for end in ("a", "b"):
            rows = rows.join(full.select(F.col("doc").alias(end), F.col(what).alias(f"{what}_{end}")), end)
        return rows.select("a", "b", f"{what}_a", f"{what}_b")

    left = durable(beside(pairs, "sig").mapInArrow(prune, "a long, b long"), "likely")
    return durable(beside(left, "items").mapInArrow(check, "a long, b long"), "links")


def joining_links(sig: np.ndarray, items: list[bytes], keys: list[np.ndarray], component: np.ndarray, side: np.ndarray | None) -> list[tuple[int, int]]:
    """Links (row, row) that join components of rows which share a key; with ``side``, of rows on different sides only.

    Pairs are taken bucket by bucket, those with most equal hashes first. Every likely pair of components not yet joined is
    confirmed on the full sets, so components that no pair of rows links stay apart.
    """
    labels, root = np.unique(component, return_inverse=True)
    root = np.arange(len(labels))[root]
    parent = np.arange(len(labels))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    sets: dict[int, np.ndarray] = {}
    out, failed = [], set()

    def linked(x, y):
        for k in (x, y):
            if k not in sets:
                sets[k] = _items(items[k])
        a, b = sets[x], sets[y]
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= PERCENT * (len(a) + len(b) - both)

    row = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
    key = np.concatenate(keys)
    order = np.argsort(key, kind="stable")
    row, key = row[order], key[order]
    cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(key)]):
        at = row[lo:hi]
        if len(at) < 2 or len({find(r) for r in np.unique(root[at])}) < 2:
            continue
        left, right = (at, at) if side is None else (at[side[at] == 0], at[side[at] == 1])
        step = max(1, PAIRS_HELD // max(len(right), 1))
        for k in range(0, len(left), step):
            now = np.array([find(r) for r in range(len(parent))])[root]
            x, y = np.repeat(left[k: k + step], len(right)), np.tile(right, len(left[k: k + step]))
            apart = (now[x] != now[y]) & ((x < y) if side is None else True)
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            alive, m = (np.concatenate(c) for c in zip(*(likely(sig[x[p: p + PAIRS_COMPARED]], sig[y[p: p + PAIRS_COMPARED]]) for p in range(0, len(x), PAIRS_COMPARED))))
            x, y, m = x[alive], y[alive], m[alive]
            for n in np.argsort(-m, kind="stable").tolist():
                p, q = int(x[n]), int(y[n])
                one, two = find(root[p]), find(root[q])
                if one == two or (p, q) in failed:
                    continue
                if linked(p, q):
                    parent[max(one, two)] = min(one, two)
                    out.append((p, q))
                else:
                    failed.add((p, q))
    return out


def open_links(rows: DataFrame, full: DataFrame, cells: int) -> DataFrame:
    """Links (a, b) that join components, of all pairs of ``rows`` (key, doc, pivot, component) that share a key.

    Buckets with one least member are one group. The members of its largest component are dealt to blocks once for each block of
    the others; the others meet all blocks of it and of one another. Within the largest component nothing is compared.
    """
    members = rows.groupBy("pivot", "doc").agg(F.collect_list("key").alias("keys"), F.first("component").alias("component"))      # BANDS keys at most
    sizes = members.groupBy("pivot", "component").agg(F.count("*").alias("c"))
    group = sizes.groupBy("pivot").agg(F.max(F.struct("c", "component")).alias("big"), F.sum("c").alias("n"))
    group = group.select("pivot", F.col("big.component").alias("big"), F.ceil(F.col("big.c") / SET_BLOCK).cast("int").alias("p"),
                         F.ceil((F.col("n") - F.col("big.c")) / SET_BLOCK).cast("int").alias("q"))
    dealt = members.join(group.where("q > 0"), "pivot")
    inside = F.col("component") == F.col("big")
    own = F.pmod(F.xxhash64("doc"), F.when(inside, F.col("p")).otherwise(F.col("q"))).cast("int")
    none = F.array().cast(PLACES)

    def place(kind, i, j, side):
        return F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.alias("side"))
    across = F.when(inside, F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: place(0, own, k, F.lit(0)))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("p") - 1), lambda k: place(0, k, own, F.lit(1))))
    among = F.when(inside, none).otherwise(F.transform(F.sequence(F.lit(0), F.col("q") - 1), lambda k: place(1, F.least(own, k), F.greatest(own, k), (k != own).cast("int"))))
    spread = dealt.select("pivot", "doc", "keys", "component", F.explode(F.concat(across.cast(PLACES), among.cast(PLACES))).alias("at"))
    spread = spread.select("pivot", "doc", "keys", "component", "at.*", F.pmod(F.xxhash64("pivot", "at.kind", "at.i", "at.j"), F.lit(cells)).alias("cell"))
    # of two different blocks only pairs across are new: each side is told by its own block
    spread = spread.withColumn("side", F.when(F.col("kind") == 0, F.col("side")).otherwise(F.lit(-1)))

    def compare(f: pd.DataFrame) -> pd.DataFrame:
        a, b = [], []
        for _, g in f.groupby(["pivot", "kind", "i", "j"], sort=True):
            g = g.drop_duplicates("doc").sort_values("doc")
            doc, component = g["doc"].to_numpy(), g["component"].to_numpy()
            if len(doc) < 2 or (component == component[0]).all():
                continue
            sig = np.frombuffer(b"".join(g["sig"]), "<u4").reshape(-1, HASHES)
            side = g["side"].to_numpy() if g["kind"].iloc[0] == 0 else None
            for x, y in joining_links(sig, g["items"].tolist(), [np.asarray(k) for k in g["keys"]], component, side):
                a.append(min(doc[x], doc[y]))
                b.append(max(doc[x], doc[y]))
        return pd.DataFrame({"a": np.array(a, np.int64), "b": np.array(b, np.int64)})

    return spread.join(full, "doc").groupBy("cell").applyInPandas(compare, "a long, b long").distinct()


def near_duplicates(docs: DataFrame) -> DataFrame:
    """uid, doc, n_shingles and component (least doc reachable) of every row of ``docs`` (doc_id, text).

    Null or wordless texts have an empty set and stand alone; a null doc_id gets no component but its own null. Rows that share
    a doc_id and the text are one document (one uid); rows that share a doc_id alone are told apart. An empty table gives an empty result.
    """
    docs = docs.select(node().alias("doc"), F.col("doc_id").cast("long").alias("id"), "text")
    cells = 4 * input_splits(docs)
    sketch = durable(sketches(docs), "sketches")
    filled = sketch.where("n > 0 AND id IS NOT NULL")
    classes = filled.groupBy("h1", "h2", "n").agg(F.min("doc").alias("rep"))
    reps = classes.select(F.col("rep").alias("doc")).distinct()
    bucket = filled.join(reps, "doc", "left_semi").select("doc", F.explode("bands").alias("key")).distinct()
    least = bucket.groupBy("key").agg(F.min("doc").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    members = durable(bucket.join(least, "key"), "members")
    wanted = members.select("doc").distinct()
    texts = docs.join(wanted.hint("shuffle_hash"), "doc", "left_semi").select("doc", "text").dropDuplicates(["doc"])
    full = durable(full_sets(texts).where("length(items) > 0"), "sets")

    pairs = members.where("doc <> pivot").groupBy(F.col("doc").alias("b")).agg(F.min("pivot").alias("a")).select("a", "b")
    comps = components(confirmed(durable(pairs, "pairs"), full))

    def known():
        return comps.select(F.col("node").alias("a"), F.col("component").alias("b"))

    def still_open():
        rows = members.join(comps.withColumnRenamed("node", "doc"), "doc", "left").select("key", "doc", "pivot", F.coalesce("component", "doc").alias("component"))
        still = rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("key")
        return rows.join(still, "key", "left_semi")

    last = durable(open_links(still_open(), full, 4 * cells), "links")
    if not last.isEmpty():
        comps = components(known().union(last))
    of = sketch.select("id", "doc", "n", "h1", "h2").join(classes, ["h1", "h2", "n"], "left").join(comps, F.col("rep") == F.col("node"), "left")
    of = of.select("id", "doc", "n", F.when(F.col("id").isNotNull(), F.coalesce("component", "rep", "doc")).alias("node"))
    names = of.where("node IS NOT NULL").groupBy("node").agg(F.min("id").alias("component"))
    return of.join(names, "node", "left").select(F.col("doc").alias("uid"), F.col("id").alias("doc"), F.col("n").alias("n_shingles"), "component")


def node():
    """The number of a row: its doc_id and text."""
    return F.xxhash64(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stand for their component, all columns unchanged: those whose doc_id is the least of it. Of rows that
    share a doc_id only the one that is a duplicate of a lesser one goes; fully repeated rows, and copies under one doc_id, stay together."""
    found = near_duplicates(docs)
    name = "_" * (1 + max(map(len, docs.columns)))          # no column of the caller
    gone = found.where("doc <> component").select(F.col("uid").alias(name)).distinct()
    return docs.join(gone.hint("shuffle_hash"), node() == F.col(name), "left_anti")


@query("op3_near_dedup")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component of every document."""
    out = near_duplicates(table(spark, sf_dir, "documents"))
    return out.select(F.col("doc").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), (F.col("doc") == F.col("component")).alias("kept"))
