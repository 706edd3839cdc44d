"""Embedding near-duplicates by a subspace pigeonhole join.

Unit vectors with cosine of at least c are at most sqrt(2 - 2c) apart. Rotated to their principal axes, the vectors are split
into blocks of BLOCK_DIMS coordinates, and the squared distance is shared out in proportion to the blocks' variance. If the whole
distance is within its budget, that of some block is within the block's share. So each block is range-joined under its
share alone: its widest coordinates are cut into cells, finer as the table grows, so that about TILE vectors are at home in
one. A vector is a guest of the cells ahead of its own that have a point within the share, and is tried by block distance
against those at home there; guests are not tried among themselves. Survivors of any block are verified by the exact cosine
in double precision.

Equal vectors are one class with a weight. A pair is verified where it first qualifies (by the least block), and a task returns
link counts and a spanning set of links rather than pairs. A cell is dealt to groups of one tile at home and one tile of others.
"""

from functools import reduce
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import durable, query, table
from lanewise.llm.components import components

COSINE = 0.95
BLOCK_DIMS = 16
SLACK = 1e-9
ROUNDING = 4e-6          # of block distances in single precision, as a part of the largest norm
TILE = 4096
GUESTS = 4 * TILE
STRIP = 512
CHECKED = 1 << 16        # pairs verified at once


class Layout:
    """Rotation, blocks of rotated coordinates, their shares of the squared distance and the cuts of their cells: dims squared numbers."""

    def __init__(self, moments: np.ndarray, cosine: float):
        n = moments[-1, -1]
        values, axes = np.linalg.eigh(moments[:-1, :-1])
        self.turn, values = axes[:, ::-1], np.maximum(values[::-1], 1e-12)
        dims = len(values)
        self.blocks = [slice(a, min(a + BLOCK_DIMS, dims)) for a in range(0, dims, BLOCK_DIMS)]
        weight = np.array([values[b].sum() for b in self.blocks])
        self.shares = (2 - 2 * cosine) * weight / weight.sum() + SLACK
        self.cosine = cosine
        mean = moments[-1, :-1] @ self.turn / n
        width = np.sqrt(np.maximum(values / n - mean * mean, 0))
        self.cuts = [cell_cuts(mean[b], width[b], n) for b in self.blocks]


def cell_cuts(mean: np.ndarray, width: np.ndarray, n: float) -> list[tuple[int, np.ndarray]]:
    """(coordinate, where it is cut) such that about TILE of ``n`` vectors share a cell: the widest part is halved in turn."""
    bits = np.zeros(len(mean), np.int64)
    for _ in range(max(0, int(np.ceil(np.log2(n / TILE))))):
        bits[np.argmax(width / 2.0 ** bits)] += 1
    return [(c, mean[c] + width[c] * np.array([NormalDist().inv_cdf(q / 2 ** b) for q in range(1, 2 ** b)])) for c, b in enumerate(bits.tolist()) if b]


def unit(vectors: list[bytes], dims: int) -> np.ndarray:
    x = np.frombuffer(b"".join(vectors), "<f8").reshape(len(vectors), dims)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def second_moments(classes: DataFrame, dims: int) -> np.ndarray:
    """Sum of the outer products of the unit vectors, each with a 1 behind it, added up by partition and row of the matrix."""
    def part(frames):
        total = np.zeros((dims + 1, dims + 1))
        for f in frames:
            x = np.c_[unit(f["vec"].tolist(), dims), np.ones(len(f))]
            total += x.T @ x
        yield pd.DataFrame({"i": np.arange(dims + 1), "row": list(total)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "row": [np.sum(np.stack(f["row"].to_numpy()), axis=0)]})

    ddl = "i int, row array<double>"
    rows = classes.select("vec").mapInPandas(part, ddl).groupBy("i").applyInPandas(add, ddl).collect()      # dims + 1 rows
    return np.array([r["row"] for r in sorted(rows, key=lambda r: r["i"])])


def reached(u: np.ndarray, cuts: list[tuple[int, np.ndarray]], share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cell of each row of ``u``, and (row, cell) for the cells ahead of it with a point within ``share``."""
    own, at, cell, far = np.zeros(len(u), np.int64), np.arange(len(u)), np.zeros(len(u), np.int64), np.zeros(len(u))
    for c, edges in cuts:
        own = own * (len(edges) + 1) + np.searchsorted(edges, u[:, c], "right")
        lots = []
        for k, (low, high) in enumerate(zip(np.r_[-np.inf, edges], np.r_[edges, np.inf])):
            gap = np.maximum(np.maximum(low - u[at, c], u[at, c] - high), 0)
            further = far + gap * gap
            near = further <= share + SLACK
            lots.append((at[near], cell[near] * (len(edges) + 1) + k, further[near]))
        at, cell, far = (np.concatenate(x) for x in zip(*lots))
    ahead = cell > own[at]
    return own, at[ahead], cell[ahead]


def spread(layout: Layout, dims: int):
    """block, cell, home and cls of each vector for every cell it may meet a partner in: its own (home) and those ahead within reach."""
    def run(batches):
        for batch in batches:
            for b in (batch.slice(i, 2048) for i in range(0, batch.num_rows, 2048)):
                y, cls = unit(b.column(1).to_pylist(), dims) @ layout.turn, b.column(0).to_numpy()
                for k, part in enumerate(layout.blocks):
                    own, at, ahead = reached(y[:, part], layout.cuts[k], layout.shares[k])
                    cell = np.r_[own, ahead]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(cell), k, np.int32)), pa.array(cell), pa.array(np.arange(len(cell)) < len(own)),
                                                      pa.array(np.r_[cls, cls[at]])], names=["block", "cell", "home", "cls"])
    return run


def close_pairs(u: np.ndarray, left: np.ndarray, right: np.ndarray, same: bool, share: float):
    """(i, j) of rows within ``share`` and a margin for single precision, CHECKED pairs at most at a time."""
    half = (u * u).sum(axis=1) / 2
    one, least = np.ones(len(u)), -share / 2 - ROUNDING * half.max(initial=0)
    a, b = (np.column_stack(x).astype(np.float32) for x in ((u, one, -half), (u, -half, one)))
    a, b = a[left], np.ascontiguousarray(b[right].T)
    for k in range(0, len(left), STRIP):
        first = k if same else 0
        hits = np.flatnonzero(a[k: k + STRIP] @ b[:, first:] >= least)          # minus half the squared distance
        for h in range(0, len(hits), CHECKED):
            i, j = np.divmod(hits[h: h + CHECKED], len(right) - first)
            i, j = left[i + k], right[j + first]
            yield (i[i < j], j[i < j]) if same else (i, j)


def meet(layout: Layout, dims: int):
    """Pairs of a tile at home in a cell and another of the cell: weight gained by each class, and links that join two components."""
    def run(f: pd.DataFrame) -> pd.DataFrame:
        k, i_, j_ = int(f["block"].iloc[0]), f["i"].iloc[0], f["j"].iloc[0]
        cls, weight, own = (f[c].to_numpy() for c in ("cls", "weight", "own"))
        x = unit(f["vec"].tolist(), dims)
        y = x @ layout.turn
        label, gain, links = np.arange(len(f)), np.zeros(len(f), np.int64), []
        for i, j in close_pairs(y[:, layout.blocks[k]], np.flatnonzero(own == i_), np.flatnonzero(own == j_), i_ == j_, layout.shares[k]):
            for n, (b, s) in enumerate(zip(layout.blocks[:k + 1], layout.shares)):   # a pair that an earlier block has is left to it
                d = y[i, b] - y[j, b]
                within = (d * d).sum(axis=1) <= s
                i, j = (i[within], j[within]) if n == k else (i[~within], j[~within])
            ok = np.einsum("ij,ij->i", x[i], x[j]) >= layout.cosine
            i, j = i[ok], j[ok]
            np.add.at(gain, i, weight[j])
            np.add.at(gain, j, weight[i])
            while len(i):                                                        # a spanning set of the links
                apart = label[i] != label[j]
                i, j = i[apart], j[apart]
                if len(i):
                    row = i == i[0]
                    _, once = np.unique(label[j[row]], return_index=True)
                    ends = j[row][once]
                    links += [(cls[i[0]], cls[t]) for t in ends]
                    label[np.isin(label, label[ends])] = label[i[0]]
        at = np.flatnonzero(gain)
        return pd.DataFrame({"cls": np.r_[cls[at], np.array([s for s, _ in links], np.int64)], "gain": np.r_[gain[at], np.zeros(len(links), np.int64)],
                             "other": pd.array([None] * len(at) + [t for _, t in links], dtype="Int64")})
    return run


def near_vectors(vectors: DataFrame, cosine: float = COSINE) -> DataFrame:
    """vec_id, n_links and component_id of every row of ``vectors`` (vec_id, embedding).

    A vector that is null, zero, or holds a null or a number that is not finite has no links and is its own component. Vectors are
    compared with those of their own length, each length by a join of its own. Repeated rows are linked with each other. An empty table gives an empty result.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    fine = (F.size("e") > 0) & ~F.exists("e", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))) & F.exists("e", lambda v: v != 0)
    sound = rows.where(F.coalesce(fine, F.lit(False)) & F.col("vec_id").isNotNull())
    lengths = [r["d"] for r in sound.groupBy(F.size("e").alias("d")).agg(F.count("*").alias("n")).where("n > 1").orderBy("d").collect()]
    if not lengths:
        return rows.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    found = [links_of_length(sound, d, cosine).withColumn("_d", F.lit(d)) for d in lengths]
    out = rows.select("vec_id", F.size("e").alias("d"))
    return (out.join(reduce(DataFrame.unionByName, found), (F.col("vec_id") == F.col("_v")) & (F.col("d") == F.col("_d")), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")))


def links_of_length(sound: DataFrame, dims: int, cosine: float) -> DataFrame:
    """_v (vec_id), n_links and component_id of the vectors of ``dims`` numbers in ``sound`` (vec_id, e)."""
    def raw(batches):
        for b in batches:
            flat = np.asarray(b.column(1).flatten(), "<f8").reshape(b.num_rows, dims) if b.num_rows else np.zeros((0, dims))
            flat = flat / np.abs(flat).max(axis=1, keepdims=True) if b.num_rows else flat        # squares of very large or small numbers stay finite
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(r + 0.0).tobytes() for r in flat], pa.binary())], names=["vec_id", "vec"])

    packed = sound.where(F.size("e") == dims).mapInArrow(raw, "vec_id long, vec binary")
    classes = packed.groupBy("vec").agg(F.min("vec_id").alias("cls"), F.count("*").alias("weight"))
    classes = durable(classes.select("cls", "weight", "vec"), "classes")
    layout = Layout(second_moments(classes, dims), cosine)
    placed = classes.select("cls", "vec").mapInArrow(spread(layout, dims), "block int, cell long, home boolean, cls long")
    placed = durable(placed, "cells")
    sizes = placed.groupBy("block", "cell").agg(F.count_if("home").alias("n"), F.count_if(~F.col("home")).alias("guests")).where("n > 0 AND n + guests > 1")
    tiles = placed.join(sizes.select("block", "cell", F.ceil(F.col("n") / TILE).cast("int").alias("tiles"), F.ceil(F.col("guests") / GUESTS).cast("int").alias("more")), ["block", "cell"])
    turn = F.xxhash64("cls")
    tiles = tiles.withColumn("own", F.when(F.col("home"), F.pmod(turn, "tiles")).otherwise(F.col("tiles") + F.pmod(turn, F.greatest("more", F.lit(1)))).cast("int"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1 + F.when(F.col("home"), F.col("more")).otherwise(0))))
    tiles = tiles.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).join(classes, "cls")
    groups = tiles.select("block", "cell", "i", "j", "own", "cls", "weight", "vec").groupBy("block", "cell", "i", "j")
    met = durable(groups.applyInPandas(meet(layout, dims), "cls long, gain long, other long"), "met")
    comps = components(met.where("other IS NOT NULL").select(F.col("cls").alias("a"), F.col("other").alias("b")))
    gains = met.groupBy("cls").agg(F.sum("gain").alias("gain"))
    by_class = (classes.join(gains, "cls", "left").join(comps.withColumnRenamed("node", "cls"), "cls", "left")
                .select("vec", (F.coalesce("gain", F.lit(0)) + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "cls").alias("component_id")))
    return packed.join(by_class, "vec").select(F.col("vec_id").alias("_v"), "n_links", "component_id").distinct()


@query("op9_embeddings")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and component of every vector."""
    out = near_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
