"""Quality classifier: random Fourier features of document statistics, ridge scores, isotonic calibration.

Statistics of a whole text (shares of byte classes, word lengths, repetition) are standardised and mapped to FEATURES cosines,
which approximate a Gaussian kernel. Each partition sums its part of the normal equations; the sums are added up by row of
the matrix and solved on the driver (FEATURES squared numbers, whatever the input). Ridge scores of labelled rows kept out of
that fit are gathered in a histogram of BINS equal-width bins, over which pool-adjacent-violators gives the calibration.
"""

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import binary_buffers, durable, mix64, pieces, query, shingle_hashes, table, word_hashes

FEATURES = 256
BINS = 4096
RIDGE = 1e-4
THRESHOLD = 0.3
CLIP = 6.0
SEED = 5
FOLDS = 5             # fold 0 is held out, fold CALIBRATE calibrates, the others fit
CALIBRATE = 4

GROUPS = [b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b" ", b"\t\v\f\r", b"\n", b".", b",", b"!", b"?", b"%", b"$",
          b"#", b"&", b"*", b"|", b"<>", b"(){}[]", b"\"'`", b"-_", b"/\\", b":;", b"@", b"=+~^"]
CLASSES = len(GROUPS) + 2      # the others: control bytes, bytes of code points above 127
CLASS = np.full(256, len(GROUPS), np.int64)
CLASS[128:] = len(GROUPS) + 1
for _k, _g in enumerate(GROUPS):
    CLASS[list(_g)] = _k
WIDTH = CLASSES + 9


def _distinct_share(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Distinct values over all values, by row."""
    n = np.diff(bounds)
    row = np.repeat(np.arange(len(n)), n)
    _, first = np.unique(mix64(h + row.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), return_index=True)
    return np.bincount(row[first], minlength=len(n)) / np.maximum(n, 1)


def statistics(column: pa.Array) -> np.ndarray:
    """WIDTH numbers for each text; all zero for an empty or null one."""
    raw, offs = binary_buffers(column)
    out = np.zeros((len(offs) - 1, WIDTH))
    for i, j, part, o in pieces(raw, offs):
        if not len(part):
            continue
        size = np.diff(o)
        row = np.repeat(np.arange(j - i), size)
        counts = np.bincount(row * CLASSES + CLASS[part], minlength=(j - i) * CLASSES).reshape(j - i, CLASSES)
        h, s, e, bounds = word_hashes(part, o)
        words = np.maximum(np.diff(bounds), 1)
        owner = np.repeat(np.arange(j - i), np.diff(bounds))
        length = np.minimum(e - s, 40).astype(float)
        mean = np.bincount(owner, length, j - i) / words
        second = np.bincount(owner, length ** 2, j - i) / words
        letters = counts[:, 0] + counts[:, 1] + counts[:, -1]
        shingles, ends = shingle_hashes(h, bounds)
        out[i:j, :CLASSES] = np.sqrt(counts / np.maximum(size, 1)[:, None])       # the root spreads small shares
        out[i:j, CLASSES:] = np.stack([
            np.log1p(size), np.log1p(np.diff(bounds)), mean, np.sqrt(np.maximum(second - mean ** 2, 0)),
            np.bincount(owner, e - s >= 15, j - i) / words, counts[:, 1] / np.maximum(letters, 1),
            _distinct_share(h, bounds), _distinct_share(shingles, ends), np.log1p(size / (counts[:, 5] + 1))], axis=1)
        out[i:j][size == 0] = 0
    return out


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``stats`` array<float> of every row of ``docs`` (doc_id, text)."""
    def run(batches):
        for b in batches:
            stats = statistics(b.column(1)).astype(np.float32)
            flat = pa.ListArray.from_arrays(pa.array(np.arange(len(stats) + 1, dtype=np.int32) * WIDTH), pa.array(stats.ravel()))
            yield pa.RecordBatch.from_arrays([b.column(0), flat], names=["doc_id", "stats"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, stats array<float>")


@dataclass
class Model:
    """What scoring needs: a few thousand numbers, sent with the tasks."""
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: tuple[float, float] = (0.0, 1.0)
    steps: np.ndarray | None = None

    def features(self, stats: np.ndarray) -> np.ndarray:
        rng = np.random.default_rng(SEED)
        x = np.clip((stats - self.mean) / self.scale, -CLIP, CLIP)
        directions = rng.standard_normal((stats.shape[1], FEATURES)) / np.sqrt(stats.shape[1])
        waves = np.sqrt(2.0 / FEATURES) * np.cos(x @ directions + rng.uniform(0, 2 * np.pi, FEATURES))
        return np.concatenate([waves, np.ones((len(stats), 1))], axis=1)

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        low, high = self.edges
        at = (self.raw(stats) - low) / max(high - low, 1e-12) * len(self.steps) - 0.5
        return np.clip(np.interp(at, np.arange(len(self.steps)), self.steps), 0.0, 1.0)


def isotonic(total: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Non-decreasing shares by pool-adjacent-violators; a bin without rows takes the line between its neighbours."""
    used = np.flatnonzero(total > 0)
    pools: list[list[float]] = []                       # [rows, positives, bins]
    for k in used:
        pools.append([total[k], positive[k], 1])
        while len(pools) > 1 and pools[-2][1] * pools[-1][0] >= pools[-1][1] * pools[-2][0]:
            n, p, b = pools.pop()
            pools[-1] = [pools[-1][0] + n, pools[-1][1] + p, pools[-1][2] + b]
    level = np.concatenate([np.full(int(b), p / n) for n, p, b in pools])
    return np.interp(np.arange(len(total)), used, level)


def fit(stats: DataFrame, labels: DataFrame) -> Model | None:
    """Model of ``labels`` (doc_id, label 0 or 1) by ``stats``; None where no labelled row can be learned from.

    Labels of fold 0 (crc32 of the id as text, modulo FOLDS) are not read. Rows without id, statistics or a label of 0 or 1
    are left out; a document that is labelled twice counts twice.
    """
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).where("label IN (0, 1)")
    known = known.withColumn("fold", fold).where("fold <> 0")
    rows = durable(stats.join(known, "doc_id").select("fold", "label", "stats"), "labelled")
    moments = rows.select(*[F.array(*[f(F.get("stats", F.lit(i))) for i in range(WIDTH)]).alias(n) for n, f in (("mean", F.avg), ("sd", F.stddev_pop))]).first()
    if moments is None or moments["mean"][0] is None:
        return None
    sd = np.array(moments["sd"])
    model = Model(np.array(moments["mean"]), np.where(sd > 1e-9, sd, 1.0), np.zeros(FEATURES + 1))

    def sums(frames):
        total = None
        for f in frames:
            x = model.features(np.stack(f["stats"].to_numpy()).astype(float))
            part = np.concatenate([x.T @ x, (x.T @ f["label"].to_numpy())[:, None]], axis=1)
            total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"i": np.arange(len(total)), "row": list(total)})

    def add(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": f["i"].iloc[:1], "row": [np.sum(np.stack(f["row"].to_numpy()), axis=0)]})

    ddl = "i int, row array<double>"
    parts = rows.where(F.col("fold") != CALIBRATE).mapInPandas(sums, ddl)
    matrix = {r["i"]: r["row"] for r in parts.groupBy("i").applyInPandas(add, ddl).collect()}      # FEATURES + 1 rows
    if not matrix:
        return None
    whole = np.array([matrix[i] for i in range(FEATURES + 1)])
    count = whole[-1, -2]
    model.weights = np.linalg.solve(whole[:, :-1] + RIDGE * count * np.eye(FEATURES + 1), whole[:, -1])

    held = rows if rows.where(F.col("fold") == CALIBRATE).isEmpty() else rows.where(F.col("fold") == CALIBRATE)

    def raw(frames):
        for f in frames:
            yield pd.DataFrame({"raw": model.raw(np.stack(f["stats"].to_numpy()).astype(float)), "label": f["label"]})

    scored = held.mapInPandas(raw, "raw double, label double")
    low, high = scored.agg(F.min("raw"), F.max("raw")).first()
    at = F.least(F.floor((F.col("raw") - low) / max(high - low, 1e-12) * BINS), F.lit(BINS - 1)).alias("at")
    total, positive = np.zeros(BINS), np.zeros(BINS)
    for r in scored.groupBy(at).agg(F.count("*").alias("n"), F.sum("label").alias("p")).collect():          # BINS rows at most
        total[r["at"]], positive[r["at"]] = r["n"], r["p"]
    model.edges, model.steps = (low, high), isotonic(total, positive)
    return model


def scores(stats: DataFrame, model: Model | None) -> DataFrame:
    """doc_id and score; one half for all where nothing could be learned."""
    def run(frames):
        for f in frames:
            yield pd.DataFrame({"doc_id": f["doc_id"], "score": model.score(np.stack(f["stats"].to_numpy()).astype(float))})

    return stats.mapInPandas(run, "doc_id long, score double") if model else stats.select("doc_id", F.lit(0.5).alias("score"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns unchanged. The statistics are computed again beside
    the text, so the texts are not shuffled. An empty table gives an empty result."""
    model = fit(durable(with_statistics(docs), "statistics"), labels)
    if model is None:
        return docs
    where = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(statistics(b.column(where))) >= threshold))

    return docs.mapInArrow(run, docs.schema)


@query("op2_quality")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score of every document."""
    stats = durable(with_statistics(table(spark, sf_dir, "documents")), "statistics")
    model = fit(stats, table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    out = scores(stats, model)
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
