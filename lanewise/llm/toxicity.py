"""Toxic passages: maximum-scoring segments of token log-odds, significant by extreme-value statistics.

* Tokens are runs of letters, digits, apostrophes and bytes above 127, A-Z lower-cased. The units of a token are itself and its
  first 3 to 8 bytes (where it is longer), so that rare forms of a word family share evidence.
* Counts of a unit in toxic and in clean labelled documents (a token right behind itself is left out) give a log-odds ratio with a Dirichlet prior: a flat part and a part in
  proportion to the unit's count in all documents. It is drawn towards 0 by CREDIBLE standard deviations. A token takes the score of its
  strongest unit, less a drift that makes the expected score of clean text negative.
* A linear-time scan finds all maximal scoring segments of a text, the passages. In clean text the best of n tokens exceeds S with
  probability 1 - exp(-K n exp(-lambda S)). Lambda solves the equation of the score distribution of clean tokens, K fits the best
  segments of clean documents. The passages of one document are joined by the sum statistics of the same theory; the logarithm of the
  probability becomes a score by a logistic curve. Lambda, K and the curve come from labelled documents kept out of the counts.

Counts cover all documents; labels come from at most about LABELLED documents, chosen by hash of the id, so that ids and labels can be
broadcast. Null and empty texts have no tokens, no passages and the lowest score. Rows are independent: repeated rows and null ids are
scored each, extra columns of any name stay. Without documents of both labels to learn from, all documents score the share of toxic ones
that is known, or 0.5 where nothing is.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.llm.common import BASE, BASE_INVERSE, BYTE_CODES, binary_buffers, durable, mix64, pieces, powers, query, table, word_hashes

THRESHOLD = 0.5
LABELLED = 200_000        # labelled documents to learn from, at most about
FOLDS = 5                 # fold 0 is held out, fold CALIBRATE calibrates, the others count
CALIBRATE = 4
FLAT, PRIOR = 0.1, 2000.0     # the prior: so many tokens for each unit, so many in proportion to all documents
CREDIBLE = 2.0
DRIFT = 0.5
MODEL_UNITS = 1 << 18     # units with a score, the strongest
PASSAGE = 0.05            # a passage is significant if so many like it are expected in clean text of that length, or fewer
PREFIXES = (8, 7, 6, 5, 4, 3)
HELD_UNITS = 1 << 22      # counted units of a task before they are added up
BINS = 4096
RIDGE = 1e-3

LETTER = np.zeros(256, bool)
LETTER[[*range(48, 58), *range(65, 91), *range(97, 123), 39]] = True
LETTER[128:] = True
TO_BLANK = np.where(LETTER, np.arange(256), 32).astype(np.uint8)
TAGS = np.uint64(3)


def token_units(raw: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of each token's units from the most specific on (0: none), low two bits clear; first and end bytes; offsets by row."""
    text = TO_BLANK[raw]
    whole, s, e, bounds = word_hashes(text, offs)
    units = [whole]
    if len(s):
        n = len(text)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_CODES[text] * powers(BASE, n), out=total[1:])
        back = powers(BASE_INVERSE, n)[s]
        for k in PREFIXES:
            h = mix64(((total[np.minimum(e, s + k)] - total[s]) * back) ^ np.uint64(k << 32))
            units.append(np.where(e - s > k, h, np.uint64(0)))
    else:
        units += [whole] * len(PREFIXES)
    return [u & ~TAGS for u in units], s, e, bounds


def repeats(token: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Which tokens stand right behind an equal one of the same text: they say nothing new."""
    again = np.zeros(len(token), bool)
    again[1:] = token[1:] == token[:-1]
    again[bounds[bounds < len(token)]] = False
    return again


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, count = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key, kind="stable")
    key, count = key[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(count, first) if len(first) else count


def unit_counts(docs: DataFrame) -> DataFrame:
    """level, unit, n in all rows of ``docs`` (text, label), n_clean and n_toxic in those labelled 0 and 1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = range(1 + len(PREFIXES))
        keys: list[list] = [[] for _ in levels]
        counts: list[list] = [[] for _ in levels]

        def put():
            for k in levels:
                if keys[k]:
                    key, n = _added(keys[k], counts[k])
                    tag = key & TAGS
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(key), k, np.int32)), pa.array((key & ~TAGS).view(np.int64)), pa.array(n),
                        pa.array(np.where(tag == 1, n, 0)), pa.array(np.where(tag == 2, n, 0))], names=["level", "unit", "n", "n_clean", "n_toxic"])
                    keys[k], counts[k] = [], []

        for b in batches:
            raw, offs = binary_buffers(b.column(0))
            label = b.column(1).to_numpy(zero_copy_only=False)
            for i, j, part, o in pieces(raw, offs):
                units, _, _, bounds = token_units(part, o)
                tag = np.repeat((label[i:j] + 1).astype(np.uint64), np.diff(bounds))
                new = np.flatnonzero(~repeats(units[0], bounds))
                _, at, n = np.unique(units[0][new] | tag[new], return_index=True, return_counts=True)
                at = new[at]
                for k, u in enumerate(units):            # equal tokens have equal prefixes
                    some = u[at] > 0
                    keys[k].append((u[at] | tag[at])[some])
                    counts[k].append(n[some])
                for k in levels:
                    if sum(map(len, keys[k])) > HELD_UNITS:
                        key, n = _added(keys[k], counts[k])
                        keys[k], counts[k] = [key], [n]
                if max(len(keys[k][0]) for k in levels) > HELD_UNITS // 2:
                    yield from put()
        yield from put()

    # null labels are -1: neither clean nor toxic
    rows = docs.select("text", F.coalesce(F.col("label").cast("int"), F.lit(-1)).alias("label"))
    parts = rows.mapInArrow(run, "level int, unit long, n long, n_clean long, n_toxic long")
    return parts.groupBy("level", "unit").agg(*[F.sum(c).alias(c) for c in ("n", "n_clean", "n_toxic")])


def log_odds(counts: DataFrame) -> DataFrame:
    """unit and score of the units whose credible interval leaves out 0."""
    total = counts.groupBy("level").agg(*[F.sum(c).alias(f"all_{c}") for c in ("n", "n_clean", "n_toxic")])      # one row a level
    prior = FLAT + PRIOR * F.col("n") / F.col("all_n")

    def logit(c: str) -> Column:
        return F.log((F.col(c) + prior) / (F.col(f"all_{c}") + PRIOR - F.col(c)))

    ratio = logit("n_toxic") - logit("n_clean")
    spread = F.sqrt(1 / (F.col("n_toxic") + prior) + 1 / (F.col("n_clean") + prior))
    # with labels of one kind only no log-odds say anything
    known = counts.where("n_clean + n_toxic > 0").join(F.broadcast(total.where("all_n_clean > 0 AND all_n_toxic > 0")), "level")
    left = known.select("unit", ratio.alias("ratio"), (F.abs(ratio) - CREDIBLE * spread).alias("sure")).where("sure > 0")
    return left.select("unit", (F.signum("ratio") * F.col("sure")).alias("score"))


def segments(start: np.ndarray, score: np.ndarray, before: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments over the positive tokens: (first, last, score) as positions in ``start``.

    ``before`` is the running total of the whole text before each. Each kept segment points to the nearest one to its left that
    begins lower; the search follows these pointers, so a text takes linear time.
    """
    kept: list[tuple[int, int, float, float, int]] = []       # first, last, total before, total behind, pointer
    for k, (low, gain) in enumerate(zip(before.tolist(), score.tolist())):
        first, high = k, low + gain
        while True:
            j = len(kept) - 1
            while j >= 0 and kept[j][2] >= low:
                j = kept[j][4]
            if j < 0 or kept[j][3] >= high:
                kept.append((first, k, low, high, j))
                break
            first, low = kept[j][0], kept[j][2]
            del kept[j:]
    return [(a, b, high - low) for a, b, low, high, _ in kept]


@dataclass
class Model:
    """Scores of the units and the numbers of the calibration, sent with the tasks."""
    units: np.ndarray             # ascending
    scores: np.ndarray
    drift: float = DRIFT
    rate: float = 1.0             # lambda
    scale: float = 1.0            # K
    curve: tuple[float, float] = (0.0, 0.0)

    def __post_init__(self):
        self.near = np.zeros(1 << 20, bool)
        self.near[(self.units >> np.uint64(44)).astype(np.int64)] = True

    def token_scores(self, units: list[np.ndarray]) -> np.ndarray:
        """Score of the strongest unit, before the drift; 0 without any."""
        out = np.zeros(len(units[0]))
        for u in units:
            maybe = np.flatnonzero(self.near[(u >> np.uint64(44)).astype(np.int64)])
            at = np.minimum(np.searchsorted(self.units, u[maybe]), len(self.units) - 1)
            value = np.where(self.units[at] == u[maybe], self.scores[at], 0.0)
            better = np.abs(value) > np.abs(out[maybe])
            out[maybe[better]] = value[better]
        return out

    def found(self, column: pa.Array) -> Iterator[tuple[np.ndarray, int, list[tuple[int, int, float]]]]:
        """For each text: scores of its tokens without drift, their number, and its segments (first byte, end byte, score)."""
        raw, offs = binary_buffers(column)
        for i, j, part, o in pieces(raw, offs):
            units, s, e, bounds = token_units(part, o)
            plain = self.token_scores(units)
            plain[repeats(units[0], bounds)] = 0
            score = plain - self.drift
            total = np.concatenate([[0.0], np.cumsum(score)])
            rising = np.flatnonzero(score > 0)
            cuts = np.searchsorted(rising, bounds)
            for r in range(j - i):
                at = rising[cuts[r]: cuts[r + 1]]
                segs = [(int(s[at[a]] - o[r]), int(e[at[b]] - o[r]), v) for a, b, v in segments(at, score[at], total[at])] if len(at) else []
                yield plain[bounds[r]: bounds[r + 1]], int(bounds[r + 1] - bounds[r]), segs

    def evidence(self, n: int, values: np.ndarray) -> float:
        """Minus the logarithm of the probability of segments as good as these in clean text of n tokens."""
        if not len(values):
            return 0.0
        x = np.sort(self.rate * np.asarray(values, float) - np.log(self.scale * max(n, 1)))[::-1]
        best = -np.log(max(-np.expm1(-np.exp(min(-x[0], 50.0))), 1e-300)) if x[0] < 30 else x[0]
        x = x[x > 0]
        if len(x) > 1:
            r = np.arange(1, len(x) + 1)
            total = np.cumsum(x)
            factorials = np.cumsum(np.log(r))               # ln r!
            ln_p = -total + (r - 1) * np.log(total) - factorials - (factorials - np.log(r)) + r * np.log(2)
            valid = (r > 1) & (total > r * (r - 1))
            if valid.any():
                best = max(best, float(-ln_p[valid].min()))
        return max(float(best), 0.0)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        a, b = self.curve
        return 1 / (1 + np.exp(-np.clip(a + b * np.log1p(evidence), -700, 700)))


def solve_rate(values: np.ndarray, weights: np.ndarray) -> float:
    """The positive root of sum(weights * exp(rate * values)) = 1 for a negative mean and some positive value, by bisection."""
    p = weights / weights.sum()
    low, high = 0.0, 1.0
    while (p * np.exp(np.minimum(high * values, 700))).sum() < 1 and high < 1e6:
        low, high = high, high * 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (low, mid) if (p * np.exp(np.minimum(mid * values, 700))).sum() > 1 else (mid, high)
    return high


def logistic(x: np.ndarray, n: np.ndarray, positive: np.ndarray) -> tuple[float, float]:
    """Intercept and slope (0 at least) of counted points, by Newton steps with a small ridge."""
    design = np.stack([np.ones(len(x)), x], axis=1)
    w = np.zeros(2)
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -500, 500)))
        gradient = design.T @ (positive - n * p) - RIDGE * w
        step = np.linalg.solve((design * (n * p * (1 - p))[:, None]).T @ design + RIDGE * np.eye(2), gradient)
        w = w + step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0]), max(float(w[1]), 0.0)


def learnable(labels: DataFrame) -> DataFrame:
    """doc_id, label (0 or 1) and fold of at most about LABELLED documents outside fold 0; a document labelled twice takes the larger."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("int").alias("label")).where("label IN (0, 1) AND doc_id IS NOT NULL")
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)).cast("int")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).withColumn("fold", fold).where("fold <> 0")
    share = min(1.0, LABELLED / max(known.count(), 1))
    return known.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)))


def fit(docs: DataFrame, labels: DataFrame) -> Model | float:
    """Model of ``labels`` (doc_id, label) over all ``docs`` (doc_id, text), or the share of toxic documents where none can be made."""
    known = durable(learnable(labels), "toxic-labels")       # about LABELLED rows: the broadcasts below are bounded
    share = known.agg(F.avg("label")).first()[0]
    counted = known.where(F.col("fold") != CALIBRATE).select("doc_id", "label")
    counts = durable(unit_counts(docs.join(F.broadcast(counted), "doc_id", "left")), "toxic-counts")
    top = log_odds(counts).orderBy(F.abs("score").desc(), "unit").limit(MODEL_UNITS).toPandas()
    if not (top["score"] > DRIFT).any():
        return 0.5 if share is None else share
    top = top.assign(unit=top["unit"].to_numpy().view(np.uint64)).sort_values("unit")
    model = Model(top["unit"].to_numpy(), top["score"].to_numpy())

    held = known.where(F.col("fold") == CALIBRATE)
    held = (known if held.where("label = 0").isEmpty() or held.where("label = 1").isEmpty() else held).select("doc_id", "label")
    edges = np.linspace(model.scores.min() - 1e-9, model.scores.max() + 1e-9, BINS + 1)

    def scan(batches):
        for b in batches:
            label = b.column(1).to_pylist()
            rows = [(label[k], n, [v for _, _, v in segs], np.histogram(plain, edges)[0] if label[k] == 0 else None)
                    for k, (plain, n, segs) in enumerate(model.found(b.column(0)))]
            clean = [r[3] for r in rows if r[3] is not None]
            hist = [np.sum(clean, axis=0).tolist() if k == 0 and clean else None for k in range(len(rows))]
            yield pa.RecordBatch.from_pydict({"label": pa.array(label, pa.int32()), "n": pa.array([r[1] for r in rows], pa.int64()),
                                              "segs": pa.array([r[2] for r in rows], pa.list_(pa.float64())), "hist": pa.array(hist, pa.list_(pa.int64()))})

    def calibration(drift: float) -> DataFrame:
        model.drift = drift
        rows = docs.join(F.broadcast(held), "doc_id").select("text", "label")
        return durable(rows.mapInArrow(scan, "label int, n long, segs array<double>, hist array<long>"), "toxic-calibration")

    rows = calibration(DRIFT)
    bins = rows.where("hist IS NOT NULL").select(F.posexplode("hist").alias("bin", "n")).groupBy("bin").agg(F.sum("n").alias("n")).collect()
    weights = np.zeros(BINS)
    for r in bins:                # BINS rows at most
        weights[r["bin"]] = r["n"]
    weights[-1] += 1              # the best score is possible in clean text
    values = (edges[1:] + edges[:-1]) / 2
    mean = float((values * weights).sum() / weights.sum())
    if mean > 0:                  # clean text scores above 0 on average: a drift of DRIFT more than that
        rows = calibration(mean + DRIFT)
    model.rate = solve_rate(values - model.drift, weights)
    best = F.coalesce(F.array_max("segs"), F.lit(0.0))
    fitted = rows.where("label = 0 AND n > 0").agg(F.count("*").alias("n"), F.sum(F.col("n") * F.exp(-model.rate * best)).alias("s")).first()
    model.scale = max(fitted["n"] / fitted["s"], 1e-12) if fitted["s"] else 1.0

    def weigh(frames):
        for f in frames:
            found = [model.evidence(n, segs) for n, segs in zip(f["n"], f["segs"])]
            yield pd.DataFrame({"x": np.round(np.log1p(found), 2), "label": f["label"]})

    curve = rows.mapInPandas(weigh, "x double, label int").groupBy("x").agg(F.count("*").alias("n"), F.sum("label").alias("p")).toPandas()    # x below 10: 1,000 rows
    if curve.empty:
        return 0.5 if share is None else share
    model.curve = logistic(curve["x"].to_numpy(), curve["n"].to_numpy(float), curve["p"].to_numpy(float))
    return model


SCORED = "score double, evidence double, passages array<struct<first:int,end:int,score:double,expected:double>>"


def scored(docs: DataFrame, model: Model | float, text: str = "text") -> DataFrame:
    """``row`` (struct of all columns of ``docs`` but the text), score, evidence and passages: bytes first to end of the significant
    segments, their score, and how many as good are expected in clean text of the same length."""
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != text] or [F.lit(None).cast("string").alias("none")])
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    if not isinstance(model, Model):
        return rows.select("row", F.lit(float(model)).alias("score"), F.lit(0.0).alias("evidence"), F.array().cast(SCORED.rpartition("passages ")[2]).alias("passages"))

    def run(batches):
        kind = pa.list_(pa.struct([("first", pa.int32()), ("end", pa.int32()), ("score", pa.float64()), ("expected", pa.float64())]))
        for b in batches:
            evidence, passages = np.zeros(b.num_rows), []
            for k, (_, n, segs) in enumerate(model.found(b.column(1))):
                evidence[k] = model.evidence(n, [v for _, _, v in segs])
                expected = [model.scale * n * np.exp(-model.rate * v) for _, _, v in segs]
                passages.append([{"first": a, "end": z, "score": v, "expected": x} for (a, z, v), x in zip(segs, expected) if x <= PASSAGE])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(model.score(evidence)), pa.array(evidence), pa.array(passages, kind)],
                                             names=["row", "score", "evidence", "passages"])

    return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, {SCORED}")


@query("op12_toxicity")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document: score, prediction, number of significant passages and the bytes they cover."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels").select("doc_id", F.col("toxic").alias("label")))
    out = scored(docs, model).withColumn("doc_id", F.col("row.doc_id"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(FOLDS)) == 0
    covered = F.aggregate("passages", F.lit(0).cast("long"), lambda t, p: t + p["end"] - p["first"])
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
                      F.size("passages").cast("long").alias("n_passages"), covered.alias("passage_bytes"))
