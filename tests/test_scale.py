"""Running totals, percentiles, the bootstrap and the place lookup against brute force, on skewed data with ties."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lanewise.operators import enrich, metrics, scale


@pytest.mark.parametrize("window_rows", [1 << 20, 100])
@pytest.mark.parametrize("descending", [True, False])
def test_running_total(spark, window_rows, descending):
    rng = np.random.default_rng(1)
    rows = [("hot" if k % 3 else f"g{k % 5}", k, float(x), int(n)) for k, (x, n) in enumerate(zip(rng.lognormal(size=1500), rng.integers(0, 9, 1500)))]
    df = spark.createDataFrame(rows, "g string, k long, x double, n long").repartition(5)
    got = {(r["g"], r["k"]): r["cum_n"] for r in scale.running_total(df, "x", ["n"], ["g"], descending, window_rows).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == g), key=lambda r: r[2], reverse=descending)
        total = 0
        for r in mine:
            total += r[3]
            assert got[g, r[1]] == total


def test_ranges_stay_small(spark):
    df = spark.range(20_000).selectExpr("id * id AS x", "1 AS n")
    plan = scale.running_total(df, "x", ["n"], window_rows=500)
    last = {r["x"]: r["cum_n"] for r in plan.where("x % 7 = 0").collect()}
    assert all(last[k * k] == 20_000 - k for k in range(0, 20_000, 7))


@pytest.mark.parametrize("window_rows", [1 << 20, 50])
def test_exact_percentiles(spark, window_rows):
    rng = np.random.default_rng(2)
    values = np.concatenate([np.round(rng.lognormal(2, 2, 4000), 2), np.full(2500, 7.0), [-1e6, 1e9]])
    df = spark.createDataFrame([("a" if k % 4 else "b", float(v)) for k, v in enumerate(values)], "g string, v double").repartition(6)
    want = {"p1": 0.001, "p50": 0.5, "p99": 0.999}
    got = scale.exact_percentiles(df, "v", want, slack=0.05, window_rows=window_rows).first()
    for n, p in want.items():
        assert got[n] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)
    for r in scale.exact_percentiles(df, "v", want, ["g"], slack=0.05, window_rows=window_rows).collect():
        mine = [v for k, v in enumerate(values) if ("a" if k % 4 else "b") == r["g"]]
        for n, p in want.items():
            assert r[n] == pytest.approx(np.percentile(mine, 100 * p), rel=1e-12)


@pytest.mark.parametrize("values", [np.random.default_rng(3).lognormal(0, 1.5, 3000), np.random.default_rng(4).integers(0, 3, 800) / 2.0, np.array([5.0]), np.full(50, 2.5)])
def test_bootstrap(spark, values):
    got = metrics.bootstrap_ci(spark.createDataFrame([(float(v),) for v in values] + [(None,)], "v double"), "v").first()
    rng = np.random.default_rng(9)
    means = np.array([rng.choice(values, len(values)).mean() for _ in range(4000)])
    assert got["mean"] == pytest.approx(values.mean())
    # Monte-Carlo error of a 2.5 % quantile of 2,000 replicas is about 0.055 standard errors; four of them
    slack = 0.25 * means.std() + 1e-9
    assert abs(got["ci_low"] - np.percentile(means, 2.5)) < slack and abs(got["ci_high"] - np.percentile(means, 97.5)) < slack


def test_bootstrap_of_nothing(spark):
    assert tuple(metrics.bootstrap_ci(spark.createDataFrame([(None,)], "v double"), "v").first()) == (None, None, None)


HUBS = [("H1", "Navi Mumbai", "MH"), ("H2", "Mumbai", "MH"), ("H3", "Pu", "MH"), ("H4", "Ål", "NO"), ("H5", "", "XX"), ("H6", "New Delhi", "DL"), ("H7", "日本橋", "JP"), ("H8", "a", "AA")]


def brute_hub(place):
    t = (place or "").strip(" ").lower()
    if not t:
        return None
    exact = [h for h, c, _ in HUBS if t in (c.strip(" ").lower(), h.lower())]
    near = [h for h, c, _ in HUBS if c and (c.lower() in t or t in c.lower())]
    return min(exact) if exact else min(near) if near else None


def test_city_to_hub(spark):
    long = "x" * 10_000 + "new delhi" + "y" * 10_000
    places = ["mumbai", "MUMBAI ", "navi", "near Navi Mumbai gate", "pu", "p", "ål", "Åland", "Delhi", "delh", "h6", "日本", "東京日本橋", "", " ", None, "zzz", long, "b" * 20_000, "um", "i", "w d"]
    hubs = spark.createDataFrame(HUBS, "hub_id string, city string, state string")
    df = spark.createDataFrame(list(enumerate(places)), "k int, place string")
    started = time.time()
    got = {r["k"]: r["place_hub_id"] for r in enrich.city_to_hub(df, hubs, "place").collect()}
    assert time.time() - started < 30
    assert got == {k: brute_hub(p) for k, p in enumerate(places)}


def test_place_work_is_linear(spark):
    """A text gives one candidate row for each character at most."""
    text = spark.createDataFrame([("abc" * 7000 + str(k) * 9,) for k in range(3)], "t string")
    rows = text.select(F.size(enrich._grams(F.col("t"), [3])).alias("n")).collect()
    assert all(r["n"] <= 21_009 for r in rows)


def test_gate_reasons_are_made_once(spark):
    """No filter on the number of reasons reaches the rows, where each reason would be worked out once more."""
    rows = spark.createDataFrame([("a,b",), ("b",), ("",), (None,)], "t string")
    reasons = F.when(F.col("t") != "", F.split(F.upper("t"), ",")).when(F.col("t") == "", F.array().cast("array<string>"))
    out = metrics.gate_reason_counts(rows.select(reasons.alias("reasons")))
    assert {(r["reason"], r["n"]) for r in out.collect()} == {("A", 1), ("B", 2)}
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("upper(") == 1 and "size(" not in plan
