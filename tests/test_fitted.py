"""Fitted models inside the audit, their drivers and variants: invariants and brute force."""

import threading
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import costing, fitted, models
from lanewise.plans import queries_fitted
from lanewise.plans.freight_view import FreightView

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def run(spark):
    job = queries_fitted.Fitted(FreightView(spark, FOLDER))
    queries_fitted.FIT = {"max_iter": 3, "max_depth": 3}
    loaded = job.models()
    return job, loaded, job.scored(loaded).cache()


def test_every_passed_invoice_has_a_probability(run):
    _, loaded, scored = run
    rows = scored.select("gate_passed", "model2_proba", "fair_cost", "fair_lower", "fair_upper", "flagged", "flag_source", "explanation", "billed_message", "field_errors").collect()
    passed = [r for r in rows if r["gate_passed"]]
    assert len(passed) > 1000 and len(rows) > len(passed)
    for r in passed:
        assert 0 <= r["model2_proba"] <= 1 and r["fair_lower"] <= r["fair_cost"] <= r["fair_upper"]
        assert not r["model2_proba"] >= loaded.threshold or r["flag_source"] in ("model", "model+logic_check")
        assert r["billed_message"] is None or r["explanation"].startswith("Price check: ")
    assert {r["flag_source"] for r in passed} & {"model", "model+logic_check"}
    assert all(r["model2_proba"] is None and r["field_errors"] for r in rows if not r["gate_passed"])


def test_orders_take_the_model_that_left_them_out(spark, run):
    job, loaded, scored = run
    frame = models.cost_frame(job.orders, ["order_id", "order_seq"]).withColumn("fold", fitted.fold_of("order_seq"))
    left_out = models.fit_cost_ratio(frame.where("fold <> 2"), max_iter=3, max_depth=3)
    again = {r["order_id"]: r["ratio"] for r in left_out.transform(frame.where("fold = 2")).collect()}
    kept = {r["order_id"]: r["ratio"] for r in loaded.order_ratios.where("fold = 2").collect()}
    assert set(again) == set(kept) and len(kept) > 50
    assert np.median([abs(again[k] - kept[k]) for k in kept]) < 1e-2      # the same data; trees may split ties otherwise
    used = {r["order_id"]: r["ratio"] for r in scored.where("order_found").select("order_id", "ratio").collect()}
    assert all(abs(used[k] - kept[k]) < 1e-12 for k in kept if k in used)
    assert scored.where("NOT order_found AND ratio IS NULL AND gate_passed").isEmpty()


def test_band_covers_eighty_percent(run):
    _, loaded, _ = run
    rows = loaded.with_band(loaded.order_ratios)
    share = rows.agg(F.avg(F.col("cost_ratio").between(F.col("low"), F.col("high")).cast("double"))).first()[0]
    assert 0.75 <= share <= 0.87


def test_bounds_are_learned(run):
    _, loaded, _ = run
    assert set(C.PRICE_BOUNDS) <= set(loaded.bounds) and loaded.bounds["genuine_invoices"] > 100
    assert loaded.bounds["cost_per_km_min"] != C.PRICE_BOUNDS["cost_per_km_min"] and loaded.reference_diesel != C.REFERENCE_DIESEL


def test_reload_gives_the_same_scores(spark, run):
    job, loaded, _ = run
    again = fitted.load_audit_models(spark, job.folder)
    cases = fitted.risk_cases(job.price(loaded.with_order_ratio(job.orders), loaded)).limit(200).cache()
    one, two = ({r["invoice_id"]: r["model2_proba"] for r in m.with_proba(cases).collect()} for m in (loaded, again))
    assert len(one) == 200 and all(abs(one[k] - two[k]) <= 1e-3 for k in one)


def test_incomplete_fit_is_refused(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        fitted.load_audit_models(spark, str(tmp_path / "none"))


def average_precision(y, s):
    out = last = 0.0
    for t in sorted(set(s), reverse=True):
        called = s >= t
        recall = (y & called).sum() / y.sum()
        out += (recall - last) * (y & called).sum() / called.sum()
        last = recall
    return out


def test_variant_table(spark, run):
    job, loaded, _ = run
    rows = spark.read.parquet(f"{job.folder}/variant_scores").toPandas()
    table = {r["variant"]: r for r in spark.read.parquet(f"{job.folder}/variants").collect()}
    assert set(table) == set(fitted.VARIANTS) == set(rows["variant"])
    for name, part in rows.groupby("variant"):
        y, now, later = part["requires_manual_review"].to_numpy() == 1, part["proba_now"].to_numpy(), part["proba_later"].to_numpy()
        assert abs(table[name]["pr_auc"] - average_precision(y, now)) < 1e-9
        assert abs(table[name]["verdicts_changed_pct"] - 100 * ((now >= 0.5) != (later >= 0.5)).mean()) < 1e-9
        assert abs(table[name]["recall"] - (now >= 0.5)[y].mean()) < 1e-9
        for kind, recall in table[name]["recall_by_anomaly"].items():
            mine = y & (part["anomaly_type"].fillna("unknown") == kind).to_numpy()
            assert abs(recall - (now >= 0.5)[mine].mean()) < 1e-9
    for name in ("scale_free", "scale_free_monotone", "deflated", "deflated_monotone"):
        assert table[name]["verdicts_changed_pct"] < 0.5          # a general price rise is no news to these
    pool = [r for r in table.values() if r["verdicts_changed_pct"] < 0.5]
    top = max(r["pr_auc"] for r in pool)
    best = sorted((r for r in pool if r["pr_auc"] >= top - 0.005), key=lambda r: (not r["monotone"], -r["pr_auc"], r["variant"]))[0]
    assert loaded.variant == best["variant"]


def test_monotone_variant_rises_with_the_bill(run):
    job, loaded, _ = run
    cases = fitted.risk_cases(job.price(loaded.with_order_ratio(job.orders), loaded)).cache()
    model = fitted.fit_variant(cases, "scale_free_monotone", loaded.reference_diesel)
    higher = cases.withColumn("actual_billed_amount", F.col("actual_billed_amount") * 1.2)
    before, after = ({r["invoice_id"]: r["proba_now"] for r in fitted.price_rise_scores(model, d, "scale_free_monotone", loaded.reference_diesel).collect()} for d in (cases, higher))
    assert len(before) > 500 and all(after[k] >= before[k] - 1e-12 for k in before)


def test_drivers_of_a_linear_model(spark):
    rng = np.random.default_rng(1)
    rows = [(k, *map(float, rng.normal(size=3))) for k in range(200)]
    frame = spark.createDataFrame([(*r, 2 * r[1] - 3 * r[2] + 0.5 * r[3] + 1) for r in rows], "id long, a double, b double, c double, y double")
    inputs = ["a", "b", "c"]
    model = Pipeline(stages=[VectorAssembler(inputCols=inputs, outputCol="features"), LinearRegression(featuresCol="features", labelCol="y", predictionCol="ratio")]).fit(frame)
    means = fitted.training_means(frame, inputs)
    weights = dict(zip(inputs, model.stages[-1].coefficients))
    for r in fitted.with_drivers(model, frame, means, {"a": ["a"], "rest": ["b", "c"]}).collect():
        got = {d["feature"]: d["delta"] for d in r["drivers"]}
        assert abs(got["a"] - weights["a"] * (r["a"] - means["a"])) < 1e-6
        assert abs(got["rest"] - sum(weights[c] * (r[c] - means[c]) for c in "bc")) < 1e-6


def test_top_drivers_read_them(run):
    _, _, scored = run
    for r in scored.where("gate_passed").select("drivers", "baseline_cost", "adjustment_drivers").limit(50).collect():
        want = sorted((-abs(round(d["delta"] * r["baseline_cost"], 2)) for d in r["drivers"]))[:3]
        assert [-abs(d["impact"]) for d in r["adjustment_drivers"]] == pytest.approx(want, abs=0.011)
        assert {d["feature"] for d in r["adjustment_drivers"]} <= set(fitted.cost_groups())


def test_side_by_side(spark):
    got = fitted.side_by_side(spark, {n: lambda n=n: spark.range(n).count() for n in (1, 5, 9)}, 3)
    assert got == {1: 1, 5: 5, 9: 9}


def test_attributions_follow_the_baseline(spark):
    df = spark.createDataFrame([([("x", 0.5), ("y", -0.25)], 100.0)], "drivers array<struct<feature:string,delta:double>>, base double")
    row = df.select(costing.top_drivers(fitted.attributions(F.col("drivers"), F.col("base")), 2).alias("t")).first()["t"]
    assert [(d["feature"], d["impact"]) for d in row] == [("x", 50.0), ("y", -25.0)]


def test_reference_context_and_typical_padding(run):
    """A reference row overrides the measured weather and the padding; a new order takes its carrier's typical padding and trip weather."""
    from lanewise.plans import audit
    from lanewise.plans.freight_view import extracted_from_invoices
    job, loaded, _ = run
    v, some = job.view, job.invoices.where("invoice_seq % 40 = 1")
    ids = [r["order_id"] for r in some.join(job.orders.select("order_id"), "order_id").select("order_id").limit(4).collect()]
    reference = v.spark.createDataFrame([(i, f"INV{k}", 7, 1.5) for k, i in enumerate(ids)], "order_id string, invoice_id string, adverse_weather_days int, vendor_padding_ratio double")
    paddings = v.vendors.select("vendor_id", F.lit(1.23).alias("padding_median"))
    out = audit.score_invoices(extracted_from_invoices(some), loaded.with_order_ratio(job.orders), v.hubs, v.routes, v.fuel_prices, v.weather, job.history,
                               models=loaded, paddings=paddings, reference=reference)
    rows = out.where("gate_passed").select("order_id", "order_found", "adverse_weather_days", "adverse_weather_source", "vendor_padding_ratio", "quoted_days", "ideal_days", "expected_weather_score", "vendor_id").collect()
    assert len(rows) > 30
    for r in rows:
        if r["order_id"] in ids:
            assert (r["adverse_weather_days"], r["adverse_weather_source"], r["vendor_padding_ratio"]) == (7, "reference", 1.5)
        elif r["order_found"]:
            assert r["adverse_weather_source"] != "reference" and r["vendor_padding_ratio"] == pytest.approx(r["quoted_days"] / max(r["ideal_days"], 0.1))
        else:
            assert r["vendor_padding_ratio"] == (1.23 if r["vendor_id"] else C.FALLBACK_PADDING)
    assert any(not r["order_found"] and r["expected_weather_score"] > 0 for r in rows) or all(r["order_found"] for r in rows)


def test_fits_of_the_cost_model_run_side_by_side(spark, monkeypatch):
    together = threading.Barrier(2, timeout=30)      # a fit that is alone waits in vain

    def fit(rows, **given):
        together.wait()
        return SimpleNamespace(transform=lambda df: df.withColumns({"features": F.lit(0), "ratio": F.lit(1.0)}))
    monkeypatch.setattr(models, "fit_cost_ratio", fit)
    frame = spark.range(200).select(F.col("id").alias("order_seq"), (F.col("id") / 100).alias("cost_ratio"), F.lit("t").alias("truck_type"), F.lit("c").alias("product_category"))
    model, oof = models.fair_cost_model(frame, "order_seq")
    assert oof.count() == 200 and model.bands.count() == 1
    assert abs(model.overall.first()["p10"] - 0.199) < 1e-9
