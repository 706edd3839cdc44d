"""Aggregates: carrier statistics, dashboards, model metrics, extraction quality."""

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import text
from lanewise.functions.numeric import laplace_score, wilson
from lanewise.operators.gate import reasons_of
from lanewise.operators.scale import exact_percentiles, running_before, running_total
from lanewise.session import cut_lineage

OK_STATUSES = ("correct", "correct_null")


# ---- carriers ---------------------------------------------------------------------

def vendor_stats(invoices: DataFrame, flag: str = "requires_manual_review") -> DataFrame:
    return invoices.groupBy("vendor_id").agg(F.count("*").alias("total_invoices"),
                                             F.sum(F.col(flag).cast("bigint")).alias("flagged_invoices"))


def vendor_scores_view(vendors: DataFrame, stats: DataFrame, cold_start: str = "prior") -> DataFrame:
    """Every carrier with its counters (0 when it has none) and smoothed flag rate."""
    joined = vendors.join(stats, "vendor_id", "left").fillna(0, ["total_invoices", "flagged_invoices"])
    return joined.withColumn("risk_score", laplace_score(F.col("flagged_invoices"), F.col("total_invoices"), cold_start))


def vendor_leaderboard(vendors: DataFrame, stats: DataFrame) -> DataFrame:
    return (vendor_scores_view(vendors, stats)
            .select("vendor_id", "vendor_name", "home_state", "total_invoices", "flagged_invoices", "risk_score")
            .orderBy(F.desc("risk_score"), "vendor_id"))


def vendor_padding_median(invoices: DataFrame, vendors: DataFrame) -> DataFrame:
    """Median positive padding per carrier -> overall median -> fixed default."""
    positive = cut_lineage(invoices.where(F.col("vendor_padding_ratio") > 0).select("vendor_id", "vendor_padding_ratio"))
    per_vendor = exact_percentiles(positive, "vendor_padding_ratio", {"own_median": 0.5}, ["vendor_id"])
    overall = exact_percentiles(positive, "vendor_padding_ratio", {"overall": 0.5})
    return (vendors.select("vendor_id").join(per_vendor, "vendor_id", "left")
            .withColumn("padding_median", F.coalesce("own_median", overall.scalar(), F.lit(C.FALLBACK_PADDING)))
            .select("vendor_id", "padding_median"))


def causal_vendor_risk(invoices: DataFrame, day: str, seq: str, flag: str = "requires_manual_review",
                       cold_start: str = "prior") -> DataFrame:
    """Smoothed flag rate of the carrier over its strictly earlier invoices."""
    past = running_before(invoices, "vendor_id", day, seq,
                          {"prior_total": F.lit(1), "prior_flagged": F.col(flag).cast("bigint")})
    return past.withColumn("vendor_historical_risk_score",
                           laplace_score(F.col("prior_flagged"), F.col("prior_total"), cold_start))


# ---- dashboards -------------------------------------------------------------------

def dashboard_kpis(log: DataFrame, latest: int) -> DataFrame:
    """Headline counts over the ``latest`` audits."""
    recent = log.orderBy(F.desc("created_at"), F.desc("id")).limit(latest)
    total = F.count("*")
    return recent.agg(total.alias("total"), F.count_if("gate_passed").alias("passed"),
                      F.count_if(~F.col("gate_passed")).alias("rejected"),
                      F.coalesce(F.try_divide(F.count_if("gate_passed"), total), F.lit(0.0)).alias("auto_rate"),
                      F.count_if(F.col("gate_passed") & F.col("flagged")).alias("flagged"),
                      F.count_if(F.size("manual_fields") > 0).alias("with_manual_entry"))


def rejection_breakdown(log: DataFrame) -> DataFrame:
    """Rejections by reason code with their share; the code is what precedes the colon."""
    counts = (log.where(F.col("gate_reason").isNotNull())
              .groupBy(F.split_part("gate_reason", F.lit(":"), F.lit(1)).alias("reason")).agg(F.count("*").alias("n")))
    total = counts.agg(F.sum("n"))
    return (counts.withColumn("share", F.col("n") / total.scalar())
            .orderBy(F.desc("n"), "reason"))


# ---- learned ranges and model metrics -----------------------------------------------

def training_ranges(orders: DataFrame, tails: bool = True) -> DataFrame:
    """One row: min, max and, with ``tails``, the 1st and 99th percentile of the drift features."""
    names = list(C.DRIFT_LABELS)
    ends = orders.agg(*[f(n).alias(f"{n}_{s}") for n in names for s, f in (("min", F.min), ("max", F.max))])
    if not tails:
        return ends.select(*[F.round(c, 2).alias(c) for c in ends.columns])
    cells = orders.select(F.inline(F.array(*[F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names])))
    quantiles = exact_percentiles(cells, "value", {"p01": 0.01, "p99": 0.99}, ["feature"])
    # four rows
    box = quantiles.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("p01", "p99"))))).scalar()
    ends = ends.withColumns({f"{n}_{p}": box[n][p] for n in names for p in ("p01", "p99")})
    return ends.select(*[F.round(c, 2).alias(c) for c in ends.columns])


def price_bounds(orders: DataFrame, genuine: DataFrame) -> DataFrame:
    """One row of learned bounds: cost per km from orders, bill ratios from genuine invoices."""
    per_km = orders.select((F.col("base_freight_cost") / F.col("distance_km")).alias("per_km"))
    tails = exact_percentiles(per_km, "per_km", {"lo": 0.001, "hi": 0.999})
    box = tails.select(F.struct("lo", "hi").alias("b")).scalar()
    billed = F.col("actual_billed_amount")
    low, high = (F.greatest(c, F.lit(1.0)) for c in ("fair_lower", "fair_upper"))
    bounds = genuine.agg((F.min(billed / low) * 0.8).alias("low"), (F.max(billed / high) * 1.5).alias("high"),
                         (F.max(billed - F.col("fair_upper")) * 1.5).alias("excess"), F.count("*").alias("genuine_invoices"))
    return bounds.select(F.round(box["lo"] * 0.5, 2).alias("cost_per_km_min"), F.round(box["hi"] * 3.0, 2).alias("cost_per_km_max"),
                         F.round("low", 3).alias("billed_low_ratio"), F.round("high", 3).alias("billed_high_ratio"),
                         F.round("excess", 0).alias("billed_high_abs"), "genuine_invoices")


def regression_metrics(df: DataFrame, actual: str, pred: str, lower: str, upper: str, by: list[str] | None = None) -> DataFrame:
    err = F.abs(F.col(pred) - F.col(actual))
    inside = (F.col(actual) >= F.col(lower)) & (F.col(actual) <= F.col(upper))
    return df.groupBy(*(by or [])).agg(
        F.avg(err).alias("mae"), (F.avg(err) / F.avg(actual) * 100).alias("mae_pct_of_mean"),
        (F.avg(err / F.abs(actual)) * 100).alias("mape_pct"), (F.max(err / F.abs(actual)) * 100).alias("max_ape_pct"),
        F.avg(inside.cast("double")).alias("interval_coverage"), F.count_if(F.col(pred) <= 0).alias("non_positive"),
        F.count("*").alias("n"))


def confusion_metrics(df: DataFrame, label: str, pred: str, by: list[str] | None = None) -> DataFrame:
    """Confusion counts and rates; a rate whose denominator is zero is NULL."""
    y, p = F.col(label).cast("boolean"), F.col(pred).cast("boolean")
    c = df.groupBy(*(by or [])).agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
                                    F.count_if(~y & ~p).alias("tn"), F.count_if(y & ~p).alias("fn"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return (c.withColumn("accuracy", F.try_divide(tp + tn, tp + fp + tn + fn))
            .withColumn("precision", F.try_divide(tp, tp + fp)).withColumn("recall", F.try_divide(tp, tp + fn))
            .withColumn("f1", F.try_divide(tp * 2, tp * 2 + fp + fn)))


def class_report(df: DataFrame, label: str, pred: str) -> DataFrame:
    """Precision, recall, F1 and support of both classes."""
    c = confusion_metrics(df, label, pred)
    def row(name, hit, wrong, lost):
        return F.struct(F.lit(name).alias("class"), F.try_divide(hit, hit + wrong).alias("precision"),
                        F.try_divide(hit, hit + lost).alias("recall"), F.try_divide(hit * 2, hit * 2 + wrong + lost).alias("f1"),
                        (hit + lost).alias("support"))
    tp, fp, tn, fn = (F.col(x) for x in ("tp", "fp", "tn", "fn"))
    return c.select(F.inline(F.array(row("flagged", tp, fp, fn), row("genuine", tn, fn, fp))))


def recall_by_anomaly(df: DataFrame, label: str, pred: str) -> DataFrame:
    hit = F.col(pred).cast("boolean")
    return (df.where(F.col(label).cast("boolean"))
            .groupBy(F.coalesce("anomaly_type", F.lit("unknown")).alias("anomaly_type"))
            .agg(F.count("*").alias("total"), F.count_if(hit).alias("caught"))
            .withColumn("recall", F.col("caught") / F.col("total")))


def pr_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Cumulative hits and calls at each distinct score, highest score first."""
    by_score = (df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score"))
                .agg(F.sum(F.col(label).cast("bigint")).alias("pos"), F.count("*").alias("n")))
    return running_total(by_score, "score", ["pos", "n"], by=by)


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Sum of precision times recall step over distinct thresholds."""
    curve = pr_curve(df, label, score, by)
    return curve.groupBy(*by).agg((F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")) / F.sum("pos")).alias("average_precision"),
                     F.count("*").alias("thresholds"))


def verdict_stability(df: DataFrame, label: str, before: str, after: str, by: Sequence[str] = ()) -> DataFrame:
    b, a = F.col(before).cast("boolean"), F.col(after).cast("boolean")
    genuine = ~F.col(label).cast("boolean")
    return df.groupBy(*by).agg((F.avg((b != a).cast("double")) * 100).alias("verdicts_changed_pct"),
                  F.avg(F.when(genuine, b.cast("double"))).alias("false_positive_rate_before"),
                  F.avg(F.when(genuine, a.cast("double"))).alias("false_positive_rate_after"))


def class_weight(df: DataFrame, label: str) -> DataFrame:
    y = F.col(label).cast("boolean")
    return df.agg((F.count_if(~y) / F.greatest(F.count_if(y), F.lit(1))).alias("positive_weight"))


# ---- extraction quality -----------------------------------------------------------

def _valued(fields: dict[str, str]) -> dict[str, Column]:
    """For each kind of field an array of its fields: name, both texts (gt, pred) and their normalised values (v_gt, v_pred).

    One array for each kind, not columns: its rule stands in the plan once, and each text is normalised once whatever asks for the value.
    """
    def of(kind):
        def valued(x):
            made = {side: text.VALUES[kind](x[side]) for side in ("gt", "pred")}
            if kind in ("id", "gstin"):       # the other kinds find no value in a blank text
                made = {side: F.when(~text.blank(x[side]), v) for side, v in made.items()}
            return F.struct(x["field"].alias("field"), *[x[side].alias(side) for side in made], *[v.alias(f"v_{side}") for side, v in made.items()])
        return F.transform(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"gt_{f}").alias("gt"), F.col(f"pred_{f}").alias("pred")) for f, k in fields.items() if k == kind]), valued)
    return {kind: of(kind) for kind in dict.fromkeys(fields.values())}


def _side(item: Column, value: Column, kind: str) -> dict[str, Column]:
    """Status and value of a text whose normalised value is known."""
    empty = value.isNull() if kind == "text" else value.isNull() & text.blank(item)       # only what has no value can be blank
    return {"status": F.when(empty, "null").when(value.isNull(), "bad").otherwise("ok"), "value": value}


def _statuses(valued: Column, kind: str) -> Column:
    """Array of struct(field, status) of what ``_valued`` made of one kind."""
    return F.transform(valued, lambda x: F.struct(x["field"].alias("field"), text.field_status(kind, *[_side(x[s], x[f"v_{s}"], kind) for s in ("gt", "pred")]).alias("status")))


def field_statuses(docs: DataFrame, fields: dict[str, str] = C.CORE_FIELDS) -> DataFrame:
    """(doc_id, layout, field, status) from wide documents with gt_* and pred_* text columns."""
    cells = F.concat(*[_statuses(v, k) for k, v in _valued(fields).items()])
    return docs.select("doc_id", "layout", F.inline(cells))


def field_accuracy(statuses: DataFrame) -> DataFrame:
    good = F.col("status").isin(*OK_STATUSES)
    counts = statuses.groupBy("field").agg(
        F.count("*").alias("n"), F.count_if(good).alias("k"),
        *[F.count_if(F.col("status") == s).alias(s) for s in ("wrong", "missing", "hallucinated", "correct_null")])
    low, high = wilson(F.col("k"), F.col("n"))
    return counts.select("field", "n", (F.col("k") / F.col("n")).alias("accuracy"), low.alias("ci_low"), high.alias("ci_high"),
                         "wrong", "missing", "hallucinated", "correct_null")


def document_accuracy(docs: DataFrame, fields: dict[str, str] = C.CORE_FIELDS) -> DataFrame:
    """Per document: share of correct fields, critical fields all correct, gate reasons and verdict.

    One row per document comes straight from the wide row; nothing is exploded or shuffled.
    """
    valued = docs.select("doc_id", "layout", *[v.alias(f"_{k}") for k, v in _valued(fields).items()])
    place = {f: [g for g, kind in fields.items() if kind == k].index(f) for f, k in fields.items()}
    right = {k: F.transform(_statuses(F.col(f"_{k}"), k), lambda x: x["status"].isin(*OK_STATUSES)) for k in dict.fromkeys(fields.values())}
    flags = valued.withColumns({f"ok_{k}": c for k, c in right.items()} | {f"v_pred_{f}": F.col(f"_{k}")[place[f]]["v_pred"] for f, k in fields.items()})
    hits = sum(F.size(F.filter(f"ok_{k}", lambda ok: ok)) for k in right)
    critical = F.lit(True)
    for f in C.CRITICAL_FIELDS:
        critical = critical & F.col(f"ok_{fields[f]}")[place[f]]
    return flags.select("doc_id", "layout", (hits / len(fields)).alias("accuracy"), critical.alias("critical_ok"),
                        reasons_of("v_pred_").alias("reasons")).withColumn("gate_passed", F.size("reasons") == 0)


def gate_cells(scored: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Gate verdict against correctness of the critical fields."""
    p, c = F.col("gate_passed"), F.col("critical_ok")
    out = scored.groupBy(*(by or [])).agg(
        F.count("*").alias("n"), F.count_if(p & c).alias("auto_correct"), F.count_if(p & ~c).alias("silent_error"),
        F.count_if(~p & ~c).alias("caught"), F.count_if(~p & c).alias("false_reject"))
    passed = F.col("auto_correct") + F.col("silent_error")
    return (out.withColumn("pass_rate", F.try_divide(passed, F.col("n")))
            .withColumn("silent_rate_of_passed", F.try_divide(F.col("silent_error"), passed))
            .withColumn("false_reject_rate", F.try_divide(F.col("false_reject"), F.col("n"))))


def gate_reason_counts(scored: DataFrame) -> DataFrame:
    # the outer kind: for the plain one Spark tests the size of the array where the table is read, and makes it there once for each use
    each = scored.select(F.posexplode_outer("reasons").alias("place", "reason")).where("place IS NOT NULL")
    return each.groupBy("reason").agg(F.count("*").alias("n"))


def layout_report(scored: DataFrame) -> DataFrame:
    silent = (F.col("gate_passed") & ~F.col("critical_ok")).cast("double")
    return scored.groupBy("layout").agg(
        F.count("*").alias("n"), F.avg("accuracy").alias("mean_field_acc"),
        F.avg(F.col("critical_ok").cast("double")).alias("critical_all_correct"), F.avg(silent).alias("silent_error_rate"))


BOOTSTRAP_BINS = 1024


def bootstrap_ci(df: DataFrame, value: str, replicas: int = 2000, seed: int = 0) -> DataFrame:
    """Mean with a 95 % percentile interval of the bootstrap.

    The column is summed up in BOOTSTRAP_BINS bins of equal width (rows, mean, spread), combined on the map side, so what is shuffled does
    not depend on the number of rows or of distinct values. How many of n draws fall into each bin is multinomial, drawn exactly for
    every replica from its own random stream; the mean of the draws inside a bin varies by its spread over their number. A bin that
    holds one value has no spread, so a column of few values is resampled exactly. Without values all three are null.
    """
    rows = cut_lineage(df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(F.col(value).cast("double").alias("v")))
    ends = rows.agg(F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    ddl = "mean double, ci_low double, ci_high double"
    if ends["lo"] is None:
        return df.sparkSession.createDataFrame([(None, None, None)], ddl)
    width = (ends["hi"] - ends["lo"]) / BOOTSTRAP_BINS or 1.0
    at = F.least(F.floor((F.col("v") - ends["lo"]) / width), F.lit(BOOTSTRAP_BINS - 1))
    bins = rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.when(F.min("v") != F.max("v"), F.stddev_pop("v")).otherwise(0.0).alias("s")).toPandas()
    n, m, s = (bins[c].to_numpy() for c in ("n", "m", "s"))          # BOOTSTRAP_BINS rows at most
    total = int(n.sum())

    def draw(frames):
        for f in frames:
            out = []
            for r in f["id"]:
                rng = np.random.default_rng([seed, int(r)])
                k = rng.multinomial(total, n / total)
                out.append(float((k @ m + (np.sqrt(k) * s) @ rng.standard_normal(len(k))) / total))
            yield pd.DataFrame({"m": out})

    means = df.sparkSession.range(replicas).mapInPandas(draw, "m double")
    # one row per replica: a fixed number, whatever the table
    limits = means.agg(F.percentile("m", 0.025).alias("ci_low"), F.percentile("m", 0.975).alias("ci_high"))
    return limits.select(F.lit(float(n @ m) / total).alias("mean"), "ci_low", "ci_high")


def line_item_status(truth: str, predicted: str) -> Column:
    """Positional comparison of two arrays of line items; keys NULL in the truth are not scored."""
    t, p = F.col(truth), F.col(predicted)

    def values(item):      # made once for each item: the comparison asks for value and status many times
        made = {f: text.NORMALISERS[kind](item[f])["value"] for f, kind in C.LINE_ITEM_FIELDS.items()}
        return F.struct(*[c.alias(f"v_{f}") for f, c in made.items()], *[item[f].alias(f) for f in made])

    def side(item, f, kind):
        return _side(item[f], item[f"v_{f}"], kind)

    def row_ok(a, b):
        ok = F.lit(True)
        for f, kind in C.LINE_ITEM_FIELDS.items():
            ok = ok & (a[f].isNull() | text.field_status(kind, side(a, f, kind), side(b, f, kind)).isin(*OK_STATUSES))
        return ok
    empty_t, empty_p = F.coalesce(F.size(t), F.lit(0)) <= 0, F.coalesce(F.size(p), F.lit(0)) <= 0
    all_ok = F.forall(F.zip_with(F.transform(t, values), F.transform(p, values), row_ok), lambda x: x)
    return (F.when(empty_t, F.when(empty_p, "correct_null").otherwise("hallucinated"))
            .when(empty_p, "missing").when(F.size(t) != F.size(p), "wrong")
            .when(all_ok, "correct").otherwise("wrong"))


def extraction_benchmark(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Per field hits under benchmark tolerance; a missing value that should be missing is right."""
    names = fields or list(C.CORE_FIELDS)
    def hits(numeric):
        texts = [F.struct(F.lit(f).alias("field"), F.col(f"gt_{f}").alias("t"), F.col(f"pred_{f}").alias("p")) for f in names if (f in C.NUMERIC_FIELDS) == numeric]
        return [F.transform(F.array(*texts), lambda x: F.struct(
            x["field"].alias("field"), F.when(x["t"].isNull(), x["p"].isNull()).otherwise(text.field_match(numeric, x["t"], x["p"])).alias("hit"),
            x["p"].isNull().alias("empty")))] if texts else []
    long = docs.select("doc_id", F.inline(F.concat(*hits(True), *hits(False))))
    return long.groupBy("field").agg(F.count("*").alias("n"), F.count_if("hit").alias("correct"),
                                     F.avg(F.col("hit").cast("double")).alias("accuracy"),
                                     F.count_if("empty").alias("empty"))


def two_number_report(results: DataFrame) -> DataFrame:
    """Auto-processed share and the risk verdict's quality on the invoices that passed."""
    share = results.agg(F.count("*").alias("total"), F.count_if("gate_passed").alias("passed"))
    c = confusion_metrics(results.where("gate_passed"), "requires_manual_review", "flagged")
    box = share.select(F.struct("total", "passed").alias("s")).scalar()
    return c.select(box["total"].alias("total"), box["passed"].alias("passed"),
                    F.try_divide(box["passed"], box["total"]).alias("auto_share"), *c.columns)

