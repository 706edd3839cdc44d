"""Aggregates, dashboards, model metrics, extraction quality, series, splits."""

from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import costing, enrich, explain, gate, metrics, models, series, splits
from lanewise.operators.scale import exact_percentiles
from lanewise.plans.queries_rows import risk_sql
from lanewise.plans.registry import op
from lanewise.session import cut_lineage, stored

# ---- carriers -------------------------------------------------------------------------------

_STATS = "SELECT vendor_id, count(*) AS total_invoices, sum(requires_manual_review)::BIGINT AS flagged_invoices FROM f_inv GROUP BY 1"
_BOARD = f"""SELECT v.vendor_id, vendor_name, home_state, coalesce(total_invoices, 0) AS total_invoices, coalesce(flagged_invoices, 0) AS flagged_invoices,
    (coalesce(flagged_invoices, 0) + 0.12::DOUBLE) / (coalesce(total_invoices, 0) + 2) AS risk_score FROM f_vendors v LEFT JOIN ({_STATS}) s ON v.vendor_id = s.vendor_id"""


@op("vendor_stats", _STATS)
def _(v):
    return v.vendor_stats


@op("vendor_scores_view", f"SELECT vendor_id, total_invoices, flagged_invoices, risk_score FROM ({_BOARD})", r="risk_score")
def _(v):
    return metrics.vendor_scores_view(v.vendors, v.vendor_stats).select("vendor_id", "total_invoices", "flagged_invoices", "risk_score")


@op("vendor_leaderboard", _BOARD, r="risk_score")
def _(v):
    return metrics.vendor_leaderboard(v.vendors, v.vendor_stats)


@op("leaderboard_sorted", f"SELECT vendor_id, lower(vendor_name) AS name_key FROM ({_BOARD})")
def _(v):
    board = metrics.vendor_leaderboard(v.vendors, v.vendor_stats)
    return explain.leaderboard_sorted(board, "vendor_name").select("vendor_id", F.lower("vendor_name").alias("name_key"))


@op("vendor_padding_median", """SELECT v.vendor_id, coalesce(m, (SELECT median(vendor_padding_ratio) FROM f_fair WHERE vendor_padding_ratio > 0), 1.164) AS padding_median FROM f_vendors v
    LEFT JOIN (SELECT vendor_id, median(vendor_padding_ratio) AS m FROM f_fair WHERE vendor_padding_ratio > 0 GROUP BY 1) p ON v.vendor_id = p.vendor_id""", r="padding_median")
def _(v):
    return metrics.vendor_padding_median(v.priced, v.vendors)


@op("causal_vendor_risk", "SELECT invoice_id, prior_total, prior_flagged, (prior_flagged + 0.12::DOUBLE) / (prior_total + 2) AS vendor_historical_risk_score FROM f_hist", r="vendor_historical_risk_score")
def _(v):
    return v.history.select("invoice_id", "prior_total", "prior_flagged", "vendor_historical_risk_score")


# ---- dashboards -------------------------------------------------------------------------------

@op("dashboard_kpis", """SELECT count(*) AS total, count(*) FILTER (gate_passed) AS passed, count(*) FILTER (NOT gate_passed) AS rejected, count(*) FILTER (gate_passed) / count(*)::DOUBLE AS auto_rate,
    count(*) FILTER (gate_passed AND flagged) AS flagged, count(*) FILTER (manual) AS with_manual_entry FROM (SELECT * FROM f_log ORDER BY created_at DESC, id DESC LIMIT 500)""", r="auto_rate")
def _(v):
    return metrics.dashboard_kpis(v.audit_log, 500)


@op("rejection_breakdown", """SELECT split_part(gate_reason, ':', 1) AS reason, count(*) AS n, count(*) / sum(count(*)) OVER ()::DOUBLE AS share FROM f_log WHERE gate_reason IS NOT NULL GROUP BY 1""", r="share")
def _(v):
    return metrics.rejection_breakdown(v.audit_log)


_AUDIT = "id, extractor_used, gate_passed, gate_reason, order_id, vendor_id, billed_amount, model2_proba, flagged"


@op("recent_audits", f"SELECT {_AUDIT} FROM f_log ORDER BY created_at DESC, id DESC LIMIT 200")
def _(v):
    return explain.recent_audits(v.audit_log, 1000).drop("created_at")


# ---- learned ranges and metrics ------------------------------------------------------------------

@op("training_ranges", "SELECT " + ", ".join(
    f"round(min({n}), 2) AS {n}_min, round(max({n}), 2) AS {n}_max, round(quantile_cont({n}, 0.01), 2) AS {n}_p01, round(quantile_cont({n}, 0.99), 2) AS {n}_p99" for n in C.DRIFT_LABELS) + " FROM f_ord",
    r=" ".join(f"{n}_{s}:1" for n in C.DRIFT_LABELS for s in ("min", "max", "p01", "p99")))
def _(v):
    return metrics.training_ranges(v.orders)


@op("price_bounds", """SELECT round(a * 0.5, 2) AS cost_per_km_min, round(b * 3, 2) AS cost_per_km_max, round(lo * 0.8::DOUBLE, 3) AS billed_low_ratio, round(hi * 1.5::DOUBLE, 3) AS billed_high_ratio,
    round(ex * 1.5::DOUBLE, 0) AS billed_high_abs, n AS genuine_invoices FROM (SELECT quantile_cont(base_freight_cost / distance_km, 0.001) AS a, quantile_cont(base_freight_cost / distance_km, 0.999) AS b FROM f_ord),
    (SELECT min(actual_billed_amount / greatest(fair_lower, 1)) AS lo, max(actual_billed_amount / greatest(fair_upper, 1)) AS hi, max(actual_billed_amount - fair_upper) AS ex, count(*) AS n FROM f_fair WHERE requires_manual_review = 0)""",
    r="cost_per_km_min:2 cost_per_km_max:2 billed_low_ratio:3 billed_high_ratio:3")
def _(v):
    return metrics.price_bounds(v.orders, v.priced.where("requires_manual_review = 0"))


@op("regression_metrics", """SELECT truck_type, avg(abs(fair_cost - base_freight_cost)) AS mae, avg(abs(fair_cost - base_freight_cost)) / avg(base_freight_cost) * 100 AS mae_pct_of_mean,
    avg(abs(fair_cost - base_freight_cost) / base_freight_cost) * 100 AS mape_pct, max(abs(fair_cost - base_freight_cost) / base_freight_cost) * 100 AS max_ape_pct,
    avg((base_freight_cost >= fair_lower AND base_freight_cost <= fair_upper)::INTEGER) AS interval_coverage, count(*) FILTER (fair_cost <= 0) AS non_positive, count(*) AS n FROM f_fair GROUP BY 1""",
    r="mae:3 mae_pct_of_mean:5 mape_pct:5 max_ape_pct:5 interval_coverage:5")
def _(v):
    return metrics.regression_metrics(v.priced, "base_freight_cost", "fair_cost", "fair_lower", "fair_upper", ["truck_type"])


_CONF = """SELECT {by}count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp, count(*) FILTER (NOT y AND NOT p) AS tn, count(*) FILTER (y AND NOT p) AS fn FROM ({src}){g}"""
_RATES = """tp, fp, tn, fn, (tp + tn) / (tp + fp + tn + fn)::DOUBLE AS accuracy, tp / nullif(tp + fp, 0)::DOUBLE AS precision, tp / nullif(tp + fn, 0)::DOUBLE AS recall, 2 * tp / nullif(2 * tp + fp + fn, 0)::DOUBLE AS f1"""
_YP = "SELECT *, requires_manual_review = 1 AS y, flagged AS p FROM f_priced"


@op("confusion_metrics", f"SELECT product_category, {_RATES} FROM ({_CONF.format(by='product_category, ', src=_YP, g=' GROUP BY 1')})", r="accuracy precision recall f1")
def _(v):
    return metrics.confusion_metrics(v.priced, "requires_manual_review", "flagged", ["product_category"])


@op("class_report", f"""WITH c AS ({_CONF.format(by='', src=_YP, g='')}) SELECT 'flagged' AS class, tp / (tp + fp)::DOUBLE AS precision, tp / (tp + fn)::DOUBLE AS recall, 2 * tp / (2 * tp + fp + fn)::DOUBLE AS f1, tp + fn AS support FROM c
    UNION ALL SELECT 'genuine', tn / (tn + fn)::DOUBLE, tn / (tn + fp)::DOUBLE, 2 * tn / (2 * tn + fp + fn)::DOUBLE, tn + fp FROM c""", r="precision recall f1")
def _(v):
    return metrics.class_report(v.priced, "requires_manual_review", "flagged")


@op("recall_by_anomaly", f"SELECT anomaly_type, count(*) AS total, count(*) FILTER (p) AS caught, count(*) FILTER (p) / count(*)::DOUBLE AS recall FROM ({_YP}) WHERE y GROUP BY 1", r="recall")
def _(v):
    return metrics.recall_by_anomaly(v.priced, "requires_manual_review", "flagged")


_CURVE = """SELECT score, pos, n, sum(pos) OVER (ORDER BY score DESC)::BIGINT AS cum_pos, sum(n) OVER (ORDER BY score DESC)::BIGINT AS cum_n FROM (
    SELECT billed_ratio AS score, sum(requires_manual_review)::BIGINT AS pos, count(*) AS n FROM f_checked GROUP BY 1)"""


@op("pr_curve", _CURVE, r="score:3")
def _(v):
    return metrics.pr_curve(v.priced, "requires_manual_review", "billed_ratio")


@op("average_precision", f"SELECT sum(pos * cum_pos / cum_n::DOUBLE) / sum(pos) AS average_precision, count(*) AS thresholds FROM ({_CURVE})", r="average_precision")
def _(v):
    return metrics.average_precision(v.priced, "requires_manual_review", "billed_ratio")


@op("verdict_stability", """SELECT avg((b <> a)::INTEGER) * 100 AS verdicts_changed_pct, avg(b::INTEGER) FILTER (NOT y) AS false_positive_rate_before, avg(a::INTEGER) FILTER (NOT y) AS false_positive_rate_after FROM (
    SELECT requires_manual_review = 1 AS y, cost_mismatch > 5000 AS b, cost_mismatch * 1.25::DOUBLE > 5000 AS a FROM f_fair)""", r="verdicts_changed_pct:5 false_positive_rate_before false_positive_rate_after")
def _(v):
    d = v.priced.select("requires_manual_review", (F.col("cost_mismatch") > 5000).alias("b"), (F.col("cost_mismatch") * C.PRICE_RISE > 5000).alias("a"))
    return metrics.verdict_stability(d, "requires_manual_review", "b", "a")


@op("class_weight", "SELECT count(*) FILTER (requires_manual_review = 0) / greatest(sum(requires_manual_review), 1)::DOUBLE AS positive_weight FROM f_inv", r="positive_weight")
def _(v):
    return metrics.class_weight(v.invoices, "requires_manual_review")


@op("exact_percentiles", """SELECT vendor_id, quantile_cont(actual_billed_amount, 0.05) AS p05, median(actual_billed_amount) AS p50, quantile_cont(actual_billed_amount, 0.95) AS p95 FROM f_inv GROUP BY 1""", r="p05:5 p50:5 p95:5")
def _(v):
    return exact_percentiles(v.invoices, "actual_billed_amount", {"p05": 0.05, "p50": 0.5, "p95": 0.95}, ["vendor_id"])


# ---- extraction quality -------------------------------------------------------------------------

@op("truth_vs_prediction", "SELECT doc_id, layout, field, status FROM f_cells")
def _(v):
    return metrics.field_statuses(v.documents)


_OK = "status IN ('correct', 'correct_null')"


@op("field_accuracy", f"""SELECT field, n, k / n::DOUBLE AS accuracy, (c - h) / d AS ci_low, (c + h) / d AS ci_high, wrong, missing, hallucinated, correct_null FROM (
    SELECT *, 1 + 3.8416 / n::DOUBLE AS d, k / n::DOUBLE + 3.8416 / (2 * n)::DOUBLE AS c, 1.96 * sqrt(k / n::DOUBLE * (1 - k / n::DOUBLE) / n + 3.8416 / (4.0 * n * n)) AS h FROM (
    SELECT field, count(*) AS n, count(*) FILTER ({_OK}) AS k, count(*) FILTER (status = 'wrong') AS wrong, count(*) FILTER (status = 'missing') AS missing,
    count(*) FILTER (status = 'hallucinated') AS hallucinated, count(*) FILTER (status = 'correct_null') AS correct_null FROM f_cells GROUP BY 1))""", r="accuracy ci_low ci_high")
def _(v):
    return metrics.field_accuracy(metrics.field_statuses(v.documents))


def _doc_scores(v):
    return metrics.document_accuracy(v.documents)


@op("document_accuracy", "SELECT doc_id, layout, accuracy, critical_ok, gate_passed FROM f_docacc", r="accuracy")
def _(v):
    return _doc_scores(v).drop("reasons")


_CELLS = """SELECT count(*) AS n, count(*) FILTER (gate_passed AND critical_ok) AS auto_correct, count(*) FILTER (gate_passed AND NOT critical_ok) AS silent_error,
    count(*) FILTER (NOT gate_passed AND NOT critical_ok) AS caught, count(*) FILTER (NOT gate_passed AND critical_ok) AS false_reject FROM f_docacc"""


@op("gate_cells", f"""SELECT *, (auto_correct + silent_error) / n::DOUBLE AS pass_rate, silent_error / nullif(auto_correct + silent_error, 0)::DOUBLE AS silent_rate_of_passed,
    false_reject / n::DOUBLE AS false_reject_rate FROM ({_CELLS})""", r="pass_rate silent_rate_of_passed false_reject_rate")
def _(v):
    return metrics.gate_cells(_doc_scores(v))


@op("gate_reason_counts", "SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM f_reasons) GROUP BY 1")
def _(v):
    return metrics.gate_reason_counts(_doc_scores(v))


@op("layout_report", """SELECT layout, count(*) AS n, avg(accuracy) AS mean_field_acc, avg(critical_ok::INTEGER) AS critical_all_correct, avg((gate_passed AND NOT critical_ok)::INTEGER) AS silent_error_rate
    FROM f_docacc GROUP BY 1""", r="mean_field_acc critical_all_correct silent_error_rate")
def _(v):
    return metrics.layout_report(_doc_scores(v))


@op("bootstrap_ci")
def _(v):
    """Random by nature, so without a SQL twin."""
    # the replicas reuse the document scores, which therefore run once
    return metrics.bootstrap_ci(cut_lineage(_doc_scores(v).select("accuracy")), "accuracy")


@op("line_item_score", f"""SELECT status, count(*) AS n FROM (SELECT CASE WHEN invoice_seq % 10 = 0 THEN CASE WHEN invoice_seq % 20 = 0 THEN 'correct_null' ELSE 'hallucinated' END WHEN invoice_seq % 7 = 0 THEN 'missing'
    WHEN invoice_seq % 11 = 0 THEN 'wrong' WHEN invoice_seq % 13 = 0 THEN 'wrong' ELSE 'correct' END AS status FROM f_inv) GROUP BY 1""")
def _(v):
    q, amount = F.col("invoice_seq"), F.col("actual_billed_amount")

    def item(desc, value, unit=F.lit(None).cast("string")):
        return F.struct(desc.alias("description"), F.lit("1").alias("quantity"), unit.alias("unit"), value.alias("rate"), value.alias("amount"))
    money = F.regexp_replace(F.format_number(amount, 2), ",", "")
    none = F.array().cast("array<struct<description:string,quantity:string,unit:string,rate:string,amount:string>>")
    full = F.array(item(F.lit("Freight"), money), item(F.lit("Toll-charge"), F.lit("100.00")))
    read = F.array(item(F.lit("FREIGHT "), F.concat(F.lit("Rs. "), money), F.lit("trip")),
                   item(F.lit("toll charge"), F.when(q % 11 == 0, "100.02").otherwise("₹100")))
    docs = v.invoices.select(
        F.when(q % 10 == 0, none).otherwise(full).alias("truth"),
        F.when(q % 20 == 0, none).when(q % 10 == 0, read).when(q % 7 == 0, none).when((q % 13 == 0) & (q % 11 != 0), F.slice(read, 1, 1)).otherwise(read).alias("seen"))
    return docs.select(metrics.line_item_status("truth", "seen").alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def _hit(f):
    t, p = f"gt_{f}", f"pred_{f}"
    if f in C.NUMERIC_FIELDS:
        num = "try_cast(regexp_replace({}, '[^0-9.\\-]', '', 'g') AS DOUBLE)".format
        same = f"abs({num(t)} - {num(p)}) <= greatest(0.02, abs({num(t)}) * 0.001)"
    else:
        same = f"lower(regexp_replace({t}, '\\s+', '', 'g')) = lower(regexp_replace({p}, '\\s+', '', 'g'))"
    return f"CASE WHEN {t} IS NULL THEN {p} IS NULL ELSE coalesce({same}, FALSE) END"


@op("extraction_benchmark", "SELECT field, count(*) AS n, count(*) FILTER (hit) AS correct, avg(hit::INTEGER) AS accuracy, count(*) FILTER (empty) AS empty FROM ("
    + " UNION ALL ".join(f"SELECT '{f}' AS field, {_hit(f)} AS hit, pred_{f} IS NULL AS empty FROM f_docs" for f in C.CORE_FIELDS) + ") GROUP BY 1", r="accuracy")
def _(v):
    return metrics.extraction_benchmark(v.documents)


_GATED_FLAG = "SELECT g.gate_passed, requires_manual_review = 1 AS y, coalesce(p.flagged, FALSE) AS p FROM f_gated g LEFT JOIN (SELECT invoice_id, flagged FROM f_priced) p USING (invoice_id)"


@op("two_number_report", f"""SELECT total, passed, passed / total::DOUBLE AS auto_share, {_RATES} FROM (SELECT count(*) AS total, count(*) FILTER (gate_passed) AS passed FROM f_gated),
    ({_CONF.format(by='', src='SELECT * FROM (' + _GATED_FLAG + ') WHERE gate_passed', g='')})""", r="auto_share accuracy precision recall f1")
def _(v):
    gated = gate.confidence_gate(v.extracted).select("invoice_id", "gate_passed", "requires_manual_review")
    flags = v.priced.select("invoice_id", "flagged")
    return metrics.two_number_report(gated.join(flags, "invoice_id", "left").fillna(False, ["flagged"]))


# ---- series --------------------------------------------------------------------------------------

@op("weekly_resample", "SELECT hub_id, week, precip, temp FROM f_weekly", r="precip:3 temp:4")
def _(v):
    return series.weekly_resample(v.weather)


def _temp_series(v):
    return series.weekly_resample(v.weather).select(F.lit("weather_temp").alias("series"), F.col("hub_id").alias("key"), F.col("week").alias("date"), F.col("temp").alias("value"))


def _daily_rain(v):
    """Daily rain with its missing days and missing readings."""
    span = v.weather.groupBy("hub_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = span.select("hub_id", F.explode(F.sequence("lo", "hi")).alias("day"))
    d = grid.join(v.weather.select("hub_id", "day", "precip"), ["hub_id", "day"], "left")
    return d.select(F.lit("rain").alias("series"), F.col("hub_id").alias("key"), F.col("day").alias("date"), F.col("precip").alias("value"))


@op("interpolate", """WITH g AS (SELECT hub_id, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT hub_id, min(day) AS lo, max(day) AS hi FROM f_weather GROUP BY 1)),
    s AS (SELECT g.hub_id, g.day, precip, row_number() OVER (PARTITION BY g.hub_id ORDER BY g.day) AS pos FROM g LEFT JOIN f_weather w ON w.hub_id = g.hub_id AND w.day = g.day),
    t AS (SELECT *, last_value(precip IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN precip IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, first_value(precip IGNORE NULLS) OVER b AS nv,
    first_value(CASE WHEN precip IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np FROM s WINDOW a AS (PARTITION BY hub_id ORDER BY day), b AS (PARTITION BY hub_id ORDER BY day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
    SELECT hub_id AS key, day AS date, coalesce(precip, pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0)::DOUBLE, pv) AS value FROM t WHERE pv IS NOT NULL""", r="value:5")
def _(v):
    return series.interpolate(_daily_rain(v)).select("key", "date", "value")


_SPLIT = """SELECT *, count(*) OVER (PARTITION BY key) AS length, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS from_end FROM f_series"""


@op("tail_split", f"SELECT key, date, value, from_end <= 60 AS is_test FROM ({_SPLIT}) WHERE length >= 90")
def _(v):
    return series.tail_split(_fuel_series(v), 60, 90).select("key", "date", "value", "is_test")


def _fuel_series(v):
    cal = enrich.price_calendar(v.fuel_prices, None)
    return cal.select(F.lit("fuel_diesel").alias("series"), F.col("state").alias("key"), F.col("day").alias("date"), F.col("price").alias("value"))


@op("persistence_baseline", f"""SELECT key, date, value, b AS baseline FROM (SELECT *, max_by(value, date) FILTER (from_end > 60) OVER (PARTITION BY key) AS b FROM ({_SPLIT}) WHERE length >= 90) WHERE from_end <= 60""")
def _(v):
    return series.persistence_baseline(series.tail_split(_fuel_series(v), 60, 90)).select("key", "date", "value", "baseline")


_TSPLIT = """SELECT *, count(*) OVER (PARTITION BY key) AS length, row_number() OVER (PARTITION BY key ORDER BY date DESC) AS from_end, lag(value, 52) OVER (PARTITION BY key ORDER BY date) AS s52 FROM f_temp_clean"""
_TCLEAN = """f_temp_clean AS (SELECT key, date, coalesce(value, pv + (nv - pv) * (pos - pp) / nullif(np - pp, 0)::DOUBLE, pv) AS value FROM (
    SELECT *, last_value(value IGNORE NULLS) OVER a AS pv, last_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER a AS pp, first_value(value IGNORE NULLS) OVER b AS nv,
    first_value(CASE WHEN value IS NOT NULL THEN pos END IGNORE NULLS) OVER b AS np FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY date) AS pos FROM f_temp_series)
    WINDOW a AS (PARTITION BY key ORDER BY date), b AS (PARTITION BY key ORDER BY date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) WHERE pv IS NOT NULL)"""


@op("seasonal_naive", f"WITH {_TCLEAN} SELECT key, date, value, CASE WHEN length > 78 THEN s52 END AS baseline FROM ({_TSPLIT}) WHERE length >= 86 AND from_end <= 26", r="value:5 baseline:5")
def _(v):
    split = series.tail_split(series.interpolate(_temp_series(v)), 26, 86)
    return series.seasonal_naive(split, 26).select("key", "date", "value", "baseline")


_DRIFT_BT = f"""SELECT 'fuel_diesel' AS series, key, date, value, lv AS baseline, lv + coalesce((lv - fv) / nullif(nt - 1, 0), 0) * (61 - from_end) AS predicted FROM (
    SELECT *, max_by(value, date) FILTER (from_end > 60) OVER w AS lv, min_by(value, date) FILTER (from_end > 60) OVER w AS fv, count(*) FILTER (from_end > 60) OVER w AS nt FROM ({_SPLIT}) WHERE length >= 90 WINDOW w AS (PARTITION BY key)) WHERE from_end <= 60"""
_SEAS_BT = f"""SELECT 'weather_temp' AS series, key, date, value, CASE WHEN length > 78 THEN s52 END AS baseline,
    CASE WHEN length > 78 THEN s52 + coalesce(pow(greatest(-1, least(1, coalesce(phi, 0))), 27 - from_end) * dl, 0) END AS predicted FROM (
    SELECT *, sum(d * d1) OVER w / nullif(sum(CASE WHEN d IS NOT NULL THEN d1 * d1 END) OVER w, 0) AS phi, max_by(d, CASE WHEN d IS NOT NULL THEN date END) OVER w AS dl FROM (
    SELECT *, lag(d) OVER (PARTITION BY key ORDER BY date) AS d1 FROM (SELECT *, CASE WHEN from_end > 26 THEN value - s52 END AS d FROM ({_TSPLIT}) WHERE length >= 86)) WINDOW w AS (PARTITION BY key)) WHERE from_end <= 26"""
_BT = f"{_DRIFT_BT} UNION ALL {_SEAS_BT}"
_SCORES = f"""SELECT series, key, mae, rmse, smape, n, CASE WHEN bm > 1e-9 THEN 1 - mae / bm END AS skill FROM (SELECT series, key, avg(e) AS mae, sqrt(avg(e * e)) AS rmse,
    avg(2 * e / greatest(abs(value) + abs(predicted), 1e-6)) * 100 AS smape, count(*) AS n, avg(abs(baseline - value)) AS bm FROM (SELECT *, abs(predicted - value) AS e FROM ({_BT}) WHERE value IS NOT NULL AND predicted IS NOT NULL) GROUP BY 1, 2)"""


def _backtests(v):
    fuel = series.drift_backtest(series.tail_split(_fuel_series(v), 60, 90))
    temp = series.seasonal_backtest(series.tail_split(series.interpolate(_temp_series(v)), 26, 86), 26)
    return fuel.unionByName(temp)


@op("series_backtest", f"WITH {_TCLEAN} SELECT series, key, date, value, baseline, predicted FROM ({_BT})", r="value:4 baseline:4 predicted:4")
def _(v):
    return _backtests(v).drop("step")


@op("forecast_scores", f"WITH {_TCLEAN} {_SCORES}", r="mae:4 rmse:4 smape:4 skill:4")
def _(v):
    return series.forecast_scores(_backtests(v))


@op("backtest_summary", f"""WITH {_TCLEAN} SELECT series, median(mae) AS median_mae, median(smape) AS median_smape, median(rmse) AS median_rmse, median(skill) AS median_skill, count(*) AS keys FROM ({_SCORES}) GROUP BY 1""",
    r="median_mae:4 median_smape:4 median_rmse:4 median_skill:4")
def _(v):
    return series.backtest_summary(series.forecast_scores(_backtests(v)))


@op("series_forecast", f"""WITH {_TCLEAN} SELECT 'fuel_diesel' AS series, key, ld + step::INTEGER AS date, round(lv + coalesce((lv - fv) / nullif(n - 1, 0), 0) * step, 3) AS forecast FROM (
    SELECT key, max(date) AS ld, max_by(value, date) AS lv, min_by(value, date) AS fv, count(*) AS n FROM f_series GROUP BY 1), (SELECT unnest(range(1, 31)) AS step)
    UNION ALL SELECT 'weather_temp', key, date + 364, round(value, 3) FROM ({_TSPLIT}) WHERE from_end <= 52 AND from_end > 26""", r="forecast:3")
def _(v):
    fuel = series.drift_forecast(_fuel_series(v), 30)
    return fuel.unionByName(series.seasonal_forecast(series.interpolate(_temp_series(v)), 26))


def _rain_series(v):
    return series.weekly_resample(v.weather).select(F.lit("weather_precip").alias("series"), F.col("hub_id").alias("key"), F.col("week").alias("date"), F.col("precip").alias("value"))


_WX = f"""WITH {_TCLEAN}, wx AS (SELECT 'weather_temp' AS series, key, date, value FROM f_temp_clean UNION ALL SELECT 'weather_precip', hub_id, week, precip FROM f_weekly),
    l AS (SELECT *, count(*) OVER k AS length, row_number() OVER (PARTITION BY series, key ORDER BY date DESC) AS from_end, lag(value, 52) OVER (PARTITION BY series, key ORDER BY date) AS s52 FROM wx WINDOW k AS (PARTITION BY series, key))"""


@op("rain_backtest", _WX + """, d AS (SELECT *, CASE WHEN from_end > 26 THEN value - s52 END AS d FROM l WHERE series = 'weather_precip' AND length >= 86),
    e AS (SELECT *, lag(d) OVER (PARTITION BY key ORDER BY date) AS d1 FROM d), f AS (SELECT *, sum(d * d1) OVER w / nullif(sum(CASE WHEN d IS NOT NULL THEN d1 * d1 END) OVER w, 0) AS phi,
    max_by(d, CASE WHEN d IS NOT NULL THEN date END) OVER w AS dl FROM e WINDOW w AS (PARTITION BY key))
    SELECT key, date, value, CASE WHEN length > 78 THEN s52 END AS baseline, CASE WHEN length > 78 THEN s52 + coalesce(pow(greatest(-1, least(1, coalesce(phi, 0))), 27 - from_end) * dl, 0) END AS predicted
    FROM f WHERE from_end <= 26""", r="value:3 baseline:3 predicted:3")
def _(v):
    return series.seasonal_backtest(series.tail_split(series.interpolate(_rain_series(v)), 26, 86), 26).drop("series", "step")


@op("weather_forecast", _WX + """, d AS (SELECT *, value - s52 AS d FROM l), e AS (SELECT *, lag(d) OVER (PARTITION BY series, key ORDER BY date) AS d1 FROM d),
    f AS (SELECT *, sum(d * d1) OVER w / nullif(sum(CASE WHEN d IS NOT NULL THEN d1 * d1 END) OVER w, 0) AS phi, max_by(d, CASE WHEN d IS NOT NULL THEN date END) OVER w AS dl FROM e WINDOW w AS (PARTITION BY series, key))
    SELECT series, key, date + 364 AS date, value + coalesce(pow(greatest(-1, least(1, coalesce(phi, 0))), 53 - from_end) * dl, 0) AS forecast FROM f WHERE from_end <= 52 AND from_end > 26 AND length > 52""", r="forecast:3")
def _(v):
    """Temperature and rain of the next 26 weeks by the model that the backtests score."""
    both = series.interpolate(_temp_series(v)).unionByName(series.interpolate(_rain_series(v)))
    return series.seasonal_ar_forecast(both, 26)


# ---- splits ----------------------------------------------------------------------------------------

def _h(seq, seed=42):
    return f"(({seq}) % 1000003 * 7919 + {seed * 104729 % 1000003}) % 1000003"


@op("random_split", f"SELECT order_id, {_h('order_seq')} < 200000 AS is_test FROM f_ord_raw")
def _(v):
    return splits.random_split(v.orders_raw, "order_seq").select("order_id", "is_test")


def _cut(share, src, by=""):
    part = f"PARTITION BY {by} " if by else ""
    key = f"{by}, " if by else ""
    grp = f" GROUP BY {by}" if by else ""
    return f"""SELECT {key}coalesce(max(h) FILTER (cum <= round(tot * {share}::DOUBLE)), -1) AS cutoff FROM (SELECT *, sum(n) OVER ({part}ORDER BY h) AS cum, sum(n) OVER ({part}) AS tot FROM (
        SELECT {key}h, count(*) AS n FROM ({src}) GROUP BY {key}h)){grp}"""


@op("stratified_split", f"""WITH s AS (SELECT invoice_id, requires_manual_review, {_h('invoice_seq')} AS h FROM f_inv), c AS ({_cut(0.25, 'SELECT * FROM s', 'requires_manual_review')})
    SELECT invoice_id, s.requires_manual_review, h <= cutoff AS is_test FROM s JOIN c ON s.requires_manual_review = c.requires_manual_review""")
def _(v):
    return splits.stratified_split(v.invoices, "requires_manual_review", "invoice_seq").select("invoice_id", "requires_manual_review", "is_test")


_LAYOUTS = f"""d AS (SELECT doc_id, layout, {_h('doc_seq')} AS h FROM f_docs), lay AS (SELECT layout, row_number() OVER (ORDER BY md5('42:' || layout)) AS rk, count(*) OVER () AS tot FROM (
    SELECT DISTINCT layout FROM d WHERE layout <> 'layout_3')), held AS (SELECT layout FROM lay WHERE rk <= least(greatest(1, ceil(tot * 0.25)), tot - 1)),
    pool AS (SELECT * FROM d WHERE layout <> 'layout_3' AND layout NOT IN (SELECT layout FROM held))"""
_SPLIT_CASE = f"""CASE WHEN layout = 'layout_3' THEN 'test_real' WHEN layout IN (SELECT layout FROM held) THEN 'test_unseen_layouts' WHEN h <= ({_cut(0.1, 'SELECT * FROM pool')}) THEN 'test_seen_layouts'
    WHEN h <= ({_cut(0.2, 'SELECT * FROM pool')}) THEN 'val' ELSE 'train' END"""


def _layout_split(v):
    return splits.layout_holdout_split(v.documents.select("doc_id", "layout", "doc_seq"), "doc_seq", ["layout_3"])


@op("layout_holdout_split", f"WITH {_LAYOUTS} SELECT doc_id, layout, {_SPLIT_CASE} AS split FROM d")
def _(v):
    return _layout_split(v).select("doc_id", "layout", "split")


@op("split_disjointness", "SELECT 'none' AS problem, '' AS item FROM f_docs WHERE FALSE")
def _(v):
    return splits.split_violations(_layout_split(v))


@op("planted_violations", f"""WITH {_LAYOUTS}, s AS (SELECT doc_id, layout, {_SPLIT_CASE} AS split FROM d), p AS (SELECT * FROM s UNION ALL
    SELECT s.doc_id, s.layout, 'train' FROM s JOIN f_docs f ON s.doc_id = f.doc_id WHERE f.doc_seq % 97 = 0)
    SELECT 'document_in_two_splits' AS problem, doc_id AS item FROM p GROUP BY doc_id HAVING count(DISTINCT split) > 1
    UNION ALL SELECT 'layout_leak', layout FROM (SELECT layout FROM p WHERE split IN ('test_unseen_layouts', 'test_real') INTERSECT SELECT layout FROM p WHERE split IN ('train', 'val', 'test_seen_layouts'))""")
def _(v):
    """The split with some documents put into training once more: what the check finds."""
    s = _layout_split(v)
    return splits.split_violations(s.unionByName(s.where("doc_seq % 97 = 0").withColumn("split", F.lit("train"))))


@op("sample_invoices", f"SELECT invoice_id, actual_billed_amount FROM f_inv ORDER BY {_h('invoice_seq', 7)}, invoice_seq LIMIT 300")
def _(v):
    return splits.sample_rows(v.invoices, "invoice_seq", 300, 7).select("invoice_id", "actual_billed_amount")


# ---- training frame and variant selection --------------------------------------------------------------

@op("training_frame", "SELECT invoice_id, anomaly_type, fair_cost, billable_weight_kg, quoted_days FROM f_fair WHERE order_date IS NOT NULL", r="fair_cost:3 billable_weight_kg:3")
def _(v):
    labels = v.invoices.select("order_id", "anomaly_type")
    orders = v.orders.withColumnRenamed("baseline_cost", "fair_cost")
    frame = models.training_frame(v.invoices.drop("anomaly_type"), labels, orders, ["fair_cost", "billable_weight_kg", "quoted_days", "order_date"], ["fair_cost", "order_date"])
    return frame.select("invoice_id", "anomaly_type", "fair_cost", "billable_weight_kg", "quoted_days")


# score of each variant, its threshold, whether it can only rise with the bill
VARIANTS = [("mismatch", "cost_mismatch", 20000.0, False, False), ("mismatch_deflated", "cost_mismatch", 20000.0, True, False), ("ratio", "cost_mismatch_ratio", 0.5, False, True),
            ("skew", "cost_mismatch_delay_skew", 2.0, False, True), ("per_kg", "excess_rate_per_kg", 4.0, True, False)]


def _variant_sql(name, feature, limit, deflate, monotone):
    d = "91.4753::DOUBLE" if deflate else None
    keep = "invoice_id, requires_manual_review AS y"
    before, after = risk_sql(1.0, d, keep=keep), risk_sql(1.25, d, keep=keep)
    return f"""SELECT '{name}' AS variant, {str(monotone).upper()} AS monotone, ap AS pr_auc, changed AS verdicts_changed_pct FROM (SELECT sum(pos * cp / cn::DOUBLE) / sum(pos) AS ap FROM (
        SELECT pos, sum(pos) OVER (ORDER BY s DESC) AS cp, sum(n) OVER (ORDER BY s DESC) AS cn FROM (SELECT {feature} AS s, sum(y) AS pos, count(*) AS n FROM ({before}) GROUP BY 1))),
        (SELECT avg(((b.{feature} > {limit}) <> (a.{feature} > {limit}))::INTEGER) * 100 AS changed FROM ({before}) b JOIN ({after}) a ON a.invoice_id = b.invoice_id)"""


_VARIANTS_SQL = " UNION ALL ".join(_variant_sql(*x) for x in VARIANTS)


def _variant_results(v):
    """PR-AUC and stability of five single-feature scores. Both price levels of every variant come
    from one row, and the rows are stored narrow: ranking and stability both read them, what prices the invoices runs once."""
    cells = []
    for name, feature, limit, deflate, monotone in VARIANTS:
        ref = F.lit(C.REFERENCE_DIESEL) if deflate else None
        now, later = (costing.risk_feature_columns(scale, ref)[feature] for scale in (1.0, C.PRICE_RISE))
        cells.append(F.struct(F.lit(name).alias("variant"), F.lit(monotone).alias("monotone"), now.alias("s"),
                              (now > limit).alias("b"), (later > limit).alias("a")))
    cases = stored(v.priced.select("requires_manual_review", F.array(*cells).alias("cells")), "variant-cells")
    long = cases.select("requires_manual_review", F.inline("cells"))
    ap = metrics.average_precision(long, "requires_manual_review", "s", ["variant"])
    st = metrics.verdict_stability(long, "requires_manual_review", "b", "a", ["variant", "monotone"])
    return (st.join(F.broadcast(ap), "variant")     # one row per variant
            .select("variant", "monotone", F.col("average_precision").alias("pr_auc"), "verdicts_changed_pct"))


@op("variant_results", _VARIANTS_SQL, r="pr_auc verdicts_changed_pct:4")
def _(v):
    return _variant_results(v)


@op("variant_selection", f"""WITH res AS ({_VARIANTS_SQL}), pool AS (SELECT * FROM res WHERE verdicts_changed_pct < 0.5 OR NOT EXISTS (SELECT 1 FROM res WHERE verdicts_changed_pct < 0.5))
    SELECT variant, pr_auc FROM pool WHERE pr_auc >= (SELECT max(pr_auc) FROM pool) - 0.005 ORDER BY NOT monotone, pr_auc DESC LIMIT 1""", r="pr_auc")
def _(v):
    results = stored(_variant_results(v), "variants")      # one row per variant, asked for three times
    return models.variant_selection(results).select("variant", "pr_auc")
