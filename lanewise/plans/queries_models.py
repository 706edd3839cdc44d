"""Model fits, which have no SQL twin, and streaming runs, compared with their batch SQL."""

from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import costing, enrich, metrics, models, splits
from lanewise.plans import audit
from lanewise.plans.freight_view import FreightView, invoices_from_lines, log_from_events
from lanewise.plans.queries_joins import trip_windows
from lanewise.plans.registry import op
from lanewise.plans.scratch import scratch_folder
from lanewise.session import side_by_side, stored
from lanewise.streaming import audit_stream as stream


def _cost_frame(v):
    return stored(models.cost_frame(v.orders, ["order_id", "order_seq"]), "cost-frame")


@op("fair_cost_model")
def _(v):
    """Band and point of every order from the final model."""
    frame = _cost_frame(v)
    model, _ = models.fair_cost_model(frame, "order_seq")
    return model.predict(frame).select("order_id", "baseline_cost", "base_freight_cost", "fair_cost", "fair_lower", "fair_upper")


@op("oof_folds", "SELECT order_id, ((order_seq % 1000003 * 7919 + 4398618 % 1000003) % 1000003 % 5)::INTEGER AS oof_fold_id FROM f_ord_raw")
def _(v):
    return v.orders_raw.select("order_id", (splits.hash_bucket(F.col("order_seq"), 42) % models.FOLDS).cast("int").alias("oof_fold_id"))


@op("oof_predictions")
def _(v):
    return models.oof_predictions(_cost_frame(v), "order_seq").select("order_id", "oof_fold_id", "cost_ratio", "ratio")


@op("direct_cost_model")
def _(v):
    """Hold-out error of the direct model beside the ratio model's."""
    tagged = splits.random_split(_cost_frame(v), "order_seq")
    train, test = tagged.where("NOT is_test"), tagged.where("is_test")
    fits = side_by_side(v.spark, {"direct": lambda: models.direct_cost_model(train, test), "ratio": lambda: models.fit_cost_ratio(train)})
    ratio = fits["ratio"].transform(test).select("order_id", "ratio")
    both = fits["direct"].join(ratio, "order_id").withColumn("ratio_cost", F.col("baseline_cost") * F.col("ratio"))
    cells = F.array(*[F.struct(F.lit(n).alias("model"), F.col(c).alias("p"), F.col(c).alias("lo"), F.col(c).alias("hi"))
                      for n, c in (("direct", "direct_cost"), ("ratio", "ratio_cost"))])
    return metrics.regression_metrics(both.select("base_freight_cost", F.inline(cells)), "base_freight_cost", "p", "lo", "hi", ["model"])


def _risk_frame(v):
    d = costing.risk_features(v.priced)
    h = v.history.select("invoice_id", "vendor_historical_risk_score")
    wet = enrich.weather_window(trip_windows(v), v.weather).select("invoice_id", "adverse_weather_days")
    d = d.drop("adverse_weather_days").join(h, "invoice_id").join(wet, "invoice_id")
    # stored before the split, which reads its rows twice
    d = stored(d.select("invoice_id", "requires_manual_review", "invoice_seq", *[F.col(c).cast("double").alias(c) for c in C.RISK_FEATURES_FULL]), "risk-rows")
    return stored(splits.stratified_split(d, "requires_manual_review", "invoice_seq").drop("invoice_seq"), "risk-frame")


@op("risk_model")
def _(v):
    d = _risk_frame(v)
    model = models.fit_risk_model(models.dealt(d.where("NOT is_test")))
    return models.score_risk(model, d.where("is_test")).select("invoice_id", "requires_manual_review", "proba")


@op("feature_importances")
def _(v):
    model = models.fit_risk_model(_risk_frame(v))
    return models.feature_importances(v.spark, model, C.RISK_FEATURES_FULL)


@op("risk_model_monotone")
def _(v):
    d = _risk_frame(v)
    model = models.fit_monotone_risk_model(models.dealt(d.where("NOT is_test")))
    return models.score_risk(model, d.where("is_test")).select("invoice_id", "requires_manual_review", "proba")


@op("model_persistence")
def _(v):
    """Largest difference between a model's predictions and those of its reloaded copy."""
    frame = _cost_frame(v)
    model, _ = models.fair_cost_model(frame, "order_seq")
    path = scratch_folder(v.spark, "model")
    models.save_cost_model(model, path, {"reference_diesel": str(C.REFERENCE_DIESEL)})
    again = models.load_cost_model(v.spark, path)
    a = model.predict(frame).select("order_id", F.col("fair_cost").alias("a"))
    b = again.predict(frame).select("order_id", F.col("fair_cost").alias("b"))
    return a.join(b, "order_id").agg(F.count("*").alias("orders"), F.max(F.abs(F.col("a") - F.col("b"))).alias("largest_difference"))


# ---- streaming -------------------------------------------------------------------------------------------

def _read_stream(v: FreightView, name: str):
    schema = v.table(name).schema
    return v.spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(v.folder)


def _run(query):
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


@op("audit_stream", "SELECT i.invoice_id, i.actual_billed_amount, o.distance_km, CASE WHEN o.order_id IS NOT NULL THEN i.actual_billed_amount - o.baseline_cost END AS cost_mismatch FROM f_inv_raw i JOIN f_ord o ON i.order_id = o.order_id WHERE i.actual_billed_amount > 0",
    r="cost_mismatch:3")
def _(v):
    """Every submission priced against its order as it arrives."""
    out, ckpt = scratch_folder(v.spark, "audit"), scratch_folder(v.spark, "audit-ckpt")
    orders = stored(v.orders, "orders")

    def job(batch):
        good = batch.withColumn("vendor_id", F.upper("vendor_id")).where("actual_billed_amount > 0")
        return audit.price_invoices(good, orders).select("invoice_id", "actual_billed_amount", "distance_km", "cost_mismatch", "flagged")
    _run(stream.audit_stream(invoices_from_lines(_read_stream(v, "lineitem")), job, out, ckpt))
    return v.spark.read.parquet(out).select("invoice_id", "actual_billed_amount", "distance_km", "cost_mismatch")


def _log_in_parts(v, start, parts: int = 3) -> None:
    """Events arrive in parts, in order of time; the query that ``start`` makes of the log is started again for each part and goes on
    from its checkpoint."""
    spark, source, events = v.spark, scratch_folder(v.spark, "events-in"), v.table("events")
    cuts = events.select(F.percentile_approx("ts", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    place = F.lit(0)
    for c in cuts:
        place = place + F.coalesce(F.col("ts") >= F.lit(c), F.lit(True)).cast("int")       # rows without a time come last
    for k in range(len(cuts) + 1):
        events.where(place == k).write.mode("append").parquet(source)
        _run(start(log_from_events(spark.readStream.schema(events.schema).parquet(source))))


@op("running_vendor_stats", "SELECT vendor_id, count(*) AS total_invoices, count(*) FILTER (flagged) AS flagged_invoices FROM f_log GROUP BY 1")
def _(v):
    out, ckpt = scratch_folder(v.spark, "stats"), scratch_folder(v.spark, "stats-ckpt")
    _log_in_parts(v, lambda log: stream.running_vendor_stats(log, out, ckpt))
    return stream.latest_vendor_stats(v.spark.read.parquet(stream.compacted(v.spark, out, stream.latest_vendor_stats)))


@op("causal_score_stream", """SELECT id, vendor_id, coalesce(count(*) OVER w, 0) AS prior_total, coalesce(count(*) FILTER (flagged) OVER w, 0) AS prior_flagged FROM f_log
    WINDOW w AS (PARTITION BY vendor_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def _(v):
    out, ckpt = scratch_folder(v.spark, "causal"), scratch_folder(v.spark, "causal-ckpt")
    _log_in_parts(v, lambda log: stream.causal_score_stream(log.select("id", "vendor_id", "flagged", F.col("created_at").alias("at")), out, ckpt, "at", "id"))
    return v.spark.read.parquet(out).select("id", "vendor_id", "prior_total", "prior_flagged")


@op("live_dashboard", """SELECT created_at::DATE AS day, count(*) AS total, count(*) FILTER (gate_passed) AS passed, count(*) FILTER (NOT gate_passed) AS rejected,
    count(*) FILTER (gate_passed AND flagged) AS flagged FROM f_log GROUP BY 1""")
def _(v):
    out, ckpt = scratch_folder(v.spark, "dashboard"), scratch_folder(v.spark, "dashboard-ckpt")
    _log_in_parts(v, lambda log: stream.live_dashboard(log, out, ckpt))
    return stream.latest_dashboard(v.spark.read.parquet(stream.compacted(v.spark, out, stream.latest_dashboard)))


@op("append_audit_log", """SELECT gate_passed, coalesce(gate_reason, 'none') AS reason, count(*) AS n, count(fields_total) AS with_total FROM (SELECT gate_passed, gate_reason, total AS fields_total FROM f_gated) GROUP BY 1, 2""")
def _(v):
    """Decisions written to the log and read back, fields inside the JSON included."""
    from lanewise.sources import reference
    path = scratch_folder(v.spark, "log")
    scored = v.scored.withColumn("manual_fields", F.array(F.lit("toll")))
    reference.append_audit_log(reference.audit_record(scored, F.lit("2001-12-01").cast("timestamp")), path)
    log = v.spark.read.parquet(path)
    total = F.get_json_object("extracted_fields", "$.total")
    return log.groupBy("gate_passed", F.coalesce("gate_reason", F.lit("none")).alias("reason")).agg(F.count("*").alias("n"), F.count(total).alias("with_total"))
