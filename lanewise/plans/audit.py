"""The end-to-end audit of a table of invoices."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import dates
from lanewise.functions.numeric import laplace_score
from lanewise.operators import cleaning, costing, enrich, explain, gate, metrics
from lanewise.operators.fitted import AuditModels, attributions

ORDER_COLUMNS = ["origin_hub_id", "dest_hub_id", "product_category", "order_date", "truck_type", "weight_kg",
                 "billable_weight_kg", "quoted_days", "ideal_days", "distance_km", "expected_fuel_price",
                 "expected_weather_score", "base_freight_cost"]


def build_orders(raw: DataFrame, hubs: DataFrame, routes: DataFrame, prices: DataFrame) -> DataFrame:
    """Raw orders -> cleaned, routed, priced orders. Every lookup is a checked broadcast,
    so the orders are not shuffled here at all."""
    df = enrich.route_lookup(enrich.hub_attributes(cleaning.clean_orders(raw), hubs), routes)
    df = df.withColumn("quoted_days", F.round(F.col("ideal_days") * 1.15, 1)).withColumn("state", F.col("origin_state"))
    df = enrich.fuel_fallback(enrich.asof_fuel(df, prices), prices)
    df = costing.cost_baseline(df).withColumn("base_freight_cost", F.col("baseline_cost") * F.col("cost_factor"))
    return df.drop("cost_factor")


def price_invoices(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Invoices with their order, fair cost band, delays and price checks; unknown orders drop out."""
    df = enrich.order_enrich(invoices.drop("weight_kg"), orders, ORDER_COLUMNS).where("order_found").drop("order_found")
    df = costing.delay_features(costing.fair_cost(costing.cost_baseline(df)))
    return with_checks(df)


def with_checks(df: DataFrame, proba: Column | None = None, threshold: float = C.RISK_THRESHOLD, bounds: dict = C.PRICE_BOUNDS) -> DataFrame:
    billed = costing.check_billed(F.col("actual_billed_amount"), F.col("fair_cost"), F.col("fair_lower"), F.col("fair_upper"), bounds)
    df = (df.withColumn("prediction_status", costing.check_prediction(F.col("fair_cost"), F.col("distance_km"), bounds))
          .withColumn("_b", billed)
          .withColumns({"billed_status": F.col("_b.status"), "billed_ratio": F.col("_b.ratio"),
                        "billed_message": F.col("_b.message")}).drop("_b"))
    return costing.flag_decision(df, proba, threshold)


def resolve_order(invoices: DataFrame, orders: DataFrame, hubs: DataFrame, routes: DataFrame, prices: DataFrame,
                  weather: enrich.WeatherTotals, models: AuditModels | None = None) -> DataFrame:
    """The order of each invoice, or its estimate when the master data has none.

    Only invoices without an order go through the estimate, its trip weather and, with ``models``, the final cost model; known orders
    bring the ratio of the model that left them out.
    """
    columns = ORDER_COLUMNS + (["ratio", "drivers"] if models else [])
    joined = enrich.order_enrich(invoices.withColumnsRenamed({"weight_kg": "inv_weight_kg"}), orders, columns)
    known = joined.where("order_found").withColumn("fuel_source", F.lit("order"))
    unknown = (joined.where("NOT order_found").drop(*columns)
               .withColumnRenamed("inv_weight_kg", "weight_kg")
               .withColumns({"truck_type": F.lit(None).cast("string"), "product_category": F.lit(None).cast("string")}))
    guess = enrich.estimate_missing_order(unknown, hubs, routes)
    guess = enrich.fuel_resolve(guess.withColumn("order_date", F.col("invoice_date")), prices, state="est_state", day="order_date")
    start, end = dates.transit_window(F.col("invoice_date"), F.col("actual_days"))
    lo, hi = dates.bounded_window(start, end)
    guess = enrich.weather_window(guess.withColumns({"_start": lo, "_end": hi}), weather, "destination_hub_id", "_start", "_end")
    guess = guess.select(
        *[c for c in invoices.columns if c != "weight_kg"], F.col("weight_kg").alias("inv_weight_kg"),
        F.col("origin_hub_id"), F.col("destination_hub_id").alias("dest_hub_id"), F.col("est_category").alias("product_category"),
        "order_date", F.col("est_truck_type").alias("truck_type"), F.col("est_weight_kg").alias("weight_kg"),
        F.col("est_weight_kg").alias("billable_weight_kg"), F.col("est_quoted_days").alias("quoted_days"),
        F.col("est_ideal_days").alias("ideal_days"), F.col("est_distance_km").alias("distance_km"),
        F.coalesce("fuel_price", F.lit(C.FALLBACK_DIESEL_NEW_ORDER)).alias("expected_fuel_price"),
        F.col("weather_score").cast("double").alias("expected_weather_score"), F.lit(None).cast("double").alias("base_freight_cost"),
        F.lit(False).alias("order_found"), "fuel_source")
    if models:
        guess = models.estimate(guess)
    return known.unionByName(guess.select(*known.columns))


def score_invoices(invoices: DataFrame, orders: DataFrame, hubs: DataFrame, routes: DataFrame, prices: DataFrame,
                   weather: DataFrame | enrich.WeatherTotals, history: DataFrame, ratio: Column | None = None, proba: Column | None = None,
                   models: AuditModels | None = None, paddings: DataFrame | None = None, reference: DataFrame | None = None) -> DataFrame:
    """Gate, enrich, price, flag and explain every invoice.

    ``invoices`` holds typed fields (see freight_view.extracted); ``history`` gives invoice_id, prior_total and prior_flagged of
    the carrier before each invoice. ``models`` plugs in the fitted models: ``orders`` must then carry their out-of-fold ratio and
    drivers, the checks use the learned bounds, and every passed invoice gets a probability. ``ratio`` and ``proba`` do the same for
    stored columns of ``invoices``. Without any, the estimate is the cost build-up and only the price checks flag. ``paddings`` (vendor_id,
    padding_median) stands in for the quote of orders that the master data lacks; ``reference`` (order_id, invoice_id,
    adverse_weather_days, vendor_padding_ratio) overrides the measured context of the orders it names.
    """
    gated = gate.confidence_gate(invoices)
    totals = weather if isinstance(weather, enrich.WeatherTotals) else enrich.weather_totals(weather)
    passed = resolve_order(gated.where("gate_passed"), orders, hubs, routes, prices, totals, models)
    start, end = dates.transit_window(F.col("invoice_date"), F.col("actual_days"))
    lo, hi = dates.bounded_window(start, end)
    passed = enrich.weather_window(passed.withColumns({"window_start": lo, "window_end": hi}), totals)
    if reference is not None:
        passed = enrich.coalesce_context(enrich.reference_context(passed, reference).withColumn("asof_price", F.lit(None).cast("double")))
    passed = passed.join(history.select("invoice_id", "prior_total", "prior_flagged"), "invoice_id", "left")
    prior_total, prior_flagged = F.coalesce("prior_total", F.lit(0)), F.coalesce("prior_flagged", F.lit(0))
    passed = passed.withColumns({
        "vendor_is_new": prior_total == 0,
        "vendor_historical_risk_score": laplace_score(prior_flagged, prior_total, "zero"),
        "actual_billed_amount": F.col("total"),
        "input_problems": costing.input_problems()})
    based, low, high = costing.cost_baseline(passed), None, None
    if models:
        based, ratio, low, high = models.with_band(based), F.col("ratio"), F.col("low"), F.col("high")
    priced = costing.delay_features(costing.fair_cost(based, ratio, low, high))
    if paddings is not None:
        priced = priced.join(paddings.select("vendor_id", "padding_median"), "vendor_id", "left")
        typical = F.coalesce("padding_median", F.lit(C.FALLBACK_PADDING))
        priced = priced.withColumn("vendor_padding_ratio", F.when(F.col("order_found"), F.col("vendor_padding_ratio")).otherwise(typical)).drop("padding_median")
    if reference is not None:
        priced = priced.withColumn("vendor_padding_ratio", F.coalesce(F.when(F.col("from_reference"), F.col("ref_padding")), "vendor_padding_ratio"))
    if models:
        priced = models.with_proba(priced)
        proba = F.col("model2_proba")
    priced = with_checks(priced, proba, *((models.threshold, models.bounds) if models else ()))
    impossible = F.size("input_problems") > 0
    out = {"cost_mismatch": F.col("cost_mismatch"), "fair_cost": F.col("fair_cost"), "fair_lower": F.col("fair_lower"),
           "fair_upper": F.col("fair_upper"), "billed_ratio": F.col("billed_ratio"), "flagged": F.col("flagged"),
           "flag_source": F.col("flag_source"), "billed_status": F.col("billed_status"),
           "prediction_status": F.col("prediction_status"), "billed_message": F.col("billed_message")}
    scored = priced.withColumns({n: F.when(~impossible, c) for n, c in out.items()})
    scored = scored.withColumns({
        "gate_passed": ~impossible, "gate_reason": F.when(impossible, "invalid_order_record"),
        "model2_proba": F.lit(None).cast("double") if proba is None else F.when(~impossible, proba)})
    scored = costing.cost_breakdown(scored)
    scored = scored.withColumn("top_drivers", costing.top_drivers(F.col("breakdown")))
    if models:
        scored = scored.withColumn("adjustment_drivers", costing.top_drivers(attributions(F.col("drivers"), F.col("baseline_cost"))))
    scored = scored.withColumn("explanation", explain.with_rule_messages(explain.explanation_text(F.col("model2_proba"))))
    scored = scored.withColumn("summary", explain.summary_line())
    scored = scored.withColumn("field_errors", F.when(impossible, F.array(F.lit("order_id"))).otherwise(F.array().cast("array<string>")))
    stopped = gated.where("NOT gate_passed").withColumn("field_errors", gate.gate_error_fields(F.col("gate_reason")))
    stopped = stopped.withColumn("explanation", F.concat(F.lit("Stopped at the gate: "), F.regexp_replace("gate_reason", "_", " "),
                                                         F.lit(". No score was computed.")))
    return scored.unionByName(stopped.withColumnRenamed("weight_kg", "inv_weight_kg"), allowMissingColumns=True)


def price_labelled(invoices: DataFrame, orders: DataFrame, weather: DataFrame, history: DataFrame, models: AuditModels) -> DataFrame:
    """Labelled invoices of known orders as the risk model learns them: priced by the ratio that left their order out, with delays,
    trip weather and the carrier's history as the audit sees them. ``orders`` carry ratio and drivers."""
    df = enrich.order_enrich(invoices.drop("weight_kg"), orders, ORDER_COLUMNS + ["ratio", "drivers"]).where("order_found AND ratio IS NOT NULL")
    df = models.with_band(costing.cost_baseline(df))
    df = costing.delay_features(costing.fair_cost(df, F.col("ratio"), F.col("low"), F.col("high")))
    lo, hi = dates.bounded_window(*dates.transit_window(F.col("received_at"), F.col("actual_days")))
    df = enrich.weather_window(df.withColumns({"window_start": lo, "window_end": hi}), weather)
    past = history.select("invoice_id", "prior_total", "prior_flagged")
    return df.join(past, "invoice_id").withColumn("vendor_historical_risk_score", laplace_score(F.col("prior_flagged"), F.col("prior_total"), "zero"))


def carrier_history(invoices: DataFrame, day: str, seq: str) -> DataFrame:
    """Counters of each carrier before each invoice."""
    return metrics.causal_vendor_risk(invoices, day, seq)


def quote_shipments(shipments: DataFrame, ranges: DataFrame, ratio: Column | None = None) -> DataFrame:
    """Estimate, band, plausibility and drivers of planned shipments; impossible inputs are refused."""
    df = shipments.withColumn("input_problems", costing.input_problems())
    df = costing.cost_breakdown(costing.fair_cost(costing.cost_baseline(df), ratio))
    df = df.withColumn("accepted", F.size("input_problems") == 0)
    box = ranges.select(F.struct(*[f"{n}_{s}" for n in C.DRIFT_LABELS for s in ("min", "max")]).alias("r")).scalar()
    outside = F.array_compact(F.array(*[
        F.when((F.col(n) > box[f"{n}_max"]) | (F.col(n) < box[f"{n}_min"]), n) for n in C.DRIFT_LABELS]))
    return df.withColumns({
        "prediction_status": costing.check_prediction(F.col("fair_cost"), F.col("distance_km")),
        "top_drivers": costing.top_drivers(F.col("breakdown")), "drift_features": outside})
