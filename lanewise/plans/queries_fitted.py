"""The audit with fitted models, the fitted risk variants and the drivers of the cost model; their fits have no SQL twin.

``score_invoices_columns`` is the same audit with ratio and probability as stored columns, which SQL can follow.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators import cleaning, costing, enrich, fitted, metrics
from lanewise.plans import audit
from lanewise.plans.freight_view import SUBMISSION_ORDER, FreightView, extracted_from_invoices, invoices_from_lines
from lanewise.plans.queries_joins import SCORED, full_audit
from lanewise.plans.registry import op
from lanewise.plans.scratch import scratch_folder
from lanewise.session import stored
from lanewise.sources.commits import Commits
from lanewise.streaming.audit_run import AuditRun

FIT = {"max_iter": 5, "max_depth": 4}


class Fitted:
    """Stored inputs and fitted models of one folder of tables; every part is made when it is first asked for."""

    def __init__(self, view: FreightView):
        self.view = view
        self.invoices, self.orders = view.invoices, stored(view.orders, "orders")
        self.history = audit.carrier_history(self.invoices, "received_at", "invoice_seq")

    def price(self, orders: DataFrame, m: fitted.AuditModels) -> DataFrame:
        return audit.price_labelled(self.invoices, orders, self.view.weather, self.history, m)

    def models(self) -> fitted.AuditModels:
        folder = scratch_folder(self.view.spark, "audit-models")
        fitted.fit_audit_models(self.orders, self.price, folder, **FIT)
        self.folder = folder
        return fitted.load_audit_models(self.view.spark, folder)

    def scored(self, m: fitted.AuditModels) -> DataFrame:
        v, padding = self.view, F.col("quoted_days") / F.greatest("ideal_days", F.lit(0.1))
        booked = self.orders.select("order_id", padding.alias("vendor_padding_ratio"))
        seen = self.invoices.select("vendor_id", "order_id").join(booked, "order_id")
        paddings = metrics.vendor_padding_median(seen, self.invoices.select("vendor_id").distinct())
        return audit.score_invoices(extracted_from_invoices(self.invoices), m.with_order_ratio(self.orders), v.hubs, v.routes, v.fuel_prices, v.weather,
                                    self.history, models=m, paddings=paddings)


MODELLED = [*SCORED, "fair_lower", "fair_upper", "model2_proba", "ratio", "billed_message", "field_errors"]


@op("score_invoices_modelled")
def _(v):
    """The whole audit with fitted cost and risk models: every passed invoice has a probability, from models that never saw it."""
    f = Fitted(v)
    out = f.scored(f.models())
    names = out.withColumns({"field_errors": F.concat_ws(",", "field_errors"), "adjustment_drivers": F.to_json("adjustment_drivers")})
    return names.select(*MODELLED, "adjustment_drivers")


@op("fitted_variant_results")
def _(v):
    """Five fitted variants on the held-out invoices: ranking quality, confusion, what a price rise changes, and the one to deploy."""
    f, folder = Fitted(v), scratch_folder(v.spark, "variants")
    _, _, chosen = fitted.compare_variants(f.orders, f.price, folder, **FIT)
    out = v.spark.read.parquet(f"{folder}/variants")
    return out.withColumns({"recall_by_anomaly": F.to_json("recall_by_anomaly"), "chosen": F.col("variant") == chosen})


@op("order_drivers")
def _(v):
    """What each feature of an order adds to its out-of-fold estimate, in rupees, largest first."""
    folder = scratch_folder(v.spark, "cost-model")
    orders = stored(v.orders, "orders")
    fitted.fit_cost(orders, folder, **FIT, at_once=4)
    ratios = v.spark.read.parquet(f"{folder}/order_ratios").select("order_id", "ratio", "drivers")
    rows = orders.join(ratios, "order_id").withColumn("top", costing.top_drivers(fitted.attributions(F.col("drivers"), F.col("baseline_cost")), 8))
    return rows.select("order_id", "baseline_cost", "ratio", F.posexplode("top").alias("place", "d")).select("order_id", "baseline_cost", "ratio", "place", "d.feature", "d.impact")


# ---- ratio and probability as stored columns ---------------------------------------------------------------------------

GIVEN_RATIO = "(0.9::DOUBLE + (invoice_seq % 23) / 100.0::DOUBLE)"
GIVEN_PROBA = "((invoice_seq % 100) / 100.0::DOUBLE)"
MORE = {"prediction_status": "ps", "fair_lower": f"c0 * ({GIVEN_RATIO} * 0.97::DOUBLE)", "fair_upper": f"c0 * ({GIVEN_RATIO} * 1.03::DOUBLE)", "cost_mismatch": "total - c",
        "billed_ratio": "round(total / greatest(c, 1), 3)", "model2_proba": "p", "model_adjustment": "round(c - c0, 2)",
        "distance_km": "distance_km", "quoted_days": "quoted_days", "truck_type": "truck_type", "dest_hub_id": "d_hub",
        "true_delay_days": "actual_days - ideal_days", "commercial_delay_days": "actual_days - quoted_days", "expected_fuel_price": "expected_fuel_price"}


def given(invoices: DataFrame) -> DataFrame:
    """The extracted fields with a ratio and a probability stored beside them."""
    out = extracted_from_invoices(invoices)
    return out.withColumns({"given_ratio": 0.9 + (F.col("invoice_seq") % 23) / 100.0, "given_proba": (F.col("invoice_seq") % 100) / 100.0})


@op("score_invoices_columns", full_audit(GIVEN_RATIO, GIVEN_PROBA, "".join(f", {e} AS {n}" for n, e in MORE.items()), ", NULL" * len(MORE)),
    r="fair_cost:3 fair_lower:3 fair_upper:3 cost_mismatch:3 vendor_historical_risk_score billed_ratio:2 model_adjustment:1 distance_km:3 expected_fuel_price true_delay_days commercial_delay_days")
def _(v):
    """The audit with ratio and probability stored beside the invoices: all that it decides and derives from them."""
    invoices, orders = v.invoices, stored(v.orders, "orders")
    history = audit.carrier_history(invoices, "received_at", "invoice_seq")
    out = audit.score_invoices(given(invoices), orders, v.hubs, v.routes, v.fuel_prices, v.weather, history, F.col("given_ratio"), F.col("given_proba"))
    adjustment = F.element_at(F.filter("breakdown", lambda d: d["feature"] == "model_adjustment"), 1)["impact"]
    return out.withColumn("model_adjustment", F.when(F.col("gate_passed"), adjustment)).select(*SCORED, *MORE)


# ---- the audit on a stream -----------------------------------------------------------------------------------------------

def stream_in_parts(v: FreightView, run: AuditRun, parts: int = 3) -> None:
    """Invoice lines arrive in parts by ship date; for each part the query is started again from its checkpoint."""
    spark, lines = v.spark, v.table("lineitem")
    source, checkpoint = scratch_folder(spark, "lines"), scratch_folder(spark, "lines-ckpt")
    cuts = lines.select(F.percentile_approx("l_shipdate", [k / parts for k in range(1, parts)], 1000)).first()[0] or []
    days = [F.lit(c).cast("date") for c in cuts]
    place = F.lit(0)
    for d in days:                     # whole days: the first submission of an invoice is never behind a later one
        place = place + F.coalesce(F.col("l_shipdate").cast("date") >= d, F.lit(False)).cast("int")
    for k in range(parts):
        lines.where(place == k).write.mode("append").parquet(source)
        query = run.start(invoices_from_lines(spark.readStream.schema(lines.schema).parquet(source)), checkpoint)
        query.awaitTermination()
        if query.exception() is not None:
            raise query.exception()


def audit_run(v: FreightView, root: str) -> AuditRun:
    """The rule audit bound to the tables of the view, on a stream with labels."""
    orders, totals = stored(v.orders, "orders"), enrich.weather_totals(v.weather)

    def score(fields: DataFrame, history: DataFrame) -> DataFrame:
        return audit.score_invoices(fields, orders, v.hubs, v.routes, v.fuel_prices, totals, history)
    return AuditRun(Commits(v.spark, root), lambda raw: cleaning.clean_invoices(raw, SUBMISSION_ORDER), extracted_from_invoices, score,
                    "received_at", "invoice_seq", "requires_manual_review")


@op("audit_run", full_audit(), r="fair_cost:3 vendor_historical_risk_score")
def _(v):
    """Gate, score, log and carrier counters of a stream in several parts: the same rows as the audit of the whole table."""
    root = scratch_folder(v.spark, "audit-run")
    run = audit_run(v, root)
    stream_in_parts(v, run)
    first = next(iter(run.commits.rows().values()), None)
    schema = v.spark.read.parquet(first["scored"]).schema
    return run.commits.read("scored", schema).select(*SCORED)


@op("audit_run_counters", "SELECT vendor_id, count(*) AS n, sum(requires_manual_review)::BIGINT AS f FROM f_inv GROUP BY 1")
def _(v):
    """Carrier counters after the same stream."""
    run = audit_run(v, scratch_folder(v.spark, "audit-run"))
    stream_in_parts(v, run)
    return run.counters()
