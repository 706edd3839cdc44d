"""Fitted models of the audit: fitted side by side over stored tables, kept as one stored version, applied inside the audit plan.

No row is scored by a model that saw it. Orders carry the ratio of the fold model that left them out; an invoice takes the risk of
the fold model that left its hash bucket out; orders that the master data lacks take the final cost model.
"""

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import costing, metrics, models
from lanewise.operators.splits import hash_bucket, stratified_split
from lanewise.session import side_by_side, stored

# name: (features, only rises with the bill, rupee features in reference-period rupees)
VARIANTS = {"full": (C.RISK_FEATURES_FULL, False, False), "scale_free": (C.RISK_FEATURES_SCALE_FREE, False, False),
            "scale_free_monotone": (C.RISK_FEATURES_SCALE_FREE, True, False), "deflated": (C.RISK_FEATURES_FULL, False, True),
            "deflated_monotone": (C.RISK_FEATURES_FULL, True, True)}
CASE = ["invoice_id", "invoice_seq", "requires_manual_review", "anomaly_type"]
DRIVERS = "array<struct<feature:string,delta:double>>"


# ---- counterfactual drivers -----------------------------------------------------------------------------------

def cost_groups() -> dict[str, list[str]]:
    """Features of the cost model as people know them: the six numbers, the category and the truck."""
    names = models.cost_columns()
    return {c: [c] for c in C.COST_NUMERIC_FEATURES} | {"product_category": [n for n in names if n.startswith("cat_")],
                                                        "truck_type": [n for n in names if n.startswith("truck_")]}


def training_means(frame: DataFrame, features: list[str]) -> dict[str, float]:
    return frame.agg(*[F.avg(c).alias(c) for c in features]).first().asDict()


def with_drivers(model: PipelineModel, frame: DataFrame, means: dict[str, float], groups: dict[str, list[str]] | None = None,
                 prediction: str = "ratio") -> DataFrame:
    """The prediction, and ``drivers``: for each group of features the prediction less that with the group at its training mean.

    Every counterfactual is one more vector in the row and one more pass of the same fitted model, so nothing is exploded, shuffled or
    joined. ``model`` is a fitted pipeline of an assembler and a regression model.
    """
    assembler, last = model.stages[0], model.stages[-1]
    groups = cost_groups() if groups is None else groups
    inputs, kept = assembler.getInputCols(), frame.columns
    out = assembler.copy({assembler.outputCol: "_x"}).transform(frame)
    out = last.copy({last.featuresCol: "_x", last.predictionCol: prediction}).transform(out).drop("_x")
    out = out.withColumns({f"_mean_{c}": F.lit(float(means[c])) for g in groups.values() for c in g})
    for k, group in enumerate(groups.values()):
        moved = [f"_mean_{c}" if c in group else c for c in inputs]
        out = assembler.copy({assembler.inputCols: moved, assembler.outputCol: "_x"}).transform(out)
        out = last.copy({last.featuresCol: "_x", last.predictionCol: f"_p{k}"}).transform(out).drop("_x")
    drivers = F.array(*[F.struct(F.lit(g).alias("feature"), (F.col(prediction) - F.col(f"_p{k}")).alias("delta")) for k, g in enumerate(groups)])
    return out.select(*kept, prediction, drivers.cast(DRIVERS).alias("drivers"))


def attributions(drivers, baseline):
    """Rupees of each driver on the order's own baseline."""
    return F.transform(drivers, lambda d: F.struct(d["feature"].alias("feature"), F.round(d["delta"] * baseline, 2).alias("impact")))


# ---- risk variants ----------------------------------------------------------------------------------------------

def risk_features(features: list[str], scale: float = 1.0, reference_diesel: float | None = None) -> list:
    """The features as columns, at a general price level and, where asked, in reference-period rupees."""
    made = costing.risk_feature_columns(scale, None if reference_diesel is None else F.lit(float(reference_diesel)))
    return [made.get(f, F.col(f)).cast("double").alias(f) for f in features]


def fit_variant(train: DataFrame, name: str, reference_diesel: float, **fit) -> PipelineModel:
    features, monotone, deflate = VARIANTS[name]
    rows = models.dealt(train).select("requires_manual_review", *risk_features(features, 1.0, reference_diesel if deflate else None)).na.drop()
    return (models.fit_monotone_risk_model if monotone else models.fit_risk_model)(rows, features, **({} if monotone else fit))


def price_rise_scores(model: PipelineModel, rows: DataFrame, name: str, reference_diesel: float, rise: float = C.PRICE_RISE) -> DataFrame:
    """Risk of every row now and after all prices (bills, fair costs, diesel) rose alike; both in one pass over the row."""
    features, monotone, deflate = VARIANTS[name]
    ref = reference_diesel if deflate else None
    levels = {"now": 1.0, "later": rise}
    out = rows.select(*CASE, *[F.struct(*risk_features(features, s, ref)).alias(f"_{n}") for n, s in levels.items()])
    out = out.where(F.forall(F.array(*[F.col(f"_now.{f}") for f in features]), lambda x: x.isNotNull()))
    for n in levels:
        out = models.score_risk(model, out.select("*", f"_{n}.*")).drop(*features).withColumnRenamed("proba", f"proba_{n}")
    return out.select(F.lit(name).alias("variant"), F.lit(monotone).alias("monotone"), *CASE, "proba_now", "proba_later")


def fitted_variants(cases: DataFrame, reference_diesel: float, at_once: int = 4, **fit) -> DataFrame:
    """Scores of the five variants on the test rows of ``cases`` (stored; with is_test), fitted at the same time on the others."""
    train, test = cases.where("NOT is_test"), cases.where("is_test")
    fits = side_by_side(cases.sparkSession, {n: lambda n=n: fit_variant(train, n, reference_diesel, **fit) for n in VARIANTS}, at_once)
    out = None
    for name, model in fits.items():
        part = price_rise_scores(model, test, name, reference_diesel)
        out = part if out is None else out.unionByName(part)
    return out


def variant_table(scores: DataFrame, threshold: float = C.RISK_THRESHOLD) -> DataFrame:
    """One row for each variant: ranking quality, confusion at the threshold, recall by anomaly, and what a price rise changes."""
    rows = scores.withColumns({"now": F.col("proba_now") >= threshold, "later": F.col("proba_later") >= threshold})
    by, label = ["variant", "monotone"], "requires_manual_review"
    ranked = metrics.average_precision(rows, label, "proba_now", ["variant"]).select("variant", F.col("average_precision").alias("pr_auc"))
    calls = metrics.confusion_metrics(rows, label, "now", ["variant"]).select("variant", "precision", "recall", "f1")
    kinds = (rows.where(F.col(label).cast("boolean")).groupBy("variant", F.coalesce("anomaly_type", F.lit("unknown")).alias("kind"))
             .agg(F.avg(F.col("now").cast("double")).alias("r")).groupBy("variant")
             .agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("kind", "r")))).alias("recall_by_anomaly")))
    out = metrics.verdict_stability(rows, label, "now", "later", by)
    for part in (ranked, calls, kinds):
        out = out.join(F.broadcast(part), "variant", "left")      # one row per variant
    return out


# ---- the whole set --------------------------------------------------------------------------------------------------

@dataclass
class AuditModels:
    """One stored version, loaded once."""
    cost: PipelineModel                  # for orders that no training row knows
    means: dict[str, float]
    bands: DataFrame                     # truck, category, p10, p90: at most 15 rows
    overall: DataFrame
    order_ratios: DataFrame              # order_id, ratio and drivers by the fold model that left the order out
    risk: list[PipelineModel]            # by fold of the invoice
    variant: str
    reference_diesel: float
    bounds: dict[str, float]
    threshold: float = C.RISK_THRESHOLD

    def with_order_ratio(self, orders: DataFrame) -> DataFrame:
        return orders.join(self.order_ratios.select("order_id", "ratio", "drivers"), "order_id", "left")

    def estimate(self, df: DataFrame) -> DataFrame:
        """ratio and drivers of orders known from their invoice alone, by the final cost model."""
        made = costing.feature_matrix(df.withColumn("_row", F.struct(*df.columns)), ["_row"])
        return with_drivers(self.cost, made, self.means).select("_row.*", "ratio", "drivers")

    def with_band(self, df: DataFrame) -> DataFrame:
        """Columns low and high: the ratio's calibrated 80 % band, by truck and category where there is one."""
        box = self.overall.select(F.struct("p10", "p90").alias("b")).scalar()
        joined = df.join(F.broadcast(self.bands), ["truck_type", "product_category"], "left")      # at most trucks x categories rows
        return joined.withColumns({"low": F.col("ratio") * F.coalesce("p10", box["p10"]), "high": F.col("ratio") * F.coalesce("p90", box["p90"])}).drop("p10", "p90")

    def with_proba(self, df: DataFrame, seq: str = "invoice_seq") -> DataFrame:
        """model2_proba of each row by the model that left its fold out; a feature that cannot be computed counts as 0."""
        features, _, deflate = VARIANTS[self.variant]
        row = F.struct(*[F.col(c) for c in df.columns]).alias("_row")
        ready = [F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0)).alias(f) for f, c in zip(features, risk_features(features, 1.0, self.reference_diesel if deflate else None))]
        out = df.select(row, fold_of(seq).alias("_fold"), *ready)
        for k, model in enumerate(self.risk):
            out = models.score_risk(model, out).withColumnRenamed("proba", f"_p{k}")
        mine = F.coalesce(*[F.when(F.col("_fold") == k, F.col(f"_p{k}")) for k in range(len(self.risk))])
        return out.select("_row.*", mine.alias("model2_proba"))


def fold_of(seq: str, folds: int = models.FOLDS, seed: int = 42):
    return F.pmod(hash_bucket(F.coalesce(F.col(seq), F.lit(0)), seed), F.lit(folds)).cast("int")


def fit_cost(orders: DataFrame, folder: str, max_iter: int, max_depth: int, at_once: int) -> None:
    """Fold models and the final one over one stored frame; ratios, drivers and bands of the orders they left out."""
    spark = orders.sparkSession
    frame = stored(models.cost_frame(orders, ["order_id", "order_seq"]).withColumn("fold", fold_of("order_seq")), "cost-frame")
    def fit(rows):
        return models.fit_cost_ratio(models.dealt(rows), max_iter=max_iter, max_depth=max_depth)
    jobs = {str(k): lambda k=k: fit(frame.where(F.col("fold") != k)) for k in range(models.FOLDS)} | {"final": lambda: fit(frame)}
    fits = side_by_side(spark, jobs, at_once)
    means = training_means(frame, models.cost_columns())
    spark.createDataFrame(list(means.items()), "feature string, mean double").coalesce(1).write.parquet(f"{folder}/means")
    out = None
    for k in range(models.FOLDS):
        part = with_drivers(fits[str(k)], frame.where(F.col("fold") == k), means)
        out = part if out is None else out.unionByName(part)
    out.select("order_id", "fold", "truck_type", "product_category", "cost_ratio", "ratio", "drivers").write.parquet(f"{folder}/order_ratios")
    bands, overall = models.residual_bands(spark.read.parquet(f"{folder}/order_ratios"))
    bands.write.parquet(f"{folder}/bands")
    overall.write.parquet(f"{folder}/overall")
    fits["final"].write().save(f"{folder}/cost")


def risk_cases(priced: DataFrame) -> DataFrame:
    """What the risk features and the bounds need of an invoice priced by its out-of-fold ratio."""
    need = ["actual_billed_amount", "fair_cost", "fair_lower", "fair_upper", "commercial_delay_days", "billable_weight_kg", "distance_km",
            "expected_fuel_price", "actual_days", "true_delay_days", "adverse_weather_days", "vendor_padding_ratio", "vendor_historical_risk_score"]
    return priced.select(*CASE, *[F.col(c).cast("double").alias(c) for c in need]).na.drop(subset=need)


def compare_variants(orders: DataFrame, price: Callable[[DataFrame, "AuditModels"], DataFrame], folder: str, max_iter: int = 20, max_depth: int = 4,
                     at_once: int = 4) -> tuple[DataFrame, float, str]:
    """Fit the cost models and the five risk variants and store them and what they score; the cases, the mean diesel price and the
    variant to deploy."""
    spark = orders.sparkSession
    fit_cost(orders, folder, max_iter, max_depth, at_once)
    reference = orders.agg(F.avg("expected_fuel_price")).first()[0]
    half = _load_cost(spark, folder, reference)
    cases = stored(risk_cases(price(half.with_order_ratio(orders), half)), "risk-cases")
    tagged = stored(stratified_split(cases, "requires_manual_review", "invoice_seq"), "risk-split")
    fitted_variants(tagged, reference, at_once, max_iter=max_iter, max_depth=max_depth).write.parquet(f"{folder}/variant_scores")
    variant_table(spark.read.parquet(f"{folder}/variant_scores")).coalesce(1).write.parquet(f"{folder}/variants")
    return cases, reference, models.variant_selection(spark.read.parquet(f"{folder}/variants")).first()["variant"]


def fit_audit_models(orders: DataFrame, price: Callable[[DataFrame, "AuditModels"], DataFrame], folder: str, max_iter: int = 20, max_depth: int = 4,
                     at_once: int = 4) -> None:
    """Fit and store everything under ``folder``, the numbers that make it complete last.

    ``orders`` have order_id, order_seq and the cost columns; ``price(orders, models)`` gives the labelled invoices priced by the
    ratios that the models carry, with delays, weather and carrier history.
    """
    spark = orders.sparkSession
    cases, reference, chosen = compare_variants(orders, price, folder, max_iter, max_depth, at_once)
    folds = cases.withColumn("fold", fold_of("invoice_seq"))
    jobs = {str(k): lambda k=k: fit_variant(folds.where(F.col("fold") != k), chosen, reference, max_iter=max_iter, max_depth=max_depth) for k in range(models.FOLDS)}
    for k, model in side_by_side(spark, jobs, at_once).items():
        model.write().save(f"{folder}/risk-{k}")
    bounds = metrics.price_bounds(orders, cases.where("requires_manual_review = 0")).first().asDict()
    numbers = {"variant": chosen, "reference_diesel": reference, "bounds": bounds, "threshold": C.RISK_THRESHOLD}
    spark.createDataFrame([(json.dumps(numbers),)], "numbers string").coalesce(1).write.text(f"{folder}/numbers")


def _load_cost(spark: SparkSession, folder: str, reference: float) -> AuditModels:
    means = {r["feature"]: r["mean"] for r in spark.read.parquet(f"{folder}/means").collect()}      # 14 rows
    return AuditModels(PipelineModel.load(f"{folder}/cost"), means, spark.read.parquet(f"{folder}/bands"), spark.read.parquet(f"{folder}/overall"),
                       spark.read.parquet(f"{folder}/order_ratios"), [], "full", reference, dict(C.PRICE_BOUNDS))


def load_audit_models(spark: SparkSession, folder: str) -> AuditModels:
    """Everything that ``fit_audit_models`` stored; fails on a folder whose fit did not end."""
    numbers = json.loads(spark.read.text(f"{folder}/numbers").first()[0])
    out = _load_cost(spark, folder, numbers["reference_diesel"])
    out.risk = [PipelineModel.load(f"{folder}/risk-{k}") for k in range(models.FOLDS)]
    out.variant, out.bounds, out.threshold = numbers["variant"], numbers["bounds"], numbers["threshold"]
    return out
