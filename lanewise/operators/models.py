"""Fair-cost and risk models as Spark ML jobs."""

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import DenseMatrix
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.operators import costing, metrics
from lanewise.operators.scale import exact_percentiles, keep_first_by
from lanewise.operators.splits import hash_bucket
from lanewise.session import side_by_side, stored

FOLDS = 5
FIT_ROWS = 1 << 20      # training rows that one task of a fit holds, about


def dealt(frame: DataFrame, rows_each: int = FIT_ROWS) -> DataFrame:
    """``frame`` (stored), in as many partitions as make about ``rows_each`` rows each where one has more. A fit keeps its rows unpacked, many
    times their size in the file, and every pass of it reads a whole partition in one task."""
    total, most = frame.groupBy(F.spark_partition_id()).count().agg(F.sum("count"), F.max("count")).first()
    return frame if (most or 0) <= rows_each else frame.repartition(-(-total // rows_each))


def cost_columns() -> list[str]:
    slug = [v.lower().replace(" ", "_").replace("-", "_") for v in C.PRODUCT_CATEGORIES + C.TRUCK_TYPES]
    n = len(C.PRODUCT_CATEGORIES)
    return C.COST_NUMERIC_FEATURES + [f"cat_{s}" for s in slug[:n]] + [f"truck_{s}" for s in slug[n:]]


def cost_frame(orders: DataFrame, keep: list[str]) -> DataFrame:
    """Baseline, target ratio and the 14 model columns."""
    based = costing.cost_baseline(orders).withColumn("cost_ratio", F.col("base_freight_cost") / F.col("baseline_cost"))
    return costing.feature_matrix(based.where(F.col("cost_ratio").isNotNull()),
                                  [*keep, "baseline_cost", "base_freight_cost", "cost_ratio", "product_category", "truck_type"])


def fit_cost_ratio(frame: DataFrame, target: str = "cost_ratio", max_iter: int = 30, max_depth: int = 5,
                   seed: int = 42) -> PipelineModel:
    assembler = VectorAssembler(inputCols=cost_columns(), outputCol="features", handleInvalid="keep")
    tree = GBTRegressor(featuresCol="features", labelCol=target, predictionCol="ratio", maxIter=max_iter, maxDepth=max_depth,
                        stepSize=0.2, subsamplingRate=0.8, seed=seed)
    return Pipeline(stages=[assembler, tree]).fit(frame)


@dataclass
class CostModel:
    """Ratio model plus the residual band by truck and category."""
    pipeline: PipelineModel
    bands: DataFrame
    overall: DataFrame = field(repr=False)

    def predict(self, frame: DataFrame) -> DataFrame:
        """fair_cost, fair_lower and fair_upper; the band always contains the point."""
        scored = self.pipeline.transform(frame).drop("features")
        any_band = self.overall.select(F.struct("p10", "p90").alias("b")).scalar()
        # at most trucks x categories rows
        joined = scored.join(F.broadcast(self.bands), ["truck_type", "product_category"], "left")
        low = F.col("ratio") * F.coalesce("p10", any_band["p10"])
        high = F.col("ratio") * F.coalesce("p90", any_band["p90"])
        return costing.fair_cost(joined, F.col("ratio"), low, high).drop("p10", "p90")


def _oof(frame: DataFrame, seq: str, folds: int, seed: int, more: dict[str, Callable], fit: dict) -> tuple[DataFrame, dict]:
    """Out-of-fold predictions, and the results of ``more`` jobs that ran beside the fits of the folds."""
    tagged = frame.withColumn("oof_fold_id", (hash_bucket(F.col(seq), seed) % folds).cast("int"))
    tagged = stored(tagged, "folds")
    jobs = {str(k): lambda k=k: fit_cost_ratio(dealt(tagged.where(F.col("oof_fold_id") != k)), seed=seed, **fit) for k in range(folds)}
    fits = side_by_side(frame.sparkSession, jobs | more)
    out = None
    for k in range(folds):
        part = fits[str(k)].transform(tagged.where(F.col("oof_fold_id") == k)).drop("features")
        out = part if out is None else out.unionByName(part)
    return out, fits


def oof_predictions(frame: DataFrame, seq: str, folds: int = FOLDS, seed: int = 42, **fit) -> DataFrame:
    """Out-of-fold ratio for every order: each fold is scored by a model that never saw it."""
    return _oof(frame, seq, folds, seed, {}, fit)[0]


def residual_bands(oof: DataFrame) -> tuple[DataFrame, DataFrame]:
    """10th and 90th percentile of actual over predicted ratio, by truck and category and overall."""
    rel = oof.withColumn("rel", F.col("cost_ratio") / F.col("ratio"))
    fr = {"p10": 0.1, "p90": 0.9}
    return exact_percentiles(rel, "rel", fr, ["truck_type", "product_category"]), exact_percentiles(rel, "rel", fr)


def fair_cost_model(frame: DataFrame, seq: str, **fit) -> tuple[CostModel, DataFrame]:
    """Final model with bands calibrated on out-of-fold residuals, and those predictions."""
    oof, fits = _oof(frame, seq, FOLDS, 42, {"final": lambda: fit_cost_ratio(dealt(frame), **fit)}, fit)
    oof = stored(oof, "oof")      # the bands read it twice, the caller once more; the fold models score once
    bands, overall = residual_bands(oof)
    return CostModel(fits["final"], stored(bands, "bands"), stored(overall, "overall")), oof


def direct_cost_model(train: DataFrame, test: DataFrame, **fit) -> DataFrame:
    """Comparison model on the raw cost; returns test predictions in direct_cost."""
    model = fit_cost_ratio(train, target="base_freight_cost", **fit)
    return model.transform(test).drop("features").withColumnRenamed("ratio", "direct_cost")


# ---- risk -----------------------------------------------------------------------

def training_frame(invoices: DataFrame, labels: DataFrame, orders: DataFrame, columns: list[str], need: list[str]) -> DataFrame:
    """Invoices with their anomaly type and the order's predictions and physical data; complete rows only."""
    return (invoices.join(labels.select("order_id", "anomaly_type"), "order_id", "left")
            .join(orders.select("order_id", *columns), "order_id").na.drop(subset=need))


def _weighted(train: DataFrame, label: str) -> DataFrame:
    weight = metrics.class_weight(train, label).scalar()
    return train.withColumn("row_weight", F.when(F.col(label) == 1, weight).otherwise(F.lit(1.0)))


def _with_proba(scored: DataFrame) -> DataFrame:
    return (scored.withColumn("proba", vector_to_array("probability")[1])
            .drop("raw", "features", "scaled", "probability", "prediction", "rawPrediction"))


def fit_risk_model(train: DataFrame, features: list[str] = C.RISK_FEATURES_FULL, label: str = "requires_manual_review",
                   max_iter: int = 20, max_depth: int = 4, seed: int = 42) -> PipelineModel:
    """Boosted trees with the positive class weighted up."""
    stages = [VectorAssembler(inputCols=features, outputCol="features", handleInvalid="keep"),
              GBTClassifier(featuresCol="features", labelCol=label, weightCol="row_weight", maxIter=max_iter, maxDepth=max_depth,
                            seed=seed)]
    return Pipeline(stages=stages).fit(_weighted(train, label))


def fit_monotone_risk_model(train: DataFrame, features: list[str] = C.RISK_FEATURES_FULL,
                            label: str = "requires_manual_review", max_iter: int = 50) -> PipelineModel:
    """Logistic model in which every feature that grows with the bill can only raise the risk."""
    # finite: an infinite bound times the zero spread of a constant feature would be undefined
    bounds = [0.0 if f in C.RISK_FEATURES_RISING else -1e6 for f in features]
    stages = [VectorAssembler(inputCols=features, outputCol="raw", handleInvalid="keep"),
              StandardScaler(inputCol="raw", outputCol="scaled", withStd=True, withMean=False),
              LogisticRegression(featuresCol="scaled", labelCol=label, weightCol="row_weight", maxIter=max_iter, regParam=1e-4,
                                 lowerBoundsOnCoefficients=DenseMatrix(1, len(features), bounds))]
    return Pipeline(stages=stages).fit(_weighted(train, label))


def score_risk(model: PipelineModel, df: DataFrame) -> DataFrame:
    return _with_proba(model.transform(df))


def feature_importances(spark, model: PipelineModel, features: list[str]) -> DataFrame:
    """Importance per feature, a fixed-length list."""
    values = model.stages[-1].featureImportances.toArray().tolist()
    return spark.createDataFrame([(f, float(v)) for f, v in zip(features, values)], "feature string, importance double")


def variant_selection(results: DataFrame, tie: float = 0.005, stable_below: float = 0.5) -> DataFrame:
    """The variant to deploy: among those whose verdicts hold under a price rise, the best
    PR-AUC; within ``tie`` of it a monotone variant is preferred.

    results: variant, monotone, pr_auc, verdicts_changed_pct; one row per variant.
    """
    stable = F.col("verdicts_changed_pct") < stable_below
    any_stable = results.agg(F.max(stable)).scalar()
    pool = results.where(stable | ~any_stable)
    top = pool.agg(F.max("pr_auc")).scalar()
    near = pool.where(F.col("pr_auc") >= top - tie)
    best = keep_first_by(near.withColumn("_one", F.lit(1)), ["_one"],
                         F.struct((~F.col("monotone")).alias("m"), (-F.col("pr_auc")).alias("p"), F.col("variant")))
    return best.drop("_one")


# ---- persistence ------------------------------------------------------------------

def save_cost_model(model: CostModel, path: str, metadata: dict[str, str]) -> None:
    """Pipeline, bands and metadata side by side."""
    model.pipeline.write().overwrite().save(f"{path}/pipeline")
    model.bands.write.mode("overwrite").parquet(f"{path}/bands")
    model.overall.write.mode("overwrite").parquet(f"{path}/overall")
    spark = model.bands.sparkSession
    spark.createDataFrame(list(metadata.items()), "name string, value string").write.mode("overwrite").json(f"{path}/metadata")


def load_cost_model(spark, path: str) -> CostModel:
    return CostModel(PipelineModel.load(f"{path}/pipeline"), spark.read.parquet(f"{path}/bands"),
                     spark.read.parquet(f"{path}/overall"))
