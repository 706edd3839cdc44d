"""Per-key time series: resampling, gap filling, backtests and forecasts.

Series are keyed by state or hub and hold one row per day or week, so a key's
window is as long as the calendar, whatever the number of invoices behind it.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEASON = 52


def daily_fill(prices: DataFrame, start: Column, end: Column, order: str) -> DataFrame:
    """One price per state and day of [start, end]: forward filled, the head back filled.

    Of the rows of one day the last by ``order`` stays; each observation is stretched
    to the day before the next.
    """
    one = prices.groupBy("state", "price_date").agg(F.max_by("diesel_price_per_litre", order).alias("price"))
    w = Window.partitionBy("state").orderBy("price_date")
    first = F.row_number().over(w) == 1
    lo = F.when(first, F.least("price_date", start)).otherwise(F.col("price_date"))
    hi = F.coalesce(F.date_sub(F.lead("price_date").over(w), 1), F.greatest("price_date", end))
    return (one.withColumn("_lo", F.greatest(lo, start)).withColumn("_hi", F.least(hi, end))
            .where("_lo <= _hi")
            .select("state", F.explode(F.sequence("_lo", "_hi")).alias("day"), "price"))


def weekly_resample(weather: DataFrame) -> DataFrame:
    """Hub x week ending Sunday: rain sum (0 for an empty week) and mean temperature."""
    week = F.date_add(F.date_trunc("week", "day").cast("date"), 6)
    sums = weather.groupBy("hub_id", week.alias("week")).agg(
        F.coalesce(F.sum("precip"), F.lit(0.0)).alias("precip"), F.avg("temp").alias("temp"))
    grid = (sums.groupBy("hub_id").agg(F.min("week").alias("lo"), F.max("week").alias("hi"))
            .select("hub_id", F.explode(F.expr("sequence(lo, hi, interval 7 days)")).alias("week")))
    return (grid.join(sums, ["hub_id", "week"], "left")
            .withColumn("precip", F.coalesce("precip", F.lit(0.0))))


def interpolate(df: DataFrame, value: str = "value") -> DataFrame:
    """Linear by position inside gaps, trailing gaps hold, leading gaps are dropped.
    Columns: series, key, date, ``value``."""
    w = Window.partitionBy("series", "key").orderBy("date")
    back = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ahead = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    point = F.when(F.col(value).isNotNull(), F.struct(F.col("pos"), F.col(value).alias("v")))
    marked = (df.withColumn("pos", F.row_number().over(w)).withColumn("_p", point)
              .withColumn("_a", F.last("_p", ignorenulls=True).over(back))
              .withColumn("_b", F.first("_p", ignorenulls=True).over(ahead)))
    between = F.col("_a.v") + (F.col("_b.v") - F.col("_a.v")) * (F.col("pos") - F.col("_a.pos")) / (
        F.col("_b.pos") - F.col("_a.pos"))
    filled = F.coalesce(F.col(value), between, F.col("_a.v"))
    return marked.where(F.col("_a").isNotNull()).select("series", "key", "date", filled.alias(value))


def tail_split(df: DataFrame, test: int, min_length: int) -> DataFrame:
    """Mark the last ``test`` points of each series; series shorter than ``min_length`` are left out."""
    by_key = Window.partitionBy("series", "key")
    return (df.withColumn("length", F.count("*").over(by_key))
            .withColumn("from_end", F.row_number().over(by_key.orderBy(F.desc("date"))))
            .where(F.col("length") >= min_length)
            .withColumn("is_test", F.col("from_end") <= test)
            .withColumn("step", F.when(F.col("is_test"), F.lit(test) - F.col("from_end") + 1)))


def persistence_baseline(split: DataFrame) -> DataFrame:
    """Last training value held over the test points."""
    last = F.max_by(F.when(~F.col("is_test"), F.col("value")), F.when(~F.col("is_test"), F.col("date")))
    return split.withColumn("baseline", last.over(Window.partitionBy("series", "key"))).where("is_test")


def seasonal_naive(split: DataFrame, test: int, season: int = SEASON) -> DataFrame:
    """Value one season earlier; empty for series not longer than season + test."""
    lagged = F.lag("value", season).over(Window.partitionBy("series", "key").orderBy("date"))
    return split.withColumn("baseline", F.when(F.col("length") > season + test, lagged)).where("is_test")


def drift_backtest(split: DataFrame) -> DataFrame:
    """Drift model: last training value plus h mean training steps; baseline is persistence."""
    by_key = Window.partitionBy("series", "key")
    train = F.when(~F.col("is_test"), F.struct("date", "value"))
    first, last = F.min(train).over(by_key), F.max(train).over(by_key)
    steps = F.count(train).over(by_key) - 1
    fitted = split.withColumns({"_f": first, "_l": last, "_n": steps})
    slope = F.coalesce((F.col("_l.value") - F.col("_f.value")) / F.nullif(F.col("_n"), F.lit(0)), F.lit(0.0))
    return (fitted.where("is_test")
            .select("series", "key", "date", "step", "value", F.col("_l.value").alias("baseline"),
                    (F.col("_l.value") + slope * F.col("step")).alias("predicted")))


def seasonal_backtest(split: DataFrame, test: int, season: int = SEASON) -> DataFrame:
    """Seasonal naive corrected by a first-order autoregression on the seasonal difference."""
    w = Window.partitionBy("series", "key")
    ordered = w.orderBy("date")
    lagged = split.withColumn("_s", F.lag("value", season).over(ordered))
    diffs = (lagged.withColumn("_d", F.when(~F.col("is_test"), F.col("value") - F.col("_s")))
             .withColumn("_d1", F.lag("_d").over(ordered)))
    fit = diffs.withColumns({
        "_phi": F.sum(F.col("_d") * F.col("_d1")).over(w)
        / F.nullif(F.sum(F.when(F.col("_d").isNotNull(), F.col("_d1") * F.col("_d1"))).over(w), F.lit(0.0)),
        "_last": F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("date"))).over(w)})
    phi = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_phi", F.lit(0.0))))
    predicted = F.col("_s") + F.coalesce(F.pow(phi, F.col("step")) * F.col("_last"), F.lit(0.0))
    enough = F.col("length") > season + test
    return fit.where("is_test").select("series", "key", "date", "step", "value",
                                       F.when(enough, F.col("_s")).alias("baseline"),
                                       F.when(enough, predicted).alias("predicted"))


def forecast_scores(backtest: DataFrame) -> DataFrame:
    """MAE, RMSE, sMAPE and skill against the baseline per series and key."""
    pair = F.col("value").isNotNull() & F.col("predicted").isNotNull()
    err = F.abs(F.col("predicted") - F.col("value"))
    spread = F.greatest(F.abs("value") + F.abs("predicted"), F.lit(1e-6))
    scores = backtest.where(pair).groupBy("series", "key").agg(
        F.avg(err).alias("mae"), F.sqrt(F.avg(err * err)).alias("rmse"),
        (F.avg(err * 2 / spread) * 100).alias("smape"), F.count("*").alias("n"),
        F.avg(F.abs(F.col("baseline") - F.col("value"))).alias("_base"))
    skill = F.when(F.col("_base") > 1e-9, F.lit(1.0) - F.col("mae") / F.col("_base"))
    return scores.withColumn("skill", skill).drop("_base")


def backtest_summary(scores: DataFrame) -> DataFrame:
    """Median metrics per series over its keys (states or hubs, a bounded list)."""
    return scores.groupBy("series").agg(*[F.median(m).alias(f"median_{m}") for m in ("mae", "smape", "rmse", "skill")],
                                        F.count("*").alias("keys"))


def drift_forecast(df: DataFrame, horizon: int) -> DataFrame:
    """Daily drift forecast of ``horizon`` steps for every key, fitted on the whole series."""
    pt = F.struct("date", "value")
    fit = df.where(F.col("value").isNotNull()).groupBy("series", "key").agg(
        F.min(pt).alias("f"), F.max(pt).alias("l"), F.count("*").alias("n"))
    slope = F.coalesce((F.col("l.value") - F.col("f.value")) / F.nullif(F.col("n") - 1, F.lit(0)), F.lit(0.0))
    return (fit.withColumn("slope", slope).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
            .select("series", "key", F.date_add("l.date", F.col("step")).alias("date"),
                    F.round(F.col("l.value") + F.col("slope") * F.col("step"), 3).alias("forecast")))


def seasonal_forecast(df: DataFrame, horizon: int, season: int = SEASON) -> DataFrame:
    """Weekly forecast: the same week one season ago."""
    if horizon > season:
        raise ValueError("the horizon must not exceed one season")
    ranked = df.withColumn("_back", F.row_number().over(
        Window.partitionBy("series", "key").orderBy(F.desc("date"))))
    return (ranked.where((F.col("_back") <= season) & (F.col("_back") > season - horizon))
            .select("series", "key", F.date_add("date", 7 * season).alias("date"),
                    F.round("value", 3).alias("forecast")))


def seasonal_ar_forecast(df: DataFrame, horizon: int, season: int = SEASON) -> DataFrame:
    """Weekly forecast by the model of ``seasonal_backtest`` fitted on the whole series: the same week one season ago, plus the
    last seasonal difference fading by the autoregression. Series of one season or less get none."""
    if horizon > season:
        raise ValueError("the horizon must not exceed one season")
    w = Window.partitionBy("series", "key")
    ordered = w.orderBy("date")
    diffs = df.withColumn("_d", F.col("value") - F.lag("value", season).over(ordered)).withColumn("_d1", F.lag("_d").over(ordered))
    fit = diffs.withColumns({
        "_phi": F.sum(F.col("_d") * F.col("_d1")).over(w) / F.nullif(F.sum(F.when(F.col("_d").isNotNull(), F.col("_d1") * F.col("_d1"))).over(w), F.lit(0.0)),
        "_last": F.max_by("_d", F.when(F.col("_d").isNotNull(), F.col("date"))).over(w),
        "_step": F.lit(season + 1) - F.row_number().over(w.orderBy(F.desc("date"))), "_n": F.count("*").over(w)})
    phi = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.coalesce("_phi", F.lit(0.0))))
    future = fit.where(F.col("_step").between(1, horizon) & (F.col("_n") > season))
    value = F.col("value") + F.coalesce(F.pow(phi, F.col("_step")) * F.col("_last"), F.lit(0.0))
    return future.select("series", "key", F.date_add("date", 7 * season).alias("date"), value.alias("forecast"))
