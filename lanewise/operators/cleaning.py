"""Cleaning of raw orders and invoices."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import dates
from lanewise.operators.scale import keep_first
from lanewise.session import stored


def clean_invoices(raw: DataFrame, order: Sequence[str]) -> DataFrame:
    """First submission per invoice, upper-case carrier, positive bills; in that order."""
    return valid_invoices(keep_first(raw, ["invoice_id"], order))


def valid_invoices(first: DataFrame) -> DataFrame:
    """Upper-case carrier and positive bills of first submissions."""
    return first.withColumn("vendor_id", F.upper("vendor_id")).where(F.col("actual_billed_amount") > 0)


def dimensional_weight(length: Column, width: Column, height: Column) -> Column:
    return length * width * height / F.lit(C.VOLUMETRIC_DIVISOR)


def assign_truck(weight: Column, limits: tuple[float, float] = C.TRUCK_LIMITS_KG) -> Column:
    """Smallest truck that takes the gross weight."""
    return (F.when(weight <= limits[0], "6-wheeler").when(weight <= limits[1], "10-wheeler")
            .otherwise("12-wheeler"))


def add_weights(orders: DataFrame) -> DataFrame:
    """Dimensional and billable weight and the truck."""
    return (orders
            .withColumn("dimensional_weight_kg",
                        dimensional_weight(F.col("length_cm"), F.col("width_cm"), F.col("height_cm")))
            .withColumn("billable_weight_kg", F.greatest("weight_kg", "dimensional_weight_kg"))
            .withColumn("truck_type", assign_truck(F.col("weight_kg"))))


def month_medians(counts: DataFrame, value: str) -> DataFrame:
    return (counts.where(F.col("month").isNotNull())
            .groupBy("month").agg(F.percentile(value, 0.5, F.col("n")).alias("month_median")))


def month_median_impute(orders: DataFrame, value: str = "expected_weather_score") -> DataFrame:
    """Missing score -> median of its calendar month across years -> overall median.

    Scores are small whole numbers, so the orders collapse to a short (month, score,
    count) table; both medians come from it. The orders are stored first, so what made them runs once.
    """
    month = F.month("order_date")
    orders = stored(orders, "scored-orders")
    counts = orders.where(F.col(value).isNotNull()).groupBy(month.alias("month"), value).agg(F.count("*").alias("n"))
    overall = counts.agg(F.percentile(value, 0.5, F.col("n")))
    return (orders.withColumn("month", month).join(F.broadcast(month_medians(counts, value)), "month", "left")    # 12 rows
            .withColumn(value, F.coalesce(F.col(value), F.col("month_median"), overall.scalar()))
            .drop("month", "month_median"))


def clean_orders(raw: DataFrame) -> DataFrame:
    """Typed dates, grams back to kilograms, recomputed weights and truck, imputed weather."""
    grams = F.col("weight_kg") > C.GRAMS_ENTERED_ABOVE
    fixed = (raw.withColumn("order_date", dates.parse_order_date(F.col("order_date")))
             .withColumn("weight_kg", F.when(grams, F.round(F.col("weight_kg") / 1000, 1))
                         .otherwise(F.col("weight_kg"))))
    return month_median_impute(add_weights(fixed))
