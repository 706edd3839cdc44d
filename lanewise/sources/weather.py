"""Weekly weather cache rows <-> daily rows."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lanewise.operators.scale import keep_first_by

READINGS = {"precip": "precipitation_sum_json", "wind": "windspeed_max_json", "temp": "temperature_max_json"}


def weather_explode(cache: DataFrame) -> DataFrame:
    """Weekly JSON arrays -> one row per (hub, day). Days beyond the arrays or the window are
    dropped; overlapping weeks keep the row fetched last."""
    arrays = cache.select(
        F.substring_index("route_key", "-", -1).alias("hub_id"), "window_start", "window_end", "api_call_timestamp",
        *[F.from_json(col, "array<double>").alias(n) for n, col in READINGS.items()])
    days = (arrays.select("hub_id", "window_start", "window_end", "api_call_timestamp", "wind", "temp",
                          F.posexplode("precip").alias("i", "precip"))
            .withColumn("day", F.date_add("window_start", F.col("i"))).where("day <= window_end")
            .select("hub_id", "day", "precip", F.get("wind", F.col("i")).alias("wind"), F.get("temp", F.col("i")).alias("temp"),
                    "api_call_timestamp", "window_start"))
    # latest call first, then the later window; unix_micros turns the order around
    newest = F.struct((-F.unix_micros("api_call_timestamp")).alias("t"), (-F.unix_date("window_start")).alias("w"))
    return keep_first_by(days, ["hub_id", "day"], newest).select("hub_id", "day", "precip", "wind", "temp")


def weather_pack(daily: DataFrame) -> DataFrame:
    """Daily rows -> one row per hub and ISO week with ordered JSON arrays; nulls keep their place.
    A group is one week, so at most seven rows are collected."""
    rows = F.array_sort(F.collect_list(F.struct("day", *READINGS)))
    packed = daily.groupBy("hub_id", F.extract(F.lit("YEAROFWEEK"), "day").alias("iso_year"),
                           F.weekofyear("day").alias("iso_week")).agg(rows.alias("d"))
    return packed.select(
        "hub_id", "iso_year", "iso_week", F.concat(F.lit("HUB-"), "hub_id").alias("route_key"),
        F.col("d")[0]["day"].alias("window_start"), F.get("d", F.size("d") - 1)["day"].alias("window_end"),
        *[F.to_json(F.col("d")[n]).alias(col) for n, col in READINGS.items()])
