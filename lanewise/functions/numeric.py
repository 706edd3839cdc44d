"""Small numeric formulae."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import constants as C


def haversine_km(lat1: Column, lon1: Column, lat2: Column, lon2: Column) -> Column:
    half_lat = F.sin(F.radians(lat2 - lat1) / 2)
    half_lon = F.sin(F.radians(lon2 - lon1) / 2)
    chord = half_lat * half_lat + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * half_lon * half_lon
    return F.lit(2 * C.EARTH_RADIUS_KM) * F.asin(F.sqrt(chord))


def day_points(precip: Column, wind: Column, temp: Column) -> Column:
    """Severity points of one day; a missing reading adds nothing."""
    def points(value, limit, weight):
        return F.when(value > limit, weight).otherwise(0)
    return (points(precip, C.HEAVY_RAIN_MM, C.RAIN_POINTS) + points(wind, C.HIGH_WIND_KMH, C.WIND_POINTS)
            + points(temp, C.HEAT_C, C.HEAT_POINTS))


def severity_score(precip: Column, wind: Column, temp: Column) -> Column:
    """Severity of parallel arrays of daily readings."""
    def above(arr, limit):
        return F.coalesce(F.size(F.filter(arr, lambda x: x > limit)), F.lit(0))
    return (F.lit(C.RAIN_POINTS) * above(precip, C.HEAVY_RAIN_MM)
            + F.lit(C.WIND_POINTS) * above(wind, C.HIGH_WIND_KMH)
            + F.lit(C.HEAT_POINTS) * above(temp, C.HEAT_C))


def laplace_score(flagged: Column, total: Column, cold_start: str = "prior") -> Column:
    """Smoothed flag rate. ``cold_start='zero'`` scores a carrier without history 0."""
    score = (flagged + F.lit(C.SMOOTHING * C.PRIOR_RISK)) / (total + F.lit(C.SMOOTHING))
    if cold_start == "zero":
        return F.when(F.coalesce(total, F.lit(0)) <= 0, F.lit(0.0)).otherwise(score)
    return score


def wilson(k: Column, n: Column, z: float = 1.96) -> tuple[Column, Column]:
    """Wilson score interval of k successes in n trials."""
    rate, z2 = k / n, z * z
    centre = rate + z2 / (n * 2)
    half = F.lit(z) * F.sqrt(rate * (F.lit(1.0) - rate) / n + F.lit(z2) / (n * n * 4.0))
    scale = F.lit(1.0) + F.lit(z2) / n
    empty = n == 0
    return (F.when(empty, 0.0).otherwise((centre - half) / scale),
            F.when(empty, 0.0).otherwise((centre + half) / scale))
