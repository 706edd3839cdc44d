"""Registry of comparison queries: key -> Spark job over the freight view, and its SQL twin."""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lanewise.plans.freight_view import FreightView
from lanewise.plans.oracle import with_view

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def op(key: str, sql: str | None = None, r: str = ""):
    """Register ``fn(view) -> DataFrame``. ``r`` lists columns rounded on both sides as
    ``name`` (6 digits) or ``name:digits``, to absorb the order of floating-point sums.
    floor(x * 10^d + 0.5) is used because the engines' own round() differ on ties."""
    digits = {n: int(d or 6) for n, _, d in (x.partition(":") for x in r.split())}

    def wrap(fn):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            df = fn(FreightView(spark, folder))
            return df.withColumns({n: F.floor(F.col(n) * 10.0 ** d + 0.5) / 10.0 ** d for n, d in digits.items()}) if digits else df
        run.__doc__ = fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            body = sql
            if digits:
                rounded = ", ".join(f"floor({n}::DOUBLE * 1e{d}::DOUBLE + 0.5::DOUBLE) / 1e{d}::DOUBLE AS {n}" for n, d in digits.items())
                body = f"SELECT * REPLACE ({rounded}) FROM ({sql})"
            ORACLES[key] = with_view(body)
        return fn
    return wrap
