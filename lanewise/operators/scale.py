"""Building blocks that stay balanced when one key holds a large share of the rows."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise.session import cut_lineage, stored

EARLIER = (Window.unboundedPreceding, -1)


def small_side(df: DataFrame) -> DataFrame:
    """A calendar-like dimension (hub pairs, state x day, hub x day), stored once.

    The stored table's size in bytes is known, so Spark broadcasts it when it is under
    ``spark.sql.autoBroadcastJoinThreshold`` and joins by shuffle when it is not; no rows
    are counted and nothing stays cached.
    """
    return stored(df, "side")


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row per key under a total order.

    ``min(struct)`` combines on the map side, so a key with a huge number of
    copies sends one row per task instead of filling one window partition.
    """
    rest = [c for c in df.columns if c not in keys and c not in order]
    lead = F.struct(*[F.col(c) for c in order], *[F.col(c) for c in rest])
    picked = df.groupBy(*keys).agg(F.min(lead).alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def keep_first_by(df: DataFrame, keys: Sequence[str], order: Column) -> DataFrame:
    """As keep_first, with the order given as one comparable expression."""
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("_first"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in df.columns])


def running_before(df: DataFrame, key: str, day: str, seq: str, measures: dict[str, Column],
                   chunk: int = 1 << 20) -> DataFrame:
    """Per key, the totals of ``measures`` over strictly earlier rows by (day, seq).

    Rows are cut into order-preserving chunks (key, day, seq div chunk). Totals per
    chunk come from a map-side combined aggregate; the long key-wide window runs
    over days, the middle one over the chunks of a day, and only the short last
    one over rows. A carrier with a third of all invoices therefore never sits in
    one task.
    """
    rows = df.withColumn("_chunk", F.floor(F.col(seq) / chunk).cast("bigint"))
    rows = rows.withColumns({f"_m_{n}": c for n, c in measures.items()})
    chunks = rows.groupBy(key, day, "_chunk").agg(*[F.sum(f"_m_{n}").alias(f"_c_{n}") for n in measures])
    days = chunks.groupBy(key, day).agg(*[F.sum(f"_c_{n}").alias(f"_d_{n}") for n in measures])
    by_day = Window.partitionBy(key).orderBy(day).rowsBetween(*EARLIER)
    days = days.select(key, day, *[F.coalesce(F.sum(f"_d_{n}").over(by_day), F.lit(0)).alias(f"_o_{n}")
                                   for n in measures])
    by_chunk = Window.partitionBy(key, day).orderBy("_chunk").rowsBetween(*EARLIER)
    chunks = (chunks.join(days, [key, day])
              .select(key, day, "_chunk",
                      *[(F.col(f"_o_{n}") + F.coalesce(F.sum(f"_c_{n}").over(by_chunk), F.lit(0))).alias(f"_b_{n}")
                        for n in measures]))
    by_row = Window.partitionBy(key, day, "_chunk").orderBy(seq).rowsBetween(*EARLIER)
    out = rows.join(chunks, [key, day, "_chunk"])
    return out.select(*df.columns,
                      *[(F.col(f"_b_{n}") + F.coalesce(F.sum(f"_m_{n}").over(by_row), F.lit(0))).alias(n)
                        for n in measures])


def salted_join(df: DataFrame, right: DataFrame, key: str, spread: str, salts: int = 16) -> DataFrame:
    """Left join on ``key`` where one key may hold a large share of ``df``: its rows go to ``salts`` places by ``spread``, and each row
    of ``right`` (one a key, far fewer than ``df``) to all of them. Rows without a key find nothing."""
    tagged = df.withColumn("_salt", F.pmod(F.xxhash64(spread), F.lit(salts)).cast("int"))
    copies = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return tagged.join(copies, [key, "_salt"], "left").drop("_salt")


WINDOW_ROWS = 1 << 20      # rows that one window sorts, about


def running_total(df: DataFrame, order: str, measures: Sequence[str], by: Sequence[str] = (), descending: bool = True,
                  window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Inclusive running totals over the whole table, or each ``by`` group, along ``order``.

    ``order`` must be distinct per group. Two levels: the rows are dealt to sampled ranges of (by, order), as many as make about
    ``window_rows`` each, and stored; the totals of the ranges are added up in one small window, the rows of each range in a window of their
    own. The longest window is a range, or the list of ranges.
    """
    def along(c):
        return F.desc(c) if descending else F.asc(c)
    rows = stored(df, "totals")
    ranges = -(-rows.count() // window_rows)
    names = [f"cum_{m}" for m in measures]
    if ranges <= 1:
        upto = Window.partitionBy(*by).orderBy(along(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return rows.select(*df.columns, *[F.sum(m).over(upto).alias(c) for m, c in zip(measures, names)])
    dealt = stored(rows.repartitionByRange(ranges, *by, along(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy(*by, "_range").agg(*[F.sum(m).alias(f"_t_{m}") for m in measures])
    above = Window.partitionBy(*by).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*by, "_range", *[F.coalesce(F.sum(f"_t_{m}").over(above), F.lit(0)).alias(f"_a_{m}") for m in measures])
    inside = Window.partitionBy(*by, "_range").orderBy(along(order)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (dealt.join(small_side(totals), [*by, "_range"])
            .select(*df.columns, *[(F.col(f"_a_{m}") + F.sum(m).over(inside)).alias(c) for m, c in zip(measures, names)]))


def exact_percentiles(df: DataFrame, value: str, fractions: dict[str, float],
                      keys: Sequence[str] = (), slack: float = 2e-4, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Exact linearly interpolated percentiles without holding a group in one task.

    The built-in ``percentile`` keeps every distinct value of a group in one
    buffer. Here a mergeable sketch brackets each requested rank, one pass counts
    what lies below the bracket, and only the values inside it are ranked, by running totals over sampled ranges of them.
    ``fractions`` maps output column -> fraction.
    """
    accuracy = int(4 / slack)
    # two passes over a narrow table; checkpointed, so that what produced it runs once
    rows = cut_lineage(df.where(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_v")))
    bounds = [b for p in fractions.values() for b in (max(0.0, p - slack), min(1.0, p + slack))]
    sketch = rows.groupBy(*keys).agg(F.count("*").alias("_n"),
                                     F.percentile_approx("_v", bounds, accuracy).alias("_q"))
    if keys:
        tagged = rows.join(small_side(sketch), list(keys))
    else:
        one = sketch.select(F.struct("_n", "_q").alias("s"))
        tagged = rows.withColumn("_s", one.scalar()).select("_v", "_s._n", "_s._q")

    names = list(fractions)
    targets = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(float(fractions[n])).alias("p"),
                                 F.col("_q")[2 * i].alias("lo"), F.col("_q")[2 * i + 1].alias("hi"))
                        for i, n in enumerate(names)])
    # Everything outside a bracket collapses to two counters and two neighbours
    # before the shuffle; values inside it collapse to (value, count).
    placed = tagged.select(*keys, "_n", "_v", F.explode(targets).alias("_t"))
    inside = (F.col("_v") >= F.col("_t.lo")) & (F.col("_v") <= F.col("_t.hi"))
    side = F.when(inside, F.col("_v"))
    pieces = (placed.groupBy(*keys, F.col("_t.name").alias("_name"), F.col("_t.p").alias("_p"),
                             side.alias("_x"), (F.col("_v") < F.col("_t.lo")).alias("_under"))
              .agg(F.count("*").alias("_c"), F.min("_v").alias("_min"), F.max("_v").alias("_max"),
                   F.max("_n").alias("_n")))
    grp = [*keys, "_name", "_p"]
    # sort value: the block under the bracket ranks first, the block over it last
    at = F.when(F.col("_x").isNotNull(), F.col("_x")).when(F.col("_under"), F.col("_max")).otherwise(F.col("_min"))
    ranked = running_total(pieces.withColumn("_at", at), "_at", ["_c"], grp, False, window_rows).withColumnRenamed("cum__c", "_end")
    spot = F.col("_p") * (F.col("_n") - 1)
    low_rank, high_rank = F.floor(spot), F.ceil(spot)
    start = F.col("_end") - F.col("_c")

    def value_at(rank):
        # of the block below only the largest value can be asked for, of the block above the smallest
        return F.max(F.when((start <= rank) & (rank < F.col("_end")), F.col("_at")))

    picked = ranked.groupBy(*grp).agg(value_at(low_rank).alias("_lo"), value_at(high_rank).alias("_hi"),
                                      F.max(spot - low_rank).alias("_w"))
    result = F.col("_lo") + (F.col("_hi") - F.col("_lo")) * F.col("_w")
    return (picked.groupBy(*keys)
            .agg(*[F.max(F.when(F.col("_name") == n, result)).alias(n) for n in names]))
