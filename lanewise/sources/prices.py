"""Diesel price files in their several shapes."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PRICE = "diesel_price_per_litre"


#: fixed values: headers of the city export, lower-cased, in the order in which they are looked for
CITY_HEADERS, PRODUCT_HEADERS, DAY_HEADERS = ("metro cities", "city"), ("products", "product"), ("calendar day", "date")
PRICE_HEADERS = ("retail selling price", "price")
DAY_FORMATS = ("yyyy-MM-dd", "d-M-yyyy", "d/M/yyyy", "d-MMM-yyyy", "d MMM yyyy")


def read_day(value: Column) -> Column:
    """A date from text, ISO or day first; NULL when unreadable."""
    return F.coalesce(*[F.try_to_date(F.trim(value.cast("string")), f) for f in DAY_FORMATS])


def load_metro_prices(raw: DataFrame, product: str = "diesel") -> DataFrame:
    """City price list: headers trimmed and found by name or prefix, one product,
    unreadable rows dropped. Result: city, price_date, price."""
    tidy = raw.toDF(*[c.strip() for c in raw.columns])

    def column(starts):
        found = [c for s in starts for c in tidy.columns if c.lower().startswith(s)]
        if not found:
            raise ValueError(f"no column starts with {' or '.join(starts)}: {tidy.columns}")
        return F.col(f"`{found[0]}`")
    return (tidy.where(F.lower(F.trim(column(PRODUCT_HEADERS))) == product)
            .select(F.trim(column(CITY_HEADERS)).alias("city"), read_day(column(DAY_HEADERS)).alias("price_date"),
                    F.trim(column(PRICE_HEADERS).cast("string")).try_cast("double").alias(PRICE))
            .na.drop())


def load_generic_prices(raw: DataFrame, mapping: dict[str, str], city_states: dict[str, str], order: str, source: str = "generic") -> DataFrame:
    """Any price list: ``mapping`` names the region, date and price columns; cities become states,
    unknown regions stay, unreadable rows go; of the rows of one (date, state) the first by
    ``order`` stays. Sorted."""
    states = F.create_map(*[F.lit(x) for kv in city_states.items() for x in kv])
    region = F.trim(mapping["region"])
    rows = raw.select(read_day(F.col(mapping["date"])).alias("price_date"), F.coalesce(F.try_element_at(states, region), region).alias("state"),
                      F.col(mapping["price"]).try_cast("double").alias(PRICE), F.col(order).alias("_order")).na.drop(subset=["price_date", PRICE])
    return (rows.groupBy("price_date", "state").agg(F.min_by(PRICE, "_order").alias(PRICE))
            .withColumn("source", F.lit(source)).orderBy("price_date", "state"))


def state_spread(metro: DataFrame, offsets: DataFrame) -> DataFrame:
    """Prices of states without a metro series: daily metro mean moved by the state's offset
    against the mean metro offset. ``offsets``: state, offset, is_metro; one row per state."""
    # decimal mean: the same whatever order the rows arrive in
    national = metro.groupBy("price_date").agg(F.avg(F.col(PRICE).cast("decimal(12,4)")).cast("double").alias("mean_price"))
    base = offsets.where("is_metro").agg(F.avg("offset"))
    shifts = (offsets.where("NOT is_metro")
              .agg(F.collect_list(F.struct("state", (F.col("offset") - base.scalar()).alias("shift"))))).scalar()
    return (national.select("price_date", "mean_price", F.inline(shifts))
            .select("price_date", "state", F.round(F.col("mean_price") + F.col("shift"), 2).alias(PRICE)))


def union_prices(metro: DataFrame, derived: DataFrame) -> DataFrame:
    """Observed and derived rows with their source."""
    cols = ["price_date", "state", PRICE]
    return (metro.select(*cols, F.lit("metro").alias("source"))
            .unionByName(derived.select(*cols, F.lit("derived").alias("source"))))


def missing_states(needed: DataFrame, prices: DataFrame) -> DataFrame:
    return needed.select("state").distinct().join(prices.select("state").distinct(), "state", "left_anti")


def html_price_table(pages: DataFrame, html: str = "html", keys: list[str] = ("page_id",)) -> DataFrame:
    """(state, price) from table rows of HTML pages: the first dd.dd in the second cell, between
    50 and 200; the first row of a state wins."""
    def plain(cell: Column) -> Column:
        return F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]+>", ""), "&nbsp;", " "))
    rows = pages.select(*keys, F.posexplode(F.regexp_extract_all(F.col(html), F.lit(r"(?s)<tr[^>]*>(.*?)</tr>"), F.lit(1)))
                        .alias("row", "tr"))
    cells = rows.withColumn("td", F.regexp_extract_all("tr", F.lit(r"(?s)<td[^>]*>(.*?)</td>"), F.lit(1)))
    found = F.regexp_extract(plain(F.get("td", F.lit(1))), r"([0-9]{2,3}\.[0-9]{1,2})", 1).try_cast("double")
    priced = (cells.where(F.size("td") >= 2)
              .select(*keys, "row", F.lower(plain(F.get("td", F.lit(0)))).alias("state"), found.alias("price"))
              .where((F.col("price") > 50) & (F.col("price") < 200)))
    return priced.groupBy(*keys, "state").agg(F.min_by("price", "row").alias("price"))
