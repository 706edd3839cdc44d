"""Joins that enrich orders and invoices: routes, diesel, weather, master data.

Routes, hubs, the state x day price calendar and the hub x day weather calendar do
not grow with the number of invoices. They are broadcast after a size check, so
the orders are not shuffled for any of these lookups.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import dates, numeric
from lanewise.operators.cleaning import assign_truck
from lanewise.operators.scale import keep_first_by, salted_join, small_side


# ---- routes ---------------------------------------------------------------------

def hub_pairs(hubs: DataFrame) -> DataFrame:
    """Every unordered pair of hubs, by rank arithmetic and an equi join.

    The pairs are quadratic in the hub list by nature; ``route_build`` makes only those that
    orders use.
    """
    ids = hubs.select("hub_id", "city", "state", "latitude", "longitude")
    ranked = ids.withColumn("rank", F.row_number().over(Window.orderBy("hub_id")))
    n = ids.agg(F.count("*").cast("int")).scalar()
    left = ranked.select(*[F.col(c).alias(f"a_{c}") for c in ranked.columns],
                         F.explode(F.when(F.col("rank") < n, F.sequence(F.col("rank") + 1, n))).alias("other"))
    right = ranked.select(*[F.col(c).alias(f"b_{c}") for c in ranked.columns])
    return left.join(right, F.col("other") == F.col("b_rank")).drop("other", "a_rank", "b_rank")


def used_pairs(hubs: DataFrame, orders: DataFrame) -> DataFrame:
    """The pairs of hubs that orders run between, whichever way round, with both hubs' places."""
    pairs = (orders.select(F.least("origin_hub_id", "dest_hub_id").alias("a_hub_id"), F.greatest("origin_hub_id", "dest_hub_id").alias("b_hub_id"))
             .where("a_hub_id < b_hub_id").distinct())
    for side in "ab":
        pairs = pairs.join(hubs.select(*[F.col(c).alias(f"{side}_{c}") for c in ("hub_id", "city", "state", "latitude", "longitude")]), f"{side}_hub_id")
    return pairs


def route_build(hubs: DataFrame, circuity: float = C.CIRCUITY, orders: DataFrame | None = None) -> DataFrame:
    """Road distance and ideal days per hub pair, of all pairs or those of ``orders``; impossible distances are dropped."""
    crow = numeric.haversine_km(F.col("a_latitude"), F.col("a_longitude"), F.col("b_latitude"), F.col("b_longitude"))
    return ((hub_pairs(hubs) if orders is None else used_pairs(hubs, orders)).withColumn("crow_km", crow)
            .withColumn("distance_km", F.round(F.col("crow_km") * circuity, 1))
            .where((F.col("distance_km") >= 1) & (F.col("distance_km") >= F.col("crow_km")))
            .select(F.col("a_hub_id").alias("origin_hub_id"), F.col("b_hub_id").alias("dest_hub_id"), "distance_km",
                    F.round(F.greatest(F.lit(C.MIN_IDEAL_DAYS), F.col("distance_km") / C.KM_PER_IDEAL_DAY), 2)
                    .alias("ideal_days")))


def route_lookup(df: DataFrame, routes: DataFrame, origin: str = "origin_hub_id",
                 dest: str = "dest_hub_id") -> DataFrame:
    """Distance and ideal days whichever way round the pair is stored; NULL when unknown. ``routes`` is a stored table, so
    Spark knows its size."""
    table = routes.select(F.least("origin_hub_id", "dest_hub_id").alias("_a"), F.greatest("origin_hub_id", "dest_hub_id").alias("_b"),
                          "distance_km", "ideal_days")
    both = F.col(origin).isNotNull() & F.col(dest).isNotNull()
    return (df.withColumn("_a", F.when(both, F.least(origin, dest))).withColumn("_b", F.when(both, F.greatest(origin, dest)))
            .join(table, ["_a", "_b"], "left").drop("_a", "_b"))


def route_lookup_directed(df: DataFrame, routes: DataFrame) -> DataFrame:
    """Lookup of the stored direction only."""
    table = routes.select("origin_hub_id", "dest_hub_id", "distance_km", "ideal_days")
    return df.join(table, ["origin_hub_id", "dest_hub_id"], "left")


def hub_attributes(df: DataFrame, hubs: DataFrame) -> DataFrame:
    """Origin and destination city and state."""
    for side in ("origin", "dest"):
        # a hub list read from a file is broadcast by its file size, without a hint
        table = hubs.select(F.col("hub_id").alias(f"{side}_hub_id"), F.col("city").alias(f"{side}_city"),
                            F.col("state").alias(f"{side}_state"))
        df = df.join(table, f"{side}_hub_id", "left")
    return df


GRAM = 3


def _grams(text: Column, sizes: list[int]) -> Column:
    """Distinct runs of ``sizes`` characters. The text is cut into characters once, so the work is linear in its length."""
    chars = F.split(text, "")

    def run(size):
        out = chars
        for k in range(1, size):
            out = F.zip_with(out, F.slice(chars, F.lit(k + 1), F.size(chars)), lambda x, y: F.concat(x, F.coalesce(y, F.lit(""))))
        return out
    return F.array_distinct(F.flatten(F.array(*[run(s) for s in sizes]))) if sizes else F.array().cast("array<string>")


def city_to_hub(df: DataFrame, hubs: DataFrame, city: str) -> DataFrame:
    """Hub of a free-text place: exact city or hub id first, else the first hub whose
    city contains the text or is contained in it.

    Containment goes through an index of hub names by runs of GRAM characters: a text that contains a name has the run the name
    begins with, a text inside a name begins with a run of the name. Candidates are verified. Distinct spellings take part once,
    with one row for each character at most; rows without a place do not take part.
    """
    listed = hubs.select(F.struct("hub_id", F.lower(F.trim("city")).alias("city"), "state").alias("hub"))
    places = df.select(F.lower(F.trim(city)).alias("text")).where("text <> ''").distinct()
    exact = (places.join(listed.select("hub", F.explode(F.array_distinct(F.array("hub.city", F.lower("hub.hub_id")))).alias("text")), "text")
             .groupBy("text").agg(F.min("hub").alias("exact")))
    named = listed.where("hub.city <> ''")
    heads = named.select("hub", F.substring("hub.city", 1, GRAM).alias("gram"))
    # names shorter than a run are their own run; at most GRAM sizes
    sizes = sorted(r[0] for r in heads.select(F.char_length("gram")).distinct().collect())
    inside = places.select("text", F.explode(_grams(F.col("text"), sizes)).alias("gram")).join(heads, "gram").where(F.col("text").contains(F.col("hub.city")))
    begins = places.select("text", F.substring("text", 1, GRAM).alias("gram"))
    runs = named.select("hub", F.explode(_grams(F.col("hub.city"), list(range(1, GRAM + 1)))).alias("gram"))
    around = begins.join(runs, "gram").where(F.col("hub.city").contains(F.col("text")))
    partial = inside.select("text", "hub").unionByName(around.select("text", "hub")).groupBy("text").agg(F.min("hub").alias("partial"))
    found = (places.join(exact, "text", "left").join(partial, "text", "left").withColumn("_hub", F.coalesce("exact", "partial"))
             .select(F.col("text").alias("_text"), F.col("_hub.hub_id").alias(f"{city}_hub_id"), F.col("_hub.state").alias(f"{city}_state")))
    # a row without a place gets a key of its own, so that all of them do not meet in one task
    key = F.coalesce(F.nullif(F.lower(F.trim(city)), F.lit("")), F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string")))
    return df.withColumn("_text", key).join(found, "_text", "left").drop("_text")


# ---- diesel ---------------------------------------------------------------------

def price_calendar(prices: DataFrame, tolerance: int | None = C.FUEL_TOLERANCE_DAYS) -> DataFrame:
    """Price in force per (state, day): each observation is stretched up to the next one,
    at most ``tolerance`` days (inclusive)."""
    next_date = F.lead("price_date").over(Window.partitionBy("state").orderBy("price_date"))
    last = F.date_sub(F.coalesce(next_date, F.date_add("price_date", (tolerance or 0) + 1)), 1)
    if tolerance is not None:
        last = F.least(last, F.date_add("price_date", tolerance))
    return (prices.withColumn("_last", last)
            .select("state", F.explode(F.sequence("price_date", "_last")).alias("day"),
                    F.col("diesel_price_per_litre").alias("price"), "price_date"))


def asof_fuel(df: DataFrame, prices: DataFrame, state: str = "state", day: str = "order_date",
              tolerance: int = C.FUEL_TOLERANCE_DAYS) -> DataFrame:
    """Backward as-of join by state, as an equi join on the price calendar."""
    table = small_side(price_calendar(prices, tolerance).select(
        F.col("state").alias(state), F.col("day").alias(day), F.col("price").alias("asof_price"),
        F.col("price_date").alias("asof_date")))
    return df.join(table, [state, day], "left")


def national_daily_median(prices: DataFrame) -> DataFrame:
    """Median over states per day; a day never holds more prices than there are states."""
    return (prices.groupBy("price_date").agg(F.median("diesel_price_per_litre").alias("median_price")))


def fuel_fallback(df: DataFrame, prices: DataFrame, day: str = "order_date") -> DataFrame:
    """Unmatched as-of price -> national median of the day -> median of daily medians."""
    medians = national_daily_median(prices)
    overall = medians.agg(F.median("median_price"))
    table = small_side(medians.select(F.col("price_date").alias(day), "median_price"))
    return (df.join(table, day, "left")
            .withColumn("expected_fuel_price", F.coalesce("asof_price", "median_price", overall.scalar()))
            .drop("median_price"))


def latest_per_state(prices: DataFrame) -> DataFrame:
    return prices.groupBy("state").agg(F.max("price_date").alias("price_date"),
                                       F.max_by("diesel_price_per_litre", "price_date").alias("last_price"))


def carry_forward_price(prices: DataFrame, current: DataFrame) -> DataFrame:
    """Price today for every cached state: listed price, else the state's last price moved by
    the mean change of the states that are both in today's list and priced on the last day.

    ``current`` has state and price. All tables here hold one row per state.
    """
    last_day = prices.agg(F.max("price_date"))
    last = (prices.where(F.col("price_date") == last_day.scalar()).select("state", "diesel_price_per_litre")
            .join(current, "state"))
    change = last.agg(F.avg("price") - F.avg("diesel_price_per_litre"))
    return (latest_per_state(prices).join(current, "state", "left")
            .select("state", "last_price", F.col("price").alias("listed_price"),
                    F.coalesce("price", F.round(F.col("last_price") + change.scalar(), 2)).alias("price_today")))


def fuel_resolve(df: DataFrame, prices: DataFrame, current: DataFrame | None = None,
                 forecast: DataFrame | None = None, offsets: dict[str, float] | None = None,
                 state: str = "state", day: str = "order_date") -> DataFrame:
    """Price and source label for any date: cache (exact or earlier) up to the cache end,
    then today's list, its carry-forward, the forecast of that day, the last cached price,
    and finally a base price plus the state's offset."""
    cache_end = prices.agg(F.max("price_date"))
    # stretch the last observation of each state to the end of the cache
    calendar = price_calendar(prices.select("state", "price_date", "diesel_price_per_litre"), None)
    tail = (latest_per_state(prices).where(F.col("price_date") < cache_end.scalar())
            .select("state", F.explode(F.sequence(F.date_add("price_date", 1), cache_end.scalar())).alias("day"),
                    F.col("last_price").alias("price")))
    cached = calendar.select("state", "day", "price").unionByName(tail)
    df = df.join(small_side(cached.select(F.col("state").alias(state), F.col("day").alias(day),
                                          F.col("price").alias("_cached"))), [state, day], "left")
    sources = [("cache", F.col("_cached"))]
    per_state = latest_per_state(prices).select("state", "last_price")
    if current is not None:
        per_state = carry_forward_price(prices, current)
        sources += [("listed", F.col("listed_price")), ("carry_forward", F.col("price_today"))]
    df = df.join(small_side(per_state.withColumnRenamed("state", state)), state, "left")
    if forecast is not None:
        last_forecast = forecast.groupBy("state").agg(F.max_by("forecast", "day").alias("_fc_last"))
        df = (df.join(small_side(forecast.select(F.col("state").alias(state), F.col("day").alias(day),
                                                 F.col("forecast").alias("_fc"))), [state, day], "left")
              .join(small_side(last_forecast.withColumnRenamed("state", state)), state, "left"))
        sources += [("forecast", F.col("_fc")), ("last_forecast", F.col("_fc_last"))]
    offset = F.create_map(*[F.lit(x) for kv in (offsets or {"": 0.0}).items() for x in kv])
    base = F.lit(C.OFFSET_BASE_DIESEL) + F.coalesce(F.try_element_at(offset, F.coalesce(F.col(state), F.lit(""))),
                                                    F.lit(C.DEFAULT_STATE_OFFSET))
    sources += [("last_cached", F.col("last_price")), ("offset", F.round(base, 2))]
    label = F.coalesce(*[F.when(c.isNotNull(), name) for name, c in sources])
    out = df.withColumns({"fuel_price": F.coalesce(*[c for _, c in sources]), "fuel_source": label})
    return out.drop("_cached", "last_price", "listed_price", "price_today", "_fc", "_fc_last")


# ---- weather --------------------------------------------------------------------

@dataclass
class WeatherTotals:
    """Running totals per hub and day, and the first and last day of each hub: stored once, used by every window lookup."""
    totals: DataFrame
    span: DataFrame


def weather_totals(weather: DataFrame) -> WeatherTotals:
    span = weather.groupBy("hub_id").agg(F.min("day").alias("lo"), F.max("day").alias("hi"))
    grid = span.select("hub_id", F.explode(F.sequence(F.date_sub("lo", 1), F.col("hi"))).alias("day"))
    upto = Window.partitionBy("hub_id").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    daily = weather.select("hub_id", "day", numeric.day_points(F.col("precip"), F.col("wind"), F.col("temp")).alias("pts"),
                           F.when(F.col("precip") > C.HEAVY_RAIN_MM, 1).otherwise(0).alias("wet"), F.lit(1).alias("seen"))
    totals = small_side(grid.join(daily, ["hub_id", "day"], "left")
                        .select("hub_id", "day", *[F.sum(F.coalesce(F.col(c), F.lit(0))).over(upto).alias(c) for c in ("pts", "wet", "seen")]))
    # the stored totals begin a day before the hub's series
    return WeatherTotals(totals, totals.groupBy("hub_id").agg(F.date_add(F.min("day"), 1).alias("lo"), F.max("day").alias("hi")))


def weather_window(df: DataFrame, weather: DataFrame | WeatherTotals, hub: str = "dest_hub_id", start: str = "window_start",
                   end: str = "window_end") -> DataFrame:
    """Severity score, adverse days and covered days over an inclusive window.

    All three are sums over days, so a running total per hub and two equi lookups
    (day before the start, end) replace the range join and the regrouping of orders.
    """
    day = F.col("day")
    known = weather if isinstance(weather, WeatherTotals) else weather_totals(weather)
    totals, bounds = known.totals, known.span

    def at(prefix, on):
        return totals.select(F.col("hub_id").alias(hub), day.alias(on), *[F.col(c).alias(f"{prefix}_{c}")
                                                                        for c in ("pts", "wet", "seen")])
    # dates outside the hub's series are pulled to its edges
    out = (df.join(bounds.withColumnRenamed("hub_id", hub), hub, "left")
           .withColumn("_to", F.least(F.col(end), F.col("hi")))
           .withColumn("_from", F.greatest(F.date_sub(F.col(start), 1), F.date_sub("lo", 1)))
           .withColumn("_to", F.greatest("_to", "_from"))
           .join(at("e", "_to"), [hub, "_to"], "left").join(at("s", "_from"), [hub, "_from"], "left"))

    def diff(c):
        return F.coalesce(F.col(f"e_{c}") - F.col(f"s_{c}"), F.lit(0))
    return out.select(*df.columns, diff("pts").alias("weather_score"), diff("wet").alias("adverse_weather_days"),
                      diff("seen").alias("covered_days"))


def weather_summary(df: DataFrame, weather: DataFrame, hub: str = "dest_hub_id", start: str = "window_start",
                    end: str = "window_end") -> DataFrame:
    """Score, adverse days, total rain, strongest wind, highest temperature and day count.

    Extremes cannot be subtracted, so each distinct (hub, start, end) window is
    expanded once (at most 46 days) and shared by all orders that use it.
    """
    key = [hub, start, end]
    windows = df.select(*key).where(F.col(start) <= F.col(end)).distinct()
    days = windows.select(*key, F.explode(F.sequence(F.col(start), F.col(end))).alias("day"))
    readings = small_side(weather.select(F.col("hub_id").alias(hub), "day", "precip", "wind", "temp"))
    wet = F.col("precip") > C.HEAVY_RAIN_MM
    per_window = (days.join(readings, [hub, "day"]).groupBy(*key).agg(
        F.sum(numeric.day_points(F.col("precip"), F.col("wind"), F.col("temp"))).alias("weather_score"),
        F.count_if(wet).alias("adverse_weather_days"),
        F.round(F.coalesce(F.sum("precip"), F.lit(0.0)), 1).alias("rain_mm_total"),
        F.max("wind").alias("max_wind_kmh"), F.max("temp").alias("max_temp_c"), F.count("*").alias("days")))
    return df.join(per_window, key, "left")


def weather_resolve(requests: DataFrame, observed: DataFrame, forecast: DataFrame, today: Column) -> DataFrame:
    """Reading per (hub, day) with its source: settled observation, forecast, or the same
    date last year; 29 February has no counterpart and stays empty."""
    settled, horizon = F.date_sub(today, 6), F.date_add(today, 15)
    cols = ["precip", "wind", "temp"]

    def table(df, prefix, day="day"):
        return small_side(df.select("hub_id", F.col("day").alias(day), F.struct(*cols).alias(prefix)))
    leap = (F.month("day") == 2) & (F.dayofmonth("day") == 29)
    asked = requests.withColumn("last_year", F.when(~leap, F.add_months("day", -12)))
    joined = (asked.join(table(observed, "o"), ["hub_id", "day"], "left")
              .join(table(forecast, "f"), ["hub_id", "day"], "left")
              .join(table(observed, "y", "last_year"), ["hub_id", "last_year"], "left"))
    day = F.col("day")
    choice = [("observed", F.when(day <= settled, F.col("o"))),
              ("forecast", F.when((day > settled) & (day <= horizon), F.col("f"))),
              ("last_year", F.when(day > horizon, F.col("y")))]
    picked = F.coalesce(*[c for _, c in choice])
    label = F.coalesce(*[F.when(c.isNotNull(), n) for n, c in choice])
    return joined.withColumn("_w", picked).select(*requests.columns, *[F.col(f"_w.{c}").alias(c) for c in cols],
                                                  label.alias("weather_source"))


def weather_from_forecast(df: DataFrame, weekly_rain: DataFrame, weather: DataFrame, first_forecast: Column,
                          hub: str = "dest_hub_id", start: str = "window_start", end: str = "window_end") -> DataFrame:
    """Future windows: forecast weekly rain dated inside the window, over 20 mm counts as one
    adverse day of severity 2. Other windows: the historical score, else zero."""
    key = [hub, start, end]
    future = df.select(*key).where(F.col(start) >= first_forecast).distinct()
    days = future.select(*key, F.explode(F.sequence(F.col(start), F.col(end))).alias("day"))
    rain = small_side(weekly_rain.select(F.col("hub_id").alias(hub), "day", "precip"))
    sums = days.join(rain, [hub, "day"]).groupBy(*key).agg(F.sum("precip").alias("_rain"))
    past = weather_window(df, weather, hub, start, end).join(sums, key, "left")
    wet = F.col("_rain") > C.HEAVY_RAIN_MM
    known = F.col("_rain").isNotNull()
    return past.select(
        *df.columns,
        F.when(known, F.when(wet, 2).otherwise(0)).otherwise(F.col("weather_score")).alias("weather_score"),
        F.when(known, F.when(wet, 1).otherwise(0)).otherwise(F.col("adverse_weather_days")).alias("adverse_weather_days"),
        F.when(known, "forecast").when(F.col("covered_days") > 0, "history").otherwise("default").alias("weather_source"))


# ---- orders, vendors, invoices ----------------------------------------------------

def add_existence(df: DataFrame, orders: DataFrame, vendors: DataFrame) -> DataFrame:
    """Flags order_known and vendor_known; both key lists are reduced to their distinct keys. A carrier may have a third of all
    invoices, so that join is salted by the order."""
    o = orders.select("order_id").distinct().withColumn("order_known", F.lit(True))
    v = vendors.select("vendor_id").distinct().withColumn("vendor_known", F.lit(True))
    return salted_join(df.join(o, "order_id", "left"), v, "vendor_id", "order_id").fillna(False, ["order_known", "vendor_known"])


def orphan_invoices(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    return invoices.join(orders.select("order_id"), "order_id", "left_anti")


def carrier_mismatch(invoices: DataFrame, orders: DataFrame) -> DataFrame:
    """Invoices whose order was booked with another carrier."""
    booked = orders.select("order_id", F.col("vendor_id").alias("booked_vendor_id"))
    return invoices.join(booked, "order_id").where(F.col("booked_vendor_id") != F.col("vendor_id"))


def order_enrich(invoices: DataFrame, orders: DataFrame, columns: list[str]) -> DataFrame:
    """Invoice with its order's attributes; order_found tells the two cases apart."""
    right = orders.select("order_id", *columns, F.lit(True).alias("order_found"))
    return invoices.join(right, "order_id", "left").fillna(False, ["order_found"])


def reference_context(df: DataFrame, reference: DataFrame) -> DataFrame:
    """Adverse days and padding of the first reference invoice of each order."""
    first = keep_first_by(reference.select("order_id", "invoice_id", "adverse_weather_days", "vendor_padding_ratio"),
                          ["order_id"], F.col("invoice_id"))
    right = first.select("order_id", F.col("adverse_weather_days").alias("ref_adverse_days"),
                         F.col("vendor_padding_ratio").alias("ref_padding"), F.lit(True).alias("from_reference"))
    return df.join(right, "order_id", "left").fillna(False, ["from_reference"])


def coalesce_context(df: DataFrame) -> DataFrame:
    """Order price -> as-of price -> default; missing weather score is 0; adverse days from
    the reference row, else measured, else 0, with a source label."""
    price = F.when(~F.isnan("expected_fuel_price"), F.col("expected_fuel_price"))
    ref = F.when(F.col("from_reference"), F.col("ref_adverse_days"))
    measured = F.when(F.col("covered_days") > 0, F.col("adverse_weather_days"))
    return df.withColumns({
        "expected_fuel_price": F.coalesce(price, F.col("asof_price"), F.lit(C.FALLBACK_DIESEL)),
        "expected_weather_score": F.coalesce(F.when(~F.isnan("expected_weather_score"), F.col("expected_weather_score")),
                                             F.lit(0.0)),
        "adverse_weather_days": F.coalesce(ref, measured, F.lit(0)),
        "adverse_weather_source": F.when(F.col("from_reference"), "reference")
        .when(measured.isNotNull(), "measured").otherwise("default")})


def estimate_missing_order(df: DataFrame, hubs: DataFrame, routes: DataFrame) -> DataFrame:
    """Order attributes guessed from the invoice itself, for orders the master data lacks.

    Input: typed invoice fields origin, destination, toll, actual_days, weight_kg,
    truck_type, product_category. Adds est_* columns.
    """
    df = city_to_hub(city_to_hub(df, hubs, "origin"), hubs, "destination")
    df = _route_between(df, routes)
    days = F.coalesce(F.nullif(F.col("actual_days"), F.lit(0.0)), F.lit(1.0))
    toll = F.coalesce("toll", F.lit(0.0))
    guessed = F.when(toll > 100, F.round(toll / C.TOLL_RATE_PER_KM, 1)).otherwise(
        F.round(F.greatest(F.lit(100.0), days * 350.0), 1))
    df = df.withColumn("est_distance_km", F.coalesce(F.when(F.col("_route_km") > 0, F.col("_route_km")), guessed))
    ideal = F.coalesce(F.when(F.col("_route_days") > 0, F.col("_route_days")),
                       F.round(F.greatest(F.lit(0.5), F.col("est_distance_km") / 500.0), 2))
    weight = F.when(F.coalesce("weight_kg", F.lit(0.0)) > 0, F.col("weight_kg")).otherwise(5000.0)
    df = df.withColumns({"est_ideal_days": ideal, "est_weight_kg": weight})
    known_truck = F.when(F.col("truck_type").isin(C.TRUCK_TYPES), F.col("truck_type"))
    known_category = F.when(F.col("product_category").isin(C.PRODUCT_CATEGORIES), F.col("product_category"))
    return df.withColumns({
        "est_truck_type": F.coalesce(known_truck, assign_truck(F.col("est_weight_kg"), C.NEW_ORDER_TRUCK_LIMITS_KG)),
        "est_state": F.coalesce("destination_state", "origin_state", F.lit(C.DEFAULT_STATE)),
        "est_category": F.coalesce(known_category, F.lit(C.DEFAULT_CATEGORY)),
        "est_quoted_days": F.greatest(F.col("est_ideal_days"), days)}).drop("_route_km", "_route_days")


def _route_between(df: DataFrame, routes: DataFrame) -> DataFrame:
    plain = routes.select("origin_hub_id", "dest_hub_id", F.col("distance_km"), F.col("ideal_days"))
    moved = df.withColumnsRenamed({c: f"_keep_{c}" for c in ("distance_km", "ideal_days") if c in df.columns})
    out = route_lookup(moved, plain, "origin_hub_id", "destination_hub_id")
    out = out.withColumnsRenamed({"distance_km": "_route_km", "ideal_days": "_route_days"})
    return out.withColumnsRenamed({c: c.removeprefix("_keep_") for c in out.columns if c.startswith("_keep_")})


def invoice_document(invoices: DataFrame, orders: DataFrame, vendors: DataFrame, hubs: DataFrame) -> DataFrame:
    """Everything printed on an invoice. The carrier table grows with the data and joins by shuffle, salted by the invoice."""
    o = orders.select("order_id", "vendor_id", "origin_hub_id", "dest_hub_id", "order_date", "truck_type",
                      "product_category", "distance_km", "ideal_days", "quoted_days", "billable_weight_kg")
    v = vendors.select("vendor_id", "vendor_name")
    joined = salted_join(invoices.join(o, ["order_id", "vendor_id"], "left"), v, "vendor_id", "invoice_id")
    return (hub_attributes(joined, hubs)
            .withColumn("invoice_date", F.date_add("order_date", F.ceil("actual_days").cast("int"))))


def shipment_context(shipments: DataFrame, hubs: DataFrame, routes: DataFrame, prices: DataFrame,
                     weather: DataFrame) -> DataFrame:
    """Route, origin-state diesel and destination weather of planned shipments.

    Days in transit: given, else 1.3 times the ideal, else 2.
    """
    df = route_lookup(hub_attributes(shipments, hubs), routes)
    df = df.withColumn("transit_days", F.coalesce("transit_days", F.col("ideal_days") * 1.3, F.lit(2.0)))
    df = df.withColumn("window_start", F.col("ship_date")).withColumn(
        "window_end", F.date_add("ship_date", dates.transit_length(F.col("transit_days"))))
    start, end = dates.bounded_window(F.col("window_start"), F.col("window_end"))
    df = df.withColumns({"window_start": start, "window_end": end})
    df = fuel_resolve(df, prices, state="origin_state", day="ship_date")
    return weather_summary(df, weather)
