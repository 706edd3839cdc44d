"""Sources, joins, windows over series, and set operations."""

from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import dates
from lanewise.operators import enrich, gate, series
from lanewise.operators.scale import keep_first
from lanewise.plans.freight_view import TODAY
from lanewise.plans.oracle import TRANSIT, truck
from lanewise.plans.registry import op
from lanewise.sources import documents, prices, reference, weather
from lanewise.plans.scratch import scratch_folder

today = f"DATE '{TODAY}'"


def _today():
    return F.lit(TODAY).cast("date")


# ---- sources -----------------------------------------------------------------------------

@op("scan_reference", "SELECT vendor_id, vendor_name, home_state, fleet_size FROM f_vendors")
def _(v):
    return v.vendors.select("vendor_id", "vendor_name", "home_state", "fleet_size")


@op("publish_tables", """SELECT year(received_at)::INTEGER AS year, count(*) AS invoices, count(anomaly_type) AS labelled FROM f_inv GROUP BY 1""")
def _(v):
    out = scratch_folder(v.spark, "published")
    inv = v.invoices.withColumn("year", F.year("received_at")).withColumn("_latent_note", F.lit("x"))
    reference.publish_tables({"invoices": inv.drop("anomaly_type"), "ground_truth_audit": inv.select("order_id", "anomaly_type", "requires_manual_review")},
                             out, {"invoices": "year"})
    back = v.spark.read.parquet(f"{out}/invoices")
    labels = v.spark.read.parquet(f"{out}/ground_truth_audit")
    return (back.join(labels.select("order_id", "anomaly_type"), "order_id").groupBy("year")
            .agg(F.count("*").alias("invoices"), F.count("anomaly_type").alias("labelled")))


def _document_lines(v):
    """Documents as JSON lines, every third one flat, the others with a fields object."""
    fields = F.struct(*[F.col(f"gt_{f}").alias(f) for f in C.CORE_FIELDS])
    nested = F.to_json(F.struct("doc_id", "layout", fields.alias("fields")))
    flat = F.to_json(F.struct("doc_id", F.lit("scan").alias("source"), *[F.col(f"gt_{f}").alias(f) for f in C.CORE_FIELDS]))
    return v.documents.select(F.when(F.col("doc_seq") % 3 == 0, flat).otherwise(nested).alias("json"))


@op("scan_documents", """SELECT doc_id, CASE WHEN doc_seq % 3 = 0 THEN 'unknown' ELSE layout END AS layout, gt_total AS total, gt_toll AS toll,
    CASE WHEN gt_toll IS NULL THEN 11 ELSE 12 END AS n_fields FROM f_docs""")
def _(v):
    d = documents.parse_documents(_document_lines(v))
    return d.select("doc_id", "layout", F.try_element_at("fields", F.lit("total")).alias("total"), F.try_element_at("fields", F.lit("toll")).alias("toll"),
                    F.size("fields").alias("n_fields"))


@op("adapt_documents", """SELECT CASE WHEN doc_seq % 4 = 0 THEN 'scan_' || doc_seq::VARCHAR WHEN doc_seq % 4 = 1 THEN doc_id ELSE gt_invoice_id END AS doc_id,
    (doc_seq % 7)::VARCHAR AS layout, gt_vendor_id AS vendor_gstin FROM f_docs""")
def _(v):
    q = F.col("doc_seq")
    fields = F.map_from_arrays(F.array(F.lit("gstin"), F.lit("invoice_id")), F.array("gt_vendor_id", F.when(q % 4 > 1, F.col("gt_invoice_id"))))
    raw = v.documents.select(F.when(q % 4 == 1, F.col("doc_id")).alias("doc_id"), "layout",
                             F.concat(F.lit("/in/scan_"), q.cast("string"), F.lit(".png")).alias("path"), fields.alias("fields"))
    d = documents.adapt_documents(raw)
    return d.select("doc_id", "layout", F.try_element_at("fields", F.lit("vendor_gstin")).alias("vendor_gstin"))


@op("resume_unprocessed", "SELECT invoice_id FROM f_inv_first WHERE invoice_id NOT IN (SELECT invoice_id FROM f_inv)")
def _(v):
    return reference.skip_processed(v.invoices_first.select("invoice_id"), v.invoices, "invoice_id")


@op("weather_pack", """SELECT hub_id, isoyear(day)::INTEGER AS iso_year, week(day)::INTEGER AS iso_week, min(day) AS window_start, max(day) AS window_end,
    count(*) AS days, count(precip) AS readings FROM f_weather GROUP BY 1, 2, 3""")
def _(v):
    p = weather.weather_pack(v.weather)
    arr = F.from_json("precipitation_sum_json", "array<double>")
    return p.select("hub_id", "iso_year", "iso_week", "window_start", "window_end", F.size(arr).cast("bigint").alias("days"),
                    F.size(F.array_compact(arr)).cast("bigint").alias("readings"))


@op("weather_explode", """SELECT hub_id, start + i::INTEGER AS day, p AS precip FROM (SELECT hub_id, start, unnest(ps) AS p, unnest(range(len(ps))) AS i
    FROM (SELECT hub_id, min(day) AS start, list(precip ORDER BY day) AS ps FROM f_weather GROUP BY hub_id, isoyear(day), week(day)))""")
def _(v):
    """Weeks without gaps come back day by day; a week with missing days shifts, as the array has no dates."""
    packed = weather.weather_pack(v.weather).withColumn("window_end", F.date_add("window_start", 6))
    first = packed.withColumn("api_call_timestamp", F.lit("2001-12-01").cast("timestamp"))
    stale = first.withColumns({"api_call_timestamp": F.lit("2001-01-01").cast("timestamp"), "precipitation_sum_json": F.lit("[-1.0]")})
    return weather.weather_explode(first.unionByName(stale)).select("hub_id", "day", "precip")


def _metro_raw(v):
    city = F.concat(F.lit(" "), F.regexp_replace("state", " 0$", ""), F.lit(" "))
    p = v.fuel_prices.where(F.col("state").endswith(" 0"))
    return p.select(city.alias(" Metro Cities"), F.when(F.dayofmonth("price_date") % 2 == 0, F.date_format("price_date", "dd-MM-yyyy")).otherwise(F.date_format("price_date", "yyyy-MM-dd")).alias("Calendar Day "),
                    F.when(F.col("diesel_price_per_litre") > 95, "n/a").otherwise(F.col("diesel_price_per_litre").cast("string")).alias(" Retail Selling Price (Rs/L)"),
                    F.when(F.dayofmonth("price_date") == 1, "Petrol").otherwise("Diesel").alias("Products"))


_METRO = "SELECT replace(state, ' 0', '') AS city, price_date, diesel_price_per_litre FROM f_fuel WHERE state LIKE '% 0' AND diesel_price_per_litre <= 95 AND day(price_date) <> 1"


@op("load_metro_prices", _METRO)
def _(v):
    return prices.load_metro_prices(_metro_raw(v))


@op("load_generic_prices", """SELECT price_date, CASE region WHEN 'ASIA' THEN 'ASIA 0' ELSE region END AS state, arg_min(p, state) AS diesel_price_per_litre, 'generic' AS source FROM (
    SELECT price_date, state, replace(replace(replace(state, ' 0', ''), ' 1', ''), ' 2', '') AS region, diesel_price_per_litre AS p FROM f_fuel WHERE day(price_date) <> 31) GROUP BY 1, 2""")
def _(v):
    day = F.when(F.dayofmonth("price_date") == 31, "n/a").when(F.dayofmonth("price_date") % 2 == 0, F.date_format("price_date", "d/M/yyyy")).otherwise(F.date_format("price_date", "yyyy-MM-dd"))
    raw = v.fuel_prices.select(F.concat(F.regexp_replace("state", " [0-9]$", ""), F.lit(" ")).alias("Region"), day.alias("Dt"),
                               F.col("diesel_price_per_litre").cast("string").alias("Rate"), F.col("state").alias("Line"))
    return prices.load_generic_prices(raw, {"region": "Region", "date": "Dt", "price": "Rate"}, {"ASIA": "ASIA 0"}, "Line")


def _metro_and_offsets(v):
    metro = v.fuel_prices.where(F.col("state").endswith(" 0")).select("price_date", "state", "diesel_price_per_litre")
    offsets = v.fuel_prices.select("state").distinct().select("state", (F.length("state") * 0.25).alias("offset"), F.col("state").endswith(" 0").alias("is_metro"))
    return metro, offsets


_SPREAD = """SELECT n.price_date, o.state, m + o.off - (SELECT avg(off) FROM offs WHERE metro) AS p FROM (SELECT price_date, avg(diesel_price_per_litre::DECIMAL(12, 4)) AS m
    FROM f_fuel WHERE state LIKE '% 0' GROUP BY 1) n, offs o WHERE NOT o.metro"""
_OFFS = "WITH offs AS (SELECT DISTINCT state, length(state) * 0.25::DOUBLE AS off, state LIKE '% 0' AS metro FROM f_fuel)"


@op("state_spread", f"{_OFFS} SELECT price_date, state, round(p::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE AS diesel_price_per_litre FROM ({_SPREAD})", r="diesel_price_per_litre:2")
def _(v):
    return prices.state_spread(*_metro_and_offsets(v))


@op("union_prices", f"""{_OFFS} SELECT source, count(*) AS n, count(DISTINCT state) AS states, min(price_date) AS first_day FROM (
    SELECT 'metro' AS source, state, price_date FROM f_fuel WHERE state LIKE '% 0' UNION ALL SELECT 'derived', state, price_date FROM ({_SPREAD})) GROUP BY 1""")
def _(v):
    metro, offsets = _metro_and_offsets(v)
    u = prices.union_prices(metro, prices.state_spread(metro, offsets))
    return u.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("state").alias("states"), F.min("price_date").alias("first_day"))


@op("missing_states", "SELECT DISTINCT state FROM f_routed WHERE state NOT LIKE '% 0'")
def _(v):
    needed = enrich.hub_attributes(v.orders_raw, v.hubs).select(F.col("origin_state").alias("state"))
    return prices.missing_states(needed, _metro_and_offsets(v)[0])


@op("upsert_reference", "SELECT vendor_id, CASE WHEN fleet_size % 2 = 0 THEN fleet_size + 1000 ELSE fleet_size END AS fleet_size, CASE WHEN fleet_size % 4 = 0 THEN NULL ELSE 1.0::DOUBLE END AS rating FROM f_vendors")
def _(v):
    old = v.vendors.select("vendor_id", "fleet_size", F.lit(1.0).alias("rating"), F.lit(1).alias("version"))
    new = old.where("fleet_size % 2 = 0").select("vendor_id", (F.col("fleet_size") + 1000).alias("fleet_size"),
                                                  F.when(F.col("fleet_size") % 4 == 0, float("nan")).otherwise(1.0).alias("rating"), F.lit(2).alias("version"))
    once = reference.upsert_reference(old, new, ["vendor_id"], "version")
    return reference.upsert_reference(once, new, ["vendor_id"], "version").drop("version")


@op("html_price_table", """SELECT day, lower(state) AS state, diesel_price_per_litre AS price FROM (SELECT price_date AS day, state, diesel_price_per_litre FROM f_fuel)""")
def _(v):
    """Pages rendered from the daily prices together with the crawled pages, which hold no price rows."""
    row = F.concat(F.lit("<tr><td><b>"), "state", F.lit("</b></td><td>Rs "), F.format_number("diesel_price_per_litre", 2), F.lit("/L</td><td>x</td></tr>"))
    # a day has at most one row per state
    made = v.fuel_prices.groupBy(F.col("price_date").alias("day")).agg(F.concat_ws("\n", F.collect_list(row)).alias("html"))
    crawled = v.table("pages").select(F.lit(None).cast("date").alias("day"), "html")
    return prices.html_price_table(made.unionByName(crawled), keys=["day"])


# ---- routes --------------------------------------------------------------------------------

@op("hub_pairs", """SELECT a_id AS a_hub_id, b_id AS b_hub_id, count(order_id) AS orders FROM f_pairs LEFT JOIN f_ord_raw
    ON a_id = least(origin_hub_id, dest_hub_id) AND b_id = greatest(origin_hub_id, dest_hub_id) GROUP BY 1, 2""")
def _(v):
    used = v.orders_raw.groupBy(F.least("origin_hub_id", "dest_hub_id").alias("a_hub_id"), F.greatest("origin_hub_id", "dest_hub_id").alias("b_hub_id")).agg(F.count("*").alias("orders"))
    pairs = enrich.hub_pairs(v.hubs).select("a_hub_id", "b_hub_id")
    return pairs.join(used, ["a_hub_id", "b_hub_id"], "left").fillna(0, ["orders"])


@op("route_build", """SELECT r.origin_hub_id, r.dest_hub_id, distance_km, ideal_days, count(order_id) AS orders FROM f_routes r LEFT JOIN f_ord_raw o
    ON r.origin_hub_id = o.origin_hub_id AND r.dest_hub_id = o.dest_hub_id GROUP BY 1, 2, 3, 4""")
def _(v):
    used = v.orders_raw.groupBy("origin_hub_id", "dest_hub_id").agg(F.count("*").alias("orders"))
    return v.routes.join(used, ["origin_hub_id", "dest_hub_id"], "left").fillna(0, ["orders"])


@op("route_lookup", "SELECT order_id, distance_km, ideal_days FROM f_routed")
def _(v):
    return enrich.route_lookup(v.orders_raw, v.routes).select("order_id", "distance_km", "ideal_days")


@op("route_lookup_directed", """SELECT order_id, distance_km FROM f_ord_raw o LEFT JOIN f_routes r ON r.origin_hub_id = o.origin_hub_id AND r.dest_hub_id = o.dest_hub_id""")
def _(v):
    return enrich.route_lookup_directed(v.orders_raw, v.routes).select("order_id", "distance_km")


@op("hub_attributes", "SELECT order_id, origin_city, origin_state, dest_city, dest_state FROM f_routed")
def _(v):
    return enrich.hub_attributes(v.orders_raw, v.hubs).select("order_id", "origin_city", "origin_state", "dest_city", "dest_state")


_CITY = """SELECT t.origin AS place, coalesce(min(CASE WHEN lower(city) = p OR lower(hub_id) = p THEN hub_id END),
    min(CASE WHEN contains(lower(city), p) OR contains(p, lower(city)) THEN hub_id END)) AS hub FROM (SELECT DISTINCT origin, lower(trim(origin)) AS p FROM f_ext) t, f_hubs GROUP BY 1"""


@op("city_to_hub", f"WITH places AS ({_CITY}) SELECT invoice_id, hub AS origin_hub_id FROM f_ext LEFT JOIN places ON origin = place")
def _(v):
    return enrich.city_to_hub(v.extracted, v.hubs, "origin").select("invoice_id", "origin_hub_id")


# ---- diesel ----------------------------------------------------------------------------------

@op("asof_fuel", "SELECT order_id, asof_price, asof_date FROM f_asof")
def _(v):
    d = enrich.hub_attributes(v.orders_clean, v.hubs).withColumnRenamed("origin_state", "state")
    return enrich.asof_fuel(d, v.fuel_prices).select("order_id", "asof_price", "asof_date")


@op("fuel_fallback", "SELECT order_id, expected_fuel_price FROM f_ord", r="expected_fuel_price")
def _(v):
    d = enrich.hub_attributes(v.orders_clean, v.hubs).withColumnRenamed("origin_state", "state")
    return enrich.fuel_fallback(enrich.asof_fuel(d, v.fuel_prices), v.fuel_prices).select("order_id", "expected_fuel_price")


@op("national_daily_median", "SELECT price_date, median_price FROM f_daymed", r="median_price:4")
def _(v):
    return enrich.national_daily_median(v.fuel_prices)


_LAST = "SELECT state, max(price_date) AS price_date, max_by(diesel_price_per_litre, price_date) AS last_price FROM f_fuel GROUP BY 1"


@op("latest_per_state", _LAST)
def _(v):
    return enrich.latest_per_state(v.fuel_prices)


def _current(v):
    """Listed prices of the day: states priced on the last cached day, a little dearer."""
    end = v.fuel_prices.agg(F.max("price_date"))
    return v.fuel_prices.where(F.col("price_date") == end.scalar()).select("state", (F.col("diesel_price_per_litre") + 1.25).alias("price"))


_CARRY = f"""SELECT l.state, last_price, c.price AS listed_price, coalesce(c.price, round(last_price + (SELECT avg(price) - avg(p0) FROM cur), 2)) AS price_today
    FROM ({_LAST}) l LEFT JOIN cur c ON l.state = c.state"""
_CUR = "cur AS (SELECT state, diesel_price_per_litre + 1.25::DOUBLE AS price, diesel_price_per_litre AS p0 FROM f_fuel WHERE price_date = (SELECT max(price_date) FROM f_fuel))"


@op("carry_forward_price", f"WITH {_CUR} {_CARRY}", r="last_price:4 listed_price:4 price_today:4")
def _(v):
    return enrich.carry_forward_price(v.fuel_prices, _current(v))


_SHIFTED = "SELECT order_id, CASE WHEN order_seq % 101 = 0 THEN 'NOWHERE' ELSE state END AS state, order_date + (order_seq % 7)::INTEGER * 100 AS day, expected_weather_score FROM f_routed"


def _requests(v):
    d = enrich.hub_attributes(v.orders_clean, v.hubs)
    return d.select("order_id", F.when(F.col("order_seq") % 101 == 0, "NOWHERE").otherwise(F.col("origin_state")).alias("state"),
                    F.date_add("order_date", (F.col("order_seq") % 7 * 100).cast("int")).alias("order_date"))


_FORECAST = """SELECT key AS state, (ld + step::INTEGER) AS day, floor((lv + coalesce((lv - fv) / nullif(n - 1, 0), 0) * step) * 1000 + 0.5) / 1000 AS forecast FROM (
    SELECT key, max(date) AS ld, max_by(value, date) AS lv, min_by(value, date) AS fv, count(*) AS n FROM f_series GROUP BY 1), (SELECT unnest(range(1, 31)) AS step)"""


def _fuel_series(v):
    """Daily diesel series per state, gaps filled forward."""
    cal = enrich.price_calendar(v.fuel_prices, None)
    return cal.select(F.lit("fuel_diesel").alias("series"), F.col("state").alias("key"), F.col("day").alias("date"), F.col("price").alias("value"))


@op("fuel_resolve", f"""WITH fc AS ({_FORECAST}), {_CUR}, req AS ({_SHIFTED}), carry AS ({_CARRY}) SELECT order_id,
    CASE WHEN day <= (SELECT max(price_date) FROM f_fuel) AND c.p IS NOT NULL THEN c.p WHEN listed_price IS NOT NULL THEN listed_price WHEN price_today IS NOT NULL THEN price_today
    ELSE 93.0::DOUBLE END AS fuel_price,
    CASE WHEN day <= (SELECT max(price_date) FROM f_fuel) AND c.p IS NOT NULL THEN 'cache' WHEN listed_price IS NOT NULL THEN 'listed' WHEN price_today IS NOT NULL THEN 'carry_forward'
    ELSE 'offset' END AS fuel_source
    FROM (SELECT req.*, f.diesel_price_per_litre AS p FROM req ASOF LEFT JOIN f_fuel f ON req.state = f.state AND req.day >= f.price_date) c LEFT JOIN carry ON c.state = carry.state""", r="fuel_price:4")
def _(v):
    fc = series.drift_forecast(_fuel_series(v), 30).select(F.col("key").alias("state"), F.col("date").alias("day"), "forecast")
    out = enrich.fuel_resolve(_requests(v), v.fuel_prices, _current(v), fc)
    return out.select("order_id", "fuel_price", "fuel_source")


@op("fuel_resolve_forecast", f"""WITH fc AS ({_FORECAST}), req AS ({_SHIFTED}) SELECT order_id,
    CASE WHEN c.day <= cend AND p IS NOT NULL THEN p ELSE coalesce(forecast, lastfc, 93.0::DOUBLE) END AS fuel_price,
    CASE WHEN c.day <= cend AND p IS NOT NULL THEN 'cache' WHEN forecast IS NOT NULL THEN 'forecast' WHEN lastfc IS NOT NULL THEN 'last_forecast' ELSE 'offset' END AS fuel_source
    FROM (SELECT req.*, f.diesel_price_per_litre AS p, (SELECT max(price_date) FROM f_fuel) AS cend FROM req ASOF LEFT JOIN f_fuel f ON req.state = f.state AND req.day >= f.price_date) c
    LEFT JOIN fc ON c.state = fc.state AND c.day = fc.day LEFT JOIN (SELECT state, max_by(forecast, day) AS lastfc FROM fc GROUP BY 1) l ON c.state = l.state""", r="fuel_price:2")
def _(v):
    fc = series.drift_forecast(_fuel_series(v), 30).select(F.col("key").alias("state"), F.col("date").alias("day"), "forecast")
    return enrich.fuel_resolve(_requests(v), v.fuel_prices, None, fc).select("order_id", "fuel_price", "fuel_source")


@op("daily_fill", """SELECT state, d AS day, coalesce(last_value(p IGNORE NULLS) OVER (PARTITION BY state ORDER BY d), first_value(p IGNORE NULLS) OVER (PARTITION BY state ORDER BY d
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) AS price FROM (SELECT state, unnest(generate_series(DATE '1994-12-01', DATE '2001-12-31', INTERVAL 1 DAY))::DATE AS d FROM (SELECT DISTINCT state FROM f_fuel))
    LEFT JOIN (SELECT state, price_date AS d, diesel_price_per_litre AS p FROM f_fuel) USING (state, d)""")
def _(v):
    late = v.fuel_prices.withColumn("line", F.lit(2))        # the later of two rows of a day, and the cheaper, is the one that counts
    early = late.where(F.dayofmonth("price_date") % 3 == 0).withColumns({"line": F.lit(1), "diesel_price_per_litre": F.col("diesel_price_per_litre") + 5})
    return series.daily_fill(early.unionByName(late), F.lit("1994-12-01").cast("date"), F.lit("2001-12-31").cast("date"), "line")


# ---- weather ---------------------------------------------------------------------------------

def trip_windows(v):
    o = v.orders_raw.select("order_id", "dest_hub_id")
    start, end = dates.transit_window(F.col("received_at"), F.col("actual_days"))
    return v.invoices.join(o, "order_id").withColumns({"window_start": start, "window_end": end})


@op("weather_window", "SELECT invoice_id, weather_score, adverse_weather_days, covered_days FROM f_inv_wx")
def _(v):
    return enrich.weather_window(trip_windows(v), v.weather).select("invoice_id", "weather_score", "adverse_weather_days", "covered_days")


_SUMMARY = """SELECT i.invoice_id, sum(pts)::BIGINT AS weather_score, count(*) FILTER (precip > 20) AS adverse_weather_days, coalesce(sum(precip), 0) AS rain_mm_total,
    max(wind) AS max_wind_kmh, max(temp) AS max_temp_c, count(*) AS days FROM f_inv_win i JOIN f_pts w ON w.hub_id = i.dest_hub_id AND w.day BETWEEN i.window_start AND i.window_end GROUP BY 1"""


@op("weather_summary", f"""SELECT invoice_id, weather_score, adverse_weather_days, rain_mm_total, max_wind_kmh, max_temp_c, days FROM f_inv_win LEFT JOIN ({_SUMMARY}) USING (invoice_id)""",
    r="rain_mm_total:0")
def _(v):
    return enrich.weather_summary(trip_windows(v), v.weather).select("invoice_id", "weather_score", "adverse_weather_days", "rain_mm_total",
                                                                 "max_wind_kmh", "max_temp_c", "days")


@op("weather_resolve", f"""WITH req AS (SELECT DISTINCT dest_hub_id AS hub_id, order_date AS day FROM f_ord_clean WHERE order_date IS NOT NULL)
    SELECT r.hub_id, r.day, coalesce(CASE WHEN o.day IS NOT NULL THEN o.precip END, CASE WHEN y.day IS NOT NULL THEN y.precip END) AS precip,
    CASE WHEN r.day <= {today} - 6 AND o.day IS NOT NULL THEN 'observed' WHEN r.day > {today} - 6 AND r.day <= {today} + 15 AND o.day IS NOT NULL THEN 'forecast' WHEN r.day > {today} + 15 AND y.day IS NOT NULL THEN 'last_year' END AS weather_source
    FROM req r LEFT JOIN f_weather o ON o.hub_id = r.hub_id AND o.day = r.day AND r.day <= {today} + 15
    LEFT JOIN f_weather y ON y.hub_id = r.hub_id AND r.day > {today} + 15 AND y.day = (r.day - INTERVAL 1 YEAR)::DATE AND strftime(r.day, '%m-%d') <> '02-29'""")
def _(v):
    req = v.orders_clean.where("order_date IS NOT NULL").select(F.col("dest_hub_id").alias("hub_id"), F.col("order_date").alias("day")).distinct()
    return enrich.weather_resolve(req, v.weather, v.weather, _today()).select("hub_id", "day", "precip", "weather_source")


@op("weather_from_forecast", f"""WITH fut AS (SELECT i.invoice_id, sum(w.precip) AS rain, count(w.week) AS n FROM f_inv_win i LEFT JOIN f_weekly w ON w.hub_id = i.dest_hub_id
    AND w.week BETWEEN i.window_start AND i.window_end AND i.window_start >= {today} GROUP BY 1)
    SELECT invoice_id, CASE WHEN n > 0 THEN CASE WHEN rain > 20 THEN 2 ELSE 0 END ELSE weather_score END AS weather_score,
    CASE WHEN n > 0 THEN CASE WHEN rain > 20 THEN 1 ELSE 0 END ELSE adverse_weather_days END AS adverse_weather_days,
    CASE WHEN n > 0 THEN 'forecast' WHEN covered_days > 0 THEN 'history' ELSE 'default' END AS weather_source FROM f_inv_wx JOIN fut USING (invoice_id)""")
def _(v):
    weekly = series.weekly_resample(v.weather).select("hub_id", F.col("week").alias("day"), "precip")
    return enrich.weather_from_forecast(trip_windows(v), weekly, v.weather, _today()).select("invoice_id", "weather_score", "adverse_weather_days", "weather_source")


# ---- orders, vendors, invoices -------------------------------------------------------------------

@op("order_enrich", "SELECT i.invoice_id, o.distance_km, o.truck_type, o.order_id IS NOT NULL AS order_found FROM f_inv i LEFT JOIN f_ord o ON i.order_id = o.order_id")
def _(v):
    return enrich.order_enrich(v.invoices, v.orders, ["distance_km", "truck_type"]).select("invoice_id", "distance_km", "truck_type", "order_found")


@op("reference_context", """SELECT i.invoice_id, r.adverse_weather_days AS ref_adverse_days, r.vendor_padding_ratio AS ref_padding, r.order_id IS NOT NULL AS from_reference FROM f_inv i LEFT JOIN (
    SELECT order_id, adverse_weather_days, vendor_padding_ratio FROM f_fair JOIN f_inv_wx USING (invoice_id)) r ON i.order_id = r.order_id""", r="ref_padding")
def _(v):
    ref = enrich.weather_window(trip_windows(v), v.weather).select("invoice_id", "order_id", "adverse_weather_days")
    ref = ref.join(v.priced.select("invoice_id", "vendor_padding_ratio"), "invoice_id")
    twice = ref.unionByName(ref.withColumns({"invoice_id": F.concat("invoice_id", F.lit("-2")), "adverse_weather_days": F.lit(99).cast("bigint")}))
    return enrich.reference_context(v.invoices, twice).select("invoice_id", "ref_adverse_days", "ref_padding", "from_reference")


@op("coalesce_context", """SELECT invoice_id, CASE WHEN invoice_seq % 3 = 0 THEN coalesce(asof_price, 91.5) ELSE expected_fuel_price END AS expected_fuel_price,
    CASE WHEN invoice_seq % 5 = 0 THEN 0 ELSE expected_weather_score END AS expected_weather_score,
    CASE WHEN invoice_seq % 2 = 0 THEN 7 WHEN covered_days > 0 THEN adverse_weather_days ELSE 0 END AS adverse_weather_days,
    CASE WHEN invoice_seq % 2 = 0 THEN 'reference' WHEN covered_days > 0 THEN 'measured' ELSE 'default' END AS adverse_weather_source
    FROM f_fair JOIN f_inv_wx USING (invoice_id)""", r="expected_fuel_price")
def _(v):
    o = v.orders.select("order_id", "asof_price", "expected_fuel_price", "expected_weather_score")
    q = F.col("invoice_seq")
    d = enrich.weather_window(trip_windows(v), v.weather).join(o, "order_id").withColumns({
        "expected_fuel_price": F.when(q % 3 != 0, F.col("expected_fuel_price")).otherwise(float("nan")),
        "expected_weather_score": F.when(q % 5 != 0, F.col("expected_weather_score")),
        "from_reference": q % 2 == 0, "ref_adverse_days": F.lit(7)})
    return enrich.coalesce_context(d).select("invoice_id", "expected_fuel_price", "expected_weather_score", "adverse_weather_days", "adverse_weather_source")


_PLACES = "places AS (SELECT t.place, coalesce(min(CASE WHEN lower(city) = p OR lower(hub_id) = p THEN hub_id END), min(CASE WHEN contains(lower(city), p) OR contains(p, lower(city)) THEN hub_id END)) AS hub FROM (SELECT DISTINCT place, lower(trim(place)) AS p FROM (SELECT origin AS place FROM f_ext UNION ALL SELECT destination FROM f_ext)) t, f_hubs GROUP BY 1)"
ESTIMATE = f"""SELECT *, CASE WHEN route_days > 0 THEN route_days ELSE round((greatest(0.5, est_distance_km / 500))::VARCHAR::DECIMAL(38, 20), 2)::DOUBLE END AS est_ideal_days FROM (
    SELECT e.*, r.distance_km AS route_km, r.ideal_days AS route_days, coalesce(CASE WHEN r.distance_km > 0 THEN r.distance_km END,
    CASE WHEN coalesce(toll, 0) > 100 THEN round((toll / 1.75::DOUBLE)::VARCHAR::DECIMAL(38, 20), 1)::DOUBLE ELSE round(greatest(100, coalesce(nullif(actual_days, 0), 1) * 350), 1) END) AS est_distance_km,
    CASE WHEN coalesce(weight_kg, 0) > 0 THEN weight_kg ELSE 5000 END AS est_weight_kg, coalesce(hd.state, ho.state, 'Maharashtra') AS est_state, ho.hub_id AS origin_hub, hd.hub_id AS dest_hub
    FROM f_ext e LEFT JOIN places po ON po.place = e.origin LEFT JOIN places pd ON pd.place = e.destination LEFT JOIN f_hubs ho ON ho.hub_id = po.hub LEFT JOIN f_hubs hd ON hd.hub_id = pd.hub
    LEFT JOIN f_routes r ON r.origin_hub_id = least(ho.hub_id, hd.hub_id) AND r.dest_hub_id = greatest(ho.hub_id, hd.hub_id))"""


@op("estimate_missing_order", f"""WITH {_PLACES} SELECT invoice_id, est_distance_km, est_ideal_days, est_weight_kg, {truck('est_weight_kg', C.NEW_ORDER_TRUCK_LIMITS_KG)} AS est_truck_type, est_state,
    'Automotive Spare Parts' AS est_category, greatest(est_ideal_days, coalesce(nullif(actual_days, 0), 1)) AS est_quoted_days FROM ({ESTIMATE})""")
def _(v):
    d = v.extracted.withColumns({"truck_type": F.lit("van"), "product_category": F.lit(None).cast("string")})
    return enrich.estimate_missing_order(d, v.hubs, v.routes).select("invoice_id", "est_distance_km", "est_ideal_days", "est_weight_kg", "est_truck_type",
                                                                     "est_state", "est_category", "est_quoted_days")


@op("referential_gate", """SELECT invoice_id, order_known, vendor_known, coalesce(CASE WHEN gate_reason LIKE 'missing%' THEN gate_reason END, CASE WHEN NOT order_known THEN 'order_id_not_found'
    WHEN NOT vendor_known THEN 'vendor_id_not_found' ELSE gate_reason END) AS gate_reason FROM (SELECT g.*, g.order_id IN (SELECT order_id FROM f_ord_raw) AS order_known,
    coalesce(g.vendor_id IN (SELECT vendor_id FROM f_vendors WHERE fleet_size % 9 <> 0), FALSE) AS vendor_known FROM f_gated g)""")
def _(v):
    known = enrich.add_existence(v.extracted, v.orders_raw, v.vendors.where("fleet_size % 9 <> 0"))
    return gate.confidence_gate(known, False, False).select("invoice_id", "order_known", "vendor_known", "gate_reason")


@op("orphan_invoices", "SELECT invoice_id FROM f_inv WHERE order_id NOT IN (SELECT order_id FROM f_ord_raw)")
def _(v):
    return enrich.orphan_invoices(v.invoices, v.orders_raw).select("invoice_id")


@op("carrier_mismatch", """SELECT i.invoice_id, upper(i.vendor_id) AS vendor_id, o.vendor_id AS booked_vendor_id FROM f_inv_raw i JOIN f_ord_raw o ON i.order_id = o.order_id WHERE upper(i.vendor_id) <> o.vendor_id""")
def _(v):
    submitted = v.invoices_raw.withColumn("vendor_id", F.upper("vendor_id"))
    return enrich.carrier_mismatch(submitted, v.orders_raw).select("invoice_id", "vendor_id", "booked_vendor_id")


@op("invoice_document", """SELECT i.invoice_id, n.vendor_name, o.origin_city, o.dest_city, o.truck_type, o.order_date + ceil(i.actual_days)::INTEGER AS invoice_date
    FROM f_inv i LEFT JOIN f_routed o ON i.order_id = o.order_id AND i.vendor_id = o.vendor_id LEFT JOIN f_vendors n ON n.vendor_id = i.vendor_id""")
def _(v):
    d = enrich.invoice_document(v.invoices, v.orders, v.vendors, v.hubs)
    return d.select("invoice_id", "vendor_name", "origin_city", "dest_city", "truck_type", "invoice_date")


@op("shipment_context", f"""WITH s AS (SELECT order_id, dest_hub_id, distance_km, order_date AS ship_date, state, order_date + greatest(1, round_even(ideal_days * 1.3::DOUBLE + 0.49::DOUBLE, 0)::INTEGER) AS w_end FROM f_routed)
    SELECT s.order_id, s.distance_km, f.diesel_price_per_litre AS fuel_price, w.weather_score, w.days FROM s ASOF LEFT JOIN f_fuel f ON s.state = f.state AND s.ship_date >= f.price_date
    LEFT JOIN (SELECT order_id, sum(pts)::BIGINT AS weather_score, count(*) AS days FROM s JOIN f_pts p ON p.hub_id = s.dest_hub_id AND p.day BETWEEN s.ship_date AND s.w_end GROUP BY 1) w ON s.order_id = w.order_id""")
def _(v):
    planned = v.orders_clean.select("order_id", "origin_hub_id", "dest_hub_id", F.col("order_date").alias("ship_date"), F.lit(None).cast("double").alias("transit_days"))
    d = enrich.shipment_context(planned, v.hubs, v.routes, v.fuel_prices, v.weather)
    price = F.when(F.col("fuel_source") == "cache", F.col("fuel_price"))
    return d.select("order_id", "distance_km", price.alias("fuel_price"), "weather_score", "days")


@op("build_orders", "SELECT order_id, truck_type, distance_km, quoted_days, expected_fuel_price, baseline_cost, base_freight_cost FROM f_ord",
    r="expected_fuel_price baseline_cost:3 base_freight_cost:3")
def _(v):
    return v.orders.select("order_id", "truck_type", "distance_km", "quoted_days", "expected_fuel_price", "baseline_cost", "base_freight_cost")


@op("price_invoices", "SELECT invoice_id, fair_cost, fair_lower, fair_upper, billed_status, prediction_status, flagged, flag_source FROM f_priced",
    r="fair_cost:3 fair_lower:3 fair_upper:3")
def _(v):
    """Cleaned invoices priced and checked against the fair-cost band."""
    return v.priced.select("invoice_id", "fair_cost", "fair_lower", "fair_upper", "billed_status", "prediction_status", "flagged", "flag_source")


@op("keep_first", "SELECT vendor_id, min(invoice_id) AS invoice_id FROM f_inv GROUP BY 1")
def _(v):
    """First invoice of each carrier: a key with very many rows."""
    return keep_first(v.invoices.select("vendor_id", "invoice_id"), ["vendor_id"], ["invoice_id"])


def full_audit(ratio: str = "1.0::DOUBLE", proba: str = "NULL::DOUBLE", more: str = "", none: str = "") -> str:
    """SQL of the audit for a ratio and a probability per invoice; ``more`` columns of scored rows, ``none`` their place in stopped ones."""
    return f"""WITH {_PLACES}, est AS ({ESTIMATE}), ord2 AS (
    SELECT g.*, o.order_id IS NOT NULL AS order_found, coalesce(o.dest_hub_id, e.dest_hub) AS d_hub, CASE WHEN o.order_id IS NOT NULL THEN o.truck_type ELSE {truck('e.est_weight_kg', C.NEW_ORDER_TRUCK_LIMITS_KG)} END AS truck_type,
    coalesce(o.billable_weight_kg, e.est_weight_kg) AS billable_weight_kg, coalesce(o.quoted_days, greatest(e.est_ideal_days, coalesce(nullif(g.actual_days, 0), 1))) AS quoted_days,
    coalesce(o.ideal_days, e.est_ideal_days) AS ideal_days, coalesce(o.distance_km, e.est_distance_km) AS distance_km, o.expected_fuel_price AS known_price, e.est_state,
    CASE WHEN o.order_id IS NOT NULL THEN o.expected_weather_score ELSE 0 END AS expected_weather_score
    FROM f_gated g LEFT JOIN f_ord o ON g.order_id = o.order_id LEFT JOIN est e ON e.invoice_id = g.invoice_id WHERE g.gate_passed),
    fuel2 AS (SELECT q.*, CASE WHEN order_found THEN known_price ELSE coalesce(f.diesel_price_per_litre, l.last_price, 93.0) END AS expected_fuel_price
    FROM ord2 q ASOF LEFT JOIN f_fuel f ON q.est_state = f.state AND q.invoice_date >= f.price_date LEFT JOIN ({_LAST}) l ON q.est_state = l.state),
    wx AS (SELECT invoice_id, coalesce(sum(wet), 0)::BIGINT AS adverse FROM fuel2 JOIN f_pts w ON w.hub_id = d_hub AND w.day BETWEEN invoice_date - {TRANSIT} AND invoice_date GROUP BY 1),
    fair AS (SELECT x.*, distance_km / (CASE truck_type WHEN '12-wheeler' THEN 4.0::DOUBLE WHEN '10-wheeler' THEN 4.6::DOUBLE ELSE 6.5::DOUBLE END) * expected_fuel_price + distance_km * 1.75::DOUBLE + ideal_days * 1200.0::DOUBLE AS c0,
    coalesce(adverse, 0) AS wet, CASE WHEN prior_total = 0 THEN 0 ELSE (prior_flagged + 0.12::DOUBLE) / (prior_total + 2) END AS risk FROM fuel2 x LEFT JOIN wx ON x.invoice_id = wx.invoice_id LEFT JOIN f_hist h ON h.invoice_id = x.invoice_id),
    est2 AS (SELECT *, c0 * {ratio} AS c, {proba} AS p FROM fair),
    chk AS (SELECT *, CASE WHEN c / greatest(distance_km, 1.0) < 7.71 THEN 'too_low' WHEN c / greatest(distance_km, 1.0) > 83.29 THEN 'too_high' ELSE 'ok' END AS ps,
    CASE WHEN total < c * 0.97::DOUBLE * 0.724::DOUBLE THEN 'too_low' WHEN total - c * 1.03::DOUBLE > 18554 OR total > c * 1.03::DOUBLE * 22.789::DOUBLE THEN 'too_high' ELSE 'ok' END AS bs FROM est2)
    SELECT invoice_id, TRUE AS gate_passed, NULL::VARCHAR AS gate_reason, order_found, c AS fair_cost, wet AS adverse_weather_days, risk AS vendor_historical_risk_score, bs AS billed_status, bs <> 'ok' OR ps <> 'ok' OR coalesce(p >= 0.5, FALSE) AS flagged,
    CASE WHEN (bs <> 'ok' OR ps <> 'ok') AND p >= 0.5 THEN 'model+logic_check' WHEN bs <> 'ok' OR ps <> 'ok' THEN 'logic_check' WHEN p >= 0.5 THEN 'model' END AS flag_source{more} FROM chk
    UNION ALL SELECT invoice_id, FALSE, gate_reason, NULL, NULL, NULL, NULL, NULL, NULL, NULL{none} FROM f_gated WHERE NOT gate_passed"""



SCORED = ["invoice_id", "gate_passed", "gate_reason", "order_found", "fair_cost", "adverse_weather_days", "vendor_historical_risk_score", "billed_status", "flagged", "flag_source"]


@op("score_invoices", full_audit(), r="fair_cost:3 vendor_historical_risk_score")
def _(v):
    """Flagship: gate, order lookup or estimate, diesel, weather, carrier history, checks and flags for every invoice."""
    return v.scored.select(*SCORED)
