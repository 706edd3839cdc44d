"""DuckDB text of the freight view, used as a CTE prefix of every comparison query.

Names start with f_ so that they never hide a given table.
"""

import re

from lanewise import constants as C
from lanewise.plans.freight_view import CATEGORY_OF_TYPE, SUBMISSION_ORDER


def dbl(x) -> str:
    return f"{x!r}::DOUBLE"


def in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def truck(weight: str, limits=C.TRUCK_LIMITS_KG) -> str:
    return (f"CASE WHEN {weight} <= {limits[0]} THEN '6-wheeler' WHEN {weight} <= {limits[1]} THEN '10-wheeler' "
            "ELSE '12-wheeler' END")


MILEAGE = "CASE truck_type WHEN '12-wheeler' THEN 4.0::DOUBLE WHEN '10-wheeler' THEN 4.6::DOUBLE ELSE 6.5::DOUBLE END"
BASELINE = f"(distance_km / ({MILEAGE}) * expected_fuel_price + distance_km * 1.75::DOUBLE + ideal_days * 1200.0::DOUBLE)"


def tri_number(x: str, kind: str) -> str:
    """Normalised amount or number as struct(status, value)."""
    if kind == "amount":
        bare, digits = f"regexp_replace(regexp_replace({x}, '(?i)(rs\\.?|inr|₹)', '', 'g'), '[, ]', '', 'g')", 2
    else:
        bare, digits = f"trim(regexp_replace(regexp_replace({x}, '(?i)(kgs?|days?)', '', 'g'), ',', '', 'g'))", 3
    return f"round(try_cast({bare} AS DOUBLE), {digits})"


def tri(x: str, kind: str) -> str:
    if kind in ("amount", "number"):
        value = tri_number(x, kind)
    elif kind == "date":
        formats = ["%Y-%m-%d", "%d-%m-%Y", "%d/%m/%Y", "%d.%m.%Y", "%d %b %Y", "%d-%b-%Y", "%d %B %Y"]
        value = f"strftime(try_strptime(trim({x}), [{in_list(formats)}]), '%Y-%m-%d')"
    elif kind == "text":
        words = f"trim(regexp_replace(lower({x}), '[^0-9a-z\\x{{0900}}-\\x{{097F}}]+', ' ', 'g'))"
        return f"struct_pack(status := CASE WHEN nullif({words}, '') IS NULL THEN 'null' ELSE 'ok' END, value := nullif({words}, ''))"
    else:
        value = f"upper(regexp_replace({x}, '\\s+', '', 'g'))"
    blank = f"({x} IS NULL OR trim({x}) = '')"
    return (f"struct_pack(status := CASE WHEN {blank} THEN 'null' WHEN ({value}) IS NULL THEN 'bad' ELSE 'ok' END, "
            f"value := CASE WHEN NOT {blank} THEN {value} END)")


def status(kind: str, truth: str, predicted: str) -> str:
    t, p = tri(truth, kind), tri(predicted, kind)
    same = f"abs(({t}).value - ({p}).value) <= 0.01" if kind in ("amount", "number") else f"({t}).value = ({p}).value"
    return (f"CASE WHEN ({t}).status = 'null' THEN CASE WHEN ({p}).status = 'null' THEN 'correct_null' ELSE 'hallucinated' END "
            f"WHEN ({p}).status = 'null' THEN 'missing' "
            f"WHEN coalesce(({t}).status = 'ok' AND ({p}).status = 'ok' AND {same}, FALSE) THEN 'correct' ELSE 'wrong' END")


def money(x: str, decimals: int = 0) -> str:
    body = f"('₹' || format('{{:,.{decimals}f}}', abs({x})))"
    return f"CASE WHEN ({x}) IS NULL THEN '—' WHEN ({x}) < 0 THEN '−' || {body} ELSE {body} END"


_CATEGORY = "CASE p_type " + " ".join(f"WHEN '{t}' THEN '{c}'" for t, c in CATEGORY_OF_TYPE.items()) + " END"
_TYPE_RANK = "CASE p_type " + " ".join(f"WHEN '{t}' THEN {i}" for i, t in enumerate(CATEGORY_OF_TYPE, 1)) + " END"

HISTORY = """sum(1) OVER w AS prior_total, sum(requires_manual_review) OVER w AS prior_flagged"""

CTES = {
    "f_hubs": """SELECT printf('HUB%02d', n_nationkey) AS hub_id, n_name AS city, r_name || ' ' || (n_nationkey % 3)::VARCHAR AS state,
        (8 + (n_nationkey * 7) % 25)::DOUBLE AS latitude, (68 + (n_nationkey * 11) % 29)::DOUBLE AS longitude,
        (['metro', 'regional', 'port'])[n_nationkey % 3 + 1] AS hub_category
        FROM nation JOIN region ON n_regionkey = r_regionkey""",
    "f_vendors": """SELECT printf('VEN%03d', s_suppkey) AS vendor_id, s_name AS vendor_name, r_name AS home_state,
        (s_suppkey % 200 + 8)::INTEGER AS fleet_size
        FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""",
    "f_pairs": """SELECT a.hub_id AS a_id, b.hub_id AS b_id, 12742.0176::DOUBLE * asin(sqrt(
        sin(radians(b.latitude - a.latitude) / 2) * sin(radians(b.latitude - a.latitude) / 2) + cos(radians(a.latitude))
        * cos(radians(b.latitude)) * sin(radians(b.longitude - a.longitude) / 2) * sin(radians(b.longitude - a.longitude) / 2))) AS crow_km
        FROM f_hubs a JOIN f_hubs b ON a.hub_id < b.hub_id""",
    "f_routes": """SELECT a_id AS origin_hub_id, b_id AS dest_hub_id, distance_km, round(greatest(0.3::DOUBLE, distance_km / 450.0::DOUBLE), 2) AS ideal_days
        FROM (SELECT *, round(crow_km * 1.3::DOUBLE, 1) AS distance_km FROM f_pairs) WHERE distance_km >= 1 AND distance_km >= crow_km""",
    "f_inv_raw": """SELECT printf('INV%06d', l_orderkey * 10 + l_linenumber) AS invoice_id, printf('ORD%06d', l_orderkey * 10 + l_linenumber) AS order_id,
        CASE WHEN l_partkey % 40 = 0 THEN lower(printf('VEN%03d', l_suppkey)) ELSE printf('VEN%03d', l_suppkey) END AS vendor_id,
        CASE WHEN l_partkey % 500 = 0 THEN -l_extendedprice ELSE l_extendedprice END AS actual_billed_amount,
        round(1.0::DOUBLE + l_tax * 20.0::DOUBLE + l_discount * 30.0::DOUBLE + l_quantity % 4 * 0.5::DOUBLE, 2) AS actual_days,
        l_quantity * 500.0::DOUBLE AS weight_kg, l_shipdate::DATE AS received_at,
        (l_returnflag = 'R' AND l_linestatus = 'F')::INTEGER AS requires_manual_review,
        CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN (['detention_padding', 'toll_inflation', 'weight_discrepancy'])[l_linenumber % 3 + 1] END AS anomaly_type,
        l_orderkey * 10 + l_linenumber AS invoice_seq, l_orderkey AS order_key, l_linenumber AS line_number, l_partkey AS part_key,
        l_suppkey AS carrier_key, l_quantity AS quantity, l_discount AS discount, l_tax AS tax FROM lineitem""",
    "f_inv_first": f"""SELECT * FROM f_inv_raw QUALIFY row_number() OVER (PARTITION BY invoice_id ORDER BY {", ".join(SUBMISSION_ORDER)}) = 1""",
    "f_inv": "SELECT * REPLACE (upper(vendor_id) AS vendor_id) FROM f_inv_first WHERE actual_billed_amount > 0",
    "f_ord_raw": f"""SELECT order_id, invoice_seq AS order_seq, upper(vendor_id) AS vendor_id, printf('HUB%02d', s_nationkey) AS origin_hub_id,
        printf('HUB%02d', c_nationkey) AS dest_hub_id, {_CATEGORY} AS product_category,
        CASE WHEN o_orderkey % 50 = 0 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN o_orderkey % 997 = 1 THEN 'unknown'
             ELSE strftime(o_orderdate, '%Y-%m-%d') END AS order_date,
        weight_kg * CASE WHEN part_key % 300 = 1 THEN 1000.0::DOUBLE ELSE 1.0::DOUBLE END AS weight_kg,
        p_size::DOUBLE * 6 + 100 AS length_cm, p_size::DOUBLE * 2 + 100 AS width_cm, p_size::DOUBLE + 100 AS height_cm,
        CASE WHEN part_key % 250 <> 7 THEN ((o_custkey * 3 + line_number) % 11)::DOUBLE END AS expected_weather_score,
        0.92::DOUBLE + (({_TYPE_RANK}) * 30 + part_key * 31 % 41)::DOUBLE / 1000.0::DOUBLE AS cost_factor
        FROM f_inv_first JOIN orders ON order_key = o_orderkey JOIN customer ON o_custkey = c_custkey
        JOIN supplier ON carrier_key = s_suppkey JOIN part ON part_key = p_partkey WHERE s_nationkey <> c_nationkey""",
    "f_ord_typed": f"""SELECT *, length_cm * width_cm * height_cm / 5000.0::DOUBLE AS dimensional_weight_kg,
        greatest(weight_kg, length_cm * width_cm * height_cm / 5000.0::DOUBLE) AS billable_weight_kg, {truck('weight_kg')} AS truck_type
        FROM (SELECT * REPLACE (coalesce(try_strptime(order_date, '%Y-%m-%d'), try_strptime(order_date, '%d-%m-%Y'))::DATE AS order_date,
              CASE WHEN weight_kg > 30000 THEN round(weight_kg / 1000, 1) ELSE weight_kg END AS weight_kg) FROM f_ord_raw)""",
    "f_month": "SELECT month(order_date) AS m, median(expected_weather_score) AS med FROM f_ord_typed WHERE order_date IS NOT NULL GROUP BY 1",
    "f_ord_clean": """SELECT f_ord_typed.* REPLACE (coalesce(expected_weather_score, med,
        (SELECT median(expected_weather_score) FROM f_ord_typed)) AS expected_weather_score)
        FROM f_ord_typed LEFT JOIN f_month ON month(order_date) = m""",
    "f_fuel": """SELECT state, d AS price_date, round(84.0::DOUBLE + date_diff('day', DATE '1995-01-01', d) % 365 / 50.0::DOUBLE
        + length(state) * 0.25::DOUBLE + (s % 40)::DOUBLE / 20.0::DOUBLE, 2) AS diesel_price_per_litre FROM (
        SELECT state, o_orderdate::DATE AS d, sum(o_custkey)::BIGINT AS s FROM orders
        JOIN f_hubs ON hub_id = printf('HUB%02d', o_custkey % 25) GROUP BY 1, 2)""",
    "f_daymed": "SELECT price_date, median(diesel_price_per_litre) AS median_price FROM f_fuel GROUP BY 1",
    "f_weather": """SELECT printf('HUB%02d', k) AS hub_id, d AS day, CASE WHEN b % 67 <> 0 THEN (a % 97)::DOUBLE * 0.25::DOUBLE END AS precip,
        (b % 61)::DOUBLE * 0.8::DOUBLE AS wind, 20.0::DOUBLE + (c % 57)::DOUBLE * 0.5::DOUBLE AS temp FROM (
        SELECT l_suppkey % 25 AS k, l_shipdate::DATE AS d, sum(l_quantity::BIGINT * 7 + l_linenumber)::BIGINT AS a,
        sum(l_partkey)::BIGINT AS b, sum(l_orderkey)::BIGINT AS c FROM lineitem GROUP BY 1, 2)""",
    "f_routed": """SELECT c.*, ho.city AS origin_city, ho.state AS origin_state, hd.city AS dest_city, hd.state AS dest_state, ho.state AS state,
        r.distance_km, r.ideal_days, round(r.ideal_days * 1.15::DOUBLE, 1) AS quoted_days FROM f_ord_clean c
        LEFT JOIN f_hubs ho ON ho.hub_id = c.origin_hub_id LEFT JOIN f_hubs hd ON hd.hub_id = c.dest_hub_id
        LEFT JOIN f_routes r ON r.origin_hub_id = least(c.origin_hub_id, c.dest_hub_id) AND r.dest_hub_id = greatest(c.origin_hub_id, c.dest_hub_id)""",
    "f_asof": """SELECT o.*, CASE WHEN order_date - f.price_date <= 7 THEN f.diesel_price_per_litre END AS asof_price,
        CASE WHEN order_date - f.price_date <= 7 THEN f.price_date END AS asof_date
        FROM f_routed o ASOF LEFT JOIN f_fuel f ON o.state = f.state AND o.order_date >= f.price_date""",
    "f_ord": f"""SELECT *, {BASELINE} AS baseline_cost, {BASELINE} * cost_factor AS base_freight_cost FROM (
        SELECT a.*, coalesce(asof_price, median_price, (SELECT median(median_price) FROM f_daymed)) AS expected_fuel_price
        FROM f_asof a LEFT JOIN f_daymed m ON a.order_date = m.price_date)""",
    "f_hist": f"""SELECT invoice_id, vendor_id, received_at, coalesce(prior_total, 0)::BIGINT AS prior_total, coalesce(prior_flagged, 0)::BIGINT AS prior_flagged
        FROM (SELECT *, {HISTORY} FROM f_inv
        WINDOW w AS (PARTITION BY vendor_id ORDER BY received_at, invoice_seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))""",
    "f_fair": """SELECT i.*, o.* EXCLUDE (order_id, vendor_id, weight_kg, order_seq), o.weight_kg AS order_weight_kg, o.baseline_cost AS fair_cost,
        o.baseline_cost * 0.97::DOUBLE AS fair_lower, o.baseline_cost * 1.03::DOUBLE AS fair_upper,
        actual_days - ideal_days AS true_delay_days, actual_days - quoted_days AS commercial_delay_days,
        actual_billed_amount - o.baseline_cost AS cost_mismatch, quoted_days / greatest(ideal_days, 0.1) AS vendor_padding_ratio
        FROM f_inv i JOIN f_ord o ON i.order_id = o.order_id""",
    "f_checked": """SELECT *, CASE WHEN fair_cost <= 0 THEN 'invalid' WHEN fair_cost / greatest(distance_km, 1.0) < 7.71 THEN 'too_low'
        WHEN fair_cost / greatest(distance_km, 1.0) > 83.29 THEN 'too_high' ELSE 'ok' END AS prediction_status,
        CASE WHEN actual_billed_amount <= 0 THEN 'invalid' WHEN actual_billed_amount < fair_lower * 0.724::DOUBLE THEN 'too_low'
        WHEN actual_billed_amount - fair_upper > 18554 OR actual_billed_amount > fair_upper * 22.789::DOUBLE THEN 'too_high' ELSE 'ok' END AS billed_status,
        round(actual_billed_amount / greatest(fair_cost, 1.0), 3) AS billed_ratio FROM f_fair""",
    "f_priced": """SELECT *, prediction_status <> 'ok' OR billed_status <> 'ok' AS flagged,
        CASE WHEN prediction_status <> 'ok' OR billed_status <> 'ok' THEN 'logic_check' END AS flag_source FROM f_checked""",
    "f_log": """SELECT id, created_at, 'table' AS extractor_used, gate_reason IS NULL AS gate_passed, gate_reason, order_id, vendor_id, billed_amount,
        round(k / 100.0::DOUBLE, 2) AS model2_proba, gate_reason IS NULL AND k >= 50 AS flagged, k % 5 = 0 AS manual FROM (
        SELECT event_id AS id, ts AS created_at, CASE event_type WHEN 'signup' THEN 'missing_critical_field:total,actual_days'
        WHEN 'error' THEN 'arithmetic_mismatch' END AS gate_reason, printf('ORD%06d', event_id) AS order_id, printf('VEN%03d', user_id) AS vendor_id,
        value AS billed_amount, (props::JSON ->> '$.k')::INTEGER AS k FROM events)""",
    "f_ext": """SELECT invoice_id, order_id, CASE WHEN invoice_seq % 37 <> 0 THEN vendor_id END AS vendor_id, received_at AS invoice_date, invoice_seq,
        'nation_' || (part_key % 30)::VARCHAR AS origin, 'NATION_' || (order_key % 25)::VARCHAR AS destination,
        CASE WHEN invoice_seq % 41 <> 0 THEN actual_days ELSE 0 END AS actual_days, CASE WHEN invoice_seq % 43 <> 0 THEN weight_kg END AS weight_kg,
        CASE WHEN invoice_seq % 19 <> 0 THEN round(actual_billed_amount - p_toll - p_det, 2) ELSE actual_billed_amount END AS freight_base,
        p_det AS detention, CASE WHEN invoice_seq % 13 <> 0 THEN p_toll END AS toll, actual_billed_amount AS total, requires_manual_review, anomaly_type
        FROM (SELECT *, round(actual_days * 350 * 1.75::DOUBLE, 2) AS p_toll, round(quantity % 4 * 500.0::DOUBLE, 2) AS p_det FROM f_inv)""",
    "f_gated": """SELECT *, reason AS gate_reason, reason IS NULL AS gate_passed FROM (SELECT *, CASE
        WHEN missing <> '' THEN 'missing_critical_field:' || missing
        WHEN abs(freight_base + detention + toll - total) > greatest(2.0, total * 0.02::DOUBLE) THEN 'arithmetic_mismatch'
        WHEN NOT (total > 500 AND total <= 250000) THEN 'amount_out_of_plausible_range'
        WHEN NOT (actual_days BETWEEN 0.2 AND 30) THEN 'days_out_of_plausible_range' END AS reason FROM (
        SELECT *, concat_ws(',', CASE WHEN coalesce(order_id, '') = '' THEN 'order_id' END, CASE WHEN coalesce(vendor_id, '') = '' THEN 'vendor_id' END,
        CASE WHEN coalesce(total, 0) = 0 THEN 'total' END, CASE WHEN coalesce(actual_days, 0) = 0 THEN 'actual_days' END) AS missing FROM f_ext))""",
}


def _documents_cte() -> str:
    m = "printf('%.2f', {})".format
    truth = {
        "invoice_id": "invoice_id", "order_id": "order_id", "vendor_id": "vendor_id", "invoice_date": "strftime(received_at, '%d-%m-%Y')",
        "origin": "'NATION_' || (part_key % 25)::VARCHAR", "destination": "'Navi-' || (order_key % 25)::VARCHAR",
        "freight_base": m("round(actual_billed_amount - p_toll - p_det, 2)"), "detention": m("p_det"),
        "toll": f"CASE WHEN q % 13 <> 0 THEN {m('p_toll')} END", "total": m("actual_billed_amount"),
        "weight_kg": "(weight_kg::BIGINT)::VARCHAR", "actual_days": m("actual_days")}
    seen = {
        "invoice_id": "CASE WHEN q % 6 = 0 THEN lower(gt_invoice_id) ELSE gt_invoice_id END",
        "order_id": "CASE WHEN q % 11 = 0 THEN 'ORD' || translate(substr(gt_order_id, 4, 20), '0', 'O') ELSE ' ' || gt_order_id END",
        "vendor_id": "CASE WHEN q % 17 <> 0 THEN gt_vendor_id END",
        "invoice_date": "CASE q % 3 WHEN 0 THEN strftime(received_at, '%Y-%m-%d') WHEN 1 THEN strftime(received_at, '%-d %b %Y') ELSE gt_invoice_date END",
        "origin": "CASE WHEN q % 7 = 0 THEN 'somewhere' ELSE lower(gt_origin) END", "destination": "replace(gt_destination, '-', ' ') || ' '",
        "freight_base": "CASE WHEN q % 19 <> 0 THEN '₹' || gt_freight_base END", "detention": "'Rs. ' || gt_detention",
        "toll": "CASE WHEN q % 13 = 0 THEN CASE WHEN q % 2 = 0 THEN '120.00' END ELSE gt_toll END",
        "total": f"CASE WHEN q % 23 = 0 THEN 'unreadable' WHEN q % 29 = 0 THEN {m('actual_billed_amount * 2')} ELSE 'INR ' || gt_total END",
        "weight_kg": "gt_weight_kg || ' kg'", "actual_days": "CASE WHEN q % 31 = 0 THEN '0.0' ELSE gt_actual_days || ' days' END"}
    inner = ", ".join(f"{e} AS gt_{n}" for n, e in truth.items())
    outer = ", ".join(f"{e} AS pred_{n}" for n, e in seen.items())
    return (f"SELECT doc_id, layout, q AS doc_seq, {', '.join('gt_' + n for n in truth)}, {outer} FROM (SELECT *, invoice_id AS doc_id, "
            f"'layout_' || (q % 7)::VARCHAR AS layout, {inner} FROM (SELECT *, invoice_seq AS q, "
            "round(actual_days * 350 * 1.75::DOUBLE, 2) AS p_toll, round(quantity % 4 * 500.0::DOUBLE, 2) AS p_det FROM f_inv))")


CTES["f_docs"] = _documents_cte()
CTES["f_cells"] = ("SELECT doc_id, layout, unnest([" + ", ".join(
    f"{{'field': '{f}', 'status': {status(k, 'gt_' + f, 'pred_' + f)}}}" for f, k in C.CORE_FIELDS.items())
    + "], recursive := true) FROM f_docs")


def _gate_reasons() -> str:
    def val(f, kind):
        return f"({tri('pred_' + f, kind)}).value"
    vals = ", ".join([f"{val('order_id', 'id')} AS v_order", f"{val('vendor_id', 'id')} AS v_vendor", f"{val('total', 'amount')} AS v_total",
                      f"{val('actual_days', 'number')} AS v_days", f"{val('freight_base', 'amount')} AS v_base",
                      f"{val('detention', 'amount')} AS v_det", f"{val('toll', 'amount')} AS v_toll"])
    reasons = """list_filter([CASE WHEN v_order IS NULL THEN 'missing:order_id' END, CASE WHEN v_vendor IS NULL THEN 'missing:vendor_id' END,
        CASE WHEN v_total IS NULL THEN 'missing:total' END, CASE WHEN v_days IS NULL THEN 'missing:actual_days' END,
        CASE WHEN v_total IS NOT NULL AND v_base IS NULL THEN 'arithmetic_uncheckable' END,
        CASE WHEN abs(v_base + coalesce(v_det, 0) + coalesce(v_toll, 0) - v_total) > greatest(2.0, v_total * 0.02::DOUBLE) THEN 'arithmetic_mismatch' END,
        CASE WHEN NOT (v_total > 500 AND v_total <= 250000) THEN 'total_out_of_bounds' END,
        CASE WHEN NOT (v_days BETWEEN 0.2 AND 30) THEN 'days_out_of_bounds' END], lambda x: x IS NOT NULL)"""
    return f"SELECT doc_id, {reasons} AS reasons FROM (SELECT doc_id, {vals} FROM f_docs)"


CTES["f_reasons"] = _gate_reasons()
CTES["f_docacc"] = f"""SELECT doc_id, layout, accuracy, critical_ok, reasons, len(reasons) = 0 AS gate_passed FROM (
    SELECT doc_id, layout, avg((status IN ('correct', 'correct_null'))::INTEGER) AS accuracy,
    bool_and(status IN ('correct', 'correct_null') OR field NOT IN ({in_list(C.CRITICAL_FIELDS)})) AS critical_ok FROM f_cells GROUP BY 1, 2)
    JOIN f_reasons USING (doc_id)"""
CTES["f_pts"] = """SELECT *, CASE WHEN precip > 20 THEN 2 ELSE 0 END + CASE WHEN wind > 40 THEN 3 ELSE 0 END + CASE WHEN temp > 45 THEN 2 ELSE 0 END AS pts,
    CASE WHEN precip > 20 THEN 1 ELSE 0 END AS wet FROM f_weather"""
TRANSIT = "greatest(1, round_even(actual_days + 0.49::DOUBLE, 0)::INTEGER)"
CTES["f_inv_win"] = f"""SELECT i.*, o.dest_hub_id, i.received_at - {TRANSIT} AS window_start, i.received_at AS window_end
    FROM f_inv i JOIN f_ord_raw o ON i.order_id = o.order_id"""
CTES["f_inv_wx"] = """SELECT i.invoice_id, coalesce(sum(pts), 0)::BIGINT AS weather_score, coalesce(sum(wet), 0)::BIGINT AS adverse_weather_days,
    count(w.day) AS covered_days FROM f_inv_win i LEFT JOIN f_weather_pts w ON w.hub_id = i.dest_hub_id AND w.day BETWEEN i.window_start AND i.window_end
    GROUP BY 1""".replace("f_weather_pts", "f_pts")
CTES["f_series"] = f"""SELECT 'fuel_diesel' AS series, state AS key, day AS date, last_value(p IGNORE NULLS) OVER (PARTITION BY state ORDER BY day) AS value FROM (
    SELECT state, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS day FROM (SELECT state, min(price_date) AS lo, max(price_date) AS hi FROM f_fuel GROUP BY 1))
    LEFT JOIN (SELECT state, price_date AS day, diesel_price_per_litre AS p FROM f_fuel) USING (state, day)"""
CTES["f_weekly"] = """SELECT hub_id, week, coalesce(p, 0) AS precip, t AS temp FROM (
    SELECT hub_id, unnest(generate_series(lo, hi, INTERVAL 7 DAY))::DATE AS week FROM (
        SELECT hub_id, min(date_trunc('week', day)::DATE + 6) AS lo, max(date_trunc('week', day)::DATE + 6) AS hi FROM f_weather GROUP BY 1))
    LEFT JOIN (SELECT hub_id, date_trunc('week', day)::DATE + 6 AS week, sum(precip) AS p, avg(temp) AS t FROM f_weather GROUP BY 1, 2) USING (hub_id, week)"""
CTES["f_temp_series"] = "SELECT 'weather_temp' AS series, hub_id AS key, week AS date, temp AS value FROM f_weekly"


def with_view(body: str) -> str:
    """Prefix the query with the CTEs it needs, in dependency order."""
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in re.findall(r"\bf_[a-z_]+\b", text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)
    visit(body)
    if not needed:
        return body
    prefix = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in needed)
    joiner = ",\n" if re.match(r"\s*WITH\s", body) else "\n"
    tail = re.sub(r"^\s*WITH\s", "", body) if joiner.startswith(",") else body
    return f"WITH {prefix}{joiner}{tail}"
