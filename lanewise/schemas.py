"""Explicit schemas of the freight tables. Nothing is inferred from files."""

from pyspark.sql import types as T

_TYPES = {"s": T.StringType(), "d": T.DoubleType(), "i": T.IntegerType(), "l": T.LongType(),
          "D": T.DateType(), "t": T.TimestampType(), "b": T.BooleanType()}


def _table(columns: str) -> T.StructType:
    """``"hub_id:s latitude:d"`` -> StructType."""
    pairs = (c.split(":") for c in columns.split())
    return T.StructType([T.StructField(n, _TYPES[t], True) for n, t in pairs])


HUBS = _table("hub_id:s city:s state:s latitude:d longitude:d hub_category:s")
VENDORS = _table("vendor_id:s vendor_name:s home_state:s fleet_size:i onboarding_date:D")
COST_ASSUMPTIONS = _table("truck_type:s mileage_kmpl:d toll_rate_per_km:d "
                          "driver_allowance_per_day:i effective_from:D")
ROUTES = _table("origin_hub_id:s dest_hub_id:s distance_km:d osrm_duration_days:d "
                "buffered_ideal_days:d last_refreshed:D")
FUEL_PRICES = _table("price_date:D state:s diesel_price_per_litre:d source:s")
WEATHER_CACHE = _table("route_key:s window_start:D window_end:D precipitation_sum_json:s "
                       "windspeed_max_json:s temperature_max_json:s api_call_timestamp:t")
ORDERS = _table("order_id:s vendor_id:s origin_hub_id:s dest_hub_id:s product_category:s "
                "order_date:s weight_kg:d length_cm:d width_cm:d height_cm:d quoted_days:d "
                "ideal_days:d distance_km:d dimensional_weight_kg:d billable_weight_kg:d "
                "truck_type:s state:s expected_fuel_price:d expected_weather_score:d "
                "base_freight_cost:d model_a_predicted_cost:d oof_fold_id:i")
INVOICES = _table("invoice_id:s order_id:s vendor_id:s actual_billed_amount:d actual_days:d "
                  "adverse_weather_days:i cost_mismatch:d true_delay_days:d "
                  "commercial_delay_days:d vendor_padding_ratio:d "
                  "vendor_historical_risk_score:d requires_manual_review:i")
GROUND_TRUTH = _table("order_id:s anomaly_type:s requires_manual_review:i")
AUDIT_LOG = _table("id:l created_at:t filename:s extractor_used:s extracted_fields:s gate_passed:b "
                   "gate_reason:s order_id:s vendor_id:s model1_predicted_cost:d billed_amount:d "
                   "cost_mismatch:d model2_proba:d flagged:b explanation:s")
VENDOR_RUNNING_STATS = _table("vendor_id:s total_invoices:i flagged_invoices:i updated_at:t")
EXTRACTED_INVOICE = _table("invoice_id:s order_id:s vendor_id:s invoice_date:s origin:s "
                           "destination:s truck_type:s actual_days:s weight_kg:s freight_base:s "
                           "detention:s toll:s total:s vendor_gstin:s product_category:s")
FORECASTS = _table("series:s key:s date:D forecast:d")
BACKTEST = _table("mae:d smape:d rmse:d n:l skill:d series:s key:s order:s last_price:d test_var:d")

LINE_ITEM = T.StructType([T.StructField(n, T.StringType()) for n in
                          ("description", "quantity", "unit", "rate", "amount")])
DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.StringType()), T.StructField("layout", T.StringType()),
    T.StructField("fields", T.MapType(T.StringType(), T.StringType())),
    T.StructField("line_items", T.ArrayType(LINE_ITEM)),
])

REFERENCE_TABLES = {"hubs": HUBS, "vendors": VENDORS, "toll_and_cost_assumptions": COST_ASSUMPTIONS,
                    "route_distance_cache": ROUTES, "fuel_prices": FUEL_PRICES,
                    "weather_cache": WEATHER_CACHE, "orders": ORDERS, "invoices": INVOICES}
