"""Domain constants, code lists and formats.

Everything here is data that has to be the same wherever invoices are audited:
rates, limits, field lists, reason codes, date formats. No logic lives here.
"""

# ---- cost build-up -------------------------------------------------------------
TRUCK_TYPES = ["6-wheeler", "10-wheeler", "12-wheeler"]
MILEAGE_KMPL = {"12-wheeler": 4.0, "10-wheeler": 4.6, "6-wheeler": 6.5}
TOLL_RATE_PER_KM = 1.75
DRIVER_ALLOWANCE_PER_DAY = 1200.0
VOLUMETRIC_DIVISOR = 5000.0
TRUCK_LIMITS_KG = (9000.0, 16000.0)
NEW_ORDER_TRUCK_LIMITS_KG = (7000.0, 14000.0)
GRAMS_ENTERED_ABOVE = 30000.0
DEFAULT_BAND = 0.03

PRODUCT_CATEGORIES = ["Steel Coils", "Automotive Spare Parts", "Industrial Chemicals",
                      "Bulk Textiles", "Electronics Components"]
DEFAULT_CATEGORY = "Automotive Spare Parts"
DEFAULT_STATE = "Maharashtra"

COST_NUMERIC_FEATURES = ["distance_km", "ideal_days", "quoted_days", "billable_weight_kg",
                         "expected_fuel_price", "expected_weather_score"]

# field: (lowest possible, highest possible)
INPUT_LIMITS = {
    "distance_km": (1.0, 6000.0),
    "billable_weight_kg": (1.0, 60000.0),
    "expected_fuel_price": (40.0, 250.0),
    "ideal_days": (0.01, 30.0),
    "quoted_days": (0.01, 45.0),
    "expected_weather_score": (0.0, 200.0),
}

PRICE_BOUNDS = {"cost_per_km_min": 7.71, "cost_per_km_max": 83.29, "billed_low_ratio": 0.724,
                "billed_high_ratio": 22.789, "billed_high_abs": 18554.0}
REFERENCE_DIESEL = 91.4753
FALLBACK_DIESEL = 91.5
FALLBACK_DIESEL_NEW_ORDER = 95.0
OFFSET_BASE_DIESEL = 90.5
DEFAULT_STATE_OFFSET = 2.5
FUEL_TOLERANCE_DAYS = 7

# ---- routes --------------------------------------------------------------------
EARTH_RADIUS_KM = 6371.0088
CIRCUITY = 1.30
KM_PER_IDEAL_DAY = 450.0
MIN_IDEAL_DAYS = 0.3

# ---- weather -------------------------------------------------------------------
HEAVY_RAIN_MM, HIGH_WIND_KMH, HEAT_C = 20.0, 40.0, 45.0
RAIN_POINTS, WIND_POINTS, HEAT_POINTS = 2, 3, 2
MAX_WINDOW_DAYS = 45

# ---- carrier history -----------------------------------------------------------
SMOOTHING, PRIOR_RISK = 2.0, 0.06
FALLBACK_PADDING = 1.164

# ---- risk model ----------------------------------------------------------------
RISK_THRESHOLD = 0.5
RISK_FEATURES_FULL = [
    "actual_billed_amount", "model_a_predicted_cost", "cost_mismatch", "actual_days",
    "true_delay_days", "commercial_delay_days", "adverse_weather_days",
    "vendor_padding_ratio", "vendor_historical_risk_score", "cost_mismatch_ratio",
    "cost_mismatch_upper", "cost_mismatch_upper_ratio", "billed_to_p90_ratio",
    "excess_rate_per_kg", "excess_rate_per_ton_km", "cost_mismatch_delay_skew",
    "zero_delay_p90_breach",
]
# without absolute rupee amounts
RISK_FEATURES_SCALE_FREE = [
    "actual_days", "true_delay_days", "commercial_delay_days", "adverse_weather_days",
    "vendor_padding_ratio", "vendor_historical_risk_score", "cost_mismatch_ratio",
    "cost_mismatch_upper_ratio", "billed_to_p90_ratio", "cost_mismatch_delay_skew",
    "zero_delay_p90_breach",
]
RISK_FEATURES_RUPEE = ["actual_billed_amount", "model_a_predicted_cost", "cost_mismatch",
                       "cost_mismatch_upper", "excess_rate_per_kg", "excess_rate_per_ton_km"]
# every feature that grows with the bill alone
RISK_FEATURES_RISING = [
    "actual_billed_amount", "cost_mismatch", "cost_mismatch_ratio", "cost_mismatch_upper",
    "cost_mismatch_upper_ratio", "billed_to_p90_ratio", "excess_rate_per_kg",
    "excess_rate_per_ton_km", "cost_mismatch_delay_skew", "zero_delay_p90_breach",
]
PRICE_RISE = 1.25

# ---- extracted invoices --------------------------------------------------------
INVOICE_FIELDS = ["invoice_id", "order_id", "vendor_id", "invoice_date", "origin", "destination",
                  "truck_type", "actual_days", "weight_kg", "freight_base", "detention", "toll",
                  "total", "vendor_gstin", "product_category"]
REQUIRED_FIELDS = ["invoice_id", "order_id", "vendor_id", "invoice_date", "actual_days",
                   "freight_base", "detention", "toll", "total"]
NUMERIC_FIELDS = ["actual_days", "weight_kg", "freight_base", "detention", "toll", "total"]
CRITICAL_FIELDS = ["order_id", "vendor_id", "total", "actual_days"]
ID_FORMATS = {"invoice_id": ("INV", 6), "order_id": ("ORD", 6), "vendor_id": ("VEN", 3)}
NULL_TOKENS = ["", "null", "none", "n/a", "na", "-"]
GLYPHS_READ, GLYPHS_MEANT = "OolISBZ", "0011582"

CORE_FIELDS = {
    "invoice_id": "id", "order_id": "id", "vendor_id": "id", "invoice_date": "date",
    "origin": "text", "destination": "text", "freight_base": "amount", "detention": "amount",
    "toll": "amount", "total": "amount", "weight_kg": "number", "actual_days": "number",
}
EXTENDED_FIELDS = {
    "vendor_name": "text", "buyer_name": "text", "vendor_gstin": "gstin", "buyer_gstin": "gstin",
    "lr_number": "id", "eway_bill_no": "id", "vehicle_no": "id", "hsn_sac": "id",
    "cgst": "amount", "sgst": "amount", "igst": "amount", "currency": "text",
}
LINE_ITEM_FIELDS = {"description": "text", "quantity": "number", "unit": "text",
                    "rate": "amount", "amount": "amount"}
DOCUMENT_META_KEYS = ["doc_id", "layout", "source", "image", "path", "split"]

# date patterns, first one that parses wins
INVOICE_DATE_PATTERNS = ["d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy-M-d", "d-M-yy", "d/M/yy",
                         "d MMM yyyy", "d MMMM yyyy", "d-MMM-yyyy", "MMM d, yyyy"]
ANY_DATE_PATTERNS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy"]
DOCUMENT_DATE_PATTERNS = ["yyyy-M-d", "d-M-yyyy", "d/M/yyyy", "d.M.yyyy", "d MMM yyyy",
                          "d-MMM-yyyy", "d MMMM yyyy", "d-MMM-yy", "d/M/yy", "yyyy/M/d",
                          "MMM d, yyyy"]

# ---- gate ----------------------------------------------------------------------
GATE_TOTAL_ABOVE, GATE_TOTAL_MAX = 500.0, 250000.0
GATE_DAYS_MIN, GATE_DAYS_MAX = 0.2, 30.0
GATE_DRIFT_ABS, GATE_DRIFT_REL = 2.0, 0.02
GATE_ERROR_FIELDS = {
    "order_id_not_found": ["order_id"],
    "vendor_id_not_found": ["vendor_id"],
    "unparseable_amount_or_days": ["total", "actual_days"],
    "arithmetic_mismatch": ["freight_base", "detention", "toll", "total"],
    "amount_out_of_plausible_range": ["total"],
    "days_out_of_plausible_range": ["actual_days"],
}

# ---- invoice rendering, bands, states ---------------------------------------------
DETENTION_PER_DAY, DETENTION_MAX_SHARE = 1500.0, 0.35
STATE_ALIASES = {"chhattisgarh": "chhatisgarh", "delhi ncr": "delhi"}
BAND_FLAGGED, BAND_PENDING = 0.35, 0.15
DRIFT_LABELS = {
    "expected_fuel_price": ("diesel price", " Rs/L"),
    "expected_weather_score": ("weather severity", ""),
    "distance_km": ("distance", " km"),
    "billable_weight_kg": ("weight", " kg"),
}
