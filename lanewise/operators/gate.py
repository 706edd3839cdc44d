"""Validation gates for extracted invoices."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lanewise import constants as C
from lanewise.functions import dates, text


def normalise_invoice(df: DataFrame) -> DataFrame:
    """Typed, canonical fields from raw extracted text."""
    out = {f: text.null_tokens(F.col(f)) for f in C.INVOICE_FIELDS}
    out |= {f: text.parse_number(F.col(f)) for f in C.NUMERIC_FIELDS}
    out |= {f: text.canonical_id(F.col(f), *C.ID_FORMATS[f]) for f in C.ID_FORMATS}
    out |= {"invoice_date": dates.parse_invoice_date(out["invoice_date"]),
            "product_category": text.map_category(out["product_category"]),
            "truck_type": text.map_truck(out["truck_type"])}
    return df.withColumns({n: c for n, c in out.items() if n in df.columns})


def _missing(field: str, value: Column, dtype: str) -> Column:
    empty = text.falsy(value) if dtype == "string" else text.falsy_number(value)
    return F.when(empty, field)


def _number(df: DataFrame, field: str) -> Column:
    value = F.col(field)
    return value if dict(df.dtypes)[field] != "string" else text.parse_number_simple(value)


def _drift(parts: Column, total: Column) -> Column:
    return F.abs(parts - total) > F.greatest(F.lit(C.GATE_DRIFT_ABS), total * C.GATE_DRIFT_REL)


def confidence_gate(df: DataFrame, allow_new_orders: bool = True, allow_new_vendors: bool = True) -> DataFrame:
    """Adds gate_passed and gate_reason; the first failing tier gives the reason.

    With allow_new_* False the frame must carry boolean order_known / vendor_known
    columns (see enrich.add_existence).
    """
    types = dict(df.dtypes)
    missing = F.array_compact(F.array(*[_missing(f, F.col(f), types[f]) for f in C.CRITICAL_FIELDS]))
    total, days = _number(df, "total"), _number(df, "actual_days")
    parts = _number(df, "freight_base") + _number(df, "detention") + _number(df, "toll")
    tiers = [F.when(F.size(missing) > 0, F.concat(F.lit("missing_critical_field:"), F.concat_ws(",", missing)))]
    if not allow_new_orders:
        tiers.append(F.when(~F.col("order_known"), "order_id_not_found"))
    if not allow_new_vendors:
        tiers.append(F.when(~F.col("vendor_known"), "vendor_id_not_found"))
    tiers += [
        F.when(total.isNull() | days.isNull(), "unparseable_amount_or_days"),
        F.when(_drift(parts, total), "arithmetic_mismatch"),
        F.when(outside(total, "total"), "amount_out_of_plausible_range"),
        F.when(outside(days, "actual_days"), "days_out_of_plausible_range"),
    ]
    return (df.withColumn("gate_reason", F.coalesce(*tiers))
            .withColumn("gate_passed", F.col("gate_reason").isNull()))


#: field -> (lowest, highest, lowest included)
LIMITS = {"total": (C.GATE_TOTAL_ABOVE, C.GATE_TOTAL_MAX, False), "actual_days": (C.GATE_DAYS_MIN, C.GATE_DAYS_MAX, True)}
LIMIT_CODES = {"total": "total_out_of_bounds", "actual_days": "days_out_of_bounds"}


def outside(value: Column, field: str, limits: dict = LIMITS) -> Column:
    low, high, closed = limits[field]
    return ~((value >= low if closed else value > low) & (value <= high))


GATE_NORMALISERS = {"order_id": text.norm_id, "vendor_id": text.norm_id, "total": text.norm_amount,
                    "actual_days": text.norm_number, "freight_base": text.norm_amount,
                    "detention": text.norm_amount, "toll": text.norm_amount}


def gate_all_reasons(df: DataFrame, prefix: str = "", order_known: Column | None = None, vendor_known: Column | None = None, **rules) -> DataFrame:
    """Adds ``reasons``: every failed check over raw text fields (named ``prefix + field``)."""
    staged = df.withColumns({f"_n_{f}": norm(F.col(prefix + f))["value"] for f, norm in GATE_NORMALISERS.items()})
    out = staged.withColumn("reasons", reasons_of("_n_", order_known, vendor_known, **rules))
    return out.drop(*[f"_n_{f}" for f in GATE_NORMALISERS])


def reasons_of(prefix: str, order_known: Column | None = None, vendor_known: Column | None = None, required: list[str] = tuple(C.CRITICAL_FIELDS),
               limits: dict = LIMITS, need_parts: bool = True) -> Column:
    """Array of failed checks from normalised values named ``prefix + field``: presence, known ids, sums, limits."""
    values = {f: F.col(f"{prefix}{f}") for f in GATE_NORMALISERS}
    checks = [(f"missing:{f}", values[f].isNull()) for f in required]
    for field, known in (("order_id", order_known), ("vendor_id", vendor_known)):
        if known is not None:
            checks.append((f"unknown_{field}", values[field].isNotNull() & ~known))
    base, total = values["freight_base"], values["total"]
    if need_parts:
        checks.append(("arithmetic_uncheckable", total.isNotNull() & base.isNull()))
    extras = [F.coalesce(values[f], F.lit(0.0)) for f in ("detention", "toll")]
    checks.append(("arithmetic_mismatch", _drift(base + extras[0] + extras[1], total)))
    checks += [(LIMIT_CODES[f], outside(values[f], f, limits)) for f in limits]
    return F.array_compact(F.array(*[F.when(failed, code) for code, failed in checks]))


def field_issues(booked_vendor: Column) -> Column:
    """Map field -> issue the reviewer should see; it never blocks. Typed fields."""
    total, days = F.col("total"), F.col("actual_days")
    parts = F.col("freight_base") + F.col("detention") + F.col("toll")
    drift = F.coalesce(_drift(parts, total), F.lit(False))
    issues = {
        "vendor_id": F.when(booked_vendor != F.col("vendor_id"), "carrier_mismatch"),
        "total": F.when(drift, "line_items_drift").when(outside(total, "total"), "total_out_of_range"),
        "actual_days": F.when(outside(days, "actual_days"), "days_out_of_range"),
    }
    full = F.create_map(*[x for k, v in issues.items() for x in (F.lit(k), v)])
    return F.map_filter(full, lambda k, v: v.isNotNull())


def gate_error_fields(reason: Column) -> Column:
    """Fields to highlight for a gate reason; a missing-field reason lists its own."""
    listed = F.create_map(*[x for k, v in C.GATE_ERROR_FIELDS.items()
                            for x in (F.lit(k), F.array(*[F.lit(f) for f in v]))])
    code = F.split_part(reason, F.lit(":"), F.lit(1))
    named = F.when(reason.contains(":"), F.split(F.split_part(reason, F.lit(":"), F.lit(2)), ","))
    return F.coalesce(F.try_element_at(listed, code), named, F.array().cast("array<string>"))


def missing_required(df: DataFrame) -> Column:
    """Required fields that are NULL or empty text; a zero is present."""
    types = dict(df.dtypes)
    return F.array_compact(F.array(*[
        F.when(F.col(f).isNull() | (F.col(f) == "" if types[f] == "string" else F.lit(False)), f)
        for f in C.REQUIRED_FIELDS]))


def manual_entry_fields(final: dict[str, Column], extracted: dict[str, Column]) -> Column:
    """Sorted names of fields present whose text differs from the extractor's value."""
    changed = [F.when(final[f].isNotNull() & (final[f].cast("string") != "")
                      & ~final[f].cast("string").eqNullSafe(extracted[f].cast("string")), f) for f in final]
    return F.array_sort(F.array_compact(F.array(*changed)))
