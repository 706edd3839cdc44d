"""Normalisers for extracted invoice text."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import constants as C

# a plain decimal number; everything else counts as unreadable
_NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def _to_double(text: Column) -> Column:
    return F.when(text.rlike(_NUMBER), text.try_cast("double"))


def _made_once(made: Column, use) -> Column:
    """``use(made)``, with ``made`` computed once however often ``use`` names it."""
    return F.transform(F.array(made), use)[0]


# the digits of a plain number between what may stand around it
_DIGITS = r"([+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?)"


def _double_of(text: Column, simple: str, bare: Column) -> Column:
    """Number of the text that ``bare`` strips. What ``simple`` matches, one number with its unit, is read by one match; only other
    texts, where the match gives an empty text and so no number, are stripped."""
    return F.coalesce(F.regexp_extract(text, simple, 1).try_cast("double"), _made_once(bare, _to_double))


def fix_glyphs(text: Column) -> Column:
    return F.translate(text, C.GLYPHS_READ, C.GLYPHS_MEANT)


def null_tokens(text: Column) -> Column:
    """Trimmed text; the spellings of "nothing" become NULL."""
    clean = F.trim(text)
    return F.when(~F.lower(clean).isin(C.NULL_TOKENS), clean)


def parse_number(text: Column) -> Column:
    """Number out of scanned text, repairing letters read in place of digits."""
    clean = null_tokens(text)
    repaired = F.when(clean.rlike("[0-9]"), fix_glyphs(clean)).otherwise(clean)
    return _to_double(F.regexp_replace(repaired, r"[^0-9.\-]", ""))


# a number that consists of digits, dots and hyphens alone
_BARE_NUMBER = r"^-?[0-9]+\.?[0-9]*\z"


def parse_number_simple(text: Column) -> Column:
    return F.when(text.rlike(_BARE_NUMBER), text.try_cast("double")).otherwise(
        _made_once(F.regexp_replace(text, r"[^0-9.\-]", ""), _to_double))


def canonical_id(text: Column, prefix: str, digits: int) -> Column:
    """``inv 123`` -> ``INV000123``; ids of another family are only cleaned."""
    clean = F.regexp_replace(F.upper(null_tokens(text)), r"\s+", "")
    number = F.regexp_replace(fix_glyphs(clean.substr(F.lit(len(prefix) + 1), F.length(clean))), "[^0-9]", "")
    stripped = F.regexp_replace(number, "^0+(?!$)", "")
    padded = F.when(F.length(stripped) >= digits, stripped).otherwise(F.lpad(stripped, digits, "0"))
    return (F.when(~clean.startswith(prefix), clean)
            .when(number == "", F.trim(text))
            .otherwise(F.concat(F.lit(prefix), padded)))


def map_category(text: Column) -> Column:
    """One of the known categories, or NULL."""
    known = F.create_map(*[F.lit(x) for c in C.PRODUCT_CATEGORIES for x in (c.lower(), c)])
    return F.try_element_at(known, F.lower(F.trim(text)))


def map_truck(text: Column) -> Column:
    """``10 wheeler`` and ``10`` -> ``10-wheeler``; unknown text stays as it is."""
    slug = F.regexp_replace(F.lower(F.trim(text)), r"[\s_]+", "-")
    spellings = {s: t for t in C.TRUCK_TYPES for s in (t, t.split("-")[0])}
    known = F.create_map(*[F.lit(x) for kv in spellings.items() for x in kv])
    return F.coalesce(F.try_element_at(known, slug), text)


# ---- tri-state normalisers: struct(status: ok | null | bad, value) -----------------

def _tri(blank: Column, value: Column) -> Column:
    status = F.when(blank, "null").when(value.isNull(), "bad").otherwise("ok")
    return F.struct(status.alias("status"), F.when(~blank, value).alias("value"))


def blank(text: Column) -> Column:
    return text.isNull() | (F.trim(text) == "")


# values of readable texts; of a blank text they are NULL or empty

def amount_value(text: Column) -> Column:
    return F.round(_double_of(text, rf"^(?:(?i:rs\.?|inr)|₹)? *{_DIGITS}\z", F.regexp_replace(text, r"(?i)(rs\.?|inr|₹|[, ])", "")), 2)


def number_value(text: Column) -> Column:
    bare = F.trim(F.replace(F.regexp_replace(text, r"(?i)(kgs?|days?)", ""), F.lit(","), F.lit("")))
    return F.round(_double_of(text, rf"^{_DIGITS} *(?i:kgs?|days?)?\z", bare), 3)


def date_value(text: Column) -> Column:
    from lanewise.functions.dates import first_parse
    return F.date_format(first_parse(text, C.DOCUMENT_DATE_PATTERNS), "yyyy-MM-dd")


def text_value(text: Column) -> Column:
    words = F.trim(F.regexp_replace(F.lower(text), "[^0-9a-z\\u0900-\\u097F]+", " "))
    return _made_once(words, lambda w: F.nullif(w, F.lit("")))


def id_value(text: Column) -> Column:
    return F.upper(F.when(text.rlike(r"\s"), F.regexp_replace(text, r"\s+", "")).otherwise(text))


VALUES = {"amount": amount_value, "number": number_value, "date": date_value, "text": text_value, "id": id_value, "gstin": id_value}


def norm_amount(text: Column) -> Column:
    return _tri(blank(text), amount_value(text))


def norm_number(text: Column) -> Column:
    return _tri(blank(text), number_value(text))


def norm_date(text: Column) -> Column:
    return _tri(blank(text), date_value(text))


def norm_text(text: Column) -> Column:
    value = text_value(text)
    return _tri(value.isNull(), value)


def norm_id(text: Column) -> Column:
    return _tri(blank(text), id_value(text))


NORMALISERS = {"amount": norm_amount, "number": norm_number, "date": norm_date,
               "text": norm_text, "id": norm_id, "gstin": norm_id}


def values_equal(kind: str, a: Column, b: Column, tolerance: float = 0.01) -> Column:
    """Equality of two normalised structs; unreadable values equal nothing."""
    same = (F.abs(a["value"] - b["value"]) <= tolerance) if kind in ("amount", "number") \
        else a["value"] == b["value"]
    return F.coalesce((a["status"] == "ok") & (b["status"] == "ok") & same, F.lit(False))


def field_status(kind: str, t: Column, p: Column) -> Column:
    """correct | correct_null | hallucinated | missing | wrong for one normalised field."""
    return (F.when(t["status"] == "null", F.when(p["status"] == "null", "correct_null").otherwise("hallucinated"))
            .when(p["status"] == "null", "missing")
            .when(values_equal(kind, t, p), "correct").otherwise("wrong"))


def field_match(numeric: bool, truth: Column, predicted: Column) -> Column:
    """Benchmark comparison: 0.02 or 0.1 % for numbers, case and spaces ignored for text."""
    if numeric:
        both = F.struct(parse_number_simple(truth).alias("t"), parse_number_simple(predicted).alias("p"))
        same = _made_once(both, lambda n: F.abs(n["t"] - n["p"]) <= F.greatest(F.lit(0.02), F.abs(n["t"]) * 0.001))
    else:
        def bare(x):
            return F.lower(F.regexp_replace(x, r"\s+", ""))
        same = bare(truth) == bare(predicted)
    return F.coalesce(same, F.lit(False))


def salvage_json(text: Column) -> Column:
    """The outermost JSON object inside a chatty reply, or NULL."""
    quiet = F.regexp_replace(text, r"(?s)<think>.*?</think>", "")
    unfenced = F.regexp_replace(quiet, r"```(json)?", "")
    return F.nullif(F.regexp_extract(unfenced, r"(?s)\{.*\}", 0), F.lit(""))


def indian_grouping(value: Column) -> Column:
    """1234567.5 -> 12,34,567.50"""
    plain = F.regexp_replace(F.format_number(F.abs(value), 2), ",", "")
    whole = F.regexp_replace(F.substring_index(plain, ".", 1), r"(\d)(?=(\d\d)*\d{3}$)", "$1,")
    sign = F.when(value < 0, "-").otherwise("")
    return F.concat(sign, whole, F.lit("."), F.substring_index(plain, ".", -1))


def money_text(value: Column, decimals: int = 0) -> Column:
    """Rupees with a real minus sign; an em dash for nothing."""
    body = F.concat(F.lit("₹"), F.format_number(F.abs(value), decimals))
    return F.when(value.isNull(), "—").when(value < 0, F.concat(F.lit("−"), body)).otherwise(body)


def signed_pct(value: Column) -> Column:
    sign = F.when(value < 0, "−").otherwise("+")
    return F.concat(sign, F.format_number(F.abs(value), 1), F.lit("%"))


def pct_text(value: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_number(value * 100, decimals), F.lit("%"))


def state_key(state: Column) -> Column:
    """Lower-case state name in the spelling the price tables use."""
    aliases = F.create_map(*[F.lit(x) for kv in C.STATE_ALIASES.items() for x in kv])
    key = F.lower(state)
    return F.coalesce(F.try_element_at(aliases, key), key)


def falsy(text: Column) -> Column:
    """Missing the way a scripting language sees it: NULL, '' or a zero number."""
    return text.isNull() | (text == "")


def falsy_number(value: Column) -> Column:
    return value.isNull() | F.isnan(value) | (value == 0)
