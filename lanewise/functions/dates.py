"""Date parsing and trip windows."""

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from lanewise import constants as C


# what each pattern letter can look like
_SHAPES = {"yyyy": "[0-9]{4}", "yy": "[0-9]{2}", "MMMM": "[A-Za-z]+", "MMM": "[A-Za-z]{3}",
           "M": "[0-9]{1,2}", "d": "[0-9]{1,2}", ".": r"\."}


def _shape(pattern: str) -> str:
    tokens = re.findall(r"yyyy|yy|MMMM|MMM|M|d|.", pattern)
    return "^" + "".join(_SHAPES.get(t, t) for t in tokens) + "$"


def _parse(text: Column, pattern: str) -> Column:
    # A parser that fails raises inside the JVM; the cheap shape test avoids most failures.
    parsed = F.when(text.rlike(_shape(pattern)), F.try_to_date(text, pattern))
    if "yyyy" in pattern:
        return parsed
    # Two-digit years 69-99 belong to the last century.
    return F.when(F.year(parsed) >= 2069, F.add_months(parsed, -1200)).otherwise(parsed).cast("date")


def first_parse(text: Column, patterns: list[str]) -> Column:
    """First pattern that parses wins; NULL when none does."""
    clean = F.trim(text)
    return F.coalesce(*[_parse(clean, p) for p in dict.fromkeys(patterns)])


def parse_invoice_date(text: Column) -> Column:
    """Canonical dd-MM-yyyy text; unreadable input is returned trimmed and unchanged."""
    return F.coalesce(F.date_format(first_parse(text, C.INVOICE_DATE_PATTERNS), "dd-MM-yyyy"),
                      F.trim(text))


def parse_any_date(text: Column, today: Column) -> Column:
    """Date of free text, day first; blank means ``today``."""
    blank = text.isNull() | (text == "")
    return F.when(blank, today).otherwise(
        first_parse(text, C.ANY_DATE_PATTERNS + C.INVOICE_DATE_PATTERNS))


def parse_order_date(text: Column) -> Column:
    """Mixed order-date text, day first; unparseable becomes NULL."""
    return first_parse(text, C.ANY_DATE_PATTERNS + C.DOCUMENT_DATE_PATTERNS)


def planned_window(start: Column, days: Column) -> tuple[Column, Column]:
    return start, F.date_add(start, F.ceil(days).cast("int"))


def transit_length(days: Column) -> Column:
    """Whole days a trip took: round-half-even of days + 0.49, never below one."""
    return F.greatest(F.lit(1), F.bround(days + F.lit(0.49), 0).cast("int"))


def transit_window(end: Column, days: Column) -> tuple[Column, Column]:
    return F.date_sub(end, transit_length(days)), end


def bounded_window(a: Column, b: Column) -> tuple[Column, Column]:
    """Put the two dates in order and cap the span."""
    start, end = F.least(a, b), F.greatest(a, b)
    return start, F.least(end, F.date_add(start, C.MAX_WINDOW_DAYS))
