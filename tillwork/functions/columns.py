"""Column expressions shared by the operators; all of them stay in generated JVM code."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tillwork.params import CANCEL_PREFIX, MONEY_SCALE, PRODUCT_EXCEPTIONS, PRODUCT_PATTERN


def strip_text(c: Column) -> Column:
    """Remove every leading and trailing white-space character, not only blanks."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def normal_code(c: Column) -> Column:
    return F.upper(strip_text(c))


def starts_with_any(c: Column, prefixes: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [c.startswith(p) for p in prefixes])


def is_cancellation(invoice: Column) -> Column:
    return invoice.startswith(CANCEL_PREFIX)


def is_non_positive(quantity: Column, price: Column) -> Column:
    return (quantity <= 0) | (price <= 0)


def is_standard_code(code: Column, pattern: str = PRODUCT_PATTERN) -> Column:
    return code.rlike(pattern)


def is_product(code: Column, pattern: str = PRODUCT_PATTERN,
               exceptions: Iterable[str] = PRODUCT_EXCEPTIONS) -> Column:
    return is_standard_code(code, pattern) | starts_with_any(code, exceptions)


def invoice_prefix(invoice: Column) -> Column:
    prefix = F.regexp_extract(invoice, r"^(\D*)", 1)
    return F.when(prefix == "", "(numeric)").otherwise(prefix)


def money_units(amount: Column) -> Column:
    """Whole ten-thousandths: integers add up exactly whatever the partition order."""
    return F.round(amount * MONEY_SCALE).cast("bigint")


def from_units(units: Column) -> Column:
    return units.cast("double") / F.lit(float(MONEY_SCALE))


def sum_money(amount: Column) -> Column:
    return from_units(F.sum(money_units(amount)))


def ratio(part: Column, whole: Column) -> Column:
    """Division that yields null, not an error, when the denominator is 0."""
    return F.try_divide(part.cast("double"), whole.cast("double"))


def month_start(ts: Column) -> Column:
    return F.trunc(ts.cast("date"), "month")


def commercial_year(ts: Column) -> Column:
    """December belongs to the following commercial year."""
    return F.year(ts) + F.when(F.month(ts) == 12, 1).otherwise(0)


def whole_days(start: Column, end: Column) -> Column:
    """Completed 24-hour days between two instants (not calendar-day differences)."""
    return F.date_part(F.lit("DAY"), end - start).cast("bigint")


def ntz(text: str) -> Column:
    return F.lit(text).cast("timestamp_ntz")
