"""Divisions that give NULL, never an error, when the denominator is zero."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Double quotient; NULL for a zero denominator."""
    return _column(numerator).cast("double") / F.nullif(_column(denominator), F.lit(0))


def percent(numerator: Column | str, denominator: Column | str, digits: int = 2) -> Column:
    """Rounded percentage, multiplied before it is divided, all in doubles."""
    scaled = F.lit(100.0) * _column(numerator)
    return F.round(scaled / F.nullif(_column(denominator), F.lit(0)), digits)


def count_where(condition: Column) -> Column:
    """Rows for which the condition holds: 0 if none, NULL on empty input."""
    return F.sum(F.when(condition, 1).otherwise(0))


#: Digits of amounts before and after the point that sums keep.
MONEY_DIGITS, MONEY_SCALE = 28, 10


def exact_sum(amount: Column | str) -> Column:
    """Decimal sum of money amounts, exact and the same however the rows are spread over tasks.

    Amounts are taken to MONEY_SCALE decimals; round or divide the sum before it becomes a
    double, and only once. One too large for the type, or not a number, raises.
    """
    return F.sum(_column(amount).cast(f"decimal({MONEY_DIGITS},{MONEY_SCALE})"))


def rounded_money(total: Column | str, digits: int = 2) -> Column:
    """A decimal sum rounded half up, as a double."""
    return F.round(_column(total), digits).cast("double")
