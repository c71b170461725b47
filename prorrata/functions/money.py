"""Decimal arithmetic: amounts have two decimals and ties round away from zero."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F
from pyspark.sql.types import DecimalType

MONEY = DecimalType(18, 2)
PERCENT = DecimalType(5, 2)
# Scale at which a bill's ordinary/extraordinary proportion is kept.
RATIO = DecimalType(22, 13)
ZERO = Decimal("0.00")
MONTHLY_INTEREST = Decimal("0.05")


def money(value: Column) -> Column:
    return value.cast(MONEY)


def to_cents(value: Column) -> Column:
    return (value * F.lit(100)).cast("long")


def from_cents(value: Column) -> Column:
    return (value.cast("decimal(20,0)") * F.lit(Decimal("0.01"))).cast(MONEY)


def proportion(part: Column, whole: Column) -> Column:
    return (part / whole).cast(RATIO)


def parse_amount(text: Column) -> Column:
    """`$ 123,45` or `123.45` to an amount; NULL when it is not a number."""
    plain = F.replace(F.replace(F.trim(text), F.lit("$"), F.lit("")), F.lit(","), F.lit("."))
    return plain.try_cast(MONEY)


def decode_amount(text: Column) -> Column:
    """Amount whose separators carry no meaning: the last two digits are the cents."""
    digits = F.translate(F.trim(text), ".,", "")
    whole = F.substring(digits, F.lit(1), F.length(digits) - 2)
    return F.when(
        F.length(digits) >= 2,
        F.concat(whole, F.lit("."), F.right(digits, F.lit(2))).try_cast(MONEY),
    )
