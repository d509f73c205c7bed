"""Parsers for text that was meant to be typed; every one gives NULL instead of failing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed patterns of the accepted notations.
DECIMAL_GROUPED = r"^[+-]?([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$"
DECIMAL_NON_NEGATIVE = r"^([0-9]+|[0-9]{1,3}(,[0-9]{3})+)(\.[0-9]+)?$"
DECIMAL_PLAIN = r"^[0-9]+(\.[0-9]+)?$"
INTEGER = r"^[+-]?[0-9]+$"
DAY_COMPACT = r"^[0-9]{8}$"
DAY_DIVIDED = r"^([0-9]{8}|[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}\.[0-9]{2}\.[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2})$"
FLAG = r"^[YyNn]$"
BLANKS = r"^[\s 　]+|[\s 　]+$"


def stripped(value: Column) -> Column:
    """Without blanks of any kind at either end; the cheap trim comes first."""
    trimmed = F.trim(value)
    return F.when(trimmed.rlike(BLANKS), F.regexp_replace(trimmed, BLANKS, "")).otherwise(trimmed)


def day_compact(value: Column) -> Column:
    """An existing day written YYYYMMDD, else NULL."""
    return F.when(value.rlike(DAY_COMPACT), F.try_to_date(value, "yyyyMMdd"))


def day_divided(value: Column) -> Column:
    """An existing day, undivided or divided by one of - . / throughout, else NULL."""
    return F.when(value.rlike(DAY_DIVIDED), F.try_to_date(F.regexp_replace(value, "[-./]", ""), "yyyyMMdd"))


def decimal(value: Column, pattern: str = DECIMAL_GROUPED, precision: int = 38, scale: int = 10) -> Column:
    return F.when(value.rlike(pattern), F.regexp_replace(value, ",", "").try_cast(f"decimal({precision},{scale})"))
