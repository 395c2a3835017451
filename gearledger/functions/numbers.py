"""Numeric helpers: half-up rounding and figures read from text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def js_round(value: Column) -> Column:
    """Round half towards plus infinity, as an integer-valued double."""
    return F.floor(value.cast("double") + F.lit(0.5)).cast("double")


def numbers_in(text: Column) -> Column:
    """All digit runs as doubles; null text gives an empty array."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("\\d+"), F.lit(0))
    return F.transform(found, lambda v: v.cast("double"))


def connector_count(text: Column) -> Column:
    """Sum of the multipliers written as ``2×`` or ``2x``; null text stays null, no multiplier is 0."""
    found = F.regexp_extract_all(text, F.lit("(\\d+)\\s*[xX×]"), F.lit(1))
    total = F.aggregate(F.transform(found, lambda v: v.cast("double")), F.lit(0.0), lambda acc, v: acc + v)
    return F.when((text.isNotNull()) & (text != ""), total)


def pcie_generation(text: Column) -> Column:
    """Highest generation written as 3.0 to 6.0, null when none is written."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("([3-6])\\.0"), F.lit(1))
    return F.array_max(F.transform(found, lambda v: v.cast("double")))


def clamp(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def release_date(year: Column) -> Column:
    """First of January of an integral year between 1970 and 2100, else null."""
    number = year.try_cast("double")
    valid = (number == F.floor(number)) & number.between(1970, 2100)
    return F.when(valid, F.make_date(number.cast("int"), F.lit(1), F.lit(1)))


def year_in(text: Column) -> Column:
    """First 19xx or 20xx figure of a text."""
    return F.nullif(F.regexp_extract(text, "((?:19|20)\\d{2})", 1), F.lit("")).cast("int")
