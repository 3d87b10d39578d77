"""Parsing and finiteness rules for raw readings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import COOPS_INTERVAL_SEC, DART_INTERVAL_SEC, HEIGHT_SENTINEL


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def is_reading(value: Column) -> Column:
    """A finite value below the missing-data sentinel."""
    return is_finite(value) & (value < F.lit(HEIGHT_SENTINEL))


# Fixed value: the text of a number this library accepts.
NUMBER_PATTERN = r"^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$"


def safe_float(text: Column) -> Column:
    """A finite double, or null for blanks, words, nan and infinities."""
    trimmed = F.trim(text)
    number = F.when(trimmed.rlike(NUMBER_PATTERN), trimmed.try_cast("double"))
    return F.when(is_finite(number), number)


def safe_int(text: Column) -> Column:
    return safe_float(text).try_cast("long")


def expected_interval_sec(source_type: Column, measurement_type: Column, product: Column) -> Column:
    dart = F.lit(DART_INTERVAL_SEC[1])
    for kind, seconds in DART_INTERVAL_SEC.items():
        dart = F.when(measurement_type == kind, seconds).otherwise(dart)
    coops = F.lit(60)
    for name, seconds in COOPS_INTERVAL_SEC.items():
        coops = F.when(product == name, seconds).otherwise(coops)
    return F.when(source_type == "dart", dart).otherwise(coops)
