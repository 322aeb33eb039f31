"""Arithmetic with the rules of a row-store SQL server."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The number that a text begins with: sign, digits, dot, exponent.
NUMBER_PREFIX = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?"


def int_div(a: Column, b: Column) -> Column:
    """Division that cuts towards zero; dividing by zero is an error."""
    return F.call_function("div", a, b)


def round_double(x: Column) -> Column:
    """Rounds halves away from zero; the result is a double."""
    return F.round(x.cast("double"))


def text_to_number(x: Column) -> Column:
    """The number a text begins with, or 0."""
    return F.coalesce(F.regexp_extract(F.ltrim(x), NUMBER_PREFIX, 0).try_cast("double"), F.lit(0.0))


def truthy(x: Column) -> Column:
    """A number in a boolean place: anything but zero is true."""
    return x != 0
