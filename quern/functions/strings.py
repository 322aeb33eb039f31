"""String functions whose rules differ from Spark's built-ins of the same name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def concat_skip(*parts) -> Column:
    """Joins its arguments as text; NULLs are left out."""
    return F.concat_ws("", *(F.col(p).cast("string") if isinstance(p, str) else p.cast("string") for p in parts))


def substring_from(x, start, count) -> Column:
    """SUBSTRING(x FROM start FOR count): a start below 1 counts as 1."""
    return F.substr(x, F.greatest(F.lit(start) if isinstance(start, int) else start, F.lit(1)), F.lit(count) if isinstance(count, int) else count)


def field(x: Column, *choices) -> Column:
    """The 1-based place of x among the choices, compared as text; 0 if it isn't there."""
    places = F.array(*(F.lit(c).cast("string") for c in choices))
    return F.coalesce(F.array_position(places, x.cast("string")), F.lit(0)).cast("long")


def elt(n: Column, *choices) -> Column:
    """The n-th choice; NULL out of range."""
    return F.get(F.array(*(F.lit(c) for c in choices)), n - 1)


def format_fixed(x: Column, digits: int) -> Column:
    """A number with a fixed number of decimals, from 0 to 30, and no thousands separators."""
    return F.format_string(f"%.{max(0, min(30, digits))}f", x.cast("double"))
