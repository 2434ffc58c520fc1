"""Numbers: years, growth and clipping, with nulls kept apart from zeros."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: logarithmic growth is clipped to this.
LOG_CLIP = 5.0


def as_year(col: Column) -> Column:
    """A year from a number or text, truncated; null where it is none."""
    return col.try_cast("double").cast("int")


def clip(x: Column, low: float = -LOG_CLIP, high: float = LOG_CLIP) -> Column:
    """x within [low, high]; null and NaN stay what they are (least and greatest would lose them)."""
    return F.when(x.isNull() | F.isnan(x), x).otherwise(F.least(F.greatest(x, F.lit(low)), F.lit(high)))


def log_ratio(after: Column, before: Column) -> Column:
    """log2((after + 1) / (before + 1))."""
    return F.log2((after + 1.0) / (before + 1.0))


def share(part: Column, total: Column) -> Column:
    """part / (total + 1e-5)."""
    return part / (total + 1e-5)
