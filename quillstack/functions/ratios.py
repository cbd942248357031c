"""Guarded ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of nothing."""
    return F.when(whole > 0, F.lit(100.0) * part / whole).otherwise(F.lit(0.0))


def floor_mean(total: Column, n: Column) -> Column:
    return F.when(n > 0, F.floor(total / n)).otherwise(F.lit(0)).cast("long")
