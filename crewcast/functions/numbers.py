"""Rounding and number formatting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FULL_WEEK_HOURS = 40.0
DAY_HOURS = 8.0


def round_binary(col: Column, places: int) -> Column:
    """Half-even rounding of the scaled double, the way array libraries round.

    Spark's round() and bround() both go through the decimal text of the value and give
    other results for weeks such as 37 or 4.6 hours.
    """
    scale = float(10**places)
    return F.rint(col * scale) / scale


def share_of_week(hours: Column) -> Column:
    """hours / 40 clipped to 0..1 and rounded to two places."""
    share = F.coalesce(hours, F.lit(0.0)) / FULL_WEEK_HOURS
    return round_binary(F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)), 2)


def extract_capacity(hours: Column) -> Column:
    """Capacity as the extract stores it: decimal(10,2), half away from zero."""
    share = (
        F.when(hours >= FULL_WEEK_HOURS, F.lit(1.0))
        .when(hours > 0, hours / FULL_WEEK_HOURS)
        .otherwise(F.lit(0.0))
    )
    return share.cast("decimal(10,2)")


def fixed_text(col: Column, places: int) -> Column:
    """'%.<places>f' of a number; null stays null."""
    return round_binary(col.cast("double"), places).cast(f"decimal(28,{places})").cast("string")


def count_text(col: Column) -> Column:
    return col.cast("bigint").cast("string")
