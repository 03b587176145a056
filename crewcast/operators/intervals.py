"""Joins of intervals of days by equality: which points lie in which intervals, which intervals overlap.

A span of days is cut into few aligned pieces of 1, 4, 16, ... days, as large as they fit; a day
lies in one piece of each size. So a day is in an interval when they share exactly one (size,
piece), and each pair is found once, without comparing every pair and without duplicates. Two
intervals overlap when one begins inside the other. An open end reaches to the last day asked for.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.sources.shared_storage import fresh_path, written

_RADIX = 4


def _of_size(size: int) -> Callable[[Column], Column]:
    return lambda piece: F.struct(F.lit(size).alias("_size"), piece.alias("_piece"))


def _pieces(first: Column, last: Column, sizes: int) -> Column:
    """array<struct<size, piece>> of the days first..last (numbers), empty when last < first."""
    empty = F.array().cast("array<bigint>")

    def between(low: Column, end: Column) -> Column:
        return F.when(low < end, F.sequence(low, F.greatest(end - 1, low))).otherwise(empty)

    def bounds(size: int) -> tuple[Column, Column]:
        width = _RADIX**size
        return F.ceil(first / F.lit(width)).cast("bigint"), F.floor((last + 1) / F.lit(width)).cast("bigint")

    parts = []
    for size in range(sizes):
        low, end = bounds(size)
        inner_low, inner_end = bounds(size + 1)
        if size == sizes - 1:
            pieces = between(low, end)
        else:
            split = F.concat(between(low, inner_low * _RADIX), between(inner_end * _RADIX, end))
            pieces = F.when(inner_low < inner_end, split).otherwise(between(low, end))
        parts.append(F.transform(pieces, _of_size(size)))
    return F.flatten(F.array(*parts))


def points_in_intervals(
    points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, first: str, last: str
) -> DataFrame:
    """All columns of both sides (the keys once) for each day `point` within first..last of the same keys.

    The columns must differ but for the keys. A null last is an open end, and reaches as far as
    the latest point; intervals without a first day or that end before they begin hold nothing.
    Null keys and null points meet nothing. Runs jobs while it is built.
    """
    spark = points.sparkSession
    day = F.unix_date(F.col(point)).cast("bigint")
    points = written(points.filter(F.col(point).isNotNull()), fresh_path(spark, "points"))
    low, high = points.agg(F.min(day), F.max(day)).first()
    start = F.unix_date(F.col(first)).cast("bigint")
    end = F.coalesce(F.unix_date(F.col(last)).cast("bigint"), F.lit(high))
    # Days outside the points' range are cut off, so an open end costs no more than a long interval.
    cut = intervals.withColumns({"_low": F.greatest(start, F.lit(low)), "_high": F.least(end, F.lit(high))})
    cut = cut.filter(F.col(first).isNotNull() & (F.col("_low") <= F.col("_high")))
    if low is None:
        cut = intervals.withColumns({"_low": F.lit(0).cast("bigint"), "_high": F.lit(0).cast("bigint")}).limit(0)
    cut = written(cut, fresh_path(spark, "intervals"))
    longest = cut.agg(F.max(F.col("_high") - F.col("_low") + 1)).first()[0] or 1
    sizes = 1
    while _RADIX**sizes <= longest:
        sizes += 1
    names = [f"`{c}`" for c in intervals.columns]
    posted = cut.select(*names, F.explode(_pieces(F.col("_low"), F.col("_high"), sizes)).alias("_p")).select(*names, "_p.*")
    places = [F.struct(F.lit(n).alias("_size"), F.floor(day / F.lit(_RADIX**n)).cast("bigint").alias("_piece")) for n in range(sizes)]
    asked = points.select("*", F.explode(F.array(*places)).alias("_p")).select(*[f"`{c}`" for c in points.columns], "_p.*")
    return asked.join(posted, [*keys, "_size", "_piece"]).drop("_size", "_piece")


def overlapping_pairs(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_days: tuple[str, str],
    right_days: tuple[str, str],
) -> DataFrame:
    """All columns of both sides (the keys once) for each pair of the same keys that share a day.

    left_days and right_days name the first and last day, both included; a null last is an open
    end. The columns must differ but for the keys. Intervals without a first day or that end
    before they begin overlap nothing; null keys meet nothing. Each pair of rows comes once. Runs
    jobs while it is built.
    """
    (first, last), (other_first, other_last) = left_days, right_days
    valid = [
        df.filter(F.col(a).isNotNull() & (F.col(b).isNull() | (F.col(a) <= F.col(b))))
        for df, a, b in ((left, first, last), (right, other_first, other_last))
    ]
    # The right one begins inside the left one, or the left one begins later, inside the right one.
    inside = points_in_intervals(valid[1], valid[0], keys, other_first, first, last)
    later = valid[1].withColumn("_after", F.date_add(other_first, 1))
    begun = points_in_intervals(valid[0], later, keys, first, "_after", other_last).drop("_after")
    columns = [*keys, *[c for c in (*left.columns, *right.columns) if c not in keys]]
    quoted = [f"`{c}`" for c in columns]
    return inside.select(*quoted).unionByName(begun.select(*quoted))
