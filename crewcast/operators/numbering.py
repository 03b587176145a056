"""Running totals and row numbers inside groups of any size.

A plain window sorts a key that holds a third of all rows in one task. So keys with more than
`rows_per_range` rows are told apart by one count, combined on the map side. Their rows are
dealt out by ranges of (key, order) into as many tasks as the session shuffles with, numbered or
summed inside (key, range), and each range starts where the key's ranges before it end. All other
keys take one plain window. Both ways give the same numbers: nulls come first in the order, and
rows with a null key are a group like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewcast.sources.shared_storage import fresh_path, written

ROWS_PER_RANGE = 100_000


def join_totals(rows: DataFrame, totals: DataFrame, keys: Sequence[str], names: Sequence[str]) -> DataFrame:
    """rows with the columns `names` of totals, which has one row per combination of keys."""
    renamed = totals.select(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)], *names)
    condition = F.lit(True)
    for n, key in enumerate(keys):
        condition = condition & F.col(f"`{key}`").eqNullSafe(F.col(f"_key{n}"))
    return rows.join(renamed, condition).drop(*[f"_key{n}" for n in range(len(keys))])


def large_keys(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys with more than `most` rows, as _key0, _key1, ..., and their number of rows _n; None without such.

    Runs one job, which counts the keys. Large keys are few: at most one in `most` rows.
    """
    large = df.groupBy(*[F.col(f"`{k}`").alias(f"_key{n}") for n, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    large = written(large.filter(F.col("_n") > most), fresh_path(df.sparkSession, "large-keys"))
    return None if large.isEmpty() else large


def is_large(keys: Sequence[str]) -> Column:
    """The condition on which a row's keys are those of a row of `large_keys`."""
    condition = F.lit(True)
    for n, key in enumerate(keys):
        condition = condition & F.col(f"`{key}`").eqNullSafe(F.col(f"_key{n}"))
    return condition


def split_by_size(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of the keys with at most `most` rows, and those of the others (None without such); runs one job."""
    large = large_keys(df, keys, most)
    if large is None:
        return df, None
    return df.join(large, is_large(keys), "left_anti"), df.join(large, is_large(keys), "left_semi")


def order_ranges(large: DataFrame, keys: Sequence[str], order: str, name: str, ties: Sequence[str]) -> DataFrame:
    """Rows sorted into ranges of (keys, order, ties) with the number of their range.

    Written, so the numbers stay whatever is computed again.
    """
    by = [f"`{c}`" for c in (*keys, order, *ties)]
    dealt = large.repartitionByRange(*by).withColumn(name, F.spark_partition_id())
    return written(dealt, fresh_path(large.sparkSession, "ranges"))


def with_order_ranges(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str = "_range",
    ties: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Adds the range of each row in its key's order: 0 throughout for keys of few rows."""
    small, large = split_by_size(df, keys, rows_per_range)
    small = small.withColumn(name, F.lit(0))
    return small if large is None else small.unionByName(order_ranges(large, keys, order, name, ties))


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: str,
    name: str,
    ties: Sequence[str] = (),
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Numbers rows from 1 per key by an order column, nulls first. Runs jobs while it is built."""
    quoted = [f"`{k}`" for k in keys]
    columns = [f"`{c}`" for c in df.columns]
    small, large = split_by_size(df, keys, rows_per_range)
    numbered = small.withColumn(name, F.row_number().over(Window.partitionBy(*quoted).orderBy(order, *ties)).cast("bigint"))
    numbered = numbered.select(*columns, name)
    if large is None:
        return numbered
    ranged = order_ranges(large, keys, order, "_range", ties)
    over_ranges = Window.partitionBy(*quoted).orderBy("_range")
    before = (
        ranged.groupBy(*quoted, "_range")
        .agg(F.count("*").alias("_rows"))
        .withColumn("_before", F.sum("_rows").over(over_ranges) - F.col("_rows"))
    )
    in_range = Window.partitionBy(*quoted, "_range").orderBy(order, *ties)
    split = (
        join_totals(ranged, before, [*keys, "_range"], ["_before"])
        .withColumn(name, F.col("_before") + F.row_number().over(in_range))
        .select(*columns, name)
    )
    return numbered.unionByName(split)
