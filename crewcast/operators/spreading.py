"""Parallelism for heavy per-row work."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(df: DataFrame) -> DataFrame:
    """Deals rows out evenly, without regard to their size or place, over twice the cores.

    For work that costs far more per row than moving the row, where a few large input splits
    would keep most cores idle.
    """
    return df.repartition(2 * df.sparkSession.sparkContext.defaultParallelism)


def spread_few(df: DataFrame) -> DataFrame:
    """`spread` for tables of fewer files than there are cores; larger tables stay where they lie.

    A table of few files is small, and reading it alone would keep cores idle; moving a large one
    would cost more than it brings. Rows are the same either way.
    """
    files = len(df.inputFiles())
    return df if files >= df.sparkSession.sparkContext.defaultParallelism else spread(df)


def spread_by(df: DataFrame, *keys: str) -> DataFrame:
    """Rows of equal keys together, over twice as many tasks as the session shuffles with.

    Before a sort or a hash over keys as many as rows: a number of tasks that is fitted to the
    bytes moved can leave one task with many millions of narrow rows. Rows that already lie by
    the keys in the session's number of partitions would not be dealt out anew.
    """
    return df.repartition(2 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
