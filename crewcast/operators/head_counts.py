"""Exact distinct counts that can be merged: one bitmap per group and bucket of numbered keys.

Counting distinct keys again for every level of a roll-up moves every (group, key) pair once per
level. Here each key gets a number once, a group's keys become bits, and every coarser group is
the OR of finer ones: what is moved is at most 4 KB per group and 32,768 keys. Bitmaps of the same
numbering, from other weeks or other runs, are merged the same way.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.operators.numbering import number_rows
from crewcast.operators.spreading import spread_by
from crewcast.sources.shared_storage import fresh_path, written

NUMBER, BUCKET, BITS = "_number", "_bucket", "_bits"


def numbered_keys(rows: DataFrame, key: str, near: Sequence[str] = ()) -> DataFrame:
    """(key, _number from 1) of every distinct key that is not null.

    Keys with equal `near` columns get neighbouring numbers, so that a group of them fills few
    buckets. Numbered by ranges over many tasks and written, as numbers must not change while
    they are in use. Runs jobs while it is built.
    """
    sides = [f"_near{n}" for n in range(len(near))]
    pairs = rows.filter(F.col(key).isNotNull()).select(key, *[F.col(f"`{c}`").alias(s) for c, s in zip(near, sides)])
    keys = pairs.distinct().groupBy(key).agg(F.min(F.struct(*sides, key)).alias("_place")).withColumn("_all", F.lit(0))
    numbered = number_rows(keys, ["_all"], "_place", NUMBER).select(key, NUMBER)
    return written(numbered, fresh_path(rows.sparkSession, "numbered-keys"))


def bitmaps(rows: DataFrame, numbers: DataFrame, key: str, by: Sequence[str]) -> DataFrame:
    """(by..., _bucket, _bits): the keys of every group. Rows whose key has no number make no group.

    Repeated rows set the same bit again, so they need not be told apart first. The rows of a group
    and bucket meet as numbers, at most 32,768 different ones, and become one bitmap at once.
    """
    columns = [f"`{c}`" for c in by]
    numbered = spread_by(rows.select(key, *columns), key).join(numbers, key)
    placed = numbered.select(
        *columns, F.bitmap_bucket_number(NUMBER).alias(BUCKET), F.bitmap_bit_position(NUMBER).alias("_position")
    )
    return (
        spread_by(placed, *columns, BUCKET)
        .groupBy(*columns, BUCKET)
        .agg(F.bitmap_construct_agg("_position").alias(BITS))
    )


def rolled_up(table: DataFrame, sets: Sequence[Sequence[str]], name: str) -> DataFrame:
    """Distinct keys of every group of every set of columns.

    Columns: all columns of the sets, null where a set does not have them; `grouped_by`, the
    set's columns joined by a comma; `name`. An empty table gives no rows, for the empty set too.
    Every set reads the bitmaps once, joins them before the shuffle, and counts bits per bucket.
    """
    columns = list(dict.fromkeys(c for columns in sets for c in columns))
    types = {f.name: f.dataType for f in table.schema}
    result = None
    for grouped in sets:
        keys = [f"`{c}`" for c in grouped]
        counted = (
            table.groupBy(*keys, BUCKET)
            .agg(F.bitmap_or_agg(BITS).alias(BITS))
            .groupBy(*keys)
            .agg(F.sum(F.bitmap_count(BITS)).alias(name))
            .filter(F.col(name).isNotNull())
            .select(
                *[F.col(f"`{c}`") if c in grouped else F.lit(None).cast(types[c]).alias(c) for c in columns],
                F.lit(",".join(grouped)).alias("grouped_by"),
                name,
            )
        )
        result = counted if result is None else result.unionByName(counted)
    return result
