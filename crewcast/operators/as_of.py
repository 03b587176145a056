"""As-of joins: the nearest row of another table in the order of a time column, for a table of times.

The known rows of a key are gathered into one list, which meets the key's asked rows; these are
dealt out with a copy of the list each where they are many. Keys of many known rows take another
way: both sides are put together in one order per key, and every asked row takes the last (or
next) value that stands before (after) it. They are split into ranges of that order, and each
range also takes what the ranges before it end with. So no key is gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewcast.operators.numbering import ROWS_PER_RANGE, is_large, join_totals, large_keys, with_order_ranges
from crewcast.sources.shared_storage import fresh_path, written

BACKWARD, FORWARD = "backward", "forward"
#: Known rows of a key that are searched as one list, at most. Without influence on results.
LIST_ROWS = 400


def as_of_join(
    asked: DataFrame,
    known: DataFrame,
    keys: Sequence[str],
    asked_time: str,
    known_time: str,
    name: str,
    direction: str = BACKWARD,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Rows of `asked` with a struct column `name`: the other columns of the `known` row as-of their time.

    backward: the latest row of the same keys at or before the time; forward: the earliest at or
    after it. Null where there is none, or where the time is null. Of several known rows with the
    same keys and time the one with the greatest columns counts. Null keys are a key like any
    other; known rows without a time are never found. Times must be dates. Both sides are read
    several times: give tables that are stored or made by little work. Known rows that lie by key
    are moved as lists. Runs jobs while it is built.
    """
    way = (keys, asked_time, known_time, name, direction, rows_per_range)
    known = known.filter(F.col(known_time).isNotNull())
    long = large_keys(known, keys, min(rows_per_range, LIST_ROWS))
    if long is None:
        return _by_lists(asked, known, *way)
    short = _by_lists(asked.join(long, is_large(keys), "left_anti"), known.join(long, is_large(keys), "left_anti"), *way)
    return short.unionByName(_by_ranges(asked.join(long, is_large(keys), "left_semi"), known.join(long, is_large(keys), "left_semi"), *way))


def _by_lists(
    asked: DataFrame, known: DataFrame, keys: Sequence[str], asked_time: str, known_time: str, name: str, direction: str,
    rows_per_range: int,
) -> DataFrame:
    """`as_of_join` for keys of few known rows; a key of many asked rows is dealt out in parts of rows_per_range rows."""
    # Days, mirrored for the other direction: the entry wanted is always the greatest one up to the day asked for.
    sign = 1 if direction == BACKWARD else -1
    held = [c for c in known.columns if c not in keys]
    others = {c: f"c{n}" for n, c in enumerate(held) if c != known_time}
    # Equal structs may hold nulls, so null keys meet.
    key = F.struct(*[F.col(f"`{k}`").alias(f"k{n}") for n, k in enumerate(keys)]).alias("_key")
    entry = F.struct((F.unix_date(F.col(f"`{known_time}`")) * sign).alias("day"), *[F.col(f"`{c}`").alias(x) for c, x in others.items()])
    lists = known.select(key, entry.alias("_entry")).groupBy("_key").agg(F.collect_list("_entry").alias("_list"))
    keyed = asked.select("*", key)
    crowded = large_keys(asked, keys, rows_per_range)
    if crowded is None:
        met = keyed.join(lists, "_key", "left")
    else:
        parts = F.ceil(F.col("_n") / rows_per_range).cast("int")
        dealt = crowded.select(F.struct(*[F.col(f"_key{n}").alias(f"k{n}") for n in range(len(keys))]).alias("_key"), parts.alias("_parts"))
        # Other keys are one part, number 0. Rows are dealt by their values, so that a row stays in its part when it is computed again.
        values = F.xxhash64(*[f"`{c}`" for c, kind in asked.dtypes if "map<" not in kind])
        part = F.coalesce(F.pmod(values, F.col("_parts")), F.lit(0)).cast("int").alias("_part")
        keyed = keyed.join(dealt, "_key", "left").select(*[f"`{c}`" for c in keyed.columns], part)
        every = F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)).alias("_part")
        met = keyed.join(lists.join(dealt, "_key", "left").select("_key", "_list", every), ["_key", "_part"], "left")
    day = F.unix_date(F.col(f"`{asked_time}`")) * sign
    met = met.withColumn("_found", F.array_max(F.filter("_list", lambda e: e["day"] <= day)))
    entry = F.col("_found")
    row = F.struct(*[(entry[others[c]] if c in others else F.date_from_unix_date(entry["day"] * sign)).alias(c) for c in held])
    return met.select(*[f"`{c}`" for c in asked.columns], F.when(entry.isNotNull(), row).alias(name))


def _by_ranges(
    asked: DataFrame, known: DataFrame, keys: Sequence[str], asked_time: str, known_time: str, name: str, direction: str,
    rows_per_range: int,
) -> DataFrame:
    """`as_of_join` for keys of any number of rows."""
    back = direction == BACKWARD
    held = [c for c in known.columns if c not in keys]
    quoted = [f"`{k}`" for k in keys]
    # Days, mirrored for the other direction; at equal days known rows come first.
    days = F.unix_date(F.col("_time")) * (1 if back else -1)
    right = (
        known.groupBy(*quoted, F.col(known_time).alias("_time"))
        .agg(F.max(F.struct(*[f"`{c}`" for c in held])).alias(name))
        .withColumn("_row", F.lit(None).cast(asked.select(F.struct(*[f"`{c}`" for c in asked.columns])).schema[0].dataType))
    )
    left = asked.select(
        *quoted, F.col(asked_time).alias("_time"), F.lit(None).cast(right.schema[name].dataType).alias(name),
        F.struct(*[f"`{c}`" for c in asked.columns]).alias("_row"),
    )
    both = right.select(*quoted, "_time", name, "_row").unionByName(left)
    both = both.withColumns({"_days": days, "_side": F.when(F.col("_row").isNull(), 0).otherwise(1)})
    # Keys are counted, sampled and dealt from the same rows, so these are put together once.
    both = written(both, fresh_path(asked.sparkSession, "as-of-rows"))
    ranged = with_order_ranges(both, keys, "_days", "_range", ["_side"], rows_per_range)

    in_range = Window.partitionBy(*quoted, "_range").orderBy("_days", "_side").rowsBetween(Window.unboundedPreceding, 0)
    before_range = Window.partitionBy(*quoted).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ends = (
        ranged.groupBy(*quoted, "_range")
        .agg(F.max_by(name, F.when(F.col("_side") == 0, F.col("_days"))).alias("_end"))
        .withColumn("_carried", F.last("_end", ignorenulls=True).over(before_range))
    )
    found = F.coalesce(F.last(name, ignorenulls=True).over(in_range), F.col("_carried"))
    answered = (
        join_totals(ranged, ends, [*keys, "_range"], ["_carried"])
        .withColumn("_found", found)
        .filter(F.col("_side") == 1)
    )
    return answered.select("_row.*", F.when(F.col("_time").isNotNull(), F.col("_found")).alias(name))


def nearer(time: Column, before: Column, after: Column, known_time: str) -> Column:
    """Of an earlier and a later struct the one whose time is nearer; the earlier one on a tie."""
    to_before, to_after = F.datediff(time, before[known_time]), F.datediff(after[known_time], time)
    return F.when(before.isNull() | (to_after < to_before), after).otherwise(before)
