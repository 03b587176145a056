"""Uniqueness contracts and data-quality tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from crewcast.functions.text import strip
from crewcast.operators.spreading import spread_by


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their row count."""
    return (
        df.groupBy(*[f"`{k}`" for k in keys])
        .agg(F.count("*").alias("row_count"))
        .filter(F.col("row_count") > 1)
    )


def assert_unique(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
    """Runs one job; raises when a key repeats, otherwise returns df unchanged."""
    examples = duplicate_keys(df, keys).limit(5).collect()
    if examples:
        shown = "; ".join(", ".join(str(v) for v in row) for row in examples)
        raise ValueError(f"{name} has repeated keys ({', '.join(keys)}, rows): {shown}")
    return df


def calendar_diagnostics(calendar: DataFrame) -> DataFrame:
    """check, detail, row_count: rows per status, repeated person-weeks, capacity outside 0..1.

    Every row learns how many rows its person-week has; then all checks are counted per status,
    on the map side, from one reading of the calendar.
    """
    capacity = F.col("CalendarCapacity")
    same_week = Window.partitionBy("Resource_Id", "WeekStart")
    outside = F.coalesce((capacity < 0) | (capacity > 1), F.lit(False)).alias("_outside")
    per_status = (
        spread_by(calendar.select("Resource_Id", "WeekStart", "CalendarStatus", outside), "Resource_Id", "WeekStart")
        .withColumn("_repeated", F.count("*").over(same_week) > 1)
        .groupBy("CalendarStatus")
        .agg(
            F.count("*").alias("rows"),
            F.count_if("_repeated").alias("repeated"),
            F.count_if("_outside").alias("outside"),
        )
    )
    checks = F.array(
        *[
            F.struct(F.lit(check).alias("check"), detail.alias("detail"), F.col(count).alias("row_count"))
            for check, detail, count in (
                ("status", F.col("CalendarStatus"), "rows"),
                ("duplicate person-week", F.lit(""), "repeated"),
                ("capacity outside 0-1", F.lit(""), "outside"),
            )
        ]
    )
    return (
        per_status.select(F.inline(checks))
        .groupBy("check", "detail")
        .agg(F.sum("row_count").alias("row_count"))
    )


# Roles a chat message may have.
MESSAGE_ROLES = ("user", "assistant", "system")


def message_violations(messages: DataFrame) -> DataFrame:
    """conversation_id, turn, problem: unknown role, blank content, repeated (conversation, turn)."""
    row_problems = F.filter(
        F.array(
            F.when(
                F.col("role").isNull() | ~F.col("role").isin(*MESSAGE_ROLES), F.lit("unknown role")
            ),
            F.when(
                strip(F.coalesce(F.col("content"), F.lit(""))) == "", F.lit("blank content")
            ),
        ),
        lambda p: p.isNotNull(),
    )
    by_row = messages.select("conversation_id", "turn", F.explode(row_problems).alias("problem"))
    repeated = duplicate_keys(messages, ["conversation_id", "turn"]).select(
        "conversation_id", "turn", F.lit("repeated number").alias("problem")
    )
    return by_row.unionByName(repeated)
