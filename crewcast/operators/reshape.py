"""Long to wide and back, column picking by name."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import iso_text
from crewcast.functions.text import normalised_column_name

STATUS_SUFFIX = "__STATUS"


def week_map(week: str, *values: str) -> Column:
    """Aggregate: map from week to a struct of the values. One row per week and key expected."""
    return F.map_from_entries(
        F.collect_list(F.struct(F.col(week), F.struct(*[F.col(v) for v in values])))
    )


def week_value(weeks: Column, week: date, field: str) -> Column:
    return F.try_element_at(weeks, F.lit(week))[field]


def wide_weeks(
    long: DataFrame,
    keys: Sequence[str],
    week: str,
    value: str,
    weeks: Sequence[date],
    owner: str,
) -> DataFrame:
    """One row per key and one column per week, named YYYY-MM-DD.

    The week list is given, so no job is needed to find the columns. `long` has one row per
    owner and week; the weeks of an owner are gathered first, so a list never holds more than
    one entry per week. A key that belongs to two owners fails the query and is named.
    """
    quoted = [f"`{k}`" for k in keys]
    per_owner = long.groupBy(*quoted, owner).agg(week_map(week, value).alias("_weeks"))
    per_key = per_owner.groupBy(*quoted).agg(
        F.first("_weeks").alias("_weeks"), F.count("*").alias("_owners")
    )
    named = F.concat_ws(" / ", *[F.coalesce(F.col(k).cast("string"), F.lit("null")) for k in quoted])
    unique = F.when(
        F.col("_owners") > 1,
        F.raise_error(F.concat(F.lit("more than one row per week for: "), named)),
    ).otherwise(F.col("_weeks"))
    return per_key.select(*quoted, unique.alias("_weeks")).select(
        *quoted, *[week_value(F.col("_weeks"), w, value).alias(w.isoformat()) for w in weeks]
    )


def status_columns(columns: Sequence[str]) -> dict[date, str]:
    """Week → name of its status column, for the columns named YYYY-MM-DD__STATUS."""
    found = {}
    for name in columns:
        if name.endswith(STATUS_SUFFIX):
            try:
                found[date.fromisoformat(name[: -len(STATUS_SUFFIX)])] = name
            except ValueError:
                continue
    return dict(sorted(found.items()))


def status_rows(tracker: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Reads a wide tracker back as (keys, WeekStart, CalendarStatus)."""
    columns = status_columns(tracker.columns)
    entries = [
        F.struct(F.lit(week).alias("WeekStart"), F.col(f"`{name}`").alias("CalendarStatus"))
        for week, name in columns.items()
    ]
    return tracker.select(*[f"`{k}`" for k in keys], F.inline(F.array(*entries)))


def visible_columns(df: DataFrame) -> DataFrame:
    return df.select(*[f"`{c}`" for c in df.columns if not c.endswith(STATUS_SUFFIX)])


def export_columns(df: DataFrame) -> DataFrame:
    """Visible columns with dates as YYYY-MM-DD text."""
    shown = visible_columns(df)
    dated = {"date", "timestamp", "timestamp_ntz"}
    return shown.select(
        *[
            (iso_text(F.col(f"`{c}`")) if t in dated else F.col(f"`{c}`")).alias(c)
            for c, t in shown.dtypes
        ]
    )


def find_column(df: DataFrame, candidates: Sequence[str]) -> str | None:
    """First candidate present when names are compared without case, spaces and signs."""
    present = {normalised_column_name(c): c for c in df.columns}
    for candidate in candidates:
        if normalised_column_name(candidate) in present:
            return present[normalised_column_name(candidate)]
    return None
