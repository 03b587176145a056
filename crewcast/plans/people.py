"""Finding people by availability, skill, group and active projects.

Everything reads the long calendar; the wide tracker is only a way to show it.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import (
    ReportingYear,
    as_date,
    closest_week,
    iso_text,
    next_month_bounds,
)
from crewcast.functions.text import name_key, strip
from crewcast.operators.filters import (
    active_projects_condition,
    group_condition,
    same_people,
    technology_rows,
    rows_mentioning,
)
from crewcast.plans.calendar import BENCH, PARTLY
from crewcast.plans.consultant_tracker import TRACKER_KEYS, tracker_weeks

AVAILABLE = (BENCH, PARTLY)


def _is_bench(value: Column) -> Column:
    shown = F.upper(strip(value))
    return (shown == "B") | shown.contains("BENCH")


def bench_on_date(calendar: DataFrame, target: str | date, as_of: str | date) -> DataFrame:
    """People on bench in the week nearest to the target date."""
    week = closest_week(ReportingYear.of(as_of).weeks, as_date(target))
    return (
        tracker_weeks(calendar.filter(F.col("WeekStart") == F.lit(week)))
        .filter(_is_bench(F.col("CalendarValue")))
        .select(
            "Consultant_Name",
            "Group",
            iso_text(F.col("Expected_Availability_Date")).alias("Expected_Availability_Date"),
            F.col("CalendarValue").alias(week.isoformat()),
            F.lit(week.isoformat()).alias("Matched_Week"),
            F.lit("Bench value found in Consultant Tracker").alias("Reason"),
        )
    )


def future_bench(calendar: DataFrame, from_date: str | date) -> DataFrame:
    """First bench week on or after a date for each person."""
    return (
        tracker_weeks(calendar.filter(F.col("WeekStart") >= F.lit(as_date(from_date))))
        .filter(_is_bench(F.col("CalendarValue")))
        .groupBy(*TRACKER_KEYS)
        .agg(
            F.min("Expected_Availability_Date").alias("available"),
            F.min("WeekStart").alias("first_week"),
            F.min_by(F.upper(strip(F.col("CalendarValue"))), "WeekStart").alias("Status"),
        )
        .select(
            "Consultant_Name",
            F.lit(None).cast("string").alias("Team"),
            F.lit(None).cast("string").alias("Level"),
            "Group",
            iso_text(F.col("available")).alias("Expected_Availability_Date"),
            iso_text(F.col("first_week")).alias("First_Bench_Week"),
            "Status",
        )
    )


def _people(weeks: DataFrame) -> DataFrame:
    return weeks.groupBy(*TRACKER_KEYS).agg(
        F.min("Expected_Availability_Date").alias("Expected_Availability_Date"),
        F.max("Active_Projects").alias("Active_Projects"),
    )


def available_next_month(calendar: DataFrame, as_of: str | date) -> DataFrame:
    """People with at least one bench or partly booked week starting in the next month."""
    first, after = next_month_bounds(as_date(as_of))
    in_month = (F.col("WeekStart") >= F.lit(first)) & (F.col("WeekStart") < F.lit(after))
    return _people(
        tracker_weeks(calendar.filter(in_month)).filter(F.col("CalendarStatus").isin(*AVAILABLE))
    )


def currently_bench(calendar: DataFrame, as_of: str | date) -> DataFrame:
    """People on bench in the latest week that has begun, or in the first week before any has."""
    day = as_date(as_of)
    weeks = ReportingYear.of(day).weeks
    week = max((w for w in weeks if w <= day), default=min(weeks))
    return _people(
        tracker_weeks(calendar.filter(F.col("WeekStart") == F.lit(week))).filter(
            F.col("CalendarStatus") == BENCH
        )
    )


def find_people(
    calendar: DataFrame,
    as_of: str | date,
    *,
    availability: str | None = None,
    active_projects: Mapping[str, Any] | None = None,
    group: str | None = None,
) -> DataFrame:
    """Group, name, availability and project count of the people that pass every given filter."""
    if availability == "next_month":
        people = available_next_month(calendar, as_of)
    elif availability == "bench":
        people = currently_bench(calendar, as_of)
    else:
        # The person columns are the same in every week, so one week is enough.
        week = ReportingYear.of(as_of).first_week
        people = _people(calendar.filter(F.col("WeekStart") == F.lit(week)))
    if active_projects:
        people = people.filter(
            active_projects_condition(F.col("Active_Projects"), active_projects)
        )
    if group:
        people = people.filter(group_condition(F.col("Group"), group))
    return people


def _keyed(df: DataFrame, name: str) -> DataFrame:
    return df.withColumn("_name_key", name_key(F.col(name)))


def documents_of(documents: DataFrame, people: DataFrame) -> DataFrame:
    """Documents whose person is among the people, names compared without accents and signs."""
    allowed = (
        _keyed(people, "Consultant_Name").filter(F.col("_name_key") != "").select("_name_key")
    )
    return _keyed(documents, "consultant_name").join(allowed, "_name_key", "left_semi").drop("_name_key")


def people_of(people: DataFrame, documents: DataFrame) -> DataFrame:
    """People that some document is about."""
    named = documents.filter(F.col("consultant_name").isNotNull())
    wanted = _keyed(named, "consultant_name").select("_name_key")
    return _keyed(people, "Consultant_Name").join(wanted, "_name_key", "left_semi").drop("_name_key")


def available_with_skill_and_experience(
    available: DataFrame,
    technologies: DataFrame,
    technology: str,
    levels: Sequence[str],
    experience: DataFrame,
    keyword: str,
) -> DataFrame:
    """People on the availability list with a technology at a level and an experience keyword."""
    skilled = technology_rows(technologies, technology, levels)
    experienced = rows_mentioning(experience, keyword)
    return same_people(same_people(available, skilled), experienced)


# Sentences that confirm the availability filter of an answer.
VERIFIED = {
    "next_month": "Availability filter verified: the consultant has at least one BENCH or "
    "PARTLY_BOOKED week during next month.",
    "bench": "Availability filter verified: the consultant is currently BENCH.",
}


def workforce_context(people: DataFrame, availability: str | None = None) -> DataFrame:
    """One confirmed text per person for the answer."""
    lines = [
        F.concat(F.lit("Verified workforce information for "), "Consultant_Name", F.lit(":")),
        F.concat(F.lit("Group: "), "Group"),
        F.concat(F.lit("Active projects: "), F.col("Active_Projects").cast("string")),
    ]
    if availability in VERIFIED:
        lines.append(F.lit(VERIFIED[availability]))
    return people.select("Group", "Consultant_Name", F.concat_ws("\n", *lines).alias("context"))
