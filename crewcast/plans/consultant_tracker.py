"""Consultant tracker: one row per group and name, weeks as columns."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import ReportingYear, iso_text
from crewcast.operators.reshape import STATUS_SUFFIX, week_map, week_value
from crewcast.sources.master import require_columns

TRACKER_KEYS = ("Group", "Consultant_Name")

CALENDAR_COLUMNS = (
    "Group", "Consultant_Name", "Expected_Availability_Date", "Active_Projects", "WeekStart",
    "CalendarValue", "CalendarStatus",
)


def tracker_weeks(calendar: DataFrame) -> DataFrame:
    """Long form of the tracker: one row per group, name and week.

    People who share group and name become one row: value and status come from the lowest
    Resource_Id, availability is the earliest, the project count the highest.
    """
    require_columns(calendar, CALENDAR_COLUMNS, "Consultant calendar")
    return (
        calendar.filter(F.col("Consultant_Name").isNotNull() & F.col("WeekStart").isNotNull())
        .groupBy(*TRACKER_KEYS, "WeekStart")
        .agg(
            F.min_by(F.struct("CalendarValue", "CalendarStatus"), "Resource_Id").alias("_first"),
            F.min("Expected_Availability_Date").alias("Expected_Availability_Date"),
            F.max("Active_Projects").alias("Active_Projects"),
        )
        .select(*TRACKER_KEYS, "WeekStart", "Expected_Availability_Date", "Active_Projects", "_first.*")
    )


def consultant_tracker(calendar: DataFrame, as_of: str | date) -> DataFrame:
    """Wide form of `tracker_weeks`.

    The calendar has every week for every person, so the lowest Resource_Id is the same in each
    week of a group and name: a person's weeks are gathered first, people are merged after that.
    """
    require_columns(calendar, CALENDAR_COLUMNS, "Consultant calendar")
    weeks = ReportingYear.of(as_of).weeks
    people = (
        calendar.filter(F.col("Consultant_Name").isNotNull() & F.col("WeekStart").isNotNull())
        .groupBy(*TRACKER_KEYS, "Resource_Id")
        .agg(
            F.min("Expected_Availability_Date").alias("available"),
            F.max("Active_Projects").alias("projects"),
            week_map("WeekStart", "CalendarValue", "CalendarStatus").alias("_weeks"),
        )
    )
    rows = people.groupBy(*TRACKER_KEYS).agg(
        iso_text(F.min("available")).alias("Expected_Availability_Date"),
        F.coalesce(F.max("projects"), F.lit(0)).alias("Active_Projects"),
        F.min_by("_weeks", "Resource_Id").alias("_weeks"),
    )
    cells = F.col("_weeks")
    return rows.select(
        *TRACKER_KEYS,
        "Expected_Availability_Date",
        "Active_Projects",
        *[week_value(cells, w, "CalendarValue").alias(w.isoformat()) for w in weeks],
        *[week_value(cells, w, "CalendarStatus").alias(w.isoformat() + STATUS_SUFFIX) for w in weeks],
    ).orderBy(*[F.col(k).asc_nulls_last() for k in TRACKER_KEYS])
