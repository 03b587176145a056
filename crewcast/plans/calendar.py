"""The person × week calendar, base of the reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import ReportingYear
from crewcast.functions.numbers import fixed_text
from crewcast.operators.assignments import (
    active_project_counts,
    eligible_assignments,
    has_week_bit,
    person_directory,
)
from crewcast.operators.numbering import number_rows
from crewcast.operators.reshape import week_map
from crewcast.operators.weekly import resource_weekly_leave, resource_weekly_time
from crewcast.sources.master import MasterData

BENCH, UNCONFIRMED, PARTLY, BOOKED, ON_LEAVE = (
    "BENCH", "UNCONFIRMED", "PARTLY_BOOKED", "BOOKED", "ON_LEAVE",
)

# Display colour of each status.
STATUS_COLOURS = {
    BOOKED: "RED",
    UNCONFIRMED: "ORANGE",
    PARTLY: "LIGHT_ORANGE",
    ON_LEAVE: "YELLOW",
    BENCH: "PURPLE",
}

# What a person's week brings from the hours and from the leave.
_HOURS = ("Logged_Hours", "Consumed_Days", "Capacity")
_LEAVE = ("Leave_Hours", "Leave_Info", "Is_Leave")


def calendar_status(capacity: Column, is_leave: Column, has_future: Column) -> Column:
    """Leave wins over hours, hours over a future assignment, and nothing at all is bench."""
    return (
        F.when(is_leave, ON_LEAVE)
        .when(capacity >= 1, BOOKED)
        .when(capacity > 0, PARTLY)
        .when(has_future, UNCONFIRMED)
        .otherwise(BENCH)
    )


def status_colour(status: Column) -> Column:
    colour = F.lit("")
    for name, value in STATUS_COLOURS.items():
        colour = F.when(status == name, value).otherwise(colour)
    return colour


def consultant_calendar(data: MasterData, as_of: str | date) -> DataFrame:
    """One row per eligible person and Monday of the as-of date's year.

    A person's hours and leave are gathered into maps of at most one entry per week of the year
    and arrive as left joins on Resource_Id; only then are people multiplied by a literal week
    array, so rows of person and week are neither moved nor sorted. Both are cut to the year's
    weeks first, so the filters reach their scans. Leave of people outside the eligible
    population finds no partner and needs no filter of its own.
    """
    year = ReportingYear.of(as_of)
    in_year = F.col("WeekStart").between(F.lit(year.first_week), F.lit(year.last_week))
    eligible = eligible_assignments(data.assignments, as_of)
    people = person_directory(eligible, as_of).join(
        active_project_counts(eligible, as_of), "Resource_Id", "left"
    )
    weeks = F.sequence(F.lit(year.first_week), F.lit(year.last_week), F.expr("interval 7 days"))
    # Other days than the year's Mondays meet no week, and would only make the maps longer.
    is_week = F.datediff("WeekStart", F.lit(year.first_week)) % 7 == 0
    hours = resource_weekly_time(data.time_entries.filter(in_year), eligible).filter(is_week)
    leave = resource_weekly_leave(data.leave.filter(in_year)).filter(is_week)
    hours_of = hours.groupBy("Resource_Id").agg(week_map("WeekStart", *_HOURS).alias("_hours"))
    leave_of = leave.groupBy("Resource_Id").agg(week_map("WeekStart", *_LEAVE).alias("_leave"))

    capacity = F.coalesce("Capacity", F.lit(0.0))
    joined = (
        people.join(hours_of, "Resource_Id", "left")
        .join(leave_of, "Resource_Id", "left")
        .withColumn("WeekStart", F.explode(weeks))
        .withColumns({"_hours": F.try_element_at("_hours", "WeekStart"), "_leave": F.try_element_at("_leave", "WeekStart")})
        .select("*", *[F.col(f"_hours.{c}") for c in _HOURS], *[F.col(f"_leave.{c}") for c in _LEAVE])
        .select(
            "Resource_Id", "Consultant_Name", "Level", "Group", "Job_Title", "Location",
            "Expected_Availability_Date",
            F.coalesce("Active_Projects", F.lit(0)).cast("int").alias("Active_Projects"),
            "WeekStart",
            F.coalesce("Logged_Hours", F.lit(0.0)).alias("Logged_Hours"),
            F.coalesce("Consumed_Days", F.lit(0.0)).alias("Consumed_Days"),
            capacity.alias("Capacity"),
            F.coalesce(F.col("Leave_Hours").cast("double"), F.lit(0.0)).alias("Leave_Hours"),
            F.coalesce("Leave_Info", F.lit("")).alias("Leave_Info"),
            F.coalesce("Is_Leave", F.lit(False)).alias("Is_Leave"),
            has_week_bit(F.col("_future_weeks"), F.col("WeekStart"), year).alias(
                "Has_Future_Assignment"
            ),
        )
    )
    status = F.col("CalendarStatus")
    from_hours = status.isin(BOOKED, PARTLY)
    return joined.withColumn(
        "CalendarStatus",
        calendar_status(F.col("Capacity"), F.col("Is_Leave"), F.col("Has_Future_Assignment")),
    ).withColumns(
        {
            "CalendarCapacity": F.when(status == UNCONFIRMED, F.lit(1.0))
            .when(from_hours, F.col("Capacity"))
            .otherwise(F.lit(0.0)),
            "CalendarValue": F.when(status == UNCONFIRMED, "1.00")
            .when(from_hours, fixed_text(F.col("Capacity"), 2))
            .when(status == ON_LEAVE, "L")
            .otherwise("B"),
        }
    )


def calendar_positions(calendar: DataFrame) -> DataFrame:
    """The calendar with each row's place, from 1, in the order of `sorted_calendar` (equal rows by Resource_Id).

    Numbered by ranges, over many tasks. Runs jobs while it is built.
    """
    order = {"_all": F.lit(0), "_no_group": F.col("Group").isNull(), "_no_name": F.col("Consultant_Name").isNull()}
    ties = ["Group", "_no_name", "Consultant_Name", "WeekStart", "Resource_Id"]
    return number_rows(calendar.withColumns(order), ["_all"], "_no_group", "position", ties).drop(*order)


def sorted_calendar(calendar: DataFrame) -> DataFrame:
    return calendar.orderBy(
        F.col("Group").asc_nulls_last(), F.col("Consultant_Name").asc_nulls_last(), "WeekStart"
    )
