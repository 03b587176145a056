"""Partial assignments: active people-projects with weeks below full hours."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import WEEK, as_date, monday_of
from crewcast.functions.numbers import FULL_WEEK_HOURS, round_binary
from crewcast.operators.assignments import active_on, eligible_assignments
from crewcast.sources.master import MasterData, require_columns

GROUPING = ("Resource_Id", "Consultant_Name", "Level", "Group", "Project_Name", "PROJECT_ID")
WEEKS_COLUMN = "Weeks assigned to project (<100% billable)"
SHARE_COLUMN = "Time (%)"


def partial_weeks(data: MasterData, run_date: str | date) -> DataFrame:
    """Person-project-weeks of the last 52 completed weeks with 0 < hours < 40."""
    day = as_date(run_date)
    this_week = monday_of(day)
    eligible = eligible_assignments(data.assignments, day)
    require_columns(eligible, (*GROUPING, "ActivityAssignment_Id"), "Assignments data")
    active = eligible.filter(active_on(day) & F.col("PROJECT_ID").isNotNull()).select(
        *GROUPING, "ActivityAssignment_Id"
    )
    history = data.time_entries.filter(
        (F.col("WeekStart") >= F.lit(this_week - 52 * WEEK))
        & (F.col("WeekStart") < F.lit(this_week))
    ).select("ActivityAssignment_Id", "WeekStart", "Logged_Hours")
    return (
        active.join(history, "ActivityAssignment_Id")
        .groupBy(*GROUPING, "WeekStart")
        .agg(F.sum("Logged_Hours").alias("Logged_Hours"))
        .filter((F.col("Logged_Hours") > 0) & (F.col("Logged_Hours") < FULL_WEEK_HOURS))
    )


def partial_assignments(data: MasterData, run_date: str | date) -> DataFrame:
    mean_share = F.sum("Logged_Hours") / F.count("*") / FULL_WEEK_HOURS
    return (
        partial_weeks(data, run_date)
        .groupBy(*GROUPING)
        .agg(
            F.count("*").alias(WEEKS_COLUMN),
            round_binary(mean_share * 100, 2).alias(SHARE_COLUMN),
        )
        .select(
            F.col("Resource_Id").alias("Resource ID"),
            F.col("Consultant_Name").alias("Resource name"),
            "Level",
            "Group",
            F.col("Project_Name").alias("Client"),
            F.col(f"`{WEEKS_COLUMN}`"),
            F.col(f"`{SHARE_COLUMN}`"),
        )
        .orderBy(
            F.col(f"`{WEEKS_COLUMN}`").desc_nulls_last(),
            F.col("`Resource name`").asc_nulls_last(),
            F.col("Client").asc_nulls_last(),
        )
    )
