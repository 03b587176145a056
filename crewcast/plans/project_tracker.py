"""Project tracker: one row per assignment, hours, leave and days for 52 weeks."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import WEEK, as_date, completed_weeks, monday_of, year_before
from crewcast.functions.text import strip
from crewcast.operators.assignments import non_blank
from crewcast.operators.reshape import week_map, week_value
from crewcast.sources.master import MasterData, require_columns
from crewcast.sources.shared_storage import fresh_path, written

ROW_COLUMNS = (
    "Resource_Id", "ActivityAssignment_Id", "Consultant_Name", "Level", "Job_Title", "Location",
    "Project_Name", "Project_Type", "Project_Status", "Assignment_Start", "Assignment_End",
)
DISPLAY_COLUMNS = (
    "Consultant_Name", "Level", "Job_Title", "Location", "Project_Name", "Project_Type",
    "Submission", "Project_Status", "Assignment_Start", "Assignment_End",
)
NO_LEAVE = "0 hours"


def _history(run_date: date):
    this_week = monday_of(run_date)
    return (F.col("WeekStart") >= F.lit(year_before(this_week))) & (
        F.col("WeekStart") < F.lit(this_week)
    )


def assignment_history(time_entries: DataFrame, run_date: str | date) -> DataFrame:
    """Per assignment: a map week → hours and days, and the submission status.

    Weeks are summed first, so each assignment's map is built from at most one row per week.
    """
    day = as_date(run_date)
    recent = F.col("WeekStart") >= F.lit(monday_of(day) - 3 * WEEK)
    weekly = (
        time_entries.filter(_history(day))
        .groupBy("ActivityAssignment_Id", "WeekStart")
        .agg(
            F.sum("Logged_Hours").alias("Logged_Hours"),
            F.sum("Consumed_Days").alias("Consumed_Days"),
            F.bool_or(F.col("Logged_Hours") > 0).alias("_submitted"),
        )
    )
    return weekly.groupBy("ActivityAssignment_Id").agg(
        week_map("WeekStart", "Logged_Hours", "Consumed_Days").alias("_time"),
        F.when(F.count_if(recent & F.col("_submitted")) == 3, "Active")
        .otherwise("Inactive")
        .alias("Submission"),
    )


def combined_leave(leave: DataFrame) -> DataFrame:
    """Distinct leave texts per person-week, joined in alphabetical order."""
    text = strip(F.coalesce("Leave_Info", F.lit("")))
    shown = F.when((text != "") & ~F.lower(text).isin("nan", "none"), text)
    return (
        leave.select("Resource_Id", "WeekStart", shown.alias("Leave_Info"))
        .distinct()
        .groupBy("Resource_Id", "WeekStart")
        .agg(F.array_join(F.sort_array(F.collect_list("Leave_Info")), ", ").alias("Leave_Info"))
        .withColumn(
            "Leave_Info", F.when(F.col("Leave_Info") == "", NO_LEAVE).otherwise(F.col("Leave_Info"))
        )
    )


def project_tracker(data: MasterData, run_date: str | date) -> DataFrame:
    """All assignments with a name and a project, whatever their dates.

    The weeks of an assignment arrive as one map instead of 52 joins. The leave maps, one row per
    person, are written first: adaptive execution splits a person with very many assignments only
    where both sides of the join are plain shuffles, not aggregates. Runs a job while it is built.
    """
    day = as_date(run_date)
    require_columns(data.assignments, ROW_COLUMNS, "assignments")
    base = (
        data.assignments.filter(non_blank("Consultant_Name") & non_blank("Project_Name"))
        .select(*ROW_COLUMNS)
        .distinct()
    )
    leave = (
        combined_leave(data.leave.filter(_history(day)))
        .groupBy("Resource_Id")
        .agg(week_map("WeekStart", "Leave_Info").alias("_leave"))
    )
    leave = written(leave, fresh_path(data.assignments.sparkSession, "leave-maps"))
    joined = base.join(
        assignment_history(data.time_entries, day), "ActivityAssignment_Id", "left"
    ).join(leave, "Resource_Id", "left")

    columns = []
    for week in completed_weeks(day):
        hours = week_value(F.col("_time"), week, "Logged_Hours")
        info = week_value(F.col("_leave"), week, "Leave_Info")
        days = week_value(F.col("_time"), week, "Consumed_Days")
        columns += [
            F.coalesce(hours, F.lit(0.0)).alias(f"Logged_Hours_{week}"),
            F.coalesce(info, F.lit(NO_LEAVE)).alias(f"Leave_{week}"),
            F.coalesce(days, F.lit(0.0)).alias(f"Consumed_Days_{week}"),
        ]
    return (
        joined.withColumn("Submission", F.coalesce("Submission", F.lit("Inactive")))
        .orderBy(
            F.col("Consultant_Name").asc_nulls_last(),
            F.col("Project_Name").asc_nulls_last(),
            "ActivityAssignment_Id",
        )
        .select(*DISPLAY_COLUMNS, *columns)
    )
