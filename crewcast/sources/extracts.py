"""The three base extracts over the raw tables of the resourcing system."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import (
    OPEN_END,
    ReportingYear,
    as_date,
    extract_week_start,
    monday_of,
    year_before,
)
from crewcast.functions.numbers import DAY_HOURS, extract_capacity

# Words that mark an activity or assignment as leave.
LEAVE_WORDS = "leave|holiday|vacation|annual"


def assignment_extract(
    resource: DataFrame,
    user: DataFrame,
    employee: DataFrame,
    assignment: DataFrame,
    activity: DataFrame,
    project: DataFrame,
    as_of: str | date,
) -> DataFrame:
    """One row per person and assignment; people without one keep a row with nulls.

    The person side keeps all its rows, and one person may own a large share of the
    assignments. A left join cannot be split on its right side, so it is written as the inner
    join (which adaptive execution can split on either side) plus the people without any
    assignment.
    """
    today = F.lit(as_date(as_of))
    people = (
        resource.select(F.col("Id").alias("Resource_Id"), F.col("User").alias("user_id"))
        .join(user.select(F.col("Id").alias("user_id"), F.col("Username")), "user_id")
        .join(
            employee.filter(F.col("DISPLAY_NAME").isNotNull()).select(
                F.col("INTEGRATION_ID").alias("Username"),
                F.col("DISPLAY_NAME").alias("Consultant_Name"),
                F.col("JOB_LEVEL").alias("Level"),
                F.col("JOB_TITLE").alias("Job_Title"),
                F.col("DEPARTMENT").alias("Group"),
                F.col("OFFICE_LOCATION").alias("Location"),
            ),
            "Username",
        )
        .drop("user_id", "Username")
    )
    projects = project.select(
        "PROJECT_ID",
        F.col("PROJECT_NAME").alias("Project_Name"),
        F.col("PROJECT_TYPE").alias("Project_Type"),
        F.col("PROJECT_STATUS").alias("Project_Status"),
    )
    activities = activity.select(
        F.col("Id").alias("ResourceActivity_Id"), F.col("Name").alias("Activity")
    ).join(projects, F.col("ResourceActivity_Id") == F.col("PROJECT_ID"), "left")
    owned = assignment.select(
        F.col("Resource").alias("Resource_Id"),
        F.col("Id").alias("ActivityAssignment_Id"),
        F.col("ResourcedActivity").alias("activity_key"),
        F.col("StartDate").cast("date").alias("Assignment_Start"),
        F.col("ForecastP2EndDate").cast("date").alias("Assignment_End"),
    ).filter(F.col("Resource_Id").isNotNull())
    with_assignment = (
        owned.join(people, "Resource_Id")
        .join(activities, F.col("activity_key") == F.col("ResourceActivity_Id"), "left")
        .drop("activity_key")
    )
    without = people.join(owned.select("Resource_Id").distinct(), "Resource_Id", "left_anti")
    active = (
        (F.col("Assignment_Start") <= today)
        & (F.coalesce(F.col("Assignment_End"), F.lit(OPEN_END)) >= today)
        & F.col("PROJECT_ID").isNotNull()
    )
    return with_assignment.unionByName(without, allowMissingColumns=True).select(
        "Resource_Id", "ActivityAssignment_Id", "Consultant_Name", "Level", "Job_Title",
        "Group", "Location", "ResourceActivity_Id", "Activity", "PROJECT_ID", "Project_Name",
        "Project_Type", "Project_Status", "Assignment_Start", "Assignment_End",
        F.when(active, 1).otherwise(0).alias("Is_Active_Assignment"),
    )


def weekly_time_extract(
    time_entry: DataFrame, time_period: DataFrame, as_of: str | date
) -> DataFrame:
    """Hours per assignment and week of the period's end date.

    The window runs from one calendar year before the current week to the end of the year.
    """
    day = as_date(as_of)
    # The extract's own week rule puts a Sunday into the following week.
    current_week = monday_of(day) if day.weekday() < 6 else date.fromordinal(day.toordinal() + 1)
    end_date = F.col("EndDate").cast("date")
    periods = time_period.filter(
        (end_date >= F.lit(year_before(current_week)))
        & (end_date <= F.lit(ReportingYear.of(day).last_day))
    ).select(F.col("Id").alias("TimePeriod"), extract_week_start(end_date).alias("WeekStart"))
    hours = F.sum(F.coalesce(F.col("EntryUnits"), F.lit(0.0)))
    return (
        time_entry.filter(F.col("ActivityAssignment").isNotNull())
        .select(
            F.col("ActivityAssignment").alias("ActivityAssignment_Id"), "TimePeriod", "EntryUnits"
        )
        .join(periods, "TimePeriod")
        .groupBy("ActivityAssignment_Id", "WeekStart")
        .agg(hours.alias("Logged_Hours"))
        .select(
            "ActivityAssignment_Id",
            "WeekStart",
            "Logged_Hours",
            (F.col("Logged_Hours") / DAY_HOURS).alias("Consumed_Days"),
            extract_capacity(F.col("Logged_Hours")).alias("Capacity"),
        )
    )


def _mentions_leave(name: str) -> Column:
    return F.lower(F.coalesce(F.col(name), F.lit(""))).rlike(LEAVE_WORDS)


def weekly_leave_extract(
    forecast_entry: DataFrame,
    assignment: DataFrame,
    resource: DataFrame,
    activity: DataFrame,
    as_of: str | date,
) -> DataFrame:
    """Leave hours per person and week of the period's start date, with a text per leave type."""
    year = ReportingYear.of(as_of)
    start = F.col("TimePeriodStartDate").cast("date")
    entries = forecast_entry.filter(
        start.between(F.lit(year.first_day), F.lit(year.last_day)) & (F.col("EntryUnits") > 0)
    ).select(
        F.col("ActivityAssignment").alias("assignment_key"),
        extract_week_start(start).alias("WeekStart"),
        F.col("EntryUnits").alias("Leave_Hours"),
    )
    people = resource.select(F.col("Id").alias("resource_key"), F.col("Id").alias("Resource_Id"))
    names = activity.select(F.col("Id").alias("activity_key"), F.col("Name").alias("activity_name"))
    # The assignment side is completed first: it is far smaller than the entries.
    assignments = (
        assignment.select(
            F.col("Id").alias("assignment_key"),
            F.col("Name").alias("assignment_name"),
            F.col("Resource").alias("resource_key"),
            F.col("ResourcedActivity").alias("activity_key"),
        )
        .join(names, "activity_key", "left")
        .join(people, "resource_key", "left")
        .filter(_mentions_leave("activity_name") | _mentions_leave("assignment_name"))
        .select(
            "assignment_key",
            "Resource_Id",
            F.coalesce(
                F.nullif(F.trim("activity_name"), F.lit("")),
                F.nullif(F.trim("assignment_name"), F.lit("")),
                F.lit("Leave"),
            ).alias("Leave_Type"),
        )
    )
    # An entry without an assignment has no leave word either, so the inner join loses nothing.
    by_type = (
        entries.join(assignments, "assignment_key")
        .groupBy("Resource_Id", "WeekStart", "Leave_Type")
        .agg(F.sum("Leave_Hours").alias("Leave_Hours"))
    )
    return weekly_leave_summary(by_type)


def weekly_leave_summary(by_type: DataFrame) -> DataFrame:
    """(Resource_Id, WeekStart, Leave_Type, Leave_Hours) → one row per person-week.

    The text lists the types in alphabetical order, so that it is the same on every run.
    """
    amount = F.col("Leave_Hours").cast("decimal(18,2)").cast("string")
    text = F.concat(amount, F.lit(" hours ("), F.col("Leave_Type"), F.lit(")"))
    return (
        by_type.groupBy("Resource_Id", "WeekStart")
        .agg(
            F.sum("Leave_Hours").cast("decimal(18,2)").alias("Leave_Hours"),
            F.sort_array(
                F.collect_list(F.struct(F.col("Leave_Type").alias("type"), text.alias("text")))
            ).alias("parts"),
        )
        .select(
            "Resource_Id",
            "WeekStart",
            "Leave_Hours",
            F.array_join(F.col("parts.text"), ", ").alias("Leave_Info"),
        )
    )
