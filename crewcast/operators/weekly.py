"""Person-week hours and leave."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.numbers import share_of_week


def assignment_owners(assignments: DataFrame) -> DataFrame:
    """ActivityAssignment_Id → Resource_Id; an assignment with two owners fails the query.

    Distinct pairs first, so what is gathered per assignment is its one owner.
    """
    shared = F.concat(F.lit("assignment with more than one person: "), "ActivityAssignment_Id")
    return (
        assignments.select("ActivityAssignment_Id", "Resource_Id")
        .distinct()
        .groupBy("ActivityAssignment_Id")
        .agg(F.collect_set("Resource_Id").alias("_owners"))
        .select(
            "ActivityAssignment_Id",
            F.when(F.size("_owners") > 1, F.raise_error(shared))
            .otherwise(F.get("_owners", F.lit(0)))
            .alias("Resource_Id"),
        )
    )


def assignment_weekly_time(time_entries: DataFrame) -> DataFrame:
    """Hours and days per assignment and week, combined before the shuffle."""
    return time_entries.groupBy("ActivityAssignment_Id", "WeekStart").agg(
        F.sum("Logged_Hours").alias("Logged_Hours"), F.sum("Consumed_Days").alias("Consumed_Days")
    )


def resource_weekly_time(time_entries: DataFrame, assignments: DataFrame) -> DataFrame:
    """Hours, days and capacity per person and week.

    Entries are summed per assignment and week before they meet the owners, so an assignment with
    any number of entries brings one row per week to the join.
    """
    return (
        assignment_weekly_time(time_entries)
        .join(assignment_owners(assignments), "ActivityAssignment_Id")
        .groupBy("Resource_Id", "WeekStart")
        .agg(
            F.sum("Logged_Hours").alias("Logged_Hours"),
            F.sum("Consumed_Days").alias("Consumed_Days"),
        )
        .withColumn("Capacity", share_of_week(F.col("Logged_Hours")))
    )


def resource_weekly_leave(leave: DataFrame) -> DataFrame:
    """Leave hours, a text and a flag per person and week.

    Where a person-week has several texts the alphabetically first is taken; tables have no
    first row.
    """
    return (
        leave.groupBy("Resource_Id", "WeekStart")
        .agg(F.sum("Leave_Hours").alias("Leave_Hours"), F.min("Leave_Info").alias("Leave_Info"))
        .withColumn("Is_Leave", F.col("Leave_Hours") > 0)
    )
