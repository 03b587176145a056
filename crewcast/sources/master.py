"""The three base tables of every report, checked and normalised."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.text import text_or_empty

# Columns each base table must bring.
ASSIGNMENT_COLUMNS = (
    "Resource_Id", "ActivityAssignment_Id", "Consultant_Name", "Level", "Group",
    "Project_Name", "Assignment_Start", "Assignment_End", "Is_Active_Assignment",
)
TIME_COLUMNS = ("ActivityAssignment_Id", "WeekStart", "Logged_Hours", "Consumed_Days", "Capacity")
LEAVE_COLUMNS = ("Resource_Id", "WeekStart", "Leave_Hours", "Leave_Info")

_ASSIGNMENT_TEXT = (
    "Resource_Id", "ActivityAssignment_Id", "Consultant_Name", "Level", "Group", "Project_Name",
)


def require_columns(df: DataFrame, columns: Iterable[str], name: str) -> DataFrame:
    """Looks only at the schema, so it starts no job."""
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise ValueError(f"{name} is missing required columns: {', '.join(missing)}")
    return df


def _number_or_zero(name: str, to: str = "double"):
    return F.coalesce(F.col(f"`{name}`").try_cast("double"), F.lit(0.0)).cast(to)


def normalise_assignments(df: DataFrame) -> DataFrame:
    require_columns(df, ASSIGNMENT_COLUMNS, "assignments")
    return df.withColumns(
        {
            **{c: F.col(c).try_cast("date") for c in ("Assignment_Start", "Assignment_End")},
            "Is_Active_Assignment": _number_or_zero("Is_Active_Assignment", "int"),
            **{c: text_or_empty(F.col(c)) for c in _ASSIGNMENT_TEXT},
        }
    )


def normalise_time_entries(df: DataFrame) -> DataFrame:
    require_columns(df, TIME_COLUMNS, "time_entries")
    return df.withColumns(
        {
            "WeekStart": F.col("WeekStart").try_cast("date"),
            "Logged_Hours": _number_or_zero("Logged_Hours"),
            "Consumed_Days": _number_or_zero("Consumed_Days"),
            "Capacity": _number_or_zero("Capacity"),
            "ActivityAssignment_Id": text_or_empty(F.col("ActivityAssignment_Id")),
        }
    )


def normalise_leave(df: DataFrame) -> DataFrame:
    require_columns(df, LEAVE_COLUMNS, "leave")
    return df.withColumns(
        {
            "WeekStart": F.col("WeekStart").try_cast("date"),
            "Leave_Hours": F.coalesce(
                F.col("Leave_Hours").try_cast("decimal(18,2)"), F.lit(0).cast("decimal(18,2)")
            ),
            "Resource_Id": text_or_empty(F.col("Resource_Id")),
            "Leave_Info": text_or_empty(F.col("Leave_Info")),
        }
    )


@dataclass(frozen=True)
class MasterData:
    assignments: DataFrame
    time_entries: DataFrame
    leave: DataFrame

    @classmethod
    def of(cls, assignments: DataFrame, time_entries: DataFrame, leave: DataFrame) -> MasterData:
        return cls(
            normalise_assignments(assignments),
            normalise_time_entries(time_entries),
            normalise_leave(leave),
        )

    def summary(self) -> DataFrame:
        """One row: row counts of the three tables, distinct names, distinct non-blank projects."""
        counts = self.assignments.agg(
            F.count("*").alias("assignment_rows"),
            F.countDistinct("Consultant_Name").alias("consultants"),
            F.countDistinct(
                F.when(F.col("Project_Name") != "", F.col("Project_Name"))
            ).alias("projects"),
        )
        return counts.select(
            "assignment_rows",
            self.time_entries.agg(F.count("*")).scalar().alias("time_entry_rows"),
            self.leave.agg(F.count("*")).scalar().alias("leave_rows"),
            "consultants",
            "projects",
        )
