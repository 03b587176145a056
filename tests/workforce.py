"""Small hand-made base tables."""

from datetime import date

from pyspark.sql import SparkSession

from crewcast.sources.master import MasterData

ASSIGNMENT_SCHEMA = """Resource_Id string, ActivityAssignment_Id string, Consultant_Name string, Level string,
    Job_Title string, `Group` string, Location string, PROJECT_ID string, Project_Name string,
    Project_Type string, Project_Status string, Assignment_Start date, Assignment_End date,
    Is_Active_Assignment int"""
TIME_SCHEMA = "ActivityAssignment_Id string, WeekStart date, Logged_Hours double, Consumed_Days double, Capacity double"
LEAVE_SCHEMA = "Resource_Id string, WeekStart date, Leave_Hours decimal(18,2), Leave_Info string"
AS_OF = "2026-07-20"


def day(text):
    return date.fromisoformat(text) if text else None


def assignment(person, key, start, end, *, name=None, project="Client A", project_id="P1", **other):
    values = {
        "Level": "Senior", "Job_Title": "Engineer", "Group": "Data", "Location": "Paris",
        "Project_Type": "Client", "Project_Status": "Open", **other,
    }
    return (
        person, key, name or f"Person {person}", values["Level"], values["Job_Title"],
        values["Group"], values["Location"], project_id, project, values["Project_Type"],
        values["Project_Status"], day(start), day(end), 0,
    )


def hours(key, week, amount):
    return (key, day(week), float(amount), amount / 8, 0.0)


def leave(person, week, amount, text="8.00 hours (Holiday)"):
    from decimal import Decimal

    return (person, day(week), Decimal(str(amount)), text)


def master(spark: SparkSession, assignments=(), time=(), leaves=()) -> MasterData:
    return MasterData.of(
        spark.createDataFrame(list(assignments), ASSIGNMENT_SCHEMA),
        spark.createDataFrame(list(time), TIME_SCHEMA),
        spark.createDataFrame(list(leaves), LEAVE_SCHEMA),
    )
