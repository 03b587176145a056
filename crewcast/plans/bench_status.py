"""Bench report: eligible people without an active assignment on the run date."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import as_date, iso_text
from crewcast.operators.assignments import END, active_on, eligible_assignments, recency_key
from crewcast.sources.master import MasterData, require_columns

PERSON_COLUMNS = ("Consultant_Name", "Level", "Job_Title", "Group", "Location")


def bench_status(data: MasterData, run_date: str | date) -> DataFrame:
    """One pass over the eligible assignments.

    Last row, activity flag and last completed assignment are aggregates of the same grouping,
    so neither an anti join nor a join back is needed. The person columns keep the nulls of the
    last row.
    """
    day = as_date(run_date)
    eligible = eligible_assignments(data.assignments, day)
    require_columns(eligible, PERSON_COLUMNS, "Assignments data")
    completed = F.when(F.col(END) < F.lit(day), recency_key())
    per_person = eligible.groupBy("Resource_Id").agg(
        F.max_by(F.struct(*PERSON_COLUMNS), recency_key()).alias("_person"),
        F.bool_or(active_on(day)).alias("_active"),
        F.max_by(F.struct("Project_Name", END), completed).alias("_last"),
    )
    ended = F.col(f"_last.{END}")
    return (
        per_person.filter(~F.col("_active"))
        .select(
            "_person.*",
            F.col("_last.Project_Name").alias("Last Project"),
            iso_text(ended).alias("Last Assignment End"),
            F.floor(F.datediff(F.lit(day), ended) / 7).cast("bigint").alias("Bench Weeks"),
            F.lit("").alias("Possible Next Assignment"),
        )
        .orderBy(F.col("Bench Weeks").desc_nulls_last(), F.col("Consultant_Name").asc_nulls_last())
    )
