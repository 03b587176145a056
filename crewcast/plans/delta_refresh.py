"""The stored calendar, kept up to date by recomputing only the people whose data has changed."""

from __future__ import annotations

from dataclasses import replace
from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crewcast.functions.dates import ReportingYear, as_date
from crewcast.operators.assignments import eligible_assignments
from crewcast.plans.calendar import consultant_calendar
from crewcast.sources.bucketed_store import BucketedStore, content_hashes
from crewcast.sources.master import MasterData
from crewcast.sources.report_store import _is_table
from crewcast.sources.shared_storage import fresh_path, written

BUCKETS = 64


def fingerprints(data: MasterData, as_of: str | date) -> DataFrame:
    """kind, key, rows, x1, x2: what the calendar's year sees of each person's assignments and leave, and of each assignment's hours.

    Order-free: the number of rows and two xors of row hashes, combined on the map side.
    """
    year = ReportingYear.of(as_of)
    in_year = F.col("WeekStart").between(F.lit(year.first_week), F.lit(year.last_week))
    sources = (
        ("assignments", eligible_assignments(data.assignments, as_of), "Resource_Id"),
        ("hours", data.time_entries.filter(in_year), "ActivityAssignment_Id"),
        ("leave", data.leave.filter(in_year), "Resource_Id"),
    )
    parts = [
        df.select(F.col(key).cast("string").alias("key"), *content_hashes(df.columns))
        .filter("key is not null")
        .groupBy("key")
        .agg(F.count("*").alias("rows"), F.bit_xor("_h1").alias("x1"), F.bit_xor("_h2").alias("x2"))
        .select(F.lit(kind).alias("kind"), "key", "rows", "x1", "x2")
        for kind, df, key in sources
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def changed_people(before: DataFrame, now: DataFrame, data: MasterData, as_of: str | date) -> DataFrame:
    """Resource_Id of everyone with a fingerprint that is new, gone or different."""
    old = before.select("kind", "key", F.struct("rows", "x1", "x2").alias("was"))
    new = now.select("kind", "key", F.struct("rows", "x1", "x2").alias("is"))
    changed = old.join(new, ["kind", "key"], "full").filter(~F.col("was").eqNullSafe(F.col("is"))).select("kind", "key")
    people = changed.filter("kind <> 'hours'").select(F.col("key").alias("Resource_Id"))
    # An assignment that changed its owner has changed both people's assignments already.
    owners = eligible_assignments(data.assignments, as_of).select("ActivityAssignment_Id", "Resource_Id")
    hours = changed.filter("kind = 'hours'").select(F.col("key").alias("ActivityAssignment_Id"))
    return people.unionByName(owners.join(hours, "ActivityAssignment_Id", "left_semi").select("Resource_Id")).distinct()


def _only(data: MasterData, people: DataFrame) -> MasterData:
    assignments = data.assignments.join(people, "Resource_Id", "left_semi")
    return replace(
        data,
        assignments=assignments,
        time_entries=data.time_entries.join(assignments.select("ActivityAssignment_Id"), "ActivityAssignment_Id", "left_semi"),
        leave=data.leave.join(people, "Resource_Id", "left_semi"),
    )


def refresh_calendar(
    spark: SparkSession, data: MasterData, folder: str, as_of: str | date, buckets: int = BUCKETS
) -> list[int]:
    """Brings the calendar stored under `folder` up to date; returns the buckets of people rewritten.

    The first run for an as-of date builds everything. Later runs compare fingerprints, recompute
    the calendar of changed, new and vanished people alone and rewrite only their buckets. The
    fingerprints are stored last: a run that breaks off is done again by the next one. Runs jobs.
    """
    day = as_date(as_of).isoformat()
    store = BucketedStore(spark, f"{folder}/calendar-{day}", "Resource_Id", buckets)
    seen = f"{folder}/seen-{day}"
    now = written(fingerprints(data, as_of), fresh_path(spark, "fingerprints"))
    if not _is_table(spark, seen) or not store.exists():
        store.create(consultant_calendar(data, as_of))
        touched = list(range(buckets))
    else:
        people = written(changed_people(spark.read.parquet(seen), now, data, as_of), fresh_path(spark, "changed-people"))
        touched = store.replace(consultant_calendar(_only(data, people), as_of), people)
    now.write.mode("overwrite").parquet(seen)
    return touched


def stored_calendar(spark: SparkSession, folder: str, as_of: str | date) -> DataFrame:
    """The calendar that `refresh_calendar` keeps."""
    return BucketedStore(spark, f"{folder}/calendar-{as_date(as_of).isoformat()}", "Resource_Id").read()
