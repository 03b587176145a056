"""Checks computed by the write itself."""

import time
import uuid
from datetime import date

import pytest
from pyspark.sql import functions as F

from crewcast.operators.observed import observed_write, standard_checks
from crewcast.plans.refresh import refresh_reports
from crewcast.sources.report_store import ReportStore
from tests.workforce import AS_OF, assignment, hours, master


def jobs_of(spark, action):
    group = str(uuid.uuid4())
    spark.sparkContext.setJobGroup(group, "counted")
    try:
        result = action()
        # The status store learns of jobs a little later.
        time.sleep(1)
        return result, len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_values_of_nulls_blanks_ranges_and_odd_names(spark, tmp_path):
    df = spark.createDataFrame(
        [("a", 3, date(2026, 1, 5)), (" ", None, None), (None, -2, date(2025, 1, 5)), ("a", 3, date(2026, 1, 5))],
        "`key, of. it` string, n int, day date",
    )
    seen = observed_write(df, str(tmp_path / "t"), standard_checks(df, ["key, of. it"]))
    assert seen == {
        "rows": "4", "missing key, of. it": "2", "lowest n": "-2", "highest n": "3",
        "lowest day": "2025-01-05", "highest day": "2026-01-05",
    }
    assert spark.read.parquet(str(tmp_path / "t")).count() == 4


@pytest.mark.parametrize("empty", ["rows", "filter", "join"])
def test_empty_tables_have_checks_too(spark, tmp_path, empty):
    df = spark.createDataFrame([], "key string, n int") if empty == "rows" else spark.range(5).selectExpr("'x' AS key", "cast(id AS int) AS n")
    if empty == "filter":
        df = df.filter("1 = 0")
    if empty == "join":
        df = df.join(df.filter("n > 99").select(F.col("n").alias("m")), F.col("n") == F.col("m")).drop("m")
    seen = observed_write(df, str(tmp_path / "t"), standard_checks(df, ["key"]))
    assert seen == {"rows": "0", "missing key": "0", "lowest n": None, "highest n": None}


def test_a_sorted_table_is_counted_once_and_no_job_is_added(spark, tmp_path):
    df = spark.range(0, 20_000, 1, 8).selectExpr("id % 7 AS key", "id AS n").groupBy("key").agg(F.max("n").alias("n"))
    df = df.unionByName(spark.range(0, 5_000, 1, 8).selectExpr("id AS key", "id AS n")).orderBy("n")
    _, plain = jobs_of(spark, lambda: df.write.parquet(str(tmp_path / "plain")))
    seen, observed = jobs_of(spark, lambda: observed_write(df, str(tmp_path / "t"), standard_checks(df, ["key"])))
    assert seen["rows"] == "5007" and seen["highest n"] == "19999"
    assert observed == plain


def test_refresh_keeps_the_checks_of_the_calendar_and_all_reports(spark, tmp_path):
    data = master(
        spark,
        [assignment("1", "A", "2026-01-01", "2026-12-31"), assignment("2", "B", "2026-01-01", "2026-02-01", Location=None)],
        [hours("A", "2026-02-02", 20)],
    )
    refresh_reports(spark, data, str(tmp_path), AS_OF)
    store = ReportStore(spark, str(tmp_path))
    values = {(r["report"], r["check"]): r["value"] for r in store.load_quality().collect()}
    assert values["consultant_calendar", "rows"] == str(2 * 52)
    assert values["consultant_calendar", "status PARTLY_BOOKED"] == "1"
    assert values["utilisation_detailed", "missing Location"] == "1"
    assert values["bench_status", "rows"] == "1"
    for name in ("bench_status", "consultant_tracker", "project_tracker", "utilisation", "utilisation_detailed", "partial_assignments"):
        assert values[name, "rows"] == str(store.load(name).count())
