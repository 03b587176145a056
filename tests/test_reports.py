from datetime import date

import pytest
from pyspark.sql import functions as F

from crewcast.plans.bench_status import bench_status
from crewcast.plans.partial_assignments import partial_assignments
from crewcast.plans.project_tracker import project_tracker
from crewcast.plans.refresh import refresh_reports
from crewcast.sources.master import MasterData, require_columns
from crewcast.sources.report_store import ReportStore, export_csv, index_documents
from tests.workforce import AS_OF, assignment, hours, leave, master


def test_bench(spark):
    data = master(
        spark,
        [
            assignment("active", "a1", "2026-07-01", "2026-07-20"),
            assignment("open", "a2", "2026-07-01", None),
            assignment("six", "a3", "2026-05-01", "2026-07-14"),
            assignment("thirteen", "a4", "2026-05-01", "2026-07-07"),
            assignment("fourteen", "a5", "2026-05-01", "2026-07-06", project="Old"),
            assignment("fourteen", "a6", "2026-09-01", None, Job_Title=None, project="New"),
            assignment("future", "a7", "2026-09-01", "2026-10-01"),
            assignment("gone", "a8", "2025-01-01", "2025-12-31"),
        ],
    )
    report = {r["Consultant_Name"]: r for r in bench_status(data, AS_OF).collect()}
    assert {n: r["Bench Weeks"] for n, r in report.items()} == {
        "Person six": 0, "Person thirteen": 1, "Person fourteen": 2, "Person future": None,
    }
    assert list(report)[0] == "Person fourteen" and list(report)[-1] == "Person future"
    assert report["Person fourteen"]["Last Project"] == "Old"
    assert report["Person fourteen"]["Job_Title"] is None  # the last row's null stays
    assert report["Person future"]["Last Project"] is None
    assert report["Person future"]["Possible Next Assignment"] == ""


def test_partial(spark):
    data = master(
        spark,
        [
            assignment("1", "a1", "2026-01-01", None),
            assignment("1", "a2", "2026-01-01", None),
            assignment("2", "a3", "2026-01-01", None, project_id=None),
            assignment("3", "a4", "2026-01-01", "2026-07-19"),
        ],
        [
            hours("a1", "2026-07-13", 10), hours("a2", "2026-07-13", 5),  # together 15 h
            hours("a1", "2026-07-06", 40), hours("a1", "2026-06-29", 20),
            hours("a1", "2026-07-20", 10),  # current week does not count
            hours("a1", "2025-07-14", 10),  # older than 52 weeks
            hours("a3", "2026-07-13", 10), hours("a4", "2026-07-13", 10),
        ],
    )
    report = partial_assignments(data, AS_OF).collect()
    assert len(report) == 1
    assert report[0]["Weeks assigned to project (<100% billable)"] == 2
    assert report[0]["Time (%)"] == 43.75


def test_project_tracker(spark):
    data = master(
        spark,
        [
            assignment("1", "a1", "2020-01-01", "2020-02-01"),
            assignment("1", "a2", "2026-01-01", None, project="B"),
            assignment("2", "a3", "2026-01-01", None, project=""),
        ],
        [
            hours("a1", "2026-07-13", 8), hours("a1", "2026-07-06", 8), hours("a1", "2026-06-29", 8),
            hours("a2", "2026-07-13", 8), hours("a2", "2026-07-06", 0), hours("a2", "2026-06-29", 8),
        ],
        [
            leave("1", "2026-07-13", 8, "B text"), leave("1", "2026-07-13", 8, "A text"),
            leave("1", "2026-07-13", 8, "A text"), leave("1", "2026-07-06", 8, " None "),
        ],
    )
    report = project_tracker(data, AS_OF)
    assert len(report.columns) == 10 + 3 * 52
    assert report.columns[10:13] == ["Logged_Hours_2026-07-13", "Leave_2026-07-13", "Consumed_Days_2026-07-13"]
    assert report.columns[-1] == "Consumed_Days_2025-07-21"
    first, second = report.collect()
    assert (first["Project_Name"], first["Submission"]) == ("B", "Inactive")
    assert (second["Project_Name"], second["Submission"]) == ("Client A", "Active")
    assert second["Leave_2026-07-13"] == "A text, B text"
    assert second["Leave_2026-07-06"] == second["Leave_2025-07-21"] == "0 hours"
    assert second["Consumed_Days_2026-07-13"] == 1.0 and second["Logged_Hours_2025-07-21"] == 0.0
    assert second["Assignment_Start"] == date(2020, 1, 1)


def test_empty_reports(spark):
    data = master(spark)
    assert bench_status(data, AS_OF).count() == 0
    assert partial_assignments(data, AS_OF).count() == 0
    assert project_tracker(data, AS_OF).count() == 0


def test_required_columns(spark):
    data = master(spark)
    with pytest.raises(ValueError, match="assignments is missing required columns: Group, Level"):
        MasterData.of(data.assignments.drop("Level", "Group"), data.time_entries, data.leave)
    with pytest.raises(ValueError, match="t is missing required columns: x"):
        require_columns(data.leave, ["x"], "t")


def test_summary(spark):
    data = master(
        spark,
        [assignment("1", "a", "2026-01-01", None), assignment("1", "b", "2026-01-01", None, project="")],
        [hours("a", "2026-07-13", 1)],
    )
    assert data.summary().first().asDict() == {
        "assignment_rows": 2, "time_entry_rows": 1, "leave_rows": 0, "consultants": 1, "projects": 1,
    }


def test_refresh_saves_all_and_reports_failures(spark, tmp_path):
    good = master(spark, [assignment("1", "a", "2026-01-01", None)])
    seconds = refresh_reports(spark, good, str(tmp_path / "good"), AS_OF)
    assert len(seconds) == 6
    store = ReportStore(spark, str(tmp_path / "good"))
    assert store.load(" Consultant_Tracker ").count() == 1
    twins = [assignment(p, p, "2026-01-01", None, name="Ann") for p in "12"]
    with pytest.raises(RuntimeError, match="1 report.*utilisation_detailed"):
        refresh_reports(spark, master(spark, twins), str(tmp_path / "bad"), AS_OF)
    assert ReportStore(spark, str(tmp_path / "bad")).load("bench_status").count() == 0


def test_unknown_report(spark):
    with pytest.raises(KeyError, match="Unknown report: nope. Available reports: bench_status, consultant_tracker"):
        ReportStore(spark, "/nowhere").path("nope")


def test_csv_has_no_status_columns_and_text_dates(spark, tmp_path):
    df = spark.sql("SELECT 'B' AS `2026-01-05`, 'BENCH' AS `2026-01-05__STATUS`, date'2026-01-05' AS d")
    export_csv(df, str(tmp_path / "csv"))
    lines = [r[0] for r in spark.read.text(str(tmp_path / "csv")).collect()]
    assert sorted(lines) == ["2026-01-05,d", "B,2026-01-05"]


def test_index_sink_refuses_bad_rows(spark, tmp_path):
    rows = spark.createDataFrame([("1", "text"), ("2", " ")], "id string, content string")
    with pytest.raises(RuntimeError, match="could not be indexed"):
        index_documents(rows, str(tmp_path / "index"))
    assert index_documents(rows.filter(F.col("id") == "1"), str(tmp_path / "index")) == 1
    again = spark.createDataFrame([("1", "new"), ("3", "three")], "id string, content string")
    assert index_documents(again, str(tmp_path / "index")) == 2
    stored = spark.read.parquet(str(tmp_path / "index"))
    assert sorted(map(tuple, stored.collect())) == [("1", "new"), ("3", "three")]
    with pytest.raises(ValueError, match="repeated keys"):
        index_documents(again.union(again), str(tmp_path / "index"))
