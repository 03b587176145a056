"""Checks that are taken while the reports are written."""

from __future__ import annotations

from pyspark.sql import DataFrame

from crewcast.plans.refresh import refresh_reports
from crewcast.sources.report_store import ReportStore
from crewcast.sources.shared_storage import fresh_path
from crewcast.sources.star_schema import AS_OF, StarSchema
from duckcheck.case import Case, case
from duckcheck.report_cases import BENCH_SQL, DETAIL_SQL, PARTIAL_SQL, PROJECT_SQL, TRACKER_SQL, UTILISATION_SQL


def _quality(s: StarSchema) -> DataFrame:
    folder = fresh_path(s.spark, "checked-reports")
    refresh_reports(s.spark, s.master(), folder, AS_OF)
    return ReportStore(s.spark, folder).load_quality()


def _checks(report: str, sql: str, keys: tuple[str, ...], ranges: tuple[str, ...], more: dict[str, str] | None = None) -> str:
    values = {"rows": "count(*)"}
    values |= {f"missing {k}": f"count(*) - count(nullif(trim(\"{k}\"), ''))" for k in keys}
    values |= {f"lowest {c}": f'min("{c}")' for c in ranges} | {f"highest {c}": f'max("{c}")' for c in ranges}
    values |= more or {}
    rows = ", ".join(f"{{'check': '{name}', 'value': CAST({value} AS VARCHAR)}}" for name, value in values.items())
    return f"SELECT '{report}' AS report, unnest([{rows}], recursive := true) FROM ({sql})"


_STATUSES = {f"status {n}": f"count(*) FILTER (WHERE CalendarStatus = '{n}')" for n in ("BOOKED", "UNCONFIRMED", "PARTLY_BOOKED", "ON_LEAVE", "BENCH")}
_IMPOSSIBLE = {
    "capacity outside 0-1": "count(*) FILTER (WHERE CalendarCapacity NOT BETWEEN 0 AND 1)",
    "negative hours": "count(*) FILTER (WHERE least(Logged_Hours, Leave_Hours) < 0)",
    "leave without text": "count(*) FILTER (WHERE Is_Leave AND Leave_Info = '')",
}
QUALITY_SQL = "\nUNION ALL ".join(
    (
        _checks(
            "consultant_calendar", "SELECT * FROM calendar", ("Resource_Id", "Consultant_Name", "Group", "Level"),
            ("Expected_Availability_Date", "Active_Projects", "WeekStart"), _STATUSES | _IMPOSSIBLE,
        ),
        _checks("consultant_tracker", TRACKER_SQL, ("Group", "Consultant_Name"), ("Active_Projects",)),
        _checks("project_tracker", PROJECT_SQL, ("Consultant_Name", "Project_Name"), ("Assignment_Start", "Assignment_End")),
        _checks("utilisation", UTILISATION_SQL, ("Utilisation",), ()),
        _checks("utilisation_detailed", DETAIL_SQL, ("Consultant_Name", "Level", "Group", "Location"), ()),
        _checks("bench_status", BENCH_SQL, ("Consultant_Name", "Last Project"), ("Bench Weeks",)),
        _checks(
            "partial_assignments", PARTIAL_SQL, ("Resource ID", "Resource name", "Client"),
            ("Weeks assigned to project (<100% billable)",),
        ),
    )
)

CASES: dict[str, Case] = {"refresh_quality": case(_quality, QUALITY_SQL)}
