"""Builds and saves every report."""

from __future__ import annotations

import logging
from collections.abc import Callable
from datetime import date
from time import perf_counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewcast.operators.observed import observed_write, standard_checks
from crewcast.plans.bench_status import bench_status
from crewcast.plans.calendar import STATUS_COLOURS, consultant_calendar
from crewcast.plans.consultant_tracker import consultant_tracker
from crewcast.plans.partial_assignments import partial_assignments
from crewcast.plans.project_tracker import project_tracker
from crewcast.plans.utilisation import utilisation, utilisation_detailed
from crewcast.sources.master import MasterData
from crewcast.sources.report_store import ReportStore
from crewcast.sources.shared_storage import fresh_path

# The columns of each report that no row should be without.
REPORT_KEYS = {
    "consultant_tracker": ("Group", "Consultant_Name"),
    "project_tracker": ("Consultant_Name", "Project_Name"),
    "utilisation": ("Utilisation",),
    "utilisation_detailed": ("Consultant_Name", "Level", "Group", "Location"),
    "bench_status": ("Consultant_Name", "Last Project"),
    "partial_assignments": ("Resource ID", "Resource name", "Client"),
}

log = logging.getLogger(__name__)


def report_builders(
    data: MasterData, calendar: Callable[[], DataFrame], as_of: str | date
) -> dict[str, Callable[[], DataFrame]]:
    return {
        "consultant_tracker": lambda: consultant_tracker(calendar(), as_of),
        "project_tracker": lambda: project_tracker(data, as_of),
        "utilisation": lambda: utilisation(calendar(), as_of),
        "utilisation_detailed": lambda: utilisation_detailed(calendar(), as_of),
        "bench_status": lambda: bench_status(data, as_of),
        "partial_assignments": lambda: partial_assignments(data, as_of),
    }


def calendar_checks(calendar: DataFrame) -> dict[str, Column]:
    """The standard checks, rows per status, and values that cannot be."""
    status, capacity, hours = F.col("CalendarStatus"), F.col("CalendarCapacity"), F.col("Logged_Hours")
    return {
        **standard_checks(calendar, ("Resource_Id", "Consultant_Name", "Group", "Level")),
        **{f"status {name}": F.count_if(status == name) for name in STATUS_COLOURS},
        "capacity outside 0-1": F.count_if((capacity < 0) | (capacity > 1)),
        "negative hours": F.count_if((hours < 0) | (F.col("Leave_Hours") < 0)),
        "leave without text": F.count_if(F.col("Is_Leave") & (F.col("Leave_Info") == "")),
    }


def refresh_reports(
    spark: SparkSession, data: MasterData, folder: str, as_of: str | date
) -> dict[str, float]:
    """Saves all six reports and returns the seconds each took.

    The calendar is written once to shared storage and read by the three reports that need it.
    A report that fails does not stop the others; the run fails at its end. Counts, ranges and
    violations of the calendar and of every saved report are taken by the jobs that write them and
    kept in the store's quality table.
    """
    store = ReportStore(spark, folder)
    table: list[DataFrame] = []
    quality: list[tuple[str, str, str | None]] = []

    def calendar() -> DataFrame:
        if not table:
            built, path = consultant_calendar(data, as_of), fresh_path(spark, "consultant-calendar")
            seen = observed_write(built, path, calendar_checks(built))
            quality.extend(("consultant_calendar", check, value) for check, value in seen.items())
            table.append(spark.read.schema(built.schema).parquet(path))
        return table[0]

    seconds: dict[str, float] = {}
    failures: dict[str, str] = {}
    for name, build in report_builders(data, calendar, as_of).items():
        started = perf_counter()
        try:
            report = build()
            seen = store.save_checked(name, report, standard_checks(report, REPORT_KEYS[name]))
            quality.extend((name, check, value) for check, value in seen.items())
            seconds[name] = perf_counter() - started
            log.info("%s saved in %.1f s", name, seconds[name])
        except Exception as error:  # one bad report must not stop the rest
            failures[name] = str(error)
            log.error("%s failed: %s", name, error)
    store.save_quality(quality)
    if failures:
        raise RuntimeError(
            f"{len(failures)} report(s) could not be generated: "
            + "; ".join(f"{n}: {m[:200]}" for n, m in failures.items())
        )
    return seconds
