"""Head counts of the calendar by week, month, group, level and status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.operators.head_counts import bitmaps, numbered_keys, rolled_up
from crewcast.sources.master import require_columns
from crewcast.sources.shared_storage import fresh_path, written

WEEKLY = ("Month", "WeekStart", "Group", "Level", "CalendarStatus")

# From the whole detail to all people of the year; a person counts once in each.
ROLL_UPS = (
    ("WeekStart", "Group", "Level", "CalendarStatus"),
    ("WeekStart", "Group", "CalendarStatus"),
    ("WeekStart", "CalendarStatus"),
    ("Month", "Group", "Level", "CalendarStatus"),
    ("Month", "Group", "CalendarStatus"),
    ("Month", "Group"),
    ("Month", "CalendarStatus"),
    ("Group", "Level"),
    ("Group", "CalendarStatus"),
    ("CalendarStatus",),
    (),
)


def weekly_people(calendar: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Bitmaps of the people of each week, group, level and status; a week belongs to its Monday's month.

    Give the numbers of an earlier table to get bitmaps that can be merged with its own. Runs jobs
    while it is built.
    """
    require_columns(calendar, ("Resource_Id", *WEEKLY[1:]), "Consultant calendar")
    if numbers is None:
        numbers = numbered_keys(calendar, "Resource_Id", ("Group", "Level"))
    with_month = calendar.withColumn("Month", F.trunc("WeekStart", "month"))
    return bitmaps(with_month, numbers, "Resource_Id", WEEKLY)


def utilisation_rollup(calendar: DataFrame) -> DataFrame:
    """How many different people each group of ROLL_UPS holds, all from one table of weekly bitmaps."""
    table = written(weekly_people(calendar), fresh_path(calendar.sparkSession, "weekly-people"))
    return rolled_up(table, ROLL_UPS, "people")
