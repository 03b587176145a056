"""Filters and per-person aggregates over assignments.

Per-person "last row" rules are written as max_by aggregates, not as windows: aggregates are
combined on the map side, so a person who owns a large share of the rows never has them gathered
in one task.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import OPEN_END, WEEK, ReportingYear, as_date, monday, monday_of
from crewcast.functions.text import strip

START, END = "Assignment_Start", "Assignment_End"


def non_blank(name: str) -> Column:
    return strip(F.coalesce(F.col(name), F.lit(""))) != ""


def _overlaps(first: date, last: date) -> Column:
    return (F.col(START) <= F.lit(last)) & (
        F.col(END).isNull() | (F.col(END) >= F.lit(first))
    )


def eligible_assignments(assignments: DataFrame, as_of: str | date) -> DataFrame:
    """Assignments with a person, a name and a project that overlap the as-of date's year."""
    year = ReportingYear.of(as_of)
    return assignments.filter(
        F.col("Resource_Id").isNotNull()
        & non_blank("Consultant_Name")
        & non_blank("Project_Name")
        & _overlaps(year.first_day, year.last_day)
    )


def eligible_resource_ids(assignments: DataFrame, as_of: str | date) -> DataFrame:
    return eligible_assignments(assignments, as_of).select("Resource_Id").distinct()


def active_on(day: str | date) -> Column:
    target = as_date(day)
    return F.coalesce(_overlaps(target, target) & non_blank("Project_Name"), F.lit(False))


def active_in_week(day: str | date) -> Column:
    week = monday_of(as_date(day))
    return F.coalesce(
        _overlaps(week, week + WEEK - (WEEK / 7)) & non_blank("Project_Name"), F.lit(False)
    )


def recency_key() -> Column:
    """Orders a person's assignments by end (open end last), then start, then a fixed tie-break."""
    return F.struct(
        F.coalesce(F.col(END), F.lit(OPEN_END)),
        F.col(START),
        F.col("Project_Name"),
        F.col("ActivityAssignment_Id"),
    )


def last_known(name: str) -> Column:
    """Latest non-null value of a column."""
    return F.max_by(F.col(name), F.when(F.col(name).isNotNull(), recency_key()))


def _future_week_mask(year: ReportingYear) -> Column:
    """Bit n is set when the assignment touches the year's week n and that week is still ahead.

    A year has at most 53 weeks, so a person's future weeks fit one bigint and can be merged
    with bit_or during the per-person aggregation: no row per assignment and week, no distinct,
    no range join.
    """
    first_ahead = max(year.first_week, year.current_week + WEEK)
    if first_ahead > year.last_week:
        return F.lit(0).cast("bigint")
    weeks_ahead = (year.last_week - first_ahead).days // 7 + 1
    offset = (first_ahead - year.first_week).days // 7
    from_week = F.greatest(monday(F.col(START)), F.lit(first_ahead))
    to_week = F.least(
        monday(F.coalesce(F.col(END), F.lit(year.last_week))), F.lit(year.last_week)
    )
    low = (F.datediff(from_week, F.lit(first_ahead)) / 7).cast("int")
    high = (F.datediff(to_week, F.lit(first_ahead)) / 7).cast("int")
    all_ahead = F.lit((1 << weeks_ahead) - 1).cast("bigint")
    from_low_on = F.call_function("shiftleft", all_ahead, low)
    up_to_high = F.call_function("shiftright", all_ahead, F.lit(weeks_ahead - 1) - high)
    mask = F.call_function("shiftleft", from_low_on.bitwiseAND(up_to_high), F.lit(offset))
    return F.when((low <= high) & (high >= 0) & (low < weeks_ahead), mask).otherwise(
        F.lit(0).cast("bigint")
    )


def has_week_bit(mask: Column, week: Column, year: ReportingYear) -> Column:
    index = (F.datediff(week, F.lit(year.first_week)) / 7).cast("int")
    return F.call_function("shiftright", mask, index).bitwiseAND(F.lit(1).cast("bigint")) == 1


def person_directory(eligible: DataFrame, as_of: str | date) -> DataFrame:
    """One row per person: latest known details, expected availability, future-week mask."""
    return eligible.groupBy("Resource_Id").agg(
        *[
            last_known(c).alias(c)
            for c in ("Consultant_Name", "Level", "Group", "Job_Title", "Location")
        ],
        F.max(END).alias("Expected_Availability_Date"),
        F.bit_or(_future_week_mask(ReportingYear.of(as_of))).alias("_future_weeks"),
    )


def active_project_counts(eligible: DataFrame, as_of: str | date) -> DataFrame:
    """Distinct projects per person active on the date; two small steps, both combined map-side."""
    return (
        eligible.filter(active_on(as_of) & F.col("PROJECT_ID").isNotNull())
        .select("Resource_Id", "PROJECT_ID")
        .distinct()
        .groupBy("Resource_Id")
        .agg(F.count("*").alias("Active_Projects"))
    )


def future_assignment_weeks(eligible: DataFrame, as_of: str | date) -> DataFrame:
    """Distinct (person, week) pairs with an assignment in a week after the current one."""
    year = ReportingYear.of(as_of)
    weeks = F.sequence(F.lit(year.first_week), F.lit(year.last_week), F.expr("interval 7 days"))
    return (
        eligible.groupBy("Resource_Id")
        .agg(F.bit_or(_future_week_mask(year)).alias("mask"))
        .filter(F.col("mask") != 0)
        .select("Resource_Id", "mask", F.explode(weeks).alias("WeekStart"))
        .filter(has_week_bit(F.col("mask"), F.col("WeekStart"), year))
        .select("Resource_Id", "WeekStart", F.lit(True).alias("Has_Future_Assignment"))
    )


# Weeks of one mask: a bigint's bits without the sign.
_WEEKS_PER_MASK = 62


def assignment_weeks(assignments: DataFrame, first: str | date, last: str | date) -> DataFrame:
    """Distinct (Resource_Id, WeekStart) with an assignment in a week from first's to last's, over any span of years.

    Counts assignments with a person, a name and a project, whatever year they begin in; a null
    end is open and reaches to the last week. Each person's weeks are bits, one bigint per 62 weeks,
    merged on the map side: overlapping and open assignments make no rows of their own.
    """
    week, end = monday_of(as_date(first)), monday_of(as_date(last))
    masks = []
    while week <= end:
        count = min(_WEEKS_PER_MASK, (end - week).days // 7 + 1)
        low = F.greatest(F.floor(F.datediff(monday(F.col(START)), F.lit(week)) / 7), F.lit(0))
        closed = F.floor(F.datediff(monday(F.coalesce(F.col(END), F.lit(end))), F.lit(week)) / 7)
        high = F.least(closed, F.lit(count - 1))
        every = F.lit((1 << count) - 1).cast("bigint")
        bits = F.call_function("shiftleft", every, low.cast("int")).bitwiseAND(
            F.call_function("shiftright", every, (F.lit(count - 1) - high).cast("int"))
        )
        masks.append((week, count, F.when((low <= high) & (high >= 0), bits).otherwise(F.lit(0).cast("bigint"))))
        week += WEEK * count
    counted = assignments.filter(
        F.col("Resource_Id").isNotNull() & F.col(START).isNotNull() & non_blank("Consultant_Name") & non_blank("Project_Name")
        & (F.col(START) <= F.lit(end + WEEK)) & (F.col(END).isNull() | (F.col(END) >= F.lit(monday_of(as_date(first)))))
        & (F.col(END).isNull() | (F.col(START) <= F.col(END)))
    )
    people = counted.groupBy("Resource_Id").agg(*[F.bit_or(mask).alias(f"_m{n}") for n, (_, _, mask) in enumerate(masks)])

    def set_weeks(mask: Column, start: date, count: int) -> Column:
        def is_set(week: Column) -> Column:
            bit = (F.datediff(week, F.lit(start)) / 7).cast("int")
            return F.call_function("shiftright", mask, bit).bitwiseAND(F.lit(1).cast("bigint")) == 1

        return F.filter(F.sequence(F.lit(start), F.lit(start + WEEK * (count - 1)), F.expr("interval 7 days")), is_set)

    weeks = [set_weeks(F.col(f"_m{n}"), start, count) for n, (start, count, _) in enumerate(masks)]
    return people.select("Resource_Id", F.explode(F.flatten(F.array(*weeks))).alias("WeekStart"))
