"""Week arithmetic and date parsing."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

WEEK = timedelta(days=7)
OPEN_END = date(9999, 12, 31)


def as_date(value: str | date | datetime) -> date:
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    return datetime.fromisoformat(value).date()


def monday_of(day: date) -> date:
    return day - timedelta(days=day.weekday())


def monday_on_or_after(day: date) -> date:
    return monday_of(day + timedelta(days=6))


def weeks_between(first: date, last: date) -> list[date]:
    return [first + WEEK * n for n in range((last - first).days // 7 + 1)]


@dataclass(frozen=True)
class ReportingYear:
    """Dates of the calendar year around an as-of date.

    Plain driver-side values: they enter the plans as literals, so that filters on them
    reach the scans.
    """

    as_of: date

    @classmethod
    def of(cls, as_of: str | date | datetime) -> ReportingYear:
        return cls(as_date(as_of))

    @property
    def first_day(self) -> date:
        return date(self.as_of.year, 1, 1)

    @property
    def last_day(self) -> date:
        return date(self.as_of.year, 12, 31)

    @property
    def current_week(self) -> date:
        return monday_of(self.as_of)

    @property
    def first_week(self) -> date:
        return monday_on_or_after(self.first_day)

    @property
    def last_week(self) -> date:
        return monday_of(self.last_day)

    @property
    def weeks(self) -> list[date]:
        return weeks_between(self.first_week, self.last_week)


def completed_weeks(as_of: date, count: int = 52) -> list[date]:
    """Mondays of the completed weeks before as_of's week, newest first."""
    this_week = monday_of(as_of)
    return [this_week - WEEK * n for n in range(1, count + 1)]


def year_before(day: date) -> date:
    """One calendar year earlier; 29 February becomes 28 February."""
    try:
        return day.replace(year=day.year - 1)
    except ValueError:
        return day.replace(year=day.year - 1, day=28)


def next_month_bounds(day: date) -> tuple[date, date]:
    """First day of the next month and of the month after it."""
    month = day.year * 12 + day.month
    return date(month // 12, month % 12 + 1, 1), date((month + 1) // 12, (month + 1) % 12 + 1, 1)


def closest_week(weeks: list[date], target: date) -> date:
    """The week start nearest to target; the earlier one wins a tie."""
    return min(sorted(weeks), key=lambda w: abs((w - target).days))


def monday(col: Column) -> Column:
    return F.trunc(col, "week")


def extract_week_start(col: Column) -> Column:
    """Week start as the extracts count it: weeks turn over on Sunday, named by their Monday.

    A Sunday therefore belongs to the Monday that follows it.
    """
    origin = F.lit(date(1900, 1, 1))
    weeks = F.floor((F.datediff(col.cast("date"), origin) + 1) / 7)
    return F.date_add(origin, (weeks * 7).cast("int"))


def iso_text(col: Column) -> Column:
    return F.date_format(col, "yyyy-MM-dd")


# Accepted date layouts in order of preference (guard pattern, date pattern).
DATE_LAYOUTS = (
    (r"\A\d{4}-\d{1,2}-\d{1,2}\z", "yyyy-M-d"),
    (r"\A\d{1,2}/\d{1,2}/\d{4}\z", "d/M/yyyy"),
    (r"\A\d{1,2}/\d{1,2}/\d{4}\z", "M/d/yyyy"),
    (r"\A\d{1,2}-\d{1,2}-\d{4}\z", "d-M-yyyy"),
    (r"\A\d{1,2}-\d{1,2}-\d{4}\z", "M-d-yyyy"),
)

# Dates looked for inside a question, in this order.
DATE_IN_TEXT = (
    r"\b\d{4}-\d{2}-\d{2}\b",
    r"\b\d{2}/\d{2}/\d{4}\b",
    r"\b\d{2}-\d{2}-\d{4}\b",
)


def parse_date(col: Column) -> Column:
    """First layout that yields a real date; null when none does."""
    return F.coalesce(
        *[F.when(col.rlike(guard), F.try_to_date(col, layout)) for guard, layout in DATE_LAYOUTS]
    )


def dates_in_text(col: Column) -> Column:
    """array<string> of the ISO dates found in a text, pattern by pattern."""
    found = F.concat(*[F.regexp_extract_all(col, F.lit(p), F.lit(0)) for p in DATE_IN_TEXT])
    parsed = F.transform(found, lambda t: iso_text(parse_date(t)))
    return F.filter(parsed, lambda d: d.isNotNull())


def recency_label(updated_at: Column, as_of: date) -> Column:
    days = F.datediff(F.lit(as_of), updated_at.cast("date"))
    return (
        F.when(days == 0, "Today")
        .when(days == 1, "Yesterday")
        .when(days <= 7, "Previous 7 days")
        .otherwise("Older")
    )
