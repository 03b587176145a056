"""Utilisation summary (metrics × weeks) and detail (person × weeks)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.functions.dates import ReportingYear
from crewcast.functions.numbers import count_text, fixed_text
from crewcast.operators.reshape import wide_weeks
from crewcast.plans.calendar import BENCH, BOOKED, ON_LEAVE, PARTLY, UNCONFIRMED
from crewcast.sources.master import require_columns

DETAIL_KEYS = ("Consultant_Name", "Level", "Group", "Location")


def weekly_utilisation(calendar: DataFrame) -> DataFrame:
    """One row per week with the eight figures as numbers.

    Booked capacity is summed as decimal: the result does not depend on the order of the rows.
    """
    require_columns(
        calendar, ("WeekStart", "CalendarStatus", "CalendarCapacity"), "Consultant calendar"
    )
    status = F.coalesce("CalendarStatus", F.lit(""))
    booked = F.when(
        status.isin(BOOKED, PARTLY),
        F.coalesce(F.col("CalendarCapacity"), F.lit(0.0)).cast("decimal(18,2)"),
    ).otherwise(F.lit(0).cast("decimal(18,2)"))
    return (
        calendar.groupBy("WeekStart")
        .agg(
            *[
                F.count_if(status == value).alias(name)
                for name, value in (
                    ("Booked", BOOKED),
                    ("Unconfirmed", UNCONFIRMED),
                    ("Partly Booked", PARTLY),
                    ("On Leave", ON_LEAVE),
                    ("Bench", BENCH),
                )
            ],
            F.sum(booked).cast("decimal(18,2)").alias("Booked Capacity"),
            F.count_if(status != ON_LEAVE).alias("Maximum Capacity"),
        )
        .withColumn(
            "Forecasted Allocation",
            F.col("Booked Capacity").cast("double")
            / F.nullif(F.col("Maximum Capacity"), F.lit(0)).cast("double"),
        )
    )


def weekly_metrics(calendar: DataFrame) -> DataFrame:
    """MetricOrder, Utilisation, WeekStart, MetricValue: the figures as text, one per row."""
    counts = ("Booked", "Unconfirmed", "Partly Booked", "On Leave", "Bench")
    texts = {
        **{name: count_text(F.col(f"`{name}`")) for name in counts},
        "Booked Capacity": fixed_text(F.col("`Booked Capacity`"), 2),
        "Maximum Capacity": fixed_text(F.col("`Maximum Capacity`"), 2),
        "Forecasted Allocation": fixed_text(F.col("`Forecasted Allocation`"), 6),
    }
    rows = F.array(
        *[
            F.struct(
                F.lit(n).alias("MetricOrder"),
                F.lit(name).alias("Utilisation"),
                text.alias("MetricValue"),
            )
            for n, (name, text) in enumerate(texts.items(), start=1)
        ]
    )
    return weekly_utilisation(calendar).select("WeekStart", F.inline(rows))


def utilisation(calendar: DataFrame, as_of: str | date) -> DataFrame:
    wide = wide_weeks(
        weekly_metrics(calendar),
        ("MetricOrder", "Utilisation"),
        "WeekStart",
        "MetricValue",
        ReportingYear.of(as_of).weeks,
        owner="MetricOrder",
    )
    return wide.orderBy("MetricOrder").drop("MetricOrder")


def utilisation_detailed(calendar: DataFrame, as_of: str | date) -> DataFrame:
    """Fails when two people share name, level, group and location."""
    needed = (*DETAIL_KEYS, "Resource_Id", "WeekStart", "CalendarValue")
    require_columns(calendar, needed, "Consultant calendar")
    weeks = ReportingYear.of(as_of).weeks
    wide = wide_weeks(
        calendar, DETAIL_KEYS, "WeekStart", "CalendarValue", weeks, owner="Resource_Id"
    )
    return wide.orderBy(*[F.col(k).asc_nulls_last() for k in DETAIL_KEYS])
