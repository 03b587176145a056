from datetime import date

import pytest
from pyspark.sql import functions as F

from crewcast.operators.quality import assert_unique, calendar_diagnostics
from crewcast.plans.calendar import consultant_calendar, status_colour
from crewcast.plans.consultant_tracker import consultant_tracker
from crewcast.plans.utilisation import utilisation, utilisation_detailed
from tests.workforce import AS_OF, assignment, hours, leave, master


def cells(calendar, person):
    picked = calendar.filter(F.col("Resource_Id") == person).collect()
    return {r["WeekStart"].isoformat(): r for r in picked}


@pytest.fixture(scope="module")
def calendar(spark):
    data = master(
        spark,
        [
            assignment("1", "a1", "2026-01-01", None),
            assignment("2", "a2", "2025-01-01", "2026-12-31"),
            assignment("3", "a3", "2027-01-01", None),
            assignment("4", "a4", "2026-03-02", "2026-03-05", project=" "),
            assignment("5", "a5", "2026-08-04", "2026-08-12"),
            assignment("5", "a6", "2026-09-07", "2026-09-13", project_id=None, Job_Title=None),
        ],
        [
            hours("a1", "2026-03-02", 37),
            hours("a1", "2026-03-09", 0.2),
            hours("a1", "2026-03-16", 39.9),
            hours("a1", "2026-03-23", 40),
            hours("a1", "2026-03-30", 20),
            hours("a1", "2026-03-30", 25),
            hours("a1", "2025-03-24", 40),
            hours("a9", "2026-03-23", 40),
        ],
        [leave("1", "2026-03-23", 8), leave("1", "2026-04-06", 0), leave("9", "2026-03-23", 8)],
    )
    return consultant_calendar(data, AS_OF).cache()


def test_population_and_weeks(calendar):
    people = calendar.groupBy("Resource_Id").count().collect()
    assert {r[0]: r[1] for r in people} == {"1": 52, "2": 52, "5": 52}
    bounds = calendar.agg(F.min("WeekStart"), F.max("WeekStart")).first()
    assert tuple(bounds) == (date(2026, 1, 5), date(2026, 12, 28))


@pytest.mark.parametrize(
    "week, status, value, capacity",
    [
        ("2026-03-02", "PARTLY_BOOKED", "0.92", 0.92),  # 37 h: half-even on the double
        ("2026-03-09", "BENCH", "B", 0.0),  # 0.2 h rounds to nothing
        ("2026-03-16", "BOOKED", "1.00", 1.0),  # 39.9 h rounds to full
        ("2026-03-23", "ON_LEAVE", "L", 0.0),  # leave wins over a full week
        ("2026-03-30", "BOOKED", "1.00", 1.0),  # two entries, capped at one
        ("2026-04-06", "BENCH", "B", 0.0),  # leave of zero hours is no leave
        ("2026-07-20", "BENCH", "B", 0.0),  # current week without hours
        ("2026-07-27", "UNCONFIRMED", "1.00", 1.0),  # next week, open-ended assignment
    ],
)
def test_status(calendar, week, status, value, capacity):
    row = cells(calendar, "1")[week]
    assert (row["CalendarStatus"], row["CalendarValue"], row["CalendarCapacity"]) == (status, value, capacity)


def test_future_weeks_are_only_touched_weeks(calendar):
    future = [w for w, r in cells(calendar, "5").items() if r["Has_Future_Assignment"]]
    assert sorted(future) == ["2026-08-03", "2026-08-10", "2026-09-07"]


def test_person_details(calendar):
    one, two, five = (cells(calendar, p)["2026-01-05"] for p in "125")
    assert one["Expected_Availability_Date"] is None and one["Active_Projects"] == 1
    assert two["Expected_Availability_Date"] == date(2026, 12, 31)
    # The later assignment has no title, so the earlier title is the last known one.
    assert five["Job_Title"] == "Engineer" and five["Active_Projects"] == 0


def test_colours(spark):
    df = spark.createDataFrame([("BENCH",), ("BOOKED",), ("other",)], "s string")
    assert [r[0] for r in df.select(status_colour(F.col("s"))).collect()] == ["PURPLE", "RED", ""]


def test_diagnostics_find_duplicates_and_bad_capacity(spark, calendar):
    broken = calendar.unionByName(calendar.filter("Resource_Id = '1'").limit(1).withColumn("CalendarCapacity", F.lit(2.0)))
    found = {(r["check"], r["detail"]): r["row_count"] for r in calendar_diagnostics(broken).collect()}
    assert found[("duplicate person-week", "")] == 2
    assert found[("capacity outside 0-1", "")] == 1


def test_same_group_and_name(spark):
    people = [
        assignment("1", "a1", "2026-01-01", "2026-05-01", name="Ann"),
        assignment("2", "a2", "2026-01-01", "2026-03-01", name="Ann"),
    ]
    data = master(spark, people, [hours("a1", "2026-02-02", 20)])
    calendar = consultant_calendar(data, AS_OF)
    tracker = consultant_tracker(calendar, AS_OF).collect()
    assert len(tracker) == 1
    assert tracker[0]["Expected_Availability_Date"] == "2026-03-01"
    assert tracker[0]["2026-02-02"] == "0.50" and tracker[0]["2026-02-02__STATUS"] == "PARTLY_BOOKED"
    table = {r["Utilisation"]: r for r in utilisation(calendar, AS_OF).collect()}
    assert table["Bench"]["2026-02-02"] == "1" and table["Partly Booked"]["2026-02-02"] == "1"
    assert table["Forecasted Allocation"]["2026-02-02"] == "0.250000"
    with pytest.raises(Exception, match="Ann / Senior / Data / Paris"):
        utilisation_detailed(calendar, AS_OF).collect()


def test_detail_keeps_a_missing_location(spark):
    data = master(spark, [assignment("1", "a1", "2026-01-01", None, Location=None)])
    detail = utilisation_detailed(consultant_calendar(data, AS_OF), AS_OF).collect()
    assert len(detail) == 1 and detail[0]["Location"] is None


def test_everyone_on_leave(spark):
    data = master(spark, [assignment("1", "a1", "2026-01-01", None)], leaves=[leave("1", "2026-02-02", 40)])
    table = {r["Utilisation"]: r for r in utilisation(consultant_calendar(data, AS_OF), AS_OF).collect()}
    assert table["Maximum Capacity"]["2026-02-02"] == "0.00"
    assert table["Forecasted Allocation"]["2026-02-02"] is None
    assert list(table) == [
        "Booked", "Unconfirmed", "Partly Booked", "On Leave", "Bench", "Booked Capacity",
        "Maximum Capacity", "Forecasted Allocation",
    ]


def test_empty_inputs(spark):
    calendar = consultant_calendar(master(spark), AS_OF)
    assert calendar.count() == 0
    for report in (consultant_tracker, utilisation, utilisation_detailed):
        built = report(calendar, AS_OF)
        assert built.count() == 0 and "2026-01-05" in built.columns


def test_assert_unique(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    assert assert_unique(df, ["k", "v"], "t") is df
    with pytest.raises(ValueError, match="t has repeated keys"):
        assert_unique(df, ["k"], "t")


def test_hot_person(spark):
    """One person owns most assignments and entries; results stay whole."""
    people = [assignment("1", f"a{n}", "2026-01-01", None, project_id=f"P{n}") for n in range(3000)]
    people.append(assignment("2", "b", "2026-01-01", None))
    time = [hours(f"a{n}", "2026-02-02", 0.5) for n in range(3000)]
    row = cells(consultant_calendar(master(spark, people, time), AS_OF), "1")["2026-02-02"]
    assert row["Logged_Hours"] == 1500.0 and row["Active_Projects"] == 3000


def test_assignment_with_two_people_is_refused(spark):
    people = [assignment("1", "same", "2026-01-01", None), assignment("2", "same", "2026-01-01", None)]
    with pytest.raises(Exception, match="assignment with more than one person: same"):
        consultant_calendar(master(spark, people, [hours("same", "2026-02-02", 8)]), AS_OF).collect()


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_weeks_are_multiplied_after_the_joins(calendar):
    lines = plan_of(calendar).splitlines()
    generate = next(n for n, line in enumerate(lines) if "Generate explode" in line)
    joins = [n for n, line in enumerate(lines) if "Join" in line]
    assert joins and min(joins) > generate  # parents come first


def test_diagnostics_of_weeks_with_several_statuses(spark):
    rows = [("1", date(2026, 1, 5), s, c) for s, c in (("BENCH", 0.0), ("BOOKED", 1.5), ("BENCH", None))]
    rows += [("1", date(2026, 1, 12), "odd", -1.0), (None, date(2026, 1, 5), "BENCH", 1.0)]
    table = spark.createDataFrame(rows, "Resource_Id string, WeekStart date, CalendarStatus string, CalendarCapacity double")
    found = calendar_diagnostics(table)
    assert {(r["check"], r["detail"]): r["row_count"] for r in found.collect()} == {
        ("status", "BENCH"): 3, ("status", "BOOKED"): 1, ("status", "odd"): 1,
        ("duplicate person-week", ""): 3, ("capacity outside 0-1", ""): 2,
    }
    assert "collect_list" not in plan_of(found) and "REPARTITION_BY_NUM" in plan_of(found)
    assert calendar_diagnostics(table.limit(0)).count() == 0
