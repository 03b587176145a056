"""Containment, as-of and interval joins against plain loops."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from crewcast.operators import as_of
from crewcast.operators.as_of import BACKWARD, FORWARD, as_of_join, nearer
from crewcast.operators.assignments import assignment_weeks
from crewcast.operators.containment import containment_pairs
from crewcast.operators.intervals import overlapping_pairs, points_in_intervals
from tests.workforce import assignment, master

DAY = date(2026, 1, 5)


def plan_of(df):
    return df._jdf.queryExecution().toString()


def days(n):
    return None if n is None else DAY + timedelta(days=n)


# --- containment -------------------------------------------------------------------------------


@pytest.mark.parametrize("texts_per_task", [3, 50_000])
def test_containment_equals_brute_force(spark, texts_per_task):
    draw = random.Random(2)
    texts = ["".join(draw.choice("abcé ") for _ in range(draw.randrange(0, 25))) for _ in range(300)]
    texts += ["x", "", None, "the very common text", "the very common text", "a😀b", "Straße ß"]
    texts += [f"the common beginning {n}" for n in range(200)]
    words = ["".join(draw.choice("abcé ") for _ in range(draw.randrange(1, 6))) for _ in range(120)]
    words += ["", None, "the", "common", "😀", "😀b", "ß", "x", "zzz", "the", "the very common text that is longer"]
    w = spark.createDataFrame([(n, x) for n, x in enumerate(words)], "id long, word string")
    t = spark.createDataFrame([(x, "k") for x in texts], "text string, word string")
    found = containment_pairs(w, t, texts_per_task=texts_per_task).collect()
    expected = {(x, y) for x in words if x for y in texts if y is not None and x in y}
    assert len(found) == len(expected) and {tuple(r) for r in found} == expected


def test_containment_of_empty_columns(spark):
    none = spark.createDataFrame([], "word string, text string")
    some = spark.createDataFrame([("a", "abc")], "word string, text string")
    assert containment_pairs(none, some).count() == 0
    assert containment_pairs(some, none).count() == 0


def test_containment_compares_no_full_product(spark):
    df = spark.createDataFrame([("abcd", "xabcdx")], "word string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(containment_pairs(df, df))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "NestedLoop" not in plan and "Cartesian" not in plan


# --- as-of -------------------------------------------------------------------------------------


def brute_as_of(asked, known, back):
    rows = []
    for key, at, tag in asked:
        able = [k for k in known if k[0] == key and k[1] is not None and at is not None and (k[1] <= at if back else k[1] >= at)]
        best = (max if back else min)((k[1] for k in able), default=None)
        rows.append((key, at, tag, max(k[1:] for k in able if k[1] == best) if able else None))
    return sorted(rows, key=repr)


@pytest.mark.parametrize("rows_per_range", [4, 100_000])
@pytest.mark.parametrize("direction", [BACKWARD, FORWARD])
def test_as_of_equals_brute_force(spark, direction, rows_per_range):
    draw = random.Random(3)
    keys = ["hot"] * 6 + ["a", "b", None]
    asked = [(draw.choice(keys), days(draw.randrange(-30, 400)), n) for n in range(250)] + [("hot", None, 900), ("nobody", DAY, 901)]
    known = [(draw.choice(keys), days(7 * draw.randrange(0, 40)), draw.randrange(5)) for _ in range(120)] + [("hot", None, 1)]
    a = spark.createDataFrame(asked, "key string, at date, tag long")
    k = spark.createDataFrame(known, "key string, week date, value long")
    found = as_of_join(a, k, ["key"], "at", "week", "found", direction, rows_per_range).collect()
    rows = sorted(((r.key, r.at, r.tag, tuple(r.found) if r.found else None) for r in found), key=repr)
    assert rows == brute_as_of(asked, known, direction == BACKWARD)
    assert as_of_join(a.limit(0), k, ["key"], "at", "week", "found", direction).count() == 0
    assert as_of_join(a, k.limit(0), ["key"], "at", "week", "found", direction).filter("found is not null").count() == 0


@pytest.mark.parametrize("direction", [BACKWARD, FORWARD])
def test_few_known_rows_are_met_as_one_list(spark, direction, monkeypatch):
    # Putting both sides in one order moves every known row for itself, several times.
    monkeypatch.setattr(as_of, "with_order_ranges", None)
    draw = random.Random(4)
    keys = ["crowded"] * 8 + ["a", None]
    asked = [(draw.choice(keys), days(draw.randrange(-30, 400)), n % 7) for n in range(300)] + [("crowded", None, 900), ("nobody", DAY, 901)]
    known = [(key, days(7 * n), draw.randrange(5)) for key in ("crowded", "a", None) for n in range(10) for _ in range(2)] + [("a", None, 1)]
    a = spark.createDataFrame(asked, "key string, at date, tag long")
    k = spark.createDataFrame(known, "key string, week date, value long").select("key", "value", "week")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = as_of_join(a, k, ["key"], "at", "week", "found", direction, 20).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    rows = sorted(((r.key, r.at, r.tag, (r.found.week, r.found.value) if r.found else None) for r in found), key=repr)
    assert rows == brute_as_of(asked, known, direction == BACKWARD)


def test_nearer_prefers_the_earlier(spark):
    df = spark.createDataFrame([(DAY, (days(-3),), (days(3),)), (DAY, (days(-4),), (days(3),)), (DAY, None, (days(9),)), (DAY, (days(-9),), None)], "at date, b struct<w:date>, a struct<w:date>")
    found = df.select(nearer(F.col("at"), F.col("b"), F.col("a"), "w").alias("n")).collect()
    assert [r.n.w for r in found] == [days(-3), days(3), days(9), days(-9)]


# --- intervals ---------------------------------------------------------------------------------


def intervals_of(draw, count, prefix):
    rows = [(draw.choice(["p", "q", "hot", "hot"]), f"{prefix}{n}", s := draw.randrange(-50, 900), s + draw.choice([0, 1, 6, 30, 364, 2000])) for n in range(count)]
    rows += [("hot", f"{prefix}open", 10, None), ("p", f"{prefix}never", 20, 10), ("q", f"{prefix}null", None, 5), (None, f"{prefix}nokey", 0, 5), ("hot", f"{prefix}old", -9000, -8000)]
    return rows


def overlap(a, b):
    if None in (a[0], b[0], a[2], b[2]) or a[0] != b[0]:
        return False
    ends = [10**9 if x[3] is None else x[3] for x in (a, b)]
    return ends[0] >= a[2] and ends[1] >= b[2] and a[2] <= ends[1] and b[2] <= ends[0]


@pytest.mark.parametrize("seed", [1, 2])
def test_overlaps_equal_brute_force(spark, seed):
    draw = random.Random(seed)
    left, right = intervals_of(draw, 70, "l"), intervals_of(draw, 70, "r")
    dated = [[(k, i, days(s), days(e)) for k, i, s, e in rows] for rows in (left, right)]
    l = spark.createDataFrame(dated[0], "key string, l string, l1 date, l2 date")
    r = spark.createDataFrame(dated[1], "key string, r string, r1 date, r2 date")
    found = overlapping_pairs(l, r, ["key"], ("l1", "l2"), ("r1", "r2"))
    assert sorted((x.l, x.r) for x in found.collect()) == sorted((a[1], b[1]) for a in left for b in right if overlap(a, b))
    assert "NestedLoop" not in plan_of(found) and "Cartesian" not in plan_of(found)
    assert overlapping_pairs(l.limit(0), r, ["key"], ("l1", "l2"), ("r1", "r2")).count() == 0
    assert overlapping_pairs(l, r.limit(0), ["key"], ("l1", "l2"), ("r1", "r2")).count() == 0


def test_points_without_keys(spark):
    points = spark.createDataFrame([(n, days(n)) for n in range(0, 300, 7)], "n long, day date")
    spans = spark.createDataFrame([("year", days(-100), days(265)), ("open", days(200), None), ("week", days(14), days(20))], "name string, a date, b date")
    found = points_in_intervals(points, spans, [], "day", "a", "b").collect()
    ends = {"year": (-100, 265), "open": (200, 10**6), "week": (14, 20)}
    assert sorted((r.name, r.n) for r in found) == sorted((k, n) for k, (a, b) in ends.items() for n in range(0, 300, 7) if a <= n <= b)


def test_open_ends_make_no_extra_rows(spark):
    """An open interval is posted under a few pieces, however far it reaches."""
    from crewcast.operators.intervals import _pieces

    one = spark.range(1).select(F.size(_pieces(F.lit(3).cast("bigint"), F.lit(100_000).cast("bigint"), 9)).alias("n"))
    assert one.first().n <= 6 * 9


# --- weeks over several years -------------------------------------------------------------------


def test_assignment_weeks_cross_years(spark):
    rows = [
        assignment("a", "1", "2024-12-30", "2025-01-06"), assignment("a", "2", "2025-01-01", "2027-01-03"),
        assignment("b", "3", "2026-03-04", None), assignment("c", "4", "2026-03-04", "2026-03-03"),
        assignment("d", "5", "2020-01-01", "2024-12-29"), assignment("e", "6", "2025-01-01", "2025-02-01", project=" "),
    ]
    data = master(spark, rows)
    found = {(r.Resource_Id, r.WeekStart) for r in assignment_weeks(data.assignments, "2025-01-01", "2027-06-30").collect()}
    first, last = date(2024, 12, 30), date(2027, 6, 28)
    weeks = [first + timedelta(days=7 * n) for n in range((last - first).days // 7 + 1)]
    expected = {("a", w) for w in weeks if w <= date(2027, 1, 3)} | {("b", w) for w in weeks if w >= date(2026, 3, 2)}
    assert found == expected
