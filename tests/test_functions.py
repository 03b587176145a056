import math
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from crewcast.functions import dates as dt
from crewcast.functions import numbers as num
from crewcast.functions import text as tx


def values(spark, data, kind, expression):
    return [r[0] for r in spark.createDataFrame([(v,) for v in data], f"x {kind}").select(expression(F.col("x"))).collect()]


def test_capacity_rounds_like_arrays(spark):
    grid = [n / 10 for n in range(0, 500)] + [n / 4 for n in range(0, 200)]
    ours = values(spark, grid, "double", num.share_of_week)
    assert ours == [float(v) for v in np.round(np.clip(np.array(grid) / 40.0, 0, 1), 2)]


def test_extract_capacity_rounds_away_from_zero(spark):
    assert [str(v) for v in values(spark, [37.0, 40.0, 50.0, 0.0, -1.0], "double", num.extract_capacity)] == [
        "0.93", "1.00", "1.00", "0.00", "0.00",
    ]


def test_fixed_text(spark):
    assert values(spark, [1 / 128, None, 0.5, 12.0], "double", lambda c: num.fixed_text(c, 6)) == [
        "0.007812", None, "0.500000", "12.000000",
    ]


def test_week_rules_differ_on_sunday(spark):
    days = [date(2026, 7, 18), date(2026, 7, 19), date(2026, 7, 20)]
    assert values(spark, days, "date", dt.monday) == [date(2026, 7, 13), date(2026, 7, 13), date(2026, 7, 20)]
    assert values(spark, days, "date", dt.extract_week_start) == [date(2026, 7, 13), date(2026, 7, 20), date(2026, 7, 20)]


def test_driver_dates():
    year = dt.ReportingYear.of("2024-02-29")
    assert (year.first_week, year.last_week, len(year.weeks)) == (date(2024, 1, 1), date(2024, 12, 30), 53)
    assert dt.year_before(date(2024, 2, 29)) == date(2023, 2, 28)
    assert dt.next_month_bounds(date(2026, 11, 5)) == (date(2026, 12, 1), date(2027, 1, 1))
    assert dt.next_month_bounds(date(2026, 12, 5)) == (date(2027, 1, 1), date(2027, 2, 1))
    weeks = [date(2026, 7, 13), date(2026, 7, 21)]
    assert dt.closest_week(weeks, date(2026, 7, 17)) == date(2026, 7, 13)


def test_parse_date(spark):
    texts = ["2026-07-01", "03/04/2026", "02/13/2026", "13-02-2026", "02-13-2026", "2026-02-30", "soon", None, "26-01-01"]
    assert values(spark, texts, "string", dt.parse_date) == [
        date(2026, 7, 1), date(2026, 4, 3), date(2026, 2, 13), date(2026, 2, 13), date(2026, 2, 13),
        None, None, None, None,
    ]


def test_dates_in_text(spark):
    text = "From 13/02/2026 or 31-12-2026 until 2026-07-01, not 99/99/2026"
    assert values(spark, [text], "string", dt.dates_in_text) == [["2026-07-01", "2026-02-13", "2026-12-31"]]


def test_strip_and_clean(spark):
    odd = ["  a\tb  ", "nan", " NaT ", None, "a \n b", "", "plain", "é  é", "None", "\x1cx\x1f"]
    assert values(spark, odd, "string", tx.strip) == [v.strip() if v is not None else None for v in odd]
    assert values(spark, odd, "string", tx.clean_text) == ["a b", "", "", "", "a b", "", "plain", "é é", "", "x"]
    assert values(spark, odd[:1] + odd[4:], "string", tx.collapse_spaces) == [
        " ".join(v.split()) for v in odd[:1] + odd[4:]
    ]


def test_name_key(spark):
    names = ["José  Núñez-O'Neil", "Straße", "ﬁne ½", "Ǆ K", "İpek", "日本", None, "Zoë́"]
    import re
    import unicodedata

    def expected(name):
        if name is None:
            return ""
        text = "".join(c for c in unicodedata.normalize("NFKD", name) if not unicodedata.combining(c))
        return re.sub("[^a-z0-9]+", "", text.lower().strip())

    assert values(spark, names, "string", tx.name_key) == [expected(n) for n in names]


def test_casefold(spark):
    assert values(spark, ["Straße", "ΟΔΟΣ", None], "string", tx.casefold) == ["strasse", "οδοσ", None]
    # Every character that case folding or lower case changes, and its neighbours in the table.
    chars = [chr(c) for c in range(0x20, 0x1F000) if not 0xD800 <= c < 0xE000 and (chr(c).casefold() != chr(c) or chr(c).lower() != chr(c))]
    texts = ["".join(chars[n : n + 50]) for n in range(0, len(chars), 50)]
    assert values(spark, texts, "string", tx.casefold) == [t.casefold() for t in texts]


def test_titles(spark):
    long = "word " * 40
    titles = values(spark, [long, " short \n one ", "x" * 60, "x" * 61], "string", tx.conversation_title)
    assert titles[0] == ("word " * 12).strip()[:59].rstrip() + "…" and len(titles[0]) <= 60
    assert titles[1:] == ["short one", "x" * 60, "x" * 59 + "…"]
    assert values(spark, ["  ", None, "y" * 121], "string", tx.clean_title) == [
        "New conversation", "New conversation", "y" * 119 + "…",
    ]


def test_skill_terms(spark):
    assert values(spark, ["Who knows Azure, AWS or dbt?", "who has it"], "string", tx.skill_terms) == [["azure", "aws", "dbt"], []]


def test_small_conversions(spark):
    assert values(spark, ["a, ,b ", None], "string", tx.skill_list) == [["a", "b"], []]
    assert values(spark, [" Yes", "0", "ACTIVE"], "string", tx.truthy) == [True, False, True]
    assert values(spark, ["2", "0.0", "no", None], "string", tx.truthy) == [True, False, False, None]
    assert values(spark, ["7", " ", None], "string", tx.optional_int) == [7, None, None]
    with pytest.raises(Exception, match="not an integer: x"):
        values(spark, ["x"], "string", tx.optional_int)


@pytest.mark.parametrize("updated, label", [("2026-07-20", "Today"), ("2026-07-19", "Yesterday"), ("2026-07-13", "Previous 7 days"), ("2026-07-25", "Previous 7 days"), ("2026-07-12", "Older")])
def test_recency(spark, updated, label):
    assert values(spark, [date.fromisoformat(updated)], "date", lambda c: dt.recency_label(c, date(2026, 7, 20))) == [label]


def test_round_binary_matches_numpy(spark):
    grid = [n / 1000 for n in range(-500, 500)] + [math.pi * n for n in range(100)]
    assert values(spark, grid, "double", lambda c: num.round_binary(c, 2)) == [float(v) for v in np.round(grid, 2)]
