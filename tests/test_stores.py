"""Stored tables of which only changed buckets are rewritten."""

import re

import pytest
from pyspark.sql import functions as F

from crewcast.plans.calendar import consultant_calendar
from crewcast.plans.delta_refresh import refresh_calendar, stored_calendar
from crewcast.plans.profile_index import live_rows, reindex
from crewcast.sources.bucketed_store import BucketedStore
from tests.workforce import assignment, hours, leave, master

AS_OF = "2026-07-20"


def files(path):
    """bucket -> names of its files; a rewritten bucket has others."""
    found = {}
    for file in path.rglob("*.parquet"):
        bucket = re.search(r"_bucket=(\d+)", str(file))
        found.setdefault(int(bucket[1]), set()).add(file.name)
    return found


def rewritten(before, after):
    return {b for b in before.keys() | after.keys() if before.get(b) != after.get(b)}


def data_of(spark, people, hour=40, extra=(), leaves=()):
    rows = [assignment(str(p), f"a{p}", "2026-01-01", "2026-12-31") for p in people]
    time = [hours(f"a{p}", "2026-07-20", hour if p == 3 else 40) for p in people]
    time += [hours(f"a{p}", "2020-01-06", hour) for p in people]
    return master(spark, rows + list(extra), time, leaves)


def test_refresh_recomputes_only_changed_people(spark, tmp_path):
    folder, store = str(tmp_path), tmp_path / f"calendar-{AS_OF}"
    everyone = list(range(1, 41))

    def run(data):
        before = files(store) if store.exists() else {}
        touched = refresh_calendar(spark, data, folder, AS_OF, buckets=32)
        assert set(touched) == rewritten(before, files(store))
        stored, full = stored_calendar(spark, folder, AS_OF), consultant_calendar(data, AS_OF)
        assert stored.exceptAll(full.select(stored.columns)).isEmpty() and full.select(stored.columns).exceptAll(stored).isEmpty()
        return touched

    assert len(run(data_of(spark, everyone))) == 32
    assert run(data_of(spark, everyone)) == []
    # Hours of one person; hours of another year do not count.
    assert len(run(data_of(spark, everyone, hour=8))) == 1
    assert len(run(data_of(spark, everyone, hour=8, leaves=[leave("7", "2026-07-20", 8)]))) == 1
    gone = [p for p in everyone if p != 9]
    assert len(run(data_of(spark, gone, hour=8))) in (1, 2)  # person 9 and the leave of person 7
    assert len(run(data_of(spark, gone, hour=8, extra=[assignment("11", "b11", "2026-02-01", None, project="Other")]))) == 1
    # A person's last row goes, and nobody is left.
    assert run(data_of(spark, []))
    assert stored_calendar(spark, folder, AS_OF).count() == 0


def index_of(spark, rows):
    return spark.createDataFrame([(i, c, n, s) for i, c, n, s in rows], "id string, content string, title string, last_modified string")


def test_index_follows_documents(spark, tmp_path):
    path = str(tmp_path / "index")

    def run(rows, stamp):
        return reindex(index_of(spark, rows), path, F.lit(stamp).cast("timestamp"), buckets=8)

    def stored():
        return {r.id: (r.content, r.removed, r.changed_at.day) for r in BucketedStore(spark, path, "id").read().collect()}

    first = [("a", "x", None, "1"), ("b", "y", "t", "1"), ("c", "z", "t", "1")]
    assert run(first, "2024-01-01") == {"added": 3, "changed": 0, "removed": 0, "left": 0}
    before = files(tmp_path / "index")
    # last_modified alone changes nothing; null and empty titles differ.
    assert run([(i, c, n, "2") for i, c, n, _ in first], "2024-01-02") == {"added": 0, "changed": 0, "removed": 0, "left": 3}
    assert rewritten(before, files(tmp_path / "index")) == set()
    assert run([("a", "x", "", "1"), ("c", "z", "t", "1"), ("d", "new", "t", "1")], "2024-01-03") == {"added": 1, "changed": 1, "removed": 1, "left": 1}
    assert len(rewritten(before, files(tmp_path / "index"))) <= 3
    assert stored() == {"a": ("x", False, 3), "b": (None, True, 3), "c": ("z", False, 1), "d": ("new", False, 3)}
    # A tombstone is removed once and may come back.
    assert run([("b", "y", "t", "1")], "2024-01-04") == {"added": 1, "changed": 0, "removed": 3, "left": 0}
    assert run([], "2024-01-05") == {"added": 0, "changed": 0, "removed": 1, "left": 0}
    assert {removed for _, removed, _ in stored().values()} == {True}
    assert live_rows(BucketedStore(spark, path, "id").read()).count() == 0


def test_index_refuses_bad_rows(spark, tmp_path):
    for bad in ([("a", " ", "t", "1")], [(None, "x", "t", "1")], [("a", "x", "t", "1"), ("a", "y", "t", "1")]):
        with pytest.raises(Exception):
            reindex(index_of(spark, bad), str(tmp_path / "none"), F.lit("2024-01-01").cast("timestamp"))
    assert not (tmp_path / "none").exists()


def test_store_refuses_rows_without_key(spark, tmp_path):
    store = BucketedStore(spark, str(tmp_path / "s"), "k", 4)
    with pytest.raises(Exception, match="without key"):
        store.create(spark.createDataFrame([(None, 1)], "k string, v int"))
    assert not store.exists()
