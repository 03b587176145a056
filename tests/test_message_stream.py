"""Numbers over batches against a plain loop; batches that are repeated; closing runs."""

from datetime import datetime, timedelta

import pytest

from crewcast.streaming import feeds
from crewcast.streaming.message_numbers import LATE, NUMBERED, REPEATED, NumberedMessages

SCHEMA = "conversation_id bigint, turn int, created_at timestamp, content string"
START = datetime(2026, 7, 20)
DAY = timedelta(days=1)


def at(hours):
    return START + timedelta(hours=hours)


# Numbers, repeats inside and across batches, nulls, late rows, a conversation with most rows.
BATCHES = [
    [(1, 1, at(0), "a"), (1, 2, at(1), "b"), (1, 2, at(2), "copy"), (None, 1, at(0), "c"), (2, None, at(0), "d"), (3, 1, None, "e")],
    [(1, 3, at(3), "f"), (1, 2, at(4), "again"), (2, None, at(5), "again"), (None, 1, at(5), "again"), (None, 2, at(5), "g")],
    [(1, 4, at(60), "h")] + [(9, n, at(60), f"hot {n}") for n in range(50, 0, -1)],
    [(1, 5, at(0), "late"), (1, 6, at(61), "i"), (9, 51, at(61), "j"), (9, 51, at(61), "j"), (3, 2, None, "untimed")],
    [],
    [(9, 52, at(62), "k"), (2, 1, at(62), "l"), (1, 2, at(62), "beyond the lateness")],
]


def expected(batches, lateness=DAY):
    numbered, late, repeated, counts = {}, [], {}, {}
    seen, limit = [], None
    for rows in batches:
        recent = {k for latest, keys in seen if latest is None or limit is None or latest >= limit for k in keys}
        keys = set()
        for row in sorted(rows, key=lambda r: ((r[1] is not None, r[1] or 0), r[2] is None, r[2] or START, r[3])):
            if row[2] is not None and limit is not None and row[2] < limit:
                late.append(row[:2])
            elif row[:2] in recent or row[:2] in keys:
                repeated[row[:2]] = repeated.get(row[:2], 0) + 1
            else:
                keys.add(row[:2])
                counts[row[0]] = counts.get(row[0], 0) + 1
                numbered[row] = counts[row[0]]
        latest = max((r[2] for r in rows if r[2]), default=None)
        seen.append((latest, keys))
        known = [t for t, _ in seen if t]
        limit = max(known) - lateness if known else None
    return numbered, sorted(late), repeated


def outcome(store):
    numbered = {tuple(r)[:4]: r["sequence_number"] for r in store.read(NUMBERED).collect()}
    late = sorted((r["conversation_id"], r["turn"]) for r in store.read(LATE).collect())
    repeated = {}
    for r in store.read(REPEATED).collect():
        key = (r["conversation_id"], r["turn"])
        repeated[key] = repeated.get(key, 0) + r["copies"]
    return numbered, late, repeated


@pytest.mark.parametrize("fold", [2, 64])
def test_every_row_is_numbered_late_or_repeated(spark, tmp_path, fold):
    store = NumberedMessages(spark, str(tmp_path), fold=fold)
    for n, rows in enumerate(BATCHES):
        store._take(spark.createDataFrame(rows, SCHEMA), n)
    numbered, late, repeated = outcome(store)
    assert (numbered, late, repeated) == expected(BATCHES)
    assert len(numbered) + len(late) + sum(repeated.values()) == sum(map(len, BATCHES))


def test_a_batch_that_broke_off_is_not_read_and_is_taken_again(spark, tmp_path, monkeypatch):
    store = NumberedMessages(spark, str(tmp_path))
    frames = [spark.createDataFrame(rows, SCHEMA) for rows in BATCHES[:2]]
    store._take(frames[0], 0)
    whole = store._write

    def breaks(df, table, batch):
        if table == "counts":
            raise OSError("lost")
        whole(df, table, batch)

    monkeypatch.setattr(store, "_write", breaks)
    with pytest.raises(OSError):
        store._take(frames[1], 1)
    monkeypatch.undo()
    assert outcome(store) == expected(BATCHES[:1])
    store._take(frames[1], 1)
    store._take(frames[1], 1)
    assert outcome(store) == expected(BATCHES[:2])


def test_closing_run_writes_the_last_windows_and_no_window_of_the_mark(spark, tmp_path):
    source, target, state, marks = (str(tmp_path / n) for n in ("in", "out", "state", "marks"))
    schema = "timestamp timestamp, route string"
    spark.createDataFrame([(at(1), "bench"), (at(30), "bench"), (at(30), None)], schema).write.parquet(source)
    stream = spark.readStream.schema(schema).parquet(source)
    counts = feeds.request_counts(feeds.with_closing_marks(stream, marks))

    def run():
        rows = feeds.run_available(counts, target, state).collect()
        return sorted((str(r.window_start)[:10], r.route or "", r.request_count) for r in rows)

    assert run() == [("2026-07-20", "bench", 1)]
    feeds.close_stream(spark, stream.schema, marks, "timestamp")
    assert run() == [("2026-07-20", "bench", 1), ("2026-07-21", "", 1), ("2026-07-21", "bench", 1)]
    assert len(run()) == 3
