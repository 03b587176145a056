"""Streams in several runs: numbers that continue, repeated and late messages, windows closed at the end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.sources.shared_storage import fresh_path
from crewcast.sources.star_schema import StarSchema
from crewcast.streaming import feeds
from crewcast.streaming.message_numbers import LATE, NUMBERED, REPEATED, NumberedMessages
from duckcheck.case import Case, case
from duckcheck.log_cases import _stream


def _numbered(s: StarSchema) -> DataFrame:
    """First all turns up to 2; then the others, a fifth of the first ones again, and messages of an earlier age."""
    messages, conversation, turn = s.messages(), F.col("conversation_id"), F.col("turn")
    first = messages.filter(turn <= 2)
    old = messages.filter(conversation % 7 == 0).withColumns(
        {"turn": turn + 1000, "created_at": F.col("created_at") - F.expr("INTERVAL 40000 days")}
    )
    second = messages.filter(turn > 2).unionByName(first.filter(conversation % 5 == 0)).unionByName(old)
    source = fresh_path(s.spark, "arriving")
    store = NumberedMessages(s.spark, fresh_path(s.spark, "numbers"), lateness="20000 days")
    for part in (first, second):
        part.write.mode("append").parquet(source)
        store.run_available(s.spark.readStream.schema(messages.schema).parquet(source))
    none = F.lit(None).cast("bigint")
    columns = ("conversation_id", "turn")
    outcomes = (
        store.read(NUMBERED).select(F.lit(NUMBERED).alias("outcome"), *columns, "sequence_number", F.lit(1).cast("bigint").alias("copies")),
        store.read(LATE).select(F.lit(LATE).alias("outcome"), *columns, none.alias("sequence_number"), F.lit(1).cast("bigint").alias("copies")),
        store.read(REPEATED).select(F.lit(REPEATED).alias("outcome"), *columns, none.alias("sequence_number"), "copies"),
    )
    return outcomes[0].unionByName(outcomes[1]).unionByName(outcomes[2])


def _closed_counts(s: StarSchema) -> DataFrame:
    """All that has arrived, then the closing run."""
    target, state, marks = (fresh_path(s.spark, f"closed-{n}") for n in ("counts", "state", "marks"))
    events = _stream(s, "events").select(F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("route"))
    counts = feeds.request_counts(feeds.with_closing_marks(events, marks))
    feeds.run_available(counts, target, state)
    feeds.close_stream(s.spark, events.schema, marks, "timestamp")
    return feeds.run_available(counts, target, state)


CASES: dict[str, Case] = {
    "streamed_message_numbers": case(
        _numbered,
        """
        SELECT 'numbered' AS outcome, conversation_id, turn,
               row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS sequence_number, 1::BIGINT AS copies
        FROM messages
        UNION ALL SELECT 'late', conversation_id, turn + 1000, NULL, 1 FROM messages WHERE conversation_id % 7 = 0
        UNION ALL SELECT 'repeated', conversation_id, turn, NULL, count(*) FROM messages
        WHERE turn <= 2 AND conversation_id % 5 = 0 GROUP BY ALL""",
    ),
    "closed_request_counts": case(
        _closed_counts,
        """
        SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
               event_type AS route, count(*) AS request_count
        FROM events GROUP BY ALL""",
    ),
}
