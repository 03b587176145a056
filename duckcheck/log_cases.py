"""Chat and audit logs, and the streaming forms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.operators.numbering import number_rows
from crewcast.operators.quality import message_violations
from crewcast.plans import logs
from crewcast.sources.audit_log import parse_audit_lines, recent_events
from crewcast.sources.shared_storage import fresh_path
from crewcast.sources.star_schema import StarSchema
from crewcast.streaming import feeds
from duckcheck.case import Case, case


def _events(s: StarSchema) -> DataFrame:
    return parse_audit_lines(s.audit_lines())


def _conversations(s: StarSchema) -> DataFrame:
    return logs.conversation_summary(s.messages())


def _stored(s: StarSchema) -> DataFrame:
    messages = s.messages().select(
        "conversation_id",
        "turn",
        F.when(F.col("turn") % 2 == 1, F.array("role", "user_id")).alias("sources"),
        F.create_map(F.lit("role"), "role").alias("metadata"),
    )
    stored = logs.stored_message(messages)
    restored = logs.restored_message(stored)
    return stored.join(restored, ["conversation_id", "turn"]).select(
        "conversation_id",
        "turn",
        "sources_json",
        "metadata_json",
        "sources",
        F.element_at("metadata", "role").alias("role"),
    )


def _flawed_messages(s: StarSchema) -> DataFrame:
    messages = s.messages().withColumns(
        {
            "role": F.when(F.col("conversation_id") % 7 == 0, "robot").otherwise(F.col("role")),
            "content": F.when(F.col("turn") == 2, " \t").otherwise(F.col("content")),
        }
    )
    return messages.unionByName(messages.filter(F.col("conversation_id") % 5 == 0))


def _stream(s: StarSchema, name: str) -> DataFrame:
    return (
        s.spark.readStream.schema(s.table(name).schema)
        .option("pathGlobFilter", f"{name}.parquet")
        .parquet(s.folder)
    )


def _streamed(s: StarSchema, result: DataFrame, name: str) -> DataFrame:
    return feeds.run_available(
        result, fresh_path(s.spark, name), fresh_path(s.spark, f"{name}-state")
    )


def _stream_counts(s: StarSchema) -> DataFrame:
    events = _stream(s, "events").select(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("event_type").alias("route")
    )
    return _streamed(s, feeds.request_counts(events), "request-counts")


def _stream_hours(s: StarSchema) -> DataFrame:
    entries = _stream(s, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ActivityAssignment_Id"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
        (F.col("l_quantity") / 2).alias("hours"),
    )
    return _streamed(s, feeds.weekly_hours(entries), "weekly-hours")


def _split_messages(s: StarSchema) -> DataFrame:
    """A conversation with a third of all messages, null conversations and turns, ties; split from 20 rows on."""
    conversation = F.col("conversation_id")
    messages = s.messages().select(
        F.when(conversation % 3 == 0, F.lit(0).cast("bigint")).when(conversation % 11 == 1, None).otherwise(conversation).alias("conversation_id"),
        F.when(F.col("turn") % 4 != 3, F.col("turn")).alias("turn"),
        "content",
        conversation.alias("started"),
    )
    return number_rows(messages, ["conversation_id"], "turn", "sequence_number", ties=["content", "started"], rows_per_range=20)


CASES: dict[str, Case] = {
    "numbered_messages": case(
        lambda s: logs.number_messages(s.messages()),
        "SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn) AS sequence_number FROM messages",
    ),
    "numbered_messages_split": case(
        _split_messages,
        """
        SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY turn NULLS FIRST, content, started) AS sequence_number
        FROM (
          SELECT CASE WHEN conversation_id % 3 = 0 THEN 0 WHEN conversation_id % 11 = 1 THEN NULL ELSE conversation_id END AS conversation_id,
                 CASE WHEN turn % 4 = 3 THEN NULL ELSE turn END AS turn, content, conversation_id AS started
          FROM messages)""",
    ),
    "conversation_summary": case(_conversations, "SELECT * FROM conversation_rows"),
    "conversation_list": case(
        lambda s: logs.list_conversations(_conversations(s), "owner3", limit=5),
        """
        SELECT * FROM conversation_rows WHERE user_id = 'owner3' AND NOT is_archived
        ORDER BY updated_at DESC, conversation_id LIMIT 5""",
    ),
    "recent_conversations": case(
        lambda s: logs.recent_conversations(_conversations(s), "2024-01-05"),
        """
        SELECT user_id, CAST(position AS INT) AS position, conversation_id, title, updated_at,
               CASE WHEN age = 0 THEN 'Today' WHEN age = 1 THEN 'Yesterday' WHEN age <= 7 THEN 'Previous 7 days' ELSE 'Older' END AS label
        FROM (SELECT *, DATE '2024-01-05' - CAST(updated_at AS DATE) AS age,
                     row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, conversation_id) AS position
              FROM conversation_rows WHERE NOT is_archived)
        WHERE position <= 50""",
    ),
    "message_list": case(
        lambda s: logs.list_messages(s.messages(), 3, "owner3"),
        """
        SELECT *, row_number() OVER (ORDER BY turn) AS sequence_number FROM messages
        WHERE conversation_id = 3 AND user_id = 'owner3'""",
    ),
    "message_violations": case(
        lambda s: message_violations(_flawed_messages(s)),
        """
        flawed AS (
            SELECT conversation_id, turn, CASE WHEN conversation_id % 7 = 0 THEN 'robot' ELSE role END AS role,
                   CASE WHEN turn = 2 THEN '' ELSE content END AS content FROM messages),
        twice AS (SELECT * FROM flawed UNION ALL SELECT * FROM flawed WHERE conversation_id % 5 = 0)
        SELECT conversation_id, turn, 'unknown role' AS problem FROM twice WHERE role NOT IN ('user', 'assistant', 'system')
        UNION ALL SELECT conversation_id, turn, 'blank content' FROM twice WHERE trim(content) = ''
        UNION ALL SELECT conversation_id, turn, 'repeated number' FROM twice GROUP BY conversation_id, turn HAVING count(*) > 1""",
    ),
    "stored_messages": case(
        _stored,
        """
        SELECT conversation_id, turn,
               CASE WHEN turn % 2 = 1 THEN '["' || role || '","' || user_id || '"]' ELSE '[]' END AS sources_json,
               '{"role":"' || role || '"}' AS metadata_json,
               CASE WHEN turn % 2 = 1 THEN [role, user_id] ELSE [] END AS sources, role
        FROM messages""",
    ),
    "audit_events": case(
        lambda s: _events(s).select(
            "_line", "timestamp", "event_type", "request_id", "user_id", "question", "route",
            "response_time_ms", "success", "exception",
        ),
        'SELECT *, CAST(NULL AS VARCHAR) AS "exception" FROM audit',
    ),
    "recent_audit_events": case(
        lambda s: recent_events(_events(s), 500, "_line").select("_line", "timestamp", "request_id"),
        'SELECT _line, "timestamp", request_id FROM audit ORDER BY _line DESC LIMIT 500',
    ),
    "audit_summary": case(
        lambda s: logs.audit_summary(_events(s)),
        """
        SELECT count(*) AS total_requests, count_if(success)::BIGINT AS successful_requests,
               count_if(NOT success)::BIGINT AS failed_requests,
               printf('%.0f', CAST(sum(CASE WHEN success THEN CAST(response_time_ms AS DECIMAL(18,3)) END) AS DOUBLE)
                              / count(CASE WHEN success THEN response_time_ms END)) || ' ms' AS average_response_time
        FROM audit""",
    ),
    "requests_by_route": case(
        lambda s: logs.requests_by_route(_events(s)),
        "SELECT route, count(*) AS request_count FROM audit WHERE success GROUP BY route",
    ),
    "request_table": case(
        lambda s: logs.request_table(_events(s)),
        """
        SELECT request_id, coalesce(user_id, 'Unknown user') AS "User",
               coalesce(question, 'Question was not recorded') AS "Question", coalesce(route, 'unknown') AS "Route",
               coalesce(printf('%.0f', round_even(response_time_ms, 0)), '-') || ' ms' AS "Response Time",
               CASE WHEN success THEN '✅' ELSE '❌' END AS "Success"
        FROM audit""",
    ),
    "streamed_request_counts": case(
        _stream_counts,
        """
        SELECT date_trunc('day', ts) AS window_start, date_trunc('day', ts) + INTERVAL 1 DAY AS window_end,
               event_type AS route, count(*) AS request_count
        FROM events
        WHERE date_trunc('day', ts) + INTERVAL 1 DAY <= (SELECT max(ts) - INTERVAL 1 HOUR FROM events)
        GROUP BY ALL""",
    ),
    "streamed_weekly_hours": case(
        _stream_hours,
        """
        SELECT CAST(l_orderkey AS VARCHAR) AS ActivityAssignment_Id,
               CAST(date_trunc('week', l_shipdate) AS DATE) AS WeekStart, sum(l_quantity / 2) AS Logged_Hours,
               sum(l_quantity / 2) / 8 AS Consumed_Days
        FROM lineitem
        WHERE CAST(date_trunc('week', l_shipdate) AS DATE) + 7 <= (SELECT max(l_shipdate) - INTERVAL 14 DAY FROM lineitem)
        GROUP BY ALL""",
    ),
}
