"""Audit events: JSON lines of a request log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewcast.functions.text import strip, truthy

# Fields of an audit event and the events that are kept.
AUDIT_FIELDS = {
    "timestamp": "timestamp",
    "event_type": "string",
    "request_id": "string",
    "user_id": "string",
    "conversation_id": "string",
    "question": "string",
    "answer": "string",
    "route": "string",
    "report_name": "string",
    "router_confidence": "double",
    "response_time_ms": "double",
    "table_row_count": "bigint",
    "source_count": "bigint",
    "table_count": "bigint",
    "success": "boolean",
    "exception": "string",
}
COMPLETED, FAILED = "chat_request_completed", "chat_request_failed"

# Every field is read as text and converted afterwards, so one bad value nulls its field and
# not the whole event.
_LINE_SCHEMA = T.StructType(
    [T.StructField(name, T.StringType()) for name in AUDIT_FIELDS]
    + [T.StructField("_broken", T.StringType())]
)


def parse_audit_lines(lines: DataFrame, line: str = "value") -> DataFrame:
    """Request events among log lines; blank and malformed lines and other events are dropped."""
    parsed = F.from_json(
        F.col(line), _LINE_SCHEMA, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken"}
    )
    others = [f"`{c}`" for c in lines.columns if c != line]

    def field(name: str, kind: str):
        value = F.col(name)
        if kind == "boolean":
            return F.when(value.isNotNull(), truthy(value)).alias(name)
        return (value if kind == "string" else value.try_cast(kind)).alias(name)

    return (
        lines.filter(strip(F.col(line)) != "")
        # A generator parses each line once; a plain column would be parsed again per field.
        .select(*others, F.inline(F.array(parsed)))
        .filter(F.col("_broken").isNull() & F.col("event_type").isin(COMPLETED, FAILED))
        .select(*others, *[field(name, kind) for name, kind in AUDIT_FIELDS.items()])
    )


def recent_events(events: DataFrame, limit: int = 500, position: str | None = None) -> DataFrame:
    """The last `limit` events, newest first.

    Files have no line numbers in Spark; without a position column the newest by time are taken.
    """
    newest = [F.col("timestamp").desc_nulls_last(), F.col("request_id").desc_nulls_last()]
    last = [F.col(position).desc()] if position else newest
    return events.orderBy(*last).limit(limit).orderBy(*newest)


def load_audit_events(spark: SparkSession, path: str, limit: int = 500) -> DataFrame:
    return recent_events(parse_audit_lines(spark.read.text(path)), limit)
