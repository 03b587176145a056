"""Chat and audit log reports."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewcast.functions.dates import as_date, recency_label
from crewcast.functions.numbers import fixed_text
from crewcast.functions.text import NEW_CONVERSATION, conversation_title
from crewcast.operators.numbering import number_rows
from crewcast.sources.audit_log import COMPLETED, FAILED


def number_messages(messages: DataFrame) -> DataFrame:
    """sequence_number from 1 per conversation, in the order of the turns."""
    return number_rows(messages, ["conversation_id"], "turn", "sequence_number")


def conversation_summary(messages: DataFrame) -> DataFrame:
    """Owner, title from the first user message, last route, last update and message count."""
    from_user = F.when(F.col("role") == "user", F.col("turn"))
    routed = F.when(F.col("route").isNotNull(), F.col("turn"))
    return messages.groupBy("conversation_id").agg(
        F.min("user_id").alias("user_id"),
        F.coalesce(
            conversation_title(F.min_by("content", from_user)), F.lit(NEW_CONVERSATION)
        ).alias("title"),
        F.max_by("route", routed).alias("last_route"),
        F.min("created_at").alias("created_at"),
        F.max("created_at").alias("updated_at"),
        F.count("*").alias("message_count"),
        F.bool_or("is_archived").alias("is_archived"),
    )


def list_conversations(
    conversations: DataFrame, user_id: str, include_archived: bool = False, limit: int = 50
) -> DataFrame:
    """One owner's conversations, latest first."""
    owned = conversations.filter(F.col("user_id") == user_id)
    if not include_archived:
        owned = owned.filter(~F.col("is_archived"))
    return owned.orderBy(F.col("updated_at").desc(), "conversation_id").limit(max(limit, 0))


def list_messages(messages: DataFrame, conversation_id, user_id: str) -> DataFrame:
    """One conversation's messages in order, for its owner only.

    Only this conversation is read and numbered; numbers the messages already have are kept.
    """
    own = messages.filter(F.col("conversation_id") == conversation_id)
    numbered = own if "sequence_number" in own.columns else number_messages(own)
    return numbered.filter(F.col("user_id") == user_id).orderBy("sequence_number")


def recent_conversations(
    conversations: DataFrame, as_of: str | date, include_archived: bool = False, limit: int = 50
) -> DataFrame:
    """The latest conversations of every owner, with the heading they are listed under."""
    if not include_archived:
        conversations = conversations.filter(~F.col("is_archived"))
    latest = Window.partitionBy("user_id").orderBy(
        F.col("updated_at").desc(), F.col("conversation_id").asc()
    )
    return (
        conversations.withColumn("position", F.row_number().over(latest))
        .filter(F.col("position") <= limit)
        .select(
            "user_id",
            "position",
            "conversation_id",
            "title",
            "updated_at",
            recency_label(F.col("updated_at"), as_date(as_of)).alias("label"),
        )
    )


def stored_message(messages: DataFrame) -> DataFrame:
    """Sources and metadata as the JSON text they are stored as."""
    return messages.withColumns(
        {
            "sources_json": F.to_json(F.coalesce("sources", F.array().cast("array<string>"))),
            "metadata_json": F.to_json(
                F.coalesce("metadata", F.create_map().cast("map<string,string>"))
            ),
        }
    ).drop("sources", "metadata")


def restored_message(stored: DataFrame) -> DataFrame:
    """Stored JSON text back to columns; missing text gives an empty list and map."""
    return stored.withColumns(
        {
            "sources": F.from_json(
                F.coalesce("sources_json", F.lit("[]")), T.ArrayType(T.StringType())
            ),
            "metadata": F.from_json(
                F.coalesce("metadata_json", F.lit("{}")),
                T.MapType(T.StringType(), T.StringType()),
            ),
        }
    ).drop("sources_json", "metadata_json")


def audit_summary(events: DataFrame) -> DataFrame:
    """Requests in total, completed and failed, and the mean response time of the completed."""
    completed, failed = F.col("event_type") == COMPLETED, F.col("event_type") == FAILED
    # Decimal sums do not depend on the order in which the rows arrive.
    times = F.when(completed, F.col("response_time_ms").cast("decimal(18,3)"))
    mean = F.coalesce(
        F.sum(times).cast("double") / F.nullif(F.count(times), F.lit(0)), F.lit(0.0)
    )
    return events.agg(
        F.count_if(completed | failed).alias("total_requests"),
        F.count_if(completed).alias("successful_requests"),
        F.count_if(failed).alias("failed_requests"),
        F.concat(fixed_text(mean, 0), F.lit(" ms")).alias("average_response_time"),
    )


def requests_by_route(events: DataFrame) -> DataFrame:
    """Completed requests per route, most frequent first; a missing route is a group of its own."""
    return (
        events.filter(F.col("event_type") == COMPLETED)
        .groupBy("route")
        .agg(F.count("*").alias("request_count"))
        .orderBy(F.col("request_count").desc(), F.col("route").asc_nulls_last())
    )


def request_table(events: DataFrame) -> DataFrame:
    """Requests with the texts they are shown with."""
    return events.filter(F.col("event_type").isin(COMPLETED, FAILED)).select(
        "request_id",
        F.coalesce("user_id", F.lit("Unknown user")).alias("User"),
        F.coalesce("question", F.lit("Question was not recorded")).alias("Question"),
        F.coalesce("route", F.lit("unknown")).alias("Route"),
        F.concat(
            F.coalesce(fixed_text(F.col("response_time_ms"), 0), F.lit("-")), F.lit(" ms")
        ).alias("Response Time"),
        F.when(F.col("success"), "✅").otherwise("❌").alias("Success"),
    )
