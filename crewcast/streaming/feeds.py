"""Additions: audit counts and weekly hours kept up to date from file streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from crewcast.functions.numbers import DAY_HOURS


def request_counts(events: DataFrame, window: str = "1 day", lateness: str = "1 hour") -> DataFrame:
    """Requests per tumbling window and route; events later than `lateness` are not counted."""
    return (
        events.withWatermark("timestamp", lateness)
        .groupBy(F.window("timestamp", window).alias("_window"), "route")
        .agg(F.count("*").alias("request_count"))
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "route",
            "request_count",
        )
    )


def weekly_hours(entries: DataFrame, lateness: str = "14 days") -> DataFrame:
    """Hours per assignment and Monday week of a stream of (ActivityAssignment_Id, ts, hours).

    The epoch is a Thursday; the four-day offset makes the windows start on Mondays.
    """
    return (
        entries.withWatermark("ts", lateness)
        .groupBy(F.window("ts", "7 days", "7 days", "4 days").alias("_week"), "ActivityAssignment_Id")
        .agg(F.sum("hours").alias("Logged_Hours"))
        .select(
            "ActivityAssignment_Id",
            F.col("_week.start").cast("date").alias("WeekStart"),
            "Logged_Hours",
            (F.col("Logged_Hours") / DAY_HOURS).alias("Consumed_Days"),
        )
    )


def run_available(result: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Processes what has arrived, once, into a Parquet table, and reads that table.

    Append mode: a window is written when the watermark has passed its end; later runs with the
    same checkpoint continue where this one stopped.
    """
    query = (
        result.writeStream.format("parquet")
        .outputMode("append")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return result.sparkSession.read.schema(result.schema).parquet(path)


# Later than any event; its own window never ends.
_CLOSING = "9000-01-01 00:00:00"


def with_closing_marks(events: DataFrame, folder: str) -> DataFrame:
    """The stream together with the marks in `folder`, which must be there from its first run on."""
    spark = events.sparkSession
    spark.createDataFrame([], events.schema).write.mode("ignore").parquet(folder)
    return events.unionByName(spark.readStream.schema(events.schema).parquet(folder))


def close_stream(spark: SparkSession, schema: StructType, folder: str, time: str) -> None:
    """Puts a mark that lets the next run write every open window; what arrives later is too late.

    The mark only moves the watermark: its own window stays open for ever and is never written.
    """
    cells = [(F.lit(_CLOSING) if f.name == time else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema]
    spark.range(1).select(*cells).write.mode("append").parquet(folder)
