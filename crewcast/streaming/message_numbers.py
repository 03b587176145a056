"""Message numbers that go on from batch to batch, with repeated and late messages accounted for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewcast.operators.numbering import number_rows
from crewcast.sources.report_store import _is_table
from crewcast.sources.shared_storage import fresh_path, written

KEYS = ("conversation_id", "turn")
NUMBERED, LATE, REPEATED = "numbered", "late", "repeated"


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]):
    condition = F.lit(True)
    for key in keys:
        condition = condition & left[key].eqNullSafe(right[key])
    return condition


class NumberedMessages:
    """A stream of messages numbered from 1 per conversation, kept in tables under `folder`.

    Every arriving row ends in exactly one table: `numbered`; `late`, when its time lies more than
    `lateness` before the latest time of the batches before; or `repeated`, one row per
    (conversation, turn) with the number of copies left out. Of copies in one batch the one with
    the earliest time is numbered; copies of a row of an earlier batch are found while that batch
    reaches into the lateness. A null conversation is a conversation, a null turn a turn, and a
    null time is never late.

    Inside a batch numbers follow the turns (`number_rows`, so a conversation with most of the
    batch is split); across batches they go on from the conversation's count. A batch writes its
    own partition of each table and its mark last: a batch that broke off is not read and is
    written anew when the stream repeats it. Every `fold` batches the counts are summed up, so a
    batch reads one total and fewer than `fold` counts. Columns must have an order (no maps).
    """

    def __init__(self, spark: SparkSession, folder: str, lateness: str = "1 day", time: str = "created_at", fold: int = 64):
        self.spark, self.folder, self.lateness, self.time, self.fold = spark, folder.rstrip("/"), lateness, time, fold

    def run_available(self, messages: DataFrame) -> None:
        """Takes what has arrived; later runs continue."""
        query = (
            messages.writeStream.foreachBatch(self._take)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )
        query.awaitTermination()

    def read(self, table: str) -> DataFrame:
        """One of the three tables, of all batches that are complete."""
        stored = self.spark.read.parquet(f"{self.folder}/{table}")
        return stored.join(self._marks().select("batch"), "batch", "left_semi").drop("batch")

    def _marks(self) -> DataFrame:
        schema = "latest timestamp, batch bigint"
        if not _is_table(self.spark, f"{self.folder}/marks"):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.folder}/marks")

    def _write(self, df: DataFrame, table: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.folder}/{table}/batch={batch}")

    def _part(self, table: str, batches: Sequence[int]) -> DataFrame:
        paths = [f"{self.folder}/{table}/batch={n}" for n in batches]
        return self.spark.read.parquet(*paths)

    def _take(self, arrived: DataFrame, batch: int) -> None:
        path = fresh_path(self.spark, "messages")
        arrived.write.parquet(path)
        rows = self.spark.read.schema(arrived.schema).parquet(path)
        before = self._marks().filter(F.col("batch") < batch)
        # One row: the time before which a message is late.
        limit = before.select((F.max("latest") - F.expr(f"INTERVAL {self.lateness}")).alias("limit")).first()["limit"]
        # One number for each batch that reaches into the lateness.
        old = F.coalesce(F.col("latest") < F.lit(limit).cast("timestamp"), F.lit(False))
        recent = [r["batch"] for r in before.filter(~old).select("batch").collect()]

        late = F.coalesce(F.col(self.time) < F.lit(limit).cast("timestamp"), F.lit(False))
        self._write(rows.filter(late).withColumn("limit", F.lit(limit).cast("timestamp")), LATE, batch)

        others = [c for c in rows.columns if c not in (*KEYS, self.time)]
        place = F.struct(F.col(self.time).isNull().alias("_untimed"), self.time, *others)
        single = rows.filter(~late).groupBy(*KEYS).agg(F.min(place).alias("_row"), F.count("*").alias("_copies"))
        single = written(single, fresh_path(self.spark, "single"))
        if recent:
            seen = self._part(NUMBERED, recent).select(*KEYS)
            fresh = single.join(seen, _same(single, seen, KEYS), "left_anti")
            again = single.join(seen, _same(single, seen, KEYS), "left_semi")
        else:
            fresh, again = single, single.limit(0)
        copies = fresh.filter("_copies > 1").withColumn("copies", F.col("_copies") - 1).unionByName(again.withColumn("copies", F.col("_copies")))
        self._write(copies.select(*KEYS, "copies"), REPEATED, batch)

        plain = fresh.select(*KEYS, "_row.*").select(*rows.columns)
        numbers = number_rows(plain, [KEYS[0]], KEYS[1], "sequence_number", ties=[self.time, *others])
        earlier = self._counts(batch // self.fold * self.fold, batch)
        if earlier is not None:
            earlier = earlier.withColumnRenamed(KEYS[0], "_conversation")
            numbers = numbers.join(earlier, F.col(KEYS[0]).eqNullSafe(F.col("_conversation")), "left").withColumn(
                "sequence_number", F.col("sequence_number") + F.coalesce("rows", F.lit(0))
            )
        self._write(numbers.select(*rows.columns, "sequence_number"), NUMBERED, batch)

        counts = self._part(NUMBERED, [batch]).groupBy(KEYS[0]).agg(F.count("*").alias("rows"))
        self._write(counts, "counts", batch)
        if batch % self.fold == self.fold - 1:
            self._write(self._counts(batch - self.fold + 1, batch + 1), "totals", batch)
        self._write(rows.agg(F.max(self.time).cast(T.TimestampType()).alias("latest")), "marks", batch)

    def _counts(self, start: int, end: int) -> DataFrame | None:
        """Numbered rows per conversation of all batches before `end`; the total before `start` stands written."""
        parts = [self._part("counts", range(start, end))] if end > start else []
        if start:
            parts.append(self._part("totals", [start - 1]))
        if not parts:
            return None
        both = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
        return both.groupBy(KEYS[0]).agg(F.sum("rows").alias("rows"))
