"""A stored table dealt into buckets by a key, of which only the buckets of changed keys are rewritten."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from crewcast.sources.report_store import _is_table
from crewcast.sources.shared_storage import fresh_path, written

BUCKET = "_bucket"


class BucketedStore:
    """Parquet under `path`, one folder per bucket of the hash of `key`.

    Each written bucket also holds one row without key, so that a bucket whose last row goes is
    replaced like any other; reading leaves these rows out. Rows without key are refused. Give so
    many buckets that one fits a task.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 64):
        self.spark, self.path, self.key, self.buckets = spark, path.rstrip("/"), key, buckets

    def exists(self) -> bool:
        return _is_table(self.spark, self.path)

    def bucket_of(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def read(self) -> DataFrame:
        return self.spark.read.parquet(self.path).filter(F.col(self.key).isNotNull()).drop(BUCKET)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        refused = F.raise_error(F.lit("a row without key")).cast("int")
        key = F.col(self.key)
        return rows.withColumn(BUCKET, F.when(key.isNull(), refused).otherwise(self.bucket_of(key)))

    def _write(self, dealt: DataFrame, buckets: list[int]) -> None:
        empty = [F.lit(None).cast(f.dataType).alias(f.name) for f in dealt.schema if f.name != BUCKET]
        marks = self.spark.createDataFrame([(b,) for b in buckets], f"{BUCKET} int").select(*empty, BUCKET)
        everything = dealt.unionByName(marks).repartition(BUCKET)
        everything.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy(BUCKET).parquet(self.path)

    def create(self, rows: DataFrame) -> None:
        """Writes the whole table."""
        self._write(self._dealt(rows), list(range(self.buckets)))

    def replace(self, rows: DataFrame, changed: DataFrame) -> list[int]:
        """Puts `rows` in the place of all stored rows whose key is in `changed`; returns the buckets rewritten.

        Every key of rows must be in changed; a changed key without rows is removed. The new
        buckets are written apart before they replace the stored ones, each as a whole. A run that
        breaks off between two buckets can be repeated.
        """
        keys = written(changed.select(self.key).distinct(), fresh_path(self.spark, "changed-keys"))
        # At most as many rows as there are buckets.
        touched = sorted(r[0] for r in keys.select(self.bucket_of(F.col(self.key))).distinct().collect())
        if not touched:
            return []
        stored = self.spark.read.parquet(self.path).filter(F.col(BUCKET).isin(touched) & F.col(self.key).isNotNull())
        kept = stored.join(keys, self.key, "left_anti")
        merged = written(kept.unionByName(self._dealt(rows), allowMissingColumns=True), fresh_path(self.spark, "buckets"))
        self._write(merged, touched)
        return touched


def content_hashes(columns: list[str], prefix: str = "_h") -> list[Column]:
    """Two 64-bit hashes of a row's columns; nulls and empty texts differ."""
    cells = [F.coalesce(F.to_json(F.struct(F.col(f"`{c}`"))), F.lit("")) for c in columns]
    return [F.xxhash64(*cells).alias(f"{prefix}1"), F.xxhash64(F.lit("second"), *cells).alias(f"{prefix}2")]
