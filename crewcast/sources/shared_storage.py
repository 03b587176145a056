"""Folder for written intermediates that every executor can reach."""

from __future__ import annotations

import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

#: Rows of ids, labels or signatures that go into a file of their own; below, cores share the rows.
ROWS_OF_FILE = 100_000


@lru_cache(maxsize=1)
def _local_folder() -> str:
    return tempfile.mkdtemp(prefix="crewcast-")


def shared_folder(spark: SparkSession) -> str:
    """The folder the session names in spark.checkpoint.dir.

    Only a local session without one falls back to a temporary folder, one per process; on a
    cluster a folder of one machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    return _local_folder()


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's own subfolder, which can go when the application has ended."""
    return f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, path: str) -> DataFrame:
    """Write df once and go on from the written table, so lost executors recompute nothing above.

    Intermediates are mostly texts, which zstd makes much smaller than the session's default does.
    """
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def in_few_files(df: DataFrame, rows: int) -> DataFrame:
    """df of `rows` rows at most, with as many partitions as these need: one a core, or one per ROWS_OF_FILE.

    A table of few rows otherwise gets a file for each shuffle partition. Each file is a task and
    a rename, and a local file system starts a process to set its mode.
    """
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // ROWS_OF_FILE)))
