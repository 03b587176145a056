"""Named reports as Parquet, CSV export, search index table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession

from crewcast.operators.observed import observed_write
from crewcast.operators.quality import assert_unique
from crewcast.operators.reshape import export_columns
from crewcast.sources.shared_storage import fresh_path, written

# The tables a report store knows.
REPORT_NAMES = (
    "bench_status", "consultant_tracker", "partial_assignments", "project_tracker",
    "utilisation", "utilisation_detailed",
    "employee_list", "languages", "professional_experience", "technologies",
)


class ReportStore:
    """A folder with one Parquet table per report name."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")

    def path(self, name: str) -> str:
        known = name.strip().lower()
        if known not in REPORT_NAMES:
            raise KeyError(
                f"Unknown report: {name}. Available reports: {', '.join(sorted(REPORT_NAMES))}"
            )
        return f"{self.folder}/{known}.parquet"

    def save(self, name: str, report: DataFrame) -> str:
        path = self.path(name)
        report.write.mode("overwrite").parquet(path)
        return path

    def save_checked(self, name: str, report: DataFrame, checks: Mapping[str, Column]) -> dict[str, str | None]:
        """Saves the report and returns its checks, which the same job computes."""
        return observed_write(report, self.path(name), checks)

    def save_quality(self, rows: list[tuple[str, str, str | None]]) -> None:
        """Keeps the checks of a run: a few dozen rows of (report, check, value)."""
        table = self.spark.createDataFrame(rows, "report string, check string, value string")
        table.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/quality.parquet")

    def load_quality(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/quality.parquet")

    def load(self, name: str) -> DataFrame:
        return self.spark.read.parquet(self.path(name))


def export_csv(report: DataFrame, path: str) -> None:
    """Visible columns, dates as text, header line; one file per partition."""
    export_columns(report).write.mode("overwrite").option("header", True).csv(path)


def index_documents(rows: DataFrame, path: str) -> int:
    """Merges search index rows into the index at `path` by id; returns how many it then has.

    Rows that an index would refuse (no id or no content) and repeated ids fail the whole run
    before anything is written. A new row replaces the indexed one of its id; all others stay.
    The rows are computed once, into an intermediate; the merged index is written apart before it
    replaces the stored one.
    """
    spark = rows.sparkSession
    rows = written(rows, fresh_path(spark, "index-rows"))
    refused = rows.filter("id IS NULL OR trim(id) = '' OR content IS NULL OR trim(content) = ''")
    examples = refused.select("id").limit(5).collect()
    if examples:
        raise RuntimeError(f"Some documents could not be indexed: {[r[0] for r in examples]}")
    assert_unique(rows, ["id"], "index rows")
    merged = rows
    if _is_table(spark, path):
        stored = spark.read.parquet(path)
        kept = stored.join(rows.select("id"), "id", "left_anti")
        merged = written(kept.unionByName(rows, allowMissingColumns=True), fresh_path(spark, "index"))
    merged.write.mode("overwrite").parquet(path)
    return merged.count()


def _is_table(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return False
        raise
    return True
