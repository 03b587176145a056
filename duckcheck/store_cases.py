"""Stored tables that follow their sources."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.operators.chunking import chunk_rows
from crewcast.plans.calendar import calendar_positions
from crewcast.plans.delta_refresh import refresh_calendar, stored_calendar
from crewcast.plans.profile_documents import index_rows
from crewcast.plans.profile_index import reindex
from crewcast.sources.bucketed_store import BucketedStore
from crewcast.sources.shared_storage import fresh_path
from crewcast.sources.star_schema import AS_OF, StarSchema
from duckcheck.case import Case, case
from duckcheck.report_cases import _calendar
from duckcheck.text_cases import CHUNKS_SQL


def _refreshed(s: StarSchema) -> DataFrame:
    """A calendar of other data, then two refreshes: to the data of the tables, and once more without a change."""
    folder, data = fresh_path(s.spark, "reports"), s.master()
    order, person = F.col("ActivityAssignment_Id").cast("bigint"), F.col("Resource_Id").cast("bigint")
    moved = F.when(order % 50 == 1, F.concat(F.lit("9"), "Resource_Id")).otherwise(F.col("Resource_Id"))
    earlier = replace(
        data,
        # Other people, missing assignments, other groups.
        assignments=data.assignments.filter(order % 50 != 0)
        .withColumn("Group", F.when(person % 97 == 0, "Elsewhere").otherwise(F.col("Group")))
        .withColumn("Resource_Id", moved),
        time_entries=data.time_entries.withColumn("Logged_Hours", F.when(order % 40 == 3, 1.0).otherwise(F.col("Logged_Hours"))),
        leave=data.leave.filter(person % 30 != 0),
    )
    refresh_calendar(s.spark, earlier, folder, AS_OF, buckets=16)
    refresh_calendar(s.spark, data, folder, AS_OF, buckets=16)
    if refresh_calendar(s.spark, data, folder, AS_OF, buckets=16):
        raise RuntimeError("a refresh without changes rewrote buckets")
    return stored_calendar(s.spark, folder, AS_OF)


def _reindexed(s: StarSchema) -> DataFrame:
    """Three runs: whole texts, some shortened and some gone, most of these back."""
    path = fresh_path(s.spark, "index")
    doc, text = F.col("doc_id"), F.col("text")
    docs = s.table("documents").select("doc_id", "text", "lang")
    half = F.substring(text, F.lit(1), F.ceil(F.length(text) / 2).cast("int"))
    runs = (
        docs,
        docs.filter(doc % 7 != 0).withColumn("text", F.when(doc % 5 == 0, half).otherwise(text)),
        docs.filter(doc % 21 != 0).withColumn("text", F.when(doc % 35 == 5, half).otherwise(text)),
    )
    for n, run in enumerate(runs, start=1):
        chunks = chunk_rows(run, "text")
        documents = chunks.select(
            F.concat_ws("-", "doc_id", "chunk_number").alias("id"), F.col("chunk").alias("content"),
            F.col("lang").alias("title"), F.col("chunk_number").cast("string").alias("row_number"),
        ).filter("trim(content) <> ''")
        stamp = F.lit(f"2024-01-0{n} 00:00:00").cast("timestamp")
        reindex(index_rows(documents, stamp), path, stamp, buckets=16)
    index = BucketedStore(s.spark, path, "id").read()
    return index.select("id", "content", "title", "row_number", "removed", "changed_at", F.col("last_modified").alias("indexed_at"))


def _index_run(run: int, text: str, where: str) -> str:
    chunks = CHUNKS_SQL.format(keys="doc_id, lang", text="t", source=f"(SELECT doc_id, lang, {text} AS t FROM documents WHERE {where})", size=1200, step=1050)
    return f"""run{run} AS (
  SELECT doc_id || '-' || chunk_number AS id, chunk AS content, lang AS title, chunk_number::INT AS row_number
  FROM ({chunks}) WHERE trim(chunk) <> '')"""


_HALF = "substring(text, 1, CAST(ceil(length(text) / 2) AS BIGINT))"
# Each row's state after every run: what it says, and the run that last changed it.
REINDEXED_SQL = f"""
WITH {_index_run(1, 'text', 'TRUE')},
{_index_run(2, f'CASE WHEN doc_id % 5 = 0 THEN {_HALF} ELSE text END', 'doc_id % 7 <> 0')},
{_index_run(3, f'CASE WHEN doc_id % 35 = 5 THEN {_HALF} ELSE text END', 'doc_id % 21 <> 0')},
ids AS (SELECT id FROM run1 UNION SELECT id FROM run2 UNION SELECT id FROM run3),
states AS (
  SELECT id, a.content AS c1, b.content AS c2, c.content AS c3, coalesce(a.title, b.title, c.title) AS title,
         coalesce(a.row_number, b.row_number, c.row_number) AS row_number
  FROM ids LEFT JOIN run1 a USING (id) LEFT JOIN run2 b USING (id) LEFT JOIN run3 c USING (id)
), changed AS (
  SELECT *, CASE WHEN c3 IS DISTINCT FROM c2 THEN 3 WHEN c2 IS DISTINCT FROM c1 THEN 2 ELSE 1 END AS run,
         CASE WHEN c3 IS NOT NULL THEN CASE WHEN c3 IS DISTINCT FROM c2 THEN 3 WHEN c2 IS DISTINCT FROM c1 THEN 2 ELSE 1 END
              WHEN c2 IS NOT NULL THEN CASE WHEN c2 IS DISTINCT FROM c1 THEN 2 ELSE 1 END ELSE 1 END AS said
  FROM states
)
SELECT id, c3 AS content, title, row_number, c3 IS NULL AS removed, TIMESTAMP '2024-01-01' + to_days(run - 1) AS changed_at,
       TIMESTAMP '2024-01-01' + to_days(said - 1) AS indexed_at
FROM changed"""

CASES: dict[str, Case] = {
    "refreshed_calendar": case(_refreshed, "SELECT * FROM calendar"),
    "reindexed_profiles": case(_reindexed, REINDEXED_SQL),
    "calendar_positions": case(
        lambda s: calendar_positions(_calendar(s)).select("Group", "Consultant_Name", "WeekStart", "Resource_Id", "position"),
        """
        SELECT "Group", Consultant_Name, WeekStart, Resource_Id,
               row_number() OVER (ORDER BY "Group" NULLS LAST, Consultant_Name NULLS LAST, WeekStart, Resource_Id) AS position
        FROM calendar""",
    ),
}
