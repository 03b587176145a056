"""A search index that follows its documents: changed rows by content hash, vanished rows as tombstones."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.operators.quality import assert_unique
from crewcast.sources.bucketed_store import BucketedStore, content_hashes
from crewcast.sources.shared_storage import fresh_path, written

BUCKETS = 64
#: Columns the index keeps beside those of its rows.
STATE = ("removed", "changed_at", "_h1", "_h2")
#: Columns that do not make a row a changed one.
UNHASHED = ("last_modified",)


def reindex(rows: DataFrame, path: str, changed_at: Column, buckets: int = BUCKETS) -> dict[str, int]:
    """Makes the index at `path` hold exactly `rows` (id, content, ...); returns how many were added, changed, removed and left.

    A row is compared with the stored one by two hashes of all its columns but last_modified. Only
    buckets with an added, changed or removed id are rewritten. A removed row stays as a tombstone
    (removed is true, content null), so that copies of the index can delete it too; it is removed
    once, and comes back as an added row. changed_at is kept from the run that last changed the
    row. Rows without id or content and repeated ids fail the run before anything is written. Runs
    jobs.
    """
    spark = rows.sparkSession
    hashed = [c for c in rows.columns if c not in UNHASHED]
    rows = written(rows.select("*", *content_hashes(hashed)), fresh_path(spark, "index-rows"))
    refused = rows.filter("id IS NULL OR trim(id) = '' OR content IS NULL OR trim(content) = ''").select("id").limit(5).collect()
    if refused:
        raise RuntimeError(f"Some documents could not be indexed: {[r[0] for r in refused]}")
    assert_unique(rows, ["id"], "index rows")
    live = rows.withColumns({"removed": F.lit(False), "changed_at": changed_at})
    store = BucketedStore(spark, path, "id", buckets)
    if not store.exists():
        store.create(live)
        return {"added": rows.count(), "changed": 0, "removed": 0, "left": 0}

    stored = store.read().select("id", F.struct("removed", "_h1", "_h2").alias("was"))
    compared = stored.join(rows.select("id", F.struct("_h1", "_h2").alias("is")), "id", "full")
    was_live = F.col("was").isNotNull() & ~F.col("was.removed")
    same = (F.col("was._h1") == F.col("is._h1")) & (F.col("was._h2") == F.col("is._h2"))
    kind = (
        F.when(F.col("is").isNull(), F.when(was_live, "removed"))
        .when(~was_live, "added")
        .when(same, "left")
        .otherwise("changed")
    )
    compared = written(compared.select("id", kind.alias("kind")).filter("kind is not null"), fresh_path(spark, "index-changes"))
    counts = {r["kind"]: r["n"] for r in compared.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    changes = compared.filter("kind <> 'left'")
    renewed = live.join(changes.filter("kind <> 'removed'").select("id"), "id", "left_semi")
    gone = store.read().join(changes.filter("kind = 'removed'").select("id"), "id", "left_semi")
    gone = gone.withColumns({"removed": F.lit(True), "changed_at": changed_at, "content": F.lit(None).cast("string")})
    store.replace(renewed.unionByName(gone, allowMissingColumns=True), changes)
    return {k: counts.get(k, 0) for k in ("added", "changed", "removed", "left")}


def live_rows(index: DataFrame) -> DataFrame:
    """The rows of a read index that are not removed, without the index's own columns."""
    return index.filter("NOT removed").drop(*STATE)
