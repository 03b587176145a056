"""Intermediates and stores are written in the smaller format."""

from pathlib import Path

from crewcast.sources.bucketed_store import BucketedStore
from crewcast.sources.shared_storage import written


def test_texts_are_written_with_zstd(spark, tmp_path):
    rows = spark.createDataFrame([(n, f"text {n}") for n in range(4)], "id bigint, text string")
    assert sorted(written(rows, str(tmp_path / "table")).collect()) == sorted(rows.collect())
    BucketedStore(spark, str(tmp_path / "store"), "id", 2).create(rows)
    files = [p.name for name in ("table", "store") for p in Path(tmp_path / name).rglob("*.parquet")]
    assert files and all(".zstd." in name for name in files)
