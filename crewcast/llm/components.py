"""Connected components by repeated label joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.sources.shared_storage import fresh_path, in_few_files, written


def components(links: DataFrame) -> DataFrame:
    """id, comp: for every id of `links` (a, b) the smallest id it is connected with.

    Each round takes the smallest label among neighbours (combined before the shuffle, so a node
    with very many links is no hot key there) and then the label of the label. Rounds grow with
    the logarithm of the longest chain, not with group sizes. Labels are written each round.
    Null ends and links of a node to itself are ignored. Runs jobs while it is built, the first of
    which counts the links.
    """
    spark = links.sparkSession
    ends = links.select("a", "b").filter("a <> b")
    most = 2 * links.count()  # rows of each table below
    both = written(
        in_few_files(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), most),
        fresh_path(spark, "links"),
    )
    labels = written(
        in_few_files(both.groupBy(F.col("a").alias("id")).agg(F.least("a", F.min("b")).alias("comp")), most),
        fresh_path(spark, "labels"),
    )
    while True:
        heard = (
            both.join(labels.withColumnRenamed("id", "b"), "b")
            .groupBy(F.col("a").alias("id"))
            .agg(F.min("comp").alias("_heard"))
        )
        nearer = labels.join(heard, "id").select("id", "comp", F.least("comp", "_heard").alias("_low"))
        # A jump through the label is only a shortcut: labels are ids of the same component.
        jump = labels.select(F.col("id").alias("_low"), F.col("comp").alias("_next"))
        after = nearer.join(jump, "_low", "left").select(
            "id",
            F.least("_low", F.coalesce("_next", "_low")).alias("comp"),
            F.col("comp").alias("_before"),
        )
        after = written(in_few_files(after, most), fresh_path(spark, "labels"))
        labels = after.select("id", "comp")
        if after.filter("comp <> _before").isEmpty():
            return labels
