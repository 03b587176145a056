"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, then an
exact weighted-shingle similarity. DataFrame functions only.

Texts are lower-cased; a shingle is five consecutive words; its weight is how often it occurs in
the window or item. A document is contaminated by an item of n words where a window of n words
(the whole text, if that is shorter) has a weighted Jaccard similarity of 0.75 or more with it.

Windows are pruned without loss before they get a fingerprint: at that similarity a window holds
at least 3/7 of both sides' shingles in common with the item, so windows with fewer shingles of
the item are left out. A 64-bit SimHash of the others meets those of the items of the same length
by eight blocks of eight bits: within radius 23 one block differs in two bits at most, and the
items enumerate these. At similarity 0.75 fingerprints differ in 11 bits on average, with a
deviation of 3.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.llm.words import WORD_GAP
from crewcast.sources.shared_storage import fresh_path, written

SHINGLE = 5
#: Fingerprint bits that may differ: below 3 * BLOCKS one block has two wrong bits at most.
RADIUS, BLOCKS = 23, 8
#: Item shingles (16 bytes each) up to which they are sent to all tasks; beyond, both sides are shuffled.
MOST_BROADCAST = 1_000_000

# All values of a block that differ from 0 in two bits at most.
_ERRORS = [n for n in range(256) if n.bit_count() <= 2]


def words_of(text: str) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), WORD_GAP), "")


def shingles_of(words: str) -> Column:
    """Hashes of the five-word runs of an array column, in order; empty below five words."""
    run = ", ".join(f"{words}[i + {n}]" for n in range(SHINGLE))
    return F.expr(
        f"if(size({words}) >= {SHINGLE}, transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({run})), array())"
    )


def _fingerprints(weighted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, fingerprint of rows keys, h, weight. A bit is set where most of the weight has it.

    Four bits share one 64-bit sum in lanes of 16 bits each, so 16 sums take all 64; a window
    below 65,536 shingles cannot overflow a lane.
    """
    sums = [
        F.sum(F.expr(" + ".join(f"shiftleft(weight * (shiftright(h, {4 * n + k}) & 1L), {16 * k})" for k in range(4)))).alias(f"s{n}")
        for n in range(16)
    ]
    bits = " | ".join(
        f"if(2 * (shiftrightunsigned(s{n}, {16 * k}) & 65535L) > total, shiftleft(1L, {4 * n + k}), 0L)"
        for n in range(16)
        for k in range(4)
    )
    return weighted.groupBy(*keys).agg(F.sum("weight").alias("total"), *sums).select(*keys, F.expr(bits).alias("fingerprint"))


def _block_keys(errors: bool) -> Column:
    """(block, value) pairs of a fingerprint, for items with all values two bits away."""
    changed = f"array({', '.join(map(str, _ERRORS))})" if errors else "array(0)"
    return F.expr(
        f"flatten(transform(sequence(0, {BLOCKS - 1}), b -> transform({changed}, e ->"
        " struct(b as block, cast(shiftrightunsigned(fingerprint, 8 * b) & 255L as int) ^ e as value))))"
    )


def _items(benchmark: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(item, item_id, length), (item, length, h, weight) of items with at least five words."""
    spark = benchmark.sparkSession
    rows = (
        benchmark.select(F.col("item_id"), words_of("text").alias("words"))
        .filter(F.size("words") >= SHINGLE)
        .select("item_id", F.size("words").alias("length"), shingles_of("words").alias("hashes"))
        .withColumn("item", F.xxhash64("item_id", "hashes"))
    )
    rows = written(rows, fresh_path(spark, "items"))
    weighted = rows.dropDuplicates(["item"]).select("item", "length", F.explode("hashes").alias("h"))
    return rows.select("item", "item_id", "length").distinct(), weighted.groupBy("item", "length", "h").agg(F.count("*").alias("weight"))


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, similarity: the best window of each contaminated document and item.

    Items with fewer than five words (null, empty) have no shingle and match nothing, as do texts
    of fewer words. Documents repeated under one id are searched each; the best similarity
    counts. Rows without a doc_id are searched and reported with a null id. Runs jobs while it is
    built. Other columns are ignored.
    """
    spark = docs.sparkSession
    items, weighted = _items(benchmark)
    weighted = written(weighted, fresh_path(spark, "item-shingles"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("text is not null")

    known = weighted.select("h", "item", "length")
    if known.count() <= MOST_BROADCAST:
        known = F.broadcast(known)
    shingled = texts.select("doc_id", F.xxhash64("text").alias("row_key"), words_of("text").alias("words"))
    hits = (
        shingled.select("doc_id", "row_key", F.size("words").alias("n"), shingles_of("words").alias("hashes"))
        # Outer: the optimiser would else test size(hashes) > 0 first, splitting the text for each shingle.
        .select("doc_id", "row_key", "n", F.posexplode_outer("hashes").alias("at", "h"))
        .join(known, "h")
    )
    starts = F.expr(f"explode(sequence(greatest(at - (least(length, n) - {SHINGLE}), 0), least(at, n - least(length, n))))")
    windows = (
        hits.dropDuplicates(["doc_id", "row_key", "item", "at"])
        .filter("least(length, n) >= 5 and greatest(at - (least(length, n) - 5), 0) <= least(at, n - least(length, n))")
        .select("doc_id", "row_key", "item", "length", "n", starts.alias("start"))
        .groupBy("doc_id", "row_key", "item", "length", "n", "start")
        .agg(F.count("*").alias("common"))
        .filter("7 * common >= 3 * (least(length, n) - 4 + length - 4)")
        .select("doc_id", "row_key", "length", "start")
        .distinct()
    )
    wanted = windows.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("length", "start")).alias("windows"))
    wanted = written(wanted, fresh_path(spark, "windows"))
    shingle_rows = (
        texts.withColumn("row_key", F.xxhash64("text"))
        .join(wanted.withColumnsRenamed({"doc_id": "_doc", "row_key": "_key"}), F.expr("doc_id <=> _doc and row_key = _key"))
        .dropDuplicates(["doc_id", "row_key"])
        .select("doc_id", "row_key", "windows", words_of("text").alias("words"))
        .select("doc_id", "row_key", "windows", shingles_of("words").alias("hashes"))
        .select("doc_id", "row_key", "hashes", F.inline("windows"))
        .select(
            "doc_id", "row_key", "length", "start",
            F.explode_outer(F.expr("slice(hashes, start + 1, length - 4)")).alias("h"),
        )
        .groupBy("doc_id", "row_key", "length", "start", "h")
        .agg(F.count("*").alias("weight"))
    )
    shingle_rows = written(shingle_rows, fresh_path(spark, "window-shingles"))
    window = ["doc_id", "row_key", "length", "start"]
    window_marks = _fingerprints(shingle_rows, window)
    item_marks = _fingerprints(weighted, ["item", "length"])
    near = (
        window_marks.select(*window, "fingerprint", F.inline(_block_keys(errors=False)))
        .join(
            item_marks.select("item", "length", F.col("fingerprint").alias("item_mark"), F.inline(_block_keys(errors=True))),
            ["length", "block", "value"],
        )
        .filter(F.bit_count(F.col("fingerprint").bitwiseXOR(F.col("item_mark"))) <= RADIUS)
        .select(*window, "item")
        .distinct()
    )
    asked = near.toDF("_doc", "_key", "_length", "_start", "item")
    rows = shingle_rows.join(
        asked, F.expr("doc_id <=> _doc and row_key = _key and length = _length and start = _start")
    ).select(*window, "item", "h", "weight")
    compared = (
        rows.join(weighted.select("item", "h", F.col("weight").alias("item_weight")), ["item", "h"], "left")
        .groupBy("item", *window)
        .agg(
            F.sum("weight").alias("size"),
            F.sum(F.least("weight", F.coalesce("item_weight", F.lit(0)))).alias("common"),
        )
        .withColumn("union", F.col("size") + F.col("length") - (SHINGLE - 1) - F.col("common"))
        .filter("100 * common >= 75 * union")
    )
    return (
        compared.join(items.select("item", "item_id"), "item")
        .groupBy("doc_id", "item_id")
        .agg(F.max(F.col("common") / F.col("union")).alias("similarity"))
    )


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """docs without the contaminated documents, with all columns.

    Rows that share the id of a contaminated one go with it; rows without an id stay.
    """
    leaks = contaminated(docs, benchmark).select(F.col("doc_id").alias("_leak")).filter("_leak is not null").distinct()
    return docs.join(written(leaks, fresh_path(docs.sparkSession, "leaks")), docs["doc_id"].cast("bigint") == F.col("_leak"), "left_anti")
