"""Quality rules: simple counts, then a log-likelihood ratio of hashed n-grams. DataFrame
functions only.

Words and word pairs are hashed to BUCKETS. Two multinomials are counted over them: one of the
trusted target (texts labelled good) and one of the whole raw corpus. A text's ratio is the mean,
over its n-grams, of log(target share / raw share): how much more its n-grams belong to the
target than to the corpus, whatever its length. Every text is judged by one fixed threshold.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.llm.words import WORD_GAP

BUCKETS = 1 << 14
#: Mean log ratio from which a text is kept.
LEAST_RATIO = -0.12
# Fixed values of the base rules.
LEAST_WORDS, MOST_REPEATED = 10, 20
_BLANKS = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"


def _arrays(docs: DataFrame, *columns: str) -> DataFrame:
    """columns, words and the hash of each word.

    The word list is a column of its own that later steps refer to more than once, so the text is
    split once. No filter may be put on what follows: it would be moved below and split anew.
    """
    text = F.coalesce("text", F.lit(""))
    words = docs.select(*columns, text.alias("text"), F.array_remove(F.split(text, WORD_GAP), "").alias("words"))
    return words.withColumn("hashes", F.transform("words", lambda w: F.xxhash64(w)))


def _grams() -> Column:
    """Buckets of all words and word pairs of `hashes`."""
    return F.expr(
        f"concat(transform(hashes, h -> cast(h & {BUCKETS - 1}L as int)),"
        f" if(size(hashes) < 2, array(), transform(sequence(0, size(hashes) - 2),"
        f" i -> cast(xxhash64(hashes[i], hashes[i + 1]) & {BUCKETS - 1}L as int))))"
    )


def _gram_counts(docs: DataFrame) -> np.ndarray:
    """Occurrences per bucket over all texts; counts start at one."""
    rows = (
        _arrays(docs)
        .select(F.explode(_grams()).alias("bucket"))
        .groupBy("bucket")
        .agg(F.count("*").alias("n"))
        .collect()
    )
    counts = np.ones(BUCKETS)
    for row in rows:
        counts[row["bucket"]] += row["n"]
    return counts


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are labelled good.

    Only documents with an id meet the labels. The ids grow with the texts, so they are never
    sent to all tasks: the texts are shuffled once, at any size.
    """
    trusted = labels.filter("quality = 1 and doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(trusted.hint("merge"), "doc_id", "left_semi")


def gram_weights(docs: DataFrame, labels: DataFrame) -> np.ndarray:
    """log(target share / raw share) per bucket, over all documents and all trusted ones."""
    raw, target = _gram_counts(docs), _gram_counts(trusted_texts(docs, labels))
    return np.log(target / target.sum()) - np.log(raw / raw.sum())


def _repeated_words() -> Column:
    """Words inside five-word windows (hashes `windows`, sorted with their places in `placed`)."""
    twice = F.filter(
        F.col("placed"),
        lambda x, i: (F.get("placed", i - 1)["h"] == x["h"]) | (F.get("placed", i + 1)["h"] == x["h"]),
    )
    return F.transform(twice, lambda x: x["at"])


def quality_rules(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, ratio.

    A null text counts as empty; texts without words fail the base rules and have ratio 0. Rows
    with a null doc_id and repeated rows are judged like any other. Without trusted texts the
    target is flat and only the base rules decide much. Other columns are ignored. Runs jobs
    while it is built.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), "quality")
    weights = F.lit(gram_weights(docs, labels))
    lines = F.filter(F.split("text", "\n"), lambda line: F.translate(line, _BLANKS, "") != "")
    window = ", ".join(f"hashes[i + {n}]" for n in range(5))
    counted = _arrays(docs, "doc_id").select(
        "doc_id",
        F.size("words").cast("bigint").alias("n_words"),
        F.length(F.translate("text", _BLANKS, "")).cast("bigint").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", _SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        lines.alias("lines"),
        F.expr(f"if(size(hashes) < 5, array(), transform(sequence(0, size(hashes) - 5), i -> xxhash64({window})))").alias("windows"),
        _grams().alias("grams"),
    )
    summed = F.aggregate("grams", F.lit(0.0), lambda total, g: total + F.get(weights, g))
    reduced = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.when(F.size("grams") > 0, F.round(summed / F.size("grams"), 9)).otherwise(0.0).alias("ratio"),
        # Most texts repeat no window: only the others are sorted.
        F.when(
            F.size(F.array_distinct("windows")) < F.size("windows"),
            F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))),
        ).alias("placed"),
    )
    places = reduced.withColumn("places", F.sort_array(_repeated_words())).withColumn(
        # A window covers five words, less where the next one starts earlier.
        "n_repeat_words",
        F.coalesce(
            F.aggregate(
                F.transform("places", lambda at, i: F.least(F.lit(5), F.coalesce(F.get("places", i + 1) - at, F.lit(5)))),
                F.lit(0),
                lambda total, n: total + n,
            ),
            F.lit(0),
        ).cast("bigint"),
    )
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return places.withColumn("base_failed", failed).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("ratio") >= LEAST_RATIO)).alias("kept"),
        "ratio",
    )
