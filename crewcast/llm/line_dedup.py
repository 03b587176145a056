"""Removal of lines that repeat across documents.

Lines are exploded with a 128-bit hash of their normalised form, the documents of each hash are
counted, and the positions of the lines to drop are brought back to their documents, which are put
together again from the positions that stay.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from crewcast.sources.shared_storage import fresh_path, written

#: A line counts with at least so many code points, and goes when at least so many documents hold it.
LEAST_LENGTH, LEAST_DOCUMENTS = 20, 3

_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _two_hashes(value: Column) -> tuple[Column, Column]:
    return F.xxhash64(value), F.xxhash64(F.lit("second"), value)


def line_keys(docs: DataFrame, least_length: int = LEAST_LENGTH) -> DataFrame:
    """_doc, _t1, _t2 (the row, by its id and the hash of its text), _pos, _h1, _h2 of each line long enough.

    Rows of one id and one text have the same lines, so they may share their positions.
    """
    t1, t2 = _two_hashes(F.coalesce("text", F.lit("")))
    lower = F.translate(F.coalesce("text", F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    exploded = docs.select(
        F.col("doc_id").alias("_doc"), t1.alias("_t1"), t2.alias("_t2"), F.posexplode(_lines(lower)).alias("_pos", "_line")
    )
    key = F.btrim("_line", F.lit(_SPACES))
    h1, h2 = _two_hashes(F.col("_key"))
    return (
        exploded.select("_doc", "_t1", "_t2", "_pos", key.alias("_key"))
        .filter(F.char_length("_key") >= least_length)
        .select("_doc", "_t1", "_t2", "_pos", h1.alias("_h1"), h2.alias("_h2"))
    )


def without_repeated_lines(
    docs: DataFrame, least_length: int = LEAST_LENGTH, least_documents: int = LEAST_DOCUMENTS
) -> DataFrame:
    """All rows and columns of docs (doc_id, text, ...) with text as it is left, n_lines and n_dropped.

    A line is what stands between line feeds; its key is the line without white space (0x20,
    0x09-0x0D) at both ends, A-Z in lower case. A key of `least_length` code points and more that
    `least_documents` and more documents hold stays, with all its lines, only in the document with
    the largest doc_id that holds it; a tie between rows of one doc_id leaves both as they are.

    Null or empty text is one empty line and comes out empty. A text of any length is one row
    throughout. Rows that repeat a doc_id are one document when documents are counted and are each
    returned. Rows without doc_id count as one document, smaller than all others. An empty table
    gives an empty table. Other columns pass; n_lines and n_dropped of docs are replaced.

    Runs a job while it is built: the keys to drop are written, so that the join with the lines has
    a plain shuffle on both sides and a line that a third of all documents hold is split among tasks.
    """
    lines = line_keys(docs, least_length)
    # Distinct (line, document) first: a frequent line is spread over tasks by its documents.
    held = lines.groupBy("_h1", "_h2", "_doc").agg(F.lit(1).alias("_one"))
    repeated = written(
        held.groupBy("_h1", "_h2")
        .agg(F.count("*").alias("_documents"), F.max("_doc").alias("_last"))
        .filter(F.col("_documents") >= least_documents)
        .select("_h1", "_h2", "_last"),
        fresh_path(docs.sparkSession, "repeated-lines"),
    )
    gone = (
        lines.join(repeated, ["_h1", "_h2"])
        .filter(~F.col("_doc").eqNullSafe(F.col("_last")))
        .groupBy("_doc", "_t1", "_t2")
        .agg(F.collect_set("_pos").alias("_gone"))
    )
    passed = [F.col(f"d.`{c}`") for c in docs.columns if c not in ("n_lines", "n_dropped")]
    t1, t2 = _two_hashes(F.coalesce("text", F.lit("")))
    rows = docs.withColumns({"_row1": t1, "_row2": t2}).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("g._doc")) & (F.col("_row1") == F.col("_t1")) & (F.col("_row2") == F.col("_t2"))
    cut = _lines(F.col("d.text"))
    kept = F.array_except(F.sequence(F.lit(0), F.size("_lines") - 1), "_gone")
    text = F.when(F.col("_gone").isNull(), F.coalesce("text", F.lit(""))).otherwise(
        F.array_join(F.transform(kept, lambda n: F.get("_lines", n)), "\n")
    )
    return (
        rows.join(gone.alias("g"), same, "left")
        .select(*passed, "_gone", cut.alias("_lines"))
        .withColumns(
            {
                "text": text,
                "n_lines": F.size("_lines").cast("bigint"),
                "n_dropped": F.coalesce(F.size("_gone"), F.lit(0)).cast("bigint"),
            }
        )
        .drop("_gone", "_lines")
    )


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the text that is left."""
    return without_repeated_lines(docs.select("doc_id", "text")).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256")
    )
