"""Fixed-size text chunks with overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crewcast.operators.numbering import ROWS_PER_RANGE, join_totals, order_ranges, split_by_size


def check_chunking(chunk_size: int, overlap: int) -> None:
    if chunk_size <= 0:
        raise ValueError("chunk_size must be positive.")
    if overlap < 0 or overlap >= chunk_size:
        raise ValueError("overlap must be between 0 and chunk_size - 1.")


def chunk_count(length: Column, chunk_size: int, overlap: int) -> Column:
    """0 for an empty text; otherwise the last chunk is the first that reaches the end."""
    step = chunk_size - overlap
    beyond_first = F.greatest(length - chunk_size, F.lit(0))
    return F.when(length > 0, F.ceil(beyond_first / step) + 1).otherwise(F.lit(0)).cast("int")


def chunk_rows(
    df: DataFrame, text: str, *, chunk_size: int = 1200, overlap: int = 150
) -> DataFrame:
    """One row per chunk: the other columns, chunk_number from 1, chunk. A map-only step."""
    check_chunking(chunk_size, overlap)
    step = chunk_size - overlap
    others = [f"`{c}`" for c in df.columns if c != text]
    count = chunk_count(F.length(F.col(text)), chunk_size, overlap)
    return (
        df.withColumn("_count", count)
        .filter(F.col("_count") > 0)
        .select("*", F.explode(F.sequence(F.lit(1), F.col("_count"))).alias("chunk_number"))
        .select(
            *others,
            "chunk_number",
            F.substring(
                F.col(text), (F.col("chunk_number") - 1) * F.lit(step) + 1, F.lit(chunk_size)
            ).alias("chunk"),
        )
    )


def assemble_chunks(
    pieces: DataFrame,
    keys: list[str],
    order: str,
    piece: str,
    prefix: Column,
    *,
    chunk_size: int,
    overlap: int,
    rows_per_range: int = ROWS_PER_RANGE,
) -> DataFrame:
    """Chunks of prefix + pieces put together in order, per key.

    The whole text is never built. Each piece gets its offset in the text, is copied to the chunks it
    touches, and each chunk gathers only its own few thousand characters. Keys of at most
    `rows_per_range` pieces take one running sum, and their chunks are gathered where the pieces
    lie. The pieces of larger keys are spread over many tasks: their sums have two levels, inside
    ranges of the key's order and over these ranges. `order` is a bigint, unique per key; equal
    values are put in the order of their text, null ones first. `prefix` is an expression over the
    keys.

    The pieces are read several times: give a table that is stored or made by little work. Pieces
    that lie by some of the keys stay there.
    """
    check_chunking(chunk_size, overlap)
    small, large = split_by_size(pieces, keys, rows_per_range)
    length = F.length("_piece").cast("bigint")
    own = Window.partitionBy(*keys).orderBy(order, "_piece")
    nth, up_to = F.row_number().over(own), F.sum(length).over(own.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    summed = small.select(*keys, order, F.col(piece).alias("_piece")).select(*keys, "_piece", nth.alias("_nth"), up_to.alias("_up_to"))
    start = F.when(F.col("_nth") == 1, 0).otherwise(F.length(prefix) + F.col("_up_to") - length)
    headed = F.when(F.col("_nth") == 1, F.concat(prefix, F.coalesce("_piece", F.lit("")))).otherwise(F.col("_piece"))
    placed = summed.select(*keys, start.cast("bigint").alias("_start"), headed.alias("_piece")).withColumn("_length", length)
    chunks = _gathered(placed, keys, chunk_size, overlap)
    if large is None:
        return chunks
    return chunks.unionByName(_gathered(_placed_by_ranges(large, keys, order, piece, prefix), keys, chunk_size, overlap))


def _placed_by_ranges(pieces: DataFrame, keys: list[str], order: str, piece: str, prefix: Column) -> DataFrame:
    """keys, _piece, _length, _start of the pieces of large keys, prefixes included."""
    sized = order_ranges(pieces, keys, order, "_range", ties=[piece]).select(
        *keys,
        order,
        "_range",
        F.col(piece).alias("_piece"),
        F.length(F.col(piece)).cast("bigint").alias("_length"),
    )
    over_ranges = Window.partitionBy(*keys).orderBy("_range")
    in_range = (
        Window.partitionBy(*keys, "_range")
        .orderBy(order, "_piece")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    ranges = (
        sized.groupBy(*keys, "_range")
        .agg(F.sum("_length").alias("_range_length"))
        .select(
            *keys,
            "_range",
            (F.sum("_range_length").over(over_ranges) - F.col("_range_length")).alias("_before"),
            F.row_number().over(over_ranges).alias("_nth"),
        )
    )
    prefix_length = F.length(prefix).cast("bigint")
    before = prefix_length + F.col("_before") + F.sum("_length").over(in_range)
    body = join_totals(sized, ranges, [*keys, "_range"], ["_before"]).select(
        *keys, "_piece", "_length", (before - F.col("_length")).alias("_start")
    )
    head = ranges.filter(F.col("_nth") == 1).select(
        *keys,
        prefix.alias("_piece"),
        prefix_length.alias("_length"),
        F.lit(0).cast("bigint").alias("_start"),
    )
    return head.unionByName(body)


def _gathered(placed: DataFrame, keys: list[str], chunk_size: int, overlap: int) -> DataFrame:
    """keys, chunk_number, chunk of placed pieces (keys, _piece, _length, _start)."""
    step = chunk_size - overlap
    placed = placed.filter(F.col("_length") > 0)
    # Chunk n covers the characters [n * step, n * step + chunk_size).
    start, end = F.col("_start"), F.col("_start") + F.col("_length")
    first = F.greatest(F.floor((start - chunk_size) / step) + 1, F.lit(0)).cast("bigint")
    last = F.floor((end - 1) / step).cast("bigint")
    copies = placed.select(
        *keys, "_start", "_piece", "_length", F.explode(F.sequence(first, last)).alias("_chunk")
    )
    chunk_start = F.col("_chunk") * step
    from_char = F.greatest(chunk_start - start, F.lit(0))
    to_char = F.least(chunk_start + chunk_size - start, F.col("_length"))
    cut = F.substring("_piece", (from_char + 1).cast("int"), (to_char - from_char).cast("int"))
    parts = F.sort_array(F.collect_list(F.struct("_start", cut.alias("_text"))))
    return (
        copies.groupBy(*keys, "_chunk")
        .agg(F.array_join(parts["_text"], "").alias("chunk"))
        # A chunk that would hold nothing but the overlap with the one before does not exist.
        .filter((F.col("_chunk") == 0) | (F.length("chunk") > overlap))
        .select(*keys, (F.col("_chunk") + 1).cast("int").alias("chunk_number"), "chunk")
    )
