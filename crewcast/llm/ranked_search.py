"""Ranked lexical search by dense blocked matrix products.

A block of items becomes a matrix of word weights, a tile of documents a matrix of word impacts;
their product holds the scores. Weights and impacts are whole numbers in 64-bit floats, and a
product covers so many words that no partial sum reaches 2**53, so BLAS adds them without error
in any order; the products of all word tiles are added as 64-bit integers. Only the best rows of
every task are shuffled.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F

from crewcast.llm.words import binary_column, slices
from crewcast.sources.shared_storage import fresh_path, written

TOP = 20
#: Items x distinct words and bytes of words of a block, documents and words of a tile, at most.
#: They bound the memory of tasks and driver and have no influence on results.
BLOCK_CELLS, BLOCK_BYTES = 4 << 20, 8 << 20
TILE_DOCUMENTS, TILE_WORDS = 512, 4096
#: Whole numbers below this are exact in 64-bit floats.
EXACT = 1 << 53
#: An impact is below (10**9 * tf) / (1000 * tf).
MOST_IMPACT = 10**6

# Terms are runs of ASCII letters and digits and of all bytes above 0x7F; the rest becomes a space.
_TABLE = bytes(
    c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)


def terms(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def _counted(docs: DataFrame, words: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the whole text), ids and tfs of those among `words`; rows without terms are left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = {w: n for n, w in enumerate(words)}
        known = number.keys()
        for batch in batches:
            for part in slices(batch, "text"):
                kept, n, ids, tfs = [], [], [], []
                for row, text in enumerate(binary_column(part, "text")):
                    found = terms(text)
                    if not found:
                        continue
                    counts = Counter(found)
                    shared = counts.keys() & known
                    kept.append(row)
                    n.append(len(found))
                    ids.append([number[w] for w in shared])
                    tfs.append([counts[w] for w in shared])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(part.schema.get_field_index("doc_id")).take(pa.array(kept, pa.int64())),
                        pa.array(n, pa.int64()),
                        pa.array(ids, pa.list_(pa.int32())),
                        pa.array(tfs, pa.list_(pa.int32())),
                    ],
                    ["doc_id", "n", "ids", "tfs"],
                )

    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return texts.mapInArrow(count, "doc_id bigint, n bigint, ids array<int>, tfs array<int>")


def _word_tiles(weights: np.ndarray, counts: list[Counter]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(word numbers; column, item, weight of each entry) with every item's sum of weight x impact below EXACT.

    A word that reaches the bound alone is dealt over several tiles.
    """
    room = EXACT // MOST_IMPACT
    left = [(word, item, int(weights[word]) * times) for item, held in enumerate(counts) for word, times in held.items()]
    left = [entry for entry in sorted(left) if entry[2]]
    tiles = []
    while left:
        filled, columns, entries, later = Counter(), {}, [], []
        for word, item, weight in left:
            take = min(weight, room - 1 - filled[item]) if word in columns or len(columns) < TILE_WORDS else 0
            if take:
                entries.append((columns.setdefault(word, len(columns)), item, take))
                filled[item] += take
            if take < weight:
                later.append((word, item, weight - take))
        tiles.append((np.fromiter(columns, np.int64, len(columns)), np.array(entries, np.int64)))
        left = later
    return tiles


def _dense(words: np.ndarray, entries: np.ndarray, items: int) -> np.ndarray:
    """The words x items matrix of a tile."""
    tile = np.zeros((len(words), items))
    tile[entries[:, 0], entries[:, 1]] = entries[:, 2]
    return tile


class _Leaders:
    """The best (score down, doc_id up, null ids last) documents of each item so far."""

    def __init__(self, items: int, top: int):
        self.top, self.border = top, np.ones(items, np.int64)
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.pending = 0

    def add(self, scores: np.ndarray, ids: np.ndarray, missing: np.ndarray) -> None:
        """scores: documents x items. What equals the border stays until ids decide."""
        rows, cols = np.nonzero(scores >= self.border)
        self.parts.append((cols, scores[rows, cols], ids[rows], missing[rows]))
        self.pending += len(rows)
        if self.pending > 500_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        cols, scores, ids, missing = (np.concatenate(c) for c in zip(*self.parts, strict=True))
        order = np.lexsort((ids, missing, -scores, cols))
        cols, scores, ids, missing = cols[order], scores[order], ids[order], missing[order]
        place = np.arange(len(cols)) - np.searchsorted(cols, cols)
        last = place == self.top - 1
        self.border[cols[last]] = scores[last]
        kept = place < self.top
        self.parts = [(cols[kept], scores[kept], ids[kept], missing[kept])]
        self.pending = int(kept.sum())
        return self.parts[0]


def _scored(counted: DataFrame, block: list[Row], tiles, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """_item, doc_id, score of the best documents of every task."""
    numbers = [int(r["_item"]) for r in block]

    def impacts(n: np.ndarray, tfs: np.ndarray) -> np.ndarray:
        # Python's integers where 25 * n * N might not fit 64 bits.
        lengths, rows = np.unique(n, return_inverse=True)
        m = np.array([75 + (25 * int(x) * n_docs) // n_terms for x in lengths], np.int64)[rows]
        return (10**9 * tfs) // (1000 * tfs + 12 * m)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = _Leaders(len(numbers), top)
        size = 1 + max((int(words.max()) for words, _ in tiles), default=0)
        column = np.full(size, -1, np.int64)
        dense = [(words, _dense(words, entries, len(numbers))) for words, entries in tiles]
        for batch in batches:
            for start in range(0, batch.num_rows, TILE_DOCUMENTS):
                part = batch.slice(start, TILE_DOCUMENTS)
                ids_of, n, words, tfs = (part.column(part.schema.get_field_index(c)) for c in ("doc_id", "n", "ids", "tfs"))
                rows = np.repeat(np.arange(part.num_rows), words.value_lengths().to_numpy())
                word = words.flatten().to_numpy()
                tf = tfs.flatten().to_numpy().astype(np.int64)
                value = impacts(n.to_numpy()[rows], tf)
                total = np.zeros((part.num_rows, len(numbers)), np.int64)
                for known, weights in dense:
                    # Compact: only the words that this tile of documents holds.
                    column[known] = np.arange(len(known))
                    inside = np.flatnonzero((word < size) & (column[np.minimum(word, size - 1)] >= 0))
                    present, where = np.unique(column[word[inside]], return_inverse=True)
                    held = np.zeros((part.num_rows, len(present)))
                    held[rows[inside], where] = value[inside]
                    total += (held @ weights[present]).astype(np.int64)
                    column[known] = -1
                missing = ids_of.is_null().to_numpy(zero_copy_only=False)
                leaders.add(total, ids_of.fill_null(0).to_numpy(), missing)
        if leaders.parts:
            cols, scores, ids, missing = leaders.cut()
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.array(numbers, np.int64)[cols]),
                    pa.array(ids.astype(np.int64), pa.int64(), mask=missing),
                    pa.array(scores),
                ],
                ["_item", "doc_id", "score"],
            )

    return counted.mapInArrow(score, "_item bigint, doc_id bigint, score bigint")


def _blocks(items: DataFrame) -> Iterator[tuple[list[Row], list[bytes], list[Counter]]]:
    """Items with their distinct words and word counts, in blocks of bounded cells and bytes (one item at least)."""

    def ready(block):
        rows, held = zip(*block, strict=True)
        words = sorted({w for counts in held for w in counts})
        number = {w: n for n, w in enumerate(words)}
        return list(rows), words, [Counter({number[w]: c for w, c in counts.items()}) for counts in held]

    block, words, size = [], set(), 0
    for row in items.toLocalIterator():
        counts = Counter(terms(row["text"].encode()))
        more = sum(map(len, counts))
        full = (len(block) + 1) * len(words | counts.keys()) > BLOCK_CELLS or size + more > BLOCK_BYTES
        if block and full:
            yield ready(block)
            block, words, size = [], set(), 0
        block.append((row, counts))
        words |= counts.keys()
        size += more
    if block:
        yield ready(block)


def ranked_documents(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the `top` documents with the highest scores above 0 per item.

    docs: doc_id (a whole number), text; items: item_id, text; other columns are not read. Terms
    are maximal runs of ASCII letters, digits and characters above 0x7F, with A-Z in lower case.
    N counts the documents with a term, L their terms with repeats, n those of one document, df
    the documents that hold a term, tf its occurrences in one. A term of an item adds, for each
    time the item has it, floor(1000 * ln((2N + 2) / (2df + 1))) times the whole part of
    1e9 tf / (1000 tf + 12 m), m = 75 + the whole part of 25 n N / L. Equal scores go by doc_id,
    rows without an id last.

    Null and empty texts have no terms; such documents are in no count and never found, such items
    find nothing. Rows that repeat a doc_id are documents of their own. Items that agree in id and
    text count once; one id with several texts gives one ranking for each. A text of any length is
    one row. Empty tables give an empty table.

    Items pass the driver in blocks of at most BLOCK_CELLS items x words and BLOCK_BYTES. Per block,
    all documents are scanned once for their counts of the block's words, which are written and
    read again for the scores. Runs jobs while it is built.
    """
    spark = docs.sparkSession
    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("text")).distinct()
    distinct = written(texts.withColumn("_item", F.monotonically_increasing_id()), fresh_path(spark, "items"))
    found = fresh_path(spark, "ranked")
    schema = "_item bigint, doc_id bigint, score bigint"
    spark.createDataFrame([], schema).write.parquet(found)
    for block, words, held in _blocks(distinct):
        counted = written(_counted(docs, words), fresh_path(spark, "counted"))
        n_docs, n_terms = counted.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        if not words or not n_docs:
            continue
        df = F.count("*")
        # One row for each word of the block, whose number is bounded.
        shares = F.floor(1000 * F.log(F.lit(2.0 * n_docs + 2) / (2 * df + 1)))
        weights = np.zeros(len(words), np.int64)
        for row in counted.select(F.explode("ids").alias("id")).groupBy("id").agg(shares.alias("w")).collect():
            weights[row["id"]] = row["w"]
        tiles = _word_tiles(weights, held)
        if tiles:
            best = _best(_scored(counted, block, tiles, n_docs, n_terms, top), top)
            best.drop("rank").write.mode("append").parquet(found)
    ranked = _best(spark.read.schema(schema).parquet(found), top)
    return ranked.join(distinct.select("_item", "item_id"), "_item").select("item_id", "rank", "doc_id", "score")


def _best(scored: DataFrame, top: int) -> DataFrame:
    order = Window.partitionBy("_item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)
