"""Batch retrieval: a table of queries against a table of documents.

Documents are not moved or copied to meet queries; only a table of fewer files than cores is dealt
out first. The queries pass the driver in scans of bounded rows and bytes, cut into blocks; a scan
travels to all tasks, every document is read once for it and scored where it lies, block by block,
and only the best rows per task and query are shuffled. With more than one scan each scan's
result is written to shared storage before the next one starts, so neither the driver nor a task
ever holds more than one scan. A table of any size takes the same way.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping
from itertools import chain
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from crewcast.functions.numbers import round_binary
from crewcast.functions.text import simple_name_key, strip, whitespace_words
from crewcast.operators.filters import equality_filter
from crewcast.operators.spreading import spread_few
from crewcast.sources.shared_storage import fresh_path

try:  # finds all words in one pass over a text; without it each word is searched by itself
    import ahocorasick
except ImportError:
    ahocorasick = None

DEFAULT_TOP_K = 30
RRF_CONSTANT = 60

# Queries that share a scan of the documents: rows, and bytes of their words or vectors, at most
# (one query at least). A block, the queries that are scored together, has no more rows.
BLOCK_ROWS, BLOCK_BYTES = 2_000, 8 << 20
SCORES_AT_ONCE = 500_000
#: The number of the block of a scored pair, in its scan.
BLOCK = "_block"


def _check_top_k(top_k: int | None) -> None:
    if top_k is not None and top_k < 1:
        raise ValueError("top_k must be greater than zero or None.")


def top_per_query(scored: DataFrame, top_k: int | None) -> DataFrame:
    """The first top_k per query by score, ties by id, with their rank.

    The limit on row_number lets Spark cut every task's rows to top_k per query before the
    shuffle, so a query that matches everything is never gathered whole. Without a limit the
    rows are only sorted, over all tasks, and carry no rank. Queries of different blocks are
    ranked apart, even under one id.
    """
    if top_k is None:
        return scored.drop(BLOCK).orderBy("query_id", F.col("score").desc(), "id")
    own = [c for c in (BLOCK, "query_id") if c in scored.columns]
    order = Window.partitionBy(*own).orderBy(F.col("score").desc(), F.col("id").asc())
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top_k).drop(BLOCK)


def query_terms(queries: DataFrame) -> DataFrame:
    terms = F.array_distinct(whitespace_words(F.lower("query")))
    return queries.select("query_id", terms.alias("terms"))


def haystack(title: str = "title", content: str = "content", name: str = "consultant_name") -> Column:
    parts = [F.coalesce(F.col(c), F.lit("")) for c in (title, content, name)]
    return F.lower(F.concat_ws(" ", *parts))


class _Best:
    """The k best (score down, id up) documents of each query among those seen so far."""

    def __init__(self, query_ids: list, k: int | None, minimum: float = -np.inf, block: int | None = None):
        self.block = block
        self.query_ids = np.array(query_ids, dtype=object)
        self.k = k
        self.border = np.full(len(query_ids), minimum, dtype=np.float64)
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.pending = 0

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        """scores: documents × queries. Only scores that can still be among the best are kept."""
        rows, cols = np.nonzero(scores >= self.border)
        self.parts.append((cols, scores[rows, cols], ids[rows]))
        self.pending += len(rows)
        if self.k is not None and self.pending > SCORES_AT_ONCE:
            self.compact()

    def compact(self) -> None:
        if not self.parts:
            return
        cols, scores, ids = (np.concatenate(column) for column in zip(*self.parts))
        if self.k is not None:
            order = np.lexsort((ids, -scores, cols))
            cols, scores, ids = cols[order], scores[order], ids[order]
            nth = np.arange(len(cols)) - np.searchsorted(cols, cols)
            full = nth == self.k - 1
            self.border[cols[full]] = np.maximum(self.border[cols[full]], scores[full])
            kept = nth < self.k
            cols, scores, ids = cols[kept], scores[kept], ids[kept]
        self.parts, self.pending = [(cols, scores, ids)], len(cols)

    def rows(self) -> pd.DataFrame:
        self.compact()
        if not self.parts:
            return pd.DataFrame({"query_id": [], "id": [], "score": []})
        cols, scores, ids = self.parts.pop()
        self.pending = 0
        found = pd.DataFrame({"query_id": self.query_ids[cols], "id": ids, "score": scores})
        return found if self.block is None else found.assign(**{BLOCK: self.block})

    def frames(self) -> Iterator[pd.DataFrame]:
        """The rows as one frame, or nothing when there are none."""
        rows = self.rows()
        if len(rows):
            yield rows


def _slices(count: int, queries: int) -> Iterator[slice]:
    size = max(1, SCORES_AT_ONCE // max(queries, 1))
    for start in range(0, count, size):
        yield slice(start, start + size)


class _Vocabulary:
    """Counts, for one text, how many of each query's words occur in it."""

    def __init__(self, term_lists: list[list[str]]):
        self.terms = sorted({t for words in term_lists for t in words})
        position = {t: n for n, t in enumerate(self.terms)}
        held: list[list[int]] = [[] for _ in self.terms]
        for n, words in enumerate(term_lists):
            for t in set(words):
                held[position[t]].append(n)
        self.holders = [np.array(queries, dtype=np.int64) for queries in held]
        self.queries = len(term_lists)
        self.automaton = None
        if ahocorasick is not None and self.terms:
            self.automaton = ahocorasick.Automaton()
            for t, n in position.items():
                self.automaton.add_word(t, n)
            self.automaton.make_automaton()

    def scores(self, text: str) -> np.ndarray:
        if self.automaton is not None:
            found = list({n for _, n in self.automaton.iter(text)})
        else:
            found = [n for n, t in enumerate(self.terms) if t in text]
        if not found:
            return np.zeros(self.queries, dtype=np.int32)
        holders = np.concatenate([self.holders[n] for n in found])
        return np.bincount(holders, minlength=self.queries).astype(np.int32)


def _score_schema(queries: DataFrame, documents: DataFrame, score: T.DataType) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", documents.schema["id"].dataType),
            T.StructField("score", score),
            T.StructField(BLOCK, T.LongType()),
        ]
    )


def _scans(queries: DataFrame, bytes_of: Callable[[Row], int], block_rows: int) -> Iterator[list[list[Row]]]:
    """The rows of queries in blocks, and these in scans of bounded size.

    They are fetched one input partition at a time. A scan holds a block at least.
    """
    scan: list[list[Row]] = []
    rows = size = 0
    for block, more in _blocks(queries, bytes_of, block_rows):
        if scan and (rows + len(block) > BLOCK_ROWS or size + more > BLOCK_BYTES):
            yield scan
            scan, rows, size = [], 0, 0
        scan.append(block)
        rows, size = rows + len(block), size + more
    if scan:
        yield scan


def _blocks(queries: DataFrame, bytes_of: Callable[[Row], int], most_rows: int) -> Iterator[tuple[list[Row], int]]:
    """The rows of queries in blocks of bounded size, each with its bytes."""
    block: list[Row] = []
    size = 0
    for row in queries.toLocalIterator():
        more = bytes_of(row)
        if block and (len(block) >= most_rows or size + more > BLOCK_BYTES):
            yield block, size
            block, size = [], 0
        block.append(row)
        size += more
    if block:
        yield block, size


def _over_scans(scans: Iterator[list[list[Row]]], answer: Callable[[list[list[Row]]], DataFrame]) -> DataFrame:
    """The answers of all scans. An answer is complete for its queries, so they only add up."""
    first = next(scans, [])
    second = next(scans, None)
    one = answer(first)
    if second is None:
        return one
    path = fresh_path(one.sparkSession, "answers")
    one.write.parquet(path)
    for scan in chain([second], scans):
        answer(scan).write.mode("append").parquet(path)
    return one.sparkSession.read.schema(one.schema).parquet(path)


def _best_of(scan: list[list[Row]], k: int | None, minimum: float = -np.inf) -> list[tuple[slice, _Best]]:
    """The best of each block of a scan, with the block's place among the scan's queries."""
    ends = np.cumsum([0, *map(len, scan)]).tolist()
    held = [_Best([r["query_id"] for r in block], k, minimum, n) for n, block in enumerate(scan)]
    return [(slice(start, end), own) for start, end, own in zip(ends, ends[1:], held)]


def _word_frames(
    batches: Iterator[pd.DataFrame],
    query_ids: list,
    term_lists: list[list[str]],
    top_k: int | None,
    best: list[tuple[slice, _Best]] | None = None,
) -> Iterator[pd.DataFrame]:
    """The matching pairs of the batches: all, in frames of bounded size, or the top_k per query at the end.

    A text is searched once for the words of all blocks.
    """
    vocabulary = _Vocabulary(term_lists)
    best = best or [(slice(None), _Best(query_ids, top_k, minimum=1))]
    for batch in batches:
        ids, found = batch["id"].to_numpy(), batch["text"].to_numpy()
        for part in _slices(len(ids), len(query_ids)):
            scores = np.stack([vocabulary.scores(t) for t in found[part]])
            for block, own in best:
                own.add(scores[:, block], ids[part])
                if top_k is None:  # a batch's pairs are never held together
                    yield from own.frames()
    for _, own in best:
        yield from own.frames()


def _score_words(texts: DataFrame, scan: list[list[Row]], top_k: int | None, schema: T.StructType) -> DataFrame:
    """A scan's queries go to every task; a task returns its top_k per query.

    Counting inside the task keeps the (query, document) pairs off the network: common words
    make almost every document match almost every query.
    """
    rows = list(chain.from_iterable(scan))
    query_ids, term_lists = [r["query_id"] for r in rows], [list(r["terms"] or ()) for r in rows]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _word_frames(batches, query_ids, term_lists, top_k, _best_of(scan, top_k, minimum=1))

    return spread_few(texts).mapInPandas(score, schema)


def keyword_search(
    documents: DataFrame,
    queries: DataFrame,
    *,
    top_k: int | None = None,
    filters: Mapping[str, Any] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """query_id, id, score (and rank, with top_k) of the documents with any of the query's words.

    The score is the number of distinct query words found anywhere in the document. Reads the
    queries while it is built.
    """
    _check_top_k(top_k)
    kept = documents.filter(equality_filter(documents, filters)) if filters else documents
    terms = query_terms(queries)
    texts = kept.select("id", haystack().alias("text"))
    schema = _score_schema(terms, texts, T.IntegerType())
    scans = _scans(terms, lambda r: sum(len(t) + 64 for t in r["terms"] or ()), block_rows)
    found = _over_scans(scans, lambda scan: top_per_query(_score_words(texts, scan, top_k, schema), top_k))
    # Written scans are sorted each by itself.
    return found if top_k is not None else top_per_query(found, None)


def _unit_rows(vectors: pd.Series, dimensions: int) -> np.ndarray:
    lengths = vectors.map(len)
    if len(lengths) and (lengths != dimensions).any():
        raise ValueError(f"expected vectors of {dimensions} numbers, got {sorted(set(lengths))}")
    rows = np.array(vectors.tolist(), dtype=np.float64).reshape(len(vectors), dimensions)
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _add_similarities(best: list[tuple[slice, _Best]], units: np.ndarray, batch: pd.DataFrame) -> None:
    """Scores of the batch against all vectors, added to what each block of them holds."""
    ids = batch["id"].to_numpy()
    for part in _slices(len(ids), len(units)):
        rows = _unit_rows(batch["content_vector"].iloc[part], units.shape[1])
        scores = np.rint(rows @ units.T * 1e6) / 1e6 + 0.0
        for block, own in best:
            own.add(scores[:, block], ids[part])


def vector_search(
    documents: DataFrame,
    queries: DataFrame,
    *,
    dimensions: int,
    top_k: int | None = None,
    filters: Mapping[str, Any] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Exact cosine neighbours: query_id, id, score (six places), rank.

    Returns at least 30 neighbours per query where there are that many. Reads the queries while
    it is built.
    """
    _check_top_k(top_k)
    k = max(top_k or DEFAULT_TOP_K, DEFAULT_TOP_K)
    kept = documents.filter(equality_filter(documents, filters)) if filters else documents
    vectors = kept.select("id", "content_vector").filter(F.col("content_vector").isNotNull())
    wanted = queries.select("query_id", "query_vector").filter(F.col("query_vector").isNotNull())
    schema = _score_schema(wanted, vectors, T.DoubleType())
    scans = _scans(wanted, lambda r: 8 * len(r["query_vector"]), block_rows)
    return _over_scans(scans, lambda scan: top_per_query(_score_vectors(vectors, scan, dimensions, k, schema), k))


def _score_vectors(
    vectors: DataFrame, scan: list[list[Row]], dimensions: int, k: int, schema: T.StructType
) -> DataFrame:
    """A scan's queries go to every task; a task returns its k best per query."""
    units = _unit_rows(pd.Series([r["query_vector"] for r in chain.from_iterable(scan)], dtype=object), dimensions)

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        best = _best_of(scan, k)
        for batch in batches:
            _add_similarities(best, units, batch)
        for _, own in best:
            yield from own.frames()

    return spread_few(vectors).mapInPandas(nearest, schema)


def hybrid_search(
    documents: DataFrame,
    queries: DataFrame,
    *,
    dimensions: int,
    top_k: int | None = None,
    filters: Mapping[str, Any] | None = None,
) -> DataFrame:
    """Keyword and vector ranks fused by reciprocal rank (constant 60)."""
    _check_top_k(top_k)
    limit = top_k or DEFAULT_TOP_K
    depth = max(limit, DEFAULT_TOP_K)
    by_word = keyword_search(documents, queries, top_k=depth, filters=filters)
    by_vector = vector_search(
        documents, queries, dimensions=dimensions, top_k=depth, filters=filters
    )
    share = F.lit(1.0) / (F.col("rank") + RRF_CONSTANT)
    fused = (
        by_word.select("query_id", "id", share.alias("share"))
        .unionByName(by_vector.select("query_id", "id", share.alias("share")))
        .groupBy("query_id", "id")
        .agg(round_binary(F.sum("share"), 6).alias("score"))
    )
    return top_per_query(fused, limit)


def best_per_person(hits: DataFrame) -> DataFrame:
    """One hit per query and person: the highest score, the earlier rank on a tie.

    A person is known by consultant_id, else by name; a hit without either stands for itself.
    position is the rank at which the person first appeared.
    """
    person_id = F.col("consultant_id") if "consultant_id" in hits.columns else F.lit(None).cast("string")
    name = simple_name_key(F.coalesce(F.col("consultant_name"), F.lit("")))
    key = (
        F.when(F.coalesce(strip(person_id), F.lit("")) != "", F.concat(F.lit("id:"), person_id))
        .when(name != "", F.concat(F.lit("name:"), name))
        .otherwise(F.concat(F.lit("document:"), F.col("id").cast("string")))
    )
    merit = F.struct(F.coalesce(F.col("score").cast("double"), F.lit(0.0)), -F.col("rank"))
    columns = [c for c in hits.columns if c != "query_id"]
    return (
        hits.groupBy("query_id", key.alias("_person"))
        .agg(
            F.max_by(F.struct(*[f"`{c}`" for c in columns]), merit).alias("_hit"),
            F.min("rank").alias("position"),
        )
        .select("query_id", "_hit.*", "position")
    )


def document_context(documents: DataFrame) -> Column:
    """Text of one hit as it is handed to the answer: labelled lines, then the content."""
    have = set(documents.columns)

    def line(label: str, name: str) -> Column:
        if name not in have:
            return F.lit(None).cast("string")
        return F.when(F.col(name) != "", F.concat(F.lit(f"{label}: "), F.col(name).cast("string")))

    return F.concat_ws(
        "\n",
        line("Consultant", "consultant_name"),
        line("Consultant ID", "consultant_id"),
        line("Title", "title"),
        line("Source file", "source_file"),
        line("Sheet", "sheet_name"),
        F.concat(F.lit("Content:\n"), F.coalesce("content", F.lit(""))),
    )
