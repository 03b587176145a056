"""Substring deduplication with an FM-index per shard.

A window is 50 consecutive words. A word goes when a window that covers it also starts in a
document with a smaller id. Windows meet by an anchor: the smallest hash among the window's
eight-word runs, so equal windows always have equal anchors, and consecutive windows mostly share
one. Around an anchor, every window that holds it also holds the 21 words before it or the 21
words behind it. So each anchor gives two keys, the hashes of the 29 words on either side, and
only windows with a key of two or more documents go on. Runs of these windows with one anchor are
cut out as segments, equal segments are merged with their smallest document, and all segments of
an anchor meet in one shard. There each shard's FM-index takes the segments as streamed documents
and reports the intervals whose matches reach 50 words.

A key that lies in very many documents (a passage that a third of all rows share) is first
tested window by window: only windows whose hash occurs in two documents stay in its segments, so
that the ever-different surroundings of the passage never gather in one place. The hashes choose
where to look; the index compares the words.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.llm.fm_index import FmIndex, repeated_spans
from crewcast.llm.words import WordHashes, binary_column, mixed, slices
from crewcast.sources.shared_storage import fresh_path, in_few_files, written

WINDOW, RUN = 50, 8
#: Words on one side of a run that any window with the run holds on one side at least.
SIDE = (WINDOW - RUN) // 2
#: Documents of a key from which its windows are tested one by one.
CROWDED = 500
#: Windows of a segment at most; longer runs are cut.
SEGMENT_WINDOWS = 64
#: Words of an index; whole anchors are put together up to it.
SHARD_WORDS = 400_000

_BASE = 0x9E3779B97F4A7C15


def _extreme(values: np.ndarray, width: int, op) -> np.ndarray:
    """Minima or maxima of each `width` neighbours; the last of the doubling steps overlaps."""
    reached = 1
    while 2 * reached <= width:
        values = op(values[:-reached], values[reached:])
        reached *= 2
    return op(values[: len(values) - (width - reached)], values[width - reached :]) if reached < width else values


class _Powers:
    """Powers of an odd base and of its inverse, modulo 2**64, kept for the longest text so far."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, count: int) -> tuple[np.ndarray, np.ndarray]:
        if count > len(self.up):
            size = max(count, 2 * len(self.up))
            steps = (np.full(size, base, np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64)))
            self.up, self.down = (np.cumprod(s) for s in steps)
        return self.up[:count], self.down[:count]


_POWERS = _Powers()


def _span_hashes(values: np.ndarray, width: int) -> np.ndarray:
    """A hash of each `width` consecutive words: differences of one running polynomial, modulo 2**64."""
    count = len(values) - width + 1
    if count <= 0:
        return np.empty(0, np.int64)
    up, down = _POWERS.of(len(values))
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values * up)))
    # Divided by the power of its place, so that equal spans agree wherever they stand.
    return ((running[width:] - running[:-width]) * down[:count]).view(np.int64)


class _Places:
    """Where the windows of a text have their anchors, and the keys at these places."""

    def __init__(self, values: np.ndarray) -> None:
        self.runs = mixed(_span_hashes(values, RUN).view(np.uint64))
        per_window = WINDOW - RUN + 1
        if len(self.runs) < per_window:
            self.anchors = np.empty(0, np.uint64)
            self.at = np.empty(0, np.int64)
            return
        self.anchors = _extreme(self.runs, per_window, np.minimum)
        # A run is an anchor where it equals the largest anchor of the windows that hold it.
        padding = np.zeros(per_window - 1, np.uint64)
        largest = _extreme(np.concatenate((padding, self.anchors, padding)), per_window, np.maximum)
        self.at = np.flatnonzero(largest == self.runs)
        spans = _span_hashes(values, RUN + SIDE)
        # Each place has one side at least: a window that holds it has 42 more words. A text's first
        # and last places have only one, which stands for both.
        before, after = self.at >= SIDE, self.at < len(spans)
        first, last = np.maximum(self.at - SIDE, 0), np.minimum(self.at, len(spans) - 1)
        self.before = spans[np.where(before, first, last)]
        self.after = spans[np.where(after, last, first)]

    def keys(self) -> np.ndarray:
        if not len(self.at):
            return np.empty(0, np.int64)
        return np.unique(np.concatenate((self.before, self.after)))

    def windows_with(self, keys: np.ndarray) -> np.ndarray:
        """Whether each window has an anchor with one of the keys."""
        if not len(self.at):
            return np.zeros(len(self.anchors), bool)
        good = self.at[np.isin(self.before, keys) | np.isin(self.after, keys)]
        chosen = np.full(len(self.runs), np.iinfo(np.uint64).max, np.uint64)
        chosen[good] = self.runs[good]
        return (_extreme(chosen, WINDOW - RUN + 1, np.minimum) == self.anchors) & (len(good) > 0)


def _anchor_rows(batches):
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = batch.column(0).to_pylist()
            found = [_Places(hashes.of((t or b"").split())).keys() for t in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate(found)),
                    pa.array(np.repeat(np.array(ids, np.int64), [len(x) for x in found])),
                ],
                names=["anchor", "doc_id"],
            )


def _window_rows(batches):
    """Hashes of the windows of crowded keys."""
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            for doc_id, text, crowded in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), batch.column(2), strict=True):
                values = hashes.of(text.split())
                here = _Places(values).windows_with(crowded.values.to_numpy())
                rows = np.unique(_span_hashes(values, WINDOW)[here])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(np.full(len(rows), doc_id, np.int64))], names=["hash", "doc_id"]
                )


def _cuts(anchors: np.ndarray, kept: np.ndarray) -> list[tuple[int, int]]:
    """(first, last) windows of the segments: kept neighbours with one anchor."""
    at = np.flatnonzero(kept)
    if not len(at):
        return []
    breaks = np.flatnonzero((np.diff(at) > 1) | (anchors[at[1:]] != anchors[at[:-1]])) + 1
    cuts = []
    for run in np.split(at, breaks):
        cuts.extend((int(run[n]), int(run[min(n + SEGMENT_WINDOWS, len(run)) - 1])) for n in range(0, len(run), SEGMENT_WINDOWS))
    return cuts


def _segment_rows(batches):
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            for doc_id, row_key, text, plain, windows in zip(
                batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "text"), batch.column(3), batch.column(4), strict=True
            ):
                words = text.split()
                values = hashes.of(words)
                places = _Places(values)
                anchors = places.anchors.view(np.int64)
                kept = places.windows_with(plain.values.to_numpy()) if plain.is_valid else np.zeros(len(anchors), bool)
                if windows.is_valid:
                    kept |= np.isin(_span_hashes(values, WINDOW), windows.values.to_numpy())
                for first, last in _cuts(anchors, kept):
                    sequence = b" ".join(words[first : last + WINDOW])
                    rows.append((int(anchors[first]), xxhash.xxh3_128_digest(sequence), doc_id, row_key, first, last - first + WINDOW, sequence))
            if rows:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), k) if k != pa.string() else pa.array(list(c), pa.binary()).cast(k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["anchor", "segment", "doc_id", "row_key", "first", "words", "sequence"],
                )


def _search(rows: list[tuple]) -> pa.RecordBatch:
    """Rows (anchor, segment, sequence, doc_id) of whole anchors -> spans of their segments."""
    names: dict[bytes, int] = {}
    parts, lengths = [], []
    for _, _, sequence, _ in rows:
        ids = [names.setdefault(w, len(names) + 1) for w in sequence.split()]
        ids.append(0)
        parts.append(np.array(ids, np.int64))
        lengths.append(len(ids) - 1)
    text, lengths = np.concatenate(parts), np.array(lengths, np.int64)
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    docs = np.array([r[3] for r in rows], np.int64)
    owners = np.unique(docs, return_inverse=True)[1].astype(np.int64)
    index = FmIndex(text, np.repeat(owners, lengths + 1), ends)
    which, first, last = repeated_spans(index, text, starts, lengths, owners, WINDOW)
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[n][0] for n in which], pa.int64()),
            pa.array([rows[n][1] for n in which], pa.binary()),
            pa.array(first, pa.int64()),
            pa.array(last, pa.int64()),
        ],
        names=["anchor", "segment", "span_first", "span_last"],
    )


def _shards(batches):
    """Segments in the order of their anchors and hashes -> spans; an index holds whole anchors."""
    block, size = [], 0
    for whole in batches:
        for batch in slices(whole, "sequence"):
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), binary_column(batch, "sequence"), batch.column(3).to_pylist(), strict=True):
                if block and row[:2] == block[-1][:2]:
                    continue  # the same segment again in its document
                if size >= SHARD_WORDS and row[0] != block[-1][0]:
                    yield _search(block)
                    block, size = [], 0
                block.append(row)
                size += len(row[2]) // 6
    if block:
        yield _search(block)


def _keep(words: list[bytes], spans: list[dict] | None) -> list[bytes]:
    if not spans:
        return words
    gone = np.zeros(len(words) + 1, np.int64)
    for span in spans:
        gone[span["first"]] += 1
        gone[span["last"] + 1] -= 1
    stays = np.cumsum(gone[:-1]) == 0
    return [w for w, s in zip(words, stays.tolist(), strict=True) if s]


def _digest(batches):
    """doc_id, row_key, text (and spans) -> the digest of the words that stay."""
    for whole in batches:
        for batch in slices(whole, "text"):
            rows = []
            spans = batch.column(3).to_pylist() if batch.num_columns > 3 else [None] * batch.num_rows
            for text, own in zip(binary_column(batch, "text"), spans, strict=True):
                words = (text or b"").split()
                kept = _keep(words, own)
                rows.append((len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=["doc_id", "row_key", "n_words", "n_removed", "kept_sha256"],
            )


def _rest(texts: pa.Array, spans: pa.Array) -> pa.Array:
    """The words of each text that stay, joined by one space; null where there is no text."""
    kept = [None if t is None else b" ".join(_keep(t.split(), s)) for t, s in zip(texts.cast(pa.binary()).to_pylist(), spans.to_pylist(), strict=True)]
    return pa.array(kept, pa.binary()).cast(pa.string())


def _per_document(rows: DataFrame, known: DataFrame, key: str, name: str) -> DataFrame:
    """doc_id and the list of its keys that are known."""
    return rows.join(known.select(key), key, "left_semi").groupBy("doc_id").agg(F.collect_set(key).alias(name))


def _of_two_documents(rows: DataFrame, key: str) -> DataFrame:
    return (
        rows.groupBy(key)
        .agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most"), F.count("*").alias("docs"))
        .filter("least < most")
    )


def repeated_passages(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The searched rows (doc_id, row_key, text), and the words to remove of those that have some.

    The second table is doc_id, row_key, spans of (first, last) words. row_key is xxhash64 of the
    text, so rows repeated under one id are told apart. Rows without an id are neither searched
    nor sources; windows of one id never match each other. Runs jobs while it is built;
    intermediates are written to the shared folder. What is joined with the texts grows with
    them, so it is never broadcast.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")
    anchors = written(texts.mapInArrow(_anchor_rows, "anchor bigint, doc_id bigint"), fresh_path(spark, "anchors"))
    shared = written(in_few_files(_of_two_documents(anchors, "anchor"), anchors.count()), fresh_path(spark, "shared-anchors"))
    known = anchors.join(shared.select("anchor", (F.col("docs") > CROWDED).alias("_crowded")), "anchor")
    plain, crowded = (F.collect_set(F.when(test, F.col("anchor"))) for test in (~F.col("_crowded"), F.col("_crowded")))
    lists = known.groupBy("doc_id").agg(plain.alias("plain"), crowded.alias("crowded"))
    lists = lists.select("doc_id", *[F.when(F.size(c) > 0, F.col(c)).alias(c) for c in ("plain", "crowded")])
    rows = written(
        texts.select("doc_id", F.xxhash64("text").alias("row_key"), "text").join(lists.hint("merge"), "doc_id"),
        fresh_path(spark, "searched"),
    )
    windows = written(
        rows.filter("crowded is not null").select("doc_id", "text", "crowded").mapInArrow(_window_rows, "hash bigint, doc_id bigint"),
        fresh_path(spark, "windows"),
    )
    tested = _per_document(windows, _of_two_documents(windows, "hash"), "hash", "windows")
    segments = written(
        rows.join(tested, "doc_id", "left")
        .filter("plain is not null or windows is not null")
        .select("doc_id", "row_key", "text", "plain", "windows")
        .mapInArrow(
            _segment_rows,
            "anchor bigint, segment binary, doc_id bigint, row_key bigint, first bigint, words bigint, sequence string",
        ),
        fresh_path(spark, "segments"),
    )
    # Equal segments are merged by their hashes; texts go on only where an anchor has segments of
    # several first documents, one text of each.
    owners = segments.groupBy("anchor", "segment").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other"))
    owners = written(in_few_files(owners, segments.count()), fresh_path(spark, "owners"))
    several = owners.groupBy("anchor").agg(F.min("owner").alias("_least"), F.max("owner").alias("_most")).filter("_least < _most")
    indexed = owners.join(several.select("anchor"), "anchor", "left_semi").select("anchor", "segment", F.col("owner").alias("doc_id"))
    own = written(
        segments.select("anchor", "segment", "sequence", "doc_id")
        .join(indexed.hint("merge"), ["anchor", "segment", "doc_id"], "left_semi")
        .select("anchor", "segment", "sequence", "doc_id")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "segment")
        .mapInArrow(_shards, "anchor bigint, segment binary, span_first bigint, span_last bigint"),
        fresh_path(spark, "spans"),
    )
    # The first document of a segment loses what the index found; all others have it from the first.
    places = segments.select("anchor", "segment", "doc_id", "row_key", "first", "words")
    copied = places.join(owners.filter("owner < other").select("anchor", "segment", "owner"), ["anchor", "segment"]).filter("doc_id > owner")
    copied = copied.select("doc_id", "row_key", "first", (F.col("first") + F.col("words") - 1).alias("last"))
    searched = own.join(owners.select("anchor", "segment", F.col("owner").alias("doc_id")), ["anchor", "segment"]).join(
        places, ["anchor", "segment", "doc_id"]
    )
    searched = searched.select(
        "doc_id", "row_key", (F.col("first") + F.col("span_first")).alias("a"), (F.col("first") + F.col("span_last")).alias("b")
    )
    spans = copied.unionByName(searched.toDF("doc_id", "row_key", "first", "last"))
    spans = spans.groupBy("doc_id", "row_key").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    return rows.select("doc_id", "row_key", "text"), spans


def substring_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 for every row; null texts count as empty.

    Every text is digested whole where it lies; only the texts that lose words are moved.
    Repeated rows of one id are each returned; an empty table gives an empty table.
    """
    searched, spans = repeated_passages(docs)
    schema = "doc_id bigint, row_key bigint, n_words bigint, n_removed bigint, kept_sha256 string"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    whole = rows.mapInArrow(_digest, schema)
    changed = (
        searched.dropDuplicates(["doc_id", "row_key"])
        .join(spans, ["doc_id", "row_key"])
        .select("doc_id", "row_key", "text", "spans")
        .mapInArrow(_digest, schema)
        .select("doc_id", "row_key", F.col("n_removed").alias("_removed"), F.col("kept_sha256").alias("_sha256"))
    )
    return whole.join(changed.hint("merge"), ["doc_id", "row_key"], "left").select(
        "doc_id", "n_words", F.coalesce("_removed", "n_removed").alias("n_removed"), F.coalesce("_sha256", "kept_sha256").alias("kept_sha256")
    )


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with repeated passages cut out of `text` and n_chars set anew where a text changed.

    Unchanged texts keep their spacing; the words left of a changed one are joined by one space.
    All rows and columns stay. Every text meets its spans once and is cut where they meet; texts
    without spans are not handed to Python.
    """
    spans = written(repeated_passages(docs)[1], fresh_path(docs.sparkSession, "removed")).toDF("_id", "_key", "_spans")
    rows = docs.withColumn("_id", F.col("doc_id").cast("bigint")).withColumn("_key", F.xxhash64("text"))
    changes = F.col("_spans").isNotNull()
    joined = rows.join(spans.hint("merge"), ["_id", "_key"], "left")
    joined = joined.withColumn("_rest", F.arrow_udf(_rest, "string")(F.when(changes, F.col("text")), F.col("_spans")))
    values = {"text": F.coalesce("_rest", "text")}
    if "n_chars" in docs.columns:
        length = F.length("_rest").cast(docs.schema["n_chars"].dataType)
        values["n_chars"] = F.when(F.col("_rest").isNotNull(), length).otherwise(F.col("n_chars"))
    return joined.select(*[values[c].alias(c) if c in values else F.col(f"`{c}`") for c in docs.columns])
