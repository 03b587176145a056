"""Near-duplicate groups: a multi-index Hamming join over b-bit MinHash signatures.

A text's set holds its distinct five-word shingles. The signature has 64 MinHash symbols of 16
bits. Texts at similarity 0.75 differ in 16 symbols on average; the join finds *every* pair that
differs in at most 28 (a pair at 0.75 exactly goes beyond that with probability about 0.0003, at
0.8 about 1e-6). The signature is cut into 16 chunks of four symbols: a pair within the radius
has at least two chunks with one differing symbol or none (14 chunks with two each already make
28), so its texts share a key "chunk without one of its symbols" for two chunks. The 64 keys of a
text enumerate the allowed error of each chunk.

Groups of any size are handled without a row for each pair of a group:

1. Equal word sequences are one class; only class representatives go on.
2. Each text is compared with the nearest (by signature) of the smallest ids of its buckets;
   links join components. This settles dense groups in one comparison a text.
3. What is left are pairs in one bucket but different components, where one text lies outside the
   bucket's largest component. A bucket's texts are dealt out in tiles of bounded size; a tile
   compares signatures and reports for each text the partners within the radius. A pair is
   reported by the first key it shares only.

Candidates are confirmed on their full sets, which meet in groups of bounded size. No bucket is
capped or sampled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.llm.components import components
from crewcast.llm.words import WordHashes, binary_column, long_list, mixed, shingles, slices
from crewcast.sources.shared_storage import fresh_path, in_few_files, written

SYMBOLS, CHUNK = 64, 4
CHUNKS = SYMBOLS // CHUNK
#: Below 2 * (CHUNKS - 1): two chunks have one error at most.
RADIUS = 28
#: Texts of a side of a tile, about; and of those that are confirmed together with one text.
TILE, TOGETHER = 1024, 256

_draw = np.random.default_rng(20_240_501)
_FACTORS = _draw.integers(0, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _draw.integers(0, 2**63, SYMBOLS, dtype=np.uint64)


def signature(values: np.ndarray) -> np.ndarray:
    """16 bits of the MinHash under each of the 64 hash functions."""
    low = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(values), 8192):
        part = values[start : start + 8192]
        low = np.minimum(low, (part[None, :] * _FACTORS[:, None] + _TERMS[:, None]).min(axis=1))
    return (mixed(low) >> np.uint64(48)).astype(np.uint16)


def _sketches(batches):
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            keys, counts, signs = [], [], []
            for text in binary_column(batch, "text"):
                words = (text or b"").lower().split()
                values = shingles(words, hashes)
                keys.append(xxhash.xxh3_128_digest(b" ".join(words)))
                counts.append(len(values))
                signs.append(signature(values).tobytes() if len(values) else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), pa.array(signs, pa.binary())],
                names=["doc_id", "row_key", "class_key", "n_shingles", "sign"],
            )


def _sets(batches):
    """group, id, partners, text -> group, id, partners, the set of the text."""
    hashes = WordHashes()
    for whole in batches:
        for batch in slices(whole, "text"):
            sets = [shingles((text or b"").lower().split(), hashes) for text in binary_column(batch, "text")]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], long_list(np.concatenate(sets), [len(s) for s in sets])],
                names=["group", "id", "partners", "items"],
            )


def chunk_keys(signs: np.ndarray) -> np.ndarray:
    """(n, 64) keys of (n, 64) symbols: which chunk and hole, and the three symbols that stay."""
    cut = signs.reshape(len(signs), CHUNKS, CHUNK).astype(np.int64)
    keys = np.empty((len(signs), CHUNKS, CHUNK), np.int64)
    for hole in range(CHUNK):
        a, b, c = (n for n in range(CHUNK) if n != hole)
        keys[:, :, hole] = cut[:, :, a] << 32 | cut[:, :, b] << 16 | cut[:, :, c]
    return keys.reshape(len(signs), SYMBOLS) | np.arange(SYMBOLS, dtype=np.int64) << 48


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, SYMBOLS)


def _keys(batches):
    for batch in batches:
        if batch.num_rows:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            keys = chunk_keys(_matrix(batch.column(1)))
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.ravel()), pa.array(np.repeat(ids, SYMBOLS))], names=["key", "id"]
            )


def _distances(batches):
    """id, sign, low, sign of low -> id, low, differing symbols, within the radius."""
    for batch in batches:
        if batch.num_rows:
            apart = (_matrix(batch.column(1)) != _matrix(batch.column(3))).sum(axis=1)
            near = pa.array(apart <= RADIUS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).filter(near), batch.column(2).filter(near), pa.array(apart[apart <= RADIUS], pa.int64())],
                names=["id", "low", "apart"],
            )


def _runs(batches, columns: int):
    """Tables of the rows that agree in the first columns; rows come sorted by these."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[0].column(n)[0] != batch.column(n)[0] for n in range(columns)):
            yield pa.Table.from_batches(held)
            held = []
        changes = np.zeros(batch.num_rows - 1, bool)
        for n in range(columns):
            changes |= np.diff(batch.column(n).to_numpy()) != 0
        cuts = [0, *(np.flatnonzero(changes) + 1).tolist(), batch.num_rows]
        for start, end in zip(cuts[:-1], cuts[1:], strict=True):
            if start:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(start, end - start))
    if held:
        yield pa.Table.from_batches(held)


def _tile_partners(batches):
    """key, x_tile, y_tile, outside, id, comp, sign by tile -> group, id, partners.

    Rows with `outside` are compared with the others of their tile.
    """
    names = ["group", "id", "partners"]
    groups, ids, partners = [], [], []
    for run in _runs(batches, 3):
        outside = run.column(3).to_numpy()
        if not outside.any() or outside.all():
            continue
        id_, comp = run.column(4).to_numpy(), run.column(5).to_numpy()
        sign = np.frombuffer(b"".join(run.column(6).to_pylist()), np.uint16).reshape(-1, SYMBOLS)
        key = run.column(0)[0].as_py()
        group = int(mixed(np.array([key ^ run.column(1)[0].as_py() << 20 ^ run.column(2)[0].as_py()], np.int64).view(np.uint64)).view(np.int64)[0])
        own = key >> 48
        inside = ~outside
        y_id, y_comp, y_sign, y_main = id_[inside], comp[inside], sign[inside], run.column(7).to_numpy()[inside]
        met: set[int] = set()
        for n in np.flatnonzero(outside):
            differs = y_sign != sign[n]
            # Two texts outside the main component meet twice; the smaller id reports.
            near = (differs.sum(axis=1) <= RADIUS) & (y_comp != comp[n]) & (y_main | (id_[n] < y_id))
            at = np.flatnonzero(near)
            if len(at):
                # The first key both share: the first chunk with one error at most, and its hole.
                errors = differs[at].reshape(len(at), CHUNKS, CHUNK)
                chunk = (errors.sum(axis=2) <= 1).argmax(axis=1)
                first = chunk * CHUNK + errors[np.arange(len(at)), chunk].argmax(axis=1)
                found = y_id[at[first == own]]
                if len(found):
                    groups.append(group)
                    ids.append(int(id_[n]))
                    partners.append(found)
                    met.update(found.tolist())
        groups += [group] * len(met)
        ids += met
        partners += [np.empty(0, np.int64)] * len(met)
        if len(ids) > 10_000:
            yield _partner_batch(groups, ids, partners, names)
            groups, ids, partners = [], [], []
    if ids:
        yield _partner_batch(groups, ids, partners, names)


def _partner_batch(groups, ids, partners, names) -> pa.RecordBatch:
    lists = long_list(np.concatenate(partners), [len(p) for p in partners])
    return pa.RecordBatch.from_arrays([pa.array(groups, pa.int64()), pa.array(ids, pa.int64()), lists], names=names)


def _group_links(batches):
    """group, id, partners, items by group -> a, b of the similar pairs."""
    for run in _runs(batches, 1):
        ids = run.column(1).to_pylist()
        lists = [x.values.to_numpy() for chunk in run.column(3).chunks for x in chunk]
        sets: dict[int, list[np.ndarray]] = {}
        for id_, items in zip(ids, lists, strict=True):
            # Rows repeated under an id may have several texts; any of them may link it.
            if not any(np.array_equal(items, known) for known in sets.setdefault(id_, [])):
                sets[id_].append(items)
        links = set()
        for id_, partners in zip(ids, run.column(2).to_pylist(), strict=True):
            for other in partners:
                if any(_reach(one, two) for one in sets[id_] for two in sets.get(other, ())):
                    links.add((min(id_, other), max(id_, other)))
        a, b = zip(*sorted(links), strict=True) if links else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _reach(one: np.ndarray, two: np.ndarray) -> bool:
    """Similarity 0.75 or more; the smaller set bounds what can be common."""
    if 100 * min(len(one), len(two)) < 75 * max(len(one), len(two)):
        return False
    common = len(np.intersect1d(one, two, assume_unique=True))
    return 100 * common >= 75 * (len(one) + len(two) - common)


def _confirmed(docs: DataFrame, wanted: DataFrame, pairs: int) -> DataFrame:
    """The links (a, b) among wanted (group, id, partners), written. Partners are ids of the group, `pairs` in all at most."""
    sets = (
        docs.select(F.col("doc_id").alias("id"), "text")
        .join(wanted.hint("merge"), "id")  # grows with the documents: never broadcast
        .select("group", "id", "partners", "text")
        .mapInArrow(_sets, "group bigint, id bigint, partners array<bigint>, items array<bigint>")
    )
    links = sets.repartition("group").sortWithinPartitions("group").mapInArrow(_group_links, "a bigint, b bigint")
    return written(in_few_files(links.distinct(), pairs), fresh_path(docs.sparkSession, "near-links"))


def _open_buckets(members: DataFrame) -> DataFrame:
    """key, main, x_tiles, y_tiles: buckets whose texts lie in several components."""
    return (
        members.groupBy("key", "comp")
        .agg(F.count("*").alias("n"))
        .groupBy("key")
        .agg(F.max("n").alias("largest"), F.max_by("comp", "n").alias("main"), F.count("*").alias("comps"), F.sum("n").alias("n"))
        .filter("comps > 1")
        .select(
            "key",
            "main",
            F.ceil((F.col("n") - F.col("largest")) / TILE).alias("x_tiles"),
            F.ceil(F.col("n") / TILE).alias("y_tiles"),
        )
    )


def _tiles(members: DataFrame, buckets: DataFrame) -> DataFrame:
    """Each member once for its own row of tiles, and, outside the main component, for its column."""
    placed = members.join(buckets, "key").withColumn("is_main", F.col("comp") == F.col("main"))
    tile = lambda count: F.pmod(F.xxhash64("id"), F.col(count))
    over = lambda count: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(count) - 1))
    as_y = placed.select("key", over("x_tiles").alias("x_tile"), tile("y_tiles").alias("y_tile"), F.lit(False).alias("outside"), "id", "comp", "is_main")
    as_x = placed.filter("not is_main").select(
        "key", tile("x_tiles").alias("x_tile"), over("y_tiles").alias("y_tile"), F.lit(True).alias("outside"), "id", "comp", "is_main"
    )
    return as_y.unionByName(as_x)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs (doc_id, text, ...).

    component_id is the smallest doc_id reachable by links of similarity 0.75 or more; kept marks
    the row that carries it. Texts without words (null, empty, blank) have n_shingles 0, link with
    nothing and are kept. Rows repeated under one id get the same verdict each; rows without an id
    have a null component_id and are kept. Other columns are ignored. Runs jobs while it is built
    and writes its intermediates to the shared folder.
    """
    return _judged(docs).drop("row_key")


def _judged(docs: DataFrame) -> DataFrame:
    """near_duplicates with row_key, xxhash64 of the text: tells rows of one id apart."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("row_key"), "text")
    base = written(
        docs.mapInArrow(_sketches, "doc_id bigint, row_key bigint, class_key binary, n_shingles bigint, sign binary"),
        fresh_path(spark, "sketches"),
    )
    # What the tables below hold at most: rows of one each, or one a key.
    rows = base.count()
    classes = base.filter("n_shingles > 0").groupBy("class_key").agg(F.min("doc_id").alias("doc_id")).filter("doc_id is not null")
    classes = written(in_few_files(classes, rows), fresh_path(spark, "classes"))
    nodes = base.join(classes, ["class_key", "doc_id"], "left_semi").select(F.col("doc_id").alias("id"), "sign").distinct()
    nodes = written(in_few_files(nodes, rows), fresh_path(spark, "nodes"))
    keys = nodes.select("id", "sign").mapInArrow(_keys, "key bigint, id bigint")
    shared = keys.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low < high")
    members = written(in_few_files(keys.join(shared.select("key", "low"), "key"), SYMBOLS * rows), fresh_path(spark, "members"))
    # Signatures are far wider than ids: they meet each pair of ids once, whatever keys it shares.
    # They grow with the documents, so they are never broadcast.
    signs = nodes.select("id", "sign").hint("merge")
    nearest = (
        members.filter("id <> low")
        .select("id", "low")
        .distinct()
        .join(signs, "id")
        .join(signs.toDF("low", "sign_low").hint("merge"), "low")
        .select("id", "sign", "low", "sign_low")
        .mapInArrow(_distances, "id bigint, low bigint, apart bigint")
        .groupBy("id")
        .agg(F.min_by("low", "apart").alias("low"))
    )
    nearest = written(in_few_files(nearest, rows), fresh_path(spark, "nearest"))
    # A popular low is confirmed in several groups; each gets its set once.
    degrees = nearest.groupBy("low").agg(F.ceil(F.count("*") / TOGETHER).alias("groups"))
    dealt = nearest.join(degrees, "low").withColumn("group", F.xxhash64("low", F.pmod(F.xxhash64("id"), F.col("groups"))))
    nobody = F.array().cast("array<bigint>")
    wanted = dealt.select("group", "id", F.array("low").alias("partners")).unionByName(
        dealt.select("group", F.col("low").alias("id")).distinct().withColumn("partners", nobody)
    )
    links = _confirmed(docs, wanted, rows)
    grouped = components(links)

    placed = members.join(grouped, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp"))
    placed = written(in_few_files(placed, SYMBOLS * rows), fresh_path(spark, "placed"))
    buckets = written(in_few_files(_open_buckets(placed), SYMBOLS * rows), fresh_path(spark, "buckets"))
    rest = (
        _tiles(placed, buckets)
        .join(signs, "id")
        .repartition("key", "x_tile", "y_tile")
        .sortWithinPartitions("key", "x_tile", "y_tile")
        .select("key", "x_tile", "y_tile", "outside", "id", "comp", "sign", "is_main")
        .mapInArrow(_tile_partners, "group bigint, id bigint, partners array<bigint>")
    )
    rest = written(rest, fresh_path(spark, "rest"))
    pairs = rest.agg(F.sum(F.size("partners"))).first()[0]
    if pairs:
        grouped = components(links.unionByName(_confirmed(docs, rest, pairs)))

    named = classes.withColumnRenamed("doc_id", "id").join(grouped, "id", "left").select("class_key", F.coalesce("comp", "id").alias("comp"))
    named = written(in_few_files(named, rows), fresh_path(spark, "named"))
    component = F.when(F.col("n_shingles") > 0, F.col("comp")).otherwise(F.col("doc_id"))
    return (
        base.select("doc_id", "row_key", "class_key", "n_shingles")
        .join(named, "class_key", "left")
        .select("doc_id", "row_key", "n_shingles", F.when(F.col("doc_id").isNotNull(), component).alias("component_id"))
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
    )


def without_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that near_duplicates keeps, with all their columns; rows without an id stay.

    Only ids are moved to decide; the texts of documents that go are not needed.
    """
    copies = _judged(docs).filter("not kept").select(F.col("doc_id").alias("_copy"), F.col("row_key").alias("_copy_key")).distinct()
    copies = written(copies, fresh_path(docs.sparkSession, "copies"))
    same = (docs["doc_id"].cast("bigint") == F.col("_copy")) & (F.xxhash64(docs["text"]) == F.col("_copy_key"))
    return docs.join(copies, same, "left_anti")
