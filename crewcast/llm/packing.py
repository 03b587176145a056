"""Packing documents into sequences of fixed length by a configuration linear program.

Only the histogram of piece lengths reaches the driver (one count per length up to the capacity).
Large lengths are rounded up to size classes. The linear program over patterns (multisets of
classes that fit a sequence) covers each class's count with the fewest sequences. Multiplicative
weights solve it: each round a knapsack dynamic program finds the pattern of largest weight, the
pattern gets as many sequences as cover EPSILON of its scarcest class, and classes lose weight as
they are covered. The solution is rounded down; its sequences get exact lengths, those that are nearly
full stay, and what remains goes by best fit, longest first, into the room left in all sequences, then into new ones. All of
this works on counts per length, so its cost does not depend on the number of documents.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from crewcast.llm.words import REMEMBERED_WORDS, binary_column, slices
from crewcast.sources.shared_storage import fresh_path, written

CAPACITY = 4096
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
END_OF_DOCUMENT = 1
#: Width of a size class, and the length up to which pieces only fill room that is left.
UNIT, SMALL = 8, 1024
#: Share of a sequence that a rounded pattern may leave empty.
MOST_SLACK = 0.003
#: Share of a pattern's scarcest class that one round covers, and the most rounds.
EPSILON, MOST_ROUNDS = 0.1, 6000
#: Pieces of one length that are numbered together.
NUMBERED_TOGETHER = 50_000
#: Parts of words a worker remembers the ids of; a cache, without effect on results.
REMEMBERED_PARTS = 600_000

# The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others follow from 256.
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
_AS_CHARS = {b: 256 + n for n, b in enumerate(b for b in range(256) if b not in _SHOWN)}


class _Ids(dict):
    """A word (bytes between ASCII white space) -> its ids as little-endian 32-bit integers.

    The tokenizer drops white space and never merges across it, so a text's ids are its words'.
    """

    def __init__(self, path: str) -> None:
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.model = self.tokenizer.model
        self.parts: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _part(self, text: str) -> bytes:
        """Lower-case letters or closing marks: one part, so its merges alone give the ids."""
        if (value := self.parts.get(text)) is None:
            if len(self.parts) > REMEMBERED_PARTS:
                self.parts.clear()
            spelled = text if text.isascii() else text.encode().decode("latin-1").translate(_AS_CHARS)
            ids = [token.id for token in self.model.tokenize(spelled)]
            value = self.parts[text] = b"".join([n.to_bytes(4, "little") for n in ids])
        return value

    def __missing__(self, word: bytes) -> bytes:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        text = word.decode()
        core = text.rstrip(".,;:!?")
        low = core.lower()
        # Below U+0300 nothing composes; letters and closing marks are parts of their own.
        if core.isalpha() and low.isalpha() and max(core) < "̀":
            value = self._part(low) + (self._part(text[len(core) :]) if len(core) < len(text) else b"")
        else:
            value = self._encode(text)
        self[word] = value
        return value


_worker: dict[str, _Ids] = {}


def _piece_rows(path: str, capacity: int):
    width = 4 * capacity

    def rows(batches):
        ids = _worker.get(path) or _worker.setdefault(path, _Ids(path))
        end = END_OF_DOCUMENT.to_bytes(4, "little")
        for whole in batches:
            for batch in slices(whole, "text"):
                docs, pieces, lengths, sums = [], [], [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), binary_column(batch, "text"), strict=True):
                    data = b"".join(map(ids.__getitem__, (text or b"").split())) + end
                    for n in range(0, len(data), width):
                        part = data[n : n + width]
                        docs.append(doc_id)
                        pieces.append(n // width)
                        lengths.append(len(part) // 4)
                        sums.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(docs, pa.int64()), pa.array(pieces, pa.int32()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())],
                    names=["doc_id", "piece", "length", "ids_crc32"],
                )

    return rows


class Group(NamedTuple):
    """`count` sequences that hold the same lengths: (length, times) in the order of their places."""

    count: int
    parts: tuple[tuple[int, int], ...]


def best_pattern(values: np.ndarray, sizes: np.ndarray, most: np.ndarray, room: int) -> dict[int, int]:
    """Knapsack by dynamic programming: the classes (index -> times) of largest total value.

    best[c] is the largest value in room c; the class taken last is remembered. A class is taken
    at most `most` times: what goes beyond is cut from the pattern found.
    """
    best = np.zeros(room + 1)
    taken = np.full(room + 1, -1)
    order = np.argsort(sizes, kind="stable")
    sizes_up, values_up = sizes[order], values[order]
    upto = np.searchsorted(sizes_up, np.arange(room + 1), "right")
    for c in range(1, room + 1):
        best[c] = best[c - 1]
        if upto[c]:
            gains = values_up[: upto[c]] + best[c - sizes_up[: upto[c]]]
            n = int(gains.argmax())
            if gains[n] > best[c]:
                best[c], taken[c] = gains[n], order[n]
    pattern: Counter[int] = Counter()
    c = room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            pattern[int(taken[c])] += 1
            c -= int(sizes[taken[c]])
    return {n: min(times, int(most[n])) for n, times in pattern.items()}


def solve_patterns(sizes: np.ndarray, demand: np.ndarray, room: int) -> dict[tuple[tuple[int, int], ...], float]:
    """Fractional sequences per pattern that cover the demand, by multiplicative weights."""
    found: dict[tuple[tuple[int, int], ...], float] = {}
    covered = np.zeros(len(sizes))
    for _ in range(MOST_ROUNDS):
        if covered.min(initial=1.0) >= 1:
            break
        # Classes already covered have no weight; the scarcer the cover, the larger the weight.
        weights = np.where(covered < 1, np.exp(-covered / EPSILON * 0.5), 0.0) * sizes
        pattern = best_pattern(weights, sizes, demand, room)
        if not pattern:
            break
        step = max(EPSILON * min(demand[n] / t for n, t in pattern.items()), 1e-9)
        for n, times in pattern.items():
            covered[n] += step * times / demand[n]
        key = tuple(sorted(pattern.items()))
        found[key] = found.get(key, 0.0) + step
    return found


def _exact_groups(patterns: list[tuple[tuple[tuple[int, int], ...], int]], left: dict[int, list[list[int]]]) -> list[Group]:
    """Sequences of the rounded patterns with exact lengths, taken from each class longest first.

    `left` has (length, count) runs per class, shortest first, and loses what is placed.
    """
    groups = []
    for pattern, count in patterns:
        slots = [n for n, times in pattern for _ in range(times)]
        while count:
            # As many sequences at once as the runs in front allow.
            need = Counter((n, left[n][-1][0]) for n in slots)
            now = min(count, *(left[n][-1][1] // times for (n, _), times in need.items()))
            if now:
                groups.append(Group(now, tuple(sorted(((length, t) for (_, length), t in need.items()), reverse=True))))
                for (n, _), times in need.items():
                    left[n][-1][1] -= times * now
            else:
                now, taken = 1, Counter()
                for n in slots:
                    while not left[n][-1][1]:
                        left[n].pop()
                    left[n][-1][1] -= 1
                    taken[left[n][-1][0]] += 1
                groups.append(Group(1, tuple(sorted(taken.items(), reverse=True))))
            count -= now
            for n in set(slots):
                while left[n] and not left[n][-1][1]:
                    left[n].pop()
    return groups


def best_fit(groups: list[Group], rest: dict[int, int], capacity: int) -> list[Group]:
    """Puts the remaining lengths, longest first, into the fullest sequences that have room."""
    by_room: dict[int, list[Group]] = {}
    for group in groups:
        by_room.setdefault(capacity - sum(n * t for n, t in group.parts), []).append(group)
    rooms = sorted(by_room)
    for length in sorted(rest, reverse=True):
        count = rest[length]
        while count:
            at = bisect.bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                group = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[at]
            else:
                room, group = capacity, Group(-(-count // (capacity // length)), ())
            times = min(room // length, count)
            used = min(group.count, count // times)
            if used < group.count:
                if room not in by_room:
                    bisect.insort(rooms, room)
                    by_room[room] = []
                # Sequences not opened yet are no sequences.
                if group.parts:
                    by_room[room].append(Group(group.count - used, group.parts))
                elif not by_room[room]:
                    del by_room[room]
                    rooms.remove(room)
            count -= used * times
            after = room - times * length
            if after not in by_room:
                bisect.insort(rooms, after)
                by_room[after] = []
            by_room[after].append(Group(used, (*group.parts, (length, times))))
    return [g for some in by_room.values() for g in some]


def plan_groups(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Group]:
    """All sequences for pieces counted by length (1 to capacity)."""
    lengths = np.array(sorted(n for n in histogram if n > SMALL and histogram[n] > 0), np.int64)
    rest = {n: c for n, c in histogram.items() if c > 0}
    groups: list[Group] = []
    room = capacity // UNIT
    classes = -(-lengths // UNIT)
    if len(lengths) and classes.max() <= room:
        sizes, which = np.unique(classes, return_inverse=True)
        demand = np.bincount(which, [histogram[int(n)] for n in lengths]).astype(np.int64)
        runs: dict[int, list[list[int]]] = {}
        for n, length in zip(which.tolist(), lengths.tolist(), strict=True):
            runs.setdefault(n, []).append([length, histogram[length]])
            del rest[length]
        solution = solve_patterns(sizes, demand, room)
        remaining, whole = demand.copy(), []
        fullest = sorted(solution.items(), key=lambda x: (-sum(sizes[n] * t for n, t in x[0]), -x[1], x[0]))
        for pattern, amount in fullest:
            count = min(int(amount), *(int(remaining[n]) // t for n, t in pattern))
            if count:
                whole.append((pattern, count))
                for n, times in pattern:
                    remaining[n] -= times * count
        # What rounding left far from full is better placed anew, by exact lengths.
        for group in _exact_groups(whole, runs):
            if capacity - sum(n * t for n, t in group.parts) <= MOST_SLACK * capacity:
                groups.append(group)
                continue
            for length, times in group.parts:
                rest[length] = rest.get(length, 0) + times * group.count
        for some in runs.values():
            for length, count in some:
                if count:
                    rest[length] = rest.get(length, 0) + count
    return best_fit(groups, rest, capacity)


def slot_table(groups: list[Group]) -> np.ndarray:
    """Columns length, first, times, sequence, offset, sorted: which places the pieces of a length take.

    Piece number k of its length, first <= k < the next row's first, goes to sequence
    (k - first) // times after `sequence`, as number (k - first) % times from `offset` on.
    """
    rows, used, sequence = [], Counter(), 0
    for group in groups:
        offset = 0
        for length, times in group.parts:
            rows.append((length, used[length], times, sequence, offset))
            used[length] += times * group.count
            offset += times * length
        sequence += group.count
    return np.array(sorted(rows), np.int64).reshape(-1, 5).T


def _placed_rows(table: np.ndarray):
    def rows(batches):
        keys = table[0] << 44 | table[1]
        for batch in batches:
            lengths, numbers = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(keys, lengths << 44 | numbers, "right") - 1
            _, first, times, sequence, offset = table[:, at]
            nth = numbers - first
            columns = [*batch.columns[:5], pa.array(sequence + nth // times), pa.array(offset + nth % times * lengths)]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return rows


def packed(docs: DataFrame, tokenizer: str = TOKENIZER, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: a row per piece of each document.

    A null, empty or blank text is the one id that ends a document. Documents are cut only where
    they are longer than the capacity. Repeated rows and rows without an id are packed like any
    other. An empty table gives no rows. Other columns are ignored. Runs jobs while it is built.
    """
    spark = docs.sparkSession
    pieces = written(
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(
            _piece_rows(tokenizer, capacity), "doc_id bigint, piece int, length bigint, ids_crc32 bigint"
        ),
        fresh_path(spark, "pieces"),
    )
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    table = slot_table(plan_groups(histogram, capacity))
    # Numbers within a length, in two levels: a length may hold most of the rows.
    salts = sum(histogram.values()) // NUMBERED_TOGETHER + 1
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)))
    before = salted.groupBy("length", "salt").agg(F.count("*").alias("n"))
    running = Window.partitionBy("length").orderBy("salt")
    before = before.select("length", "salt", (F.sum("n").over(running) - F.col("n")).alias("before"))
    within = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        salted.join(before, ["length", "salt"])
        .withColumn("number", F.col("before") + F.row_number().over(within) - 1)
        .select("doc_id", "piece", (F.col("piece").cast("bigint") * capacity).alias("start"), "length", "ids_crc32", "number")
    )
    return numbered.mapInArrow(
        _placed_rows(table),
        "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
    )
