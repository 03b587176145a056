"""Words and hashes of whole texts, shared by the operators of this folder.

A word is a run of bytes other than space and 0x09-0x0D; bytes.split() cuts at exactly these.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash

#: The same words for SQL and regular expressions.
WORD_GAP = r"[\x20\x09-\x0D]+"

#: Words a worker remembers the hash of; a cache, without effect on results.
REMEMBERED_WORDS = 300_000

_MIX = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """bytes -> 64-bit hash, remembered."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def rolling(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each run of `width` consecutive values; empty when there are fewer."""
    count = len(hashes) - width + 1
    if count <= 0:
        return np.empty(0, np.uint64)
    total = np.zeros(count, np.uint64)
    for n in range(width):
        total = mixed(total * _MIX + hashes[n : n + count])
    return total


def mixed(values: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    values = (values ^ (values >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(29))


def shingles(words: list[bytes], hashes: WordHashes, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words is one shingle, without words none."""
    if not words:
        return np.empty(0, np.uint64)
    values = hashes.of(words)
    return np.unique(rolling(values, min(width, len(words))))


def binary_column(batch: pa.RecordBatch, name: str) -> list[bytes | None]:
    """The UTF-8 bytes of a string column."""
    return batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()


def slices(batch: pa.RecordBatch, text: str, most_bytes: int = 16 << 20):
    """Cuts a batch so that each part holds few bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text))
    if not batch.num_rows:
        return
    sizes = np.diff(np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1])
    start = size = 0
    for n, more in enumerate(sizes.tolist()):
        if n > start and size + more > most_bytes:
            yield batch.slice(start, n - start)
            start, size = n, 0
        size += more
    yield batch.slice(start)


def long_list(values: np.ndarray, lengths: list[int]) -> pa.Array:
    """list<int64> from concatenated values."""
    offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.view(np.int64)))
