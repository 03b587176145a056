"""A compressed FM-index over short word sequences, searched for many patterns at once.

The Burrows-Wheeler transform of a block is kept in a wavelet matrix of bit-packed levels with
word-wise counts. Backward search narrows suffix intervals; a range-minimum table over the
suffix order tells the smallest document of an interval.
"""

from __future__ import annotations

import numpy as np

_ONE = np.uint64(1)


def _suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffix array by prefix doubling; ends early where all suffixes already differ."""
    size = len(symbols)
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        after = np.zeros(size, np.int64)
        after[: size - step] = rank[step:] + 1 if step < size else 0
        key = rank * (size + 1) + after
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.empty(size, np.int64)
        fresh[order] = np.concatenate(([0], np.cumsum(ordered[1:] != ordered[:-1])))
        rank = fresh
        if rank[order[-1]] == size - 1:
            return order
        step *= 2


class _Bits:
    """A packed bit vector with rank."""

    def __init__(self, bits: np.ndarray) -> None:
        padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
        padded[: len(bits)] = bits
        self.packed = np.packbits(padded, bitorder="little").view(np.uint64)
        self.before = np.concatenate(([0], np.cumsum(np.bitwise_count(self.packed), dtype=np.int64)))[:-1].astype(np.int32)
        self.zeros = len(bits) - int(bits.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        cell = at >> 6
        mask = (_ONE << (at & 63).astype(np.uint64)) - _ONE
        return self.before[cell] + np.bitwise_count(self.packed[cell] & mask)


class FmIndex:
    """Sequences of ids 1..top, each with the id of its owner; ends are kept apart.

    `starts` are the first positions of the sequences in `text`, where each sequence is followed
    by one 0.
    """

    def __init__(self, text: np.ndarray, owners: np.ndarray, ends: np.ndarray) -> None:
        # Each end is a symbol of its own, below all words: suffixes differ within one sequence.
        count = len(ends)
        symbols = text.astype(np.int64) + count
        symbols[ends] = np.arange(count)
        order = _suffix_order(symbols)
        self.top = int(text.max(initial=0))
        last = text[order - 1]
        sizes = np.bincount(text, minlength=self.top + 1)
        first = np.concatenate(([0], np.cumsum(sizes)))[:-1]
        self.levels = [
            _Bits(np.zeros(0, np.uint8)) for _ in range(max(1, self.top.bit_length()))
        ]
        current = last
        for n in range(len(self.levels)):
            bits = ((current >> (len(self.levels) - 1 - n)) & 1).astype(np.uint8)
            self.levels[n] = _Bits(bits)
            current = np.concatenate((current[bits == 0], current[bits == 1]))
        every = np.arange(self.top + 1)
        self.shift = np.zeros(self.top + 1, np.int64)
        self.shift = first - self._down(every, np.zeros(self.top + 1, np.int64))
        lowest = owners[order].astype(np.int32)
        self.lowest = [lowest]
        width = 1
        while 2 * width <= len(lowest):
            above = self.lowest[-1]
            self.lowest.append(np.minimum(above[:-width], above[width:]))
            width *= 2
        self.size = len(text)

    def _down(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        for n, level in enumerate(self.levels):
            ones = level.rank(at)
            at = np.where((symbols >> (len(self.levels) - 1 - n)) & 1, level.zeros + ones, at - ones)
        return at

    def extend(self, symbols: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals after one symbol is put in front of each pattern."""
        both = self._down(np.concatenate((symbols, symbols)), np.concatenate((low, high)))
        shift = self.shift[symbols]
        return both[: len(low)] + shift, both[len(low) :] + shift

    def lowest_owner(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The smallest owner in each (non-empty) suffix interval."""
        exponent = np.frexp((high - low).astype(np.float64))[1] - 1
        found = np.empty(len(low), np.int32)
        for n in np.unique(exponent):
            here = exponent == n
            row = self.lowest[n]
            found[here] = np.minimum(row[low[here]], row[high[here] - (1 << int(n))])
        return found


def repeated_spans(
    index: FmIndex, text: np.ndarray, starts: np.ndarray, lengths: np.ndarray, owners: np.ndarray, window: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, first, last): spans of `window` or more words that also occur under a smaller owner.

    Streams all given sequences through the index side by side. Each holds one pattern [s, e],
    searched from its end; where a pattern first fails at j, nothing that contains [j, e] occurs,
    so the next window starts behind j. A window that occurs is lengthened to its longest
    matching end before the next one is tried.
    """
    which = np.flatnonzero(lengths >= window)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    last = (lengths - 1)[which]
    s = np.zeros(len(which), np.int64)
    e = np.full(len(which), window - 1, np.int64)
    known, bad = np.full(len(which), -1, np.int64), last + 1
    jumped = np.zeros(len(which), bool)
    j = e.copy()
    low, high = np.zeros(len(which), np.int64), np.full(len(which), index.size, np.int64)
    base, owner = starts[which], owners[which]
    while len(which):
        low, high = index.extend(text[base + j], low, high)
        occurs = high > low
        occurs[occurs] = index.lowest_owner(low[occurs], high[occurs]) < owner[occurs]
        whole = occurs & (j == s)
        fails = ~occurs
        j = j - 1
        turn = whole | fails
        if not turn.any():
            continue
        at = j + 1
        first_try = known < 0
        lost = fails & first_try
        # A longest match is settled when the next longer end is known to fail.
        known = np.where(whole, e, known)
        bad = np.where(fails & ~first_try, e, bad)
        settled = turn & ~lost & (known + 1 >= bad)
        if settled.any():
            found.append((which[settled], s[settled], known[settled]))
        next_s = np.where(lost, at + 1, np.where(settled, np.maximum(s + 1, known + 2 - window), s))
        guess = np.where(
            whole,
            np.where(first_try, last, np.where(jumped, known + 1, (known + bad) // 2)),
            np.where(at - 1 > known, np.minimum(at - 1, bad - 1), (known + bad) // 2),
        )
        anew = lost | settled
        jumped = np.where(turn, fails & ~anew & (at - 1 > known), jumped)
        s = np.where(anew, next_s, s)
        e = np.where(turn, np.where(anew, s + window - 1, np.clip(guess, known + 1, bad - 1)), e)
        known = np.where(anew, -1, known)
        bad = np.where(anew, last + 1, bad)
        j = np.where(turn, e, j)
        low, high = np.where(turn, 0, low), np.where(turn, index.size, high)
        going = e <= last
        if not going.all():
            which, last, s, e, known, bad, jumped, j, low, high, base, owner = (
                x[going] for x in (which, last, s, e, known, bad, jumped, j, low, high, base, owner)
            )
    if not found:
        none = np.empty(0, np.int64)
        return none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))
