"""Plain restatements of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def near_groups(rows):
    """doc_id -> (set size, smallest reachable doc_id)."""
    sets, holders = {}, defaultdict(list)
    for doc_id, text in rows:
        words = WORD.findall((text or "").translate(_LOWER))
        if len(words) < 5:
            sets[doc_id] = {tuple(words)} if words else set()
        else:
            sets[doc_id] = {tuple(words[i : i + 5]) for i in range(len(words) - 4)}
        for s in sets[doc_id]:
            holders[s].append(doc_id)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for doc_id, own in sets.items():
        for other, n in Counter(o for s in own for o in holders[s] if o < doc_id).items():
            if 100 * n >= 75 * (len(own) + len(sets[other]) - n):
                a, b = root(doc_id), root(other)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def substring_rows(rows):
    """doc_id -> (n_words, n_removed, kept_sha256)."""
    first, found = {}, {}
    for doc_id, text in sorted(rows):
        words = WORD.findall(text or "")
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), doc_id)
    for doc_id, text in rows:
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < doc_id:
                gone.update(range(i, i + 50))
        kept = " ".join(w for i, w in enumerate(words) if i not in gone)
        found[doc_id] = (len(words), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return found


def base_counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times, covered = Counter(windows), set()
    for i, window in enumerate(windows):
        if times[window] > 1:
            covered.update(range(i, i + 5))
    lines = [line for line in text.split("\n") if WORD.search(line)]
    symbols = sum(c in "#*$%&|<>" for c in text)
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered)
