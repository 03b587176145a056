"""Conversation repair, ranked search and line deduplication."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from crewcast.llm import conversation_repair as repair
from crewcast.llm import line_dedup, ranked_search

SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
CONVERSATIONS = "conv_id long, turn long, role string, text string, edit string, n long"


# --- conversation repair -----------------------------------------------------------------------


def full_chart(rows):
    """Least (cost, audit) by a chart over all spans and all splits, with another grammar.

    rows: (initial, fault). X -> U A | X X are pairs, Z -> S X has a system turn, E is deleted rows;
    every sign may have E at either side, and U, A can come from no row at all.
    """
    n = len(rows)
    chart = defaultdict(dict)

    def offer(cell, sign, found):
        if sign not in cell or found < cell[sign]:
            cell[sign] = found
            return True
        return False

    binary = [("X", "U", "A"), ("X", "X", "X"), ("Z", "S", "X"), ("E", "E", "E")]
    binary += [(s, *pair) for s in "UASXZ" for pair in ((s, "E"), ("E", s))]
    empty = {"U": (5, "I"), "A": (5, "I"), "X": (10, "II"), "E": (0, "")}
    for length in range(1, n + 1):
        for i in range(n - length + 1):
            cell = chart[i, i + length]
            if length == 1:
                initial, fault = rows[i]
                offer(cell, "E", (2, "D"))
                if fault != "d":
                    more = 5 if fault == "t" else 0
                    for sign in "UA":
                        offer(cell, sign, (1 + more, "R"))
                    if initial in "sua":
                        offer(cell, initial.upper(), (more, "K"))
            for k in range(i + 1, i + length):
                for sign, a, b in binary:
                    left, right = chart[i, k].get(a), chart[k, i + length].get(b)
                    if left and right:
                        offer(cell, sign, (left[0] + right[0], left[1] + right[1]))
            while True:  # insertion closure: one side from no row
                changed = False
                for sign, a, b in binary:
                    for left, right in ((cell.get(a), empty.get(b)), (empty.get(a), cell.get(b))):
                        if left and right:
                            changed |= offer(cell, sign, (left[0] + right[0], left[1] + right[1]))
                if not changed:
                    break
    return min(chart[0, n][s] for s in "EXZ" if s in chart[0, n]) if n else (0, "")


@pytest.mark.parametrize("seed", range(60))
def test_cells_equal_the_full_chart(seed):
    draw = random.Random(seed)
    rows = [(draw.choice("uuaaso"), draw.choice("---td")) for _ in range(draw.randrange(1, 9))]
    cells = [repair.terminal(*r) for r in rows]
    assert repair.cheapest(repair.combined(cells)) == full_chart(rows)
    for at in range(1, len(rows)):  # every split gives the same cell
        assert repair.joined(repair.combined(cells[:at]), repair.combined(cells[at:])) == repair.combined(cells)


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        shown = [" " if v is None else str(v) for v in (conv, turn)]
        kind = zlib.crc32(":".join(shown).encode()) % 20
        role, text = (" " if v is None else v for v in (role, text))
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        out += [(conv, turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def brute_report(originals, rows):
    found = {}
    for conv in {r[0] for r in originals}:
        own = sorted((r[1:] for r in rows if r[0] == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        seen, faults = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            faults.append("b" if not bare else "r" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-")
            seen.add((role, text))
        initials = [role[:1] if role[:1] in ("s", "u", "a") else "o" for _, role, _ in own]
        # States of the pattern: start, after system, after user, after assistant.
        after = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
        roles = {"u": "user", "a": "assistant"}
        best = {0: (0, "", ())}

        def inserted(best):
            for _ in range(2):
                for (p, sign), q in after.items():
                    if p in best and sign != "s":
                        cost, audit, lines = best[p]
                        new = (cost + 5, audit + "I", (*lines, roles[sign] + ":"))
                        best[q] = min(best.get(q, new), new)
            return best

        best = inserted(best)
        for (_, role, text), fault, initial in zip(own, faults, initials, strict=True):
            new = {}

            def offer(q, entry):
                new[q] = min(new.get(q, entry), entry)

            for p, (cost, audit, lines) in best.items():
                offer(p, (cost + 2, audit + "D", lines))
                if fault in "-t":
                    more = 5 * (fault == "t")
                    for sign in "sua":
                        if (p, sign) in after:
                            if sign == initial:
                                offer(after[p, sign], (cost + more, audit + "K", (*lines, f"{role}:{text}")))
                            if sign != "s":
                                offer(after[p, sign], (cost + 1 + more, audit + "R", (*lines, f"{roles[sign]}:{text}")))
            best = inserted(new)
        cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
        turns = [t for t, _, _ in own if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False))
        found[conv] = (
            gaps, faults.count("b"), faults.count("r"), faults.count("t"), illegal, cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest(),
        )
    return found


def conversation_rows(spark, rows):
    return spark.createDataFrame([(*r, "x", 7) for r in rows], CONVERSATIONS)


def reported(df):
    return {r.conv_id: tuple(r[1:]) for r in df.collect()}


ODD = [
    (1, 0, "user", "Hi there."), (1, 1, "assistant", "Hello!"), (1, 1, "assistant", "Hello!"), (1, 4, "user", "And"),
    (2, 0, None, None), (2, None, "system", "Be kind."), (2, None, "user", "A?"), (2, 3, "assistant", "B. \t\n"),
    (None, 5, "user", "no id?"), (None, None, "assistant", "none."), (3, 1, "tool", "x."), (3, 2, "", "y!"),
    (4, 0, "user", "long " * 60_000 + "."), (4, 1, "assistant", "é "), (5, 9, "assistant", "only one."), (6, 0, "user", " "),
]


def test_repair_of_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 2)
    monkeypatch.setattr(repair, "FAN", 2)
    df = conversation_rows(spark, ODD)
    assert reported(repair.repair_report(df)) == brute_report(ODD, [(a, b, " " if c is None else c, " " if d is None else d) for a, b, c, d in ODD])
    assert reported(repair.repair_report(df, repair.damaged(df))) == brute_report(ODD, brute_damage(ODD))
    assert repair.repair_report(conversation_rows(spark, [])).count() == 0


def test_repair_of_a_long_conversation(spark, monkeypatch):
    monkeypatch.setattr(repair, "SPAN", 16)
    monkeypatch.setattr(repair, "FAN", 3)
    draw = random.Random(1)
    rows = [(draw.randrange(3, 60), n, draw.choice(("user", "assistant")), draw.choice(("a.", "b", " ", f"{n}?"))) for n in range(200)]
    rows += [(1, n, ("user", "assistant")[(n + (draw.random() < 0.1)) % 2], f"t{draw.randrange(400)}{draw.choice('..!,')}") for n in range(600)]
    df = conversation_rows(spark, rows)
    assert reported(repair.repair_report(df, repair.damaged(df))) == brute_report(rows, brute_damage(rows))


def test_repaired_rows_follow_the_pattern(spark):
    rows = [(1, 0, "assistant", "a."), (1, 1, "user", "b?"), (1, 2, "user", "c."), (1, 3, "user", "cut off")]
    turns = repair.numbered_turns(conversation_rows(spark, rows))
    repaired = repair.repaired_turns(turns, repair.parsed_conversations(repair.faulty_turns(turns))).orderBy("position").collect()
    assert [(r.edit, r.role, r.text) for r in repaired] == [("D", None, None), ("K", "user", "b?"), ("R", "assistant", "c."), ("D", None, None)]


# --- ranked search -----------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def brute_ranking(docs, items, top=20):
    found = [(d, TERM.findall((t or "").translate(LOWER))) for d, t in docs]
    found = [(d, w) for d, w in found if w]
    n_docs, n_terms = len(found), sum(len(w) for _, w in found)
    df = Counter(t for _, w in found for t in set(w))
    rows = []
    for item_id, text in {(i, t or "") for i, t in items}:
        scored = []
        for doc_id, words in found:
            tf, m = Counter(words), 75 + (25 * len(words) * n_docs) // n_terms
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * tf[t]) // (1000 * tf[t] + 12 * m))
                for t in TERM.findall(text.translate(LOWER)) if tf[t]
            )
            if score > 0:
                scored.append((-score, doc_id is None, doc_id or 0, doc_id))
        rows += [(item_id, n, s[3], -s[0]) for n, s in enumerate(sorted(scored, key=lambda s: s[:3])[:top], start=1)]
    return sorted(rows, key=repr)


def items_of(spark, rows):
    return spark.createDataFrame([(*r, 1, 2.0) for r in rows], "item_id long, text string, doc_id long, score double")


def ranking(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("cells", [1, 4 << 20])
def test_ranking_equals_brute_force(spark, docs_of, prose, monkeypatch, cells):
    monkeypatch.setattr(ranked_search, "BLOCK_CELLS", cells)
    monkeypatch.setattr(ranked_search, "TILE_WORDS", 7)
    monkeypatch.setattr(ranked_search, "TILE_DOCUMENTS", 5)
    docs = [(i, " ".join(prose(i % 40, 5 + i % 30, 50))) for i in range(120)]
    docs += [(500, None), (501, ""), (502, "..., !"), (None, "w1 w2 w3"), (None, "w1 w2 w3"), (7, "W1-w2_É é w3"), (503, "w4 " * 30_000)]
    items = [(1, "w1 W2 w2, w3"), (1, "w5"), (1, "w5"), (2, None), (3, "nothing here"), (4, "é É"), (None, "w7 w8 " * 40)]
    assert ranking(ranked_search.ranked_documents(docs_of(docs), items_of(spark, items))) == brute_ranking(docs, items)


def test_ranking_of_empty_tables(spark, docs_of):
    assert ranked_search.ranked_documents(docs_of([]), items_of(spark, [(1, "a")])).count() == 0
    assert ranked_search.ranked_documents(docs_of([(1, "a")]), items_of(spark, [])).count() == 0


def test_partial_sums_stay_exact(spark, docs_of):
    """One word so often that weight x impact passes 2**53 is dealt over several products."""
    docs = [(1, "rare " * 3), (2, "other words"), (3, "other")] + [(i, "other") for i in range(4, 40)]
    items = [(1, "rare " * 5_000_000 + "other")]
    assert ranking(ranked_search.ranked_documents(docs_of(docs), items_of(spark, items))) == brute_ranking_of_counts(docs, {1: {"rare": 5_000_000, "other": 1}})
    weights, counts = np.array([4000, 3]), [Counter({0: 5_000_000, 1: 1})]
    tiles = ranked_search._word_tiles(weights, counts)
    assert len(tiles) > 1
    for words, entries in tiles:
        assert ranked_search._dense(words, entries, 1).sum() * ranked_search.MOST_IMPACT < ranked_search.EXACT
    assert sum(int(e[:, 2].sum()) for _, e in tiles) == 4000 * 5_000_000 + 3


def brute_ranking_of_counts(docs, items):
    """Like brute_ranking, with the items given as counted terms."""
    once = {i: brute_ranking(docs, [(i, t)]) for i, times in items.items() for t in times}
    assert once
    total = Counter()
    for i, times in items.items():
        for term, count in times.items():
            for _, _, doc_id, score in brute_ranking(docs, [(i, term)], top=10**9):
                total[i, doc_id] += count * score
    rows = []
    for i in items:
        own = sorted(((-s, d) for (j, d), s in total.items() if j == i))[:20]
        rows += [(i, n, d, -s) for n, (s, d) in enumerate(own, start=1)]
    return sorted(rows, key=repr)


# --- line deduplication ------------------------------------------------------------------------


def brute_lines(rows, length=20, least=3):
    def key(line):
        return line.strip(SPACE).translate(LOWER)

    holders = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= length:
                holders[key(line)].add(doc_id)
    last = {k: max((d for d in ids if d is not None), default=None) for k, ids in holders.items() if len(ids) >= least}
    found = Counter()
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if key(x) not in last or last[key(x)] == doc_id]
        digest = hashlib.sha256("\n".join(kept).encode()).hexdigest()
        found[doc_id, len(lines), len(lines) - len(kept), digest] += 1
    return found


def test_lines_equal_brute_force(docs_of):
    draw = random.Random(5)
    pool = [f"  Line number {n} of the common pool \t" for n in range(30)] + ["short", "", "x" * 19, "é" * 20, "É" * 20, "ab\r" * 9]
    rows = [(i, "\n".join(draw.choice(pool).upper() if draw.random() < 0.2 else draw.choice(pool) for _ in range(draw.randrange(1, 40)))) for i in range(60)]
    rows += [(i, f"A line that every document has, hot\nown {i}\n") for i in range(100, 300)]
    rows += [(900, None), (901, ""), (902, "\n"), (903, "x" * 300_000 + "\n" + pool[0]), (None, pool[1] + "\n" + pool[2]), (None, pool[1]), (5, pool[3]), (5, pool[3])]
    rows += [(904, "\n".join(f"a long text with very many lines, {n % 700}" for n in range(20_000)))]
    found = line_dedup.line_digests(docs_of(rows)).collect()
    assert Counter(tuple(r) for r in found) == brute_lines(rows)


def test_lines_keep_rows_and_columns(docs_of):
    rows = [(i, "the very same line of text\nrest") for i in (3, 1, 2)]
    found = {r.doc_id: r for r in line_dedup.without_repeated_lines(docs_of(rows)).collect()}
    assert [found[i].text for i in (1, 2, 3)] == ["rest", "rest", "the very same line of text\nrest"]
    assert [found[i].n_dropped for i in (1, 2, 3)] == [1, 1, 0] and found[1].comp == "x"
    assert line_dedup.line_digests(docs_of([])).count() == 0
    few = docs_of(rows[:2])
    assert {r.n_dropped for r in line_dedup.without_repeated_lines(few).collect()} == {0}
    assert {r.n_dropped for r in line_dedup.without_repeated_lines(few, least_documents=2).collect()} == {0, 1}
