"""Near-duplicate groups and substring deduplication against brute force."""

import random
from pathlib import Path

import numpy as np
import pytest

from crewcast.llm import components as component_rounds
from crewcast.llm import near_dup, substrings
from crewcast.llm.components import components
from crewcast.llm.fm_index import FmIndex, repeated_spans
from tests.llm.brute import near_groups, substring_rows


def edited(words, share, seed):
    draw = random.Random(seed)
    return [f"e{draw.randrange(10**6)}" if draw.random() < share else w for w in words]


@pytest.fixture(scope="module")
def corpus(prose):
    rows, n = [], 0

    def add(words):
        nonlocal n
        rows.append((n * 7 % 1009, " ".join(words)))
        n += 1

    base = prose(1, 300)
    for k in range(60):  # a graded group around one text
        add(edited(base, 0.002 * k, k))
    for _ in range(30):
        add(base)
    passage = prose(2, 120)
    for k in range(40):  # a passage in otherwise different texts
        own = prose(100 + k, 90)
        add(own[:40] + passage + own[40:])
    loop = prose(3, 7) * 40
    add(loop)
    add(loop + prose(4, 3))
    add(prose(5, 4))
    add(prose(5, 4))
    add(prose(6, 49))
    add(prose(7, 50))
    add(prose(7, 50) + ["tail"])
    rows += [(2000, None), (2001, ""), (2002, " \n\t "), (2003, "one"), (2004, "ONE"), (2005, "é É")]
    return rows


def test_near_groups_match_brute_force(docs_of, corpus):
    result = {r.doc_id: r for r in near_dup.near_duplicates(docs_of(corpus)).collect()}
    assert {d: (r.n_shingles, r.component_id) for d, r in result.items()} == near_groups(corpus)
    assert all(r.kept == (r.doc_id == r.component_id) for r in result.values())


def test_near_groups_with_small_tiles(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(near_dup, "TILE", 5)
    monkeypatch.setattr(near_dup, "TOGETHER", 3)
    result = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(corpus)).collect()}
    assert result == near_groups(corpus)


def test_near_groups_of_odd_rows(docs_of, prose):
    text = " ".join(prose(1, 30))
    rows = [(5, text), (5, text), (3, text), (None, text), (9, None), (None, None), (9, "other words " * 5)]
    result = near_dup.near_duplicates(docs_of(rows)).collect()
    assert len(result) == len(rows)
    assert {(r.doc_id, r.component_id, r.kept) for r in result} == {
        (5, 3, False), (3, 3, True), (None, None, True), (9, 9, True),
    }
    assert near_dup.near_duplicates(docs_of([])).count() == 0
    assert near_dup.without_copies(docs_of(rows)).count() == 5


def test_keys_meet_within_the_radius():
    """Any two signatures that differ in RADIUS symbols share a key."""
    draw = np.random.default_rng(1)
    for _ in range(200):
        one = draw.integers(0, 2**16, near_dup.SYMBOLS, dtype=np.uint16)
        two = one.copy()
        two[draw.permutation(near_dup.SYMBOLS)[: near_dup.RADIUS]] ^= 1
        keys = near_dup.chunk_keys(np.stack((one, two)))
        assert set(keys[0]) & set(keys[1])


def test_components_of_chains_stars_and_loops(spark):
    links = [(n, n + 1) for n in range(1, 40)] + [(100, n) for n in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    found = {r.id: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert {found[n] for n in range(1, 41)} == {1}
    assert {found[n] for n in range(100, 140)} == {100}
    assert found[200] == found[201] == 200


def test_substrings_match_brute_force(docs_of, corpus):
    result = substrings.substring_digests(docs_of(corpus)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result} == substring_rows(corpus)


def test_substrings_of_crowded_anchors(docs_of, corpus, monkeypatch):
    monkeypatch.setattr(substrings, "CROWDED", 5)
    monkeypatch.setattr(substrings, "SHARD_WORDS", 500)
    result = substrings.substring_digests(docs_of(corpus)).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in result} == substring_rows(corpus)


def test_substrings_of_odd_rows(docs_of, prose):
    text = " ".join(prose(1, 60))
    rows = [(1, text), (1, text), (2, text), (None, text), (3, None), (4, "")]
    removed = sorted((r.doc_id or -1, r.n_words, r.n_removed) for r in substrings.substring_digests(docs_of(rows)).collect())
    assert removed == [(-1, 60, 0), (1, 60, 0), (1, 60, 0), (2, 60, 60), (3, 0, 0), (4, 0, 0)]
    assert substrings.substring_digests(docs_of([])).count() == 0
    cut = {r.doc_id: (r.text, r.n_chars) for r in substrings.without_repeats(docs_of(rows)).collect()}
    assert cut == {1: (text, len(text)), 2: ("", 0), None: (text, len(text)), 3: (None, None), 4: ("", 0)}
    assert substrings.without_repeats(docs_of(rows)).columns == docs_of(rows).columns


def test_index_against_plain_search(prose):
    sequences = [prose(n % 5, 70, 30)[n % 3 :] + prose(n, n % 9, 30) for n in range(25)]
    names = {w: i + 1 for i, w in enumerate(sorted({w for s in sequences for w in s}))}
    ids = [np.array([names[w] for w in s] + [0]) for s in sequences]
    lengths = np.array([len(s) for s in sequences])
    text, owners = np.concatenate(ids), np.arange(len(ids))[::-1].copy()
    ends = np.cumsum(lengths + 1) - 1
    index = FmIndex(text, np.repeat(owners, lengths + 1), ends)
    spans = repeated_spans(index, text, ends - lengths, lengths, owners, 20)
    covered = {(int(w), p) for w, a, b in zip(*spans, strict=True) for p in range(a, b + 1)}
    first = {}
    for n, s in enumerate(sequences):
        for i in range(len(s) - 19):
            key = tuple(s[i : i + 20])
            first[key] = min(first.get(key, 99), int(owners[n]))
    wanted = {
        (n, p)
        for n, s in enumerate(sequences)
        for i in range(len(s) - 19)
        if first[tuple(s[i : i + 20])] < owners[n]
        for p in range(i, i + 20)
    }
    assert covered == wanted


def test_texts_are_cut_where_they_meet_their_spans(docs_of, prose, monkeypatch):
    names, write = [], substrings.written
    monkeypatch.setattr(substrings, "written", lambda df, path: names.append(path.split("/")[-1].split("-")[0]) or write(df, path))
    passage, own = " ".join(prose(1, 60)), " ".join(prose(2, 20))
    docs = docs_of([(1, passage), (2, f"{own}  {passage}"), (2, f"{own}  {passage}"), (3, None), (None, passage), (4, " a  b ")])
    found = sorted((str(r["doc_id"]), r["text"], r["n_chars"]) for r in substrings.without_repeats(docs).collect() if r["text"] is not None)
    assert found == sorted(
        [("1", passage, len(passage)), *[("2", own, len(own))] * 2, ("None", passage, len(passage)), ("4", " a  b ", 6)]
    )
    assert "changed" not in names  # no second table of changed texts


def test_few_rows_take_few_files(spark, docs_of, corpus, monkeypatch):
    """Ids, labels and owners are not written once per shuffle partition (finding: pipeline on check_h)."""
    files = {}

    def counted(df, path, write=near_dup.written):
        found = write(df, path)
        name = path.split("/")[-1].rsplit("-", 1)[0]
        files[name] = max(files.get(name, 0), len([*Path(path.removeprefix("file:")).glob("part-*")]))
        return found

    for module in (near_dup, substrings, component_rounds):
        monkeypatch.setattr(module, "written", counted)
    cores, settings = spark.sparkContext.defaultParallelism, {"spark.sql.adaptive.coalescePartitions.enabled": "false"}
    settings["spark.sql.shuffle.partitions"] = str(3 * cores)
    before = {k: spark.conf.get(k) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        result = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dup.near_duplicates(docs_of(corpus)).collect()}
        removed = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_digests(docs_of(corpus)).collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert (result, removed) == (near_groups(corpus), substring_rows(corpus))
    few = {"classes", "nodes", "members", "nearest", "near-links", "links", "labels", "placed", "buckets", "named", "shared-anchors", "owners"}
    assert few <= set(files)
    assert {name: files[name] for name in few if files[name] > cores} == {}
