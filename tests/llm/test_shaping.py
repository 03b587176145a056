"""Packing, preference formatting, HTML text and the pipeline."""

import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from crewcast.llm import packing
from crewcast.llm.html_text import html_texts, page_text
from crewcast.llm.preferences import preferences


def check_packed(rows, texts):
    """Each document's pieces are whole, cut only above the capacity, and places are gapless."""
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    tokenizer.encode_special_tokens = True
    wanted = Counter()
    for doc_id, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        for piece, start in enumerate(range(0, len(ids), 4096)):
            part = np.array(ids[start : start + 4096], "<u4")
            wanted[doc_id, piece, start, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == wanted
    places = defaultdict(list)
    for r in rows:
        places[r.sequence_id].append((r.offset, r.length))
    for held in places.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096
    return len(places)


def test_packing_of_odd_texts(docs_of):
    texts = [
        (1, None), (2, ""), (3, "Hello, World! it's <|endoftext|> 3.14 naïve ŉ İ ǰ ΣΑΣ 日本語 é don't\x1cstop x"),
        (4, "word " * 9000), (4, "word " * 9000), (None, "no id"), (5, "ÉCOLE. Straße, ﬁ!?"),
    ]
    rows = packing.packed(docs_of(texts)).collect()
    check_packed(rows, texts)
    assert packing.packed(docs_of([])).count() == 0


def test_packing_of_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = packing.packed(docs).collect()
    used = check_packed(rows, [(r.doc_id, r.text) for r in docs.collect()])
    assert used <= 1.02 * -(-sum(r.length for r in rows) // 4096) + 1


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece(seed):
    draw = np.random.default_rng(seed)
    lengths = draw.integers(1, 4097, 3000) if seed else np.repeat([4096, 2049, 1365, 1], [50, 7, 90, 3])
    histogram = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
    groups = packing.plan_groups(histogram)
    placed = Counter()
    for group in groups:
        assert sum(n * t for n, t in group.parts) <= 4096
        for length, times in group.parts:
            placed[length] += times * group.count
    assert placed == histogram
    large = sum(c for n, c in histogram.items() if n > 2048)
    least = max(large, -(-int(lengths.sum()) // 4096))
    assert sum(g.count for g in groups) <= 1.03 * least + 3


def test_plan_without_pieces():
    assert packing.plan_groups({}) == []


def test_knapsack_finds_the_best_value():
    sizes, values = np.array([3, 5, 7]), np.array([3.0, 6.0, 8.0])
    pattern = packing.best_pattern(values, sizes, np.array([9, 9, 9]), 13)
    assert sum(values[n] * t for n, t in pattern.items()) == 15.0


def test_preferences(spark):
    turns = [
        (1, 0, "system", "Be kind."), (1, 1, "user", "Hi"), (1, 2, "assistant", "Hello"), (1, 3, "user", "Bye"), (1, 4, "assistant", "See you"),
        (2, 0, "system", "Be kind."), (2, 1, "user", "Hi"), (2, 2, "assistant", "What?"), (2, 2, "assistant", "What?"),
        (3, 0, "system", "Be kind."), (3, 1, "user", "Hi"), (4, None, None, None), (None, 0, "user", "lost"),
    ]
    table = spark.createDataFrame([(*t, "extra") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    pairs = spark.createDataFrame([(1, 2), (1, 2), (1, 3), (4, 1), (1, 1), (1, 99), (None, 2)], "chosen_id long, rejected_id long")
    found = {(r.chosen_id, r.rejected_id): r for r in preferences(pairs, table).collect()}
    assert set(found) == {(1, 2), (1, 3), (4, 1)}
    r = found[1, 2]
    assert r.shared_turns == 2 and r.prompt == "<|system|>\nBe kind.<|end|>\n<|user|>\nHi<|end|>\n"
    assert r.chosen == "<|assistant|>\nHello<|end|>\n<|user|>\nBye<|end|>\n<|assistant|>\nSee you<|end|>\n"
    assert [r.chosen[a:b] for a, b in r.chosen_spans] == ["Hello<|end|>\n", "See you<|end|>\n"]
    assert [r.rejected[a:b] for a, b in r.rejected_spans] == ["What?<|end|>\n"]
    assert found[1, 3].rejected == "" and found[1, 3].rejected_spans == []
    assert found[4, 1].shared_turns == 0 and found[4, 1].chosen == "<||>\n<|end|>\n"
    assert preferences(pairs.limit(0), table).count() == 0


CASES = {
    "<p>one<p>two <i>i</i>n<br>line": "one\n\ntwo in\nline",
    "<ul><li>a<li>b<ul><li>c</ul><li>d</ul>e": "- a\n- b\n  - c\n- d\n\ne",
    "<ol><li>x</li><li>y</li></ol>": "1. x\n2. y",
    "<table><tr><th>N<th>Value<tr><td>long<td>1</table>z": "N    | Value\nlong | 1\n\nz",
    "a<div hidden>no<p>no</div>b<span style='display:none'>no</span>c": "abc",
    "<script>if (a<b) x=\"</p>\";</script>t<style>p{}</style><!-- c -->u": "tu",
    "<pre>  a\n   b</pre>": "  a\n   b",
    "1 &lt; 2 &amp; 3 < 4 > 3": "1 < 2 & 3 < 4 > 3",
    "<title>no</title>yes<p title=\"a>b\">x": "yes\n\nx",
    "": "",
    "</p></div>": "",
    "<table><tr><td>広い<td>x<tr><td>abc<td>y</table>": "広い | x\nabc  | y",
    "unfinished <a href=\"x": "unfinished",
    "<td>loose</td><li>item": "loose\n- item",
}


@pytest.mark.parametrize("page", CASES)
def test_page_text(page):
    assert page_text(page) == CASES[page]


SEEN = {
    "<p>a <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>tex</annotation></math> b": "a x=2 b",
    "a<svg><title>no</title><desc>no</desc><defs><text>no</text></defs><path d='M0'/><text>one</text><text>two</text></svg>b": "a\none\ntwo\nb",
    "a<textarea>one &amp;\n  <b>two</textarea>b": "a\none &\n  <b>two\nb",
    "a<select><option>one<option selected>two<option>three</select>b": "a two b",
    "a<select><option disabled>one</option><option>two</option></select>b": "a two b",
    "a <select multiple><option>one<option>two</select> b": "a one two b",
    "a<datalist><option>no</datalist>b": "ab",
    "a <span aria-hidden='true'>*</span> b": "a * b",
    "a <select hidden><option selected>no</select><textarea style='display:none'>no</textarea> b": "a b",
}


@pytest.mark.parametrize("page", SEEN)
def test_seen_text_of_forms_drawings_and_formulas(page):
    assert page_text(page) == SEEN[page]


def test_many_unclosed_selections_end():
    assert page_text("<select><option>x" * 20_000).split() == ["x"] * 20_000


def test_long_and_deep_pages_end():
    assert page_text("<div>" * 50_000 + "x" + "<ul><li>" * 20_000 + "y").count("\n") == 2
    assert page_text('<a "' * 20_000) == "" and page_text("<" * 50_000) == "<" * 50_000


def test_pages_take_linear_time_and_bounded_room():
    begun = time.monotonic()
    assert page_text("<p>a<button>" + "<div>" * 40_000 + "x").split() == ["a", "x"]
    assert page_text("<table><tr><td>" + "<div>" * 40_000 + "x" + "</p>" * 20_000).split() == ["x"]
    assert time.monotonic() - begun < 10
    wide = "<table><tr><td>" + "w" * 20_000 + "<td>b" + "<tr><td>a<td>b" * 3000 + "</table>"
    assert len(page_text(wide)) < 3 * len(wide)


def test_spanning_cells_and_numbered_lists():
    page = "<table><tr><th rowspan=2>k<th colspan='2'>wide<tr><td>b<td>c<tr><td>d<td>e<td>f</table>"
    assert page_text(page).split("\n") == ["k | wide |", "  | b    | c", "d | e    | f"]
    page = '<ol start="3"><li>c<li value=9>i<li>j</ol><ol start=x><li>a</ol><ol start=-1><li>m<li>z</ol>'
    assert [line for line in page_text(page).split("\n") if line] == ["3. c", "9. i", "10. j", "1. a", "-1. m", "0. z"]
    assert page_text("<table><tr><td colspan=0 rowspan=0>a<td colspan=99999999>b<tr><td>c</table>").startswith("a | b")


def test_pages_table(spark):
    rows = [(1, "u", "<p>a", 1), (None, None, None, 2), (2, "u", "", 3), (2, "u", "", 3)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    assert sorted(map(str, html_texts(table).collect())) == sorted(
        [
            "Row(page_id=1, url='u', text='a')", "Row(page_id=None, url=None, text=None)",
            "Row(page_id=2, url='u', text='')", "Row(page_id=2, url='u', text='')",
        ]
    )
    assert html_texts(table.limit(0)).count() == 0


def test_pipeline_stages(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "substring_dedup", "decontamination", "packing"]
    for _, stage in corpus_pipeline.STAGES[1:4]:
        kept = stage(spark, docs, folder)
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= docs.count()
