"""Quality rules and models, toxicity, decontamination and licences."""

import itertools
import random
import textwrap

import numpy as np
import pytest

from crewcast.llm import decontamination, licences, quality_model, quality_rules, toxicity
from tests.llm.brute import base_counts

FOLDER = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return {name: spark.read.parquet(f"{FOLDER}/{name}.parquet") for name in ("documents", "labels", "benchmark")}


ODD = [(1, None), (2, ""), (3, " \n"), (4, "word"), (5, "a b c d e f g h i j k"), (6, "x y z x y " * 400), (7, "same\nsame\n\nsame"), (None, "no id at all")]


def test_rules_count_exactly(tables, docs_of, spark):
    labels = spark.createDataFrame([(5, 1, 0), (None, 1, 1), (9, None, None)], "doc_id long, quality int, toxic int")
    rows = {r.doc_id: r for r in quality_rules.quality_rules(docs_of(ODD), labels).collect()}
    for doc_id, text in ODD:
        r = rows[doc_id]
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts == base_counts(text)
        assert r.base_failed == (counts[0] < 10 or 100 * counts[4] > 20 * counts[0])
        assert not (r.kept and r.base_failed)
    assert quality_rules.quality_rules(docs_of([]), labels).count() == 0


def test_rules_keep_good_texts(tables):
    result = quality_rules.quality_rules(tables["documents"], tables["labels"]).join(tables["labels"], "doc_id").collect()
    texts = {r.doc_id: r.text for r in tables["documents"].collect()}
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base_counts(texts[r.doc_id]) for r in result)
    good = [r for r in result if r.quality == 1 and not r.base_failed]
    bad = [r for r in result if r.quality == 0]
    assert sum(r.kept for r in good) >= 0.98 * len(good)
    assert sum(r.kept for r in bad) <= 0.2 * len(bad)


def test_ratio_against_plain_count(spark, docs_of):
    """With single-word texts the ratio is that of the word's bucket."""
    docs = docs_of([(1, "good"), (2, "bad"), (3, "bad")])
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    ratios = {r.doc_id: r.ratio for r in quality_rules.quality_rules(docs, labels).collect()}
    n = quality_rules.BUCKETS
    assert ratios[1] == pytest.approx(np.log(2 / (n + 1)) - np.log(2 / (n + 3)), abs=1e-8)
    assert ratios[2] == ratios[3] == pytest.approx(np.log(1 / (n + 1)) - np.log(3 / (n + 3)), abs=1e-8)


def test_quality_model_on_held_out_rows(tables):
    result = quality_model.quality_scores(tables["documents"], tables["labels"])
    rows = result.join(tables["labels"], "doc_id").filter("held_out").collect()
    assert len(rows) > 50
    assert sum(r.predicted == r.quality for r in rows) >= 0.95 * len(rows)


def test_quality_model_of_odd_rows(spark, docs_of, tables):
    rows = quality_model.quality_scores(docs_of(ODD), tables["labels"]).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality_model.quality_scores(docs_of(ODD), none).collect()} == {0.5}
    assert quality_model.quality_scores(docs_of([]), none).count() == 0


def test_discriminant_is_the_density_ratio():
    draw = np.random.default_rng(3)
    width = quality_model.STATISTICS
    groups = {0: draw.normal(0, 1, (400, width)), 1: draw.normal(0.7, 2, (600, width))}
    sums = {q: np.hstack((x, np.ones((len(x), 1)))).T @ np.hstack((x, np.ones((len(x), 1)))) for q, x in groups.items()}
    found = quality_model.scores(quality_model.model_of(sums), np.vstack((groups[0], groups[1])))
    assert (found[:400] < 0.5).mean() > 0.95 and (found[400:] > 0.5).mean() > 0.95


@pytest.fixture(scope="module")
def toxic_tables(spark, prose):
    draw = random.Random(5)
    rows, labels = [], []
    for n in range(400):
        words = prose(n, 60, 900)
        toxic = n % 8 == 0
        if toxic:
            words[draw.randrange(60)] = draw.choice(["idiot", "moron"])
        rows.append((n, " ".join(w.replace("w", "re") + "ing" for w in words[:5]) + " " + " ".join(words)))
        labels.append((n, 1, int(toxic)))
    for k, shape in enumerate(["you 1d10t there", "an i.d.i.o.t here", "such a m0rrrron now", "i d i o t again", "the (moron) goes", "IDIOT!!"]):
        rows.append((1000 + k, shape))
    rows += [(2000, "a plain and clean text"), (2001, None), (2002, ""), (2003, "idiom moronic"), (None, "idiot")]
    return rows, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_disguised_words_are_restored_and_scored(docs_of, toxic_tables):
    rows, labels = toxic_tables
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs_of(rows), labels).collect()}
    assert all(found[1000 + k].predicted == 1 for k in range(6))
    assert all(found[d].predicted == 0 for d in (2000, 2001, 2002, 2003))
    assert found[None].predicted == 1 and found[None].held_out is None
    held = [r for d, r in found.items() if d is not None and d < 400 and r.held_out]
    assert all(r.predicted == (r.doc_id % 8 == 0) for r in held)


def test_doubled_letters_and_words_taken_apart(docs_of, toxic_tables):
    rows, labels = toxic_tables
    shapes = [
        "you idiiot there", "an idioot here", "morron", "i  d i\to\nt", "an id io t again", "a " + "x-" * 29 + "idi.ot end",
        " ".join("zyx" * 20 + "idiot"), "-".join("z" * 70) + " m-o-r-o-n",
    ]
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs_of([*rows, *((3000 + k, t) for k, t in enumerate(shapes))]), labels).collect()}
    assert all(found[3000 + k].predicted == 1 for k in range(len(shapes)))
    assert all(found[d].predicted == 0 for d in (2000, 2001, 2002, 2003))


def _all_paths(token, spelling):
    """Every spelling of a token with its probability, by plain enumeration."""
    runs = [(m.group(1), len(m.group(0))) for m in toxicity._RUN.finditer(token)]
    for path in itertools.product(*(toxicity._choices(*run) for run in runs)):
        text = "".join(piece for piece, _ in path)
        if text.startswith(" ") or "  " in text:
            continue
        total = sum(cost for _, cost in path)
        for word in text.split(" "):
            padded = "\0\0\0" + word
            total += sum(spelling.log_probability(padded[n : n + 3], padded[n + 3]) for n in range(len(word)))
        for before in text.split(" "):
            total += spelling.log_probability(("\0\0\0" + before)[-3:], "\0")
        yield total, text


def test_decoder_and_skeletons_against_all_paths(docs_of, prose):
    """The decoder's spelling is a best one, and no spelled word is outside the token's skeleton."""
    docs = docs_of([(n, " ".join(prose(n, 80) + ["idiot", "silly", "settle"])) for n in range(20)])
    spelling = toxicity.Spelling(toxicity.character_counts(docs))
    draw = random.Random(11)
    tokens = ["".join(draw.choice("aeilost0135!|*.-½²•é") for _ in range(draw.randrange(1, 6))) for _ in range(300)]
    for token in [*tokens, "1d10t", "i.d.i.o.t", "s3ttl3"]:
        paths = dict((text, total) for total, text in sorted(_all_paths(token, spelling)))
        if not paths:  # separators alone
            continue
        restored = spelling.restore(token)
        best = max(paths.values())
        assert max(paths.get(restored + end, -1e9) for end in ("", " ")) == pytest.approx(best, abs=1e-9), token
        for text in paths:
            for word in filter(None, text.split(" ")):
                assert toxicity._Skeletons([word]).may_hold(token), (token, word)


def test_skeletons_change_no_sum(docs_of, toxic_tables):
    rows, labels = toxic_tables
    model = toxicity.fit_toxicity(docs_of(rows), labels)
    marked, restored = toxicity._marked(model), toxicity._Restored(toxicity.Spelling(model.table))
    assert model.words
    for _, text in rows:
        held = toxicity.restored_words(text or "", restored) & set(model.words)
        assert toxicity._sum(text or "", marked, model) == round(min(sum(model.words[w] for w in sorted(held)), 20.0), 1)


def test_odd_marks_and_wide_letters(docs_of, toxic_tables):
    rows, labels = toxic_tables
    shapes = ["an i•d•i•o•t here", "an id\u200biot here", "an ｉｄｉｏｔ here", "an idi\u00adot", "z" + "x1|-" * 20_000 + " m0r0n"]
    found = {r.doc_id: r for r in toxicity.toxicity_scores(docs_of([*rows, *((3000 + k, t) for k, t in enumerate(shapes))]), labels).collect()}
    assert all(found[3000 + k].predicted == 1 for k in range(len(shapes)))
    assert all(found[d].predicted == 0 for d in (2000, 2001, 2002, 2003))


def test_toxicity_without_labels_or_rows(spark, docs_of):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in toxicity.toxicity_scores(docs_of(ODD), none).collect()} == {0.5}
    assert toxicity.toxicity_scores(docs_of([]), none).count() == 0
    assert toxicity.without_toxic(docs_of(ODD), none).columns == docs_of(ODD).columns


def test_slots_agree():
    gram = "\0ab"
    assert toxicity._slot(gram) == toxicity._slots([np.array([ord(c)]) for c in gram])[0]


def test_strange_spellings_count_nothing_beside_many_others(docs_of):
    """More distinct n-grams than half a million: known ones keep exact counts, strange ones none."""
    draw = random.Random(8)
    words = ["".join(chr(0x4E00 + draw.randrange(20_000)) for _ in range(6)) for _ in range(100_000)]
    docs = docs_of([(n, " ".join([*words[n::500], "plain"])) for n in range(500)])
    spelling = toxicity.Spelling(toxicity.character_counts(docs))
    assert spelling._count("plai") == spelling._count("\0pl") == 500.0
    assert all(spelling._count(w[1:5]) >= 1.0 for w in words[:500])
    strange = ["".join(chr(0xAC00 + draw.randrange(10_000)) for _ in range(4)) for _ in range(500)]
    assert not any(map(spelling._count, strange))


def test_leaks(docs_of, spark, prose):
    item, other = prose(1, 40), prose(2, 12)
    near = item[:20] + ["changed"] + item[21:]
    far = item[:12] + prose(3, 28)
    rows = [
        (1, " ".join(prose(4, 80) + item + prose(5, 80))), (2, " ".join(w.upper() for w in item)), (3, " ".join(prose(6, 30) + near)),
        (4, " ".join(prose(7, 30) + far)), (5, " ".join(item[:37])), (6, " ".join(other)), (7, None), (8, ""), (None, " ".join(item)), (2, "x"),
        (10, " ".join(item[:4])),
    ]
    benchmark = spark.createDataFrame([(1, " ".join(item)), (2, " ".join(other)), (3, None), (4, "too short"), (None, "a b c d e f")], "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.similarity for r in decontamination.contaminated(docs_of(rows), benchmark).collect()}
    assert found == {(1, 1): 1.0, (2, 1): 1.0, (3, 1): pytest.approx(31 / 41), (5, 1): pytest.approx(33 / 36), (6, 2): 1.0, (None, 1): 1.0}
    kept = {r.doc_id for r in decontamination.without_leaks(docs_of(rows), benchmark).collect()}
    assert kept == {4, 7, 8, None, 10}
    assert decontamination.contaminated(docs_of([]), benchmark).count() == 0
    assert decontamination.contaminated(docs_of(rows), benchmark.limit(0)).count() == 0


def test_leaks_without_broadcast(docs_of, spark, prose, monkeypatch):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", 0)
    benchmark = spark.createDataFrame([(1, " ".join(prose(1, 40)))], "item_id long, text string")
    found = decontamination.contaminated(docs_of([(1, " ".join(prose(1, 40) * 2))]), benchmark).collect()
    assert [(r.doc_id, r.similarity) for r in found] == [(1, 1.0)]


def test_licences(docs_of):
    mit = next(text for name, text in licences.TEMPLATES if name == "MIT" and len(text) > 200)
    rows = [
        (1, "some prose\nReleased under the MIT License."), (2, "This program mentions no terms at all"), (3, mit.upper().replace(" ", "\n", 1)),
        (4, "Licensed under CC BY-NC 4.0."), (5, None), (6, ""), (7, "license"), (4, "released under the mit license"), (None, "All rights reserved."),
    ]
    found = {(r.doc_id, r.licence): (r.dice, r.whole_text) for r in licences.licence_matches(docs_of(rows)).collect()}
    assert found[1, "MIT"] == (1.0, False) and found[4, "CC-BY-NC-4.0"] == (1.0, True) and found[4, "MIT"] == (1.0, True)
    assert found[3, "MIT"][0] == 1.0 and found[None, "Proprietary"] == (1.0, True)
    assert {d for d, _ in found} == {1, 3, 4, None}
    assert licences.licence_matches(docs_of([])).count() == 0


def test_licences_at_the_threshold(docs_of):
    """Dice exactly 0.8 with sizes 3 : 2 and 2 : 3."""
    rows = [(1, "2024 All rights reserved."), (2, "All rights reserved worldwide."), (3, "All rights reserved")]
    found = {(r.doc_id, r.licence, r.dice) for r in licences.licence_matches(docs_of(rows[:2])).collect()}
    assert {(1, "Proprietary"), (2, "Proprietary")} == {x[:2] for x in found} and min(x[2] for x in found) >= 0.8
    longer = licences.licence_matches(docs_of(rows), [("Longer", "All rights reserved worldwide.")]).collect()
    assert (3, "Longer", 0.8) in {(r.doc_id, r.licence, r.dice) for r in longer}


def test_wrapped_notices_inside_longer_texts(docs_of, prose):
    mit = next(text for name, text in licences.TEMPLATES if name == "MIT" and len(text) > 200)
    before, after = " ".join(prose(1, 300)), " ".join(prose(2, 300))
    wrapped = "\n * ".join(textwrap.wrap(mit, 78))
    rows = [
        (1, f"{before}\n\n{wrapped}\n\n{after}"), (2, f"{before}\n{wrapped}\n{after}"), (3, f"{before} {wrapped} {after}"),
        (4, f"{before}\nof the Software and to the\n{after}"),
    ]
    found = {(r.doc_id, r.licence): (r.dice, r.whole_text) for r in licences.licence_matches(docs_of(rows)).collect()}
    assert found == {(n, "MIT"): (1.0, False) for n in (1, 2, 3)}


def test_trusted_ids_are_not_sent_to_all_tasks(docs_of, spark):
    docs = docs_of([(1, "good text"), (2, "other"), (1, "good again"), (None, "no id")])
    labels = spark.createDataFrame([(1, 1), (1, 1), (2, 0), (None, 1)], "doc_id long, quality int")
    trusted = quality_rules.trusted_texts(docs, labels)
    assert sorted(r["text"] for r in trusted.collect()) == ["good again", "good text"]
    plan = trusted._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
