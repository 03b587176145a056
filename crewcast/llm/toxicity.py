"""Toxicity: noisy-channel restoration of disguised words, then a word model of the restored text.

Channel: a token is a lattice of look-alike characters (fixed list), separators between letters,
letters spaced apart and repeated letters. Viterbi finds the most probable spelling under a
four-gram character model with shorter orders behind it, counted over the words of all documents.
A plain word has one path only and is its own restoration; a token of digits only is a number.

Score: a text sums the log-likelihood ratios of the model's words it holds, and a logistic curve
fitted on the training rows turns the sum into a probability. The words are selected among the
restored words of the labelled training rows: LIFT times as frequent in toxic texts, with a
log-likelihood statistic of at least SIGNIFICANCE. Equal texts count once. Everything the model
gathers is aggregated by Spark; the driver gets the counts of all distinct n-grams (16 bytes each,
so they grow with the corpus's spellings), the selected words and at most SUMS distinct sums.

Skeletons: a word's letters as classes of what look-alikes confuse, equal neighbours once. The
restoration of a token holds a word only if the token's skeleton holds the word's, so texts are
scored by decoding only tokens whose skeleton holds one of the model's words. A mark that may stand
for a letter or for none is left out of both, together with the letters it may stand for.
"""

from __future__ import annotations

import itertools
import math
import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from crewcast.llm.words import REMEMBERED_WORDS, WORD_GAP, slices
from crewcast.sources.shared_storage import fresh_path, written

ORDER = 4
SIGNIFICANCE, LIFT, LEAST_TEXTS = 20.0, 10.0, 4
#: A sum counts up to CEILING in steps of 0.1, so the curve is fitted to SUMS points at most.
CEILING = 20.0
SUMS = int(CEILING * 10) + 1
THRESHOLD = 0.7
#: Labelled rows the word model is fitted on at most: those of the smallest hash of their id. So
#: few ids are sent to all tasks, and no text is shuffled to meet its label.
MOST_LABELLED = 40_000

# Characters that stand for letters.
LOOKALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "¢": "c", "(": "c", "*": "aeiou", "#": "h",
}
# Characters put between letters.
SEPARATORS = ".-_*~'`^,:;/\\ "

# Costs in natural logarithms of the channel.
_PLAIN, _SWAP, _DROP, _BREAK, _SHORTEN, _ODD = 0.0, -1.0, -0.5, -3.0, -1.5, -12.0

_EDGE = ".,;:!?\"'()[]{}…»«"
_WIDE_EDGE = _EDGE + "%&$*#|<>+-=_~^@/\\0123456789"
#: Words taken apart: single characters, or pieces of one or two, with any white space between.
_SPACED = (re.compile(rb"\x01{3,}"), re.compile(rb"[\x01\x02]{3,}"))
_RUN = re.compile(r"(.)\1*", re.DOTALL)
#: What is no letter, and doubled letters: what has more than the plain path.
_DISGUISE = re.compile(r"[\W\d_]")
_DOUBLED = re.compile(r"([^\W\d_])\1")


_FACTOR, _MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


class Grams(NamedTuple):
    """Counts of distinct n-grams of all orders by their 64-bit keys, sorted by key."""

    keys: np.ndarray
    counts: np.ndarray


def _slots(codes: list[np.ndarray]) -> np.ndarray:
    """The 64-bit key of the n-gram spelled by aligned arrays of character codes."""
    total = np.full(len(codes[0]), len(codes), np.uint64)
    for code in codes:
        total = (total ^ code.astype(np.uint64)) * np.uint64(_FACTOR)
        total ^= total >> np.uint64(29)
    return total.view(np.int64)


def _slot(gram: str) -> int:
    """_slots of one n-gram."""
    total = len(gram)
    for char in gram:
        total = (total ^ ord(char)) * _FACTOR & _MASK
        total ^= total >> 29
    return total - (total >> 63 << 64)


def _gram_rows(batches):
    """word, n -> slot, n. Three marks (code 0) stand before a word; the one after it counts."""
    for batch in batches:
        words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
        kept = [n for n, w in enumerate(words) if w.isalpha()]
        if not kept:
            continue
        text = "".join("\0\0\0" + words[n] for n in kept) + "\0"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        sizes = np.array([len(words[n]) + 1 for n in kept])
        begins = np.cumsum(sizes + 2) - sizes + 1
        places = np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        weights = np.repeat(counts[kept], sizes).astype(np.float64)
        for order in range(1, ORDER + 1):
            grams = [codes[places - n] for n in range(order - 1, -1, -1)]
            keys, which = np.unique(_slots(grams), return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.bincount(which, weights))], names=["slot", "n"])


def character_counts(docs: DataFrame) -> Grams:
    """Counts of all distinct character n-grams over the words of all texts."""
    spark = docs.sparkSession
    words = (
        docs.select(F.explode(F.split(F.lower("text"), WORD_GAP)).alias("word"))
        .filter("word <> ''")
        .groupBy("word")
        .agg(F.count("*").alias("n"))
    )
    grams = words.mapInArrow(_gram_rows, "slot bigint, n double").groupBy("slot").agg(F.sum("n").alias("n"))
    rows = written(grams.select("slot", F.col("n").cast("double").alias("n")), fresh_path(spark, "grams")).toArrow()
    keys = rows.column("slot").to_numpy()
    order = np.argsort(keys)
    return Grams(keys[order], rows.column("n").to_numpy()[order])


class Spelling:
    """The character model and the decoder."""

    def __init__(self, table: Grams) -> None:
        self.table = table
        self.total = max(float(table.counts.sum(dtype=np.float64)) / ORDER, 1.0)
        self.words = self._count("\0")
        self.known: dict[tuple[str, str], float] = {}

    def _count(self, gram: str) -> float:
        key = _slot(gram)
        at = int(self.table.keys.searchsorted(key))
        return float(self.table.counts[at]) if at < len(self.table.keys) and self.table.keys[at] == key else 0.0

    def log_probability(self, history: str, char: str) -> float:
        """log P(char | three characters before), each order interpolated with the next shorter."""
        key = (history, char)
        if (value := self.known.get(key)) is None:
            share = (self._count(char) + 0.5) / (self.total + 64)
            for size in range(1, ORDER):
                before = history[-size:]
                both = self._count(before + char)
                seen = self._count(before) if before.strip("\0") else self.words
                share = (both + 4.0 * share) / (max(seen, both) + 4.0)
            if len(self.known) > REMEMBERED_WORDS:
                self.known.clear()
            value = self.known[key] = math.log(share)
        return value

    def restore(self, token: str) -> str:
        """The best spelling; words are separated by a space.

        The state is carried over the whole token. A path is its last piece and the path before;
        where all paths have met, what they spell is settled.
        """
        settled: list[str] = []
        paths: dict[str, tuple[float, tuple | None]] = {"\0\0\0": (0.0, None)}
        for run in _RUN.finditer(token):
            choices = _choices(run.group(1), len(run.group(0)))
            if len(paths) == len(choices) == 1 and choices[0][0] != " ":  # nothing to weigh
                piece = choices[0][0]
                settled.append(piece)
                paths = {(next(iter(paths)) + piece)[-3:]: (0.0, None)}
                continue
            after: dict[str, tuple[float, tuple | None]] = {}
            for piece, cost in choices:
                for history, (score, spelled) in paths.items():
                    total, past = score + cost, history
                    if piece == " " and past == "\0\0\0":
                        continue
                    for char in piece:
                        if char == " ":
                            total += self.log_probability(past, "\0")
                            past = "\0\0\0"
                        else:
                            total += self.log_probability(past, char)
                            past = past[1:] + char
                    if past not in after or total > after[past][0]:
                        after[past] = (total, (spelled, piece))
            paths = after or paths
            if len(paths) == 1:
                ((history, (_, spelled)),) = paths.items()
                settled += _pieces(spelled)
                paths = {history: (0.0, None)}
        best = max(((s + self.log_probability(h, "\0"), "".join(_pieces(t))) for h, (s, t) in paths.items()))[1]
        return ("".join(settled) + best).strip()


def _pieces(path: tuple | None) -> list[str]:
    found = []
    while path is not None:
        path, piece = path
        found.append(piece)
    return found[::-1]


def _spaced_runs(tokens: list[str]) -> set[str]:
    """Runs of words taken apart, in lower case with one blank between the pieces."""
    sizes = bytes(map(min, map(len, tokens), itertools.repeat(3)))
    return {" ".join(tokens[m.start() : m.end()]).lower() for pattern in _SPACED for m in pattern.finditer(sizes)}


def _choices(char: str, count: int) -> list[tuple[str, float]]:
    """What a run of one character may stand for, with the channel's cost."""
    found: list[tuple[str, float]] = []
    if char.isalpha():
        found.append((char * min(count, 2), _PLAIN if count < 3 else _SHORTEN))
        if count > 1:
            found.append((char, _SHORTEN))
    for letter in LOOKALIKES.get(char, ""):
        found.append((letter, _SWAP))
        if count > 1:
            found.append((letter * 2, _SWAP + _SHORTEN))
    if char in SEPARATORS:
        found += [("", _DROP), (" ", _BREAK)]
    return found or [("", _ODD)]


def _classes() -> dict[int, str | None]:
    """Letters that one look-alike may stand for, and the look-alike, by one letter of them."""
    group: dict[str, str] = {}
    for letters in LOOKALIKES.values():
        joined = {c for c, name in group.items() if name in {group.get(x, x) for x in letters}} | set(letters)
        group.update(dict.fromkeys(joined, min(joined)))
    marks = {mark: group[letters[0]] for mark, letters in LOOKALIKES.items()}
    return {ord(c): name for c, name in {**group, **marks}.items()}


_CLASS = _classes()
_AGAIN = re.compile(r"(.)\1+", re.DOTALL)
#: Marks that stand for a letter or for none, and _CLASS without the letters they may stand for.
_EITHER = re.compile("[" + re.escape("".join(sorted(set(LOOKALIKES) & set(SEPARATORS)))) + "]")
_BARE = {c: None if name in {_CLASS[ord(m)] for m in set(LOOKALIKES) & set(SEPARATORS)} else name for c, name in _CLASS.items()}


def skeleton(token: str, classes: dict[int, str | None]) -> str:
    """The classes of the letters a lower-case token may stand for, equal neighbours once."""
    found = token.translate(classes)
    return _AGAIN.sub(r"\1", found if found.isalpha() else "".join(filter(str.isalpha, found)))


class _Skeletons:
    """Tells whether the restoration of a token could hold one of the words."""

    def __init__(self, words: Iterable[str]) -> None:
        spelled = [w for w in words if w.isalpha()]  # others are never spelled by the decoder
        self.full, self.bare = (self._starts(spelled, classes) for classes in (_CLASS, _BARE))

    @staticmethod
    def _starts(words: list[str], classes: dict[int, str | None]) -> tuple[list[str], dict[str, tuple[str, ...]]]:
        """Skeletons of less than two classes, and all by their first two classes."""
        starts: dict[str, set[str]] = {}
        for found in (skeleton(w, classes) for w in words):
            starts.setdefault(found[:2], set()).add(found)
        return [x for x in starts if len(x) < 2], {start: tuple(sorted(found)) for start, found in starts.items()}

    def may_hold(self, token: str) -> bool:
        classes, (short, starts) = (_BARE, self.bare) if _EITHER.search(token) else (_CLASS, self.full)
        found = skeleton(token, classes)
        if any(start in found for start in short):
            return True
        for at in range(len(found) - 1):
            if (words := starts.get(found[at : at + 2])) and found.startswith(words, at):
                return True
        return False


def _readings(token: str, restore: Callable[[str], Iterable[str]]) -> tuple[str, ...]:
    """The words a token may be read as: as written without its edges, and restored."""
    low = (token if token.isascii() else unicodedata.normalize("NFKC", token)).lower()
    core = low.strip(_EDGE)
    words = (core, low.strip(_WIDE_EDGE))
    if core and not core.isdigit():
        if _DISGUISE.search(core) or _DOUBLED.search(core):
            words = (*words, *restore(core))
        if low[0] in "!(":  # a mark, or the first letter
            words = (*words, *restore(low.rstrip(_EDGE)))
    return tuple(dict.fromkeys(w for w in words if w))


class _Restored(dict):
    """Token as written -> its restored words."""

    def __init__(self, spelling: Spelling) -> None:
        super().__init__()
        self.spelling = spelling

    def restore(self, token: str) -> list[str]:
        return self.spelling.restore(token).split(" ")

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        value = self[token] = _readings(token, self.restore)
        return value


def restored_words(text: str, cache: _Restored) -> set[str]:
    """The distinct restored words of a text, those spelled with spaced letters included."""
    found: set[str] = set()
    tokens = text.split()
    for words in set(map(cache.__getitem__, tokens)):
        found.update(words)
    for run in _spaced_runs(tokens):
        found.update(cache.restore(run))
    found.discard("")
    return found


class _Marked(dict):
    """Token as written -> the model's words in it; nearly always none."""

    def __init__(self, spelling: Spelling, words: dict[str, float]) -> None:
        super().__init__()
        self.spelling, self.words, self.skeletons = spelling, words, _Skeletons(words)

    def restore(self, token: str) -> list[str]:
        """The model's words in the restoration."""
        if not self.skeletons.may_hold(token):
            return []
        return [w for w in self.spelling.restore(token).split(" ") if w in self.words]

    def __missing__(self, token: str) -> tuple[str, ...]:
        if len(self) > REMEMBERED_WORDS:
            self.clear()
        core = token.strip(_EDGE).lower()
        if core.isascii() and core.isalpha() and token[0] not in "!(" and not _DOUBLED.search(core):  # one reading
            value = self[token] = (core,) if core in self.words else ()
        else:
            value = self[token] = tuple(w for w in _readings(token, self.restore) if w in self.words)
        return value


class ToxicityModel(NamedTuple):
    name: str
    table: Grams
    words: dict[str, float]
    slope: float
    base: float


#: What this Python worker remembers of the model it used last.
_worker: dict[str, _Marked] = {}


def _marked(model: ToxicityModel) -> _Marked:
    if model.name not in _worker:
        _worker.clear()
        _worker[model.name] = _Marked(Spelling(model.table), model.words)
    return _worker[model.name]


def _word_rows(table: Grams):
    def rows(batches):
        cache = _Restored(Spelling(table))
        for whole in batches:
            for batch in slices(whole, "text"):
                found = [sorted(restored_words(t or "", cache)) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["toxic", "words"])

    return rows


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """toxic, text of MOST_LABELLED labelled rows outside the held-out third, equal texts once.

    A text with both labels counts as toxic.
    """
    learned = labels.filter("toxic in (0, 1) and doc_id is not null").filter("crc32(cast(cast(doc_id as bigint) as string)) % 3 <> 1")
    sample = (
        learned.groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MOST_LABELLED)
    )
    return (
        docs.select("doc_id", "text")
        .filter("text is not null")
        .join(F.broadcast(sample), "doc_id")
        .groupBy("text")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .select("toxic", "text")
    )


def fit_toxicity(docs: DataFrame, labels: DataFrame) -> ToxicityModel:
    """Learns from the labelled training rows; without rows of both classes all scores are the prior."""
    spark = docs.sparkSession
    table = character_counts(docs)
    rows = written(training_rows(docs, labels), fresh_path(spark, "labelled"))
    per_class = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = per_class.get(1, 0), per_class.get(0, 0)
    prior = math.log((toxic + 1) / (clean + 1))
    if not toxic or not clean:
        return ToxicityModel(uuid.uuid4().hex, table, {}, 1.0, prior)
    restored = written(rows.select("toxic", "text").mapInArrow(_word_rows(table), "toxic int, words array<string>"), fresh_path(spark, "restored"))
    counts = (
        restored.select("toxic", F.explode("words").alias("word"))
        .groupBy("word")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
    )
    ratio = F.log((F.col("bad") + 0.5) / (toxic + 1)) - F.log((F.col("good") + 0.5) / (clean + 1))
    share = (F.col("bad") + F.col("good")) / (toxic + clean)
    statistic = 2 * (
        F.col("bad") * F.log(F.col("bad") / (share * toxic)) + F.col("good") * F.log(F.greatest("good", F.lit(0.5)) / (share * clean))
    )
    chosen = (
        counts.filter(F.col("bad") >= LEAST_TEXTS)
        .select("word", ratio.alias("ratio"), statistic.alias("statistic"))
        .filter((F.col("ratio") >= math.log(LIFT)) & (F.col("statistic") >= SIGNIFICANCE))
        .orderBy("word")
        .collect()
    )
    model = ToxicityModel(uuid.uuid4().hex, table, {r["word"]: r["ratio"] for r in chosen}, 1.0, 0.0)
    sums = (
        restored.mapInArrow(_sum_rows(model.words), "toxic int, value double")
        .groupBy("value")
        .agg(F.sum("toxic").alias("bad"), F.sum(1 - F.col("toxic")).alias("good"))
        .toPandas()
    )
    slope, base = _curve(sums["value"].to_numpy(), sums["bad"].to_numpy(float), sums["good"].to_numpy(float))
    return model._replace(slope=slope, base=base)


def _curve(values: np.ndarray, bad: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of a logistic regression with a light ridge, by Newton's method."""
    x = np.stack((values, np.ones(len(values))))
    ridge = np.diag([0.1, 0.01])
    beta = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(beta @ x, -30, 30)))
        slope = x @ (bad - (bad + good) * p) - ridge @ beta
        step = np.linalg.solve((x * ((bad + good) * p * (1 - p))) @ x.T + ridge, slope)
        beta = beta + np.clip(step, -2, 2)
    return float(beta[0]), float(beta[1])


def _weight(words: Iterable[str], weights: dict[str, float]) -> float:
    """The sum of the weights of the distinct words."""
    return round(min(sum(weights[w] for w in sorted(words) if w in weights), CEILING), 1)


def _sum_rows(weights: dict[str, float]):
    def rows(batches):
        for batch in batches:
            sums = [_weight(words, weights) for words in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.float64())], names=["toxic", "value"])

    return rows


def _score_rows(model: ToxicityModel):
    def rows(batches):
        cache = _marked(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                scores = [_score(t or "", cache, model) for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    return rows


def _sum(text: str, cache: _Marked, model: ToxicityModel) -> float:
    found: set[str] = set()
    tokens = text.split()
    for words in set(map(cache.__getitem__, tokens)):
        found.update(words)
    for run in _spaced_runs(tokens):
        found.update(cache.restore(run))
    return _weight(found, model.words)


def _score(text: str, cache: _Marked, model: ToxicityModel) -> float:
    return 1 / (1 + math.exp(-(model.slope * _sum(text, cache, model) + model.base)))


def toxicity_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs.

    Texts without words (null, empty, blank) get the score of a text with none of the model's
    words. A null doc_id has held_out null. Other columns are ignored. Runs jobs while it is built.
    """
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = fit_toxicity(docs, labels)
    return docs.mapInArrow(_score_rows(model), "doc_id bigint, score double").select(
        "doc_id",
        (F.expr("crc32(cast(doc_id as string)) % 3") == 1).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )


def _clean_rows(model: ToxicityModel):
    def rows(batches):
        cache = _marked(model)
        for whole in batches:
            for batch in slices(whole, "text"):
                at = batch.schema.get_field_index("text")
                stays = [_score(t or "", cache, model) < THRESHOLD for t in batch.column(at).to_pylist()]
                yield batch.filter(pa.array(stays, pa.bool_()))

    return rows


def without_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that score below the threshold, with all their columns."""
    names = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = fit_toxicity(names, labels)
    return docs.mapInArrow(_clean_rows(model), docs.schema)
