"""Text columns: stripping, cleaning, comparison keys, titles, question terms."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# Every code point that Python's str.isspace() accepts, so that stripping removes
# no-break spaces and tabs too (Spark's plain trim removes only the space).
WHITESPACE = "".join(chr(cp) for cp in range(0x3001) if chr(cp).isspace())

# The same characters as a pattern; plain ranges are much faster than Unicode classes.
_SPACE_RUN = r"[\x09-\x0d\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+"

# Texts that stand for a missing value.
MISSING_TEXTS = ("nan", "none", "nat")

# Words that carry no technology in a skill question.
SKILL_STOP_WORDS = (
    "consultant", "consultants", "employee", "employees", "experience",
    "experienced", "find", "has", "have", "know", "knows", "me", "show",
    "skill", "skills", "someone", "who", "with",
)

# Punctuation around a word of a skill question.
TERM_PUNCTUATION = "?,.!:;()[]{}"

NEW_CONVERSATION = "New conversation"


def strip(col: Column) -> Column:
    return F.btrim(col, F.lit(WHITESPACE))


def text_or_empty(col: Column) -> Column:
    """Null becomes the empty string, everything else is stripped text."""
    return strip(F.coalesce(col.cast("string"), F.lit("")))


# Anything but printable ASCII, a double space, or a space at an end: only such texts need work.
_UNTIDY = r"[^ -~]|  |\A | \z"


def _collapsed(col: Column) -> Column:
    return F.regexp_replace(strip(col), _SPACE_RUN, " ")


def collapse_spaces(col: Column) -> Column:
    return F.when(col.rlike(_UNTIDY), _collapsed(col)).otherwise(col)


def clean_text(col: Column) -> Column:
    """Text with single spaces; null and the missing-value words become ''."""
    text = col.cast("string")
    missing = r"\A(?i:" + "|".join(MISSING_TEXTS) + r")\z"
    return (
        F.when(text.rlike(_UNTIDY), F.regexp_replace(_collapsed(text), missing, ""))
        .when(text.isNull() | F.lower(text).isin(*MISSING_TEXTS), F.lit(""))
        .otherwise(text)
    )


def null_if_blank(col: Column) -> Column:
    return F.nullif(strip(col.cast("string")), F.lit(""))


@lru_cache(maxsize=1)
def _casefolds() -> tuple[dict[str, str], dict[str, str]]:
    """Characters that case folding changes: into one character, and into several."""
    folds = {chr(cp): chr(cp).casefold() for cp in range(sys.maxunicode + 1) if not 0xD800 <= cp < 0xE000}
    changed = {ch: fold for ch, fold in folds.items() if fold != ch}
    return (
        {ch: fold for ch, fold in changed.items() if len(fold) == 1},
        {ch: fold for ch, fold in changed.items() if len(fold) > 1},
    )


def _replace_characters(text: Column, single: dict[str, str], several: dict[str, str]) -> Column:
    """Each character by its replacement; the longer ones only in texts that hold such a character."""
    # One parsed expression: hundreds of single literals would be built one by one on the driver.
    expansions = F.expr("map(" + ", ".join(f"'{x}'" for pair in several.items() for x in pair) + ")")
    expanded = F.array_join(
        F.transform(F.split(text, ""), lambda ch: F.coalesce(F.try_element_at(expansions, ch), ch)),
        "",
    )
    has_several = text.rlike("[" + "".join(several) + "]")
    return F.translate(F.when(has_several, expanded).otherwise(text), "".join(single), "".join(single.values()))


# ASCII, signs of Latin-1 and general punctuation (dashes, quotes): folding them is lowering them.
_PLAIN = r"\A[\x00-\xb4\xb6-\xbf\u2000-\u206f]*\z"


def casefold(col: Column) -> Column:
    """Caseless comparison form: full Unicode case folding, character by character."""
    return F.when(col.rlike(_PLAIN), F.lower(col)).otherwise(_replace_characters(col, *_casefolds()))


def simple_name_key(col: Column) -> Column:
    return F.lower(strip(col.cast("string")))


def known_text(col: Column) -> Column:
    """Cleaned text, null when nothing is left."""
    return F.nullif(clean_text(col), F.lit(""))


def labelled(label: str, value: Column) -> Column:
    """'label: value', or null when the cleaned value is empty."""
    return F.concat(F.lit(f"{label}: "), known_text(value))


@lru_cache(maxsize=1)
def _ascii_residues() -> tuple[dict[str, str], dict[str, str]]:
    """What compatibility decomposition leaves of each non-ASCII character in [a-z0-9].

    First dict: characters that leave one letter or digit; second: those that leave several.
    """
    single: dict[str, str] = {}
    several: dict[str, str] = {}
    for cp in range(0x80, sys.maxunicode + 1):
        ch = chr(cp)
        decomposed = unicodedata.normalize("NFKD", ch)
        if decomposed == ch and not ch.lower().isascii():
            continue
        kept = re.sub(
            "[^a-z0-9]",
            "",
            "".join(c for c in decomposed if not unicodedata.combining(c)).lower(),
        )
        if kept:
            (single if len(kept) == 1 else several)[ch] = kept
    return single, several


def name_key(col: Column) -> Column:
    """Accent- and punctuation-free key: decompose, drop marks, lower, keep [a-z0-9].

    Dropping everything outside [a-z0-9] makes the key a per-character mapping, so one
    translate() covers it; the few characters that expand to several letters (ligatures,
    fractions) go through a map only in the rows that contain one.
    """
    text = F.coalesce(col.cast("string"), F.lit(""))
    folded = _replace_characters(text, *_ascii_residues())
    ascii_only = text.rlike(r"\A[\x00-\x7f]*\z")
    return F.regexp_replace(
        F.lower(F.when(ascii_only, text).otherwise(folded)), "[^a-z0-9]+", ""
    )


def normalised_column_name(name: str) -> str:
    return re.sub("[^a-z0-9]", "", str(name).lower())


def _shorten(text: Column, limit: int) -> Column:
    cut = F.rtrim(F.substring(text, 1, limit - 1), F.lit(WHITESPACE))
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(cut, F.lit("…")))


def conversation_title(message: Column, limit: int = 60) -> Column:
    return _shorten(collapse_spaces(message), limit)


def clean_title(title: Column, limit: int = 120) -> Column:
    collapsed = collapse_spaces(F.coalesce(title, F.lit("")))
    return F.when(collapsed == "", F.lit(NEW_CONVERSATION)).otherwise(_shorten(collapsed, limit))


def whitespace_words(col: Column) -> Column:
    """array<string> of the words between whitespace runs."""
    return F.filter(F.split(collapse_spaces(col), " "), lambda w: w != "")


def skill_terms(question: Column) -> Column:
    """Lower-cased words of a question longer than two characters, minus the stop words."""
    words = F.transform(
        whitespace_words(question), lambda w: F.lower(F.btrim(w, F.lit(TERM_PUNCTUATION)))
    )
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*SKILL_STOP_WORDS))


def skill_list(col: Column) -> Column:
    """Comma-separated text → array of non-blank skills; null → empty array."""
    parts = F.transform(F.split(F.coalesce(col, F.lit("")), ","), strip)
    return F.filter(parts, lambda s: s != "")


def truthy(col: Column) -> Column:
    """Whether a text or number says yes: any number but 0, or one of the words for it."""
    text = F.lower(strip(col.cast("string")))
    number = text.try_cast("double")
    return F.when(number.isNotNull(), number != 0).otherwise(text.isin("true", "yes", "active"))


def optional_int(col: Column) -> Column:
    """An integer or null for a blank text; any other text fails the query."""
    text = null_if_blank(col)
    number = text.try_cast("int")
    bad = F.concat(F.lit("not an integer: "), text)
    return F.when(text.isNotNull() & number.isNull(), F.raise_error(bad).cast("int")).otherwise(number)


def document_id(consultant: Column, section: Column, chunk_number: Column) -> Column:
    return F.sha2(F.concat_ws("|", consultant, section, chunk_number.cast("string")), 256)


def contains_any(col: Column, terms: tuple[str, ...]) -> Column:
    """Literal substring test for any of the terms."""
    test = F.lit(False)
    for term in terms:
        test = test | col.contains(term)
    return test
