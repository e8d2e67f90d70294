"""Text expressions. Everything here is a plain column expression."""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from answerloom.functions.binding import let
from answerloom.functions.words import ENGLISH_STOP_WORDS, SPLIT_WORDS

WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"
ALNUM_PATTERN = r"^[\p{L}\p{N}]+$"

# Applied in this order to lower-cased text; each blanks out what a word
# tokeniser would split off, so that white space ends every token.
KEYWORD_RULES = (
    (r"[\[\](){}<>;@#$%&?!*\"`«»“”„‘’]", " "),
    (r"--|\.{2,}|''", " "),
    (r"[,:]([^0-9]|$)", r" $1"),
    (r"[,:]([^0-9]|$)", r" $1"),
    (r"\.+(\s|$)", r" $1"),
    (r"([^' \s])('s|'m|'d|'ll|'re|'ve|n't|')(\s|$)", r"$1 $3"),
)


def text_or_blank(column: Column) -> Column:
    return F.coalesce(column, F.lit(""))


def strip(column: Column) -> Column:
    """Trim every kind of Unicode white space, not only the space character."""
    return F.regexp_replace(column, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")


def corpus_text(title: Column, body: Column) -> Column:
    return F.concat(text_or_blank(title), F.lit(" "), text_or_blank(body))


def question_text(title: Column, body: Column) -> Column:
    return strip(F.concat(text_or_blank(title), F.lit("\n"), text_or_blank(body)))


def space_tokens(column: Column) -> Column:
    """Lower-cased tokens between runs of white space."""
    return F.filter(F.split(F.lower(column), r"(?U)[\s\x1c-\x1f]+"), lambda t: t != "")


def word_tokens(column: Column, stop_words: Sequence[str] = ()) -> Column:
    """Lower-cased words of two or more characters, stop words left out."""
    return without(F.regexp_extract_all(F.lower(column), F.lit(WORD_PATTERN), F.lit(0)), stop_words)


def ascii_tokens(column: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits."""
    return F.regexp_extract_all(F.lower(column), F.lit("[a-z0-9]+"), F.lit(0))


def without(tokens: Column, stop_words: Sequence[str]) -> Column:
    if not stop_words:
        return tokens
    return F.filter(tokens, lambda t: ~t.isin(*stop_words))


def keywords(column: Column, stop_words: Sequence[str] = ENGLISH_STOP_WORDS) -> Column:
    """Alphanumeric tokens of a text, in order, duplicates kept."""
    text = F.lower(text_or_blank(column))
    for pattern, replacement in KEYWORD_RULES:
        text = F.regexp_replace(text, pattern, replacement)
    for word, parts in SPLIT_WORDS.items():
        text = F.regexp_replace(text, rf"\b{word}\b", parts)
    tokens = F.filter(F.split(text, r"(?U)\s+"), lambda t: t.rlike(ALNUM_PATTERN))
    return without(tokens, stop_words)


def shown_tags(column: Column) -> Column:
    return F.replace(text_or_blank(column), F.lit("|"), F.lit(", "))


def matches_tags(words: Column, tags: Column, match: str = "substring") -> Column:
    """Whether any of ``words`` occurs in the tags, as a part of them or as a whole tag."""
    lowered = F.lower(text_or_blank(tags))
    if match == "substring":
        return let(lowered, lambda t: F.exists(words, lambda w: F.contains(t, w)))
    if match == "tag":
        return F.arrays_overlap(words, F.split(lowered, r"\|"))
    raise ValueError(f"unknown tag match: {match}")


def spell_out_braces(column: Column) -> Column:
    # The words that stand for braces.
    opened = F.replace(column, F.lit("{"), F.lit("left curly brace"))
    return F.replace(opened, F.lit("}"), F.lit("right curly brace"))


def double_braces(column: Column) -> Column:
    return F.replace(F.replace(column, F.lit("{"), F.lit("{{")), F.lit("}"), F.lit("}}"))


def boxed_number(column: Column) -> Column:
    """The first boxed number as a double; NULL when there is none or it is malformed."""
    return F.regexp_extract(column, r"\\boxed\{ *([\d.]+) *\}", 1).try_cast("double")


def boxed_choice(column: Column, a: Column, b: Column) -> Column:
    """``b`` when the first boxed letter is B, otherwise ``a``."""
    letter = F.regexp_extract(F.coalesce(column, F.lit("")), r"\\boxed\{(A|B)\}", 1)
    return F.when(letter == "B", b).otherwise(a)


def without_prefix(column: Column, prefix: Column) -> Column:
    """Drop an echoed prompt from the front of a generated text."""
    rest = F.substring(column, F.length(prefix) + 1, F.length(column))
    return F.when(F.startswith(column, prefix), rest).otherwise(column)


class Template:
    """A text with ``{slot}`` places, filled with columns in one or more steps."""

    def __init__(self, text: str, bound: dict[str, Column] | None = None):
        self.text = text
        self.pieces = [(before, slot) for before, slot, _, _ in string.Formatter().parse(text)]
        self.bound = bound or {}

    @property
    def slots(self) -> set[str]:
        return {slot for _, slot in self.pieces if slot is not None}

    def bind(self, **columns: Column) -> "Template":
        return Template(self.text, {**self.bound, **columns})

    def column(self) -> Column:
        """The filled text. Slots that are still open stay as ``{slot}``."""
        parts = []
        for before, slot in self.pieces:
            if before:
                parts.append(F.lit(before))
            if slot is not None:
                parts.append(text_or_blank(self.bound[slot].cast("string")) if slot in self.bound else F.lit("{%s}" % slot))
        return F.concat(*parts)
