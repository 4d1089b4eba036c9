"""Keyword expressions.

A keyword text is normalised as a whole and split once, and the tests on a word are plain predicates, so that
after an explode they stay inside generated code; lambdas over arrays would not.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.text import as_col, strip, wide


def _joined(value, is_array: bool) -> Column:
    """One comma text; a comma inside an array element is no separator and is dropped."""
    if not is_array:
        return as_col(value)
    return F.array_join(F.transform(as_col(value), lambda w: F.replace(w, F.lit(","), F.lit(""))), ",")


def _pieces(text: Column) -> Column:
    """Trimmed non-empty pieces of a comma text; NULL if there is none."""
    tight = F.regexp_replace(text, wide(r"\s*,[\s,]*"), ",")
    return F.split(F.nullif(F.regexp_replace(tight, wide(r"^[\s,]+|[\s,]+$"), ""), F.lit("")), ",")


def keyword_list(value, is_array: bool = False) -> Column:
    """Comma text or array of words, as an array of trimmed non-empty words."""
    return F.coalesce(_pieces(_joined(value, is_array)), F.array().cast("array<string>"))


def ends_with_any(word, endings) -> Column:
    if not endings:
        return F.lit(False)
    return as_col(word).rlike("(?:" + "|".join(re.escape(e) for e in endings) + r")\z")


def part_of_any(word, parts) -> Column:
    hit = F.lit(False)
    for part in parts:
        hit = hit | F.contains(as_col(word), F.lit(part))
    return hit


def is_metric_keyword(bare, pack: TextPack = KOREAN) -> Column:
    """A cleaned keyword is fit for counting: two characters or more, no number, stopword, verb form or address."""
    bare = as_col(bare)
    return ~(
        (F.length(bare) < 2)
        | bare.rlike(wide(r"^\d+$"))
        | bare.isin(*pack.metric_stopwords)
        | ends_with_any(bare, pack.metric_endings)
        | F.contains(bare, F.lit("@"))
    )


def metric_keyword(word, pack: TextPack = KOREAN) -> Column:
    """The cleaned keyword, or NULL if it is not fit for counting (H8)."""
    bare = strip(F.translate(F.lower(strip(word)), pack.metric_marks, ""))
    return F.when(is_metric_keyword(bare, pack), bare)


def metric_words(keywords, pack: TextPack = KOREAN, is_array: bool = False) -> Column:
    """Distinct cleaned words of one article; explode it and keep :func:`is_metric_keyword` (H8)."""
    marks = pack.metric_marks.replace(",", "")
    return F.array_distinct(_pieces(F.translate(F.lower(_joined(keywords, is_array)), marks, "")))


def is_top_issue_keyword(word, pack: TextPack = KOREAN) -> Column:
    """A lower-case word may become the issue of the day (H9)."""
    word = as_col(word)
    digits = F.length(F.regexp_replace(word, wide(r"[^\d]"), ""))
    return (
        (F.length(word) > 1) & ~word.isin(*pack.top_issue_stopwords)
        & ~part_of_any(word, pack.top_issue_banned_parts) & (digits * 2 < F.length(word))
    )


def top_issue_words(keywords, is_array: bool = False) -> Column:
    """Lower-case words of one article, repeats kept."""
    return _pieces(F.lower(_joined(keywords, is_array)))


def is_valid_keyword(word, pack: TextPack = KOREAN, min_length: int = 2) -> Column:
    """Long enough, no digit, has a letter, no stopword, no short native word outside the allowed list,
    not verb-like; Latin words always pass the last test (H10)."""
    word = as_col(word)
    latin = word.rlike("^[a-zA-Z]+$")
    short_native = (F.length(word) <= 2) & word.rlike(f"^[{pack.script}]{{1,2}}$")
    usual = (
        (F.length(word) >= min_length)
        & ~word.isin(*pack.keyword_stopwords)
        & ~F.lower(word).isin(*pack.keyword_stopwords)
        & (~short_native | word.isin(*pack.keyword_short_allowed))
    )
    # what a Latin word always fulfils is not asked of it
    return usual & (latin | (~word.rlike(wide(r"\d")) & word.rlike(r"\p{L}") & ~word.rlike(pack.verb_like_ending)))


def word_role(word, pack: TextPack = KOREAN) -> Column:
    """Place of a word in a title: subject 0, time 1, issue or unknown 2, direction 3."""
    word = as_col(word)
    return (
        F.when(word.isin(*pack.roles["subject"]), 0)
        .when(word.isin(*pack.roles["time"]), 1)
        .when(word.isin(*pack.roles["direction"]), 3)
        .otherwise(2)
    )
