"""Text expressions: cleaning, sentences, scores. Everything is a Column, so it runs inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions.packs import KOREAN, TextPack


def as_col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def wide(pattern: str) -> str:
    """Give a pattern Unicode character classes and Unix line ends (the Python meaning of \\s, \\w, ., $)."""
    return "(?Ud)" + pattern


def strip(text) -> Column:
    """Remove Unicode whitespace at both ends."""
    return F.regexp_replace(as_col(text), wide(r"^\s+|\s+$"), "")


def drop_patterns(text, patterns, replacement: str = " ") -> Column:
    """Apply removals one after another; each result is the input of the next."""
    out = as_col(text)
    for pattern in patterns:
        find, put = pattern if isinstance(pattern, tuple) else (pattern, replacement)
        out = F.regexp_replace(out, wide(find), put)
    return out


def any_match(text, patterns) -> Column:
    hit = F.lit(False)
    for pattern in patterns:
        hit = hit | as_col(text).rlike(wide(pattern))
    return hit


def words_of(text) -> Column:
    """Whitespace words, without empty ones."""
    return F.filter(F.split(as_col(text), wide(r"\s+")), lambda w: w != "")


def word_array(words) -> Column:
    """A constant array; one literal that is split once, as thousands of single literals are slow to build."""
    if not words:
        return F.array().cast("array<string>")
    return F.split(F.lit("\x1f".join(words)), "\x1f")


def clean_article(text, pack: TextPack = KOREAN) -> Column:
    """Remove broadcast endings, bylines, credits, captions and marks, then drop stopword tokens (H1)."""
    words = words_of(drop_patterns(F.coalesce(as_col(text), F.lit("")), pack.article_patterns))
    return F.array_join(F.filter(words, lambda w: ~w.isin(*pack.article_stopwords)), " ")


def banned_names(author) -> Column:
    """The author's name as written, without spaces, without the byline word, and without both."""
    name = F.coalesce(strip(author), F.lit(""))
    bare = F.replace(name, F.lit(KOREAN.byline_word), F.lit(""))
    forms = F.array(name, F.replace(name, F.lit(" "), F.lit("")), strip(bare), F.replace(strip(bare), F.lit(" "), F.lit("")))
    return F.filter(F.array_distinct(forms), lambda n: n != "")


def article_tokens(text, author=None, pack: TextPack = KOREAN, tokenizer=None) -> Column:
    """Distinct nouns in reading order (H2). ``tokenizer`` maps a text Column to an array Column and may be
    a pandas UDF around a morphological analyser; the default takes runs of letters and digits."""
    cleaned = drop_patterns(F.coalesce(as_col(text), F.lit("")), pack.token_patterns)
    tokens = tokenizer(cleaned) if tokenizer else F.regexp_extract_all(cleaned, F.lit(wide(r"\w+")), 0)
    banned = banned_names(author) if author is not None else F.array().cast("array<string>")

    def keep(word):
        ok = (F.length(word) > 1) & ~word.isin(*pack.article_stopwords)
        ok = ok & ~F.exists(banned, lambda n: F.contains(word, n))
        for part in pack.token_banned_parts:
            ok = ok & ~F.contains(word, F.lit(part))
        for ending in pack.token_banned_endings:
            ok = ok & ~F.endswith(word, F.lit(ending))
        return ok

    return F.array_distinct(F.filter(tokens, keep))


def clean_body(text, pack: TextPack = KOREAN) -> Column:
    return strip(drop_patterns(text, pack.body_patterns))


def clean_scope_title(title, pack: TextPack = KOREAN) -> Column:
    return strip(drop_patterns(title, pack.scope_title_patterns))


def clean_credit_title(title, pack: TextPack = KOREAN) -> Column:
    return strip(F.regexp_replace(drop_patterns(title, pack.credit_title_patterns), wide(r"\s+"), " "))


def clean_token(token, pack: TextPack = KOREAN) -> Column:
    """URL, address, number and symbol removal inside one token; NULL if nothing is left (H7)."""
    cleaned = strip(F.regexp_replace(drop_patterns(token, pack.token_clean_patterns), wide(r"\s+"), " "))
    return F.nullif(cleaned, F.lit(""))


def rule_text(text, pack: TextPack = KOREAN) -> Column:
    """Drop tags and bylines, then replace synonyms in their given order (H5)."""
    out = drop_patterns(F.coalesce(as_col(text), F.lit("")), pack.rule_text_patterns, "")
    for word, meaning in pack.rule_text_synonyms:
        out = F.replace(out, F.lit(word), F.lit(meaning))
    return out


def model_text(title, body, body_limit: int | None = None) -> Column:
    """Title twice, then the body; ``body_limit`` cuts it to the input size of a model."""

    def tidy(value):
        squeezed = F.regexp_replace(F.coalesce(as_col(value), F.lit("")), wide(r"\s+"), " ")
        bare = F.regexp_replace(squeezed, wide(r"\[[^\]]*\]|\([^)]*\)|#\S+"), " ")
        return strip(F.regexp_replace(bare, wide(r"\s+"), " "))

    whole = tidy(body)
    return strip(F.concat_ws(" ", tidy(title), tidy(title), F.substring(whole, 1, body_limit) if body_limit else whole))


# --- sentences -----------------------------------------------------------------------------------


def split_sentences(text, min_length: int = 15, pack: TextPack | None = None) -> Column:
    """Sentences of at least ``min_length`` characters; with a pack, noise sentences are dropped."""
    parts = F.transform(F.split(strip(text), wide(r"(?<=[.!?])\s+")), strip)
    keep = lambda s: F.length(s) >= min_length
    if pack is not None:
        keep = lambda s: (F.length(s) >= min_length) & ~any_match(s, pack.noise_patterns)
    return F.filter(parts, keep)


def natural_trim(text, limit: int = 70, pack: TextPack = KOREAN) -> Column:
    """Within ``limit`` unchanged; else cut after the last particle inside the limit, else hard, with an ellipsis."""
    text = as_col(text)
    head = F.substring(text, 1, limit)
    at_particle = F.regexp_extract(head, f"(?s)^(.*[{pack.trim_particles}])", 1)
    cut = F.concat(F.coalesce(F.nullif(at_particle, F.lit("")), head), F.lit("…"))
    return F.when(F.length(text) <= limit, text).otherwise(cut)


def script_ratio(text, script: str) -> Column:
    text = as_col(text)
    return F.length(F.regexp_replace(text, f"[^{script}]", "")) / F.length(text)


def is_caption(text, pack: TextPack = KOREAN) -> Column:
    return any_match(text, pack.caption_patterns)


def is_meta(text, pack: TextPack = KOREAN) -> Column:
    return any_match(text, pack.meta_patterns)


def is_quote(text, pack: TextPack = KOREAN) -> Column:
    return any_match(text, pack.quote_patterns)


def is_valid_sentence(text, pack: TextPack = KOREAN, min_length: int = 20, min_ratio: float = 0.4) -> Column:
    text = as_col(text)
    return (
        (F.length(text) >= min_length)
        & (script_ratio(text, pack.script) >= min_ratio)
        & ~is_caption(text, pack)
        & ~is_meta(text, pack)
        & ~text.rlike(wide(pack.image_source_pattern))
    )


def fact_score(text, pack: TextPack = KOREAN) -> Column:
    hits = sum((as_col(text).rlike(wide(p)).cast("int") for p in pack.fact_patterns), F.lit(0))
    return F.least(hits * F.lit(0.05), F.lit(0.15))


def economy_score(text, pack: TextPack = KOREAN) -> Column:
    hits = F.size(F.filter(word_array(pack.economy_words), lambda w: F.contains(as_col(text), w)))
    return F.least(hits * F.lit(0.05), F.lit(0.10))


def keyword_overlap_penalty(text, keywords) -> Column:
    hits = F.size(F.filter(F.coalesce(as_col(keywords), F.array().cast("array<string>")), lambda k: F.contains(as_col(text), k)))
    return -F.least(hits * F.lit(0.03), F.lit(0.10))


# --- rule-text predicates ------------------------------------------------------------------------


def occurrences(text, word) -> Column:
    """Non-overlapping occurrences of a non-empty word (H32); bytes are counted, as no character need be decoded for that."""
    text, word = as_col(text), word if isinstance(word, Column) else F.lit(word)
    return ((F.octet_length(text) - F.octet_length(F.replace(text, word, F.lit("")))) / F.octet_length(word)).cast("int")


def contains_any(text, words) -> Column:
    """True if some word of the list occurs in the text."""
    if not words:
        return F.lit(False)
    return F.exists(word_array(words), lambda w: F.contains(as_col(text), w))


def _overlaps_itself(word: str) -> bool:
    return any(word[:k] == word[-k:] for k in range(1, len(word)))


def _near_patterns(anchors, words, window: int) -> list:
    """Regular expressions of which one matches exactly if a word lies in the window of an anchor."""
    quote = lambda w: "\\Q" + w + "\\E"
    some = "(?:" + "|".join(quote(a) for a in anchors) + ")"
    out = []
    for size in sorted({len(w) for w in words}):
        if size <= window:  # the word stands wholly before or after the anchor
            same = "(?:" + "|".join(quote(w) for w in words if len(w) == size) + ")"
            gap = f".{{0,{window - size}}}"
            out += [same + gap + some, some + gap + same]
    for a in anchors:
        for w in words:
            if w in a:
                out.append(quote(a))
            out += [quote(w) for o in range(len(w) - len(a) + 1) if w[o : o + len(a)] == a and max(o, len(w) - o - len(a)) <= window]
            for k in range(1, min(len(a), len(w))):  # the word shares k characters with an end of the anchor
                if len(w) - k <= window:
                    out += [quote(w + a[k:])] * (w[-k:] == a[:k]) + [quote(a + w[k:])] * (a[-k:] == w[:k])
    return list(dict.fromkeys(out))


def near(text, anchors, words, window: int) -> Column:
    """Some word lies inside ``window`` characters around an anchor occurrence.

    Whether a word stands before, after or across an anchor is known from the lists alone, so one regular expression
    decides, asked only of texts that hold an anchor and a word at all. Anchors that can overlap themselves count without
    overlaps and take the slower way over positions."""
    if not anchors or not words:
        return F.lit(False)
    text = as_col(text)
    plain = [a for a in anchors if not _overlaps_itself(a)]
    patterns = _near_patterns(plain, words, window) if plain else []
    hit = text.rlike("(?s)" + "|".join(patterns)) if patterns else F.lit(False)
    tricky = [a for a in anchors if _overlaps_itself(a)]
    hit = hit | _near_positions(text, tricky, words, window) if tricky else hit
    return contains_any(text, anchors) & contains_any(text, words) & hit


def _near_positions(text: Column, anchors, words, window: int) -> Column:
    marks, sought = word_array(anchors), word_array(words)

    def around(anchor):
        # a piece ends where an anchor occurrence starts
        pieces = F.split(text, F.concat(F.lit(r"\Q"), anchor, F.lit(r"\E")), -1)
        starts = F.aggregate(
            F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))),
            F.struct(F.lit(1).alias("next"), F.array().cast("array<int>").alias("at")),
            lambda acc, piece: F.struct(
                (acc["next"] + F.length(piece) + F.length(anchor)).cast("int").alias("next"),
                F.concat(acc["at"], F.array((acc["next"] + F.length(piece)).cast("int"))).alias("at"),
            ),
        )["at"]
        span = lambda i: F.substring(
            text, F.greatest(i - window, F.lit(1)), F.least(i - 1, F.lit(window)) + F.length(anchor) + F.lit(window))
        return F.exists(starts, lambda i: F.exists(sought, lambda w: F.contains(span(i), w)))

    return F.exists(marks, around)


def strip_leading_tag(text) -> Column:
    return F.regexp_replace(as_col(text), wide(r"^\[[^\]]+\]\s*"), "")


def phrase_text(text) -> Column:
    """Lower-case letter/digit runs between single spaces, ready for phrase matching."""
    return F.concat(F.lit(" "), F.trim(F.regexp_replace(F.lower(as_col(text)), wide(r"[^\w]+"), " ")), F.lit(" "))


def suggestion_words(title) -> Column:
    """Title words without ellipses, middle dots, brackets and quotes."""
    spaced = F.translate(as_col(title), "…·", "  ")
    return F.transform(words_of(spaced), lambda w: F.btrim(w, F.lit("[]()\"'‘’“”,.")))
