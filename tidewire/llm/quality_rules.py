"""Quality rules by distribution divergence: histograms of a text against those of its language, DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.columns import settled
from tidewire.session import durable

SPACE = r"[\x20\x09-\x0D]"

# Very common words, by language.
COMMON_WORDS = {
    "de": ["der", "die", "und", "in", "den", "von", "zu", "das", "mit", "ist", "des", "auf"],
    "en": ["the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "as", "with"],
    "es": ["de", "la", "que", "el", "en", "y", "a", "los", "se", "del", "las", "un"],
    "fr": ["de", "la", "le", "et", "les", "des", "en", "un", "du", "une", "que", "est"],
}
LANGUAGES = sorted(COMMON_WORDS)
BINS = sorted({word for words in COMMON_WORDS.values() for word in words})
#: Character classes, each counted in what the ones before it left over; the last histogram bin takes the rest.
CLASSES = {
    "lower": r"\p{Ll}+",
    "upper": r"\p{Lu}+",
    "space": SPACE + "+",
    "digit": r"\p{Nd}+",
    "mark": r"[.,;:!?'\"()-]+",
    "symbol": r"[#*$%&|<>]+",
}

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A histogram of few items is mostly noise: below these lengths a distance decides nothing.
CHAR_GUARD = 200
WORD_GUARD = 120
MAX_CHAR_DISTANCE = 0.25
MAX_WORD_DISTANCE = 0.25


def _letter(position: int) -> str:
    return chr(ord("0") + position) if position < 10 else chr(ord("A") + position - 10)


def measure(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang", carry: list[str] | None = None) -> DataFrame:
    """Counts and histograms per row: ``doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, chars, commons``
    and, as struct ``rest``, the columns of ``carry``.

    ``chars`` holds the code points by character class, ``commons`` the words equal to each common word and, last, the
    other words. A null text counts as empty (all zero). Rows with equal ids stay rows of their own; other columns of
    the input, whatever their names, are not read.
    """
    rest = [F.struct(*carry).alias("rest")] if carry else []
    rows = docs.select(
        F.col(id_column).alias("doc_id"), F.col(lang).cast("string").alias("lang"), F.coalesce(F.col(text), F.lit("")).alias("text"), *rest
    )
    also = ["rest"] if carry else []
    rows = rows.withColumn("words", F.array_remove(F.split("text", SPACE + "+"), ""))
    names = list(CLASSES)
    left = "text"
    for name in names:
        rows = rows.withColumn(f"no_{name}", F.regexp_replace(left, CLASSES[name], ""))
        left = f"no_{name}"
    bins = ", ".join(f"'{word}'" for word in BINS)
    alphabet = "".join(_letter(k) for k in range(len(BINS)))
    before = ["text", *[f"no_{name}" for name in names]]
    sizes = [F.char_length(a) - F.char_length(b) for a, b in zip(before, before[1:], strict=False)] + [F.char_length(before[-1])]
    rows = rows.select(
        *also,
        "doc_id",
        "lang",
        "words",
        F.size("words").cast("bigint").alias("n_words"),
        F.array(*[s.cast("bigint") for s in sizes]).alias("chars"),
        F.expr("filter(split(text, '\\n'), line -> line rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
        F.expr("CASE WHEN size(words) >= 3 THEN transform(slice(words, 1, size(words) - 2), (w, i) -> xxhash64(w, words[i + 1], words[i + 2])) END").alias("windows"),
        F.expr(
            f"array_join(transform(filter(words, w -> w IN ({bins})), w -> substr('{alphabet}', CAST(array_position(array({bins}), w) AS int), 1)), '')"
        ).alias("codes"),
    )
    # Equal windows lie next to each other once sorted by hash; the words themselves confirm it.
    rows = rows.withColumn(
        "sorted", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i))) END")
    )
    same = "(sorted[{0}].h = x.h AND words[sorted[{0}].i] = words[x.i] AND words[sorted[{0}].i + 1] = words[x.i + 1] AND words[sorted[{0}].i + 2] = words[x.i + 2])"
    starts = (
        f"sort_array(filter(transform(sorted, (x, j) -> IF((j > 0 AND {same.format('j - 1')}) OR (j + 1 < size(sorted) AND {same.format('j + 1')}), x.i, NULL)), i -> i IS NOT NULL))"
    )
    covered = f"aggregate({starts}, struct(0L AS n, -3 AS last), (a, i) -> struct(a.n + least(3, i - a.last) AS n, i AS last)).n"
    counts = [F.char_length("codes") - F.char_length(F.replace("codes", F.lit(_letter(k)))) for k in range(len(BINS))]
    return rows.select(
        *also,
        "doc_id",
        "lang",
        "n_words",
        (sum(F.col("chars")[k] for k in range(len(CLASSES) + 1)) - F.col("chars")[names.index("space")]).alias("word_chars"),
        F.col("chars")[names.index("symbol")].alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint").alias("n_dup_lines"),
        F.coalesce(F.expr(covered), F.lit(0)).cast("bigint").alias("n_repeat_words"),
        "chars",
        F.array(*[c.cast("bigint") for c in counts], F.col("n_words") - F.char_length("codes")).alias("commons"),
    )


def references(measured: DataFrame) -> list[dict]:
    """One row per language with a word list, summed over all documents that state it: ``lang, chars, commons``.

    At most ``len(LANGUAGES)`` rows reach the driver.
    """
    sums = [F.array(*[F.sum(F.col(c)[k]) for k in range(n)]).alias(c) for c, n in (("chars", len(CLASSES) + 1), ("commons", len(BINS) + 1))]
    found = measured.filter(F.col("lang").isin(LANGUAGES)).groupBy("lang").agg(*sums).collect()
    return [row.asDict() for row in sorted(found, key=lambda row: row["lang"])]


def js_distance(counts: str, reference: list[int]) -> Column:
    """Square root of the Jensen-Shannon divergence (base 2) of a count array from a reference; null without counts."""
    total = sum(reference)
    shares = ", ".join(f"{v / total!r}D" for v in reference)
    term = "(IF({0} > 0, {0} * ln({0} / m), 0D))"
    parts = f"zip_with(p, array({shares}), (x, y) -> transform(array((x + y) / 2), m -> {term.format('x')} + {term.format('y')})[0])"
    body = f"sqrt(greatest(0D, aggregate({parts}, 0D, (a, v) -> a + v) / {2 * math.log(2)!r}D))"
    n = f"aggregate({counts}, 0L, (a, v) -> a + v)"
    return F.expr(f"CASE WHEN {n} > 0 THEN transform(array(transform(array({n}), n -> transform({counts}, v -> v / n))[0]), p -> {body})[0] END")


def _own_distance(counts: str, refs: list[dict]) -> Column:
    """Distance from the stated language; a row that states none is held against every reference and takes the nearest."""
    usable = [r for r in refs if sum(r[counts]) > 0]
    if not usable:
        return F.lit(None).cast("double")
    each = {r["lang"]: js_distance(counts, r[counts]) for r in usable}
    nearest = F.least(*each.values()) if len(each) > 1 else next(iter(each.values()))
    out = F.when(F.col("lang").isNull(), nearest)
    for name, distance in each.items():
        out = out.when(F.col("lang") == name, distance)
    return out


def quality_rules(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: the counts of :func:`measure`, both distances, ``base_failed`` and ``kept``.

    A text fails at once with fewer than 50 words or with more than half its words in repeated three-word windows.
    Otherwise it goes when its character classes or its common words lie too far from its language's, unless it is
    shorter than the guard of that test. A language without a reference is not judged (the text stays). The references
    are the sums over all documents; an empty table gives an empty result.
    """
    measured = durable(measure(docs, id_column, text, lang))
    return judged(measured, references(measured)).drop("chars", "commons")


def judged(measured: DataFrame, refs: list[dict]) -> DataFrame:
    """The measured rows with both distances, ``base_failed`` and ``kept``."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    chars_ok = (F.col("word_chars") < CHAR_GUARD) | F.coalesce(F.col("char_distance") <= MAX_CHAR_DISTANCE, F.lit(True))
    words_ok = (F.col("n_words") < WORD_GUARD) | F.coalesce(F.col("word_distance") <= MAX_WORD_DISTANCE, F.lit(True))
    distances = {"char_distance": _own_distance("chars", refs), "word_distance": _own_distance("commons", refs)}
    return measured.withColumns(distances).withColumn("base_failed", failed).withColumn("kept", ~failed & chars_ok & words_ok)


def drop_rejected(docs: DataFrame, id_column: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows that :func:`quality_rules` keeps, with all their columns.

    The histograms are taken twice, for the references and for the verdicts, so that no text is shuffled or stored.
    """
    refs = references(measure(docs, id_column, text, lang))
    return judged(settled(measure(docs, id_column, text, lang, docs.columns)), refs).filter("kept").select("rest.*")
