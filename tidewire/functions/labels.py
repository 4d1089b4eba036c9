"""Labels, percentages, dates and display texts."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.text import as_col


def code_name(code, names: dict, default=None) -> Column:
    """Display name of a code; an unknown code shows itself unless a default is given."""
    table = F.create_map(*[F.lit(x) for x in chain(*names.items())])
    return F.coalesce(F.element_at(table, as_col(code)), F.lit(default) if default is not None else as_col(code))


def sentiment_label(value) -> Column:
    """positive / neutral / negative from either spelling; anything else is neutral."""
    value = F.lower(F.trim(F.coalesce(as_col(value), F.lit(""))))
    out = None
    for label, local in ko.SENTIMENT_NAMES.items():
        test = value.isin(label, local)
        out = F.when(test, label) if out is None else out.when(test, label)
    return out.otherwise("neutral")


def sentiment_in(column, wanted: str) -> Column:
    """Match a label in either spelling."""
    for label, local in ko.SENTIMENT_NAMES.items():
        if wanted in (label, local):
            return as_col(column).isin(label, local)
    return as_col(column) == wanted


def half_even_percent(part, total) -> Column:
    """Whole percent, half to even; 0 if there is nothing to divide by."""
    share = as_col(part).cast("double") * 100 / F.nullif(as_col(total), F.lit(0))
    return F.coalesce(F.bround(share, 0).cast("bigint"), F.lit(0).cast("bigint"))


def percent_label(count, percent) -> Column:
    return F.when((as_col(count) > 0) & (as_col(percent) == 0), F.lit("<1%")).otherwise(
        F.concat(as_col(percent).cast("string"), F.lit("%"))
    )


def dominant_label(positive, neutral, negative) -> Column:
    """Largest of the three; equal values keep the order positive, neutral, negative."""
    p, n, g = as_col(positive), as_col(neutral), as_col(negative)
    return F.when((p >= n) & (p >= g), "positive").when(n >= g, "neutral").otherwise("negative")


def opinion_sentence(topic, positive, neutral, negative) -> Column:
    """One sentence on the leading opinion; a second voice is named from 20 percent on."""
    p, n, g = as_col(positive), as_col(neutral), as_col(negative)
    first = dominant_label(p, n, g)
    second = (
        F.when(first == "positive", F.when(n >= g, "neutral").otherwise("negative"))
        .when(first == "neutral", F.when(p >= g, "positive").otherwise("negative"))
        .otherwise(F.when(p >= n, "positive").otherwise("neutral"))
    )
    share = F.when(second == "positive", p).when(second == "neutral", n).otherwise(g)
    key = F.concat_ws("/", first, F.when(share >= 20, second).otherwise(""))
    subject = F.coalesce(F.nullif(as_col(topic), F.lit("")), F.lit(ko.DEFAULT_TOPIC))
    texts = {f"{a}/{b or ''}": t for (a, b), t in ko.OPINION_SENTENCES.items()}
    template = F.element_at(F.create_map(*[F.lit(x) for x in chain(*texts.items())]), key)
    return F.replace(template, F.lit("%s"), subject)


def base_date_label(ts, prefix: str = "기준일") -> Column:
    return F.concat_ws(" ", F.lit(prefix), F.date_format(as_col(ts), "yyyy.MM.dd"))


def clock_label(ts) -> Column:
    return F.coalesce(F.date_format(as_col(ts), "HH:mm"), F.lit("-"))


def stay_text(seconds) -> Column:
    whole = F.floor(as_col(seconds)).cast("bigint")
    return F.format_string("%d시간 %d분", F.floor(whole / 3600), F.floor((whole % 3600) / 60))


def binary_label(value) -> Column:
    """1 / 0 / NULL from the accepted spellings."""
    text = F.lower(F.trim(as_col(value).cast("string")))
    return F.when(text.isin(*ko.BINARY_TRUE_LABELS, "1.0"), 1).when(text.isin(*ko.BINARY_FALSE_LABELS, "0.0"), 0)


def naive_time(text) -> Column:
    """Wall-clock time of an ISO text: an offset at the end is dropped, not applied."""
    bare = F.regexp_replace(as_col(text), r"(Z|[+-]\d{2}:?\d{2})$", "")
    return F.try_to_timestamp(F.regexp_replace(bare, "T", " "))
