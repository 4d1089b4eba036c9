"""URL filter: given host rules first, then rules that FP-growth mines from labelled URLs."""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.session import durable

BLOCKED = "label=block"


def host_of(url: Column) -> Column:
    """What stands between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty without one."""
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://([^/?#]*)", 1)
    return F.translate(rest, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; empty without ``://``."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def url_tokens(host: str = "host", path: str = "path") -> Column:
    """Distinct tokens: every host label, every suffix of the host by whole labels, path words without digits."""
    labels = f"split({host}, '[.]')"
    suffixes = f"transform(sequence(1, size({labels})), i -> concat('host:', array_join(slice({labels}, i, size({labels}) - i + 1), '.')))"
    parts = f"transform(filter(split({path}, '[^\\\\p{{L}}]+'), w -> w <> ''), w -> concat('path:', lower(w)))"
    return F.expr(f"array_distinct(concat(transform({labels}, w -> concat('label:', w)), {suffixes}, {parts}))")


def fitting_rule(rules: list[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """Struct ``rule, verdict`` of the longest given rule (host + path prefix) that fits; null if none does or none is given."""
    out = None if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        rule_host, slash, rest = text.partition("/")
        fits = ((F.col(host) == rule_host) | F.endswith(F.col(host), F.lit("." + rule_host))) & F.startswith(F.col(path), F.lit(slash + rest))
        value = F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def mine_rules(labelled: DataFrame, min_support: float, min_confidence: float) -> DataFrame:
    """Rules ``antecedent, confidence, support`` that conclude "block", from rows ``tokens, block``.

    A rule goes when a rule over fewer of its tokens is as confident: the shorter one matches all it matches.
    """
    items = F.when(F.col("block"), F.array_append("tokens", F.lit(BLOCKED))).otherwise(F.col("tokens"))
    baskets = durable(labelled.filter(F.size("tokens") > 0).select(items.alias("items")))
    found = FPGrowth(itemsCol="items", minSupport=min_support, minConfidence=min_confidence).fit(baskets).associationRules
    rules = durable(found.filter(F.col("consequent")[0] == BLOCKED).select(F.array_sort("antecedent").alias("antecedent"), "confidence", "support"))
    # Shorter rules of a rule share its first or a later token; the join is on single tokens of the longer one.
    short = rules.select(F.col("antecedent").alias("short"), F.col("confidence").alias("short_confidence"), F.col("antecedent")[0].alias("token"))
    long = rules.withColumn("token", F.explode("antecedent"))
    beaten = long.join(short, "token").filter(
        (F.size("short") < F.size("antecedent")) & (F.size(F.array_except("short", "antecedent")) == 0) & (F.col("short_confidence") >= F.col("confidence"))
    )
    return rules.join(beaten.select("antecedent").distinct(), "antecedent", "left_anti")


def match_rules(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The distinct ``url`` values of rows ``url, tokens`` that some rule matches, through an inverted index.

    Every rule stands in the index under its rarest token only, so a token that all URLs share brings no rule to them.
    """
    wanted = rules.select(F.explode("antecedent").alias("token")).distinct()
    spread = urls.select("url", "tokens", F.explode("tokens").alias("token"))
    frequency = spread.join(wanted, "token", "left_semi").groupBy("token").agg(F.count("*").alias("n"))
    keyed = rules.withColumn("token", F.explode("antecedent")).join(frequency, "token")
    index = keyed.groupBy("antecedent").agg(F.min_by("token", F.struct("n", "token")).alias("token"))
    return spread.join(index, "token").filter(F.size(F.array_except("antecedent", "tokens")) == 0).select("url").distinct()


def url_filter(
    pages: DataFrame,
    labelled: DataFrame,
    given: list[tuple[str, str]],
    min_support: float = 0.002,
    min_confidence: float = 0.5,
    id_column: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict, mined``.

    ``labelled`` has rows ``url, block``; null URLs or labels teach nothing. The longest given rule decides; without
    one a page is blocked exactly when a mined rule matches (``mined``). A null URL, or one without ``://``, has empty
    host and path, no rule and no token, and is allowed. Repeated URLs are matched once; repeated rows stay rows.
    """
    parts = pages.select(F.col(id_column).alias("page_id"), F.col(url).alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    taught = labelled.filter("url IS NOT NULL AND block IS NOT NULL").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rules = mine_rules(taught.filter("host <> ''").select(url_tokens().alias("tokens"), "block"), min_support, min_confidence)
    rules = durable(rules)
    distinct = parts.filter("host <> ''").select("url", "host", "path").distinct().select("url", url_tokens().alias("tokens"))
    hit = match_rules(distinct, rules).withColumn("mined", F.lit(True))
    judged = parts.join(hit, "url", "left").withColumn("mined", F.coalesce("mined", F.lit(False))).withColumn("fit", fitting_rule(given))
    verdict = F.coalesce(F.col("fit.verdict"), F.when(F.col("mined"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", F.col("fit.rule").alias("rule"), verdict.alias("verdict"), "mined")
