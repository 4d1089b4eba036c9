"""Rule classifier for the viewpoint of an article.

The words come from the caller as a table (list_name, word); the rules below are data: which lists and places make
a condition, and what a true condition does to the score of a category. Conditions never depend on scores, so every
category is one pass over its own steps.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.fixed import korean as ko
from tidewire.functions.packs import KOREAN, TextPack
from tidewire.functions.text import contains_any, near, occurrences, rule_text, word_array

# --- Fixed values: categories in declaration order, by short key --------------------------------
CATEGORIES = dict(
    gov="정부 책임", corp="기업 책임", ind="개인 책임", ext="외부 책임", mix="복합 책임",
    crit="비판적 태도", worry="우려", exp="기대", praise="성과 예찬",
    simple="단순 전달", cause="원인 분석", result="결과 분석", resp="대응 분석", outlook="전망 분석",
    intr="정부 개입 강조", mkt="시장 자율 강조", world="외부 요인(글로벌)", policy="정책 요인(국내)",
)
TITLE_WEIGHT, BODY_WEIGHT = 3.0, 1.0

# --- Fixed values: what a condition does; (condition, category, operation, value) ---------------
EFFECTS = [
    ("informative", "simple", "add", 2.0), ("informative_neutral", "gov", "add", -1.0),
    ("burden_relief", "worry", "add", -2.0),
    ("promotion_title", "exp", "add", 0.8), ("promotion_title", "praise", "add", 0.3),
    ("labour", "policy", "add", 1.5), ("labour", "resp", "add", 1.2), ("labour_calm", "crit", "mul", 0.75),
    ("company_blame", "corp", "add", 3.0), ("company_failure", "corp", "add", 3.5), ("company_exclusion", "corp", "mul", 0.3),
    ("government_blamed", "gov", "add", 4.0),
    ("government_acts", "gov", "add", -1.0), ("government_acts", "policy", "add", 1.5), ("government_acts", "resp", "add", 1.5),
    ("politics", "gov", "add", -2.0), ("politics", "crit", "add", 1.5), ("politics", "policy", "add", 1.0),
    ("denial_or_claim", "crit", "add", 1.0),
    ("policy_promotion", "gov", "mul", 0.6), ("policy_promotion", "policy", "add", 1.5),
    ("official_blame", "gov", "add", 2.5), ("risky_failure", "gov", "add", 1.2),
    ("failure_title", "gov", "add", 3.5), ("failure_title_loose", "gov", "add", 2.8), ("failure_body", "gov", "add", 2.2),
    ("other_blame", "gov", "add", -2.0), ("other_blame", "corp", "add", 1.0),
    ("enforcement", "gov", "add", -2.0), ("enforcement", "policy", "add", 1.5), ("enforcement", "resp", "add", 1.0),
    ("enforcement_company", "corp", "add", 1.5),
    ("announcement", "gov", "add", -2.0), ("announcement", "policy", "add", 2.0), ("announcement", "resp", "add", 1.0),
    ("government_support", "gov", "add", -1.5), ("government_support", "policy", "add", 1.0),
    ("market_claim", "mkt", "add", 2.0), ("market_claim_normative", "mkt", "add", 2.0), ("market_claim_announced", "mkt", "mul", 0.5),
    ("market_execution", "mkt", "mul", 0.25), ("market_opposition", "mkt", "mul", 0.05),
    ("intervention_claim", "intr", "add", 3.0), ("intervention_denied", "intr", "mul", 0.25),
    ("blame_debate_title", "gov", "add", 6.0),
    ("government_victim", "gov", "add", -1.0), ("government_victim", "corp", "add", 2.0), ("pension_company", "corp", "add", 1.5),
    ("always", "simple", "mul", 0.25), ("always", "simple", "zero_below", 2.0),
    ("bias_negative", "crit", "bias", 1.0), ("bias_negative", "worry", "bias", 1.0), ("bias_negative", "gov", "bias", 0.2),
    ("bias_negative", "corp", "bias", 0.2), ("bias_negative", "exp", "bias", -0.5), ("bias_negative", "praise", "bias", -1.0),
    ("bias_positive", "exp", "bias", 1.0), ("bias_positive", "praise", "bias", 1.0), ("bias_positive", "crit", "bias", -0.5),
    ("bias_positive", "worry", "bias", -0.5),
    ("personal", "ind", "add", 3.0), ("investor_choice", "ind", "add", 2.0),
    ("investor_victim", "ind", "mul", 0.25), ("investor_victim", "resp", "add", 1.0),
    ("fraud", "ind", "mul", 0.3), ("fraud", "corp", "add", 2.0), ("research", "ind", "mul", 0.35),
    ("external_shock", "ext", "add", 2.5), ("external_impact", "ext", "add", 0.8),
    ("mixed", "mix", "add", 2.5), ("mixed_near", "mix", "add", 2.0), ("not_blame", "mix", "mul", 0.05), ("always", "mix", "zero_below", 2.5),
    ("denial", "gov", "mul", 0.03), ("denial", "corp", "mul", 0.2), ("denial", "ind", "mul", 0.2),
    ("claim_only", "gov", "mul", 0.55), ("claim_only", "corp", "mul", 0.75), ("claim_only", "ind", "mul", 0.75),
    ("guidance", "gov", "mul", 0.2), ("guidance", "policy", "add", 0.5),
    ("always", "policy", "mul", 0.72), ("always", "result", "mul", 0.78), ("always", "simple", "mul", 0.72),
    ("always", "praise", "mul", 0.84), ("always", "exp", "mul", 0.86), ("always", "worry", "mul", 0.86),
    ("always", "crit", "mul", 0.9), ("always", "world", "mul", 0.9),
    ("always", "gov", "boost", (1.0, 1.2, 0.8)), ("always", "corp", "boost", (2.5, 1.2, 0.8)), ("always", "ind", "boost", (3.0, 1.2, 0.8)),
    ("always", "ext", "boost", (2.5, 1.2, 0.8)), ("always", "mix", "boost", (2.5, 1.2, 0.8)),
    ("always", "gov", "boost", (2.0, 1.0, 1.2)),
    ("always", "intr", "boost", (2.0, 1.25, 1.0)), ("always", "mkt", "boost", (2.0, 1.25, 1.0)),
]


@dataclass(frozen=True)
class ViewpointWords:
    """Named word lists. Category words sit under the short category key; the names of the context lists are those
    used in :func:`conditions`. A missing list is empty and its conditions stay false."""

    lists: dict

    def __getitem__(self, name: str) -> list:
        return self.lists.get(name, [])


def base_score(words: list, title, body) -> Column:
    """Hits in the title count three times those in the body; a word listed twice counts twice."""
    if not words:
        return F.lit(0.0)
    per_word = F.transform(
        word_array(words), lambda w: occurrences(title, w) * F.lit(TITLE_WEIGHT) + occurrences(body, w) * F.lit(BODY_WEIGHT))
    return F.aggregate(per_word, F.lit(0.0), lambda s, x: s + x)


def weighted_hits(words: list, title, body, title_weight: float, body_weight: float) -> Column:
    per_word = F.transform(word_array(words), lambda w: occurrences(title, w) * F.lit(title_weight) + occurrences(body, w) * F.lit(body_weight))
    return F.aggregate(per_word, F.lit(0.0), lambda s, x: s + x)


def shared_conditions(w: ViewpointWords, title: str = "T", body: str = "B", both: str = "X") -> dict:
    """Named boolean Columns that more than one of :func:`conditions` is made of, the costly ones above all."""
    t, x = (lambda n: contains_any(title, w[n])), (lambda n: contains_any(both, w[n]))
    victim = x("investor") & x("investor_victim")
    return {
        "denial": near(both, w["responsibility_anchor"], w["responsibility_denial"], 24),
        "claim": near(both, w["responsibility_anchor"], w["responsibility_claim"], 24) & ~x("responsibility_fact"),
        "enforcement": x("government_strict") & x("enforcement"),
        "normative": near(both, w["regulation"], w["normative"], 18) | near(both, w["market_anchor"], w["normative"], 14),
        "title_hit": t("government_strict") & t("government_failure"), "loose_hit": t("government_loose") & t("loose_failure"), "victim": victim,
    }


def conditions(w: ViewpointWords, title: str = "T", body: str = "B", both: str = "X", shared: dict | None = None) -> dict:
    """Named boolean Columns over title, body and both joined without a space; ``shared`` has columns in which
    :func:`shared_conditions` are made already."""
    t, b, x = (lambda n: contains_any(title, w[n])), (lambda n: contains_any(body, w[n])), (lambda n: contains_any(both, w[n]))
    spaced = F.concat_ws(" ", title, body)
    info = F.aggregate(F.transform(word_array(w["information"]), lambda word: occurrences(spaced, word)), F.lit(0), lambda s, n: s + n) >= 2
    denial, claim, enforcement, normative, title_hit, loose_hit, victim = (shared or shared_conditions(w, title, body, both)).values()
    market = x("market_direct") | normative
    return {
        "always": F.lit(True),
        "informative": info, "informative_neutral": info & ~x("critique"),
        "burden_relief": b("burden_relief"), "promotion_title": t("promotion"),
        "labour": x("labour"), "labour_calm": x("labour") & ~t("labour_dispute"),
        "company_blame": x("company_blame"), "company_failure": x("company_subject") & x("company_failure"),
        "company_exclusion": x("company_exclusion"),
        "government_blamed": x("government_blamed"), "government_acts": x("government_actor"), "politics": x("politics"),
        "denial_or_claim": denial | claim, "denial": denial, "claim_only": claim & ~denial,
        "policy_promotion": t("policy_promotion") & ~x("negative_context"),
        "official_blame": near(both, w["government_strict"], w["official_blame"], 40),
        "risky_failure": x("government_strict") & x("risky_failure"),
        "failure_title": title_hit, "failure_title_loose": loose_hit & ~title_hit,
        "failure_body": b("government_strict") & b("government_failure") & ~title_hit & ~loose_hit,
        "other_blame": x("other_blame"), "enforcement": enforcement, "enforcement_company": enforcement & x("company_failure"),
        "announcement": x("announcement") & ~x("strong_blame"), "government_support": x("government_support"),
        "market_claim": market, "market_claim_normative": normative, "market_claim_announced": market & x("market_announcement"),
        "market_execution": (x("market_anchor") | market) & x("market_execution"),
        "market_opposition": near(both, w["regulation"], w["opposition"], 28),
        "intervention_claim": x("intervention_direct") | near(both, w["intervention_context"], w["intervention_action"], 16),
        "intervention_denied": market & x("anti_intervention"),
        "blame_debate_title": t("blame_debate"),
        "government_victim": x("government_victim"), "pension_company": x("pension") & x("pension_context"),
        "bias_negative": F.col("sentiment") == "negative", "bias_positive": F.col("sentiment") == "positive",
        "personal": x("personal_subject") & x("personal"),
        "investor_choice": x("investor") & x("investor_choice") & ~victim, "investor_victim": victim,
        "fraud": x("fraud"), "research": x("research") & ~x("personal_blame"),
        "external_shock": x("external_shock") & x("external_context"), "external_impact": x("external_event") & x("external_impact"),
        "mixed": x("mixed"), "mixed_near": near(both, w["mixed_anchor"], w["mixed_context"], 24), "not_blame": x("not_blame"),
        "guidance": x("guidance") & x("government_actor") & ~x("strong_blame"),
    }


def _fold(base, steps) -> Column:
    """Apply steps in order: a score below ``floor`` becomes 0; from ``least`` on it is multiplied and added to."""
    return F.aggregate(
        F.array(*steps), base,
        lambda s, e: F.when(s < e["floor"], F.lit(0.0)).when(s >= e["least"], s * e["mul"] + e["add"]).otherwise(s),
    )


def _step(mul=1.0, add=0.0, floor=float("-inf"), least=float("-inf")) -> Column:
    as_double = lambda v: (v if isinstance(v, Column) else F.lit(float(v))).cast("double")
    return F.struct(as_double(mul).alias("mul"), as_double(add).alias("add"), as_double(floor).alias("floor"), as_double(least).alias("least"))


def _settled(df: DataFrame) -> DataFrame:
    """Keep computed columns from being computed again wherever they are used: the optimiser moves expressions
    into their uses through a projection, but not through a generator."""
    return df.select(F.explode(F.array(F.struct(*df.columns))).alias("_row")).select("_row.*")


def classify_viewpoints(articles: DataFrame, words: ViewpointWords, pack: TextPack = KOREAN) -> DataFrame:
    """article_id and its three best viewpoints as an array of (rank, category, score).

    Columns used: article_id, title, clean_text, sentiment, sentiment_score. One scan, no shuffle."""
    ready = _settled(articles.select(
        "article_id", rule_text("title", pack).alias("T"), rule_text("clean_text", pack).alias("B"), "sentiment",
        (F.least(F.coalesce("sentiment_score", F.lit(0.0)), F.lit(0.85)) * 2).alias("bias"),
    )).select("*", F.concat("T", "B").alias("X"))
    made = shared_conditions(words)
    ready = _settled(ready.select("*", *[test.alias(f"made_{name}") for name, test in made.items()]))  # each is used several times
    base = {key: base_score(words[key], "T", "B") for key in CATEGORIES}
    weak = words["weak_result"]
    context = contains_any("B", words["result_context"])
    base["result"] = base["result"] + weighted_hits(weak, "T", "B", 1.0, 0.2) + F.when(context, weighted_hits(weak, "T", "B", 1.5, 0.4)).otherwise(0.0)
    tests = {f"is_{name}": F.coalesce(test, F.lit(False)) for name, test in conditions(words, shared={name: F.col(f"made_{name}") for name in made}).items()}
    seen = _settled(ready.select("article_id", "bias", *[c.alias(f"base_{k}") for k, c in base.items()], *[c.alias(n) for n, c in tests.items()]))
    steps: dict = {key: [_step()] for key in CATEGORIES}
    for condition, key, operation, value in EFFECTS:
        on = F.col(f"is_{condition}")
        if operation == "add":
            steps[key].append(_step(add=F.when(on, value).otherwise(0.0)))
        elif operation == "bias":
            steps[key].append(_step(add=F.when(on, F.col("bias") * value).otherwise(0.0)))
        elif operation == "mul":
            steps[key].append(_step(mul=F.when(on, value).otherwise(1.0)))
        elif operation == "zero_below":
            steps[key].append(_step(floor=value))
        else:
            least, mul, add = value
            steps[key].append(_step(mul=mul, add=add, least=least))
    scored = F.array(*[
        F.struct((-F.greatest(_fold(F.col(f"base_{k}"), steps[k]), F.lit(0.0))).alias("minus"), F.lit(i).alias("place"), F.lit(name).alias("category"))
        for i, (k, name) in enumerate(CATEGORIES.items())
    ])
    best = _settled(seen.select("article_id", F.slice(F.array_sort(scored), 1, 3).alias("best")))
    entry = lambda rank, category, score: F.struct(
        F.lit(rank).alias("rank"), category.alias("category"), F.bround(score, 1).alias("score"))
    none = F.lit(ko.UNCLASSIFIED_VIEWPOINT)
    low = F.array(entry(1, F.lit(ko.FALLBACK_VIEWPOINT), -F.col("best")[0]["minus"]), entry(2, none, F.lit(0.0)), entry(3, none, F.lit(0.0)))
    usual = F.array(*[
        entry(i + 1, F.when(F.col("best")[i]["minus"] < 0, F.col("best")[i]["category"]).otherwise(none), F.greatest(-F.col("best")[i]["minus"], F.lit(0.0)))
        for i in range(3)
    ])
    return best.select("article_id", F.when(-F.col("best")[0]["minus"] < 1.0, low).otherwise(usual).alias("perspective"))
