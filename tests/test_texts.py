"""Korean text rules against values worked out by hand."""

import random

from pyspark.sql import functions as F

from tidewire.functions import keywords as kw
from tidewire.functions import labels as lb
from tidewire.functions import sentiment as sn
from tidewire.functions import text as tx


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'string'}" for k, v in values.items()))
    return df.select(column.alias("r")).first()["r"]


def test_clean_article(spark):
    text = "[속보] 홍길동 기자 금리 인상, 시장은 긴장 <b>중</b> ※ 재배포 금지"
    assert one(spark, tx.clean_article("t"), t=text) == "금리 인상 시장은 긴장 중"


def test_article_tokens_drop_the_author(spark):
    got = one(spark, tx.article_tokens("t", F.col("a")), t="홍길동 금리 인상 금리 특파원단 합니다 물가", a="홍길동 기자")
    assert got == ["금리", "인상", "물가"]


def test_titles(spark):
    assert one(spark, tx.clean_scope_title("t"), t="[단독] 금리 인상(종합)  전망") == "금리 인상 전망"
    assert one(spark, tx.clean_credit_title("t"), t="<앵커> 물가 (영상취재 : 김민철, 디자인 : 박태영) 상승") == "물가 상승"
    assert one(spark, tx.strip_leading_tag("t"), t="[게시판] 소식") == "소식"


def test_clean_body_cuts_blocks(spark):
    assert one(spark, tx.clean_body("t"), t="[앵커] 안녕하십니까\n[리포트] 수출이 늘었다. ▶ 제보") == "안녕하십니까 수출이 늘었다."
    assert one(spark, tx.clean_body("t"), t="수출이 늘었다. 문의 a.b@c.com https://x.y/z") == "수출이 늘었다. 문의"


def test_rule_text_order(spark):
    assert one(spark, tx.rule_text("t"), t="미국 불황 예측 (종합) 성과급인상") == "글로벌 침체 전망  "


def test_metric_keyword(spark):
    for word, want in [(" #금리! ", "금리"), ("12", None), ("가", None), ("뉴스", None), ("밝혔습니다", None), ("a@b", None), ("AI", "ai")]:
        assert one(spark, kw.metric_keyword("w"), w=word) == want
    words = one(spark, F.array_sort(F.filter(kw.metric_words("w"), lambda k: kw.is_metric_keyword(k))), w="금리, #금리,물가 , 가,AI,ai")
    assert words == ["ai", "금리", "물가"]


def test_top_issue_keywords(spark):
    got = one(spark, F.filter(kw.top_issue_words("w"), lambda k: kw.is_top_issue_keyword(k)), w="금리,정부안,관계자들,a1,반도체,금리,전망,20년")
    assert got == ["금리", "반도체", "금리"]


def test_valid_keyword(spark):
    for word, want in [("금리", True), ("가격", False), ("3분기", False), ("AI", True), ("반도체", True), ("올라가", True), ("오르고", False), ("com", False)]:
        assert one(spark, kw.is_valid_keyword("w"), w=word) is want, word


def test_natural_trim(spark):
    assert one(spark, tx.natural_trim("t", 5), t="가나는다라마바") == "가나는다…"
    assert one(spark, tx.natural_trim("t", 3), t="xxyyzz") == "xxy…"
    assert one(spark, tx.natural_trim("t", 9), t="짧다") == "짧다"


def test_sentences(spark):
    text = "첫 번째 문장은 충분히 깁니다 정말로. 짧다. 무단 전재 및 재배포를 금지합니다 여러분! 두 번째 문장도 충분히 깁니다 정말."
    assert one(spark, tx.split_sentences("t", 15, tx.KOREAN), t=text) == ["첫 번째 문장은 충분히 깁니다 정말로.", "두 번째 문장도 충분히 깁니다 정말."]
    assert one(spark, tx.is_valid_sentence("t"), t="수출이 전년 대비 3.5% 증가했다고 한국은행이 발표했다.")
    assert not one(spark, tx.is_valid_sentence("t"), t="대통령이 현장을 둘러보는 관계자들과 이야기하는 모습.")
    assert one(spark, tx.fact_score("t"), t="역대 최대 수출 3% 증가했다") == 0.15
    assert abs(one(spark, tx.economy_score("t"), t="은행 금리") - 0.10) < 1e-9
    assert abs(one(spark, tx.keyword_overlap_penalty("t", "k"), t="은행 금리", k=["은행", "금리", "물가"]) + 0.06) < 1e-9


def test_near_against_positions(spark):
    rng = random.Random(7)
    texts = [("".join(rng.choice("abcd") for _ in range(rng.randint(0, 24))),) for _ in range(300)]

    def brute(text, anchors, words, window):
        for a in anchors:
            at = text.find(a)
            while at >= 0:
                span = text[max(0, at - window) : min(len(text), at + len(a) + window)]
                if any(w in span for w in words):
                    return True
                at = text.find(a, at + len(a))
        return False

    df = spark.createDataFrame(texts, "t string").coalesce(2)
    cases = [(["ab", "dc"], ["ca", "bd", "abd"], w) for w in (0, 1, 3, 8)] + [(["aa", "bcb"], ["d", "cab"], 2), (["abc"], ["b", "zabcz", "cd"], 1)]
    rows = df.select("t", *[tx.near("t", *c).alias(f"c{i}") for i, c in enumerate(cases)]).collect()
    for r in rows:
        for i, c in enumerate(cases):
            assert r[f"c{i}"] == brute(r["t"], *c), (r["t"], c)


def test_labels(spark):
    assert one(spark, lb.half_even_percent(F.lit(1), F.lit(8)), x="") == 12
    assert one(spark, lb.percent_label(F.lit(1), F.lit(0)), x="") == "<1%"
    assert one(spark, lb.stay_text(F.lit(3725)), x="") == "1시간 2분"
    assert one(spark, lb.opinion_sentence(F.lit(""), F.lit(50), F.lit(30), F.lit(20)), x="").startswith("해당 이슈 이슈는 긍정적 기대와")
    assert one(spark, lb.binary_label("v"), v=" 정부 책임 ") == 1
    assert one(spark, lb.binary_label("v"), v="maybe") is None


def test_sentiment_rules(spark):
    assert tuple(one(spark, sn.gap_label("p", "n"), p=0.52, n=0.48)) == ("neutral", 0.96)
    assert abs(one(spark, sn.boosted("p", F.array(F.lit(1.0), F.lit(2.0))), p=0.6) - 1.0) < 1e-9
