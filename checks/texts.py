"""Checked queries: text functions run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.catalog import query
from checks.packs import LATIN
from checks.reads import quoted
from tidewire.functions import keywords as kw
from tidewire.functions import labels as lb
from tidewire.functions import sentiment as sn
from tidewire.functions import text as tx
from tidewire.functions import vectors as vc
from tidewire.operators import topics as tp


def folded(column, patterns, put=" "):
    out = column
    for p in patterns:
        find, to = p if isinstance(p, tuple) else (p, put)
        find = find.replace("'", "''").replace(r"\w", r"[\p{L}\p{M}\p{Nd}_]")
        out = f"regexp_replace({out}, '{find}', '{to}', 'g')"
    return out


def stripped(expr):
    return f"regexp_replace({expr}, '^\\s+|\\s+$', '', 'g')"


STOP = quoted(LATIN.article_stopwords)
query("clean_articles", f"""SELECT article_id, array_to_string(list_filter(string_split_regex({folded("coalesce(title || ' ' || content, '')", LATIN.article_patterns)}, '\\s+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ') AS clean_text FROM articles""")(
    lambda t: t.articles.select("article_id", tx.clean_article(F.concat_ws(" ", "title", "content"), LATIN).alias("clean_text")))
query("article_tokens", f"""SELECT article_id, len(list_distinct(w)) AS n_tokens, coalesce(array_to_string(list_sort(list_distinct(w)), ' '), '') AS words FROM (SELECT article_id, list_filter(regexp_extract_all({folded('content', LATIN.token_patterns)}, '[\\p{{L}}\\p{{M}}\\p{{Nd}}_]+'),
  lambda w: length(w) > 1 AND w NOT IN ({STOP}) AND NOT contains(w, 'wh') AND NOT ends_with(w, 'tion') AND NOT ends_with(w, 'ing')) AS w FROM articles)""")(
    lambda t: t.articles.select("article_id", tx.article_tokens("content", None, LATIN).alias("w")).select(
        "article_id", F.size("w").cast("bigint").alias("n_tokens"), F.array_join(F.array_sort("w"), " ").alias("words")))
query("clean_bodies", f"SELECT article_id, {stripped(folded('content', LATIN.body_patterns))} AS body FROM articles")(
    lambda t: t.articles.select("article_id", tx.clean_body("content", LATIN).alias("body")))
query("clean_titles", f"SELECT article_id, {stripped(folded('title', LATIN.scope_title_patterns))} AS scope_title, {stripped('regexp_replace(' + folded('title', LATIN.credit_title_patterns) + ', $$\\s+$$, $$ $$, $$g$$)')} AS credit_title FROM articles")(
    lambda t: t.articles.select("article_id", tx.clean_scope_title("title", LATIN).alias("scope_title"), tx.clean_credit_title("title", LATIN).alias("credit_title")))


def synonyms(expr):
    for a, b in LATIN.rule_text_synonyms:
        expr = f"replace({expr}, '{a}', '{b}')"
    return expr


RULE_TEXT = synonyms(folded("content", LATIN.rule_text_patterns, ""))
query("rule_texts", f"SELECT article_id, {RULE_TEXT} AS rule_text FROM articles")(lambda t: t.articles.select("article_id", tx.rule_text("content", LATIN).alias("rule_text")))


def tidy(c):
    inner = f"regexp_replace({c}, '\\s+', ' ', 'g')"
    inner = f"regexp_replace({inner}, '\\[[^\\]]*\\]|\\([^)]*\\)|#\\S+', ' ', 'g')"
    return stripped(f"regexp_replace({inner}, '\\s+', ' ', 'g')")


query("model_texts", f"SELECT article_id, {stripped(tidy('title') + ' || $$ $$ || ' + tidy('title') + ' || $$ $$ || ' + tidy('content'))} AS text FROM articles")(
    lambda t: t.articles.select("article_id", tx.model_text("title", "content").alias("text")))
query("trimmed_titles", """SELECT article_id, CASE WHEN length(title) <= 70 THEN title ELSE coalesce(nullif(regexp_extract(substr(title,1,70), '(?s)^(.*[aeiou])', 1), ''), substr(title,1,70)) || '…' END AS trimmed FROM articles""")(
    lambda t: t.articles.select("article_id", tx.natural_trim("title", 70, LATIN).alias("trimmed")))
query("article_sentences")(lambda t: t.articles.select("article_id", F.posexplode(tx.split_sentences("content", 15, LATIN)).alias("pos", "sentence")))
SENT = "SELECT doc_id, unnest(string_split(text, chr(10))) AS s FROM documents"
VALID = "length(s) >= 20 AND length(regexp_replace(s, '[^A-Za-zß-ÿ]', '', 'g')) / length(s) >= 0.4 AND NOT regexp_matches(s, 'th[.]?$') AND NOT regexp_matches(s, 'subscribe|copyright') AND NOT regexp_matches(s, '(?:photo|image) by')"
query("sentence_marks", f"""SELECT doc_id, count(*) AS lines, count(*) FILTER ({VALID}) AS valid, count(*) FILTER (regexp_matches(s, '^["'']| was ')) AS quotes, count(*) FILTER (regexp_matches(s, 'th[.]?$')) AS captions,
 round(sum(least(0.05 * (regexp_matches(s, '[0-9]+')::INT + regexp_matches(s, 'the ')::INT + regexp_matches(s, 'tion ')::INT), 0.15)), 6) AS facts,
 round(sum(least(0.05 * (contains(s,'edthe')::INT + contains(s,'ing')::INT + contains(s,'ment')::INT + contains(s,'ung')::INT), 0.10)), 6) AS economy FROM ({SENT}) GROUP BY 1""")(
    lambda t: t.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("s")).groupBy("doc_id").agg(
        F.count("*").alias("lines"), F.count_if(tx.is_valid_sentence("s", LATIN)).alias("valid"), F.count_if(tx.is_quote("s", LATIN)).alias("quotes"),
        F.count_if(tx.is_caption("s", LATIN)).alias("captions"), F.round(F.sum(tx.fact_score("s", LATIN)), 6).alias("facts"),
        F.round(F.sum(tx.economy_score("s", LATIN)), 6).alias("economy")))
query("keyword_overlap", """SELECT article_id, -least(0.03 * len(list_filter(string_split(s.scope_keywords, ','), lambda k: k <> '' AND contains(a.content, k))), 0.10) AS penalty FROM articles a JOIN scopes s USING (scope_id)""")(
    lambda t: t.articles.join(t.scopes.select("scope_id", "scope_keywords"), "scope_id").select("article_id", tx.keyword_overlap_penalty("content", kw.keyword_list("scope_keywords")).alias("penalty")))
query("word_occurrences", "SELECT article_id, ((length(content) - length(replace(content, 'en', ''))) // 2)::INT AS n, contains(content, 'zzz') OR contains(content, 'tion') AS some FROM articles")(
    lambda t: t.articles.select("article_id", tx.occurrences("content", "en").alias("n"), tx.contains_any("content", ["zzz", "tion"]).alias("some")))
# positions of every anchor are too slow in SQL on whole texts; brute force on a fixture is in the tests
query("near_terms")(lambda t: t.documents.select("doc_id", tx.near("text", ["which", "from"], ["tion", "the"], 8).alias("is_near")))
query("untagged_titles", "SELECT article_id, regexp_replace('[tag ' || press || '] ' || title, '^\\[[^\\]]+\\]\\s*', '') AS bare FROM articles")(
    lambda t: t.articles.select("article_id", tx.strip_leading_tag(F.concat(F.lit("[tag "), "press", F.lit("] "), "title")).alias("bare")))
query("keyword_lists", "SELECT article_id, array_to_string(list_filter(list_transform(string_split(keywords || ', ,' || press || ' ,', ','), lambda x: trim(x)), lambda x: x <> ''), '|') AS words FROM articles")(
    lambda t: t.articles.select("article_id", F.array_join(kw.keyword_list(F.concat("keywords", F.lit(", ,"), "press", F.lit(" ,"))), "|").alias("words")))
VALID_KW = f"""length(w) >= 2 AND NOT regexp_matches(w, '[0-9]') AND regexp_matches(w, '\\p{{L}}') AND w NOT IN ({quoted(LATIN.keyword_stopwords)}) AND lower(w) NOT IN ({quoted(LATIN.keyword_stopwords)})
 AND (NOT regexp_full_match(w, '[A-Za-zß-ÿ]{{1,2}}') OR w IN ('re','on','an')) AND (regexp_full_match(w, '[a-zA-Z]+') OR NOT regexp_matches(w, '[éèê]$'))"""
query("valid_keywords", f"SELECT w, count(*) AS n, CASE WHEN w IN ('of','de','la') THEN 0 WHEN w IN ('on','en') THEN 1 WHEN w IN ('er','re') THEN 3 ELSE 2 END AS role FROM (SELECT unnest(string_split_regex(text, '\\s+')) AS w FROM documents) WHERE {VALID_KW} GROUP BY 1")(
    lambda t: t.documents.select(F.explode(tx.words_of("text")).alias("w")).filter(kw.is_valid_keyword("w", LATIN)).groupBy("w").agg(F.count("*").alias("n")).withColumn("role", kw.word_role("w", LATIN)))
# DuckDB's patterns know blanks and word characters of ASCII only: others are spelled out, and stand between underscores while word borders count
SPACE, WORD, WIDE = r"\s\x0b\x1c-\x1f\x85\p{Z}", r"\p{L}\p{M}\p{N}_", r"([\x{AA}\x{B2}\x{B3}\x{B5}\x{B9}\x{BA}\x{BC}-\x{BE}\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{2C1}\x{370}-\x{1FFF}\x{3040}-\x{D7FF}])"
CLEANED = "w"
for find, put in [(r"https?://\S+", " "), (r"ftp://\S+", " "), (r"www\.\S+", " "), (rf"[{WORD}.+-]+@[{WORD}-]+\.[a-zA-Z]{{2,}}", " "), (WIDE, r"_\1_"), (r"\b[a-zA-Z0-9-]+\.[a-zA-Z]{2,6}\b", " "), (r"\b[\d,.\-]+\b", " "),
                  (rf"_{WIDE}_", r"\1"), (rf"[^{WORD} ]", " "), (" +", " "), ("^ | $", "")]:
    CLEANED = f"regexp_replace({CLEANED}, '{find}', '{put}', 'g')"
query("clean_tokens", f"WITH w AS (SELECT DISTINCT unnest(string_split_regex(text, '[{SPACE}]+')) AS w FROM documents) SELECT w, nullif({CLEANED}, '') AS cleaned FROM w WHERE w <> ''")(
    lambda t: t.documents.select(F.explode(tx.words_of("text")).alias("w")).distinct().withColumn("cleaned", tx.clean_token("w")))
query("suggestion_words", """SELECT article_id, array_to_string(list_transform(list_filter(string_split_regex(translate(title, '…·', '  '), '\\s+'), lambda w: w <> ''), lambda w: trim(w, '[]()"''‘’“”,.')), '|') AS words FROM articles""")(
    lambda t: t.articles.select("article_id", F.array_join(tx.suggestion_words("title"), "|").alias("words")))
query("sentiment_labels", """SELECT article_id, CASE WHEN r IN ('positive','긍정') THEN 'positive' WHEN r IN ('negative','부정') THEN 'negative' ELSE 'neutral' END AS label FROM
 (SELECT article_id, CASE WHEN doc_id % 2 = 0 THEN sentiment WHEN sentiment = 'positive' THEN '긍정' WHEN sentiment = 'negative' THEN '부정' END AS r FROM articles)""")(
    lambda t: t.sql("SELECT article_id, CASE WHEN doc_id % 2 = 0 THEN sentiment WHEN sentiment = 'positive' THEN '긍정' WHEN sentiment = 'negative' THEN '부정' END AS r FROM articles").select("article_id", lb.sentiment_label("r").alias("label")))
query("date_labels", "SELECT article_id, '기준일 ' || strftime(published_at, '%Y.%m.%d') AS base_label, strftime(published_at, '%H:%M') AS clock, published_at::TIMESTAMP AS naive FROM articles")(
    lambda t: t.articles.select("article_id", lb.base_date_label("published_at").alias("base_label"), lb.clock_label("published_at").alias("clock"),
                                lb.naive_time(F.concat(F.date_format("published_at", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+09:00"))).alias("naive")))
query("role_names", "SELECT user_id, CASE role WHEN 'general' THEN 'General' WHEN 'admin' THEN 'Admin' ELSE role END AS role_name FROM users")(
    lambda t: t.users.select("user_id", lb.code_name("role", {"general": "General", "admin": "Admin"}).alias("role_name")))
query("stay_texts", "SELECT o_orderkey, (floor(o_totalprice)::BIGINT // 3600)::VARCHAR || '시간 ' || (floor(o_totalprice)::BIGINT % 3600 // 60)::VARCHAR || '분' AS stay FROM orders")(
    lambda t: t.orders.select("o_orderkey", lb.stay_text("o_totalprice").alias("stay")))
query("binary_labels", "SELECT l_orderkey, l_linenumber, CASE WHEN lower(l_returnflag) IN ('n') THEN NULL WHEN l_returnflag = 'A' THEN 1 ELSE 0 END AS label FROM lineitem")(
    lambda t: t.lineitem.select("l_orderkey", "l_linenumber", lb.binary_label(F.when(F.col("l_returnflag") == "A", " Yes ").when(F.col("l_returnflag") == "R", "FALSE").otherwise("maybe")).alias("label")))
query("opinion_sentences", """WITH c AS (SELECT press, count(*) FILTER (sentiment='positive') AS p, count(*) FILTER (sentiment='neutral') AS n, count(*) FILTER (sentiment='negative') AS g FROM articles GROUP BY 1),
 d AS (SELECT *, CASE WHEN p >= n AND p >= g THEN 'p' WHEN n >= g THEN 'n' ELSE 'g' END AS f FROM c), e AS (SELECT *, CASE f WHEN 'p' THEN CASE WHEN n >= g THEN 'n' ELSE 'g' END WHEN 'n' THEN CASE WHEN p >= g THEN 'p' ELSE 'g' END ELSE CASE WHEN p >= n THEN 'p' ELSE 'n' END END AS s FROM d),
 k AS (SELECT *, CASE WHEN CASE s WHEN 'p' THEN p WHEN 'n' THEN n ELSE g END >= 20 THEN s ELSE '' END AS v FROM e)
 SELECT press, press || CASE f WHEN 'p' THEN CASE v WHEN 'n' THEN ' 이슈는 긍정적 기대와 우호적 평가가 가장 많이 나타나며, 중립적 전달도 함께 확인됩니다.' WHEN 'g' THEN ' 이슈는 긍정적 기대와 우호적 평가가 가장 많이 나타나며, 일부 우려의 시각도 함께 확인됩니다.' ELSE ' 이슈는 긍정적 기대와 우호적 평가가 뚜렷하게 나타납니다.' END
 WHEN 'g' THEN CASE v WHEN 'n' THEN ' 이슈는 우려와 비판적 해석이 가장 많이 나타나며, 중립적 전달도 함께 확인됩니다.' WHEN 'p' THEN ' 이슈는 우려와 비판적 해석이 가장 많이 나타나며, 일부 긍정적 기대도 함께 확인됩니다.' ELSE ' 이슈는 우려와 비판적 해석이 뚜렷하게 나타납니다.' END
 ELSE CASE v WHEN 'p' THEN ' 이슈는 사실 전달 중심의 중립적 보도가 가장 많이 나타나며, 긍정적 기대를 담은 해석도 일부 확인됩니다.' WHEN 'g' THEN ' 이슈는 사실 전달 중심의 중립적 보도가 가장 많이 나타나며, 부정적 우려를 담은 해석도 일부 확인됩니다.' ELSE ' 이슈는 사실 전달 중심의 중립적 보도가 우세하게 나타납니다.' END END AS sentence FROM k""")(
    lambda t: t.articles.groupBy("press").agg(F.count_if(F.col("sentiment") == "positive").alias("p"), F.count_if(F.col("sentiment") == "neutral").alias("n"), F.count_if(F.col("sentiment") == "negative").alias("g"))
    .select("press", lb.opinion_sentence("press", "p", "n", "g").alias("sentence")))
query("unit_vectors", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x * 4))), 5) AS doubled_norm, round(list_extract(embedding::DOUBLE[], 1) / sqrt(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x))), 5) AS first FROM embeddings")(
    lambda t: t.embeddings.select("vec_id", F.round(vc.norm(F.transform("embedding", lambda x: x.cast("double") * 2)), 5).alias("doubled_norm"), F.round(vc.unit("embedding", 64)[0], 5).alias("first")))
query("gap_labels", """SELECT event_id, CASE WHEN abs(p - n) < 0.1 THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS label, round_even(CASE WHEN abs(p - n) < 0.1 THEN 1 - abs(p - n) ELSE greatest(p, n) END, 6) AS score
 FROM (SELECT event_id, user_id % 100 / 100.0::DOUBLE AS p, 1 - user_id % 100 / 100.0::DOUBLE AS n FROM events)""")(
    lambda t: t.events.select("event_id", sn.gap_label((F.col("user_id") % 100) / F.lit(100.0), 1 - (F.col("user_id") % 100) / F.lit(100.0)).alias("s")).select("event_id", "s.label", "s.score"))

# --- corpus keywords and titles ------------------------------------------------------------------

TOK = "[A-Za-zß-ÿ]+"
query("tfidf_keywords", f"""WITH r AS (SELECT doc_id, unnest(regexp_extract_all(text, '{TOK}')) AS w, regexp_extract_all(split_part(text, chr(10), 1), '{TOK}') AS tn FROM documents),
 v AS (SELECT doc_id, lower(w) AS term, list_contains(tn, w) AND w = lower(w) AS it FROM r WHERE NOT contains(w, '÷') AND {VALID_KW}), tf AS (SELECT doc_id, term, count(*) AS tf, bool_or(it) AS it FROM v GROUP BY 1, 2),
 st AS (SELECT term, count(*) AS df FROM tf GROUP BY 1), n AS (SELECT count(DISTINCT doc_id) AS n FROM tf),
 w AS (SELECT doc_id, term, it, (1 + ln(tf)) * (ln((1 + n) / (1 + df)) + 1) AS w FROM tf JOIN st USING (term), n),
 s AS (SELECT doc_id, term AS keyword, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) + CASE WHEN it THEN 0.3 ELSE 0 END AS score FROM w),
 k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, keyword) AS rank FROM s) SELECT doc_id, keyword, round(score, 5) AS score FROM k WHERE rank <= 5""")(
    lambda t: tp.tfidf_keywords(t.documents.select("doc_id", F.regexp_extract_all("text", F.lit(TOK), 0).alias("tokens"),
                                                   F.regexp_extract_all(F.split_part("text", F.lit("\n"), F.lit(1)), F.lit(TOK), 0).alias("title_nouns")), pack=LATIN)
    .select("doc_id", "keyword", F.round("score", 5).alias("score")))
NOUN_STOP = quoted(LATIN.noun_stopwords)
query("scope_titles", f"""WITH r AS (SELECT scope_id, article_id, title, row_number() OVER (PARTITION BY scope_id ORDER BY published_at DESC, article_id) AS pos FROM articles WHERE scope_id IS NOT NULL AND title <> ''),
 t AS (SELECT scope_id, article_id, pos, {stripped(folded('title', LATIN.scope_title_patterns))} AS title FROM r), u AS (SELECT * FROM t WHERE title <> ''),
 n AS (SELECT scope_id, count(*) AS n FROM u GROUP BY 1), w AS (SELECT scope_id, article_id, unnest(string_split_regex(title, '[^\\p{{L}}\\p{{M}}\\p{{Nd}}_]+')) AS word FROM u),
 f AS (SELECT scope_id, word, count(*) AS tf, count(DISTINCT article_id) AS df FROM w WHERE length(word) >= 2 AND word NOT IN ({NOUN_STOP}) GROUP BY 1, 2),
 b AS (SELECT scope_id, word, row_number() OVER (PARTITION BY scope_id ORDER BY round(tf * (ln((n + 1) / (df + 1)) + 1), 9) DESC, word) AS rank FROM f JOIN n USING (scope_id)),
 o AS (SELECT scope_id, string_agg(word, ' ' ORDER BY CASE WHEN word IN ('of','de','la') THEN 0 WHEN word IN ('on','en') THEN 1 WHEN word IN ('er','re') THEN 3 ELSE 2 END, rank) AS title FROM b WHERE rank <= 5 GROUP BY 1)
 SELECT scope_id, CASE WHEN length(title) > 50 THEN coalesce(nullif(regexp_extract(substr(title,1,50), '^(.*) ', 1), ''), substr(title,1,50)) ELSE title END AS scope_title FROM o""")(
    lambda t: tp.scope_titles(t.articles, pack=LATIN))
