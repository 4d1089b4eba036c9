"""Checked queries: filters, joins, aggregates, windows, ranking and set operations."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog import query
from checks.packs import LATIN
from tidewire.functions import labels as lb
from tidewire.operators import aggregates as ag
from tidewire.operators import filters as fl
from tidewire.operators import intervals as iv
from tidewire.operators import joins as jn
from tidewire.operators import postings as po
from tidewire.operators import ranking as rk
from tidewire.operators import reports as rp
from tidewire.operators import tables as tb
from tidewire.session import durable, shared_folder
from tidewire.sources.keyed import KeyedTable
from tidewire.sources.tables import replace_partition

NOW = "2024-01-31 00:00:00"
KW = "tion"
TOPIC = "the"
LIVE = "NOT coalesce(is_disabled, false)"
KEY_HIT = f"contains(lower(keywords), '{KW}')"


def norm(col):
    return f"(' ' || trim(regexp_replace(lower(coalesce({col}, '')), '[^a-z0-9_ß-öø-ÿµªºœžšŀ]+', ' ', 'g')) || ' ')"


# --- B: filters ----------------------------------------------------------------------------------

query("articles_window_auto", "SELECT article_id, published_at FROM articles WHERE published_at >= TIMESTAMP '2024-01-14' AND published_at < TIMESTAMP '2024-01-15'")(
    lambda t: fl.in_window(t.articles, "published_at", "auto", "2024-01-15 10:30:00").select("article_id", "published_at"))
query("articles_window_manual", "SELECT article_id, published_at FROM articles WHERE published_at >= TIMESTAMP '2024-01-15' AND published_at < TIMESTAMP '2024-01-15 10:30:00'")(
    lambda t: fl.in_window(t.articles, "published_at", "manual", "2024-01-15 10:30:00").select("article_id", "published_at"))
query("missing_fields", """SELECT article_id, CASE WHEN trim(coalesce(summary,'')) = '' OR lower(trim(summary)) = 'nan' OR sentiment IS NULL
  THEN 'skipped_missing' ELSE 'ok' END AS status FROM articles""")(
    lambda t: fl.tag_missing(t.articles.select("article_id", "summary", "sentiment"), ["summary", "sentiment"]).select("article_id", "status"))
query("pending_articles", "SELECT article_id FROM articles WHERE content IS NOT NULL AND summary IS NULL AND scope_id IS NOT NULL")(
    lambda t: fl.pending(t.articles, ["content", "scope_id"], ["summary"]).select("article_id"))
query("articles_on_days", f"SELECT article_id FROM articles WHERE {LIVE} AND published_at >= TIMESTAMP '2024-01-04 15:00:00' AND published_at < TIMESTAMP '2024-01-08 15:00:00'")(
    lambda t: fl.on_days(fl.enabled(t.articles), "published_at", "2024-01-05", "2024-01-08", 9).select("article_id"))
query("keyword_substring", f"SELECT article_id FROM articles WHERE {KEY_HIT} AND {LIVE}")(
    lambda t: fl.enabled(t.articles).filter(fl.kw_contains("keywords", "TION")).select("article_id"))
query("keyword_exact", "SELECT article_id FROM articles WHERE list_contains(string_split(keywords, ','), 'tion')")(
    lambda t: t.articles.filter(fl.kw_contains("keywords", "Tion", exact=True)).select("article_id"))
query("title_phrase", f"SELECT article_id FROM articles WHERE contains({norm('content')}, ' of the ')")(
    lambda t: t.articles.filter(fl.phrase("content", "of the")).select("article_id"))
query("title_phrase_prefix", f"SELECT article_id FROM articles WHERE contains({norm('title')}, ' the th')")(
    lambda t: t.articles.filter(fl.phrase_prefix("title", "the th")).select("article_id"))
query("multi_match", f"""SELECT article_id, greatest(CASE WHEN contains({norm('title')}, ' ment ') THEN 3.0 ELSE 0 END,
  CASE WHEN contains({norm('summary')}, ' ment ') THEN 2.0 ELSE 0 END, CASE WHEN contains({norm('keywords')}, ' ment ') THEN 4.0 ELSE 0 END,
  CASE WHEN contains({norm('content')}, ' ment ') THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM articles WHERE score > 0""")(
    lambda t: fl.multi_match(t.articles, "ment").select("article_id", "score"))


def stored_postings(t, fields=tuple(fl.SEARCH_WEIGHTS)):
    """All words of the searched fields of all articles with their places, as a table in the shared folder."""
    path = f"{shared_folder(t.spark)}/postings-{uuid.uuid4().hex}"
    po.write_postings(po.postings(t.articles, list(fields)), path)
    return po.read_postings(t.spark, path)


query("indexed_phrase", f"SELECT article_id FROM articles WHERE contains({norm('content')}, ' of the ')")(
    lambda t: po.phrase_keys(stored_postings(t, ["content"]), "of the", "content").select(F.col("key").alias("article_id")))
query("indexed_phrase_prefix", f"SELECT article_id FROM articles WHERE contains({norm('title')}, ' the th')")(
    lambda t: po.phrase_prefix_keys(stored_postings(t, ["title"]), "the th", "title").select(F.col("key").alias("article_id")))
query("indexed_multi_match", f"""SELECT article_id, greatest(CASE WHEN contains({norm('title')}, ' ment ') THEN 3.0 ELSE 0 END,
  CASE WHEN contains({norm('summary')}, ' ment ') THEN 2.0 ELSE 0 END, CASE WHEN contains({norm('keywords')}, ' ment ') THEN 4.0 ELSE 0 END,
  CASE WHEN contains({norm('content')}, ' ment ') THEN 1.0 ELSE 0 END)::DOUBLE AS score FROM articles WHERE score > 0""")(
    lambda t: po.match_scores(stored_postings(t), "ment").select(F.col("key").alias("article_id"), "score"))
SAVED = [(1, "of the"), (2, "The, TION"), (3, "ment"), (4, "the the")]
query("saved_phrases", " UNION ALL ".join(
    f"SELECT {i} AS query_id, article_id FROM articles WHERE contains({norm('content')}, ' {text} ')" for i, text in [(1, "of the"), (2, "the tion"), (3, "ment"), (4, "the the")]))(
    lambda t: po.saved_phrases(stored_postings(t, ["content"]), t.spark.createDataFrame(SAVED, "query_id int, query string"), "content").select("query_id", F.col("key").alias("article_id")))
query("boosted_or", f"""SELECT article_id, (CASE WHEN {KEY_HIT} THEN 8 ELSE 0 END + CASE WHEN contains({norm('title')}, ' tion ') THEN 5 ELSE 0 END)::DOUBLE AS score
  FROM articles WHERE score > 0""")(
    lambda t: fl.boosted_or(t.articles, [(fl.kw_contains("keywords", KW), 8), (fl.phrase("title", KW), 5)]).select("article_id", "score"))
query("since_days", "SELECT article_id FROM articles WHERE published_at >= TIMESTAMP '2024-01-28'")(
    lambda t: fl.since_days(t.articles, "published_at", 3, "2024-01-31 17:00:00").select("article_id"))
query("sentiment_alias", "SELECT article_id FROM articles WHERE sentiment = 'positive'")(
    lambda t: fl.with_sentiment(t.articles, "긍정").select("article_id"))
query("rank1_category", "SELECT article_id FROM perspectives WHERE rnk = 1 AND category = 'C04'")(
    lambda t: t.articles_p.filter(fl.has_rank1("perspective", "C04")).select("article_id"))
query("article_cards", f"""SELECT article_id, coalesce(nullif(press,''),'언론사 없음') AS press, coalesce(nullif(title,''),'제목 없음') AS title,
  coalesce(nullif(summary,''), substr(content,1,120)) AS description, coalesce(sentiment,'neutral') AS sentiment,
  strftime(published_at, '%Y-%m-%d') AS published_on, url FROM articles WHERE {LIVE}""")(
    lambda t: fl.article_card(fl.enabled(t.articles)))
query("review_low_confidence", """SELECT article_id, sentiment_score FROM articles WHERE sentiment = 'neutral' AND sentiment_score < 0.55
  AND published_at >= TIMESTAMP '2024-01-03' AND published_at < TIMESTAMP '2024-01-26'
  AND article_id NOT IN (SELECT article_id FROM corrections WHERE used_in_finetune = 1)""")(
    lambda t: jn.exclude_trained(fl.review_filter(t.articles, "low_confidence", 0.55, None, "neutral", "2024-01-03", "2024-01-25"), t.corrections).select("article_id", "sentiment_score"))
query("review_search", f"""SELECT article_id FROM articles WHERE sentiment IS NOT NULL AND (contains({norm('title')}, ' tion ') OR contains({norm('keywords')}, ' tion '))""")(
    lambda t: fl.review_filter(t.articles, "search", query="tion").select("article_id"))
query("log_search", "SELECT history_id FROM process_logs WHERE status = 'fail' AND contains(article_id, '_12') AND occurred_at >= TIMESTAMP '2024-01-02' AND occurred_at < TIMESTAMP '2024-01-21'")(
    lambda t: fl.log_filter(t.process_logs, "occurred_at", {"status": "fail", "x": None}, {"article_id": "doc_12"}, "2024-01-02", "2024-01-20").select("history_id"))
query("active_banners", """SELECT banner_id, banner_type, is_pinned FROM banners WHERE is_active AND start_at <= DATE '1995-06-01' AND end_at >= DATE '1995-06-01' AND banner_type = 'notice'""")(
    lambda t: fl.active_on(t.banners, "1995-06-01", "notice").select("banner_id", "banner_type", "is_pinned"))
query("incomplete_articles", "SELECT article_id FROM articles WHERE sentiment IS NULL OR sentiment_score IS NULL OR keywords IS NULL OR scope_id IS NULL OR summary IS NULL")(
    lambda t: fl.incomplete(t.articles_p).select("article_id"))

# --- C: joins ------------------------------------------------------------------------------------

query("user_overview", """WITH r AS (SELECT user_id, count(*) FILTER (reaction_type='like') AS l, count(*) FILTER (reaction_type='dislike') AS d FROM article_reactions GROUP BY 1),
 g AS (SELECT user_id, max(created_at) AS last_login FROM login_logs WHERE event_type='login' AND result='success' GROUP BY 1)
 SELECT u.user_id, u.name, u.role, u.created_at, coalesce(r.l,0) AS like_count, coalesce(r.d,0) AS dislike_count, g.last_login
 FROM (SELECT * FROM users ORDER BY created_at DESC, user_id LIMIT 300) u LEFT JOIN r USING (user_id) LEFT JOIN g USING (user_id)""")(
    lambda t: jn.user_overview(t.users, t.article_reactions, t.login_logs))
query("user_overview_search", """WITH r AS (SELECT user_id, count(*) FILTER (reaction_type='like') AS l, count(*) FILTER (reaction_type='dislike') AS d FROM article_reactions GROUP BY 1),
 g AS (SELECT user_id, max(created_at) AS last_login FROM login_logs WHERE event_type='login' AND result='success' GROUP BY 1)
 SELECT u.user_id, u.name, u.role, u.created_at, coalesce(r.l,0) AS like_count, coalesce(r.d,0) AS dislike_count, g.last_login
 FROM (SELECT * FROM users WHERE role='admin' AND (contains(CAST(user_id AS VARCHAR), '2') OR contains(name,'2')) ORDER BY created_at DESC, user_id LIMIT 300) u LEFT JOIN r USING (user_id) LEFT JOIN g USING (user_id)""")(
    lambda t: jn.user_overview(t.users, t.article_reactions, t.login_logs, "2", "관리자"))
query("process_errors", """SELECT p.history_id, p.article_id, p.status, p.occurred_at, e.error_code FROM (SELECT * FROM process_logs ORDER BY occurred_at DESC, history_id DESC LIMIT 100) p
 LEFT JOIN error_logs e USING (history_id)""")(
    lambda t: jn.process_errors(t.process_logs, t.error_logs))
CORPUS = "SELECT article_id, url, title, press FROM articles WHERE published_at < TIMESTAMP '2024-01-16'"
FRESH = "SELECT article_id, url, title, press FROM articles WHERE published_at >= TIMESTAMP '2024-01-16'"
query("new_to_corpus", f"""WITH c AS ({CORPUS}), n AS ({FRESH}) SELECT n.* FROM n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.article_id = n.article_id)
 AND NOT EXISTS (SELECT 1 FROM c WHERE c.url = n.url) AND NOT EXISTS (SELECT 1 FROM c WHERE c.title = n.title AND c.press = n.press AND c.title <> '')""")(
    lambda t: jn.anti_any_key(t.sql(FRESH), t.sql(CORPUS)))
query("enriched_views", "SELECT v.user_id, v.article_id, a.press FROM article_views v JOIN articles a USING (article_id) WHERE v.is_valid_view")(
    lambda t: jn.enrich(t.article_views.filter("is_valid_view").select("user_id", "article_id"), t.articles, ["press"]))
query("press_reaction", """SELECT a.press, sum(v)::BIGINT AS views, sum(k)::BIGINT AS likes FROM (
 SELECT article_id, 1 AS v, 0 AS k FROM article_views WHERE created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21' UNION ALL
 SELECT article_id, 0, 1 FROM article_reactions WHERE reaction_type='like' AND created_at >= TIMESTAMP '2024-01-05' AND created_at < TIMESTAMP '2024-01-21') f JOIN articles a USING (article_id) GROUP BY 1""")(
    lambda t: jn.press_reaction(t.article_views, t.article_reactions, t.articles, "2024-01-05", "2024-01-20"))
query("orphan_scopes", f"SELECT scope_id FROM scopes WHERE scope_id NOT IN (SELECT scope_id FROM articles WHERE scope_id IS NOT NULL AND {LIVE} AND press <> 'src3' AND sentiment = 'negative')")(
    lambda t: jn.orphan_scopes(t.scopes, t.articles.filter("press <> 'src3' AND sentiment = 'negative'")).select("scope_id"))
query("titleless_scopes", "SELECT scope_id, news_count FROM scopes WHERE scope_title IS NULL AND scope_id IN (SELECT scope_id FROM articles)")(
    lambda t: jn.titleless_live(t.scopes, t.articles).select("scope_id", "news_count"))
query("untrained_articles", "SELECT article_id FROM articles WHERE sentiment IS NOT NULL AND article_id NOT IN (SELECT article_id FROM corrections WHERE used_in_finetune = 1)")(
    lambda t: jn.exclude_trained(t.articles.filter("sentiment IS NOT NULL"), t.corrections).select("article_id"))
query("latest_correction", "SELECT article_id, id, corrected_sentiment, used_in_finetune FROM corrections c WHERE id = (SELECT max(id) FROM corrections d WHERE d.article_id = c.article_id)")(
    lambda t: jn.latest_correction(t.corrections))
query("asof_job", "SELECT l.history_id, l.occurred_at, j.job_id FROM process_logs l ASOF LEFT JOIN batch_jobs j ON l.occurred_at >= j.start_at")(
    lambda t: iv.asof_job(t.process_logs, t.batch_jobs).select("history_id", "occurred_at", "job_id"))
query("job_stats", """WITH h AS (SELECT DISTINCT j.job_id, v.article_id FROM batch_jobs j JOIN article_views v ON v.created_at BETWEEN j.start_at AND j.end_at),
 bad AS (SELECT article_id FROM articles WHERE sentiment IS NULL OR sentiment_score IS NULL OR keywords IS NULL OR scope_id IS NULL OR summary IS NULL)
 SELECT j.job_id, j.start_at, j.end_at, count(h.article_id) AS total_count, count(b.article_id) AS fail_count FROM batch_jobs j LEFT JOIN h USING (job_id) LEFT JOIN bad b ON b.article_id = h.article_id GROUP BY ALL""")(
    lambda t: iv.job_stats(t.batch_jobs, t.article_views, fl.incomplete(t.articles_p)))
LEX = "SELECT DISTINCT n_name AS k, substr(lower(n_name),1,3) AS keyword, CASE WHEN n_regionkey < 2 THEN 'positive' ELSE 'negative' END AS sentiment, CAST(n_nationkey AS DOUBLE) / CAST(10 AS DOUBLE) AS weight FROM nation"
query("lexicon_hits", f"""WITH l AS ({LEX}) SELECT a.article_id, l.keyword, l.sentiment, l.weight,
  ((length(content) - length(replace(content, l.keyword, ''))) / length(l.keyword))::BIGINT AS hits FROM articles a JOIN l ON contains(a.content, l.keyword)""")(
    lambda t: jn.lexicon_hits(t.articles, t.sql(LEX), "content", "article_id"))
query("related_articles", f"""WITH b AS (SELECT article_id, scope_id, coalesce(sentiment,'neutral') AS s, published_at, {LIVE} AS live FROM articles WHERE scope_id IS NOT NULL),
 p AS (SELECT x.article_id, y.article_id AS o, y.s AS os, x.s AS xs, row_number() OVER (PARTITION BY x.article_id ORDER BY y.published_at DESC, y.article_id) AS rn
   FROM b x JOIN b y ON x.scope_id = y.scope_id AND x.article_id <> y.article_id AND y.live)
 SELECT b.article_id, (SELECT min_by(o, rn) FROM p WHERE p.article_id = b.article_id AND os = xs) AS same_id,
   (SELECT min_by(o, rn) FROM p WHERE p.article_id = b.article_id AND os <> xs) AS different_id FROM b
   WHERE b.scope_id IN (SELECT scope_id FROM b WHERE live)""")(
    lambda t: jn.related(t.articles))
COUNTS = f"SELECT p.category, count(*) AS cnt FROM perspectives p JOIN articles a USING (article_id) WHERE rnk = 1 AND category <> '미분류' AND {LIVE} GROUP BY 1"
query("viewpoint_default", f"""WITH c AS ({COUNTS}) SELECT m.es_category, m.display_title, coalesce(c.cnt, 0) AS cnt FROM viewpoint_master m LEFT JOIN c ON c.category = m.es_category
 ORDER BY coalesce(c.cnt, 0) DESC, m.sort_order LIMIT 1""")(
    lambda t: jn.viewpoint_select(t.viewpoint_master, ag.rank1_counts(t.articles_p)).select("es_category", "display_title", "cnt"))
query("viewpoint_chosen", f"""WITH c AS ({COUNTS}) SELECT m.es_category, m.display_title, coalesce(c.cnt, 0) AS cnt FROM viewpoint_master m LEFT JOIN c ON c.category = m.es_category WHERE m.display_title = 'View 05'""")(
    lambda t: jn.viewpoint_select(t.viewpoint_master, ag.rank1_counts(t.articles_p), "View 05").select("es_category", "display_title", "cnt"))
query("user_views_page", f"""WITH p AS (SELECT article_id, created_at FROM article_views WHERE user_id = (SELECT min(user_id) FROM article_views) AND is_valid_view ORDER BY created_at DESC, article_id LIMIT 10 OFFSET 5)
 SELECT p.article_id, p.created_at, a.title, a.press FROM p JOIN articles a USING (article_id) WHERE a.title IS NOT NULL AND {LIVE}""")(
    lambda t: jn.user_history(t.article_views, t.articles, t.article_views.agg(F.min("user_id")).scalar(), 2, 5, valid_only=True).unionByName(
        jn.user_history(t.article_views, t.articles, t.article_views.agg(F.min("user_id")).scalar(), 3, 5, valid_only=True)))
SCOPE_HIT = "contains(lower(scope_keywords), 'an') AND news_count >= 5"
SCOPE_SCORE = f"(CASE WHEN contains({norm('scope_title')}, ' an ') THEN 6 ELSE 0 END + CASE WHEN contains({norm('scope_summary')}, ' an ') THEN 3 ELSE 0 END)::DOUBLE"
query("scope_search", f"SELECT scope_id, {SCOPE_SCORE} AS score FROM scopes WHERE {SCOPE_HIT} ORDER BY score DESC, updated_at DESC, news_count DESC, scope_id LIMIT 5")(
    lambda t: jn.scope_search(t.scopes, "an").select("scope_id", "score"))
query("scope_search_recent", f"SELECT scope_id FROM scopes WHERE {SCOPE_HIT} ORDER BY updated_at DESC, news_count DESC, scope_id LIMIT 10")(
    lambda t: jn.scope_search(t.scopes, "an", 10, by="date").select("scope_id"))

# --- D: aggregates -------------------------------------------------------------------------------

query("press_terms", "SELECT press, count(*) AS cnt FROM articles GROUP BY 1 ORDER BY cnt DESC, press LIMIT 10")(lambda t: ag.terms(t.articles, "press", 10))
query("scope_cardinality", f"SELECT count(DISTINCT scope_id) AS distinct_values FROM articles WHERE {KEY_HIT}")(
    lambda t: ag.cardinality(t.articles.filter(fl.kw_contains("keywords", KW)), "scope_id", exact=True))
RANGE = "collected_at >= TIMESTAMP '2024-01-03' AND collected_at < TIMESTAMP '2024-01-21'"
query("collection_summary", f"""WITH c AS (SELECT count(*) AS c FROM raw_articles WHERE {RANGE}), a AS (SELECT * FROM articles WHERE {RANGE} AND {LIVE}), p AS (SELECT count(*) AS p FROM a)
 SELECT 'total' AS section, 'collected' AS label, c AS cnt FROM c UNION ALL SELECT 'total', 'processed', p FROM p UNION ALL SELECT 'total', 'removed', greatest(c - p, 0) FROM c, p
 UNION ALL SELECT 'press', press, count(*) FROM a GROUP BY 2 UNION ALL SELECT 'scope', scope_id, count(*) FROM a WHERE scope_id IS NOT NULL GROUP BY 2 UNION ALL SELECT 'sentiment', sentiment, count(*) FROM a WHERE sentiment IS NOT NULL GROUP BY 2""")(
    lambda t: ag.collection_summary(t.raw_articles, fl.enabled(t.articles), "2024-01-03", "2024-01-20"))
query("rank1_counts", COUNTS)(lambda t: ag.rank1_counts(t.articles_p))
KWALL = f"({KEY_HIT} OR contains({norm('title')}, ' {KW} ') OR contains({norm('summary')}, ' {KW} ') OR contains({norm('content')}, ' {KW} '))"
query("rank1_counts_keyword", COUNTS.replace("WHERE", f"WHERE {KWALL} AND"))(lambda t: ag.rank1_counts(t.articles_p, KW))
query("articles_per_day", "SELECT CAST(published_at + INTERVAL 9 HOUR AS DATE) AS day, count(*) AS cnt FROM articles GROUP BY 1")(lambda t: ag.per_day(t.articles, "published_at", 9))
query("score_histogram", "SELECT round(floor(round(sentiment_score / 0.05, 9)) * 0.05, 2) AS bucket, count(*) AS cnt FROM articles WHERE sentiment_score IS NOT NULL GROUP BY 1")(
    lambda t: ag.histogram(t.articles, "sentiment_score"))
query("confidence_stats", """SELECT coalesce(sentiment,'all') AS sentiment, count(*) AS cnt, round_even(round(avg(sentiment_score),9),4) AS avg_score, count(*) FILTER (sentiment_score >= 0.8) AS high,
 count(*) FILTER (sentiment_score >= 0.55 AND sentiment_score < 0.8) AS mid, count(*) FILTER (sentiment_score < 0.55) AS low, round_even(count(*) FILTER (sentiment_score < 0.55) / count(*), 4) AS low_rate
 FROM articles WHERE sentiment IS NOT NULL AND sentiment_score IS NOT NULL GROUP BY ROLLUP (sentiment)""")(lambda t: ag.confidence_stats(t.articles))
query("hot_articles", """WITH r AS (SELECT article_id, count(*) FILTER (reaction_type='like') AS like_count, count(*) FILTER (reaction_type='dislike') AS dislike_count, count(*) AS total FROM article_reactions GROUP BY 1
 ORDER BY total DESC, like_count DESC, article_id LIMIT 5) SELECT r.*, a.title, a.press FROM r JOIN articles a USING (article_id)""")(lambda t: ag.hot_articles(t.article_reactions, t.articles))


def quoted(words):
    return ", ".join(f"'{w}'" for w in words)


def duck_metric(pack=LATIN):
    stop, ends = quoted(pack.metric_stopwords), " OR ".join(f"ends_with(k, '{e}')" for e in pack.metric_endings)
    return f"length(k) >= 2 AND NOT regexp_full_match(k, '[0-9]+') AND k NOT IN ({stop}) AND NOT ({ends}) AND NOT contains(k, '@')"


WORDS = "SELECT article_id, CAST(published_at AS DATE) AS date, trim(translate(lower(trim(x)), '#\".,?!', '')) AS k FROM (SELECT *, unnest(string_split(keywords, ',')) AS x FROM articles WHERE {0})"
METRICS = f"SELECT date, k AS keyword, count(DISTINCT article_id) AS article_count FROM ({WORDS.format(LIVE)}) WHERE {duck_metric()} GROUP BY 1, 2"
query("daily_keyword_metrics", METRICS)(lambda t: ag.daily_keyword_metrics(t.articles, pack=LATIN))
query("daily_keyword_metrics_day", METRICS.replace("WHERE NOT coalesce", "WHERE CAST(published_at AS DATE) = DATE '2024-01-09' AND NOT coalesce"))(
    lambda t: ag.daily_keyword_metrics(t.articles, "2024-01-09", LATIN))
STORED = "SELECT CAST(ts AS DATE) AS date, CASE WHEN user_id % 3 = 0 THEN '#' || upper(event_type) || '!' WHEN user_id % 3 = 1 THEN event_type ELSE event_type || 'ing' END AS keyword, count(*) AS article_count FROM events GROUP BY 1, 2"
query("metrics_recleaned", f"SELECT date, k AS keyword, sum(article_count)::BIGINT AS article_count FROM (SELECT *, trim(translate(lower(trim(keyword)), '#\".,?!', '')) AS k FROM ({STORED})) WHERE {duck_metric()} GROUP BY 1, 2")(
    lambda t: ag.reclean_metrics(t.sql(STORED), LATIN))
query("metrics_removed", f"SELECT date, keyword, article_count FROM (SELECT *, trim(translate(lower(trim(keyword)), '#\".,?!', '')) AS k FROM ({STORED})) WHERE NOT ({duck_metric()})")(
    lambda t: ag.removed_metrics(t.sql(STORED), LATIN))
TOP_OK = f"length(k) > 1 AND k NOT IN ({quoted(LATIN.top_issue_stopwords)}) AND NOT contains(k, 'wh') AND NOT contains(k, 'aux')"
query("daily_top_issue", f"""WITH a AS (SELECT CAST(published_at + INTERVAL 9 HOUR AS DATE) AS date, sentiment, keywords FROM articles WHERE published_at >= TIMESTAMP '2024-01-04 15:00:00' AND published_at < TIMESTAMP '2024-01-20 15:00:00'),
 w AS (SELECT date, k, count(*) AS n FROM (SELECT date, unnest(string_split(keywords, ',')) AS k FROM a) WHERE {TOP_OK} GROUP BY 1, 2),
 b AS (SELECT date, k AS top_keyword, n AS total_mentions FROM w QUALIFY row_number() OVER (PARTITION BY date ORDER BY n DESC, k) = 1),
 s AS (SELECT a.date, count(*) AS t, count(*) FILTER (sentiment='positive') AS p, count(*) FILTER (sentiment='negative') AS g, count(*) FILTER (sentiment='neutral') AS u FROM a JOIN b ON a.date = b.date AND contains(a.keywords, b.top_keyword) WHERE sentiment IS NOT NULL GROUP BY 1)
 SELECT b.date, top_keyword, total_mentions, coalesce(p / t, 0) AS positive_ratio, coalesce(g / t, 0) AS negative_ratio, coalesce(u / t, 0) AS neutral_ratio FROM b LEFT JOIN s USING (date)""")(
    lambda t: ag.daily_top_issue(t.articles, "2024-01-05", "2024-01-20", 9, LATIN))
PCT = "coalesce(round_even({0} * 100.0 / nullif({1}, 0), 0), 0)::BIGINT"


def percents(total):
    p, n = PCT.format("positive", total), PCT.format("neutral", total)
    return f"{p} AS positive_percent, {n} AS neutral_percent, CASE WHEN {total} > 0 THEN 100 - {p} - {n} ELSE 0 END::BIGINT AS negative_percent"


LABELS = "count(*) FILTER (sentiment='positive') AS positive, count(*) FILTER (sentiment='neutral') AS neutral, count(*) FILTER (sentiment='negative') AS negative"
query("press_sentiment_percent", f"""WITH c AS (SELECT press, {LABELS} FROM articles GROUP BY 1)
 SELECT press, positive, neutral, negative, {percents('(positive + neutral + negative)')},
 CASE WHEN positive >= neutral AND positive >= negative THEN 'positive' WHEN neutral >= negative THEN 'neutral' ELSE 'negative' END AS dominant FROM c""")(
    lambda t: ag.sentiment_percent(t.articles.groupBy("press").agg(*ag.label_counts())).withColumn("dominant", lb.dominant_label("positive", "neutral", "negative")))
query("scope_sentiment", """SELECT scope_id, count(*) AS scored_count, CASE WHEN count(*) >= 3 THEN round_even(round(avg(sentiment_score),9),4) ELSE 0 END AS sentiment_score,
 CASE WHEN count(*) >= 3 THEN round_even(count(*) FILTER (sentiment='positive')/count(*),4) END AS positive, CASE WHEN count(*) >= 3 THEN round_even(count(*) FILTER (sentiment='neutral')/count(*),4) END AS neutral,
 CASE WHEN count(*) >= 3 THEN round_even(count(*) FILTER (sentiment='negative')/count(*),4) END AS negative FROM articles WHERE scope_id IS NOT NULL AND sentiment IS NOT NULL GROUP BY 1""")(
    lambda t: ag.scope_sentiment(t.articles))
query("scope_keywords", """WITH w AS (SELECT scope_id, k, count(*) AS n FROM (SELECT scope_id, unnest(string_split(keywords, ',')) AS k FROM articles WHERE scope_id IS NOT NULL UNION ALL
   SELECT scope_id, unnest(string_split(scope_keywords || ',' || scope_keywords, ',')) AS k FROM scopes) WHERE k <> '' GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY scope_id ORDER BY n DESC, k) AS rn FROM w)
 SELECT scope_id, string_agg(k, ',' ORDER BY rn) AS scope_keywords, 'ok' AS scope_keywords_status FROM r WHERE rn <= 5 GROUP BY 1""")(
    lambda t: ag.scope_keywords(t.articles, t.scopes))
query("keyword_ranking", """SELECT k AS keyword, count(*) AS frequency, row_number() OVER (ORDER BY count(*) DESC, k) AS rank FROM (SELECT unnest(string_split(keywords, ',')) AS k FROM articles) WHERE k <> '' GROUP BY 1""")(
    lambda t: ag.keyword_ranking(t.articles))
query("enrichment_status", """WITH e AS (SELECT a.*, v.vec_id FROM articles a LEFT JOIN embeddings v ON v.vec_id = a.doc_id)
 SELECT 'no_embedding_news' AS measure, count(*) FILTER (vec_id IS NULL) AS cnt FROM e UNION ALL SELECT 'unclassified_news', count(*) FILTER (scope_id IS NULL) FROM e
 UNION ALL SELECT 'no_sentiment_news', count(*) FILTER (scope_id IS NOT NULL AND sentiment IS NULL) FROM e UNION ALL SELECT 'no_summary_news', count(*) FILTER (summary IS NULL) FROM e
 UNION ALL SELECT 'no_keywords_news', count(*) FILTER (keywords IS NULL) FROM e UNION ALL SELECT 'positive_news', count(*) FILTER (sentiment='positive') FROM e
 UNION ALL SELECT 'neutral_news', count(*) FILTER (sentiment='neutral') FROM e UNION ALL SELECT 'negative_news', count(*) FILTER (sentiment='negative') FROM e
 UNION ALL SELECT 'total_scopes', count(*) FROM scopes UNION ALL SELECT 'no_scope_title', count(*) FILTER (scope_title IS NULL) FROM scopes UNION ALL SELECT 'has_scope_title', count(scope_title) FROM scopes
 UNION ALL SELECT 'no_scope_keywords', count(*) FILTER (scope_keywords IS NULL) FROM scopes UNION ALL SELECT 'no_scope_summary', count(*) FILTER (scope_summary IS NULL) FROM scopes""")(
    lambda t: ag.enrichment_status(t.articles.join(t.embeddings, F.col("vec_id") == F.col("doc_id"), "left"), t.scopes))
TRUTH = "SELECT article_id, corrected_sentiment AS true_label FROM corrections WHERE id % 2 = 1"
PRED = "SELECT article_id, sentiment AS pred_label, sentiment_score AS pred_score FROM articles WHERE sentiment IS NOT NULL"
query("confusion_matrix", f"SELECT true_label, pred_label, count(*) AS cnt FROM ({PRED}) JOIN ({TRUTH}) USING (article_id) GROUP BY 1, 2")(lambda t: ag.confusion(t.sql(PRED), t.sql(TRUTH)))
query("class_report", f"""WITH x AS (SELECT true_label, pred_label FROM ({PRED}) JOIN ({TRUTH}) USING (article_id)), l AS (SELECT unnest(['positive','negative','neutral']) AS label),
 c AS (SELECT label, count(*) FILTER (true_label = label AND pred_label = label) AS tp, count(*) FILTER (true_label = label) AS s, count(*) FILTER (pred_label = label) AS q FROM l, x GROUP BY 1),
 m AS (SELECT label, coalesce(tp / nullif(q,0),0) AS p, coalesce(tp / nullif(s,0),0) AS r, s FROM c), f AS (SELECT label, round_even(p,4) AS precision, round_even(r,4) AS recall, round_even(coalesce(2*p*r/nullif(p+r,0),0),4) AS f1, s AS support FROM m)
 SELECT label, precision, recall, f1, support FROM f UNION ALL SELECT 'macro', round_even(avg(precision),4), round_even(avg(recall),4), round_even(avg(f1),4), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'weighted', round_even(sum(precision*support)/sum(support),4), round_even(sum(recall*support)/sum(support),4), round_even(sum(f1*support)/sum(support),4), sum(support)::BIGINT FROM f
 UNION ALL SELECT 'accuracy', a, a, a, n FROM (SELECT round_even(count(*) FILTER (true_label = pred_label) / count(*), 4) AS a, count(*) AS n FROM x)""")(
    lambda t: ag.class_report(ag.confusion(t.sql(PRED), t.sql(TRUTH))))
query("misclassified", f"SELECT article_id, pred_label, pred_score, true_label FROM ({PRED}) JOIN ({TRUTH}) USING (article_id) WHERE pred_label <> true_label ORDER BY pred_score DESC, article_id LIMIT 30")(
    lambda t: ag.misclassified(t.sql(PRED), t.sql(TRUTH)))
query("daily_trend", """SELECT d::DATE AS day, coalesce(v.n, 0) AS views, coalesce(s.n, 0) AS signups FROM (SELECT unnest(range(least((SELECT min(created_at)::DATE FROM users), DATE '2024-02-03' - 6)::TIMESTAMP, TIMESTAMP '2024-02-04', INTERVAL 1 DAY)) AS d)
 LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS n FROM article_views GROUP BY 1) v ON v.day = d::DATE LEFT JOIN (SELECT created_at::DATE AS day, count(*) AS n FROM users GROUP BY 1) s ON s.day = d::DATE""")(
    lambda t: ag.daily_trend(t.article_views, t.users, "2024-02-03"))
SESSIONS = """SELECT user_id, day, created_at AS login_at, CASE WHEN ne = 'logout' THEN greatest(floor((epoch_us(nt) - epoch_us(created_at)) / 1000000), 0) ELSE 300 END::BIGINT AS stay_seconds FROM (
 SELECT user_id, event_type, created_at, created_at::DATE AS day, lead(event_type) OVER w AS ne, lead(created_at) OVER w AS nt FROM login_logs WHERE result = 'success' WINDOW w AS (PARTITION BY user_id, created_at::DATE ORDER BY created_at, event_type)) WHERE event_type = 'login'"""
query("login_sessions", SESSIONS)(lambda t: iv.pair_sessions(t.login_logs))
query("usage_stats", f"""WITH s AS ({SESSIONS}), d AS (SELECT day, count(DISTINCT user_id) AS u, sum(stay_seconds) AS total FROM s GROUP BY 1), v AS (SELECT created_at::DATE AS day, count(*) AS n FROM article_views WHERE is_valid_view GROUP BY 1)
 SELECT coalesce(d.day, v.day) AS day, coalesce(u,0) AS daily_users, coalesce(total,0)::BIGINT AS total_stay_seconds, coalesce(round_even(total / u, 2), 0) AS avg_stay_seconds, coalesce(n,0) AS daily_article_views,
 (coalesce(total,0)::BIGINT // 3600)::VARCHAR || '시간 ' || (coalesce(total,0)::BIGINT % 3600 // 60)::VARCHAR || '분' AS total_stay_text,
 (floor(coalesce(total / u,0))::BIGINT // 3600)::VARCHAR || '시간 ' || (floor(coalesce(total / u,0))::BIGINT % 3600 // 60)::VARCHAR || '분' AS avg_stay_text FROM d FULL JOIN v ON d.day = v.day""")(
    lambda t: ag.usage_stats(t.login_logs, t.article_views))
query("press_flow", "SELECT press, sentiment AS flow, n AS flow_count FROM (SELECT press, sentiment, count(*) AS n FROM articles WHERE sentiment IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY press ORDER BY n DESC, sentiment) = 1")(
    lambda t: rp.press_mode(t.articles))
query("vector_centroids", """WITH c AS (SELECT label, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT label, pos, sum(x) AS x FROM c GROUP BY 1, 2)
 SELECT label, (pos - 1)::INT AS pos, round(x / sqrt(sum(x * x) OVER (PARTITION BY label)), 5) AS value FROM s""")(
    lambda t: ag.centroid(t.embeddings, "label").select("label", F.posexplode("centroid").alias("pos", "value")).withColumn("value", F.round("value", 5)))
query("scope_stats", "SELECT scope_id, news_count FROM scopes ORDER BY news_count DESC, scope_id LIMIT 20")(lambda t: ag.scope_stats(t.scopes).select("scope_id", "news_count"))
query("scope_recount", f"SELECT scope_id, count(*) AS news_count FROM articles WHERE scope_id IS NOT NULL AND {LIVE} GROUP BY 1")(lambda t: ag.recount_scopes(t.articles))

# --- E, F: windows, ranking, paging --------------------------------------------------------------

query("rank_by_count", "SELECT press, count(*) AS cnt, row_number() OVER (ORDER BY count(*) DESC, press) AS rank FROM articles GROUP BY 1")(lambda t: rk.rank_by(ag.terms(t.articles, "press"), "cnt", "press"))
query("press_samples", "SELECT press, article_id, url, title FROM articles QUALIFY row_number() OVER (PARTITION BY press ORDER BY published_at DESC, article_id DESC) = 1")(lambda t: rp.press_samples(t.articles))
query("sentiment_compare", f"""SELECT sentiment, article_id FROM articles WHERE {LIVE} AND sentiment IS NOT NULL AND published_at >= TIMESTAMP '2024-01-28' AND ({KEY_HIT} OR contains({norm('title')}, ' {KW} ') OR contains({norm('summary')}, ' {KW} '))
 QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY published_at DESC, (CASE WHEN {KEY_HIT} THEN 8 ELSE 0 END + CASE WHEN contains({norm('title')}, ' {KW} ') THEN 5 ELSE 0 END + CASE WHEN contains({norm('summary')}, ' {KW} ') THEN 3 ELSE 0 END) DESC, article_id) = 1""")(
    lambda t: rp.sentiment_compare(t.articles, KW, NOW).select("sentiment", "article_id"))
query("newest_three_per_press", "SELECT scope_id, press, article_id FROM articles WHERE scope_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope_id, press ORDER BY published_at DESC, article_id) <= 3")(
    lambda t: rk.top_per(t.articles.filter("scope_id IS NOT NULL"), ["scope_id", "press"], [F.desc("published_at"), F.asc("article_id")], 3).select("scope_id", "press", "article_id"))
query("newest_twenty_per_scope", "SELECT scope_id, article_id FROM articles WHERE scope_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY published_at DESC, article_id) <= 20")(
    lambda t: rk.top_per(t.articles.filter("scope_id IS NOT NULL"), ["scope_id"], [F.desc("published_at"), F.asc("article_id")], 20).select("scope_id", "article_id"))
query("login_fail_streak", """WITH r AS (SELECT *, created_at::DATE AS d, sum(CASE WHEN result = 'success' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, created_at::DATE ORDER BY created_at, log_id) AS island FROM login_logs)
 SELECT log_id, user_id, created_at, CASE WHEN result = 'success' THEN 0 ELSE sum(CASE WHEN result = 'success' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, d, island ORDER BY created_at, log_id) END::BIGINT AS fail_streak FROM r""")(
    lambda t: iv.failure_streak(t.login_logs, "log_id", slice_seconds=3600).select("log_id", "user_id", "created_at", "fail_streak"))
query("first_per_url", "SELECT url, article_id FROM articles QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id) = 1")(lambda t: rk.keep_first(t.articles.select("url", "article_id", "doc_id"), ["url"], "doc_id").select("url", "article_id"))
query("prefix_within", """WITH c AS (SELECT press, count(*) AS cnt FROM articles GROUP BY 1), r AS (SELECT *, sum(length(press)) OVER (ORDER BY cnt DESC, press) AS used_length, row_number() OVER (ORDER BY cnt DESC, press) AS rn FROM c)
 SELECT press, cnt, used_length::BIGINT AS used_length FROM r WHERE used_length <= 32 AND rn <= 9""")(
    lambda t: rk.prefix_within(ag.terms(t.articles, "press"), "press", [F.desc("cnt"), F.asc("press")], 32, 9))
USED = "SELECT '20240131-' || lpad(CAST(n_nationkey AS STRING), 4, '0') AS scope_id FROM nation"
query("next_scope_ids", f"SELECT article_id, '20240131-' || lpad((24 + row_number() OVER (ORDER BY published_at, article_id))::VARCHAR, 4, '0') AS new_id FROM articles WHERE scope_id IS NULL")(
    lambda t: rk.next_ids(t.articles.filter("scope_id IS NULL").select("article_id", "published_at"), [F.asc("published_at"), F.asc("article_id")], "20240131", t.sql(USED), "scope_id").select("article_id", "new_id"))
FILLS = "SELECT event_id, ts, CASE WHEN event_type = 'purchase' THEN value END AS price FROM events"
query("fill_last_price", f"SELECT event_id, last_value(price IGNORE NULLS) OVER (ORDER BY ts, event_id) AS price_filled FROM ({FILLS})")(
    lambda t: iv.fill_last(t.sql(FILLS), "price", "ts", "event_id").select("event_id", "price_filled"))
query("latest_day_top_keywords", f"WITH m AS ({METRICS}) SELECT date, keyword, article_count FROM m WHERE date = (SELECT max(date) FROM m) ORDER BY article_count DESC, keyword LIMIT 5")(
    lambda t: rk.top_k(rk.latest_rows(durable(ag.daily_keyword_metrics(t.articles, pack=LATIN)), "date"), [F.desc("article_count"), F.asc("keyword")], 5))
query("articles_page", f"SELECT article_id, published_at FROM articles WHERE {LIVE} ORDER BY published_at DESC, article_id LIMIT 20 OFFSET 40")(
    lambda t: rk.page(fl.enabled(t.articles).select("article_id", "published_at"), [F.desc("published_at"), F.asc("article_id")], 3, 20))
query("articles_page_info", f"SELECT count(*) AS total, count(*) > 60 AS has_more FROM articles WHERE {LIVE}")(lambda t: rk.page_info(fl.enabled(t.articles), 3, 20))
query("random_scope", f"""SELECT s.*, live_count FROM scopes s JOIN (SELECT scope_id, count(*) AS live_count FROM articles WHERE {LIVE} AND scope_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 5) USING (scope_id)
 WHERE created_at >= TIMESTAMP '2024-01-01' AND created_at <= TIMESTAMP '2024-01-08' ORDER BY md5('0:' || scope_id), scope_id LIMIT 1""")(
    lambda t: rp.random_scope(t.articles, t.scopes, "2024-01-08 00:00:00"))
query("random_keyword", f"""WITH m AS ({METRICS}), b AS (SELECT * FROM m WHERE date = (SELECT max(date) FROM m) ORDER BY article_count DESC, keyword LIMIT 10)
 SELECT date, keyword, article_count FROM b ORDER BY md5('0:' || keyword), keyword LIMIT 1""")(
    lambda t: rp.random_keyword(durable(ag.daily_keyword_metrics(t.articles, pack=LATIN))))
query("merged_logs", """WITH a AS (SELECT history_id AS id, occurred_at, status, NULL AS error_code FROM process_logs ORDER BY occurred_at DESC, id DESC LIMIT 100),
 b AS (SELECT e.history_id AS id, p.occurred_at, NULL AS status, e.error_code FROM error_logs e JOIN process_logs p USING (history_id) ORDER BY occurred_at DESC, id DESC LIMIT 100) SELECT * FROM a UNION ALL SELECT * FROM b""")(
    lambda t: rk.merge_logs(t.process_logs.select(F.col("history_id").alias("id"), "occurred_at", "status"),
                            t.error_logs.join(t.process_logs, "history_id").select(F.col("history_id").alias("id"), "occurred_at", "error_code"), "occurred_at", "id", 100))
query("suggest_words", f"""WITH s AS (SELECT article_id, published_at, title, keywords, CASE WHEN contains(coalesce(keywords, ''), 'tion') THEN 5 ELSE 0 END + CASE WHEN contains({norm('title')}, ' tion') THEN 3 ELSE 0 END AS score FROM articles WHERE {LIVE}),
 w AS (SELECT score, published_at, article_id, list_concat(list_filter(list_transform(string_split(coalesce(keywords, ''), ','), lambda k: trim(k)), lambda k: k <> ''),
   CASE WHEN contains(coalesce(title, ''), 'tion') THEN list_transform(list_filter(regexp_split_to_array(translate(title, '…·', '  '), '\\s+'), lambda t: t <> ''), lambda t: trim(t, '[]()"''‘’“”,.')) ELSE [] END) AS ws FROM s WHERE score > 0),
 f AS (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS i, score, published_at, article_id FROM w),
 o AS (SELECT *, row_number() OVER (ORDER BY score DESC, published_at DESC, article_id, i) AS n FROM f WHERE contains(word, 'tion'))
 SELECT word FROM (SELECT word, min(n) AS n FROM o GROUP BY 1) ORDER BY n LIMIT 6""")(lambda t: rp.suggest(t.articles, "tion"))
query("balanced_sample", "SELECT sentiment, article_id FROM articles WHERE sentiment_score >= 0.8 AND sentiment IS NOT NULL QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY sentiment_score DESC, article_id) <= 100")(
    lambda t: rk.top_per(t.articles.filter("sentiment IS NOT NULL AND sentiment_score >= 0.8"), ["sentiment"], [F.desc("sentiment_score"), F.asc("article_id")], 100).select("sentiment", "article_id"))

# --- reports -------------------------------------------------------------------------------------

HITS = f"SELECT * FROM articles WHERE {LIVE} AND {KEY_HIT}"
query("keyword_detail", f"""WITH h AS ({HITS}), c AS (SELECT count(*) AS total_count, count(DISTINCT scope_id) AS scope_count, {LABELS} FROM h), n AS (SELECT * FROM h)
 SELECT '{KW}' AS keyword, total_count, scope_count, {percents('total_count')}, (SELECT count(DISTINCT press) FROM n) AS press_count,
 (SELECT category FROM n JOIN perspectives p USING (article_id) WHERE rnk = 1 AND category <> '미분류' GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 1) AS flow,
 (SELECT count(*) FROM scopes WHERE contains(lower(scope_keywords), '{KW}')) AS issue_count FROM c""")(lambda t: rp.keyword_detail(t.articles_p, t.scopes, KW))
query("keyword_articles", f"""SELECT article_id, press, coalesce(nullif(title,''),'제목 없음') AS title, coalesce(nullif(summary,''), substr(content,1,120)) AS description, coalesce(sentiment,'neutral') AS sentiment,
  strftime(published_at, '%Y-%m-%d') AS published_on, url FROM ({HITS}) ORDER BY published_at DESC, article_id LIMIT 50""")(lambda t: rp.keyword_articles(t.articles, KW))
GROUPS = "SELECT group_name, es_category AS category FROM viewpoint_master"
query("viewpoint_cards", f"""WITH c AS ({COUNTS}), g AS ({GROUPS}) SELECT group_name, category, coalesce(cnt,0) AS cnt, {PCT.format('coalesce(cnt,0)', '(SELECT sum(cnt) FROM c)')} AS percent,
 CASE WHEN coalesce(cnt,0) > 0 AND {PCT.format('coalesce(cnt,0)', '(SELECT sum(cnt) FROM c)')} = 0 THEN '<1%' ELSE ({PCT.format('coalesce(cnt,0)', '(SELECT sum(cnt) FROM c)')})::VARCHAR || '%' END AS percent_label FROM g LEFT JOIN c USING (category)""")(
    lambda t: rp.viewpoint_cards(ag.rank1_counts(t.articles_p), t.sql(GROUPS)))
query("viewpoint_detail", f"""WITH r AS (SELECT a.*, p.category FROM articles a JOIN perspectives p USING (article_id) WHERE rnk = 1 AND category <> '미분류' AND {LIVE}),
 c AS (SELECT category, count(*) AS cnt, max(published_at) AS latest_at, {LABELS} FROM r GROUP BY 1), w AS (SELECT category, k, count(*) AS n FROM (SELECT category, unnest(string_split(keywords, ',')) AS k FROM r) WHERE k <> '' GROUP BY 1, 2),
 t AS (SELECT category, string_agg(k, ',' ORDER BY n DESC, k) AS top_keywords FROM (SELECT * FROM w QUALIFY row_number() OVER (PARTITION BY category ORDER BY n DESC, k) <= 8) GROUP BY 1),
 j AS (SELECT m.*, c.category, coalesce(cnt,0) AS cnt, latest_at, coalesce(positive,0) AS positive, coalesce(neutral,0) AS neutral, coalesce(negative,0) AS negative, coalesce(top_keywords,'') AS top_keywords FROM viewpoint_master m LEFT JOIN c ON c.category = m.es_category LEFT JOIN t ON t.category = m.es_category)
 SELECT group_name, display_title, es_category, cnt, {PCT.format('cnt', '(SELECT sum(cnt) FROM c)')} AS percent, CASE WHEN latest_at IS NULL THEN '기준일' ELSE '기준일 ' || strftime(latest_at, '%Y.%m.%d') END AS date_label, {percents('(positive + neutral + negative)')}, top_keywords FROM j""")(
    lambda t: rp.viewpoint_detail(t.articles_p, t.viewpoint_master))
query("viewpoint_newest", f"SELECT a.article_id FROM articles a JOIN perspectives p USING (article_id) WHERE rnk = 1 AND category = 'C04' AND {LIVE} ORDER BY published_at DESC, a.article_id LIMIT 5")(
    lambda t: rp.viewpoint_newest(t.articles_p, "C04").select("article_id"))
HELD = f"SELECT * FROM articles WHERE scope_id IS NOT NULL AND {LIVE}"
query("scope_detail", f"""WITH t AS ({HELD}), c AS (SELECT scope_id, count(*) AS article_count, count(*) FILTER (sentiment='positive') AS positive, count(*) FILTER (coalesce(sentiment,'neutral')='neutral') AS neutral, count(*) FILTER (sentiment='negative') AS negative FROM t GROUP BY 1)
 SELECT s.scope_id, s.scope_title, array_to_string(list_filter(string_split(s.scope_keywords, ','), lambda k: k <> '')[1:5], ',') AS first_keywords, coalesce(article_count,0) AS article_count, {percents('article_count')}, strftime(s.updated_at, '%H:%M') AS updated_clock FROM scopes s LEFT JOIN c USING (scope_id)""")(
    lambda t: rp.scope_detail(t.articles, t.scopes))
query("scope_viewpoints", f"""WITH t AS ({HELD}), n AS (SELECT scope_id, count(*) AS a FROM t GROUP BY 1), c AS (SELECT scope_id, category, count(*) AS cnt FROM t JOIN perspectives p USING (article_id) WHERE category <> '미분류' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY scope_id ORDER BY count(*) DESC, category) <= 4)
 SELECT scope_id, category, cnt, {PCT.format('cnt', 'a')} AS percent FROM c JOIN n USING (scope_id)""")(lambda t: rp.scope_viewpoints(t.articles_p))
TOPIC_HIT = " OR ".join(f"contains({norm(c)}, ' {TOPIC} ')" for c in ("title", "summary", "keywords", "content"))
query("issue_chips", f"""WITH f AS (SELECT scope_id FROM articles WHERE {LIVE} AND scope_id IS NOT NULL AND ({TOPIC_HIT})),
 k AS (SELECT keyword, count(*) AS cnt FROM (SELECT unnest(string_split(scope_keywords, ',')) AS keyword FROM scopes WHERE scope_id IN (SELECT scope_id FROM f)) WHERE keyword <> '' AND keyword <> '{TOPIC}' AND keyword NOT IN ('co', 'kr') GROUP BY 1),
 r AS (SELECT *, sum(length(keyword)) OVER (ORDER BY cnt DESC, keyword) AS used_length, row_number() OVER (ORDER BY cnt DESC, keyword) AS rn FROM k) SELECT keyword, cnt, used_length::BIGINT AS used_length FROM r WHERE rn <= 5 AND used_length <= 32""")(
    lambda t: rp.issue_chips(t.articles, t.scopes, TOPIC))
query("dominant_opinions", f"""WITH b AS (SELECT scope_id, scope_title, scope_keywords FROM scopes WHERE {SCOPE_HIT} ORDER BY {SCOPE_SCORE} DESC, updated_at DESC, news_count DESC, scope_id LIMIT 5),
 c AS (SELECT scope_id, {LABELS} FROM articles WHERE {LIVE} GROUP BY 1), p AS (SELECT b.*, {percents('(positive + neutral + negative)')} FROM b LEFT JOIN c USING (scope_id))
 SELECT scope_id, positive_percent, neutral_percent, negative_percent, CASE WHEN positive_percent >= neutral_percent AND positive_percent >= negative_percent THEN 'positive' WHEN neutral_percent >= negative_percent THEN 'neutral' ELSE 'negative' END AS dominant FROM p""")(
    lambda t: rp.dominant_opinions(t.scopes, t.articles, "an").select("scope_id", "positive_percent", "neutral_percent", "negative_percent", "dominant"))

# --- A, G: tables and sets -----------------------------------------------------------------------

BATCH = "SELECT user_id, event_type AS name, value AS score, event_id FROM events WHERE event_type IN ('click', 'view')"
TARGET = "SELECT user_id, name, CAST(0 AS DOUBLE) AS score FROM users"
query("upsert_rows", f"""WITH n AS (SELECT user_id, name, score FROM ({BATCH}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT * FROM n UNION ALL SELECT * FROM ({TARGET}) o WHERE user_id NOT IN (SELECT user_id FROM n)""")(lambda t: tb.upsert(t.sql(TARGET), t.sql(BATCH), ["user_id"], "event_id"))
query("upsert_counts", f"""SELECT count(*) FILTER (o.user_id IS NULL) AS inserted, count(*) FILTER (o.user_id IS NOT NULL) AS updated FROM (SELECT DISTINCT user_id FROM ({BATCH})) n LEFT JOIN ({TARGET}) o USING (user_id)""")(
    lambda t: tb.upsert_counts(t.sql(TARGET), t.sql(BATCH), ["user_id"], "event_id"))
query("patch_rows", """SELECT a.article_id, a.press, coalesce(c.corrected_sentiment, a.sentiment) AS sentiment FROM articles a LEFT JOIN (SELECT article_id, corrected_sentiment FROM corrections WHERE id % 2 = 1) c USING (article_id)""")(
    lambda t: tb.patch(t.articles.select("article_id", "press", "sentiment"), t.sql("SELECT article_id, corrected_sentiment AS sentiment FROM corrections WHERE id % 2 = 1"), ["article_id"], ["sentiment"]))


def stored(t, df, key):
    """A stored copy of a table in the shared folder, by key."""
    return KeyedTable(t.spark, f"{shared_folder(t.spark)}/keyed-{uuid.uuid4().hex}", key, 16).create(df)


def upsert_stored(t):
    table = stored(t, t.sql(TARGET), ["user_id"])
    table.upsert(t.sql(BATCH), "event_id")
    return table.read()


PATCHES = "SELECT 'DOC_' || CAST(user_id * 9 AS STRING) AS article_id, CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_type END AS sentiment, CASE WHEN event_id % 2 = 0 THEN value END AS sentiment_score, event_id FROM events WHERE user_id % 4 = 1"


def patch_stored(t):
    table = stored(t, t.articles.select("article_id", "press", "sentiment", "sentiment_score"), ["article_id"])
    table.patch(t.sql(PATCHES), ["sentiment", "sentiment_score"], "event_id")
    return table.read()


# the days of one week written anew, with a mark on their titles; the other days stay as they are stored
def replaced_days(t):
    path = f"{shared_folder(t.spark)}/days-{uuid.uuid4().hex}"
    days = t.sql("SELECT article_id, title, CAST(CAST(published_at AS DATE) AS STRING) AS day FROM articles")
    replace_partition(days, path, "day")
    replace_partition(days.filter("day BETWEEN '2024-01-08' AND '2024-01-14'").withColumn("title", F.concat(F.lit("* "), "title")), path, "day")
    return t.spark.read.parquet(path).select("article_id", "title", F.col("day").cast("string").alias("day"))


query("upsert_stored", f"""WITH n AS (SELECT user_id, name, score FROM ({BATCH}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT * FROM n UNION ALL SELECT * FROM ({TARGET}) o WHERE user_id NOT IN (SELECT user_id FROM n)""")(upsert_stored)
query("patch_stored", f"""WITH n AS (SELECT article_id, arg_max(sentiment, event_id) FILTER (sentiment IS NOT NULL) AS s, arg_max(sentiment_score, event_id) FILTER (sentiment_score IS NOT NULL) AS c FROM ({PATCHES}) GROUP BY 1)
 SELECT a.article_id, a.press, coalesce(s, a.sentiment) AS sentiment, coalesce(c, a.sentiment_score) AS sentiment_score FROM articles a LEFT JOIN n USING (article_id)""")(patch_stored)
query("replaced_days", "SELECT article_id, CASE WHEN CAST(published_at AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' THEN '* ' || title ELSE title END AS title, CAST(CAST(published_at AS DATE) AS VARCHAR) AS day FROM articles")(replaced_days)
query("insert_ignored", f"""WITH n AS (SELECT user_id, name, score FROM ({BATCH}) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id) = 1) SELECT * FROM ({TARGET}) UNION ALL SELECT * FROM n WHERE user_id NOT IN (SELECT user_id FROM ({TARGET}))""")(
    lambda t: tb.insert_ignore(t.sql(TARGET), t.sql(BATCH), ["user_id"], "event_id"))
query("stage_log", """SELECT article_id, 'S501' AS code_id, CASE WHEN summary IS NULL THEN 'fail' ELSE 'success' END AS status, CASE WHEN summary IS NULL THEN 'E007' END AS error_code, CASE WHEN summary IS NULL THEN 'summary' END AS error_message FROM articles""")(
    lambda t: tb.stage_log(t.articles, "S501", F.col("summary").isNull(), F.lit("summary")))
query("union_logs", "SELECT article_id, status, NULL AS reaction_type FROM process_logs UNION ALL SELECT article_id, NULL, reaction_type FROM article_reactions")(
    lambda t: tb.union_all(t.process_logs.select("article_id", "status"), t.article_reactions.select("article_id", "reaction_type")))
query("common_words", """SELECT article_id, array_to_string(list_sort(list_distinct(list_intersect(string_split(lower(title), ' '), string_split(keywords, ',')))), ',') AS common FROM articles""")(
    lambda t: tb.common_items(t.articles.select("article_id", F.split(F.lower("title"), " ").alias("a"), F.split("keywords", ",").alias("b")), "a", "b").select("article_id", F.array_join(F.array_sort("common"), ",").alias("common")))
STOP_A, STOP_B = "SELECT lower(n_name) AS word FROM nation", "SELECT lower(r_name) AS word FROM region"
KWORDS = "SELECT DISTINCT event_type AS word FROM events UNION ALL SELECT lower(n_name) AS word FROM nation"
query("stopword_union", f"SELECT word FROM ({STOP_A}) UNION SELECT word FROM ({STOP_B})")(lambda t: tb.stopword_set(t.sql(STOP_A), t.sql(STOP_B)))
query("without_stopwords", f"SELECT word FROM ({KWORDS}) WHERE word NOT IN (SELECT word FROM ({STOP_A}))")(lambda t: tb.drop_stopwords(t.sql(KWORDS), t.sql(STOP_A)))
query("dedupe_last", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1")(
    lambda t: tb.dedupe(t.events.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", "last"))
