"""Checked queries: sources, similarity, clean-up, summaries, scopes, viewpoints and models."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog import query
from checks.packs import LATIN
from checks.reads import LEX
from tidewire.operators import ingest as ig
from tidewire.operators import models as md
from tidewire.operators import scopes as sp
from tidewire.operators import similarity as sm
from tidewire.operators import summaries as su
from tidewire.operators import viewpoints as vp
from tidewire.session import durable, shared_folder
from tidewire.sources import pages as pg
from tidewire.sources import tables as tb

# --- A: sources ----------------------------------------------------------------------------------

PAGE_RULES = {"content": ["#dic_area", "article"], "press": ["span.press"], "author": ["article h1"]}
query("page_articles")(lambda t: pg.extract_articles(t.pages, PAGE_RULES).select("page_id", "url", "content", "press", "author"))
DECODED = "regexp_replace(replace(replace(replace(replace({0}, '&lt;', '<'), '&gt;', '>'), '&quot;', chr(34)), '&#39;', chr(39)), '&amp;?', '&', 'g')"
query("page_headlines", "SELECT page_id, trim(regexp_replace(" + DECODED.format("regexp_extract(html, '(?s)<article[^>]*>.*?<h1>(.*?)</h1>', 1)") + ", '\\(.*?\\)', '', 'g')) AS author, 'Unknown' AS press FROM pages")(
    lambda t: pg.extract_articles(t.pages, PAGE_RULES).select("page_id", "author", "press"))
query("page_links", """SELECT page_id, split_part(regexp_extract(item, '(?s)^.*<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 1), '?', 1) AS link,
 trim(regexp_replace(regexp_extract(item, '(?s)^.*<a\\b[^>]*?\\bhref="([^"]*)"[^>]*>(.*?)</a>', 2), '<[^>]*>', '', 'g')) AS title FROM (SELECT page_id, unnest(regexp_extract_all(html, '(?s)<li\\b[^>]*>(.*?)</li>', 1)) AS item FROM pages) WHERE contains(item, '<a ')""")(
    lambda t: pg.extract_links(t.pages))
SITES = [("net", r"example\.net/([a-z]+)/(\d+)", "NET_"), ("com", r"example\.com/([a-z]+)/(\d+)", "COM_")]
query("page_ids", """SELECT page_id, CASE WHEN regexp_matches(url, 'example\\.net/([a-z]+)/([0-9]+)') THEN 'NET_' || regexp_extract(url, 'example\\.net/([a-z]+)/([0-9]+)', 1) || '_' || regexp_extract(url, 'example\\.net/([a-z]+)/([0-9]+)', 2)
 WHEN regexp_matches(url, 'example\\.com/([a-z]+)/([0-9]+)') THEN 'COM_' || regexp_extract(url, 'example\\.com/([a-z]+)/([0-9]+)', 1) || '_' || regexp_extract(url, 'example\\.com/([a-z]+)/([0-9]+)', 2) END AS article_id FROM pages""")(
    lambda t: t.pages.select("page_id", pg.article_id_expr("url", SITES).alias("article_id")))


def feeds(t):
    safe = F.replace(F.replace("title", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    safe = F.regexp_replace(safe, r"[\x00-\x08\x0b\x0c\x0e-\x1f]", "")
    when = F.date_format("published_at", "dd MMM yyyy HH:mm:ss")
    item = F.concat(F.lit("<item><title>"), safe, F.lit("</title><link>https://n.example/article/"), F.col("doc_id").cast("string"), F.lit("/7?x=1</link><pubDate>Mon, "), when,
                    F.lit(" +0900</pubDate><dc:creator>"), F.when(F.col("is_disabled"), F.lit(" ")).otherwise(F.col("press")), F.lit("</dc:creator><author>desk</author></item>"))
    return t.articles.select(F.concat(F.lit("<rss><channel>"), item, F.lit("</channel></rss>")).alias("xml"))


query("rss_items", """SELECT 'https://n.example/article/' || doc_id || '/7' AS url, CASE WHEN is_disabled THEN 'desk' ELSE press END AS author, published_at::TIMESTAMP AS published_at, 'NAVER_' || doc_id || '_7' AS article_id FROM articles""")(
    lambda t: pg.parse_rss(feeds(t)).select("url", "author", "published_at", "article_id"))
RAW_LEX = "SELECT event_id AS seq, CASE WHEN event_id % 17 = 0 THEN ' ' ELSE ' U' || CAST(user_id AS STRING) || ' ' END AS keyword, CASE event_type WHEN 'click' THEN 'Positive' WHEN 'error' THEN ' negative ' ELSE event_type END AS sentiment, CASE WHEN event_id % 5 = 0 THEN '' ELSE CAST(user_id AS STRING) || '.5' END AS weight FROM events"
CLEAN_LEX = f"""SELECT keyword, sentiment, weight FROM (SELECT seq, lower(trim(keyword)) AS keyword, lower(trim(sentiment)) AS sentiment, coalesce(try_cast(weight AS DOUBLE), 1.0) AS weight FROM ({RAW_LEX})) WHERE keyword <> '' AND sentiment IN ('positive','negative') QUALIFY row_number() OVER (PARTITION BY keyword ORDER BY seq DESC) = 1"""
query("lexicon_cleaned", CLEAN_LEX)(
    lambda t: tb.clean_lexicon(t.sql(RAW_LEX)))


@query("lexicon_uploaded", CLEAN_LEX)
def lexicon_uploaded(t):
    """The same rows through CSV files, whose order alone says which row is the last."""
    path = f"{shared_folder(t.spark)}/lexicon-{uuid.uuid4().hex}"
    tb.write_csv(t.sql(RAW_LEX).orderBy("seq").drop("seq"), path)
    return tb.load_lexicon(t.spark, path)


query("lexicon_bad_rows", f"SELECT lower(trim(sentiment)) AS sentiment, count(*) AS cnt FROM ({RAW_LEX}) WHERE trim(keyword) = '' OR lower(trim(sentiment)) NOT IN ('positive','negative') GROUP BY 1")(
    lambda t: tb.bad_lexicon_rows(t.sql(RAW_LEX)))
BULK = "SELECT event_id AS seq, 'DOC_' || CAST(user_id * 9 AS STRING) AS article_id, CASE event_type WHEN 'click' THEN ' Positive' WHEN 'error' THEN 'negative' WHEN 'view' THEN 'neutral' ELSE event_type END AS true_sentiment FROM events"
LAST = f"""SELECT article_id, s FROM (SELECT seq, article_id, lower(trim(true_sentiment)) AS s FROM ({BULK})) WHERE s IN ('positive','negative','neutral') QUALIFY row_number() OVER (PARTITION BY article_id ORDER BY seq DESC) = 1"""
query("bulk_corrections", f"SELECT l.article_id, a.sentiment AS original_sentiment, a.sentiment_score AS original_score, l.s AS corrected_sentiment FROM ({LAST}) l JOIN articles a USING (article_id) WHERE a.sentiment IS DISTINCT FROM l.s")(
    lambda t: tb.apply_corrections(t.articles, t.sql(BULK))[0])
query("bulk_corrections_patched", f"SELECT a.article_id, coalesce(l.s, a.sentiment) AS sentiment FROM articles a LEFT JOIN ({LAST}) l USING (article_id)")(
    lambda t: tb.apply_corrections(t.articles, t.sql(BULK))[1].select("article_id", "sentiment"))
query("bulk_correction_outcomes", f"SELECT CASE WHEN a.article_id IS NULL THEN 'missing' WHEN a.sentiment IS NOT DISTINCT FROM l.s THEN 'same' ELSE 'changed' END AS outcome, count(*) AS cnt FROM ({LAST}) l LEFT JOIN articles a USING (article_id) GROUP BY 1")(
    lambda t: tb.apply_corrections(t.articles, t.sql(BULK))[2])
query("label_export", "SELECT article_id, title, content, sentiment, sentiment_score, published_at FROM articles WHERE sentiment = 'neutral' AND article_id NOT IN (SELECT article_id FROM corrections WHERE used_in_finetune = 1)")(
    lambda t: tb.export_labels(t.articles, t.corrections, "neutral"))

# --- similarity ----------------------------------------------------------------------------------

COS = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"
query("nearest_vectors", f"SELECT a.vec_id AS left_id, b.vec_id AS right_id, round({COS}, 5) AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND {COS} >= 0.3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY {COS} DESC, b.vec_id) <= 3")(
    lambda t: sm.knn_join(*[t.embeddings.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))] * 2, 3, 0.3, 128, same_table=True).withColumn("similarity", F.round("similarity", 5)))
# sequential acceptance in SQL: rows in order, each compared with the list of those accepted so far
TEXTS = """g AS MATERIALIZED (SELECT id, seq, list_sort(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) AS words FROM src), s AS MATERIALIZED (SELECT *, md5(array_to_string(words, ' ')) AS sig FROM g),
 u AS MATERIALIZED (SELECT sig, any_value(words) AS words FROM s WHERE len(words) > 0 GROUP BY 1), tf AS MATERIALIZED (SELECT sig, term, count(*) AS tf FROM (SELECT sig, unnest(words) AS term FROM u) GROUP BY 1, 2), dfs AS MATERIALIZED (SELECT term, count(*) AS df FROM tf GROUP BY 1),
 r AS MATERIALIZED (SELECT sig, term, tf * (ln((1 + (SELECT count(*) FROM u)) / (1 + df)) + 1) AS w FROM tf JOIN dfs USING (term)), vec AS MATERIALIZED (SELECT sig, term, w / sqrt(sum(w * w) OVER (PARTITION BY sig)) AS w FROM r),
 near AS MATERIALIZED (SELECT a.sig AS sa, b.sig AS sb FROM vec a JOIN vec b ON a.term = b.term AND a.sig <> b.sig GROUP BY 1, 2 HAVING sum(a.w * b.w) >= 0.9)"""
WALK = """, ord AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM s), nb AS MATERIALIZED (SELECT i, list(j) AS js FROM hit GROUP BY 1), oo AS MATERIALIZED (SELECT ord.i, js FROM ord LEFT JOIN nb USING (i)),
 walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS acc UNION ALL SELECT oo.i, CASE WHEN js IS NOT NULL AND list_has_any(acc, js) THEN acc ELSE list_append(acc, oo.i) END FROM walk JOIN oo ON oo.i = walk.i + 1),
 fin AS (SELECT unnest(acc) AS i FROM (SELECT acc FROM walk ORDER BY i DESC LIMIT 1))"""
query("near_copies", f"""WITH RECURSIVE src AS (SELECT doc_id AS id, doc_id AS seq, text FROM documents), {TEXTS},
 hit AS MATERIALIZED (SELECT a.i, b.i AS j FROM (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM s) a JOIN (SELECT *, row_number() OVER (ORDER BY seq) AS i FROM s) b ON b.i < a.i AND (a.sig = b.sig OR EXISTS (SELECT 1 FROM near WHERE sa = a.sig AND sb = b.sig))) {WALK}
 SELECT id, fin.i IS NOT NULL AS kept FROM ord LEFT JOIN fin USING (i)""")(
    lambda t: sm.near_copies(t.documents.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("seq"), "text")))
CORPUS = "SELECT article_id, url, title, press FROM articles WHERE published_at < TIMESTAMP '2024-01-04'"
BAD = "(coalesce(trim(title),'') = '' OR lower(title) = 'nan' OR coalesce(trim(raw_text),'') = '' OR lower(raw_text) = 'nan' OR coalesce(trim(url),'') = '' OR coalesce(trim(press),'') = '' OR published_at IS NULL OR collected_at IS NULL)"
query("ingest_status", f"""WITH RECURSIVE c AS ({CORPUS}), whole AS (SELECT * FROM raw_articles WHERE NOT {BAD}),
 fresh AS (SELECT * FROM whole n WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.article_id = n.article_id) AND NOT EXISTS (SELECT 1 FROM c WHERE c.url = n.url) AND NOT EXISTS (SELECT 1 FROM c WHERE c.title = n.title AND c.press = n.press)),
 src AS (SELECT raw_id AS id, seq, raw_text AS text FROM fresh), {TEXTS}, num AS (SELECT s.*, url, title, press, row_number() OVER (ORDER BY s.seq) AS i FROM s JOIN fresh f ON f.raw_id = s.id),
 hit AS (SELECT a.i, b.i AS j FROM num a JOIN num b ON b.i < a.i AND (a.sig = b.sig OR a.url = b.url OR (a.title = b.title AND a.press = b.press) OR EXISTS (SELECT 1 FROM near WHERE sa = a.sig AND sb = b.sig))) {WALK},
 ok AS (SELECT w.* FROM whole w JOIN ord ON ord.id = w.raw_id JOIN fin USING (i))
 SELECT seq, raw_id, 'skipped_missing' AS status FROM raw_articles WHERE {BAD} UNION ALL
 SELECT seq, raw_id, CASE WHEN raw_id IN (SELECT raw_id FROM ok) THEN 'accepted' WHEN EXISTS (SELECT 1 FROM ok WHERE ok.url = w.url AND ok.seq < w.seq) THEN 'skipped_duplicate_url'
 WHEN EXISTS (SELECT 1 FROM ok WHERE ok.title = w.title AND ok.press = w.press AND ok.seq < w.seq) THEN 'skipped_duplicate_meta' WHEN raw_id NOT IN (SELECT raw_id FROM fresh) THEN 'skipped_corpus_duplicate' ELSE 'skipped_similarity' END FROM whole w""")(
    lambda t: ig.dedup_ingest(t.raw_articles, t.sql(CORPUS)))


def accepted(t):
    rows = ig.accepted_articles(t.raw_articles, ig.dedup_ingest(t.raw_articles, t.sql(CORPUS)), LATIN)
    return rows.select("raw_id", "clean_text", F.size("tokens").alias("n_tokens"))


query("ingest_accepted")(accepted)
query("recleaned")(lambda t: ig.retokenise(ig.reclean(t.articles, LATIN), LATIN).select("article_id", "clean_text", F.array_join("tokens", " ").alias("tokens")))

# --- scopes, summaries, viewpoints, models -------------------------------------------------------

EMB = "SELECT a.article_id, a.collected_at, a.published_at, a.press, a.scope_id, a.content, v.embedding FROM articles a JOIN embeddings v ON v.vec_id = a.doc_id"
OLD = "SELECT 'OLD_' || CAST(label AS STRING) AS scope_id, embedding AS centroid, 28 AS news_count FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS rn FROM embeddings) e WHERE rn = 1"


def assigned(t, block=2048):
    return sp.assign_scopes(t.sql(EMB), t.sql(OLD), "20240131", 0.35, 3, 30, 64, block)


# sequential assignment in SQL: articles in order, each with its similar scopes and possible leaders, nearest first; the list of homes so far says who leads and how full a scope is
UNIT = "list_transform({0}::DOUBLE[], lambda x: x / sqrt(list_dot_product({0}::DOUBLE[], {0}::DOUBLE[])))"
SCOPED = f"""WITH RECURSIVE emb AS MATERIALIZED (SELECT article_id, row_number() OVER (ORDER BY collected_at, article_id) AS seq, {UNIT.format('embedding')} AS v FROM ({EMB})), old AS MATERIALIZED (SELECT scope_id, {UNIT.format('centroid')} AS v, news_count FROM ({OLD})),
 cand AS (SELECT e.seq, 0 AS place, scope_id AS scope, news_count AS had, round(list_dot_product(e.v, o.v), 9) AS sim FROM emb e JOIN old o ON round(list_dot_product(e.v, o.v), 9) >= 0.35
  UNION ALL SELECT e.seq, b.seq, 'new:' || b.article_id, 0, round(list_dot_product(e.v, b.v), 9) FROM emb e JOIN emb b ON b.seq < e.seq AND round(list_dot_product(e.v, b.v), 9) >= 0.35),
 opts AS (SELECT seq, list(struct_pack(place := place, scope := scope, had := had) ORDER BY -sim, place, scope) AS opts FROM cand GROUP BY seq), near AS MATERIALIZED (SELECT seq, article_id, coalesce(opts, []) AS opts FROM emb LEFT JOIN opts USING (seq)),
 walk AS (SELECT 0::BIGINT AS i, []::VARCHAR[] AS homes UNION ALL SELECT i + 1, list_append(homes, coalesce(list_filter(list_filter(opts, lambda o: o.place = 0 OR homes[o.place] = o.scope)[1:3], lambda o: o.had + len(list_filter(homes, lambda h: h = o.scope)) < 30)[1].scope, 'new:' || article_id)) FROM walk JOIN near ON seq = i + 1),
 home AS MATERIALIZED (SELECT seq, article_id, v, homes[seq] AS scope FROM emb, (SELECT homes FROM walk ORDER BY i DESC LIMIT 1)), fresh AS (SELECT scope, '20240131-' || lpad(CAST(row_number() OVER (ORDER BY seq) AS VARCHAR), 4, '0') AS new_id FROM home WHERE scope = 'new:' || article_id),
 named AS MATERIALIZED (SELECT article_id, v, coalesce(new_id, scope) AS scope_id FROM home LEFT JOIN fresh USING (scope))"""
query("scope_assignment", f"{SCOPED} SELECT article_id, scope_id FROM named")(lambda t: assigned(t)[0])
# the whole centroid, in steps of a thousandth
query("scope_assignment_changed", f"""{SCOPED}, parts AS (SELECT scope_id, v, 1 AS n FROM named UNION ALL SELECT scope_id, list_transform(v, lambda x: x * news_count), news_count FROM old WHERE scope_id IN (SELECT scope_id FROM named)),
 sums AS (SELECT scope_id, list(s ORDER BY i) AS s FROM (SELECT scope_id, i, sum(v[i]) AS s FROM parts, (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2) GROUP BY 1)
 SELECT scope_id, CAST(sum(n) AS BIGINT) AS news_count, array_to_string(list_transform(any_value({UNIT.format('s')}), lambda x: CAST(floor(x * 1000 + 0.5) AS BIGINT)), ',') AS centroid FROM parts JOIN sums USING (scope_id) GROUP BY scope_id""")(
    lambda t: assigned(t)[1].select("scope_id", "news_count", F.array_join(F.transform("centroid", lambda x: F.floor(x * 1000 + 0.5).cast("string")), ",").alias("centroid")))
query("textrank_summaries")(lambda t: su.textrank_summary(t.documents.select("doc_id", "text"), pack=LATIN))
query("scope_summaries")(lambda t: su.scope_summaries(t.sql(EMB), t.scopes, pack=LATIN))

WORDS = vp.ViewpointWords({
    "gov": ["the", "tion"], "corp": ["ment", "que"], "ind": ["ing"], "ext": ["ung", "sch"], "mix": ["ado"], "crit": ["eux", "wh"], "worry": ["oi"], "exp": ["ch", "eau"],
    "praise": ["ous"], "simple": ["is", "in"], "cause": ["cause"], "result": ["re"], "resp": ["en"], "outlook": ["ou"], "intr": ["der"], "mkt": ["die"], "world": ["los", "las"], "policy": ["und", "und"],
    "weak_result": ["es", "er"], "result_context": ["%", "dado"], "information": ["then", "that"], "critique": ["onnd"], "burden_relief": ["lelle"], "promotion": ["and"],
    "labour": ["aux"], "labour_dispute": ["ouré"], "company_blame": ["ererea"], "company_subject": ["en"], "company_failure": ["thth"], "company_exclusion": ["zado"],
    "government_blamed": ["ndnd"], "government_actor": ["tionst"], "politics": ["ciero"], "responsibility_anchor": ["the ", "que "], "responsibility_denial": ["not", "rien"],
    "responsibility_claim": ["wer", "onre"], "responsibility_fact": ["edes"], "policy_promotion": ["of"], "negative_context": ["shha"], "official_blame": ["heha"],
    "government_strict": ["the"], "government_loose": ["by"], "government_failure": ["ndre"], "risky_failure": ["stst"], "loose_failure": ["with"], "other_blame": ["ouou"],
    "enforcement": ["inin"], "announcement": ["erer"], "strong_blame": ["anan"], "government_support": ["leur"], "market_direct": ["vons"], "regulation": ["on "], "normative": ["ous", "eux"],
    "market_anchor": ["la "], "market_announcement": ["onla"], "market_execution": ["esti"], "opposition": ["non"], "intervention_direct": ["ein"], "intervention_context": ["der "], "intervention_action": ["lich"],
    "anti_intervention": ["keit"], "blame_debate": ["is the"], "government_victim": ["ados"], "pension": ["ran"], "pension_context": ["cia"], "personal_subject": ["it"], "personal": ["this"],
    "investor": ["you"], "investor_choice": ["are"], "investor_victim": ["worth"], "fraud": ["frau"], "research": ["was"], "personal_blame": ["sher"], "external_shock": ["lado"], "external_context": ["que"],
    "external_event": ["cion"], "external_impact": ["mos"], "mixed": ["heit"], "mixed_anchor": ["zu"], "mixed_context": ["ver"], "not_blame": ["schu"], "guidance": ["ach"],
})


def judged(t):
    return t.articles.withColumn("clean_text", F.col("content"))


query("viewpoints")(lambda t: vp.classify_viewpoints(judged(t), WORDS, LATIN).select("article_id", F.explode("perspective").alias("p")).select("article_id", "p.rank", "p.category", "p.score"))
HIT = "((length({0}) - length(replace({0}, '{1}', ''))) / length('{1}'))"
R_T = "replace(replace(replace(regexp_replace(title, '\\[.*?\\]|\\(.*?\\)|#.*', '', 'g'), 'ation', 'tion'), 'and', 'or'), 'or', 'nor')"
R_B = R_T.replace("title", "content")
BASES = " UNION ALL ".join(
    f"SELECT article_id, '{k}' AS category, ({' + '.join(f'3 * {HIT.format(c, w)} + {HIT.format(b, w)}' for w in WORDS[k] for c, b in [('t', 'b')])})::DOUBLE AS hits FROM x" for k in ("gov", "crit", "policy", "simple"))
query("viewpoint_word_hits", f"WITH x AS (SELECT article_id, {R_T} AS t, {R_B} AS b FROM articles) {BASES}")(
    lambda t: t.articles.select("article_id", vp.rule_text("title", LATIN).alias("T"), vp.rule_text("content", LATIN).alias("B")).select(
        "article_id", F.explode(F.create_map(*[x for k in ("gov", "crit", "policy", "simple") for x in (F.lit(k), vp.base_score(WORDS[k], "T", "B"))])).alias("category", "hits")))
PROB = "SELECT doc_id, CAST(doc_id * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS positive, CAST(1 AS DOUBLE) - CAST(doc_id * 37 % 100 AS DOUBLE) / CAST(100 AS DOUBLE) AS negative FROM labels"
query("sentiment_scores", f"""WITH l AS ({LEX}), pr AS ({PROB}), b AS (SELECT d.doc_id, pr.positive, pr.negative, coalesce((SELECT sum(weight) FROM l WHERE sentiment='positive' AND contains(d.title || d.content, keyword)), 0) AS wp, coalesce((SELECT sum(weight) FROM l WHERE sentiment='negative' AND contains(d.title || d.content, keyword)), 0) AS wn FROM articles d LEFT JOIN pr USING (doc_id)),
 s AS (SELECT doc_id, positive, least(1, positive + 0.15 * wp) AS p, least(1, negative + 0.15 * wn) AS n FROM b), q AS (SELECT doc_id, positive, p / (p + n) AS p, n / (p + n) AS n FROM s)
 SELECT doc_id, CASE WHEN positive IS NULL OR abs(p - n) < 0.1 THEN 'neutral' WHEN p > n THEN 'positive' ELSE 'negative' END AS sentiment, round(CASE WHEN positive IS NULL THEN 0 WHEN abs(p - n) < 0.1 THEN 1 - abs(p - n) ELSE greatest(p, n) END, 5) AS sentiment_score FROM q""")(
    lambda t: md.score_sentiment(t.articles, t.sql(PROB), t.sql(LEX), None).withColumn("sentiment_score", F.round("sentiment_score", 5)))
query("embeddings_of_texts")(lambda t: md.embed(t.articles.withColumn("clean_text", F.col("content")), None, 64).select("article_id", "has_embedding", F.size("embedding").alias("dimension")))
query("finetune_set", """SELECT c.article_id, a.title || ' ' || a.content AS text, CASE corrected_sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END AS label, 'correction' AS origin FROM corrections c JOIN articles a USING (article_id) WHERE used_in_finetune = 0
 UNION ALL SELECT article_id, title || ' ' || content, CASE sentiment WHEN 'negative' THEN 0 WHEN 'neutral' THEN 1 ELSE 2 END, 'model' FROM (SELECT * FROM articles WHERE sentiment IS NOT NULL AND sentiment_score >= 0.8 QUALIFY row_number() OVER (PARTITION BY sentiment ORDER BY sentiment_score DESC, article_id) <= 100)""")(
    lambda t: md.finetune_set(t.corrections, t.articles))


def binary(t):
    rows = durable(md.training_rows(t.sql("SELECT article_id, title, content AS clean_text, CASE WHEN sentiment = 'positive' THEN 'yes' WHEN sentiment = 'neutral' THEN 'no' END AS label FROM articles")))
    train, test = md.stratified_split(rows)
    return md.score_binary(test, md.train_binary(train))


query("binary_model_scores")(lambda t: binary(t).select("article_id", "label", "prediction"))
query("binary_model_report")(lambda t: md.binary_report(binary(t)))
query("binary_training_rows", f"""SELECT article_id, label, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text FROM (SELECT article_id, CASE WHEN sentiment = 'positive' THEN 1 ELSE 0 END AS label, {{0}} || ' ' || {{0}} || ' ' || {{1}} AS text FROM articles WHERE sentiment IN ('positive','neutral'))""".format(
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(title, '\\s+', ' ', 'g'), '\\[[^\\]]*\\]|\\([^)]*\\)|#\\S+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')",
    "regexp_replace(regexp_replace(regexp_replace(regexp_replace(content, '\\s+', ' ', 'g'), '\\[[^\\]]*\\]|\\([^)]*\\)|#\\S+', ' ', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"))(
    lambda t: md.training_rows(t.sql("SELECT article_id, title, content AS clean_text, CASE WHEN sentiment = 'positive' THEN 'yes' WHEN sentiment = 'neutral' THEN 'no' END AS label FROM articles")))
