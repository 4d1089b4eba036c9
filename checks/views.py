"""News tables derived from the given parquet tables, by the same SQL for Spark and for DuckDB.

Pieces that the two dialects spell differently stand in braces and are filled in per dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tidewire.session import spread

TEXT_KEYS = {"documents": "doc_id", "pages": "page_id"}
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()

DIALECT = {
    "spark": {
        "words": "array_join(array_sort(array_distinct(filter(regexp_extract_all(lower(d.text), '[a-zß-ÿ]+', 0), x -> length(x) > 1))), ',')",
        "idiv25": "CAST(floor(d.doc_id / 25) AS BIGINT)",
    },
    "duckdb": {
        "words": "array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(d.text), '[a-zß-ÿ]+'), lambda x: length(x) > 1))), ',')",
        "idiv25": "CAST(floor(d.doc_id / 25) AS BIGINT)",
    },
}

VIEWS = {
    "articles": """
SELECT d.doc_id,
       'DOC_' || CAST(d.doc_id AS STRING) AS article_id,
       split_part(d.text, chr(10), 1) AS title,
       d.text AS content,
       d.source AS press,
       'https://' || d.lang || '.example.com/' ||
         CAST(CASE WHEN d.doc_id % 20 = 19 THEN d.doc_id - 1 ELSE d.doc_id END AS STRING) AS url,
       make_timestamp(2024, 1, CAST(1 + d.doc_id % 30 AS INT), CAST((d.doc_id * 7) % 24 AS INT),
                      CAST((d.doc_id * 13) % 60 AS INT), CAST((d.doc_id * 17) % 60 AS INT)) AS published_at,
       make_timestamp(2024, 1, CAST(1 + d.doc_id % 30 AS INT), 23, CAST((d.doc_id * 13) % 60 AS INT), 30) AS collected_at,
       CASE WHEN l.toxic = 1 THEN 'negative' WHEN l.quality = 1 THEN 'positive'
            WHEN l.quality = 0 THEN 'neutral' END AS sentiment,
       CASE WHEN l.doc_id IS NOT NULL
            THEN CAST((d.doc_id * 7919) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) END AS sentiment_score,
       {words} AS keywords,
       CASE WHEN d.doc_id % 3 = 0 THEN NULL ELSE split_part(d.text, chr(10), 2) END AS summary,
       CASE WHEN d.doc_id % 11 = 10 THEN NULL
            ELSE 'S' || lpad(CAST({idiv25} AS STRING), 8, '0') END AS scope_id,
       d.doc_id % 50 = 7 AS is_disabled
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
    "perspectives": """
SELECT a.article_id, r.rnk AS rnk,
       CASE WHEN (a.doc_id * r.rnk + r.rnk) % 19 = 18 THEN '미분류'
            ELSE 'C' || lpad(CAST((a.doc_id * r.rnk + r.rnk) % 19 AS STRING), 2, '0') END AS category,
       CAST(10 - 2 * r.rnk AS DOUBLE) AS score
FROM articles a CROSS JOIN (SELECT 1 AS rnk UNION ALL SELECT 2 UNION ALL SELECT 3) r""",
    "article_views": """
SELECT e.user_id, 'DOC_' || CAST(e.event_id % (SELECT count(*) FROM documents) AS STRING) AS article_id,
       e.event_id % 3 <> 0 AS is_valid_view, e.ts AS created_at
FROM events e WHERE e.event_type = 'view'""",
    "article_reactions": """
SELECT e.user_id, 'DOC_' || CAST(e.event_id % (SELECT count(*) FROM documents) AS STRING) AS article_id,
       CASE WHEN e.event_type = 'click' THEN 'like' ELSE 'dislike' END AS reaction_type, e.ts AS created_at
FROM events e WHERE e.event_type IN ('click', 'error')""",
    "login_logs": """
SELECT e.user_id, CASE WHEN e.event_type = 'signup' THEN 'login' ELSE 'logout' END AS event_type,
       CASE WHEN e.event_type = 'signup' AND e.event_id % 4 = 0 THEN 'fail' ELSE 'success' END AS result,
       e.ts AS created_at, e.event_id AS log_id
FROM events e WHERE e.event_type IN ('signup', 'purchase')""",
    "users": """
SELECT c.c_custkey AS user_id, c.c_name AS name,
       CASE WHEN c.c_custkey % 100 = 0 THEN 'superadmin' WHEN c.c_custkey % 20 = 0 THEN 'admin'
            ELSE 'general' END AS role,
       make_timestamp(2024, 1, CAST(1 + c.c_custkey % 30 AS INT), CAST((c.c_custkey * 5) % 24 AS INT), 0, 0) AS created_at
FROM customer c""",
    "batch_jobs": """
SELECT datediff_days AS job_id, start_at, end_at
FROM (SELECT CAST(extract(day FROM min(ts)) AS BIGINT) AS datediff_days, min(ts) AS start_at, max(ts) AS end_at
      FROM events GROUP BY CAST(ts AS DATE)) t""",
    "process_logs": """
SELECT e.event_id AS history_id, 'DOC_' || CAST(e.event_id % (SELECT count(*) FROM documents) AS STRING) AS article_id,
       CASE WHEN e.event_type = 'error' THEN 'fail' ELSE 'success' END AS status, e.ts AS occurred_at
FROM events e WHERE e.event_type IN ('error', 'view')""",
    "error_logs": """
SELECT e.event_id AS history_id, CASE WHEN e.value > 50 THEN 'E001' ELSE 'E002' END AS error_code
FROM events e WHERE e.event_type = 'error'""",
    "corrections": """
SELECT l.doc_id * 2 + r.n AS id, 'DOC_' || CAST(l.doc_id AS STRING) AS article_id,
       CASE WHEN (l.toxic + r.n) % 2 = 1 THEN 'neutral' ELSE 'negative' END AS corrected_sentiment,
       CASE WHEN l.doc_id % 2 = 0 AND l.quality = 1 THEN 1 ELSE 0 END AS used_in_finetune
FROM labels l CROSS JOIN (SELECT 0 AS n UNION ALL SELECT 1) r""",
    "scopes": """
SELECT scope_id, count(*) AS news_count, min(published_at) AS created_at, max(published_at) AS updated_at,
       CASE WHEN min(doc_id) % 4 = 0 THEN NULL ELSE min(split_part(title, '.', 1)) END AS scope_title,
       max(split_part(title, '.', 1)) AS scope_summary,
       min(split_part(keywords, ',', 3)) || ',' || max(split_part(keywords, ',', 3)) || ',' ||
       min(split_part(keywords, ',', 20)) || ',' || max(split_part(keywords, ',', 20)) || ',' ||
       max(split_part(keywords, ',', 50)) AS scope_keywords
FROM articles WHERE scope_id IS NOT NULL GROUP BY scope_id""",
    "viewpoint_master": """
SELECT DISTINCT 'G' || CAST(s_nationkey % 5 AS STRING) AS group_name,
       'View ' || lpad(CAST(s_nationkey AS STRING), 2, '0') AS display_title,
       'C' || lpad(CAST(s_nationkey AS STRING), 2, '0') AS es_category, s_nationkey AS sort_order
FROM (SELECT n_nationkey AS s_nationkey FROM nation) n""",
    "banners": """
SELECT o_orderkey AS banner_id, CASE WHEN o_orderpriority = '1-URGENT' THEN 'notice' ELSE 'banner' END AS banner_type,
       o_orderpriority = '5-LOW' AS is_pinned, o_orderstatus = 'F' AS is_active,
       CAST(o_orderdate AS DATE) AS start_at, CAST(o_orderdate + INTERVAL '90' DAY AS DATE) AS end_at, o_orderdate AS created_at
FROM orders""",
    "raw_articles": """
SELECT d.doc_id AS seq, 'R' || CAST(d.doc_id AS STRING) AS raw_id, a.article_id, a.url, a.press,
       CASE WHEN d.doc_id % 13 = 12 THEN ' ' ELSE a.title END AS title, d.text AS raw_text,
       a.published_at, a.collected_at
FROM documents d JOIN articles a ON a.doc_id = d.doc_id""",
}

PERSPECTIVE_ARRAY = """
SELECT a.*, transform(array(1, 2, 3), r -> named_struct('rank', r,
         'category', CASE WHEN (a.doc_id * r + r) % 19 = 18 THEN '미분류'
                          ELSE 'C' || lpad(CAST((a.doc_id * r + r) % 19 AS STRING), 2, '0') END,
         'score', CAST(10 - 2 * r AS DOUBLE))) AS perspective
FROM articles a"""


def _needs(sql: str) -> list:
    words = set(re.findall(r"[a-z_]+", sql))
    return [n for n in (*TABLES, *VIEWS) if n in words]


def _order(sql: str, dialect: str) -> list:
    """Names of the derived views a text uses, dependencies first."""
    out: list = []

    def visit(text):
        for name in _needs(text):
            if name in VIEWS and name not in out:
                visit(VIEWS[name].format(**DIALECT[dialect]))
                out.append(name)

    visit(sql)
    return out


def duck(sql: str) -> str:
    """A DuckDB query text with the derived views it uses written out as common table expressions."""
    names = _order(sql, "duckdb")
    body = sql.strip()
    recursive = body[:14].upper() == "WITH RECURSIVE"
    own = body[14:] if recursive else (body[4:] if body[:4].upper() == "WITH" else None)
    parts = [f"{n} AS MATERIALIZED ({VIEWS[n].format(**DIALECT['duckdb']).strip()})" for n in names]
    if not parts:
        return body
    head = "WITH RECURSIVE " if recursive else "WITH "
    return head + ",\n".join(parts) + (",\n" + own.strip() if own is not None else "\n" + body)


class Tables:
    """Given and derived tables of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name in TABLES:
            df = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            return spread(df, TEXT_KEYS[name]) if name in TEXT_KEYS else df
        if name == "articles_p":
            return self.sql(PERSPECTIVE_ARRAY)
        if name in VIEWS:
            return self.sql(f"SELECT * FROM {name}")
        raise AttributeError(name)

    def sql(self, text: str) -> DataFrame:
        views = _order(text, "spark")
        wanted = text + " ".join(VIEWS[v] for v in views)
        for name in _needs(wanted):
            if name in TABLES:
                getattr(self, name).createOrReplaceTempView(name)
        for name in views:
            self.spark.sql(VIEWS[name].format(**DIALECT["spark"])).createOrReplaceTempView(name)
        return self.spark.sql(text)
