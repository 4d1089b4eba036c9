"""Checked queries: incremental and streaming work over the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from checks.catalog import query
from checks.packs import LATIN
from checks.reads import METRICS
from checks.views import DIALECT, VIEWS
from tidewire.functions.text import clean_article
from tidewire.session import shared_folder
from tidewire.streaming import jobs as jb


def places(spark):
    """A new sink and checkpoint folder for one run."""
    base = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    return f"{base}/sink", f"{base}/checkpoint"


def stream_of(t, table):
    static = t.spark.read.parquet(f"{t.folder}/{table}.parquet")
    df = jb.read_table_stream(t.spark, f"{t.folder}/{table}.parquet", static.schema)
    if table == "events":
        df = df.withColumn("ts", F.col("ts").cast("timestamp"))
    return df


def stream_view(t, view, table):
    """A derived table whose given table arrives as a stream."""
    t.sql(f"SELECT * FROM {view}")
    name = f"{table}_stream"
    stream_of(t, table).createOrReplaceTempView(name)
    text = VIEWS[view].format(**DIALECT["spark"]).replace(f"FROM {table} ", f"FROM {name} ")
    return t.spark.sql(text)


def incremental_clean(t):
    sink, mark = places(t.spark)
    stage = lambda batch: batch.select("doc_id", clean_article("text", LATIN).alias("clean_text"))
    jb.run_incremental(stream_of(t, "documents"), stage, sink, mark)
    return jb.read_sink(t.spark, sink)


from checks.texts import STOP, folded  # noqa: E402

query("incremental_clean", f"""SELECT doc_id, array_to_string(list_filter(string_split_regex({folded('text', LATIN.article_patterns)}, '\\s+'), lambda w: w <> '' AND w NOT IN ({STOP})), ' ') AS clean_text FROM documents""")(incremental_clean)


def keyword_counts(t):
    sink, mark = places(t.spark)
    live = stream_view(t, "articles", "documents").filter(~F.coalesce("is_disabled", F.lit(False)))
    jb.run_aggregate(jb.stream_keyword_counts(live, pack=LATIN), sink, mark)
    return jb.read_sink(t.spark, sink, ["date", "keyword"])


query("stream_keyword_counts", METRICS)(keyword_counts)


def hot(t):
    sink, mark = places(t.spark)
    clicks = stream_of(t, "events").filter(F.col("event_type") == "click").select(F.col("ts").alias("created_at"), F.concat(F.lit("U_"), F.col("user_id").cast("string")).alias("article_id"))
    jb.run_aggregate(jb.stream_hot(clicks), sink, mark)
    return jb.hottest(jb.read_sink(t.spark, sink, ["window_start", "window_end", "article_id"]))


query("stream_hot", """WITH c AS (SELECT 'U_' || user_id AS article_id, unnest(range(0, 12)) AS s, ts FROM events WHERE event_type = 'click'),
 w AS (SELECT time_bucket(INTERVAL 5 MINUTE, ts) - s * INTERVAL 5 MINUTE AS window_start, article_id, count(*) AS total FROM c GROUP BY 1, 2)
 SELECT window_start, window_start + INTERVAL 1 HOUR AS window_end, article_id, total FROM w QUALIFY row_number() OVER (PARTITION BY window_start ORDER BY total DESC, article_id) <= 5""")(hot)


def dedup(t):
    sink, mark = places(t.spark)
    rows = jb.stream_dedup(stream_of(t, "events").select("user_id", "event_type", "ts"), "user_id", "ts", "1 day").select("user_id")
    jb.run_aggregate(rows, sink, mark, "append")
    return jb.read_sink(t.spark, sink)


query("stream_dedup", "SELECT DISTINCT user_id FROM events")(dedup)

VOTES = "SELECT user_id, 'A' || CAST(event_id % 20 AS STRING) AS article_id, ts, CASE WHEN event_type = 'click' THEN 'like' ELSE 'hate' END AS vote_type FROM events WHERE event_type IN ('click', 'error')"
TAIL = f"""WITH v AS ({VOTES}), l AS (SELECT user_id, article_id, max_by(vote_type, ts) AS last_vote FROM v GROUP BY 1, 2), o AS (SELECT v.user_id, v.article_id, max(ts) AS other FROM v JOIN l USING (user_id, article_id) WHERE vote_type <> last_vote GROUP BY 1, 2)
 SELECT user_id, article_id, CASE WHEN count(*) % 2 = 1 THEN any_value(last_vote) END AS state FROM v JOIN l USING (user_id, article_id) LEFT JOIN o USING (user_id, article_id) WHERE other IS NULL OR ts > other GROUP BY 1, 2"""
query("vote_states", TAIL)(lambda t: jb.fold_votes(t.sql(VOTES)))
query("vote_counts", f"SELECT article_id, count(*) FILTER (state='like') AS like_count, count(*) FILTER (state='hate') AS hate_count FROM ({TAIL}) GROUP BY 1")(lambda t: jb.vote_counts(jb.fold_votes(t.sql(VOTES))))


def votes(t):
    sink, mark = places(t.spark)
    stream_of(t, "events").createOrReplaceTempView("events_stream")
    jb.run_aggregate(jb.stream_votes(t.spark.sql(VOTES.replace("FROM events", "FROM events_stream"))), sink, mark)
    return jb.read_sink(t.spark, sink, ["user_id", "article_id"])


query("stream_vote_states", TAIL)(votes)
query("first_views", "SELECT user_id, article_id, min(created_at) AS created_at, bool_or(is_valid_view) AS is_valid_view FROM article_views GROUP BY 1, 2")(lambda t: jb.fold_views(t.article_views))


def sessions(t):
    sink, mark = places(t.spark)
    logins = stream_view(t, "login_logs", "events")
    jb.run_aggregate(jb.stream_sessions(logins), sink, mark, "append")
    return jb.read_sink(t.spark, sink)


# an open session of a day the watermark has not passed is not out yet
query("stream_sessions", """WITH l AS (SELECT user_id, event_type, created_at, created_at::DATE AS day, lead(event_type) OVER w AS ne, lead(created_at) OVER w AS nt FROM login_logs WHERE result = 'success' WINDOW w AS (PARTITION BY user_id, created_at::DATE ORDER BY created_at, event_type))
 SELECT user_id, day, created_at AS login_at, CASE WHEN ne = 'logout' THEN floor((epoch_us(nt) - epoch_us(created_at)) / 1000000) ELSE 300 END::BIGINT AS stay_seconds FROM l
 WHERE event_type = 'login' AND (ne IS NOT NULL OR day + 1 <= (SELECT max(created_at) FROM login_logs WHERE result = 'success') - INTERVAL 1 HOUR)""")(sessions)
