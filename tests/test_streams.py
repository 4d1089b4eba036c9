"""Streams over tables of one file and of many, and their memory across batches, against plain code."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from checks.streams import stream_of
from checks.views import Tables
from tidewire.streaming import jobs as jb

AT = dt.datetime(2024, 1, 1)


@pytest.mark.parametrize("files", [1, 3])
def test_a_table_is_streamed_from_a_file_and_from_a_folder(spark, tmp_path, files):
    rows = spark.createDataFrame([(i, f"text {i}") for i in range(20)], "doc_id long, text string")
    path = f"{tmp_path}/documents.parquet"
    if files == 1:
        rows.toPandas().to_parquet(path)
    else:
        rows.repartition(files).write.parquet(path)
    jb.run_incremental(stream_of(Tables(spark, str(tmp_path)), "documents"), lambda b: b, f"{tmp_path}/sink", f"{tmp_path}/mark")
    assert sorted(r["doc_id"] for r in jb.read_sink(spark, f"{tmp_path}/sink").collect()) == list(range(20))


def batched(spark, tmp_path, rows, schema, parts):
    """The rows as a stream of one batch per part, in this order."""
    for k in range(parts):
        some = rows[k * len(rows) // parts : (k + 1) * len(rows) // parts]
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")


@pytest.mark.parametrize("buckets", [1, 7])
def test_votes_are_remembered_across_batches(spark, tmp_path, buckets):
    draw = random.Random(3)
    rows = [(draw.choice([None, 1, 2, 2**60 + 1]), draw.choice(["a", "b", None]), AT + dt.timedelta(seconds=k), draw.choice(["like", "hate"])) for k in range(120)]
    live = batched(spark, tmp_path, rows, "user_id long, article_id string, ts timestamp, vote_type string", 3)
    jb.run_aggregate(jb.stream_votes(live, buckets), f"{tmp_path}/sink", f"{tmp_path}/mark")
    want = {}
    for user, article, _, vote in rows:
        want[user, article] = None if want.get((user, article)) == vote else vote
    got = jb.read_sink(spark, f"{tmp_path}/sink", ["user_id", "article_id"]).collect()
    assert len(got) == len(want) and {(r["user_id"], r["article_id"]): r["state"] for r in got} == want


@pytest.mark.parametrize("buckets", [1, 7])
def test_sessions_stay_open_across_batches(spark, tmp_path, buckets):
    draw = random.Random(5)
    rows = [(draw.randrange(4), draw.choice(["login", "logout"]), "success", AT + dt.timedelta(minutes=20 * k)) for k in range(200)]
    live = batched(spark, tmp_path, rows, "user_id long, event_type string, result string, created_at timestamp", 3)
    jb.run_aggregate(jb.stream_sessions(live, buckets=buckets), f"{tmp_path}/sink", f"{tmp_path}/mark", "append")
    got = sorted((r["user_id"], r["login_at"], r["stay_seconds"]) for r in jb.read_sink(spark, f"{tmp_path}/sink").select("user_id", F.col("login_at"), "stay_seconds").collect())
    want = []
    for i, (user, kind, _, at) in enumerate(rows):
        after = [(k, t) for u, k, _, t in rows[i + 1 :] if u == user and t.date() == at.date()]
        if kind == "login" and (after or at.date() + dt.timedelta(days=1) <= (rows[-1][3] - dt.timedelta(hours=1)).date()):
            want.append((user, at, int((after[0][1] - at).total_seconds()) if after and after[0][0] == "logout" else 300))
    assert got == sorted(want)
