"""Order-dependent and similarity operators against plain Python on small tables."""

import datetime as dt
import math
import random

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tidewire.operators import aggregates as ag
from tidewire.operators import intervals as iv
from tidewire.operators import ranking as rk
from tidewire.operators import graph
from tidewire.operators import similarity as sm
from tidewire.operators import summaries as su
from tidewire.operators import tables as tb
from tidewire.operators import viewpoints as vp
from tidewire.operators.ingest import dedup_ingest
from tidewire.operators.scopes import assign_scopes


def test_number_rows_is_a_global_order(spark):
    df = spark.createDataFrame([(i, (i * 37) % 101) for i in range(500)], "id int, v int").repartition(7)
    got = {r["id"]: r["n"] for r in rk.number_rows(df, [F.desc("v"), F.asc("id")], "n").collect()}
    want = sorted(range(500), key=lambda i: (-((i * 37) % 101), i))
    assert [got[i] for i in want] == list(range(1, 501))


def logins(spark, n=300):
    rng = random.Random(3)
    rows = [(i, rng.randint(1, 2), rng.choice(["login", "logout"]), rng.choice(["success", "fail", "fail"]),
             dt.datetime(2024, 1, 1) + dt.timedelta(minutes=rng.randint(0, 4000), microseconds=i)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "log_id int, user_id int, event_type string, result string, created_at timestamp")


def test_failure_streak_over_slices(spark):
    rows, df = logins(spark)
    want, last = {}, {}
    for i, u, _, result, at in sorted(rows, key=lambda r: r[4]):
        key = (u, at.date())
        last[key] = 0 if result == "success" else last.get(key, 0) + 1
        want[i] = last[key]
    for seconds in (60, 7200):
        got = {r["log_id"]: r["fail_streak"] for r in iv.failure_streak(df, "log_id", slice_seconds=seconds).collect()}
        assert got == want


def test_sessions_and_fill_over_slices(spark):
    rows, df = logins(spark)
    want, opened = [], {}
    for _, u, kind, result, at in sorted(rows, key=lambda r: r[4]):
        if result != "success":
            continue
        key = (u, at.date())
        if kind == "login":
            if key in opened:
                want.append((key[0], opened[key], 300))
            opened[key] = at
        elif key in opened:
            want.append((key[0], opened[key], int((at - opened.pop(key)).total_seconds())))
    want += [(k[0], at, 300) for k, at in opened.items()]
    got = [(r["user_id"], r["login_at"], r["stay_seconds"]) for r in iv.pair_sessions(df, slice_seconds=120).collect()]
    assert sorted(got) == sorted(want)
    prices = df.withColumn("price", F.when(F.col("result") == "success", F.col("log_id")))
    seen, filled = None, {}
    for i, _, _, result, at in sorted(rows, key=lambda r: r[4]):
        seen = i if result == "success" else seen
        filled[i] = seen
    assert {r["log_id"]: r["price_filled"] for r in iv.fill_last(prices, "price", "created_at", "log_id").collect()} == filled


def unit_rows(n, dim, seed):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(6, dim))
    m = base[rng.integers(0, 6, n)] + 0.8 * rng.normal(size=(n, dim))
    return m / np.linalg.norm(m, axis=1, keepdims=True)


def test_fills_within_keys_that_span_many_ranges(spark):
    rng = random.Random(5)
    at = dt.datetime(2024, 1, 1)
    rows = [(i, rng.choice(["hot", "hot", "hot", "b", None, f"k{i % 40}"]), rng.choice([None, None, None, i]), at + dt.timedelta(seconds=rng.randrange(60))) for i in range(3000)]
    df = spark.createDataFrame(rows, "id int, k string, v int, at timestamp").repartition(9)
    last, want, before = {}, {}, {}
    for i, k, v, when in sorted(rows, key=lambda r: (r[3], r[0])):
        before[i] = last.get(k)
        last[k] = v if v is not None else last.get(k)
        want[i] = last[k]
    assert {r["id"]: r["v_filled"] for r in iv.fill_last(df, "v", "at", "id", ["k"]).collect()} == want
    assert {r["id"]: r["w"] for r in iv.carry_last(df, ["k"], ["at", "id"], "v", "w", before_only=True).collect()} == before
    sizes = sorted(r["count"] for r in iv.ranged(df, ["at", "id"]).groupBy("_range").count().collect())
    assert sizes[-1] <= 3 * sizes[len(sizes) // 2]  # one minute holds all rows


def test_asof_jobs_of_one_crowded_hour(spark):
    rng = random.Random(6)
    at = dt.datetime(2024, 1, 1, 5)
    when = lambda: at + dt.timedelta(seconds=rng.randrange(3600))
    logs = [(i, when() if i % 50 else None) for i in range(2000)] + [(5000, at - dt.timedelta(days=900)), (5001, at + dt.timedelta(days=900))] + [(7, at)] * 2
    jobs = [(j, when()) for j in range(300)] + [(900, at), (901, at), (902, None)]
    got = iv.asof_job(spark.createDataFrame(logs, "history_id int, occurred_at timestamp"), spark.createDataFrame(jobs, "job_id int, start_at timestamp")).collect()
    want = [(i, t, max(((s, j) for j, s in jobs if s is not None and t is not None and s <= t), default=(None, None))[1]) for i, t in logs]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_job_stats_of_thousands_of_overlapping_jobs(spark):
    rng = random.Random(7)
    at = dt.datetime(2024, 1, 1)
    when = lambda: at + dt.timedelta(seconds=rng.randrange(86_400) // 60 * 60)
    seen = [("hot" if i % 3 == 0 else f"a{rng.randrange(300)}", when()) for i in range(3000)] + [(None, at), ("n", None)]
    jobs = [(j, *sorted((when(), when()))) for j in range(5000)] + [(9000, at + dt.timedelta(hours=9), at), (9001, None, at), (9002, at, None), (9003, at, at)]
    bad = {"hot", "a1", "a2", "a7"}
    stats = iv.job_stats(spark.createDataFrame(jobs, "job_id int, start_at timestamp, end_at timestamp"), spark.createDataFrame(seen, "article_id string, created_at timestamp"),
                         spark.createDataFrame([(b,) for b in bad] * 2, "article_id string"))
    got = {r["job_id"]: (r["total_count"], r["fail_count"]) for r in stats.collect()}
    assert len(got) == len(jobs)
    times = [(a, t) for a, t in seen if a is not None and t is not None]
    for j, s, e in [*jobs[:200], *jobs[5000:]]:
        inside = {a for a, t in times if s is not None and e is not None and s <= t <= e}
        assert got[j] == (len(inside), len(inside & bad)), j


def test_knn_join_equals_all_pairs(spark):
    m = unit_rows(150, 8, 1)
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "id bigint, vec array<double>")
    sims = m @ m.T
    want = set()
    for i in range(150):
        order = sorted((j for j in range(150) if j != i and sims[i, j] >= 0.7), key=lambda j: (-sims[i, j], j))
        want |= {(i, j) for j in order[:3]}
    for block in (16, 1000):
        got = {(r["left_id"], r["right_id"]) for r in sm.knn_join(df, df, 3, 0.7, block, same_table=True).collect()}
        assert got == want


TEXTS = ["alpha beta gamma delta", "alpha beta gamma delta", "beta gamma delta alpha epsilon", "one two three four five six seven", "one two three four five six seven eight",
         "one two three four five six seven eight nine", "zeta", "", "zeta zeta", "delta gamma beta alpha", "theta iota kappa lambda mu", "theta iota kappa lambda nu"]


def greedy(texts, threshold):
    bags = [sorted(t.lower().split()) for t in texts]
    distinct = [list(x) for x in {tuple(b) for b in bags if b}]
    df = {}
    for b in distinct:
        for w in set(b):
            df[w] = df.get(w, 0) + 1

    def vec(b):
        v = {w: b.count(w) * (math.log((1 + len(distinct)) / (1 + df[w])) + 1) for w in set(b)}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()} if size else {}

    kept = []
    for i, b in enumerate(bags):
        v = vec(b)
        if not any(bags[k] == b or sum(x * vec(bags[k]).get(w, 0) for w, x in v.items()) >= threshold for k in kept):
            kept.append(i)
    return kept


def test_near_copies_equal_a_sequential_pass(spark):
    rng = random.Random(5)
    words = [f"w{i:02d}" for i in range(12)]
    texts = TEXTS + [" ".join(rng.choices(words, k=rng.randint(3, 9))) for _ in range(30)]
    df = spark.createDataFrame([(i, i, t) for i, t in enumerate(texts)], "id int, seq int, text string")
    for threshold in (0.6, 0.9):
        want = greedy(texts, threshold)
        got = sorted(r["id"] for r in sm.near_copies(df, threshold).filter("kept").collect())
        assert got == want
    # with no budget for pairs, only the rounds decide
    signed = sm.text_signatures(df.filter(F.col("id") < len(TEXTS)))
    keys = signed.select("id", F.col("id").cast("string").alias("key"))
    for options in ({}, {"head_rounds": 0}, {"head_rounds": 1, "component_rows": 1}):
        got = sorted(r["id"] for r in sm.first_come(signed, keys, signed, 0.9, **options).collect())
        assert got == greedy(TEXTS, 0.9)


def test_near_copies_leave_no_shuffle_and_hold_numbers(spark, tmp_path, monkeypatch):
    """Shuffles go with the step that made them, and no table of terms holds a signature."""
    df = spark.createDataFrame([(i, i, f"word{i % 40} other{i} more{i % 7} text") for i in range(300)], "id int, seq int, text string")
    seen, plain = [], sm.durable
    monkeypatch.setattr(sm, "durable", lambda df: seen.append(df.dtypes) or plain(df))
    made = spark.sparkContext._jsc.sc().env().blockManager()
    shuffles = lambda: sum(1 for b in made.diskBlockManager().getAllFiles().mkString("\n").split("\n") if "shuffle_" in b)
    before = shuffles()
    assert sm.near_copies(df, 0.9).filter("kept").count() == len(greedy([r["text"] for r in df.collect()], 0.9))
    assert all(kind != "string" for columns in seen for name, kind in columns if name in ("sig", "sig_a", "sig_b"))
    assert shuffles() - before < 60


def test_first_come_on_a_long_chain(spark, monkeypatch):
    """Every row conflicts with the next; the number of checkpoints grows with the logarithm of the chain."""
    made = []
    plain = graph.durable
    monkeypatch.setattr(graph, "durable", lambda df: made.append(1) or plain(df))
    rows = spark.range(2000).select("id", F.col("id").alias("seq"))
    keys = rows.select("id", F.explode(F.array(F.col("id").cast("string"), (F.col("id") + 1).cast("string"))).alias("key"))
    assert sorted(r["id"] for r in sm.first_come(rows, keys).collect()) == list(range(0, 2000, 2))
    assert len(made) < 20


def test_first_come_on_one_hot_key(spark):
    rows = spark.range(2000).select("id", F.col("id").alias("seq"))
    keys = rows.select("id", F.lit("all").alias("key"))
    assert [r["id"] for r in sm.first_come(rows, keys).collect()] == [0]
    assert [r["id"] for r in sm.first_come(rows, keys, component_rows=10).collect()] == [0]


def test_ingest_reasons(spark):
    now = dt.datetime(2024, 1, 1)
    rows = [(1, "r1", "a1", "u1", "t1", "p", "first text about rates", now, now), (2, "r2", "a2", "u1", "t2", "p", "another thing entirely", now, now),
            (3, "r3", "a3", "u3", "t1", "p", "third story of markets", now, now), (4, "r4", "a4", "u4", "t4", "p", "first text about rates", now, now),
            (5, "r5", "a5", "u5", "", "p", "no title here", now, now), (6, "r6", "old", "u6", "t6", "p", "known article body", now, now),
            (7, "r7", "a2", "u7", "t7", "p", "another thing entirely", now, now), (8, "r8", "a7", "u8", "t2", "p", "something new again", now, now)]
    raw = spark.createDataFrame(rows, "seq int, raw_id string, article_id string, url string, title string, press string, raw_text string, published_at timestamp, collected_at timestamp")
    corpus = spark.createDataFrame([("old", "x", "y", "z")], "article_id string, url string, title string, press string")
    got = {r["raw_id"]: r["status"] for r in dedup_ingest(raw, corpus).collect()}
    assert got == {"r1": "accepted", "r2": "skipped_duplicate_url", "r3": "skipped_duplicate_meta", "r4": "skipped_similarity", "r5": "skipped_missing",
                   "r6": "skipped_corpus_duplicate", "r7": "accepted", "r8": "accepted"}


def plain_scopes(vectors, old, threshold, k, cap):
    leaders, count, home = [(s, v) for s, v, _ in old], {s: n for s, _, n in old}, []
    for i, v in enumerate(vectors):
        near = sorted(((-float(lv @ v), j) for j, (_, lv) in enumerate(leaders)))[:k]
        pick = next((leaders[j][0] for s, j in near if -s >= threshold and count[leaders[j][0]] < cap), None)
        if pick is None:
            pick = f"20240131-{len(leaders) - len(old) + 1:04d}"
            leaders.append((pick, v))
            count[pick] = 0
        count[pick] += 1
        home.append(pick)
    return home, count


def test_scope_assignment_equals_a_sequential_pass(spark):
    m = unit_rows(120, 6, 9)
    old = [("OLD-1", m[100], 2), ("OLD-2", m[101], 4)]
    start = dt.datetime(2024, 1, 31)
    arts = spark.createDataFrame([(f"A{i:03d}", start + dt.timedelta(minutes=i), [float(x) for x in m[i]]) for i in range(100)] + [("BAD", start, [0.0] * 6)],
                                 "article_id string, collected_at timestamp, embedding array<double>")
    scopes = spark.createDataFrame([(s, [float(x) for x in v], n) for s, v, n in old], "scope_id string, centroid array<double>, news_count bigint")
    home, count = plain_scopes(m[:100], old, 0.6, 3, 5)
    for block in (2048, 15):
        got, changed = assign_scopes(arts, scopes, "20240131", 0.6, 3, 5, 6, block)
        rows = {r["article_id"]: r["scope_id"] for r in got.collect()}
        assert rows.pop("BAD") == "__no_embedding__"
        assert [rows[f"A{i:03d}"] for i in range(100)] == home
        sizes = {r["scope_id"]: r["news_count"] for r in changed.collect()}
        assert sizes == {s: n for s, n in count.items() if s in set(home)}


def test_scope_assignment_of_one_crowd_and_of_nothing(spark):
    """A third of all articles are one vector: they fill scope after scope, whatever Arrow batches they come in."""
    m = unit_rows(60, 6, 3)
    vectors = [m[0] if i % 3 == 0 else m[i] for i in range(60)]
    start = dt.datetime(2024, 1, 31)
    arts = spark.createDataFrame([(f"A{i:03d}", start + dt.timedelta(minutes=i), [float(x) for x in v]) for i, v in enumerate(vectors)], "article_id string, collected_at timestamp, embedding array<double>")
    none = spark.createDataFrame([], "scope_id string, centroid array<double>, news_count bigint")
    home, count = plain_scopes(vectors, [], 0.7, 3, 4)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for size in ("10000", "7"):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got, changed = assign_scopes(arts, none, "20240131", 0.7, 3, 4, 6)
            assert {r["article_id"]: r["scope_id"] for r in got.collect()} == {f"A{i:03d}": h for i, h in enumerate(home)}
            assert {r["scope_id"]: r["news_count"] for r in changed.collect()} == count
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    got, changed = assign_scopes(arts.limit(0), none, "20240131")
    assert got.collect() == [] and changed.collect() == []


def test_linked_groups_are_the_components_of_all_pairs(spark):
    m = unit_rows(90, 5, 4)
    df = spark.createDataFrame([(f"n{i:02d}", [float(x) for x in v]) for i, v in enumerate(m)], "id string, vec array<double>")
    close = m @ m.T >= 0.9
    for block in (2048, 8):
        got = {r["node"]: r["component"] for r in sm.linked_groups(df, df, 0.9, block).collect()}
        least = list(range(90))
        for _ in range(90):
            least = [min(least[j] for j in np.flatnonzero(close[i])) for i in range(90)]
        assert {f"n{i:02d}": f"n{least[i]:02d}" for i in range(90) if close[i].sum() > 1} == got


def test_summary_kernels():
    sentences = ["금리 인상이 물가 안정에 도움을 준다", "금리 인상이 물가 안정에 도움을 줄 것이다", "전혀 다른 스포츠 소식이다", "물가 안정과 금리 인상"]
    m = su.Grams(sentences)
    rows = np.array([m.dense(i) for i in range(4)])
    assert np.allclose(np.linalg.norm(rows, axis=1), 1)
    assert np.allclose(m.against(rows[0]), rows @ rows[0]) and np.allclose(m.mixed(np.arange(4.0)), np.arange(4.0) @ rows)
    assert su.central_sentence(sentences) in (0, 1, 3)
    pdf = pd.DataFrame({"scope_id": "s", "article_id": "a", "pos": [1, 1, 2], "spos": [0, 1, 0], "sentence": ["같은 문장 입니다", "다른 이야기", "같은 문장 입니다"]})
    assert list(su.drop_similar(0.85)(pdf)["sentence"]) == ["같은 문장 입니다", "다른 이야기"]


WORDS = vp.ViewpointWords({"gov": ["정부 책임"], "crit": ["비판", "논란"], "worry": ["우려"], "mix": ["공동 책임"], "simple": ["개최", "발표"], "government_blamed": ["정부 책임"],
                           "responsibility_anchor": ["정부 책임"], "responsibility_denial": ["반박"], "mixed": ["공동 책임"], "labour": ["노조"], "labour_dispute": ["비판"]})


def test_viewpoints_by_hand(spark):
    rows = [("a", "정부 책임 비판", "논란 우려", None, 0.0), ("b", "정부 책임", "반박", None, 0.0), ("c", "소식", "개최", None, 0.0), ("d", "노조 우려", "논란", "negative", 0.9)]
    df = spark.createDataFrame(rows, "article_id string, title string, clean_text string, sentiment string, sentiment_score double")
    got = {r["article_id"]: [(p["category"], p["score"]) for p in r["perspective"]] for r in vp.classify_viewpoints(df, WORDS).collect()}
    # a: gov (3 + 4) = 7, floor 1 -> 7 * 1.2 + 0.8 = 9.2, +1.2; crit (3 + 1) * 0.9; worry 1 * 0.86
    assert got["a"] == [("정부 책임", 10.4), ("비판적 태도", 3.6), ("우려", 0.9)]
    # b: gov 7 * 0.03 = 0.21; crit +1 by the denial, 0.9; the best is below 1
    assert got["b"] == [("단순 전달", 0.9), ("미분류", 0.0), ("미분류", 0.0)]
    assert got["c"] == [("단순 전달", 0.0), ("미분류", 0.0), ("미분류", 0.0)]
    # d: worry 3 + 1.7 = 4.7 * 0.86 = 4.042; crit (1 * 0.75 + 1.7) * 0.9 = 2.205; policy 1.5 * 0.72 = 1.08; resp 1.2
    assert got["d"] == [("우려", 4.0), ("비판적 태도", 2.2), ("대응 분석", 1.2)]


def test_percentages_add_up(spark):
    df = spark.createDataFrame([(a, b, c) for a in range(4) for b in range(4) for c in range(4)], "positive int, neutral int, negative int")
    for r in ag.sentiment_percent(df).collect():
        total = r["positive_percent"] + r["neutral_percent"] + r["negative_percent"]
        assert total == (100 if r["positive"] + r["neutral"] + r["negative"] else 0) and r["negative_percent"] >= 0


def test_upsert_and_patch_are_idempotent(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "x", 1), (2, "y", 2), (3, "z", 3)], "k int, v string, seq int")
    once = tb.upsert(old, new, ["k"], "seq")
    assert sorted(map(tuple, once.collect())) == [(1, "a"), (2, "y"), (3, "z")]
    assert sorted(map(tuple, tb.upsert(once, new, ["k"], "seq").collect())) == sorted(map(tuple, once.collect()))
    patched = tb.patch(old, once, ["k"], ["v"])
    assert sorted(map(tuple, tb.patch(patched, once, ["k"], ["v"]).collect())) == [(1, "a"), (2, "y")]


def test_term_weights_of_the_binary_model(spark):
    from tidewire.operators.models import fit_terms

    texts = ["rate rate rate rise", "rate falls today", "rise today rise", "other words here", "other rate"]
    rows = spark.createDataFrame(list(enumerate(texts)), "article_id int, text string")
    model = fit_terms(rows, min_df=2, max_df=0.99)
    terms = model.counts.stages[-1].vocabulary
    bags = [[w for w in t.split()] for t in texts]
    bags = [b + [f"{x} {y}" for x, y in zip(b, b[1:])] for b in bags]
    for row in model.features(rows).collect():
        bag = bags[row["article_id"]]
        want = {}
        for t in set(bag) & set(terms):
            want[t] = (1 + math.log(bag.count(t))) * (math.log((1 + len(bags)) / (1 + sum(t in b for b in bags))) + 1)
        size = math.sqrt(sum(v * v for v in want.values())) or 1.0
        got = {terms[i]: v for i, v in zip(row["features"].indices, row["features"].values)}
        assert got.keys() == want.keys() and all(abs(got[t] - want[t] / size) < 1e-9 for t in want)


def test_binary_model_makes_its_texts_once(spark):
    import pytest

    from tidewire.operators.models import binary_report, fit_terms, score_binary, train_binary

    made = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(text):
        made.add(1)
        return text

    rows = [(i, "rates rise again today" if i % 2 else "rates fall again now", i % 2) for i in range(40)]
    base = spark.createDataFrame(rows, "article_id int, text string, label int")
    model = train_binary(base.withColumn("text", counted("text")), min_per_class=5)
    assert made.value == 40
    assert sorted(model.counts.stages[-1].vocabulary[:6]) == ["again now", "again today", "fall", "fall again", "now", "rates fall"]
    made.value = 0
    report = binary_report(score_binary(base.withColumn("text", counted("text")), model)).first()
    assert made.value == 40 and (report["tp"], report["fp"], report["fn"], report["tn"], report["auc"]) == (20, 0, 0, 20, 1.0)
    with pytest.raises(ValueError):
        fit_terms(spark.createDataFrame([(1, "one two"), (2, "three four")], "article_id int, text string"))


def test_tfidf_titles_repeats_and_plan(spark):
    from dataclasses import replace

    from tidewire.functions.packs import KOREAN
    from tidewire.operators.topics import tfidf_keywords

    pack = replace(KOREAN, keyword_stopwords=["stop"])
    rows = [
        (1, ["Rate", "rate", "stop", None, "market!", "", "x1"], ["rate", None, "rate", "market"]),
        (2, ["market", "Rates", "Stop"], None), (2, ["bank"], ["bank", "market"]), (3, None, ["rate"]), (4, [], ["rate"]),
    ]
    docs = spark.createDataFrame(rows, "doc_id int, tokens array<string>, title_nouns array<string>")
    found = tfidf_keywords(docs, pack=pack)
    got = {(r["doc_id"], r["keyword"]): r["score"] for r in found.collect()}
    tf = {1: {"rate": 2, "market": 1}, 2: {"market": 1, "rates": 1, "bank": 1}}
    boosted = {(1, "rate"), (1, "market"), (2, "bank")}
    want = {}
    for d, own in tf.items():
        w = {t: (1 + math.log(n)) * (math.log(3 / (1 + sum(t in o for o in tf.values()))) + 1) for t, n in own.items()}
        size = math.sqrt(sum(v * v for v in w.values()))
        want |= {(d, t): v / size + (0.3 if (d, t) in boosted else 0.0) for t, v in w.items()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "array_sort" not in plan  # words are judged once each, not in the array of every document


def test_scope_keywords_counts_old_and_new_ones_at_once(spark):
    articles = spark.createDataFrame([("s", " a , b,,a"), ("s", "b,c"), ("t", None), ("u", ","), (None, "x")], "scope_id string, keywords string")
    scopes = spark.createDataFrame([("s", "c,d"), ("u", None), ("v", "z")], "scope_id string, scope_keywords string")
    both = ag.scope_keywords(articles, scopes, n=3)
    assert {tuple(r) for r in both.collect()} == {("s", "c,a,b", "ok"), ("t", "", "insufficient"), ("u", "", "insufficient")}
    aggregates = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [")
    assert aggregates(both) == aggregates(ag.scope_keywords(articles, n=3))


def test_viewpoint_conditions_used_several_times_are_made_once(spark):
    from tidewire.operators.viewpoints import ViewpointWords, classify_viewpoints

    words = ViewpointWords({"gov": ["tax"], "corp": ["firm"], "crit": ["bad"], "responsibility_anchor": ["blame"], "responsibility_denial": ["denies"], "responsibility_claim": ["claims"]})
    rows = [("a", "tax tax", "denies all blame"), ("b", "tax tax", "claims the blame"), ("c", "tax tax", "denies it, and much later than that comes the blame"), ("d", None, None)]
    out = classify_viewpoints(spark.createDataFrame([(*r, None, None) for r in rows], "article_id string, title string, clean_text string, sentiment string, sentiment_score double"), words)
    got = {r["article_id"]: [(p["category"], p["score"]) for p in r["perspective"]] for r in out.collect()}
    assert got["c"][0] == ("정부 책임", 9.2) and got["a"][0] == ("단순 전달", 0.9) and ("비판적 태도", 0.9) in got["b"] and ("비판적 태도", 0.9) not in got["c"]
    spark.conf.set("spark.sql.debug.maxToStringFields", "10000")
    try:
        plan = out._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    assert plan.count("(?s)(?:") == 2  # one for the denial and one for the claim


def test_patch_with_two_rows_of_a_key(spark):
    target = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    rows = spark.createDataFrame([(1, "x"), (1, "y"), (1, None)], "k int, v string")
    assert sorted(tuple(r) for r in tb.patch(target, rows, ["k"], ["v"]).collect()) == [(1, "y"), (2, "b")]
    two = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, w int")
    rows = spark.createDataFrame([(1, "z", 5, 1), (1, "c", None, 2), (1, None, 4, 3)], "k int, v string, w int, at int")
    assert sorted(tuple(r) for r in tb.patch(two, rows, ["k"], ["v", "w"]).collect()) == [(1, "z", 5), (2, "b", 2)]  # one row, whole
    assert sorted(tuple(r) for r in tb.patch(two, rows, ["k"], ["v", "w"], "at").collect()) == [(1, "c", 4), (2, "b", 2)]  # one after another


def test_lexicon_of_fifty_thousand_words(spark):
    from tidewire.operators.joins import lexicon_hits

    rng = random.Random(9)
    words = sorted({"".join(rng.choices("abcdefg", k=rng.randint(1, 8))) for _ in range(60000)})[:50000]
    texts = [(i, " ".join("".join(rng.choices("abcdefg", k=rng.randint(1, 9))) for _ in range(40))) for i in range(20)] + [(98, ""), (99, None)]
    lexicon = spark.createDataFrame([(w, "positive", 1.0) for w in words], "keyword string, sentiment string, weight double")
    docs = spark.createDataFrame(texts, "doc_id int, text string")
    want = {(i, w): t.count(w) for i, t in texts if t for w in words if w in t}
    for part in (16 << 20, 1 << 20):
        found = lexicon_hits(docs, lexicon, part_bytes=part).collect()
        assert {(r["doc_id"], r["keyword"]): r["hits"] for r in found} == want and len(found) == len(want)


def test_lexicon_rows_of_one_word_overlaps_and_nothing(spark):
    from tidewire.operators.joins import lexicon_hits

    lexicon = spark.createDataFrame([("aa", "positive", 1.0), ("aa", "negative", 2.0), ("a", None, None), ("금리", "positive", 0.5), ("", "x", 1.0), (None, "y", 1.0)], "keyword string, sentiment string, weight double")
    docs = spark.createDataFrame([("d1", "aaaaa 금리금리"), ("d1", "a"), (None, "aa"), ("d2", None)], "doc_id string, text string")
    got = sorted((tuple(r) for r in lexicon_hits(docs, lexicon).collect()), key=str)
    assert got == sorted([("d1", "aa", "positive", 1.0, 2), ("d1", "aa", "negative", 2.0, 2), ("d1", "a", None, None, 5), ("d1", "금리", "positive", 0.5, 2), ("d1", "a", None, None, 1),
                          (None, "aa", "positive", 1.0, 1), (None, "aa", "negative", 2.0, 1), (None, "a", None, None, 2)], key=str)
    assert lexicon_hits(docs, lexicon.limit(0)).collect() == [] and lexicon_hits(docs.limit(0), lexicon).collect() == []
