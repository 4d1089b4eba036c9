"""Pages, feeds and files."""

import pytest
from pyspark.sql import functions as F

from tidewire.sources import pages as pg
from tidewire.sources import tables as tb

PAGE = """<html><script>x</script><span class="media_end_head_top_press">한국 신문</span><em class="media_end_head_journalist_name">홍길동(기자)</em>
<span class="media_end_head_info_datestamp_time" data-date-time="2024-01-02 03:04:05">x</span><div id="dic_area">첫 <b>문장</b><script>no</script><br>둘째&amp;</div></html>"""


def test_article_page(spark):
    rows = [(1, "u", PAGE), (2, "v", '<div class="media_end_head_top_logo"><a><img alt="로고"></a></div><div class="article-body story">본문</div>'), (3, "w", None)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string")
    got = {r["page_id"]: r for r in pg.extract_articles(df).collect()}
    assert (got[1]["content"], got[1]["press"], got[1]["author"], str(got[1]["published_at"])) == ("첫 문장 둘째&", "한국 신문", "홍길동", "2024-01-02 03:04:05")
    assert (got[2]["content"], got[2]["press"]) == ("본문", "로고")
    assert (got[3]["content"], got[3]["press"], got[3]["author"]) == ("", "Unknown", "")


def test_ids_and_links(spark):
    urls = ["https://n/article/001/0002?x", "https://y/view/AKR123", "https://www.hankyung.com/article/2024abc#t", "https://z"]
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert [r[0] for r in df.select(pg.article_id_expr("url")).collect()] == ["NAVER_001_0002", "YNA_AKR123", "HK_2024abc", None]
    page = spark.createDataFrame([(1, '<li><dt><a href="/i?1"><img></a></dt><dt><a class="x" href="/a/2?s=1">제목 <b>둘</b></a></dt></li><li>none</li>')], "page_id int, html string")
    assert [tuple(r) for r in pg.extract_links(page).collect()] == [(1, "/a/2", "제목 둘")]


def test_rss_file(spark, tmp_path):
    (tmp_path / "f.xml").write_text("""<rss xmlns:dc="d"><channel><item><title> 제목 </title><link>https://n/article/1/2?x</link><pubDate>Tue, 02 Jan 2024 09:08:07 +0900</pubDate><dc:creator>갑</dc:creator></item>
<item><title>둘</title><link>https://z</link><pubDate>bad</pubDate><author>을</author></item></channel></rss>""", encoding="utf-8")
    got = sorted(map(tuple, pg.read_rss(spark, str(tmp_path)).select("title", "url", "author", F.col("published_at").cast("string"), "article_id").collect()))
    assert got == [("둘", "https://z", "을", None, None), ("제목", "https://n/article/1/2", "갑", "2024-01-02 09:08:07", "NAVER_1_2")]


def test_lexicon_file(spark, tmp_path):
    path = tmp_path / "l.csv"
    path.write_text("﻿keyword,sentiment,weight\n 호황 ,Positive,2\n불황,negative,\n호황,positive,3\n,positive,1\n애매,unknown,1\n", encoding="utf-8")
    got = sorted(map(tuple, tb.load_lexicon(spark, str(path)).collect()))
    assert got == [("불황", "negative", 1.0), ("호황", "positive", 3.0)]
    old = spark.createDataFrame([("옛말", "positive", 1.0), ("불황", "negative", 9.0)], "keyword string, sentiment string, weight double")
    assert sorted(r["keyword"] for r in tb.load_lexicon(spark, str(path), old).collect()) == ["불황", "옛말", "호황"]
    assert tb.load_lexicon(spark, str(path), old, replace_all=True).count() == 2
    with pytest.raises(ValueError):
        tb.read_csv(spark, str(path), ["nothing"])


def test_replace_one_day(spark, tmp_path):
    path = str(tmp_path / "m")
    make = lambda rows: spark.createDataFrame(rows, "date string, keyword string, n int")
    tb.replace_partition(make([("2024-01-01", "a", 1), ("2024-01-02", "b", 2)]), path)
    tb.replace_partition(make([("2024-01-02", "c", 3)]), path)
    assert sorted((str(r["date"]), r["keyword"]) for r in spark.read.parquet(path).collect()) == [("2024-01-01", "a"), ("2024-01-02", "c")]
    assert tb.read_table(spark, path, ["keyword"]).columns == ["keyword"]


def test_logo_map_and_export(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"가": "x.png",\n "나": "y.png"}', encoding="utf-8")
    rows = tb.read_map(spark, str(tmp_path / "map.json"))
    assert sorted(map(tuple, rows.collect())) == [("가", "x.png"), ("나", "y.png")]
    tb.write_map(rows, str(tmp_path / "out"))
    tb.write_csv(rows, str(tmp_path / "csv"))
    assert tb.read_csv(spark, str(tmp_path / "csv"), ["name", "value"]).count() == 2


def test_keyed_table_rewrites_only_the_buckets_it_touches(spark, tmp_path):
    from tidewire.sources.keyed import KeyedTable

    path = str(tmp_path / "t")
    first = spark.createDataFrame([(i, f"v{i}", i) for i in range(200)], "k int, v string, n int")
    table = KeyedTable(spark, path, ["k"], 16).create(first)
    files = lambda: {p: p.stat().st_mtime_ns for p in (tmp_path / "t").rglob("*.parquet")}
    bucket = lambda p: int(p.parent.name.removeprefix("_bucket="))
    before = files()
    touched = table.upsert(spark.createDataFrame([(3, "old", 1, 1), (3, "new", 2, 2), (500, "added", 5, 3)], "k int, v string, n int, at int"), "at")
    after = files()
    assert 1 <= len(touched) <= 2
    assert {p: t for p, t in before.items() if bucket(p) not in touched} == {p: t for p, t in after.items() if bucket(p) not in touched}
    assert not any(p in after for p in before if bucket(p) in touched)
    want = {i: (f"v{i}", i) for i in range(200)} | {3: ("new", 2), 500: ("added", 5)}
    assert {r["k"]: (r["v"], r["n"]) for r in table.read().collect()} == want
    assert len(table.patch(spark.createDataFrame([(7, None, 70), (7, "seven", None), (900, "nobody", 1)], "k int, v string, n int"), ["v"])) <= 2
    want[7] = ("seven", 7)
    assert {r["k"]: (r["v"], r["n"]) for r in KeyedTable(spark, path, ["k"], 16).read().collect()} == want
    assert table.upsert(spark.createDataFrame([], "k int, v string, n int, at int"), "at") == [] and table.read().count() == 201


def test_keyed_table_that_begins_empty(spark, tmp_path):
    from tidewire.sources.keyed import KeyedTable

    empty = spark.createDataFrame([], "k string, v int")
    table = KeyedTable(spark, str(tmp_path / "e"), ["k"], 4).create(empty)
    assert table.read().collect() == []
    table.upsert(spark.createDataFrame([("a", 1, 1), (None, 2, 2)], "k string, v int, at int"), "at")
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 1), (None, 2)]


def test_pages_are_read_in_small_steps():
    import pyarrow as pa

    html = [None if i % 7 == 0 else f"<article><h1>t{i}</h1>body {i}</article>" for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array([f"u{i}" for i in range(1000)]), pa.array(html)], names=["page_id", "url", "html"])
    rules = {"content": ["article"], "author": ["article h1"]}
    out = list(pg._read_pages(rules, "page_id")([batch]))
    assert max(b.num_rows for b in out) <= pg.PAGES and sum(b.num_rows for b in out) == 1000
    rows = [r for b in out for r in b.to_pylist()]
    assert rows == [{"page_id": i, "url": f"u{i}"} | pg.read_fields(html[i], rules) for i in range(1000)]
