"""Saved web pages and feeds as tables (A1-A4)."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- Fixed values: where the supported news sites keep the parts of an article -------------------
ARTICLE_RULES = {
    "content": ["#dic_area", "#articleBodyContents", ".story-news.article", "#articletxt", ".article-body"],
    "press": ["span.media_end_head_top_press"],
    "press_logo": [".media_end_head_top_logo img"],
    "author": [".media_end_head_journalist_name", ".byline_s"],
    "published": ["span.media_end_head_info_datestamp_time"],
}
ATTRIBUTES = {"press_logo": "alt", "published": "data-date-time"}
ID_PATTERNS = [
    ("naver", r"/article/(\d+)/(\d+)", "NAVER_"),
    ("yonhap", r"/view/([A-Z0-9]+)", "YNA_"),
    ("hankyung", r"hankyung\.com/article/([^/?#\s]+)", "HK_"),
]
RSS_TIME = "d MMM yyyy HH:mm:ss"

#: Pages whose fields are held at a time.
PAGES = 256

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SILENT = {"script", "style", "template"}


class _Element:
    __slots__ = ("tag", "id", "classes", "attrs")

    def __init__(self, tag, attrs):
        self.tag, self.attrs = tag, {k: v or "" for k, v in attrs}
        self.id, self.classes = self.attrs.get("id"), set(self.attrs.get("class", "").split())

    def fits(self, simple: str) -> bool:
        """tag, #id, .class and their combinations, without spaces."""
        head, *classes = simple.split(".")
        tag, _, wanted_id = head.partition("#")
        return (not tag or tag == self.tag) and (not wanted_id or wanted_id == self.id) and set(classes) <= self.classes


class _Finder(HTMLParser):
    """First element and its text pieces for every selector of interest, in one reading of the page."""

    def __init__(self, selectors):
        super().__init__(convert_charrefs=True)
        self.waiting = {s: s.split() for s in selectors}
        self.open, self.filling, self.found = [], [], {}

    def handle_starttag(self, tag, attrs):
        element = _Element(tag, attrs)
        for selector, path in list(self.waiting.items()):
            if not element.fits(path[-1]):
                continue
            above, ok = iter(self.open), True
            for simple in path[:-1]:
                ok = ok and any(e.fits(simple) for e in above)
            if ok:
                del self.waiting[selector]
                self.found[selector] = (element.attrs, [])
                if tag not in VOID:
                    self.filling.append((len(self.open), selector))
        if tag not in VOID:
            self.open.append(element)

    def handle_endtag(self, tag):
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth].tag == tag:
                del self.open[depth:]
                self.filling = [f for f in self.filling if f[0] < depth]
                return

    def handle_data(self, data):
        if self.filling and not any(e.tag in SILENT for e in self.open):
            piece = data.strip()
            if piece:
                for _, selector in self.filling:
                    self.found[selector][1].append(piece)


def read_fields(html: str, rules: dict) -> dict:
    """Field texts of one page; a field takes its first selector that occurs at all."""
    finder = _Finder([s for selectors in rules.values() for s in selectors])
    finder.feed(html or "")
    finder.close()
    out = {}
    for field, selectors in rules.items():
        hit = next((finder.found[s] for s in selectors if s in finder.found), None)
        if hit is None:
            out[field] = None
        elif field in ATTRIBUTES:
            out[field] = hit[0].get(ATTRIBUTES[field])
        else:
            out[field] = (" " if field == "content" else "").join(hit[1])
    return out


def _read_pages(rules: dict, key: str):
    """Batch function: the fields of every page, ``PAGES`` pages at a time."""
    names = list(rules)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, PAGES):
                some = batch.slice(a, PAGES)
                fields = [read_fields(html.as_py(), rules) for html in some.column("html")]
                texts = [pa.array([f[n] for f in fields], pa.string()) for n in names]
                yield pa.RecordBatch.from_arrays([some.column(key), some.column("url"), *texts], names=[key, "url", *names])

    return run


def extract_articles(pages: DataFrame, rules: dict | None = None, key: str = "page_id") -> DataFrame:
    """Page fields per row (A1): content, press (name, else logo text, else Unknown), author without brackets, time."""
    rules = rules or ARTICLE_RULES
    names = list(rules)
    key_type = dict(pages.dtypes)[key]
    raw = pages.select(key, "url", "html").mapInArrow(_read_pages(rules, key), f"{key} {key_type}, url string, " + ", ".join(f"{n} string" for n in names))
    have = lambda n: F.col(n) if n in names else F.lit(None).cast("string")
    return raw.select(
        key, "url", F.coalesce("content", F.lit("")).alias("content"),
        F.coalesce(have("press"), have("press_logo"), F.lit("Unknown")).alias("press"),
        F.trim(F.regexp_replace(F.coalesce(have("author"), F.lit("")), r"\(.*?\)", "")).alias("author"),
        F.try_to_timestamp(have("published"), F.lit("yyyy-MM-dd HH:mm:ss")).alias("published_at"),
    )


def extract_links(pages: DataFrame, key: str = "page_id", item: str = "li") -> DataFrame:
    """Last anchor of every list item: link without its query string, and the anchor text as title (A3)."""
    items = pages.select(key, F.explode(F.regexp_extract_all("html", F.lit(rf"(?s)<{item}\b[^>]*>(.*?)</{item}>"), 1)).alias("item"))
    anchor = r'(?s)^.*<a\b[^>]*?\bhref="([^"]*)"[^>]*>(.*?)</a>'
    text = F.trim(F.regexp_replace(F.regexp_extract("item", anchor, 2), r"<[^>]*>", ""))
    return items.filter(F.col("item").rlike(anchor)).select(
        key, F.split_part(F.regexp_extract("item", anchor, 1), F.lit("?"), F.lit(1)).alias("link"), text.alias("title"))


def article_id_expr(url: str, patterns=None) -> Column:
    """Stable id from the first site pattern that fits, else NULL (A4)."""
    out = F.lit(None).cast("string")
    for _, pattern, prefix in reversed(patterns or ID_PATTERNS):
        groups = [F.regexp_extract(url, pattern, i + 1) for i in range(pattern.count("(") - pattern.count("(?"))]
        out = F.when(F.col(url).rlike(pattern), F.concat(F.lit(prefix), F.concat_ws("_", *groups))).otherwise(out)
    return out


RSS_ITEM = "title string, link string, guid string, pubDate string, creator string, author string"


def rss_fields(items: DataFrame) -> DataFrame:
    """Item columns to article columns: wall-clock time without weekday and offset, author by fallback (A2)."""
    clean = lambda c: F.nullif(F.trim(c), F.lit(""))
    time = F.regexp_extract("pubDate", r"(\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2})", 1)
    return items.select(
        F.trim("title").alias("title"), F.split_part(F.trim("link"), F.lit("?"), F.lit(1)).alias("url"),
        F.coalesce(clean("creator"), clean("author"), F.lit("")).alias("author"),
        F.try_to_timestamp(time, F.lit(RSS_TIME)).alias("published_at"),
        article_id_expr("link").alias("article_id"),
    )


def parse_rss(feeds: DataFrame, column: str = "xml") -> DataFrame:
    """Items of feeds stored one per row (A2)."""
    schema = f"channel struct<item array<struct<{RSS_ITEM.replace(' string', ': string')}>>>"
    parsed = F.from_xml(F.regexp_replace(column, "(</?)dc:", "$1"), schema)
    return rss_fields(feeds.select(F.explode(parsed["channel"]["item"]).alias("i")).select("i.*"))


def read_rss(spark, path: str) -> DataFrame:
    """Items of feed files (A2)."""
    raw = spark.read.format("xml").option("rowTag", "item").schema(RSS_ITEM.replace("creator", "`dc:creator`")).load(path)
    return rss_fields(raw.withColumnRenamed("dc:creator", "creator"))
