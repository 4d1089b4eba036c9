"""CSV rows in file order, however the files are cut into splits."""

import csv
import io
import random

import pytest

from tidewire.sources import tables as tb


@pytest.mark.parametrize("split", [64, 1 << 20])
def test_rows_follow_the_file(spark, tmp_path, split):
    rnd = random.Random(split)
    values = ["plain", "two\nlines", 'a "quoted" word', "x,y", "\n\nthree breaks\n", "한글 값", "long " * 30]
    want = []
    for name, bom in (("a.csv", "\ufeff"), ("b.csv", "")):
        rows = [[f"{name[0]}{k}", rnd.choice(values), rnd.choice(["1.5", ""])] for k in range(150)]
        out = io.StringIO()
        csv.writer(out, lineterminator="\n").writerows([["keyword", "sentiment", "weight"], *rows])
        (tmp_path / name).write_text(bom + out.getvalue() + "\n", encoding="utf-8")
        want += [(k, v, w or None) for k, v, w in rows]
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = tb.read_csv_rows(spark, str(tmp_path / "*.csv"), ["keyword"]).orderBy("seq").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [tuple(r)[:3] for r in got] == want


def test_the_last_row_of_a_file_wins(spark, tmp_path):
    lines = ["keyword,sentiment,weight"] + [f"w{k % 7},{'positive' if k % 2 else 'negative'},{k}" for k in range(100)]
    (tmp_path / "one.csv").write_text("\n".join(lines))
    got = {r.keyword: r.weight for r in tb.load_lexicon(spark, str(tmp_path / "one.csv")).collect()}
    assert got == {f"w{k % 7}": float(k) for k in range(93, 100)}


def test_unfit_files(spark, tmp_path):
    for name, text in (("open.csv", 'keyword,sentiment\n"a,positive\n'), ("none.csv", ""), ("other.csv", "word,label\na,positive\n")):
        (tmp_path / name).write_text(text)
        with pytest.raises(ValueError):
            tb.read_csv_rows(spark, str(tmp_path / name), ["keyword"])
