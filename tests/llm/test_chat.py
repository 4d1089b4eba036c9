"""Formatted conversations against plain code."""

import hashlib
import random
from collections import Counter

from pyspark.sql import functions as F

from tidewire.llm.chat_format import digests, escape, examples, format_examples, format_turns, read_back, render, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
PARTS = ["<", "[", "s>", "/s>", "INST]", "/INST]", "ROLE]", "/ROLE]", "\\", " ", "<s>", "</s>", "[INST] ", " [/INST]", "\n", "é", "\U0001f600", "$1", "a"]


def odd_turns(seed=5):
    rnd = random.Random(seed)
    text = lambda: "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(12)))
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "", None, "[/ROLE] <s>", "tool\n"]), rnd.choice([text(), None, ""])) for c in range(40) for t in range(rnd.randrange(1, 9))]
    rows += [(100, t, "user" if t % 2 == 0 else "assistant", text() + str(t)) for t in range(3000)]  # one long conversation
    rows += [(101, None, "user", "x"), (101, None, "user", "x"), (101, 3, "assistant", "same"), (101, 3, "assistant", "same"), (102, 0, "assistant", "y" * 3_000_000 + "[INST]")]
    return rows + [(None, 0, "user", "no id"), (None, 1, "assistant", "</s>")]


def plain(rows):
    by = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        by.setdefault(c, []).append((role or "", text or ""))
    return by


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    rnd = random.Random(1)
    texts = ["".join(rnd.choice(PARTS) for _ in range(rnd.randrange(30))) for _ in range(4000)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t"))).withColumn("u", unescape(F.col("e")))
    for r in df.collect():
        assert r.u == r.t
        assert not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "[ROLE]", "[/ROLE]"))


def test_digests(spark):
    rows = odd_turns()
    df = spark.createDataFrame(rows, SCHEMA).repartition(7).withColumn("position", F.lit("x")).withColumn("piece", F.lit(1))
    pieces = format_turns(df)
    got = {r.conv_id: r for r in digests(pieces).collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for c, turns in want.items():
        loss = "".join(t for role, t in turns if role == "assistant")
        assert got[c].n_turns == len(turns)
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert (got[c].loss_chars, got[c].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    sizes = Counter()
    for r in pieces.collect():
        sizes[r.conv_id] += len(r.piece)
    assert {c: r.formatted_chars for c, r in got.items()} == dict(sizes)


def test_places_and_examples(spark):
    rows = odd_turns(9)
    pieces = format_turns(spark.createDataFrame(rows, SCHEMA).repartition(5))
    want = plain(rows)
    by = {}
    for r in pieces.collect():
        by.setdefault(r.conv_id, []).append(r)
    for c, own in by.items():
        own.sort(key=lambda r: r.position)
        assert [r.position for r in own] == list(range(len(want[c])))
        at, n = 0, 0
        for r, (role, _) in zip(own, want[c], strict=True):
            assert r.start == at
            assert (r.example is not None) == (role == "assistant")
            if r.example is not None:
                assert r.example == n
                n += 1
            at += len(r.piece)
    assert examples(pieces).count() == sum(role == "assistant" for turns in want.values() for role, _ in turns)
    back = {(r.conv_id, r.position): (r.role, r.text) for r in read_back(pieces).collect()}
    assert back == {(c, k): turn for c, turns in want.items() for k, turn in enumerate(turns)}


def test_rendered_examples_hold_the_prefix_and_one_reply(spark):
    rows = [(1, 0, "system", "be [INST] kind"), (1, 1, "user", "hi"), (1, 2, "assistant", "hello"), (1, 3, "user", "and?"), (1, 4, "assistant", "bye"), (2, 0, "user", "alone")]
    pieces = format_turns(spark.createDataFrame(rows, SCHEMA))
    got = {r.example: r for r in render(pieces, examples(pieces)).collect()}
    first = "<s>[ROLE]system[/ROLE] be [\\INST] kind </s><s>[INST] hi [/INST] hello </s>"
    assert got[0].formatted == first
    assert got[1].formatted == first + "<s>[INST] and? [/INST] bye </s>"
    assert [got[k].formatted[got[k].target_from : got[k].target_to] for k in (0, 1)] == ["hello", "bye"]
    assert set(got) == {0, 1}


def test_empty(spark):
    pieces = format_turns(spark.createDataFrame([], SCHEMA))
    assert pieces.collect() == [] and digests(pieces).collect() == [] and examples(pieces).collect() == []


def test_every_reply_is_written_out_behind_its_whole_context(spark):
    rows = odd_turns(11)
    pieces = format_turns(spark.createDataFrame(rows, SCHEMA).filter("conv_id <> 102 OR conv_id IS NULL").repartition(6))
    own = {}
    for r in pieces.collect():
        own.setdefault(r.conv_id, []).append(r)
    want = set()
    for c, turns in own.items():
        stream = ""
        for r in sorted(turns, key=lambda r: r.position):
            stream += r.piece
            last = (c, r.example, hashlib.sha256(stream.encode()).hexdigest(), r.target_from, r.target_to)
            want |= {last} if r.example is not None else set()
        want.add(last)  # turns that no reply follows
    written = format_examples(pieces).select("conv_id", "example", F.sha2("formatted", 256).alias("formatted"), "target_from", "target_to").collect()
    assert {tuple(r) for r in written} == want and len(written) == len(want)


def test_digests_read_the_written_examples(spark, monkeypatch):
    from tidewire.llm import chat_format

    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "a </s>"), (1, 2, "assistant", "b"), (1, 3, "tool", "end")]
    ordered = format_turns(spark.createDataFrame(rows, SCHEMA)).orderBy("position").toArrow()
    monkeypatch.setattr(chat_format, "HELD_BYTES", 1)
    written = [r for b in chat_format._written(iter(ordered.to_batches())) for r in b.to_pylist()]
    assert [r["formatted"][r["target_from"] : r["target_to"]] for r in written[:2]] == ["a <\\/s>", "b"]
    assert [r["example"] for r in written] == [0, 1, None] and written[2]["formatted"].startswith(written[1]["formatted"])
    read = [r for b in chat_format._digested(chat_format._written(iter(ordered.to_batches()))) for r in b.to_pylist()]
    assert [(r["n_turns"], r["loss_chars"], r["formatted_chars"]) for r in read] == [(4, 7, len(written[2]["formatted"]))]
