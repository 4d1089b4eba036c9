"""Conversations as training examples: every assistant turn becomes an example whose context is all that precedes it.

A conversation is formatted once, turn by turn, into one stream of pieces. An example names its context and its target as
ranges of that stream (prefix and reply). ``format_examples`` writes every example out, its context in front of its reply;
``render`` writes those that are asked for.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidewire.session import durable

#: Control strings of the template, around the turns of each role; other roles are named inside their marks.
USER = ("<s>[INST] ", " [/INST]")
REPLY = (" ", " </s>")
ROLE = ("<s>[ROLE]", "[/ROLE] ", " </s>")

#: What a text could hold of a control string: its first character, any number of backslashes, and its rest.
_CONTROLS = [r"<(\\*)(/?s>)", r"\[(\\*)(/?(?:INST|ROLE)\])"]


def escape(text: Column) -> Column:
    """The text with one more backslash inside everything that looks like a control string; none is left whole."""
    for pattern in _CONTROLS:
        first = "<" if pattern.startswith("<") else "["
        text = F.regexp_replace(text, F.lit(pattern), F.lit(f"{first}\\\\$1$2"))
    return text


def unescape(text: Column) -> Column:
    """The inverse of :func:`escape`: one backslash fewer."""
    for pattern in _CONTROLS:
        first = "<" if pattern.startswith("<") else "["
        text = F.regexp_replace(text, F.lit(pattern.replace(r"(\\*)", r"\\(\\*)")), F.lit(f"{first}$1$2"))
    return text


def format_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per turn: ``conv_id, position, piece, start, example, target_from, target_to``.

    ``piece`` is the formatted turn and ``start`` its place in the conversation's stream, in code points; ``position``
    counts turns from 0. An assistant turn is example number ``example`` (from 0): its context is the stream from 0 to
    ``target_from``, and only ``target_from`` to ``target_to``, the reply without its marks, is trainable. The three are
    null for other turns.

    Turns are ordered by ``turn`` (null first), then role and text; repeated rows are turns of their own. A null text or
    role counts as empty, a null conversation is one conversation, other columns are not read, an empty table gives an
    empty result. A conversation of any length is spread over range partitions: running sums are taken inside a range,
    and a range that begins inside a conversation gets that one conversation's sums so far.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("role", role), ("text", text))])
    body, reply = escape(F.col("text")), F.col("role") == "assistant"
    piece = (
        F.when(F.col("role") == "user", F.concat(F.lit(USER[0]), body, F.lit(USER[1])))
        .when(reply, F.concat(F.lit(REPLY[0]), body, F.lit(REPLY[1])))
        .otherwise(F.concat(F.lit(ROLE[0]), escape(F.col("role")), F.lit(ROLE[1]), body, F.lit(ROLE[2])))
    )
    order = ["turn", "role", "text"]
    sums = ["position", "start", "replies"]
    counted = rows.withColumns({"one": F.lit(1).cast("bigint"), "chars": F.char_length(piece).cast("bigint"), "reply": reply.cast("bigint")})
    ranged = durable(counted.repartitionByRange("conv_id", *order).withColumn("range", F.spark_partition_id()))
    before = W.partitionBy("conv_id", "range").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    pieces = ranged.withColumn("piece", piece).withColumns({name: F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in zip(sums, ("one", "chars", "reply"), strict=True)})
    whole = ranged.groupBy("conv_id", "range").agg(*[F.sum(c).alias(name) for name, c in zip(sums, ("one", "chars", "reply"), strict=True)])
    ahead = W.partitionBy("conv_id").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(F.col("conv_id").alias("c"), F.col("range").alias("r"), *[F.sum(name).over(ahead).alias(f"{name}_carried") for name in sums])
    carried = carried.filter("position_carried IS NOT NULL")  # one conversation per range at most begins before it
    out = pieces.join(F.broadcast(carried), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("range") == F.col("r")), "left")
    for name in sums:
        out = out.withColumn(name, F.col(name) + F.coalesce(f"{name}_carried", F.lit(0)))
    reply = F.col("reply") == 1
    return out.select(
        "conv_id", "position", "piece", "start", F.when(reply, F.col("replies")).alias("example"),
        F.when(reply, F.col("start") + len(REPLY[0])).alias("target_from"), F.when(reply, F.col("start") + F.col("chars") - len(REPLY[1])).alias("target_to"),
    )


def examples(pieces: DataFrame) -> DataFrame:
    """One row per assistant turn: ``conv_id, example, position, target_from, target_to, end``; the example is the
    conversation's stream up to ``end``, its context ends at ``target_from``."""
    end = F.col("start") + F.char_length("piece")
    return pieces.filter("example IS NOT NULL").select("conv_id", "example", "position", "target_from", "target_to", end.alias("end"))


def render(pieces: DataFrame, wanted: DataFrame) -> DataFrame:
    """The texts of the examples ``conv_id, example`` of ``wanted``: ``formatted`` up to the reply's end mark, and the
    trainable range ``target_from, target_to`` in it. An example is one row, so its whole context is in one string; the
    rows joined are the turns of the wanted contexts."""
    asked = wanted.select(F.col("conv_id").alias("c"), F.col("example").alias("e")).distinct()
    asked = examples(pieces).join(asked, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("example") == F.col("e"))).select("c", "e", F.col("position").alias("p"), F.col("target_from").alias("f"), F.col("target_to").alias("t"))
    parts = asked.join(pieces.select("conv_id", "position", "piece"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("position") <= F.col("p")))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "piece"))), lambda x: x["piece"]), "")
    return parts.groupBy(F.col("c").alias("conv_id"), F.col("e").alias("example")).agg(whole.alias("formatted"), F.first("f").alias("target_from"), F.first("t").alias("target_to"))


def read_back(pieces: DataFrame) -> DataFrame:
    """The turns that the pieces say, ``conv_id, position, role, text, loss, chars``: role and text by the template's marks,
    ``loss`` the unescaped characters under the loss mask (null where there are none)."""
    piece = F.col("piece")
    named = r"(?s)^<s>\[ROLE\](.*?)\[/ROLE\] "
    role = F.when(piece.startswith(USER[0]), F.lit("user")).when(piece.startswith(ROLE[0]), unescape(F.regexp_extract(piece, named, 1))).otherwise(F.lit("assistant"))
    text = F.regexp_extract(piece, r"(?s)^(?:<s>\[INST\] |<s>\[ROLE\].*?\[/ROLE\] | )(.*)(?: \[/INST\]| </s>)$", 1)
    loss = F.substring(piece, (F.col("target_from") - F.col("start") + 1).cast("int"), (F.col("target_to") - F.col("target_from")).cast("int"))
    return pieces.select("conv_id", "position", role.alias("role"), unescape(text).alias("text"), unescape(loss).alias("loss"), F.char_length(piece).cast("bigint").alias("chars"))


#: Bytes of formatted examples that a task gathers before it hands them on.
HELD_BYTES = 1 << 22

_TURN = re.compile(r"<s>\[INST\] (?P<user>.*?) \[/INST\]|<s>\[ROLE\](?P<role>.*?)\[/ROLE\] (?P<named>.*?) </s>| (?P<reply>.*?) </s>", re.DOTALL)
_ESCAPED = [(re.compile(p.replace(r"(\\*)", r"\\(\\*)")), ("<" if p.startswith("<") else "[") + r"\1\2") for p in _CONTROLS]


def _unescaped(text: str) -> str:
    for pattern, put in _ESCAPED:
        text = pattern.sub(put, text)
    return text


def _written(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of conversations, each in order, to their examples; a conversation's stream and one batch are held."""
    names = ["conv_id", "example", "formatted", "target_from", "target_to"]
    out, held, now, stream, begun, rest, kind = [], 0, None, bytearray(), False, False, pa.int64()

    def made():
        types = [kind, pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    for batch in batches:
        kind = batch.schema.field("conv_id").type
        columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("conv_id", "piece", "example", "target_from", "target_to")]
        for conv, piece, example, first, last in zip(*columns, strict=True):
            if not begun or conv != now:
                if rest:
                    out.append((now, None, bytes(stream), None, None))
                    held += len(stream)
                now, stream, begun = conv, bytearray(), True
            stream += piece.encode()
            rest = example is None
            if not rest:
                out.append((now, example, bytes(stream), first, last))
                held += len(stream)
            if held >= HELD_BYTES:
                yield made()
                out, held = [], 0
    if rest:
        out.append((now, None, bytes(stream), None, None))
    if out:
        yield made()


def _in_order(pieces: DataFrame) -> DataFrame:
    return pieces.select("conv_id", "position", "piece", "example", "target_from", "target_to").repartition("conv_id").sortWithinPartitions("conv_id", "position")


def format_examples(pieces: DataFrame) -> DataFrame:
    """The examples of all conversations with their texts: ``conv_id, example, formatted, target_from, target_to``.

    An assistant turn gives one row: ``formatted`` is its context, which is all that precedes it, and the reply with its
    marks; ``target_from`` to ``target_to`` is the reply in it, in code points. Turns that no reply follows, or all of a
    conversation without a reply, give one more row of the whole conversation with nulls for the three. The texts grow
    with the turns of a conversation times its length; a task holds one conversation's stream and a few megabytes.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    return _in_order(pieces).mapInArrow(_written, f"conv_id {kind}, example long, formatted string, target_from long, target_to long")


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written examples, those of a conversation in order, to what they say: each must begin with the one before it."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    now, said, learnt, n, n_loss, chars, begun, before = None, None, None, 0, 0, 0, False, b""
    for batch in batches:
        ids = batch.column(0)
        out = []
        for conv, formatted, first, last in zip(ids.to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), *[batch.column(k).to_pylist() for k in (3, 4)], strict=True):
            if not begun or conv != now:
                if begun:
                    out.append((now, n, said.hexdigest(), n_loss, learnt.hexdigest(), chars))
                now, said, learnt, n, n_loss, chars, begun, before = conv, hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, b""
            if not formatted.startswith(before):
                raise ValueError(f"an example of conversation {conv} does not begin with the one before it")
            added, at = formatted[len(before) :].decode(), 0
            while at < len(added):
                turn = _TURN.match(added, at)
                if turn is None:
                    raise ValueError(f"conversation {conv} cannot be read at {chars + at}")
                role = {"user": "user", "reply": "assistant"}.get(turn.lastgroup) or _unescaped(turn["role"])
                said.update(f"{role}\n{_unescaped(turn[turn.lastgroup])}\n".encode())
                n, at = n + 1, turn.end()
            if first is not None:
                loss = _unescaped(added[first - chars : last - chars])
                learnt.update(loss.encode())
                n_loss += len(loss)
            chars, before = chars + len(added), formatted
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _types(ids.type), strict=True)], names=names)
    if begun:
        last = (now, n, said.hexdigest(), n_loss, learnt.hexdigest(), chars)
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(last, _types(ids.type), strict=True)], names=names)


def _types(ids: pa.DataType) -> list[pa.DataType]:
    return [ids, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def digests(pieces: DataFrame) -> DataFrame:
    """One row per conversation of what its examples say, written out as by :func:`format_examples` and read back: turns,
    their digest, characters and digest under the loss mask, and the length of the formatted conversation.

    A digest needs the turns of a conversation one after another, so each conversation goes in order through one task,
    which reads the examples a few megabytes at a time where they are written.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    return _in_order(pieces).mapInArrow(
        lambda batches: _digested(_written(batches)), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
