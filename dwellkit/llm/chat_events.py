"""Chat formatting from event logs: final messages folded from what happened, then rendered.

An event is (conv_id, seq, kind, turn, role, text). ``message`` starts a turn with a text,
``delta`` appends to it, ``edit`` replaces what is there, ``delete`` takes the turn away
and ``regenerate`` takes away the turn and all later ones. A message is rendered on its
own and its place in the conversation is a running sum of lengths, so a conversation of
any length is never put together in one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# A backslash escapes itself and the bar of a control string, so no text holds "<|".
_ESCAPED = re.compile(r"\\(.)", re.S)
_MESSAGE = re.compile(r"<\|im_start\|>((?:[^\\\n]|\\.)*+)\n((?:[^\\<]|\\.|<(?!\|))*+)<\|im_end\|>\n", re.S)


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    """Also keeps a line break inside a role from ending the header."""
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): what each turn says after all events.

    Events of a conversation apply in the order of seq; events with equal seq in the
    order of kind, turn, role, text. An event counts if no later one regenerates its turn
    or an earlier one or deletes its turn. A turn's text is the last message or edit that
    counts and the deltas after it; its role is the last one named since the last message.
    Deltas without a message make one. Null texts are empty, null roles stay null, null
    turns are one turn before all others, null conversations one conversation; events of
    other kinds do nothing. A turn with deletes or regenerations alone is not there.
    """
    order = [F.col(c).asc_nulls_first() for c in ("seq", "kind", "turn", "role", "text")]
    later = Window.partitionBy("conv_id").orderBy("place").rowsBetween(1, Window.unboundedFollowing)
    numbered = events.select("conv_id", "seq", "kind", "turn", "role", "text").withColumn(
        "place", F.row_number().over(Window.partitionBy("conv_id").orderBy(*order))
    )
    at = F.coalesce("turn", F.lit(-(1 << 62)))
    cut = F.min(F.when(F.col("kind") == "regenerate", at)).over(later)
    alive = numbered.withColumn("cut", cut).where(F.col("cut").isNull() | (F.col("cut") > at))
    own = Window.partitionBy("conv_id", "turn").orderBy("place")
    gone = F.max(F.when(F.col("kind") == "delete", F.col("place")))
    base = F.max(F.when(F.col("kind").isin("message", "edit"), F.col("place")))
    whole = own.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    kept = (
        alive.where(F.col("kind").isin("message", "delta", "edit", "delete"))
        .withColumn("gone", gone.over(whole))
        .where((F.col("gone").isNull() | (F.col("place") > F.col("gone"))) & (F.col("kind") != "delete"))
        .withColumn("base", base.over(whole))
        .withColumn("named", F.max(F.when(F.col("kind") == "message", F.col("place"))).over(whole))
    )
    spoken = F.col("base").isNull() | (F.col("place") >= F.col("base"))
    names = F.col("named").isNull() | (F.col("place") >= F.col("named"))
    said = F.sort_array(F.collect_list(F.when(spoken, F.struct("place", F.coalesce("text", F.lit("")).alias("text")))))
    return kept.groupBy("conv_id", "turn").agg(
        F.max_by("role", F.when(names & F.col("role").isNotNull(), F.col("place"))).alias("role"),
        F.array_join(F.transform(said, lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, message_no, formatted, start, mask_start, mask_length) for each message.

    formatted is the message between turn marks, with control strings in it escaped;
    start is where it begins in its conversation, in characters. The loss mask is the
    text of messages of ``loss_role`` and has length 0 elsewhere. An empty table stays empty.
    """
    role = escape_role(F.coalesce("role", F.lit("")))
    body = escape(F.coalesce("text", F.lit("")))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    head = F.concat(F.lit(START), role, F.lit("\n"))
    parts = messages.select(
        "conv_id",
        "turn",
        F.concat(head, body, F.lit(f"{END}\n")).alias("formatted"),
        F.length(head).cast("long").alias("head"),
        F.when(F.col("role") == loss_role, F.length(body)).otherwise(0).cast("long").alias("mask_length"),
    )
    start = F.coalesce(F.sum(F.length("formatted")).over(before), F.lit(0)).cast("long")
    return parts.select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("message_no"),
        "formatted",
        start.alias("start"),
        (start + F.col("head")).alias("mask_start"),
        "mask_length",
    )


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Streams the messages of sorted conversations through two digests; holds one message."""
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    state: list | None = None

    def closed(rows: list) -> pa.RecordBatch:
        values = [[c, n, t.hexdigest(), lc, ls.hexdigest(), f] for c, n, t, lc, ls, f in rows]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*values), kinds)], names=names)

    for batch in batches:
        done = []
        for row in batch.to_pylist():
            if state is None or state[0] != row["conv_id"]:
                done += [state] if state else []
                state = [row["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            formatted = row["formatted"]
            match = _MESSAGE.fullmatch(formatted)
            role, text = unescape(match[1]), unescape(match[2])
            state[1] += 1
            state[2].update(f"{role}\n{text}\n".encode())
            at = row["mask_start"] - row["start"]
            loss = unescape(formatted[at : at + row["mask_length"]])
            state[3] += len(loss)
            state[4].update(loss.encode())
            state[5] += len(formatted)
        if done:
            yield closed(done)
    if state:
        yield closed([state])


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) from what ``render`` wrote.

    A digest is a fold in order, so a conversation is one task's; it passes through message
    by message and is never held. Conversations have integer ids, null is one of them.
    """
    return (
        formatted.select(F.col("conv_id").cast("long").alias("conv_id"), "message_no", "formatted", "start", "mask_start", "mask_length")
        .repartition("conv_id")
        .sortWithinPartitions("conv_id", "message_no")
        .mapInArrow(
            _digests,
            "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
        )
    )


def events_of(turns: DataFrame) -> DataFrame:
    """A log in which each row of (conv_id, turn, role, text) is one message.

    Rows of a conversation are numbered by turn, role and text, so rows with one turn stay apart.
    """
    order = [F.col(c).asc_nulls_first() for c in ("turn", "role", "text")]
    number = F.row_number().over(Window.partitionBy("conv_id").orderBy(*order)).cast("long")
    return turns.select(
        "conv_id",
        number.alias("seq"),
        F.lit("message").alias("kind"),
        number.alias("turn"),
        "role",
        "text",
    )
