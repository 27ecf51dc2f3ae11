"""Chat examples by prefix-target expansion.

Every assistant turn becomes one example: all turns before it as context, and its
own text as the only trainable span.  A conversation that does not end with an
assistant turn gets one more example, its whole transcript with nothing to
train on, so that every turn can be read back.

A turn is written ``<s>[INST] role\\n text [/INST]</s>``.  Control strings inside roles and
texts are escaped by a backslash after their first character, and a control
string that already has backslashes there gets one more, so unescaping is
exact.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from zealmark.llm.common import partitions, prepare

OPEN, CLOSE, BREAK = "<s>[INST] ", " [/INST]</s>", "[SEP]"
# Control strings of the template, plain or already escaped
CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\]|SEP\])")
ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\]|SEP\])")
TURN = re.compile(re.escape(OPEN) + "(.*?)" + re.escape(BREAK) + "(.*?)" + re.escape(CLOSE), re.S)
ASSISTANT = "assistant"

EXAMPLES = "conv_id bigint, example bigint, target_turn bigint, text string, loss_start bigint, loss_end bigint"


def escape(text: str) -> str:
    return CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2\3", text)


def write_turn(role: str, text: str) -> str:
    return f"{OPEN}{escape(role)}{BREAK}{escape(text)}{CLOSE}"


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted example."""
    turns, at = [], 0
    for match in TURN.finditer(formatted):
        if match.start() != at:
            raise ValueError(f"no turn at {at}")
        turns.append((unescape(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


def _by_conversation(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Rows of a partition that is sorted by conversation, with a flag on the first of each."""
    last: object = ()
    for batch in batches:
        for row in zip(*[batch.column(c).to_pylist() for c in columns], strict=True):
            yield (row[0] != last, *row)
            last = row[0]


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple] = []
    size = 0
    context: list[str] = []
    length = example = 0
    conv, open_end = None, False

    def flush() -> pa.RecordBatch:
        nonlocal held, size
        names = [c.split()[0] for c in EXAMPLES.split(", ")]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)], names=names)
        held, size = [], 0
        return out

    def rest() -> None:
        """The transcript of a conversation whose last turn no example holds."""
        nonlocal size
        if open_end:
            held.append((conv, example, None, "".join(context), length, length))
            size += length

    for first, conv_id, turn, role, text in _by_conversation(batches, ("conv_id", "turn", "role", "text")):
        if first:
            rest()
            context, length, example, conv, open_end = [], 0, 0, conv_id, False
        written = write_turn(role, text)
        context.append(written)
        open_end = role != ASSISTANT
        if not open_end:
            start = length + len(OPEN) + len(escape(role)) + len(BREAK)
            held.append((conv, example, turn, "".join(context), start, length + len(written) - len(CLOSE)))
            size += length + len(written)
            example += 1
        length += len(written)
        if len(held) >= 1000 or size >= 1 << 22:
            yield flush()
    rest()
    if held:
        yield flush()


def format_conversations(turns: DataFrame) -> DataFrame:
    """Examples (conv_id, example, target_turn, text, loss_start, loss_end) of all conversations.

    The loss mask is the span [loss_start, loss_end) of code points.  Turns
    stand by turn number (null first), rows that share it by role and text;
    null roles and texts are empty.  Rows without conv_id are one conversation.  The rows are laid
    out by conversation and streamed; a task holds one transcript and a few
    examples, never a conversation's whole expansion.
    """
    prepare(turns.sparkSession)
    rows = turns.select(
        F.col("conv_id").cast("bigint").alias("conv_id"),
        F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    laid = rows.repartition(partitions(turns.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return laid.mapInArrow(_expand, EXAMPLES)


DIGESTS = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    out: list[tuple] = []
    conv, last, loss, loss_chars, chars, seen = None, "", hashlib.sha256(), 0, 0, False

    def done() -> None:
        turns, digest = read_turns(last), hashlib.sha256()
        for role, text in turns:
            digest.update(f"{role}\n{text}\n".encode())
        out.append((conv, len(turns), digest.hexdigest(), loss_chars, loss.hexdigest(), chars))

    for first, conv_id, _, text, start, end in _by_conversation(batches, ("conv_id", "example", "text", "loss_start", "loss_end")):
        if first:
            if seen:
                done()
            conv, loss, loss_chars, chars, seen = conv_id, hashlib.sha256(), 0, 0, True
        trained = unescape(text[start:end])
        loss.update(trained.encode())
        loss_chars, chars, last = loss_chars + len(trained), chars + len(text), text
        if len(out) >= 1000:
            yield _rows(out)
            out = []
    if seen:
        done()
    if out:
        yield _rows(out)


def _rows(out: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in DIGESTS.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


def read_back(examples: DataFrame) -> DataFrame:
    """Digests per conversation, read from the formatted examples alone.

    Turns come from the last example, which holds the whole transcript; the
    trained text is that under the loss masks of all examples, in order.
    """
    spark = examples.sparkSession
    laid = examples.select("conv_id", "example", "text", "loss_start", "loss_end").repartition(partitions(spark), "conv_id")
    return laid.sortWithinPartitions("conv_id", "example").mapInArrow(_digest, DIGESTS)
