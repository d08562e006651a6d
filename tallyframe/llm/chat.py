"""Chat formatting with a grammar that is parsed back and compared.

A turn is rendered as ``<|turn|>`` role ``\\n<|says|>`` text ``\\n<|end|>``; a
conversation is its turns, one after the other. Any control string inside a
role or text gets one backslash before it, and backslashes that already stand
before one are kept and counted, so that the parser can take exactly one away.
A turn is first rendered as it is; only if the parser does not give back the
same role and text is its content escaped, and the parse repeated.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, SAYS, END = "<|turn|>", "\n<|says|>", "\n<|end|>"
# Control strings of this template and of others in use.
CONTROLS = (
    "<|turn|>", "<|says|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<|im_start|>", "<|im_end|>", "<|endoftext|>",
)
_CONTROL = "|".join(re.escape(c) for c in CONTROLS)
_INSIDE = re.compile(rf"(\\*)({_CONTROL})")
_FORMATTED = "conv_id bigint, turn bigint, role string, formatted string, loss boolean"


def escape(text: str) -> str:
    return _INSIDE.sub(r"\\\1\2", text)


def unescape(text: str) -> str:
    return re.sub(rf"\\(\\*)({_CONTROL})", r"\1\2", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) turns; ValueError where the grammar does not hold. A control
    string with a backslash before it is content, one without is a mark."""
    marks = [m for m in _INSIDE.finditer(formatted) if not m[1]]
    turns, at = [], 0
    for i in range(0, len(marks), 3):
        three = marks[i : i + 3]
        if [m[2] for m in three] != [TURN, SAYS[1:], END[1:]] or three[0].start() != at:
            raise ValueError("not a turn")
        a, b, c = three
        if formatted[b.start() - 1] != "\n" or b.start() <= a.end() or formatted[c.start() - 1] != "\n" or c.start() <= b.end():
            raise ValueError("a mark does not begin a line")
        turns.append((unescape(formatted[a.end() : b.start() - 1]), unescape(formatted[b.end() : c.start() - 1])))
        at = c.end()
    if at != len(formatted):
        raise ValueError("text after the last turn")
    return turns


def _said(formatted: str) -> Column:
    """The text of one formatted turn up to its end mark, after its role, as it was before escaping."""
    kept = F.substr(F.col(formatted), F.lit(1), F.length(formatted) - len(END))
    return F.regexp_replace(kept, rf"\\(\\*)({_CONTROL})", "$1$2")


def render(role: str, text: str) -> str:
    """One turn, escaped if and only if it would not be read back as it is."""
    for change in (lambda s: s, escape):
        out = f"{TURN}{change(role)}{SAYS}{change(text)}{END}"
        try:
            if parse(out) == [(role, text)]:
                return out
        except ValueError:
            pass
    raise ValueError(f"a turn of role {role!r} is not read back")


def formatted_turns(conversations: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, formatted, loss) of every row of ``conversations``
    (conv_id, turn, role, text).

    A conversation's text is its rows' ``formatted`` in order of (turn, role,
    text), nulls first. A null role or text is empty. Repeated rows are repeated
    turns. ``loss`` marks the turns whose text is learnt.
    """

    def run(batches):
        for batch in batches:
            roles = [r or "" for r in batch.column("role").to_pylist()]
            texts = [t or "" for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), pa.array(roles, pa.string()),
                 pa.array([render(r, t) for r, t in zip(roles, texts, strict=True)], pa.string()),
                 pa.array([r == loss_role for r in roles], pa.bool_())],
                ["conv_id", "turn", "role", "formatted", "loss"])

    return conversations.select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    ).mapInArrow(run, _FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)
    from formatted turns alone.

    The rows of a conversation come to one task in order and are taken one by
    one, so a conversation of any length needs the memory of one turn. A null
    conv_id is one conversation.
    """

    def digests(batches) -> Iterator[pa.RecordBatch]:
        done: list = []
        state: list | None = None

        def closed():
            conv, n, turns, chars, loss, size = state
            return conv, n, turns.hexdigest(), chars, loss.hexdigest(), size

        for batch in batches:
            for conv, formatted, loss in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "formatted", "loss")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        done.append(closed())
                    state = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(formatted):
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                    if loss:
                        state[3] += len(text)
                        state[4].update(text.encode())
                state[5] += len(formatted)
            if len(done) >= 1000:
                yield _batch(done)
                done = []
        if state is not None:
            done.append(closed())
        if done:
            yield _batch(done)

    return (
        formatted.repartition("conv_id").withColumn("_said", _said("formatted"))
        .sortWithinPartitions("conv_id", "turn", "role", "_said")
        .select("conv_id", "formatted", "loss")
        .mapInArrow(digests, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
    )


def _batch(rows: list) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
