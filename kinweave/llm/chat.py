"""Chat formatting by incremental black-box rendering.

A template is any function from a list of (role, text) messages to one string.  The
formatter renders successive prefixes of a conversation and compares consecutive outputs:
where the longer output begins with the shorter one, the rest is the new turn's
span.  Where it does not, the template rewrites history: the conversation is marked.  Where
a text stands is found by rendering its turn with two probe texts and looking at what they have
in common.  Spans of a template that rewrites would belong to outputs that no longer stand, so
none are returned; its texts are looked for in the final output, by probes there, and those
that it has dropped are in no loss span.

Every prefix is rendered whole, as a template may rewrite history for some lengths only; for a conversation of n turns that takes
O(n^2) characters.

A template needs its whole conversation, so one conversation must fit in a task.

Edge cases: null texts and roles are empty; very long texts are ordinary ones; turns are ordered
by turn number, nulls first, and equal numbers by role and text; repeated rows are turns of their
own; a row with a null id is a conversation of its own, so that such rows never crowd one task; an
empty table gives no rows; columns other than the four named are ignored, whatever they are called.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import schema_of

#: Conversations in one batch of results, and characters after which one is sent early.
ROWS, CHARS = 500, 4 << 20

#: The control strings of the template below.
START, END = "<|im_start|>", "<|im_end|>"

Message = tuple[str, str]


def escape(text: str, line: bool = False) -> str:
    """``text`` without control strings: a backslash goes before each backslash and inside each ``<|``."""
    text = text.replace("\\", "\\\\").replace("<|", "<\\|")
    return text.replace("\n", "\\n") if line else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


def chatml(messages: list[Message]) -> str:
    """Turns between start and end marks, the role on the first line; texts are escaped."""
    return "".join(f"{START}{escape(role, True)}\n{escape(text)}{END}\n" for role, text in messages)


def parse_chatml(formatted: str) -> list[tuple[str, int, int]]:
    """``(role, start, end)`` of each text in the output of :func:`chatml`."""
    found, at = [], 0
    while at < len(formatted):
        line = formatted.index("\n", at)
        end = formatted.index(END, line)
        found.append((unescape(formatted[at + len(START) : line]), line + 1, end))
        at = end + len(END) + 1
    return found


def _common(a: str, b: str) -> int:
    """Length of the common prefix, by halving."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if a[low:middle] == b[low:middle] else (low, middle)
    return low


def _text_span(messages: list[Message], k: int, end: int, whole: str, render) -> tuple[int, int] | None:
    """Where the text of turn ``k`` stands in ``whole``, the output for the turns before ``end``.

    None if the text stands nowhere, or changes more than one place.
    """
    one, two = (render([*messages[:k], (messages[k][0], probe), *messages[k + 1 : end]]) for probe in ("0", "1"))
    if one == two:
        return None
    head = _common(one, two)
    tail = _common(one[:head:-1], two[:head:-1])
    stop = len(whole) - tail
    same = head <= stop and whole.startswith(one[:head]) and (not tail or whole.endswith(one[-tail:]))
    return (head, stop) if same else None


def turn_spans(messages: list[Message], render: Callable[[list[Message]], str]) -> tuple[str, list[tuple[int, int]], list[tuple[int, int] | None], bool]:
    """The whole output, the span of each turn (of none, if the template rewrites history), the
    span of each text or None, and whether the template rewrites history."""
    whole = render(messages) if messages else ""
    spans, texts, before = [], [], ""
    for k in range(len(messages)):
        after = render(messages[: k + 1])
        if not after.startswith(before):
            return whole, [], [_text_span(messages, i, len(messages), whole, render) for i in range(len(messages))], True
        spans.append((len(before), len(after)))
        texts.append(_text_span(messages, k, k + 1, after, render))
        before = after
    return whole, spans, texts, False


def format_conversations(
    df: DataFrame,
    render: Callable[[list[Message]], str] = chatml,
    conv: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """``(conv, formatted, spans, loss, rewrites)`` of each conversation.

    ``spans`` are the turns' starts and ends in ``formatted``, ``loss`` those of the
    texts of ``loss_role``, both flat lists in order.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def packed() -> pa.RecordBatch:
            kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.bool_()]
            ids = pa.array([o[0] for o in out], id_type)
            return pa.RecordBatch.from_arrays(
                [ids, *(pa.array([o[i + 1] for o in out], kind) for i, kind in enumerate(kinds))],
                names=[conv, "formatted", "spans", "loss", "rewrites"],
            )

        def close() -> None:
            whole, spans, texts, rewrites = turn_spans(messages, render)
            loss = [x for (r, _), s in zip(messages, texts) if r == loss_role and s for x in s]
            out.append((current, whole, [x for s in spans for x in s], loss, rewrites))

        current, messages, id_type = None, [], None
        for batch in batches:
            id_type = batch.schema.field(conv).type
            columns = (batch.column(c).to_pylist() for c in (conv, role, text))
            for c, r, t in zip(*columns):
                if messages and (c != current or c is None):
                    close()
                    messages = []
                current = c
                messages.append((r or "", t or ""))
            if len(out) >= ROWS or sum(len(o[1]) for o in out) >= CHARS:
                yield packed()
                out = []
        if messages:
            close()
        if out:
            yield packed()

    ddl = "formatted string, spans array<long>, loss array<long>, rewrites boolean"
    return (
        df.select(conv, turn, role, text)
        .repartition(conv, F.when(F.col(conv).isNull(), F.xxhash64(turn, role, text)))
        .sortWithinPartitions(conv, turn, role, text)
        .mapInArrow(run, schema_of(df, [conv], ddl))
    )


def read_back(formatted: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Counts and digests, all taken from the output of :func:`format_conversations` with :func:`chatml`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for whole, loss in zip(batch.column("formatted").to_pylist(), batch.column("loss").to_pylist()):
                turns = parse_chatml(whole)
                digest = hashlib.sha256()
                for role, start, end in turns:
                    digest.update(f"{role}\n{unescape(whole[start:end])}\n".encode())
                masked = "".join(unescape(whole[a:b]) for a, b in zip(loss[::2], loss[1::2]))
                rows.append(
                    (len(turns), digest.hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(whole))
                )
            columns = list(zip(*rows)) if rows else [()] * 5
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(conv), *(pa.array(c, k) for c, k in zip(columns, kinds)), batch.column("rewrites")],
                names=[conv, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "rewrites"],
            )

    ddl = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, rewrites boolean"
    return formatted.select(conv, "formatted", "loss", "rewrites").mapInArrow(run, schema_of(formatted, [conv], ddl))
