"""Operator 5, chat formatting by incremental rendering of a black box.

A template is any function from messages to text. Nothing is known of it: successive
prefixes of a conversation are rendered, and what an output has beyond the one before is
the span of the turn. An output that does not begin with the one before shows a template
that rewrites history; the turn is flagged and its span starts where the outputs part. The
place of the text inside a span is found by rendering the turn with two one-letter texts.

By default true prefixes are rendered from the first turn on, which takes time with the
square of a conversation's turns. ``context="doubling"`` keeps that linear: each turn is
rendered with the one before it, and at turns 1, 2, 4, 8 and so on, and at the last one, the
whole prefix is rendered and compared with the pieces so far. A conversation that disagrees
anywhere is rendered in full, prefix by prefix, so what comes out is what prefixes say,
for every template whose rewrites are still there at one of those turns. A black box takes
whole conversations, so both ways hold one conversation, its texts and pieces, in memory.

With a number as ``context`` a template is rendered on that many earlier turns only, and rows
stream through a task: a conversation of any length is never gathered, and rewrites further
back are not seen. ``context=0`` renders each turn alone and compares nothing: it is for
templates that are known to look back at nothing.

Order of turns: by turn (null first), then role and text. Null roles and texts are empty.
Null conversation ids form one conversation. Repeated rows are turns of their own. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Messages = list[tuple[str, str]]
Template = Callable[[Messages], str]

CONTROL = re.compile(r"</?s>|\[/?INST\]")
HIDDEN = re.compile(r"\\(.)", re.DOTALL)


def escape(text: str) -> str:
    """Break every control string by a backslash after its first character; double backslashes."""
    return CONTROL.sub(lambda m: m[0][0] + "\\" + m[0][1:], text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return HIDDEN.sub(r"\1", text)


def turn_template(messages: Messages) -> str:
    """``<s>role`` and the text, a user's text between instruction marks; looks back at nothing."""
    out = []
    for role, text in messages:
        body = f"[INST] {escape(text)} [/INST]" if role == "user" else escape(text)
        out.append("<s>" + escape(role).replace("\n", "\\n") + "\n" + body + "</s>\n")
    return "".join(out)


def read_turn(piece: str) -> tuple[str, str]:
    """Role and text of one turn that ``turn_template`` wrote."""
    head, _, body = piece.removeprefix("<s>").partition("\n")
    role = HIDDEN.sub(lambda m: "\n" if m[1] == "n" else m[1], head)
    body = body[: body.index("</s>")]
    return role, unescape(body.removeprefix("[INST] ").removesuffix(" [/INST]") if role == "user" else body)


def locate_turn(template: Template, before: Messages, turn: tuple[str, str]) -> tuple[str, bool, int, int]:
    """Text that a turn adds, whether it rewrote what was there, and the span of its text in it (-1 if unknown)."""
    return _locate(template, before, turn)[:4]


def _locate(template: Template, before: Messages, turn: tuple[str, str]) -> tuple[str, bool, int, int, int]:
    """What ``locate_turn`` gives, and how many characters of the earlier output are rewritten."""
    earlier, now = template(before), template([*before, turn])
    shared = len(earlier) if now.startswith(earlier) else len(commonprefix([earlier, now]))
    piece = now[shared:]
    one, two = (template([*before, (turn[0], letter)])[shared:] for letter in "ab")
    head = len(commonprefix([one, two]))
    tail = len(one) - head - 1
    fits = len(one) == len(two) and one[head : head + 1] == "a" and len(piece) >= head + tail
    if fits and piece[:head] == one[:head] and piece[len(piece) - tail :] == one[head + 1 :]:
        return piece, shared < len(earlier), head, len(piece) - tail, len(earlier) - shared
    return piece, shared < len(earlier), -1, -1, len(earlier) - shared


class _Turns:
    """Pieces of one conversation, turn after turn."""

    def __init__(self, template: Template, context: int | str | None):
        self.template, self.doubling = template, context == "doubling"
        self.seen: deque = deque(maxlen=1 if self.doubling else context)
        self.every: Messages = []
        self.out: list[tuple] = []
        self.position = 0
        self.empty = template([])
        self.place = len(self.empty)

    def add(self, turn: tuple[str, str]) -> None:
        piece, rewrites, a, b, undone = _locate(self.template, list(self.seen), turn)
        self.place -= undone
        self.out.append((self.position, *turn, piece, self.place, rewrites, a, b))
        self.seen.append(turn)
        self.place, self.position = self.place + len(piece), self.position + 1
        if self.doubling:
            self.every.append(turn)
            if self.position & (self.position - 1) == 0:
                self._compare()

    def _compare(self) -> None:
        """The whole prefix against the pieces so far; from a difference on, prefixes are rendered in full."""
        if not self.doubling:
            return
        pieces = "".join([self.empty, *(t[3] for t in self.out)])
        if pieces == self.template(self.every) and not any(t[5] for t in self.out):
            return
        full = _Turns(self.template, None)
        for turn in self.every:
            full.add(turn)
        self.seen, self.out, self.place, self.doubling = full.seen, full.out, full.place, False

    def take(self) -> list[tuple]:
        out, self.out = self.out, []
        return out

    def finish(self) -> list[tuple]:
        self._compare()
        return self.take()


TURNS = "position long, role string, text string, piece string, start long, rewrites boolean, text_start long, text_end long"


def format_turns(
    conversations: DataFrame,
    template: Template = turn_template,
    context: int | str | None = None,
    conv_id: str = "conv_id",
    turn: str = "turn",
    role: str = "role",
    text: str = "text",
) -> DataFrame:
    """Every turn, in order within its conversation, with the piece of output that it adds.

    ``start`` is the piece's place in the output, after a rewrite where the outputs part; ``text_start`` and ``text_end`` are the
    places of the escaped text in the piece. Conversations stay together and in order in
    the partitions of the result.
    """
    rows = conversations.select(
        F.col(conv_id).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = rows.schema["conv_id"].dataType.simpleString()

    if isinstance(context, str) and context != "doubling":
        raise ValueError(f"context must be a number, None or 'doubling', got {context}")
    whole = context == "doubling"
    names = ["position", "role", "text", "piece", "start", "rewrites", "text_start", "text_end"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, turns = object(), _Turns(template, context)
        kind_of_id = None

        def rows_of(conv: object, out: list[tuple]) -> pa.RecordBatch:
            columns = zip(*out, strict=True) if out else [[] for _ in names]
            return pa.RecordBatch.from_arrays(
                [pa.array([conv] * len(out), kind_of_id)] + [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["conv_id", *names]
            )

        for batch in batches:
            kind_of_id = batch.column(0).type
            ids, _, roles, texts = (c.to_pylist() for c in batch.columns)
            for conv, who, what in zip(ids, roles, texts, strict=True):
                if conv != current:
                    if turns.position:
                        yield rows_of(current, turns.finish())
                    current, turns = conv, _Turns(template, context)
                turns.add((who, what))
            if not whole:  # nothing given out is looked at again
                yield rows_of(current, turns.take())
        if turns.position:
            yield rows_of(current, turns.finish())

    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, f"conv_id {kind}, {TURNS}")


def digest_turns(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One row for each conversation, read back from the pieces of ``turn_template``.

    ``turns`` must be as ``format_turns`` leaves them: together and in order.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    rows = turns.select("conv_id", "piece", "text_start", "text_end")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def answer() -> pa.RecordBatch:
            values = [current, n, whole.hexdigest(), loss_chars, loss.hexdigest(), chars]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, kinds, strict=True)], names=names)

        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds: list[pa.DataType] = []
        current, n = None, 0
        for batch in batches:
            kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            for conv, piece, a, b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not n or conv != current:
                    if n:
                        yield answer()
                    current, n, loss_chars, chars = conv, 0, 0, 0
                    whole, loss = hashlib.sha256(), hashlib.sha256()
                role, text = read_turn(piece)
                whole.update(f"{role}\n{text}\n".encode())
                n, chars = n + 1, chars + len(piece)
                if role == loss_role:
                    under_mask = unescape(piece[a:b])
                    loss_chars += len(under_mask)
                    loss.update(under_mask.encode())
        if n:
            yield answer()

    return rows.mapInArrow(
        run, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
