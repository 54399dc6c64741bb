"""Chat formatting by incremental black-box rendering.

A template is any function from a list of turns to a string.  It is called with one turn more each time; where the new output begins with the one
before it, the rest is the new turn's span.  Otherwise the template rewrites history: the turn is flagged, and its span starts where the outputs
part.  A further call with a probe in place of the turn's text shows where the text stands inside the span.

Prefixes are rendered from the first turn on, so a task holds a conversation.  Only templates declared by ``one_back``, whose output for a turn depends on the
turn before it at most (and on being the first), are rendered in segments of ``SEGMENT`` turns, each with the last turn before it as context; a task holds a segment.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Turn(NamedTuple):
    role: str
    text: str


class Span(NamedTuple):
    """Places in the formatted text; ``text_start`` is -1 where the text can't be located.

    ``rewrites``: with this turn the template changed what it had written before; ``rewritten``: a later turn changed this one's part, whose span then ends with its text in the final output, and
    begins there too unless what stands before it is unchanged; -1 where it can't be told.
    """

    start: int
    end: int
    text_start: int
    text_end: int
    rewrites: bool
    rewritten: bool = False


Template = Callable[[list[Turn]], str]
SEGMENT = 32
PROBE = "\ue000"
# Control strings of the template below.
CONTROL = ("[INST]", "[/INST]", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "<|", "|>")
WRAP = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}


def escape(text: str) -> str:
    """Backslashes are doubled, and one is put after the first character of each control string."""
    text = text.replace("\\", "\\\\")
    for c in CONTROL:
        text = text.replace(c, c[0] + "\\" + c[1:])
    return text


def unescape(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def one_back(template: Template) -> Template:
    """Declares that ``template`` looks one turn back at most and rewrites no turn before that."""
    template.one_back = True
    return template


@one_back
def marked(turns: list[Turn]) -> str:
    """The template of this library: control strings mark turns and never occur in escaped texts."""
    out = []
    for t in turns:
        left, right = WRAP.get(t.role) or (f"<|{escape(t.role)}|>", "<|end|>")
        out.append(left + escape(t.text) + right)
    return "".join(out)


def parse_turn(piece: str) -> tuple[str, str]:
    """(role, text) of a turn as ``marked`` writes it."""
    for role, (left, right) in WRAP.items():
        if piece.startswith(left) and piece.endswith(right):
            return role, unescape(piece[len(left) : len(piece) - len(right)])
    if not piece.startswith("<|") or not piece.endswith("<|end|>"):
        raise ValueError("not a turn")
    role, _, rest = piece[2:].partition("|>")
    return unescape(role), unescape(rest[: -len("<|end|>")])


def _common(a: str, b: str) -> int:
    """Length of the common beginning."""
    lo, hi = 0, min(len(a), len(b))
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[lo:mid] == b[lo:mid] else (lo, mid - 1)
    return lo


def _located(after: str, probe: str, start: int = 0) -> tuple[int, int]:
    """Where ``after`` has what ``probe``, the output with a probe for a text, has the probe for; -1 if that can't be told."""
    at = probe.find(PROBE, start)
    if at >= 0 and probe.find(PROBE, at + 1) < 0 and len(after) >= len(probe) - 1 and after.startswith(probe[:at]) and after.endswith(probe[at + 1 :]):
        return at, len(after) - (len(probe) - at - 1)
    return -1, -1


def spans(turns: list[Turn], template: Template = marked, context: list[Turn] | None = None) -> tuple[str, list[Span]]:
    """The formatted text of ``turns`` after ``context``, and each turn's span in it.

    Where a turn rewrites history, all turns are located again in the final output, by one more call with a probe for each: also an output that begins as the one before may do so by chance.
    """
    context = list(context or [])
    base = before = template(context)
    found: list[Span] = []
    for k, turn in enumerate(turns):
        so_far = [*context, *turns[:k]]
        after = template([*so_far, turn])
        rewrites = not after.startswith(before)
        start = _common(before, after) if rewrites else len(before)
        if rewrites:
            found = [s._replace(rewritten=True, start=s.start if s.start <= start else -1) if s.end > start else s for s in found]
        probe = template([*so_far, Turn(turn.role, PROBE)])
        found.append(Span(start, len(after), *_located(after, probe, start if after.startswith(probe[:start]) else 0), rewrites))
        before = after
    if any(s.rewrites for s in found):
        for k, s in enumerate(found):
            place = _located(before, template([*context, *turns[:k], Turn(turns[k].role, PROBE), *turns[k + 1 :]]))
            if s.rewritten or place != (s.text_start, s.text_end):
                begin = s.start if s.rewritten and 0 <= s.start <= place[0] else place[0]  # what stands before it is as it was
                found[k] = s._replace(start=begin, end=place[1], text_start=place[0], text_end=place[1], rewritten=True)
    cut = len(base) if before.startswith(base) else 0
    move = lambda x: max(0, x - cut) if x >= 0 else x
    return before[cut:], [s._replace(start=move(s.start), end=move(s.end), text_start=move(s.text_start), text_end=move(s.text_end)) for s in found]


_SPAN = pa.struct([("turn", pa.int64()), ("role", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text_start", pa.int64()), ("text_end", pa.int64()), ("loss", pa.bool_()), ("rewrites", pa.bool_()), ("rewritten", pa.bool_())])
_SCHEMA = "_id long, segment long, formatted string, spans array<struct<turn:long,role:string,start:long,end:long,text_start:long,text_end:long,loss:boolean,rewrites:boolean,rewritten:boolean>>"
_NEW = object()


def _format(template: Template, segment: int | None, loss: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: object = _NEW
        numbers: list = []
        turns: list[Turn] = []
        context: list[Turn] = []
        part = 0

        def row() -> dict:
            text, found = spans(turns, template, context)
            marks = [{"turn": n, "role": t.role, "loss": t.role in loss, **s._asdict()} for n, t, s in zip(numbers, turns, found)]
            return {"_id": now, "segment": part, "formatted": text, "spans": marks}

        def packed(rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(("_id", "segment", "formatted", "spans"), (pa.int64(), pa.int64(), pa.string(), pa.list_(_SPAN)))], names=["_id", "segment", "formatted", "spans"])

        for batch in batches:
            out = []
            for conv, n, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if conv != now or len(turns) == segment:
                    if turns:
                        out.append(row())
                    context, part = ([], 0) if conv != now else ([turns[-1]], part + 1)
                    now, turns, numbers = conv, [], []
                turns.append(Turn(role or "", text or ""))
                numbers.append(n)
            if out:
                yield packed(out)
        if turns:
            yield packed([row()])

    return run


def format_chats(turns: DataFrame, template: Template = marked, segment: int = SEGMENT, loss: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id long, segment long, formatted string, spans array), a row per segment, in order inside each partition.

    A conversation is one segment, unless ``template`` is declared by ``one_back``: then ``segment`` turns are.

    ``turns`` has conv_id, turn, role and text.  A conversation's turns are taken in the order of turn (null first), role and text, and none is dropped, repeated ones
    included; null roles and texts count as empty; rows whose conv_id is null are one conversation.  Each span has its place in the segment's formatted text, and that of
    the turn's own text; ``loss`` tells whether its role is learnt.  Other columns are not read.  Equal conversations need one ordered pass each: a
    conversation's rows meet in one task, which sorts them on disk and holds one segment.
    """
    at_once = segment if getattr(template, "one_back", False) else None
    src = turns.select(F.col("conv_id").cast("long").alias("_id"), F.col("turn").cast("long").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = src.repartition("_id").sortWithinPartitions("_id", "n", "role", "text")
    return dealt.mapInArrow(_format(template, at_once, frozenset(loss)), _SCHEMA).withColumnRenamed("_id", "conv_id")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Read segments back: everything comes from the formatted text and its spans."""
    now: object = _NEW
    state: list = []

    def row() -> tuple:
        n, all_, loss_n, loss, chars = state
        return now, n, all_.hexdigest(), loss_n, loss.hexdigest(), chars

    def packed(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    for batch in batches:
        out = []
        for conv, text, marks in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
            if conv != now:
                if now is not _NEW:
                    out.append(row())
                now, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
            state[4] += len(text)
            for m in marks:
                role, said = parse_turn(text[m["start"] : m["end"]])
                state[0] += 1
                state[1].update(f"{role}\n{said}\n".encode())
                if m["loss"]:
                    learnt = unescape(text[m["text_start"] : m["text_end"]])
                    state[2] += len(learnt)
                    state[3].update(learnt.encode())
        if out:
            yield packed(out)
    if now is not _NEW:
        yield packed([row()])


def digests(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars) of each conversation, from the rows of ``format_chats`` in their order."""
    return formatted.mapInArrow(_digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
