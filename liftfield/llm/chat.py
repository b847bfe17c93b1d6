"""Chat formatting by a template that is a black box: turns in, one string out.

Successive prefixes of a conversation are rendered and consecutive outputs compared. Where the longer output begins with
the shorter one, the rest is the turn's span; where it doesn't, the template has rewritten history and the conversation is
marked so. Two one-letter probes in place of a turn's text show where the text itself stands in its span.

A conversation is rendered in blocks of turns, each led by the turn before it, so one that holds a large part of all rows
is spread over many tasks and no task holds more than a block. That suits templates whose output for a turn depends on
that turn and the one before (``lookback = 1``) or on that turn only (0); the block's own prefixes are compared with the
short rendering, and a difference counts as rewriting. A template that reads further back has ``lookback = None``: its
conversations are rendered whole.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from liftfield.llm.common import tasks

Turn = tuple[str, str]
#: Turn numbers of one block.
BLOCK = 32
#: Output rows of one Arrow batch, and characters after which a batch is sent on.
ROWS, CHARS = 1024, 4 << 20

# Control strings of the default template.
OPEN = {"system": "[SYS] ", "user": "[INST] ", "assistant": "<s>"}
CLOSE = {"system": " [/SYS]", "user": " [/INST]", "assistant": "</s>"}
OTHER_OPEN, OTHER_MIDDLE, OTHER_CLOSE = "[ROLE]", "[/ROLE]", "[END]"
CONTROL = r"(?:/?(?:INST\]|SYS\]|ROLE\]|s>)|END\])"
PLAIN, ESCAPED = re.compile(rf"([\[<])(\\*)(?={CONTROL})"), re.compile(rf"([\[<])\\(\\*)(?={CONTROL})")


def escape(text: str) -> str:
    """One more backslash after the bracket of whatever looks like a control string, escaped or not."""
    return PLAIN.sub(r"\1\\\2", text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1\2", text)


@dataclass(frozen=True)
class Template:
    """``render`` makes one string of (role, text) turns; a turn's output depends on ``lookback`` turns before it, or all (None)."""

    render: Callable[[list[Turn]], str]
    lookback: int | None = 1
    unescape: Callable[[str], str] = unescape


def render_turns(turns: list[Turn]) -> str:
    """Each turn between its role's control strings; other roles are written out."""
    out = []
    for role, text in turns:
        if role in OPEN:
            out.append(OPEN[role] + escape(text) + CLOSE[role])
        else:
            out.append(OTHER_OPEN + escape(role) + OTHER_MIDDLE + escape(text) + OTHER_CLOSE)
    return "".join(out)


TURN = re.compile("|".join(f"{re.escape(OPEN[r])}(?P<{r}>.*?){re.escape(CLOSE[r])}" for r in OPEN)
                  + f"|{re.escape(OTHER_OPEN)}(?P<role>.*?){re.escape(OTHER_MIDDLE)}(?P<text>.*?){re.escape(OTHER_CLOSE)}", re.S)


def read_turns(formatted: str) -> list[Turn]:
    """The turns of a formatted text again."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        if m.lastgroup == "text":
            turns.append((unescape(m["role"]), unescape(m["text"])))
        else:
            turns.append((m.lastgroup, unescape(m[m.lastgroup])))
        at = m.end()
    return turns


TAGGED = Template(render_turns, lookback=0)


@dataclass
class Span:
    """Where a turn stands in the formatted text, and its text within (both empty if that can't be told)."""

    start: int
    end: int
    text_start: int
    text_end: int


def text_within(render: Callable[[list[Turn]], str], before: list[Turn], role: str, shown: str, size: int) -> tuple[int, int]:
    """Start and end of the text in the output ``shown`` of a turn after ``size`` characters of earlier output."""
    a, b = (render([*before, (role, x)])[size:] for x in "ab")
    head = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), None)
    if head is None or len(a) != len(b) or a[head + 1 :] != b[head + 1 :]:
        return 0, 0
    tail = len(a) - head - 1
    if len(shown) < head + tail or shown[:head] != a[:head] or shown[len(shown) - tail :] != a[head + 1 :]:
        return 0, 0
    return head, len(shown) - tail


def render_block(template: Template, lead: list[Turn], turns: list[Turn], spoken: Callable[[str], bool]) -> tuple[str, list[Span], int | None]:
    """Formatted text of ``turns`` after ``lead``, each turn's span in it, and the first turn at which history was rewritten.

    Where history is rewritten, no earlier span can be trusted: the text is the last rendering and all spans are empty.
    """
    render, local = template.render, template.lookback
    before, shown, spans, broken = list(lead), render(lead) if lead else "", [], None
    base = len(shown)
    for k, (role, text) in enumerate(turns):
        now = render([*before, (role, text)])
        if broken is None and not now.startswith(shown):
            broken = k
        size = len(shown)
        if broken is None:
            part = now[size:]
            if local is not None and k:
                near = before[len(before) - local :] if local else []
                led = render(near) if near else ""
                if render([*near, (role, text)]) != led + part:
                    broken = k
            inside = text_within(render, before, role, part, size) if spoken(role) else (0, 0)
            spans.append(Span(size - base, len(now) - base, size - base + inside[0], size - base + inside[1]))
        before.append((role, text))
        shown = now
    if broken is not None:
        spans = [Span(0, 0, 0, 0)] * len(turns)
    return shown[base:], spans, broken


PIECE = ("conv_id bigint, block bigint, n_turns bigint, formatted string, rewritten bigint, "
         "spans array<struct<role: string, start: bigint, end: bigint, text_start: bigint, text_end: bigint>>")


def grouped(batches: Iterable[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, Iterator[dict]]]:
    """Rows of sorted batches by consecutive equal keys, read as they come."""
    rows = (r for b in batches for r in b.to_pylist())
    row = next(rows, None)
    while row is not None:
        key = tuple(row[k] for k in keys)

        def same() -> Iterator[dict]:
            nonlocal row
            while row is not None and tuple(row[k] for k in keys) == key:
                yield row
                row = next(rows, None)

        own = same()
        yield key, own
        for _ in own:
            pass


def batched(rows: Iterable[dict], schema: pa.Schema, weight: str | None = None) -> Iterator[pa.RecordBatch]:
    out, size = [], 0
    for r in rows:
        out.append(r)
        size += len(r[weight]) if weight else 0
        if len(out) >= ROWS or size >= CHARS:
            yield pa.RecordBatch.from_pylist(out, schema)
            out, size = [], 0
    yield pa.RecordBatch.from_pylist(out, schema)


def turns_of(conversations: DataFrame) -> DataFrame:
    return conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def format_conversations(conversations: DataFrame, template: Template = TAGGED, spoken: tuple[str, ...] = ("assistant",),
                         block: int = BLOCK) -> DataFrame:
    """Formatted pieces of each conversation: ``conv_id``, ``block``, ``n_turns``, ``formatted``, ``rewritten`` and ``spans``.

    A conversation's formatted text is its pieces' ``formatted`` joined in the order of ``block``; spans count characters
    from the piece's start, and ``text_start .. text_end`` is the loss mask of turns whose role is in ``spoken`` (escaped, as
    it stands in the text; empty for other roles). ``rewritten`` is the number within the piece of the turn at which the
    template changed earlier output, else null; such a piece has empty spans.

    Turns come by ``turn``, nulls first; those of one number by role and text, and repeated rows stay repeated. A null role
    or text is empty; the rows of a null ``conv_id`` form one conversation. A piece holds the turns of ``block`` numbers
    (a null number: its own piece), so many rows of one number make a long one. A single turn may be as long as a string
    can be. Other columns are not read; an empty table gives an empty one.
    """
    rows = turns_of(conversations)
    whole = template.lookback is None
    at = F.lit(0).cast("bigint") if whole else F.coalesce(F.floor(F.col("turn") / block), F.lit(-(1 << 62)))
    rows = rows.withColumn("block", at).withColumn("lead", F.lit(0))
    if template.lookback:
        # the last turn of each block leads the next one
        ends = rows.groupBy("conv_id", "block").agg(F.max(F.struct("turn", "role", "text")).alias("e"))
        after = F.lead("block").over(Window.partitionBy("conv_id").orderBy("block"))
        ends = ends.withColumn("next", after).where("next is not null")
        rows = rows.unionByName(ends.select("conv_id", "e.turn", "e.role", "e.text", F.col("next").alias("block"), F.lit(-1).alias("lead")))
    schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("rewritten", pa.int64()),
                        ("spans", pa.list_(pa.struct([("role", pa.string()), *((n, pa.int64()) for n in ("start", "end", "text_start", "text_end"))])))])

    def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
        for (conv, number), own in grouped(batches, "conv_id", "block"):
            lead, turns = [], []
            for r in own:
                (lead if r["lead"] else turns).append((r["role"], r["text"]))
            text, spans, broken = render_block(template, lead, turns, lambda role: role in spoken)
            yield {"conv_id": conv, "block": number, "n_turns": len(turns), "formatted": text, "rewritten": broken,
                   "spans": [vars(s) | {"role": t[0]} for s, t in zip(spans, turns, strict=True)]}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batched(pieces_of(batches), schema, "formatted")

    order = ("conv_id", "block", "lead", "turn", "role", "text")
    return rows.repartition(tasks(rows), "conv_id", "block").sortWithinPartitions(*order).mapInArrow(run, PIECE)


def read_back(pieces: DataFrame, template: Template = TAGGED, read: Callable[[str], list[Turn]] = read_turns) -> DataFrame:
    """What the formatted pieces say of each conversation: ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of
    each turn), ``loss_chars``, ``loss_sha256`` (all text under the loss mask, unescaped) and ``formatted_chars``.

    Pieces are parsed where they lie. Digests run over a conversation's pieces in order, one piece at a time.
    """
    parsed_schema = pa.schema([("conv_id", pa.int64()), ("block", pa.int64()), ("n", pa.int64()), ("said", pa.string()), ("loss", pa.string()), ("chars", pa.int64())])
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for r in (r for b in batches for r in b.to_pylist()):
                text, turns = r["formatted"], read(r["formatted"])
                loss = "".join(template.unescape(text[s["text_start"] : s["text_end"]]) for s in r["spans"])
                yield {"conv_id": r["conv_id"], "block": r["block"], "n": len(turns), "said": "".join(f"{a}\n{b}\n" for a, b in turns), "loss": loss, "chars": len(text)}

        yield from batched(rows(), parsed_schema, "said")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for (conv,), own in grouped(batches, "conv_id"):
                said, loss, n, shown, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
                for r in own:
                    said.update(r["said"].encode())
                    loss.update(r["loss"].encode())
                    n, shown, chars = n + r["n"], shown + r["chars"], chars + len(r["loss"])
                yield {"conv_id": conv, "n_turns": n, "turns_sha256": said.hexdigest(), "loss_chars": chars, "loss_sha256": loss.hexdigest(), "formatted_chars": shown}

        yield from batched(rows(), schema)

    parts = pieces.select("conv_id", "block", "formatted", "spans").mapInArrow(parse, "conv_id bigint, block bigint, n bigint, said string, loss string, chars bigint")
    return parts.repartition(tasks(parts), "conv_id").sortWithinPartitions("conv_id", "block").mapInArrow(
        digest, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint")
