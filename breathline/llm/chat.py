"""Chat formatting: conversations as training texts of limited length, with a loss mask.

A conversation becomes one or more windows of whole turns.  Each window begins with the conversation's system turn, repeats
some of the turns before its own ones as history, and then has as many new turns as its budget of tokens allows.  Every
turn is new in exactly one window, so a target, the text of an assistant turn, is under the loss mask exactly once; what is
repeated is masked.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from typing import Mapping

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow, texts
from .tokens import encoder

SYSTEM, ASSISTANT = "system", "assistant"


@dataclass(frozen=True)
class Template:
    """How turns are marked.

    ``marks`` gives what stands before and after a text, by role; a turn of another role stands between ``other``'s first
    two marks with its role, and before the third.  ``controls`` are the strings that a model's tokenizer reads as control
    tokens; no text may hold one, so a backslash goes after the first character of whatever looks like one, with any
    number of backslashes in that place already, and taking one backslash away again gives the text back.
    """

    begin: str = "<s>"
    marks: Mapping[str, tuple[str, str]] = field(
        default_factory=lambda: {
            "system": ("<<SYS>>\n", "\n<</SYS>>\n\n"),
            "user": ("[INST] ", " [/INST]"),
            "assistant": (" ", "</s>"),
        }
    )
    other: tuple[str, str, str] = ("<|role|>", "<|text|>", "<|end|>")
    controls: tuple[str, ...] = (
        *("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"),
        *("<|role|>", "<|text|>", "<|end|>"),
    )
    # tokens of a mark, and of the beginning
    mark_tokens: int = 1

    def __post_init__(self) -> None:
        closing = [c for _, c in self.marks.values()] + [*self.other[1:]]
        if any(not any(c in mark for c in self.controls) for mark in closing):
            raise ValueError("what ends a text must hold a control string")
        opening = [before for before, _ in self.marks.values()] + [self.other[0]]
        if any(i != j and a.startswith(b) for i, a in enumerate(opening) for j, b in enumerate(opening)):
            raise ValueError("a mark that opens a turn begins with another one")
        for one in self.controls:
            if len(one) < 2 or one[0] == "\\" or one[1] == "\\":
                raise ValueError(f"no room for a backslash in the control string {one!r}")
            for two in self.controls:
                if any(one[i:].startswith(two) or two.startswith(one[i:]) for i in range(1, len(one))):
                    raise ValueError(f"the control strings {one!r} and {two!r} overlap")

    @cached_property
    def _escape(self) -> re.Pattern:
        each = "|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in self.controls)
        return re.compile(f"(?:{each})")

    @cached_property
    def _unescape(self) -> re.Pattern:
        each = "|".join(f"{re.escape(c[0])}(?=\\\\+{re.escape(c[1:])})" for c in self.controls)
        return re.compile(f"({each})\\\\")

    def escape(self, text: str) -> str:
        return self._escape.sub(lambda m: m[0] + "\\", text)

    def unescape(self, text: str) -> str:
        return self._unescape.sub(lambda m: m[1], text)

    def turn(self, role: str, escaped: str) -> tuple[str, int]:
        """A marked turn, and where its text begins in it."""
        if role in self.marks:
            before, after = self.marks[role]
        else:
            opened, between, after = self.other
            before = f"{opened}{self.escape(role)}{between}"
        return before + escaped + after, len(before)

    def parse(self, formatted: str) -> list[tuple[str, str]]:
        """(role, text) of every turn of a formatted text; ``ValueError`` if it does not follow the template."""
        if not formatted.startswith(self.begin):
            raise ValueError("a formatted text has its own beginning")
        at, turns = len(self.begin), []
        opened, between, ended = self.other
        while at < len(formatted):
            for role, (before, after) in self.marks.items():
                if formatted.startswith(before, at):
                    at += len(before)
                    break
            else:
                if not formatted.startswith(opened, at):
                    raise ValueError(f"no turn begins at character {at}")
                stop = self._find(formatted, between, at + len(opened))
                role, after = self.unescape(formatted[at + len(opened) : stop]), ended
                at = stop + len(between)
            stop = self._find(formatted, after, at)
            turns.append((role, self.unescape(formatted[at:stop])))
            at = stop + len(after)
        return turns

    def _find(self, formatted: str, mark: str, at: int) -> int:
        """Where ``mark`` stands whose control string is the first one from ``at`` on."""
        control = next(c for c in self.controls if c in mark)
        inside = mark.index(control)
        stop = formatted.find(control, at + inside) - inside
        if stop < at or not formatted.startswith(mark, stop):
            raise ValueError(f"no end to the turn at character {at}")
        return stop


@dataclass(frozen=True)
class Limits:
    """``budget`` is the tokens of a window, ``history`` those of the turns it may repeat besides the system turn."""

    budget: int = 1024
    history: int = 256


@dataclass
class Turn:
    role: str
    text: str  # escaped
    tokens: int
    before: int  # tokens of all turns before


class Windows:
    """Cuts one conversation into windows, turn by turn, and holds no more than a window and its history."""

    def __init__(self, template: Template, limits: Limits):
        self.template, self.limits = template, limits
        self.system: Turn | None = None
        self.past: deque[Turn] = deque()
        self.repeated: list[Turn] = []
        self.fresh: list[Turn] = []
        self.used = 0
        self.count = 0

    def push(self, turn: Turn, first: bool) -> tuple | None:
        """Take a turn; the window that it closes, if any."""
        closed = None
        if self.fresh and self.used + turn.tokens > self.limits.budget:
            closed = self.finish()
        if not self.fresh:
            self._open(turn)
        if first and turn.role == SYSTEM:
            self.system = turn
        self.fresh.append(turn)
        self.used += turn.tokens
        return closed

    def _open(self, turn: Turn) -> None:
        self.repeated = [self.system] if self.system else []
        self.used = self.template.mark_tokens + sum(t.tokens for t in self.repeated)
        # as many of the turns just before as history allows, but never in the place of the new turn
        room = min(self.limits.history, self.limits.budget - self.used - turn.tokens)
        kept = [t for t in self.past if t is not self.system and turn.before - t.before <= room]
        if kept:
            self.repeated += kept
            self.used += turn.before - kept[0].before

    def finish(self) -> tuple:
        """The open window: (number, text, turns repeated, loss begins, loss ends, tokens)."""
        pieces, begins, ends, at = [self.template.begin], [], [], len(self.template.begin)
        for i, turn in enumerate([*self.repeated, *self.fresh]):
            piece, offset = self.template.turn(turn.role, turn.text)
            if i >= len(self.repeated) and turn.role == ASSISTANT:
                begins.append(at + offset)
                ends.append(at + offset + len(turn.text))
            pieces.append(piece)
            at += len(piece)
        window = (self.count, "".join(pieces), len(self.repeated), begins, ends, self.used)
        last = self.fresh[-1]
        for turn in self.fresh:
            if last.before + last.tokens - turn.before <= self.limits.history:
                self.past.append(turn)
        while self.past and last.before + last.tokens - self.past[0].before > self.limits.history:
            self.past.popleft()
        self.fresh, self.count = [], self.count + 1
        return window


WINDOWS = (
    "conv_id long, window long, text string, repeated long, loss_begins array<long>, loss_ends array<long>, n_tokens long"
)


def format_chats(
    turns: DataFrame, tokenizer: str, template: Template = Template(), limits: Limits = Limits(), by_chunk: bool = True
) -> DataFrame:
    """One row per window: its formatted ``text``, how many of its first turns are ``repeated`` (the system turn and
    history), where the text under the loss mask begins and ends (code points), and its tokens.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  A conversation's turns are taken by turn, nulls
    first, equal ones by role and text, repeated rows as often as they stand there; rows without ``conv_id`` make one
    conversation; a null role or text is empty.  A system turn is retained in all windows if it is the conversation's
    first turn; a later one is a turn like any other.  A turn longer than the budget is never cut: it is the only new turn
    of its window, without history, and ``n_tokens`` tells.  An empty table gives no windows.

    Turns are escaped and their tokens counted where they lie; sums of tokens before each turn, by a window function over
    the one shuffle that brings a conversation together, then choose the spans.  A conversation passes as a
    stream, so a task holds a window and its history, however long the conversation is.  The windows of a conversation
    come one after the other, in order, in one partition.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, by_chunk)
        for batch in batches:
            roles = batch.column("role").to_pylist()
            escaped = pa.array([template.escape(t) for t in batch.column("text").to_pylist()], pa.large_string())
            _, begins = encode.encode(texts(escaped))
            plain = [role in template.marks for role in roles]
            unmarked = pa.array(["" if p else r for p, r in zip(plain, roles)], pa.large_string())
            _, named = encode.encode(texts(unmarked))
            marks = [template.mark_tokens * (2 if p else 3) for p in plain]
            tokens = begins[1:] - begins[:-1] + named[1:] - named[:-1] + marks
            yield pa.RecordBatch.from_arrays(
                [batch.column("conv_id"), batch.column("turn"), batch.column("role"), escaped, pa.array(tokens, pa.int64())],
                names=["conv_id", "turn", "role", "text", "tokens"],
            )

    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")],
    )
    counted = map_arrow(given, count, "conv_id long, turn long, role string, text string, tokens long")
    order = "turn NULLS FIRST, role, text"
    over = f"(PARTITION BY conv_id ORDER BY {order} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    rows = (
        counted.repartition("conv_id")
        .withColumn("before", F.expr(f"sum(tokens) OVER {over} - tokens"))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "before")
        .select("conv_id", "role", "text", "tokens", "before")
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, windows, found, held = None, None, [], 0
        for batch in batches:
            for conv_id, *turn in zip(*(c.to_pylist() for c in batch.columns)):
                first = windows is None or conv_id != current
                if first:
                    if windows is not None:
                        found.append((current, *windows.finish()))
                    current, windows = conv_id, Windows(template, limits)
                closed = windows.push(Turn(*turn), first)
                if closed:
                    found.append((conv_id, *closed))
                held += len(turn[1])
                if held > 8 << 20:
                    yield _windows(found)
                    found, held = [], 0
        if windows is not None:
            found.append((current, *windows.finish()))
        yield _windows(found)

    return map_arrow(rows, cut, WINDOWS)


def _windows(found: list[tuple]) -> pa.RecordBatch:
    number, numbers = pa.int64(), pa.list_(pa.int64())
    types = (number, number, pa.large_string(), number, numbers, numbers, number)
    names = ["conv_id", "window", "text", "repeated", "loss_begins", "loss_ends", "n_tokens"]
    columns = zip(*found) if found else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_turns(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """The turns back from the windows, in their order: ``conv_id, window, role, text``, every turn once."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for conv_id, window, text, repeated in zip(
                *(batch.column(c).to_pylist() for c in ("conv_id", "window", "text", "repeated"))
            ):
                rows += [(conv_id, window, *turn) for turn in template.parse(text)[repeated:]]
            columns = zip(*rows) if rows else [()] * 4
            types = (pa.int64(), pa.int64(), pa.large_string(), pa.large_string())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, types)], names=["conv_id", "window", "role", "text"]
            )

    return map_arrow(windows, read, "conv_id long, window long, role string, text string")


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def summarise(windows: DataFrame, template: Template = Template()) -> DataFrame:
    """One row per conversation from its windows, which must come as :func:`format_chats` gives them: turns and their
    digest (role and text, a line each), code points under the loss mask, unescaped, and their digest, and code points of
    all formatted texts.  Nothing moves: each task folds the conversations it has, a window at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [c.split()[0] for c in SUMMARY.split(", ")]
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        done: list[tuple] = []
        current, fold = None, None

        def close() -> None:
            n, turns, chars, loss, total = fold
            done.append((current, n, turns.hexdigest(), chars, loss.hexdigest(), total))

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else [()] * len(types)
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("conv_id", "text", "repeated", "loss_begins", "loss_ends"))
            for conv_id, text, repeated, begins, ends in zip(*columns):
                if fold is None or conv_id != current:
                    if fold is not None:
                        close()
                    current, fold = conv_id, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in template.parse(text)[repeated:]:
                    fold[0] += 1
                    fold[1].update(f"{role}\n{said}\n".encode())
                for a, b in zip(begins, ends):
                    target = template.unescape(text[a:b])
                    fold[2] += len(target)
                    fold[3].update(target.encode())
                fold[4] += len(text)
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if fold is not None:
            close()
        yield batch_of(done)

    return map_arrow(windows, run, SUMMARY)
