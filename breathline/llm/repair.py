"""Repair of conversations that break the role grammar, by generalised LR parsing with weighted edits.

The grammar is over the roles' initials: an optional system turn, then user and assistant turns by pairs.  Every row of a
conversation is kept, given another role, or deleted, and empty turns may be inserted anywhere; each edit has a cost, and
the cheapest edits that make the roles a sentence of the grammar are taken.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import map_arrow

# The role grammar as productions, and the roles that an edit may give.
GRAMMAR = (
    ("conversation", ()),
    ("conversation", ("turns",)),
    ("conversation", ("s", "turns")),
    ("turns", ("u", "a")),
    ("turns", ("turns", "u", "a")),
)
GIVEN = {"u": "user", "a": "assistant"}
KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"


@dataclass(frozen=True)
class Costs:
    """What edits cost.  ``truncated`` is added for a truncated row that is not deleted."""

    rerole: int = 2
    delete: int = 3
    insert: int = 2
    truncated: int = 1


class Automaton:
    """LR(0) item sets of a grammar, as shift and goto moves and the productions each state completes.

    Reductions are made as soon as a state has nothing else to do, so that the states between rows wait for a row or the
    end.  ``move`` gives the stack after one symbol.  Tops that are equal expect the same, whatever lies below.
    """

    def __init__(self, productions=GRAMMAR):
        self.productions = (("start", (productions[0][0],)), *productions)
        self.heads = {head for head, _ in self.productions}
        self.sets: list[frozenset] = [self._closed({(0, 0)})]
        self.goto: list[dict[str, int]] = []
        while len(self.goto) < len(self.sets):
            moved: dict[str, set] = {}
            for p, dot in self.sets[len(self.goto)]:
                if dot < len(self.productions[p][1]):
                    moved.setdefault(self.productions[p][1][dot], set()).add((p, dot + 1))
            row = {}
            for symbol in sorted(moved):
                items = self._closed(moved[symbol])
                if items not in self.sets:
                    self.sets.append(items)
                row[symbol] = self.sets.index(items)
            self.goto.append(row)
        self.complete = [[p for p, dot in s if dot == len(self.productions[p][1])] for s in self.sets]
        self.eager = [len(done) == 1 and len(s) == 1 for done, s in zip(self.complete, self.sets)]

    def _closed(self, items: set) -> frozenset:
        items = set(items)
        while True:
            wanted = {self.productions[p][1][dot] for p, dot in items if dot < len(self.productions[p][1])}
            more = {(i, 0) for i, (head, _) in enumerate(self.productions) if head in wanted} - items
            if not more:
                return frozenset(items)
            items |= more

    def move(self, stack: tuple, symbol: str) -> tuple | None:
        """``stack`` is (state, rest of the stack); shared between all that grew from it."""
        target = self.goto[stack[0]].get(symbol)
        if target is None or symbol in self.heads:
            return None
        stack = (target, stack)
        while self.eager[stack[0]]:
            head, body = self.productions[self.complete[stack[0]][0]]
            for _ in body:
                stack = stack[1]
            stack = (self.goto[stack[0]][head], stack)
        return stack

    def accepts(self, stack: tuple) -> bool:
        """Whether the input may end here: the reductions left lead to the start symbol."""
        while True:
            done = [p for p in self.complete[stack[0]]]
            if 0 in done:
                return True
            if not done:
                return False
            head, body = self.productions[done[0]]
            for _ in body:
                stack = stack[1]
            stack = (self.goto[stack[0]][head], stack)


class Repairer:
    """Parses one conversation row by row, all stacks side by side.

    The frontier has one stack for each top, the one with the smallest (cost, audit); an audit is the edits' initials.
    Merging is safe: equal tops expect the same, and of two audits of equal cost neither begins with the other, since
    what they differ by would have to be insertions, which cost.

    A stack that costs more than another by over ``slack`` goes: whatever may follow it may follow the other one as well, at
    the price of deleting a system turn, and of inserting a turn before it or a pair at the end.  Edits that all stacks
    agree on are decided and leave the frontier, so what it holds does not grow with the conversation.
    """

    def __init__(self, automaton: Automaton, costs: Costs):
        self.automaton, self.costs = automaton, costs
        self.slack = costs.delete + 2 * costs.insert
        # top state -> (cost, audit since the decided edits, stack)
        self.frontier: dict[int, tuple[int, str, tuple]] = {}
        self._offer(self.frontier, 0, "", (0, None))
        self._insert(self.frontier)
        self.pending: list = []
        self.stack = (0, None)

    @staticmethod
    def _offer(frontier: dict, cost: int, audit: str, stack: tuple | None) -> bool:
        if stack is None:
            return False
        best = frontier.get(stack[0])
        if best is not None and (best[0], best[1]) <= (cost, audit):
            return False
        frontier[stack[0]] = (cost, audit, stack)
        return True

    def _insert(self, frontier: dict) -> None:
        """Insertions until none is an improvement; every one costs, so this ends."""
        fresh = list(frontier)
        while fresh:
            cost, audit, stack = frontier[fresh.pop()]
            for symbol in GIVEN:
                after = self.automaton.move(stack, symbol)
                if self._offer(frontier, cost + self.costs.insert, audit + INSERT, after):
                    fresh.append(after[0])

    def push(self, row, initial: str, unwanted: bool, truncated: bool) -> list[tuple]:
        """Take one row, whatever it is, and return the edits decided now: (edit, row or None, symbol or None)."""
        move, costs, frontier = self.automaton.move, self.costs, {}
        extra = costs.truncated if truncated else 0
        for cost, audit, stack in self.frontier.values():
            self._offer(frontier, cost + costs.delete, audit + DELETE, stack)
            if not unwanted:
                self._offer(frontier, cost + extra, audit + KEEP, move(stack, initial))
                for symbol in GIVEN:
                    self._offer(frontier, cost + costs.rerole + extra, audit + REROLE, move(stack, symbol))
        self._insert(frontier)
        least = min(cost for cost, _, _ in frontier.values()) + self.slack
        self.frontier = frontier = {top: found for top, found in frontier.items() if found[0] <= least}
        self.pending.append((row, initial))
        agreed = commonprefix([audit for _, audit, _ in frontier.values()])
        if not agreed:
            return []
        self.frontier = {top: (cost, audit[len(agreed) :], stack) for top, (cost, audit, stack) in frontier.items()}
        return self._decided(agreed)

    def finish(self) -> list[tuple]:
        ends = [(cost, audit) for cost, audit, stack in self.frontier.values() if self.automaton.accepts(stack)]
        return self._decided(min(ends)[1])

    def _decided(self, audit: str) -> list[tuple]:
        """An audit and the stack before it settle which role every edit gives."""
        out, taken = [], 0
        for edit in audit:
            row = symbol = None
            if edit != INSERT:
                row, symbol = self.pending[taken]
                taken += 1
            if edit in (REROLE, INSERT):
                symbol = next(s for s in GIVEN if self.automaton.move(self.stack, s) is not None)
            if edit == DELETE:
                symbol = None
            else:
                self.stack = self.automaton.move(self.stack, symbol)
            out.append((edit, row, symbol))
        del self.pending[:taken]
        return out


BLANK, DUPLICATE, TRUNCATED = "blank", "duplicate", "truncated"
EDITS = (
    "conv_id long, turn long, old_role string, fault string, edit string, role string, text string, cost int"
)


def fault(duplicate: Column) -> Column:
    """The first fault of a row; null for none."""
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    whole = F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    return F.when(blank, BLANK).when(duplicate, DUPLICATE).when(~whole, TRUNCATED)


def repair_conversations(turns: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """The cheapest edits of every conversation, one row per edit.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored.  Rows of a conversation are taken by turn, nulls
    first, equal turns by role and text; rows without ``conv_id`` make one conversation; a null role or text is one space.
    A row is blank (nothing but white space), a duplicate (role and text of an earlier row of the conversation) or
    truncated (its last character that is not white space ends no sentence); the first of these counts, and blank and
    duplicate rows are always deleted.  Of several cheapest repairs the one whose edits' initials (D, I, K, R) sort first
    is taken.  An empty table gives no rows.

    Result, for every edit: the row's ``turn, old_role, fault`` (null for an insertion), ``edit`` as an initial, the turn's
    ``role`` and ``text`` after the repair (a deleted row's are as they were), and ``cost``.  The rows of a conversation
    come one after the other, in order, in one partition.

    One shuffle brings a conversation together.  Sorting, and finding duplicates, is left to Spark, which spills; the parser
    sees each row once and holds only rows whose edit is open.
    """
    given = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"),
    ).repartition("conv_id")
    seen = "row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1"
    # of equal rows, the one that is no duplicate comes first
    rows = (
        given.withColumn("again", F.expr(seen))
        .sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "again")
        .select("conv_id", "turn", "role", "text", fault(F.col("again")).alias("fault"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton()
        parser, current, found, held = None, None, [], 0

        def noted(conv_id, edits) -> int:
            size = 0
            for edit, row, symbol in edits:
                if row is None:
                    found.append((conv_id, None, None, None, edit, GIVEN[symbol], "", costs.insert))
                    continue
                turn, role, text, wrong = row
                cost = {KEEP: 0, REROLE: costs.rerole, DELETE: costs.delete}[edit]
                if wrong == TRUNCATED and edit != DELETE:
                    cost += costs.truncated
                given = GIVEN[symbol] if edit == REROLE else role
                found.append((conv_id, turn, role, wrong, edit, given, text, cost))
                size += len(text)
            return size

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault")]
            for conv_id, turn, role, text, wrong in zip(*columns):
                if parser is None or conv_id != current:
                    if parser is not None:
                        held += noted(current, parser.finish())
                    parser, current = Repairer(automaton, costs), conv_id
                edits = parser.push((turn, role, text, wrong), role[:1], wrong in (BLANK, DUPLICATE), wrong == TRUNCATED)
                held += noted(conv_id, edits)
                if held > 4 << 20 or len(found) > 20_000:
                    yield _table(found)
                    found, held = [], 0
        if parser is not None:
            noted(current, parser.finish())
        yield _table(found)

    return map_arrow(rows, run, EDITS)


def _table(found: list[tuple]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), *[pa.large_string()] * 5, pa.int64())
    names = [c.split()[0] for c in EDITS.split(", ")]
    columns = zip(*found) if found else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


SUMMARY = (
    "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string,"
    " repaired_sha256 string"
)
# Pairs of neighbours' initials that a conversation may have.
LEGAL = ("su", "ua", "au")


def summarise(edits: DataFrame) -> DataFrame:
    """One row per conversation from its edits, which must come as :func:`repair_conversations` gives them: faults counted,
    missing turn numbers (``gaps``), neighbours that may not follow each other before the repair (``illegal``), the
    ``cost`` and ``audit`` of the repair, and the SHA-256 of the repaired ``role:text``, newline-joined.

    Nothing moves: each task folds the conversations it has, a row at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        names = [c.split()[0] for c in SUMMARY.split(", ")]
        done: list[tuple] = []
        current, fold = None, None

        def close() -> None:
            low, high, distinct = fold["low"], fold["high"], fold["distinct"]
            gaps = 0 if low is None else high - low + 1 - distinct
            counts = [fold[k] for k in (BLANK, DUPLICATE, TRUNCATED, "illegal", "cost")]
            done.append((current, gaps, *counts, "".join(fold["audit"]), fold["sha"].hexdigest()))

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "turn", "old_role", "fault", "edit", "role", "text", "cost")]
            for conv_id, turn, old, wrong, edit, role, text, cost in zip(*columns):
                if fold is None or conv_id != current:
                    if fold is not None:
                        close()
                    current = conv_id
                    fold = {BLANK: 0, DUPLICATE: 0, TRUNCATED: 0, "illegal": 0, "cost": 0, "audit": [], "before": None}
                    fold |= {"low": None, "high": None, "distinct": 0, "sha": hashlib.sha256(), "begun": False}
                fold["audit"].append(edit)
                fold["cost"] += cost
                if edit != INSERT:
                    if wrong:
                        fold[wrong] += 1
                    if fold["before"] is not None:
                        fold["illegal"] += fold["before"] + old[:1] not in LEGAL
                    fold["before"] = old[:1]
                    if turn is not None and turn != fold["high"]:
                        fold["distinct"] += 1
                        fold["low"] = turn if fold["low"] is None else fold["low"]
                        fold["high"] = turn
                if edit != DELETE:
                    fold["sha"].update(f"\n{role}:{text}".encode() if fold["begun"] else f"{role}:{text}".encode())
                    fold["begun"] = True
            if len(done) > 5_000:
                yield _columns(done, names)
                done = []
        if fold is not None:
            close()
        yield _columns(done, names)

    return map_arrow(edits, run, SUMMARY)


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    types = [*[pa.int64()] * 7, pa.large_string(), pa.large_string()]
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)
