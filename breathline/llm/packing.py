"""Best-fit packing of documents into training sequences by the sum-of-squares rule."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import new_path
from .text import map_arrow, texts
from .tokens import encoder

PIECES = "doc_id long, piece int, start long, length long, ids binary, sequence_id long, offset long"
# Sequence ids: the task above these bits, the task's own number below.
_TASK_SHIFT = 36
# Those of sequences packed from what tasks have left over.
_AGAIN = 1 << 61


class SumOfSquares:
    """Open bins, known by the gap each has left.

    An item goes where the sum, over all gaps, of the squared number of open bins with that gap becomes smallest; among
    equals into the smallest gap that holds it, and into a new bin only if that is better.  Full bins count as closed.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.count = np.zeros(capacity + 1, np.int64)
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.used = 0

    def place(self, size: int) -> tuple[int, int]:
        """The bin and the offset in it."""
        capacity, count = self.capacity, self.count
        # change of the sum if a bin moves from gap g to gap g - size: 2 N(g - size) + 1 - (2 N(g) - 1)
        left = 2 * count[: capacity - size + 1] + 1
        left[0] = 0
        change = left[:-1] - 2 * count[size:capacity] + 1
        change[count[size:capacity] == 0] = np.iinfo(np.int64).max
        best = int(np.argmin(change)) if len(change) else -1
        if best >= 0 and change[best] <= left[-1]:
            gap = size + best
            chosen = self.bins[gap].pop()
            count[gap] -= 1
        else:
            gap, chosen = capacity, self.used
            self.used += 1
        rest = gap - size
        if rest:
            self.bins[rest].append(chosen)
            count[rest] += 1
        return chosen, capacity - gap


class Held:
    """Pieces by the bin they are in, until their bin is full."""

    def __init__(self, capacity: int):
        self.rule, self.capacity = SumOfSquares(capacity), capacity
        self.rows: dict[int, list[tuple]] = {}

    def place(self, length: int, row: tuple) -> list[tuple]:
        """Place a piece; the rows of its bin, each with bin and offset, if that is full now."""
        bin_, offset = self.rule.place(length)
        self.rows.setdefault(bin_, []).append((*row, bin_, offset))
        return self.rows.pop(bin_) if offset + length == self.capacity else []

    def open(self) -> list[tuple]:
        return [row for rows in self.rows.values() for row in rows]


COLUMNS = [c.split()[0] for c in PIECES.split(", ")]
_PLACED = f"{PIECES}, open boolean, number long"


def _placed(rows: list[tuple], first: int, is_open: bool) -> pa.RecordBatch:
    """Rows of (doc_id, piece, start, length, ids, number, bin, offset)."""
    doc_id, piece, start, length, ids, number, bin_, offset = zip(*rows) if rows else [()] * 8
    numbers = (pa.array(c, pa.int64()) for c in (doc_id, piece, start, length))
    sequence = pa.array([first + b for b in bin_], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            *numbers,
            pa.array(ids, pa.large_binary()),
            sequence,
            pa.array(offset, pa.int64()),
            pa.array([is_open] * len(rows), pa.bool_()),
            pa.array([first + n for n in number], pa.int64()),
        ],
        names=[c.split()[0] for c in _PLACED.split(", ")],
    )


def pack(
    docs: DataFrame, tokenizer: str, end_id: int, capacity: int = 2048, by_chunk: bool = True, group_pieces: int = 200_000
) -> DataFrame:
    """Cut every document into pieces and pack them: one row per piece, with its ``ids`` (little-endian, 32 bits), the
    sequence it is in and its ``offset`` there.

    A document is its token ids, then ``end_id``; only one longer than ``capacity`` is cut, each piece but the last being
    full.  Sequences have no gaps and hold at most ``capacity`` ids.  Rows with the same id are separate documents; a null
    text is an empty one.

    First each task packs the documents of its own input split, an Arrow batch at a time and in it the longest first, and
    holds back only the pieces of bins that are not full.  Everything is written to shared storage.  Then the pieces of
    bins left open, a small share of a split of ordinary size, are packed anew, together with those of other splits,
    in groups of about ``group_pieces``: only their numbers and lengths are shuffled for this.  So what is lost does not
    grow with the number of splits, and no text or token is shuffled but those of open bins.  A split, or a group, that
    runs again gives the same rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, held, number = encoder(tokenizer, by_chunk), Held(capacity), 0
        first = TaskContext.get().partitionId() << _TASK_SHIFT
        for batch in batches:
            ids, begins = encode.encode(texts(batch.column("text")))
            n = len(begins) - 1
            ids = np.insert(ids, begins[1:], end_id).astype("<u4")
            begins = begins + np.arange(n + 1)
            sizes = np.diff(begins)
            pieces = -(-sizes // capacity)
            document = np.repeat(np.arange(n), pieces)
            piece = np.arange(len(document)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = piece * capacity
            length = np.minimum(sizes[document] - start, capacity)
            at = 4 * (begins[document] + start)
            data, doc_id = ids.tobytes(), batch.column("doc_id").take(pa.array(document)).to_pylist()
            full: list[tuple] = []
            for i in np.argsort(-length, kind="stable").tolist():
                a, size = int(at[i]), int(length[i])
                row = (doc_id[i], int(piece[i]), int(start[i]), size, data[a : a + 4 * size], number)
                full += held.place(size, row)
                number += 1
                if len(full) >= 2_000:
                    yield _placed(full, first, False)
                    full = []
            yield _placed(full, first, False)
        yield _placed(held.open(), first, True)

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    spark, path = docs.sparkSession, new_path(docs.sparkSession)
    placed = map_arrow(given, run, _PLACED)
    placed.write.partitionBy("open").parquet(path)
    kept = spark.read.schema(placed.schema).parquet(path)
    left = kept.where("open")
    groups = left.count() // group_pieces + 1
    again = left.drop("sequence_id", "offset").join(_packed_again(left, capacity, groups), "number")
    return kept.where("NOT open").select(*COLUMNS).unionByName(again.select(*COLUMNS))


def _packed_again(pieces: DataFrame, capacity: int, groups: int) -> DataFrame:
    """``number``, ``sequence_id`` and ``offset`` of pieces known by number and length, packed group by group, longest
    first."""
    rows = (
        pieces.select("number", "length", F.expr(f"pmod(xxhash64(number), {groups})").alias("group"))
        .repartition(groups, "group")
        .sortWithinPartitions("group", F.desc("length"), "number")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, rule = None, None
        for batch in batches:
            sequence, offset = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for i, (length, group) in enumerate(zip(batch.column("length").to_pylist(), batch.column("group").to_pylist())):
                if group != current:
                    current, rule = group, SumOfSquares(capacity)
                bin_, offset[i] = rule.place(length)
                sequence[i] = _AGAIN + (group << _TASK_SHIFT) + bin_
            yield pa.RecordBatch.from_arrays(
                [batch.column("number"), pa.array(sequence), pa.array(offset)], names=["number", "sequence_id", "offset"]
            )

    return map_arrow(rows, run, "number long, sequence_id long, offset long")
