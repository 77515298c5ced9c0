"""Words of Arrow text columns, and identities of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

# The separators of "words" in the two readings that the operators use.
WHITE_SPACE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _table(keep: Callable[[int], bool]) -> bytes:
    """Bytes to bytes: A-Z lower-cased, and a space for what is not kept.  Bytes of longer characters are above 0x7F."""
    lower = bytes(range(256)).translate(bytes.maketrans(UPPER.encode(), LOWER.encode()))
    return bytes(b if keep(b) else 0x20 for b in lower)


LOWER_CASE = _table(lambda b: True)
# a-z, digits and everything beyond ASCII
LOWER_ALNUM = _table(lambda b: b > 0x7F or chr(b).isalnum())


def texts(column: pa.Array | pa.ChunkedArray) -> pa.LargeStringArray:
    """A text column without nulls, in one piece."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string())
    return column.fill_null("") if column.null_count else column


def mapped(column: pa.LargeStringArray, table: bytes) -> pa.LargeStringArray:
    """Each byte replaced by the table's; lengths stay."""
    if not len(column):
        return column
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = (column.buffers()[2] or pa.py_buffer(b""))[offsets[0] : offsets[-1]].to_pybytes().translate(table)
    return pa.LargeStringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(data))


def slices(column: pa.LargeStringArray, limit: int = 4 << 20) -> Iterator[pa.LargeStringArray]:
    """Stretches of a column of about ``limit`` bytes, each at least one text.

    What is worked out per character or word takes many times the space of a text, so it is done for some texts at a time.
    """
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + limit, side="right")) - 1)
        yield column.slice(begin, end - begin)
        begin = end


def words(column: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray]:
    """All words between ASCII white space, one text after the other, and where each text's begin (one more at the end)."""
    lists = pc.ascii_split_whitespace(column)
    flat = lists.flatten()
    full = pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0
    before = np.concatenate([[0], np.cumsum(full)])
    begins = lists.offsets.to_numpy() - (lists.offsets[0].as_py() if len(lists.offsets) else 0)
    return (flat if full.all() else flat.filter(pa.array(full))), before[begins]


def gathered(values: np.ndarray, begins: np.ndarray, lengths: np.ndarray, picks: np.ndarray) -> np.ndarray:
    """``values`` holds runs; the picked runs, one after the other."""
    sizes = lengths[picks]
    ends = np.cumsum(sizes)
    return values[np.arange(ends[-1] if len(ends) else 0) + np.repeat(begins[picks] - (ends - sizes), sizes)]


def row_key(*columns: str) -> Column:
    """128 bits that identify a row's content, also without a usable id.  Equal rows have equal keys."""
    named = [F.col(f"`{c}`") for c in columns]
    flags = F.concat(*[F.when(c.isNull(), "0").otherwise("1") for c in named])
    return F.struct(F.xxhash64(*named, flags).alias("a"), F.xxhash64(F.lit("b"), *named, flags).alias("b"))


def keyed(docs: DataFrame, *columns: str) -> DataFrame:
    """``doc``, the whole row whatever its columns are called, and its content key as ``a`` and ``b``."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")
    return docs.select(whole, row_key(*columns).alias("key")).select("doc", "key.a", "key.b")


def id_remainder(column: str, divisor: int) -> Column:
    """Remainder of the crc32 of an id as text, which splits rows at random but fixedly; a null id is an empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % divisor


def map_arrow(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with columns cast to what the schema says.

    The function is unpickled inside the task, after the folder of this package is on the worker's path: workers of a local
    session start wherever the session did.  On a cluster the package is installed or shipped with ``--py-files``.
    """
    target = StructType.fromDDL(schema) if isinstance(schema, str) else schema
    arrow = to_arrow_schema(target)
    packed, root = cloudpickle.dumps(function), str(Path(__file__).resolve().parents[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle
        import sys

        import pyarrow

        if root not in sys.path:
            sys.path.append(root)
        try:
            for batch in pickle.loads(packed)(batches):
                columns = [batch.column(f.name).cast(f.type) for f in arrow]
                yield pyarrow.RecordBatch.from_arrays(columns, schema=arrow)
        finally:
            # a worker waits for its next task beside those of other stages
            pyarrow.default_memory_pool().release_unused()

    return df.mapInArrow(run, target)
