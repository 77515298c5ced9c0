"""Token ids as files of length-delimited binary records, with an offset index for shuffled reads.

A record file is a sequence of frames; a frame is

    length of the payload   unsigned 64 bits
    masked checksum of the eight bytes before
    payload
    masked checksum of the payload

all little-endian.  A checksum is a CRC-32, masked (rotated right by 15 bits, plus a constant) so that data that hold
checksums of themselves keep a useful one.  A payload is one document: a byte that says whether it has an id, eight bytes
of id, a byte with the width of a token id (2 or 4), then the token ids.  So a reader can walk a file frame by frame, and
the index, a Parquet table with one row per record, lets it fetch any records in any order.

The index is also what makes a write valid: a task writes to a file of its own attempt, and only the rows of the attempt
that Spark commits name it.  Files of lost or repeated attempts are never named and never read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.files import qualified
from .text import map_arrow, texts
from .tokens import encoder

# Fixed value: what masking adds.
MASK = 0xA282EAD8
INDEX = "file string, record long, doc_id long, offset long, length long, n_tokens long"
TOKENS = "doc_id long, start long, ids binary"
_LENGTH, _CHECK, _DOCUMENT = "<Q", "<I", "<BqB"
_HEAD = 12  # bytes of a length and its checksum


def masked(data: bytes) -> int:
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    header = struct.pack(_LENGTH, len(payload))
    return b"".join((header, struct.pack(_CHECK, masked(header)), payload, struct.pack(_CHECK, masked(payload))))


def payload(doc_id: int | None, ids: np.ndarray, width: int) -> bytes:
    head = struct.pack(_DOCUMENT, doc_id is not None, doc_id or 0, width)
    return head + ids.astype(f"<u{width}").tobytes()


def length_of(head: bytes, offset: int = 0) -> int:
    """The payload's length, from the first bytes of a frame; ``ValueError`` if its checksum does not fit."""
    if len(head) < offset + _HEAD or struct.unpack_from(_CHECK, head, offset + 8)[0] != masked(head[offset : offset + 8]):
        raise ValueError(f"damaged record length at byte {offset}")
    return struct.unpack_from(_LENGTH, head, offset)[0]


def unframe(data: bytes, offset: int = 0) -> tuple[bytes, int]:
    """The payload of the frame at ``offset``, and where the next one begins; ``ValueError`` if the bytes are damaged."""
    begin = offset + _HEAD
    end = begin + length_of(data, offset)
    content = data[begin:end]
    if len(data) < end + 4 or struct.unpack_from(_CHECK, data, end)[0] != masked(content):
        raise ValueError(f"damaged record at byte {offset}")
    return content, end + 4


def parse(content: bytes) -> tuple[int | None, np.ndarray]:
    known, doc_id, width = struct.unpack_from(_DOCUMENT, content)
    ids = np.frombuffer(content, f"<u{width}", offset=struct.calcsize(_DOCUMENT))
    return doc_id if known else None, ids.astype("<u4")


def open_folder(folder: str) -> tuple[pyarrow.fs.FileSystem, str]:
    """The file system of a shared folder, which every task opens by itself; the folder as ``files.qualified`` gives it."""
    if folder.startswith("file:"):
        folder = "/" + folder.removeprefix("file:").lstrip("/")
    if "://" not in folder:
        return pyarrow.fs.LocalFileSystem(), folder
    return pyarrow.fs.FileSystem.from_uri(folder.replace("s3a://", "s3://", 1))


def write_records(docs: DataFrame, folder: str, tokenizer: str, end_id: int, by_chunk: bool = True) -> None:
    """Encode every whole text, append ``end_id``, and write records in ascending ``doc_id`` order (null ids first, equal
    ids by text) below ``folder``: record files in ``records``, the index in ``index``.

    One range shuffle of the texts gives the order; it also spreads rows that share one id.  A task holds one Arrow batch.
    """
    target = qualified(docs.sparkSession, f"{folder}/records")
    filesystem, path = open_folder(target)
    filesystem.create_dir(path, recursive=True)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer, by_chunk)
        width = 2 if max(encode.size - 1, end_id) < 1 << 16 else 4
        system, place = open_folder(target)
        name = f"{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}.records"
        offset = record = 0
        out = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = out or system.open_output_stream(f"{place}/{name}")
            ids, begins = encode.encode(texts(batch.column("text")))
            rows = []
            for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
                data = frame(payload(doc_id, np.append(ids[begins[i] : begins[i + 1]], end_id), width))
                out.write(data)
                rows.append((name, record, doc_id, offset, len(data), int(begins[i + 1] - begins[i]) + 1))
                offset, record = offset + len(data), record + 1
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), *[pa.int64()] * 5))],
                names=["file", "record", "doc_id", "offset", "length", "n_tokens"],
            )
        if out:
            out.close()

    order = ["doc_id", "tie"]
    ranged = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
        .withColumn("tie", F.xxhash64("text"))
        .repartitionByRange(*order)
        .sortWithinPartitions(*order, "text")
        .select("doc_id", "text")
    )
    map_arrow(ranged, write, INDEX).write.parquet(f"{folder}/index")


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per record; ``file`` and ``record`` together are in the order of the records."""
    return spark.read.schema(INDEX).parquet(f"{folder}/index")


def _rows(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else ((), (), ())
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], names=["doc_id", "start", "ids"]
    )


def read_records(spark: SparkSession, folder: str, files_at_once: int | None = None) -> DataFrame:
    """``doc_id``, ``start`` (token ids of all records before) and ``ids`` (little-endian, 32 bits), walking each file from
    its first frame to its last and checking every checksum.

    A task takes whole files, a frame at a time.
    """
    files = read_index(spark, folder).groupBy("file").agg(F.sum("n_tokens").alias("n_tokens"))
    starts = files.selectExpr("file", "sum(n_tokens) OVER (ORDER BY file) - n_tokens AS start")
    target = qualified(spark, f"{folder}/records")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(target)
        for batch in batches:
            for name, start in zip(*(batch.column(c).to_pylist() for c in ("file", "start"))):
                found, held = [], 0
                with system.open_input_stream(f"{place}/{name}", buffer_size=1 << 20) as source:
                    while head := source.read(_HEAD):
                        doc_id, ids = parse(unframe(head + source.read(length_of(head) + 4))[0])
                        found.append((doc_id, start, ids.tobytes()))
                        start, held = start + len(ids), held + ids.nbytes
                        if held > 8 << 20:
                            yield _rows(found)
                            found, held = [], 0
                yield _rows(found)

    parts = files_at_once or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return map_arrow(starts.repartition(parts, "file"), read, TOKENS)


def read_shuffled(spark: SparkSession, folder: str, seed: int) -> DataFrame:
    """``doc_id``, ``place`` and ``ids`` of all records in a random order that ``seed`` fixes: by ``place`` over all
    partitions.  Index rows are shuffled, not records; each task then fetches its records by offset."""
    target = qualified(spark, f"{folder}/records")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = open_folder(target)
        opened: dict[str, pa.NativeFile] = {}
        for batch in batches:
            rows, held = [], 0
            for name, offset, length, at in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length", "place"))):
                if name not in opened:
                    if len(opened) >= 64:
                        opened.pop(next(iter(opened))).close()
                    opened[name] = system.open_input_file(f"{place}/{name}")
                opened[name].seek(offset)
                doc_id, ids = parse(unframe(opened[name].read(length))[0])
                rows.append((doc_id, at, ids.tobytes()))
                held += ids.nbytes
                if held > 8 << 20:
                    yield _rows(rows).rename_columns(["doc_id", "place", "ids"])
                    rows, held = [], 0
            yield _rows(rows).rename_columns(["doc_id", "place", "ids"])

    order = read_index(spark, folder).withColumn("place", F.xxhash64(F.lit(seed), "file", "record"))
    ordered = order.repartitionByRange("place").sortWithinPartitions("place", "file", "record")
    return map_arrow(ordered, fetch, "doc_id long, place long, ids binary")
