"""Near-duplicates by SimHash fingerprints, found with a hierarchical index in Gray order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from .text import LOWER_CASE, keyed, map_arrow, mapped, row_key, slices, texts, words

BITS = 64
HASH_SEED = 42
FINGERPRINTS = "doc_id long, a long, b long, fingerprint long"


# fingerprints ----------------------------------------------------------------------------------------------------


def majority_bits(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Per run of ``counts`` hashes, the bits set in over half of them; zero for an empty run.

    Eight bits are counted at a time, each in a byte of its own, over at most 255 hashes before the bytes are added up.
    """
    out = np.zeros(len(counts), np.uint64)
    full = np.flatnonzero(counts)
    sizes = counts[full]
    if not len(full):
        return out
    blocks = -(-sizes // 255)
    first_block = np.cumsum(blocks) - blocks
    within = np.arange(blocks.sum()) - np.repeat(first_block, blocks)
    starts = np.repeat(np.cumsum(sizes) - sizes, blocks) + 255 * within
    for k in range(8):
        lanes = np.add.reduceat((hashes >> np.uint64(k)) & np.uint64(0x0101010101010101), starts)
        by_byte = lanes.astype("<u8").view(np.uint8).reshape(-1, 8).astype(np.int64)
        set_in = np.add.reduceat(by_byte, first_block, axis=0)
        over = (2 * set_in > sizes[:, None]).astype(np.uint8)
        out[full] |= over.view("<u8").ravel().astype(np.uint64) << np.uint64(k)
    return out


def batch_fingerprints(column: pa.LargeStringArray, shingle: int) -> np.ndarray:
    """Fingerprints of all texts of a column."""
    flat, begins = words(mapped(column, LOWER_CASE))
    n_words = np.diff(begins)
    counts = np.where(n_words == 0, 0, np.maximum(n_words - shingle + 1, 1))
    offsets = np.frombuffer(flat.buffers()[1], np.int64)[flat.offset : flat.offset + len(flat) + 1] if len(flat) else np.zeros(1, np.int64)
    data = np.frombuffer(flat.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    # all words with one space after each: a shingle is a stretch of it
    joined = np.insert(data, offsets[1:], 0x20).tobytes()
    number = np.arange(len(flat))
    start, end = offsets[:-1] + number, offsets[1:] + number
    total = counts.sum()
    first = np.repeat(begins[:-1] - (np.cumsum(counts) - counts), counts) + np.arange(total)
    last = np.minimum(first + shingle, np.repeat(begins[1:], counts)) - 1
    digest = xxhash.xxh64_intdigest
    hashes = [digest(joined[i:j], HASH_SEED) for i, j in zip(start[first].tolist(), end[last].tolist())]
    return majority_bits(np.array(hashes, np.uint64), counts)


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """``doc_id``, the row's content key (``a``, ``b``) and the fingerprint of every whole text.

    A-Z are lower-cased; words stand between ASCII white space; a shingle is ``shingle`` consecutive words with single spaces
    (all words, if there are fewer), and repeats count.  A text without words has fingerprint zero.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = [batch_fingerprints(part, shingle) for part in slices(texts(batch.column("text")), 2 << 20)]
            prints = np.concatenate([np.zeros(0, np.uint64), *parts])
            columns = [*(batch.column(c) for c in ("doc_id", "a", "b")), pa.array(prints.view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "a", "b", "fingerprint"])

    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", "text").alias("key"),
        F.col("text").cast("string").alias("text"),
    ).select("doc_id", "key.a", "key.b", "text")
    return map_arrow(given, run, FINGERPRINTS)


# the index -------------------------------------------------------------------------------------------------------


def gray_rank(prints: np.ndarray) -> np.ndarray:
    """Position of each fingerprint in the Gray code sequence, in which neighbours differ by one bit."""
    rank = prints.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


def _gray_order(fingerprint: str) -> Column:
    """:func:`gray_rank` as a signed number that sorts like the unsigned one."""
    rank = F.col(fingerprint)
    for shift in (1, 2, 4, 8, 16, 32):
        rank = rank.bitwiseXOR(F.shiftrightunsigned(rank, shift))
    return rank.bitwiseXOR(F.lit(-(1 << 63)))


class GrayIndex:
    """Binary tree over fingerprints in Gray order.

    A node holds the bits that all fingerprints below it share and no node above it holds; a fingerprint itself holds the
    bits that are left.  On the way down a query adds up its differences from each node's bits, and leaves a whole group
    once the sum exceeds the limit; at a fingerprint the sum is the distance.
    """

    def __init__(self, prints: np.ndarray):
        self.prints = prints[np.argsort(gray_rank(prints), kind="stable")]
        ones, zeros = self.prints, ~self.prints  # bits that are 1, and that are 0, in all of a group
        levels = [(ones, zeros)]
        while len(ones) > 1:
            if len(ones) % 2:
                ones, zeros = np.append(ones, ones[-1]), np.append(zeros, zeros[-1])
            ones, zeros = ones[0::2] & ones[1::2], zeros[0::2] & zeros[1::2]
            levels.append((ones, zeros))
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        above = np.zeros(1, np.uint64)
        for ones, zeros in reversed(levels):
            shared = ones | zeros
            held = np.repeat(above, 2)[: len(shared)] if len(self.levels) else above
            self.levels.append((shared & ~held, ones))
            above = shared

    def within(self, queries: np.ndarray, limit: int, at_once: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query number, fingerprint number) at most ``limit`` bits apart, some queries at a time."""
        for begin in range(0, len(queries), at_once):
            part = queries[begin : begin + at_once]
            query = np.arange(len(part), dtype=np.int32)
            node = np.zeros(len(part), np.int32)
            so_far = np.zeros(len(part), np.uint8)
            for depth, (mask, value) in enumerate(self.levels):
                if depth:
                    query, so_far = np.repeat(query, 2), np.repeat(so_far, 2)
                    node = np.repeat(node * 2, 2)
                    node[1::2] += 1
                    if len(mask) % 2 and len(mask) > 1 or len(mask) == 1:
                        real = node < len(mask)
                        query, so_far, node = query[real], so_far[real], node[real]
                so_far = so_far + np.bitwise_count((part[query] ^ value[node]) & mask[node])
                near = so_far <= limit
                query, node, so_far = query[near], node[near], so_far[near]
            yield query.astype(np.int64) + begin, node.astype(np.int64)


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links a-b: each element's is the smallest element it is linked to by now."""
    while True:
        x, y = labels[a], labels[b]
        differ = x != y
        if not differ.any():
            return labels
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while True:
            up = labels[labels]
            if (up == labels).all():
                break
            labels = up


def _block_links(table: pa.Table, limit: int) -> pa.Table:
    home = table.column("home").to_numpy().astype(bool)
    prints = table.column("fingerprint").to_numpy().view(np.uint64)
    index = GrayIndex(prints[home])
    known = len(index.prints)
    everything = np.concatenate([index.prints, prints[~home]])
    labels = np.arange(len(everything))
    if known:
        for query, found in index.within(everything, limit):
            labels = joined(labels, query, found)
    linked = np.flatnonzero(labels != np.arange(len(labels)))
    signed = everything.view(np.int64)
    return pa.table({"x": signed[linked], "y": signed[labels[linked]]})


def links(prints: DataFrame, limit: int, block_size: int = 1 << 18, visitors: int = 1 << 24, blocks: int = 24) -> DataFrame:
    """(``x``, ``y``): links between distinct ``fingerprint`` values that connect the same groups as all pairs at most
    ``limit`` bits apart do.

    Fingerprints are cut into blocks of equal size in Gray order, at least ``blocks`` of them, of about ``block_size``.  A
    block's summary is the bits all of it shares; the summaries are all that reaches the driver.  A fingerprint is sent to
    its own block, to be indexed, and to later blocks whose summary it differs from by at most ``limit`` bits, to be looked
    up; so every pair meets once.  A task finds all pairs of its block but returns only enough of them to connect what
    they connect, at most one per fingerprint it was sent, however dense the groups are.  Where a block could be sent more
    than ``visitors``, they are dealt over several copies of it.
    """
    spark = prints.sparkSession
    ranked = prints.select("fingerprint", _gray_order("fingerprint").alias("rank"))
    n = ranked.count()
    blocks = max(blocks, -(-n // block_size))
    shares = -(-n // visitors) or 1
    quantiles = [i / blocks for i in range(1, blocks)]
    bounds = np.array(
        ranked.agg(F.percentile_approx("rank", quantiles, 50 * blocks)).first()[0] or [], np.int64
    )
    bounds = np.unique(bounds)
    limits = spark.sparkContext.broadcast(bounds)
    located = map_arrow(
        ranked,
        lambda batches: (
            pa.RecordBatch.from_arrays(
                [b.column("fingerprint"), pa.array(np.searchsorted(limits.value, b.column("rank").to_numpy(), side="right"))],
                names=["fingerprint", "block"],
            )
            for b in batches
        ),
        "fingerprint long, block long",
    )
    summaries = {
        r.block: (r.ones, r.any)
        for r in located.groupBy("block")
        .agg(F.bit_and("fingerprint").alias("ones"), F.bit_or("fingerprint").alias("any"))
        .collect()
    }
    order = sorted(summaries)
    ones = np.array([summaries[b][0] for b in order], np.int64)
    shared = ~(np.array([summaries[b][1] for b in order], np.int64) ^ ones)
    known = spark.sparkContext.broadcast((np.array(order, np.int64), ones.view(np.uint64), shared.view(np.uint64)))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, value, mask = known.value
        for batch in batches:
            prints, own = batch.column("fingerprint").to_numpy(), batch.column("block").to_numpy()
            some = max(1, (1 << 22) // max(1, len(number)))
            for i in range(0, len(prints), some):
                part, home = prints[i : i + some], own[i : i + some]
                apart = np.bitwise_count((part.view(np.uint64)[:, None] ^ value) & mask)
                who, where = np.nonzero((apart <= limit) & (number > home[:, None]))
                share = (part[who] >> 5) % shares
                columns = [
                    np.concatenate([np.repeat(home, shares), number[where]]),
                    np.concatenate([np.tile(np.arange(shares), len(part)), share]),
                    np.concatenate([np.repeat(part, shares), part[who]]),
                    np.concatenate([np.ones(len(part) * shares, np.int8), np.zeros(len(who), np.int8)]),
                ]
                yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["block", "share", "fingerprint", "home"])

    dealt = map_arrow(located, deal, "block long, share long, fingerprint long, home byte")
    return dealt.groupBy("block", "share").applyInArrow(lambda t: _block_links(t, limit), "x long, y long")


# groups ----------------------------------------------------------------------------------------------------------


def connected(edges: DataFrame) -> DataFrame:
    """(``node``, ``label``) of all nodes of the edges (``x``, ``y``): the smallest node of its component.

    Every round takes the smallest label among a node's neighbours, then the label's own label; what one round makes is
    written before the next, and the rounds end when no label changes.
    """
    both = materialise(edges.unionByName(edges.selectExpr("y AS x", "x AS y")).distinct())
    labels = materialise(both.groupBy(F.col("x").alias("node")).agg(F.least(F.min("y"), F.col("node")).alias("label")))
    while True:
        near = both.join(labels, F.col("y") == F.col("node")).groupBy("x").agg(F.min("label").alias("near"))
        hooked = labels.join(near, F.col("node") == F.col("x")).select(
            "node", F.col("label").alias("old"), F.least("label", "near").alias("label")
        )
        up = hooked.select(F.col("node").alias("_node"), F.col("label").alias("up"))
        # a label is a node of the same component, so each has one
        step = materialise(hooked.join(up, F.col("label") == F.col("_node")).select("node", "old", F.col("up").alias("label")))
        labels = step.select("node", "label")
        if step.where("label <> old").isEmpty():
            return labels


def near_duplicates(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """One row per document: ``doc_id``, its content key (``a``, ``b``), ``fingerprint`` and ``first``, the document that
    stands for its group (fields ``doc_id``, ``a``, ``b``): the one with the smallest id, or, where no member has an id, the
    smallest key.

    Two documents are linked if their fingerprints differ in at most ``max_bits`` bits; a group is all that links reach.
    Texts without words all have fingerprint zero and so are one group, as are rows that repeat.
    """
    found = materialise(fingerprints(docs, shingle))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "a", "b")).alias("first")
    distinct = materialise(found.groupBy("fingerprint").agg(first))
    labels = connected(links(distinct, max_bits))
    named = distinct.join(labels, F.col("fingerprint") == F.col("node"), "left").select(
        "fingerprint", F.coalesce("label", "fingerprint").alias("label"), "first"
    )
    groups = named.groupBy("label").agg(F.min("first").alias("first"))
    members = named.select("fingerprint", "label").join(groups, "label").select("fingerprint", "first")
    return found.join(members, "fingerprint", "left").select("doc_id", "a", "b", "fingerprint", "first")


def deduplicate(docs: DataFrame, shingle: int = 3, max_bits: int = 3) -> DataFrame:
    """The documents that stand for their groups, one for each group, with all columns."""
    found = near_duplicates(docs, shingle, max_bits)
    kept = found.where("a = first.a AND b = first.b").select("a", "b").distinct()
    whole = keyed(docs, "doc_id", "text").join(kept, ["a", "b"], "left_semi")
    return whole.dropDuplicates(["a", "b"]).select("doc.*")
