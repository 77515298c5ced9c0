"""The trie of all conversations' prefixes, as node tables addressed by minimal perfect hashing.

A node is a distinct sequence of first turns and is known by a 128-bit digest of it.  Conversations are dealt into shards
of neighbouring ids.  A shard enumerates its distinct prefix digests, gives each a slot by a minimal perfect hash whose
answers are verified against the stored digest, and keeps all it knows of its nodes in flat arrays by slot.  What
is known of one node in several shards is brought together by its digest; what a node weighs is then put into the
table of the one shard that has its smallest member, where all its ancestors are, and carried up through the array of
parent slots, deepest nodes first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from .text import map_arrow

ROOT = hashlib.blake2b(b"", digest_size=16).digest()
KEY = np.dtype([("a", "<u8"), ("b", "<u8")])


class PerfectHash:
    """Slots 0..n-1 for n distinct keys, one each.

    Level by level, the keys left are hashed to about as many places; a key alone in its place stays there, the others go on.
    A key's slot is the number of taken places before its own.  ``verify`` says which of any keys are really in the table.
    """

    def __init__(self, keys: np.ndarray):
        self.levels: list[tuple[int, np.ndarray, np.ndarray]] = []
        rest, before, level = keys, 0, 0
        while len(rest):
            places = self._places(rest, level, size := max(2 * len(rest), 4))
            alone = np.bincount(places, minlength=size) == 1
            ranks = before + np.cumsum(alone) - alone
            self.levels.append((size, alone, ranks))
            before += int(alone.sum())
            rest, level = rest[~alone[places]], level + 1
            if level > 200:
                raise ValueError("keys are not distinct")
        self.keys = np.zeros(len(keys), KEY)
        self.keys[self._slots(keys)] = keys

    @staticmethod
    def _places(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            x = (keys["a"] + np.uint64(level + 1) * np.uint64(0x9E3779B97F4A7C15)) ^ keys["b"]
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            x ^= x >> np.uint64(31)
        return (x % np.uint64(size)).astype(np.int64)

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        slots = np.zeros(len(keys), np.int64)
        left = np.arange(len(keys))
        for level, (size, alone, ranks) in enumerate(self.levels):
            places = self._places(keys[left], level, size)
            here = alone[places]
            slots[left[here]] = ranks[places[here]]
            left = left[~here]
        slots[left] = -1
        return slots

    def slots(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 for one that is not in the table: its place may be another key's."""
        slots = self._slots(keys)
        if len(self.keys):
            slots[self.keys[slots] != keys] = -1
        return slots


def _keys(digests) -> np.ndarray:
    return np.frombuffer(b"".join(digests), KEY)


def _distinct(keys: np.ndarray) -> np.ndarray:
    keys = keys[np.lexsort((keys["b"], keys["a"]))]
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


@dataclass
class Local:
    """A shard's table while its conversations come in: an entry for each (conversation, depth)."""

    digests: list[bytes] = field(default_factory=list)
    parents: list[bytes] = field(default_factory=list)
    depths: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    members: list[int | None] = field(default_factory=list)
    ends: list[int] = field(default_factory=list)

    def add(self, member: int | None, chain: list[tuple[bytes, int]]) -> None:
        """One conversation, as (digest, bytes) of each turn."""
        own = ROOT
        steps = [(own, own, 0, 0)]
        for depth, (turn, size) in enumerate(chain, 1):
            own, parent = hashlib.blake2b(own + turn, digest_size=16).digest(), own
            steps.append((own, parent, depth, size))
        for own, parent, depth, size in steps:
            self.digests.append(own)
            self.parents.append(parent)
            self.depths.append(depth)
            self.sizes.append(size)
            self.members.append(member)
        self.ends.append(len(self.digests) - 1)

    def table(self, shard: int) -> pa.RecordBatch:
        """The shard's distinct nodes: members and whether one goes on are counted, ends are listed in order."""
        keys = _keys(self.digests)
        table = PerfectHash(_distinct(keys))
        slots, n = table.slots(keys), len(table.keys)
        count = np.bincount(slots, minlength=n)
        ids = np.array([_NONE if m is None else m for m in self.members], np.int64)
        first = np.full(n, _NONE, np.int64)
        np.minimum.at(first, slots, ids)
        parent, depth, size, goes_on = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, bool)
        parent[slots] = table.slots(_keys(self.parents))
        depth[slots], size[slots] = self.depths, self.sizes
        goes_on[parent[depth > 0]] = True
        at = slots[self.ends]
        order = np.lexsort((ids[self.ends], at))
        stops = np.cumsum(np.bincount(at, minlength=n))
        ends = pa.ListArray.from_arrays(
            pa.array(np.concatenate([[0], stops]), pa.int32()), _nullable(ids[self.ends][order])
        )
        return pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(n, shard)),
                _binary(table.keys),
                _binary(table.keys[parent]),
                *map(pa.array, (depth, size, count)),
                _nullable(first),
                pa.array(goes_on),
                ends,
            ],
            names=["shard", "digest", "parent", "depth", "size", "n", "first", "goes_on", "ends"],
        )


# Stands for "no id" in arrays; sorts last, so that a smallest id is one that is known.
_NONE = np.iinfo(np.int64).max


def _nullable(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == _NONE)


def _binary(keys: np.ndarray) -> pa.Array:
    return pa.array([k.tobytes() for k in keys], pa.binary())


def rebuilt_length(conv_id: Column) -> Column:
    """How many first turns of another conversation a rebuilt one begins with; see :func:`local_nodes`."""
    return F.crc32(F.coalesce(conv_id.cast("string"), F.lit("")).cast("binary")) % 9


LOCAL = (
    "shard long, digest binary, parent binary, depth long, size long, n long, first long, goes_on boolean, ends array<long>"
)


def conversation_turns(turns: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, a 128-bit digest of role and text, and the text's bytes: all that a trie needs of a turn."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"))).alias("content"),
        F.octet_length(text).cast("long").alias("size"),
    )


def local_nodes(turns: DataFrame, family: Column, borrowed: Column, shard_rows: int = 400_000) -> DataFrame:
    """The nodes of each shard's own trie; a node that several shards have has a row in each.

    ``turns`` is as :func:`conversation_turns` gives it.  A conversation's turns are taken by turn, nulls first, equal
    ones by their digest.  ``family`` is the id of the conversation that another one borrows from, ``borrowed`` how many of
    its first turns (all it has if fewer; none if it is not there) take the place of as many own ones; with zeros every
    conversation is taken as it is.

    One shuffle of turns' digests, not texts, by ranges of families.  A shard is closed after ``shard_rows`` turns, so a
    task holds the nodes of one shard, or of its longest conversation.
    """
    own = F.coalesce(F.col("conv_id") != F.col("family"), F.lit(True))
    spark = turns.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), turns.count() // shard_rows + 1)
    rows = (
        turns.withColumns({"family": family, "borrowed": borrowed})
        .withColumn("own", own)
        .repartitionByRange(parts, "family")
        .sortWithinPartitions("family", "own", "conv_id", F.col("turn").asc_nulls_first(), "content")
        .select("family", "own", "conv_id", "borrowed", "content", "size")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        shard = TaskContext.get().partitionId() << 24
        local, current, lender, lent, chain, borrowed = Local(), None, None, [], [], 0

        def close() -> None:
            family, own, conv_id = current
            local.add(conv_id, [*lent[:borrowed], *chain[borrowed:]] if lender == family else chain[borrowed:])

        for batch in batches:
            for *key, h, content, size in zip(*(c.to_pylist() for c in batch.columns)):
                if key != current:
                    if current is not None:
                        if not current[1]:
                            lender, lent = current[0], chain
                        close()
                        if len(local.digests) >= shard_rows:
                            yield local.table(shard)
                            local, shard = Local(), shard + 1
                    current, chain, borrowed = key, [], h
                chain.append((content, size))
        if current is not None:
            if not current[1]:
                lender, lent = current[0], chain
            close()
            yield local.table(shard)

    return map_arrow(rows, run, LOCAL)


SUMS = (
    "digest binary, conv_id long, depth long, parent_conv_id long, n_convs long, children long, leaves long, saved long"
)


def _subtree_sums(known: DataFrame) -> DataFrame:
    """Each shard's share of what hangs below its nodes, and the node itself where the shard owns it."""
    rows = known.repartition("shard").sortWithinPartitions("shard", "depth")

    def sums(batch: pa.Table) -> pa.RecordBatch:
        digests, parents = (batch.column(c).to_pylist() for c in ("digest", "parent"))
        keys = _keys(digests)
        table = PerfectHash(keys)
        n, slots = len(keys), table.slots(keys)

        def scattered(name: str) -> np.ndarray:
            values = batch.column(name).combine_chunks()
            values = values.fill_null(_NONE) if pa.types.is_integer(values.type) else values
            out = np.zeros(n, np.bool_ if pa.types.is_boolean(values.type) else np.int64)
            out[slots] = values.to_numpy(zero_copy_only=False)
            return out

        depth, size, count, first, goes_on, owned = map(
            scattered, ("depth", "size", "n_convs", "conv_id", "any_goes_on", "owned")
        )
        parent = np.zeros(n, np.int64)
        parent[slots] = table.slots(_keys(parents))
        children = np.bincount(parent[owned & (depth > 0)], minlength=n)
        leaves = (owned & ~goes_on).astype(np.int64)
        saved = np.where(owned, (count - 1) * size, 0)
        by_depth = np.argsort(depth, kind="stable")
        edges = np.searchsorted(depth[by_depth], np.arange(int(depth.max(initial=0)) + 2))
        for level in range(len(edges) - 2, 0, -1):
            here = by_depth[edges[level] : edges[level + 1]]
            np.add.at(leaves, parent[here], leaves[here])
            np.add.at(saved, parent[here], saved[here])

        def told(values: np.ndarray, known: np.ndarray) -> pa.Array:
            return pa.array(values, pa.int64(), mask=~known)

        return pa.RecordBatch.from_arrays(
            [
                _binary(table.keys),
                told(first, owned & (first != _NONE)),
                told(depth, owned),
                told(first[parent], owned & (depth > 0) & (first[parent] != _NONE)),
                told(count, owned),
                *map(pa.array, (children, leaves, saved)),
            ],
            names=[c.split()[0] for c in SUMS.split(", ")],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(shards)) + 1).tolist(), len(shards)]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if held and held[0].column("shard")[0].as_py() != shards[a]:
                    yield sums(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(a, b - a))
        if held:
            yield sums(pa.Table.from_batches(held))

    return map_arrow(rows, run, SUMS)


ENDS = "digest binary, ends_sha256 string"


def _ends(local: DataFrame) -> DataFrame:
    """The SHA-256 of the ids that end at each node, ascending, comma-joined.

    Ids are brought together by stretches of 4,096 possible ids, so that a node where very many conversations end is few
    rows, and a task reads the stretches of a node in order, as a stream: the hash itself is one after the other.
    """
    ids = local.where("size(ends) > 0").select("digest", F.explode("ends").alias("id")).where("id IS NOT NULL")
    runs = ids.groupBy("digest", F.expr("id >> 12").alias("run")).agg(F.array_sort(F.collect_list("id")).alias("ids"))
    rows = runs.repartition("digest").sortWithinPartitions("digest", "run")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, sha = None, None
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = zip(*rows) if rows else ((), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.string()))], names=["digest", "ends_sha256"]
            )

        for batch in batches:
            for digest, ids in zip(*(batch.column(c).to_pylist() for c in ("digest", "ids"))):
                text = ",".join(map(str, ids)).encode()
                if digest != current:
                    if sha is not None:
                        done.append((current, sha.hexdigest()))
                    current, sha = digest, hashlib.sha256(text)
                else:
                    sha.update(b"," + text)
            if len(done) > 10_000:
                yield batch_of(done)
                done = []
        if sha is not None:
            done.append((current, sha.hexdigest()))
        yield batch_of(done)

    return map_arrow(rows, run, ENDS)


def prefix_trie(turns: DataFrame, family: Column, borrowed: Column, shard_rows: int = 400_000) -> DataFrame:
    """One row per distinct prefix: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id`` (the parent's smallest
    member; null for the root), ``n_convs``, ``n_children``, ``n_leaves`` and ``saved_tokens`` (both over the subtree),
    ``ends_sha256`` (ids of the members that end here).

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored; for ``family`` and ``borrowed`` see
    :func:`local_nodes`.  A null role or text is empty.  Rows without ``conv_id`` make one conversation; it is counted as a
    member, but is no smallest member and in no list of ends.  An empty table has no conversation, so no root either.

    Texts never move, and a prefix that many conversations share is one row for each shard from the first shuffle on,
    whatever its number of members.
    """
    local = materialise(local_nodes(conversation_turns(turns), family, borrowed, shard_rows))
    over = "OVER (PARTITION BY digest)"
    known = local.selectExpr(
        "shard",
        "digest",
        "parent",
        "depth",
        "size",
        f"sum(n) {over} AS n_convs",
        f"min(first) {over} AS conv_id",
        f"bool_or(goes_on) {over} AS any_goes_on",
        # the shard of the smallest member; the first one if none is known
        f"shard = min_by(shard, struct(first IS NULL, first, shard)) {over} AS owned",
    )
    nodes = (
        _subtree_sums(known)
        .groupBy("digest")
        .agg(
            *[F.max(c).alias(c) for c in ("conv_id", "depth", "parent_conv_id", "n_convs")],
            F.sum("children").alias("n_children"),
            F.sum("leaves").alias("n_leaves"),
            F.sum("saved").alias("saved_tokens"),
        )
    )
    return (
        nodes.join(_ends(local), "digest", "left")
        .withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit("").cast("binary"), 256)))
        .drop("digest")
    )
