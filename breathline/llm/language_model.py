"""Scoring of texts by a hashed maximum-entropy language model, next to smoothed unigrams.

Every word of the training texts is an outcome of its own.  The model gives a token the product of the probabilities on its
way down a tree, each given the tokens before: of its class; of its member within the class; and, where the member is not one
frequent word but a group of all other words with like endings, of one of the group's lots (words are dealt to them by hash),
and of the branches below the lot, down to the word (`word_trees`).  A class holds members that keep like company.  All are
softmaxes over sums of weights, found by hashing the words before (one and two back, and both) into tables; the first also
sees the third word back, pairs with gaps, and members.  So a token costs some short softmaxes, their number growing with the
logarithm of the number of words, and the probabilities of all known words, and of one unknown word for each lot, add up to one.

Classes, members and lots are trained everywhere and averaged, in tables of fixed size.  What lies below a lot is trained and
used in one task, together with other lots: its tokens go there, and sums by text come back, so no weights leave the task
and their table grows with the words of its lots.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from .text import LOWER_CASE, map_arrow, mapped, slices, texts, words
from .word_trees import BRANCHES, Softmaxes, Ways, descend, softmax, ways

# The word that stands for the end of a text; no word of a text is empty.
END = ""
BLOCKS = "block long, words array<string>, tokens binary, lengths binary, training binary, doc_ids array<long>"
PAIRS = "word string, bucket int, block long, place int, n long"
STREAMS = "block long, kinds binary, lengths binary, places binary"
PIECES = "part int, block long, hashes binary, kinds binary, words binary, a binary, b binary, lengths binary, training binary"
SUMS = "block long, texts binary, sums binary"
SCORES = "doc_id long, n_tokens long, n_known long, base_score double, score double"


@dataclass(frozen=True)
class Options:
    smoothing: float = 0.1
    classes: int = 16
    members: int = 16  # of each class
    endings: int = 96  # members that hold the words with like endings; the other members are one frequent word each
    lots: int = BRANCHES  # of each of these members, at most so many
    slots: int = 40  # kinds of words of a lot that contexts tell apart
    lot_rows: int = 1 << 15  # hashed rows for what is before, and a member with lots
    pair_rows: int = 4096  # hashed rows for pairs of words before
    word_rows: int = 1 << 15  # hashed rows for what is before, and a class
    rounds: int = 3  # the training texts are dealt over so many rounds; weights are averaged after each
    trainers: int = 24  # tasks of a round, at least
    trainer_blocks: int = 8  # blocks that a trainer takes in a round; beyond that there are more trainers
    averaged: int = 32  # weight tables that one task averages; beyond that, averages are averaged
    rate: float = 0.15
    batch: int = 8192
    part_tokens: int = 1 << 20  # lots are dealt to so many tasks that one has about so many tokens,
    part_words: int = 40_000  # and words
    pieces_at_once: int = 1 << 18  # tokens that are put in random order together, at least

    @property
    def total(self) -> int:
        return self.classes * self.members

    @property
    def frequent(self) -> int:
        return self.total - self.endings

    @property
    def kinds(self) -> int:
        return self.frequent + self.endings * self.lots * self.slots

    def parts(self, tokens: int, words: int) -> int:
        """Tasks that the lots are dealt to."""
        wanted = max(self.trainers, -(-tokens // self.part_tokens), -(-words // self.part_words))
        return min(wanted, self.endings * self.lots)

    def member_of_kind(self) -> np.ndarray:
        other = self.frequent + np.repeat(np.arange(self.endings), self.lots * self.slots)
        return np.concatenate([np.arange(self.frequent), other])


def squeezed(values: np.ndarray) -> bytes:
    """Small whole numbers, compressed byte plane by byte plane."""
    planes = values.astype("<u4").view(np.uint8).reshape(-1, 4).T.copy()
    return len(values).to_bytes(8, "little") + pa.Codec("zstd").compress(planes.tobytes(), asbytes=True)


def unsqueezed(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:8], "little")
    planes = pa.Codec("zstd").decompress(data[8:], decompressed_size=4 * n, asbytes=True) if n else b""
    return np.frombuffer(planes, np.uint8).reshape(4, n).T.copy().view("<u4").ravel().astype(np.int64)


def ending_bucket(some: pa.LargeStringArray, endings: int) -> np.ndarray:
    """Words with the same last two characters, apart from closing punctuation, share a bucket; punctuation makes two."""
    bare = pc.utf8_rtrim(some, ".,;:!?")
    closed = pc.not_equal(pc.binary_length(bare), pc.binary_length(some)).to_numpy(zero_copy_only=False)
    coded = pc.dictionary_encode(pc.utf8_slice_codeunits(bare, -2))
    hashed = np.array([zlib.crc32(s.encode()) % (endings // 2) for s in coded.dictionary.to_pylist()], np.int64)
    return 2 * hashed[coded.indices.to_numpy(zero_copy_only=False)] + closed if len(some) else np.zeros(0, np.int64)


def tokenized(docs: DataFrame, held_out: F.Column) -> DataFrame:
    """Blocks of texts of some megabytes: the distinct words, and every text as places in that list, its end included.

    A-Z are lower-cased; words stand between ASCII white space.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            done = 0
            for part in slices(texts(batch.column("text")), 16 << 20):
                yield block(number, part, *(batch.column(c).slice(done, len(part)) for c in ("held_out", "doc_id")))
                done, number = done + len(part), number + 1

    def block(number: int, column: pa.LargeStringArray, held_out: pa.Array, doc_ids: pa.Array) -> pa.RecordBatch:
        flat, begins = words(mapped(column, LOWER_CASE))
        coded = pc.dictionary_encode(flat)
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        vocabulary = pa.concat_arrays([coded.dictionary.cast(pa.large_string()), pa.array([END], pa.large_string())])
        place = np.insert(place, begins[1:], len(vocabulary) - 1)
        lengths = np.diff(begins) + 1
        held = held_out.to_numpy(zero_copy_only=False)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number]),
                pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary.cast(pa.string())),
                *(pa.array([x], pa.binary()) for x in (squeezed(place), squeezed(lengths), squeezed(~held))),
                pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), doc_ids),
            ],
            names=["block", "words", "tokens", "lengths", "training", "doc_ids"],
        )

    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), held_out.alias("held_out"), F.col("text").cast("string").alias("text")
    )
    return map_arrow(given, run, BLOCKS)


def word_counts(blocks: DataFrame, options: Options) -> DataFrame:
    """For every word of every block: the block, its place there, how often all training texts have it (``c``), and whether
    this row is the word's ``first``; only that one has the ``word`` itself and its ``lot``.

    Blocks count before anything is shuffled, so the commonest word comes once per block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                some = batch.column("words")[i].values.cast(pa.large_string())
                training, lengths, tokens = (unsqueezed(batch.column(c)[i].as_py()) for c in ("training", "lengths", "tokens"))
                used = tokens[np.repeat(training, lengths) == 1]
                n = np.bincount(used, minlength=len(some))
                bucket = ending_bucket(some, options.endings)
                block = np.full(len(some), batch.column("block")[i].as_py())
                rows = [some, *map(pa.array, (bucket, block, np.arange(len(some)), n))]
                whole = pa.RecordBatch.from_arrays(rows, names=["word", "bucket", "block", "place", "n"])
                for begin in range(0, len(some), 50_000):
                    yield whole.slice(begin, 50_000)

    pairs = map_arrow(blocks.select("block", "words", "tokens", "lengths", "training"), run, PAIRS)
    whole = pairs.selectExpr(
        "*", "sum(n) OVER (PARTITION BY word) AS c", "row_number() OVER (PARTITION BY word ORDER BY block) = 1 AS first"
    )
    lot = f"CAST(bucket * {options.lots} + pmod(xxhash64(word), {options.lots}) AS int)"
    return whole.selectExpr("block", "place", "c", "first", "if(first, word, NULL) AS word", f"if(first, {lot}, NULL) AS lot")


@dataclass
class Vocabulary:
    """What the driver knows of the words: the frequent ones, and totals by member and lot.  None of it grows with the corpus.

    The frequent words are those with a member of their own; all others have a leaf of their own below a lot.
    """

    frequent: list[str]
    member_tokens: np.ndarray
    member_words: np.ndarray
    lot_tokens: np.ndarray
    tokens: int
    words: int


def vocabulary_of(counted: DataFrame, options: Options) -> Vocabulary:
    known = counted.where("first AND c > 0").select("word", "lot", "c")
    top = known.where(F.col("word") != END).orderBy(F.desc("c"), "word").limit(options.frequent - 1).collect()
    frequent = [END] + [r.word for r in top]
    by_lot = known.groupBy("lot").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    end = known.where(F.col("word") == END).select("c", "lot").first()
    tokens, distinct = np.zeros(options.total, np.int64), np.zeros(options.total, np.int64)
    lot_tokens, lot_words = (np.zeros(options.endings * options.lots, np.int64) for _ in range(2))
    for r in by_lot:
        lot_tokens[r.lot], lot_words[r.lot] = r.c, r.n
    # frequent words are members of their own
    for i, (word, lot, c) in enumerate([*([(END, end.lot, end.c)] if end else []), *[tuple(r) for r in top]]):
        tokens[i], distinct[i] = c, 1
        lot_tokens[lot] -= c
        lot_words[lot] -= 1
    tokens[options.frequent :] = lot_tokens.reshape(-1, options.lots).sum(axis=1)
    distinct[options.frequent :] = lot_words.reshape(-1, options.lots).sum(axis=1)
    return Vocabulary(frequent, tokens, distinct, lot_tokens, int(tokens.sum()), int(distinct.sum()))


# Hashes of words; the first lot of digits chooses among lots, others tell words of a lot apart.
WORD_HASHES = "transform(words, w -> xxhash64(w)) AS hashes"


def kinds_of(some: pa.LargeStringArray, hashes: np.ndarray, frequent: list[str], options: Options) -> np.ndarray:
    """A number for each word, which also tells its member and its lot: frequent words have one each, the words of a lot share
    some."""
    own = pc.index_in(some, value_set=pa.array(frequent, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False)
    lot = ending_bucket(some, options.endings) * options.lots + hashes % options.lots
    slot = (hashes.view(np.uint64) >> np.uint64(40)).astype(np.int64) % options.slots
    return np.where(own >= 0, own, options.frequent + lot * options.slots + slot).astype(np.int32)


def coded_blocks(blocks: DataFrame, frequent: list[str], options: Options, function: Callable, schema: str) -> DataFrame:
    """What ``function`` makes of each block: its number, hashes and kinds of its words, tokens, lengths and training flags."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                hashes = batch.column("hashes")[i].values.to_numpy(zero_copy_only=False)
                kinds = kinds_of(batch.column("words")[i].values.cast(pa.large_string()), hashes, frequent, options)
                tokens, lengths, training = (unsqueezed(batch.column(c)[i].as_py()) for c in ("tokens", "lengths", "training"))
                yield from function(batch.column("block")[i].as_py(), hashes, kinds, tokens.astype(np.int32), lengths, training)

    return map_arrow(blocks.selectExpr("block", "words", WORD_HASHES, "tokens", "lengths", "training"), run, schema)


def row_of(schema: str, *values: int | bytes) -> pa.RecordBatch:
    names = [c.split()[0] for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], pa.binary() if isinstance(v, bytes) else pa.int64()) for v in values], names=names)


def word_streams(blocks: DataFrame, frequent: list[str], options: Options) -> DataFrame:
    """The training texts of every block as kinds of words, and the kinds of the block's list of words."""

    def streams(block, hashes, kinds, tokens, lengths, training):
        used = tokens[np.repeat(training, lengths) == 1]
        yield row_of(STREAMS, block, squeezed(kinds[used]), squeezed(lengths[training == 1]), squeezed(kinds))

    return coded_blocks(blocks, frequent, options, streams, STREAMS)


def word_pieces(blocks: DataFrame, frequent: list[str], options: Options, parts: int) -> DataFrame:
    """The tokens of every block that are not frequent words, those of each part by themselves: the words of the part (part of
    a hash, and a kind), the tokens as places among these, the kinds one and two places before, and how many each text has."""

    def pieces(block, hashes, kinds, tokens, lengths, training):
        lot = (kinds - options.frequent) // options.slots
        part = np.where(kinds < options.frequent, parts, lot % parts).astype(np.int32)
        words = np.argsort(part, kind="stable")
        words_begin = np.searchsorted(part[words], np.arange(parts + 1))
        within = np.empty(len(part), np.int32)
        within[words] = np.arange(len(part)) - words_begin[part[words]]
        seen = kinds[tokens]
        a, b = (before(seen, lengths, k).astype(np.int32) for k in (1, 2))
        of_token = part[tokens]
        order = np.argsort(of_token.astype(np.uint16 if parts < 1 << 16 else np.int64), kind="stable").astype(np.int32)
        begin = np.searchsorted(of_token[order], np.arange(parts + 1))
        text = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        flags = squeezed(training)
        for p in range(parts):
            here, some = words[words_begin[p] : words_begin[p + 1]], order[begin[p] : begin[p + 1]]
            if len(some):
                columns = hashes[here] & 0xFFFFFFFF, kinds[here], within[tokens[some]], a[some], b[some]
                counts = np.bincount(text[some], minlength=len(lengths))
                yield row_of(PIECES, p, block, *map(squeezed, columns), squeezed(counts), flags)

    return coded_blocks(blocks, frequent, options, pieces, PIECES)


class Part:
    """The lots of one task: their words as leaves of trees, and the softmaxes on the way to them."""

    def __init__(self, words: list[np.ndarray], tokens: Iterator[tuple[np.ndarray, np.ndarray]], options: Options):
        """``words`` of every piece, as kinds above thirty-two bits of a hash; of every piece its places and which are of training."""
        self.options = options
        self.words = np.unique(np.concatenate(words))
        count = np.zeros(len(self.words), np.int64)
        for own, (place, training) in zip(words, tokens):
            n = np.bincount(place[training], minlength=len(own))
            np.add.at(count, np.searchsorted(self.words, own), n)
        lot = ((self.words >> 32) - options.frequent) // options.slots
        lots, number = np.unique(lot, return_inverse=True)
        known = np.flatnonzero(count)
        # one more leaf in each lot, for words that training texts don't have
        weight = np.concatenate([count[known], np.full(len(lots), options.smoothing)])
        self.ways: Ways = ways(np.concatenate([number[known], np.arange(len(lots))]), weight)
        self.leaf = len(known) + number
        self.leaf[known] = np.arange(len(known))
        # the table follows the words that training texts have
        rows = 64 + 3 * np.bincount(number[known], minlength=len(lots)) // 2
        self.softmaxes = Softmaxes(self.ways.shares, self.ways.tree, rows)
        self.squares = np.zeros(len(self.softmaxes.table), np.float32)

    def steps(self, own: np.ndarray, place: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """All steps down to the tokens' leaves: which token, node and branch, and the kinds before."""
        which, at = self.ways.items(self.leaf[np.searchsorted(self.words, own)][place])
        return which, self.ways.node[at], self.ways.child[at], a[which], b[which]

    def train(self, steps: list[tuple[np.ndarray, ...]], rng: np.random.Generator) -> None:
        node, child, a, b = (np.concatenate(x) for x in list(zip(*steps))[1:])
        self.softmaxes.train(node, child, a, b, self.squares, rng, self.options.rate, self.options.batch)


def word_sums(pieces: DataFrame, options: Options) -> DataFrame:
    """For every part and block, the log10 probabilities of words within their lots, added up by text, where they are not 0.

    A task takes the pieces of one part, trains on its training tokens, and then goes through all of them.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("block")
        column = lambda name, i, kind=np.int32: unsqueezed(table.column(name)[i].as_py()).astype(kind)
        n = range(table.num_rows)
        words = [column("kinds", i, np.int64) << 32 | column("hashes", i, np.int64) for i in n]
        training = lambda i: np.repeat(column("training", i), column("lengths", i)) == 1
        part = Part(words, ((column("words", i), training(i)) for i in n), options)
        rng, kept, size = np.random.default_rng(table.column("part")[0].as_py()), [], 0
        for i in n:
            some = training(i)
            kept.append(part.steps(words[i], *(column(c, i)[some] for c in ("words", "a", "b"))))
            size += int(some.sum())
            if size >= options.pieces_at_once or i == n[-1]:
                part.train(kept, rng)
                kept, size = [], 0
        out = []
        for i in n:
            which, *steps = part.steps(words[i], *(column(c, i) for c in ("words", "a", "b")))
            lengths = column("lengths", i, np.int64)
            sums = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[which], part.softmaxes.log10(*steps), len(lengths))
            texts = np.flatnonzero(sums)
            out.append(row_of(SUMS, table.column("block")[i].as_py(), squeezed(np.diff(texts, prepend=0)), sums[texts].astype(np.float32).tobytes()))
        return pa.Table.from_batches(out)

    return pieces.groupBy("part").applyInArrow(run, SUMS)


def before(members: np.ndarray, lengths: np.ndarray, back: int) -> np.ndarray:
    """The member ``back`` places before each token of its text; the end of a text (member 0) where there is none."""
    out = np.zeros(len(members), np.int64)
    out[back:] = members[: len(members) - back]
    begins = np.cumsum(lengths) - lengths
    for k in range(back):
        out[(begins + k)[lengths > k]] = 0
    return out


def neighbours(streams: DataFrame, options: Options) -> np.ndarray:
    """How often each member follows each: a matrix of fixed size, counted by block and added up by Spark."""
    member_of = options.member_of_kind()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, lengths in zip(batch.column("kinds").to_pylist(), batch.column("lengths").to_pylist()):
                members = member_of[unsqueezed(data)]
                pairs = before(members, unsqueezed(lengths), 1) * options.total + members
                n = np.bincount(pairs, minlength=1)
                cell = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(cell), pa.array(n[cell])], names=["cell", "n"])

    rows = map_arrow(streams.select("kinds", "lengths"), run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(options.total**2)
    for r in rows:
        out[r.cell] = r.n
    return out.reshape(options.total, options.total)


def balanced_classes(follows: np.ndarray, classes: int) -> np.ndarray:
    """Members in an order in which each class is a stretch of equal length: halved again and again along the direction in
    which the company that the members keep differs most."""
    out_of, into = follows.sum(axis=1) + 1, follows.sum(axis=0) + 1
    company = follows / np.sqrt(np.outer(out_of, into))
    company = np.concatenate([company, company.T], axis=1)

    def halved(some: np.ndarray, parts: int) -> list[int]:
        if parts == 1:
            return some.tolist()
        rows = company[some] - company[some].mean(axis=0)
        direction = np.linalg.svd(rows, full_matrices=False)[2][0]
        direction = direction * np.sign(direction[np.argmax(np.abs(direction))])
        order = some[np.argsort(rows @ direction, kind="stable")]
        middle = len(order) // 2
        return halved(order[:middle], parts // 2) + halved(order[middle:], parts // 2)

    return np.array(halved(np.arange(len(follows)), classes))


def remainder(numbers: np.ndarray, n: int) -> np.ndarray:
    """Of numbers that are not negative; bits are cut off faster than numbers are divided."""
    return numbers & (n - 1) if n & (n - 1) == 0 else numbers % n


class MaxEnt:
    """Weights of both softmaxes, and how contexts are hashed to their rows.

    Contexts are kinds of words; ``member_of`` gives their members.  Without it members are all that is seen.
    """

    def __init__(self, options: Options, order: np.ndarray, member_tokens: np.ndarray, member_of: np.ndarray | None = None):
        o = self.options = options
        self.member_of = np.arange(o.total) if member_of is None else member_of
        position = np.empty(o.total, np.int64)
        position[order] = np.arange(o.total)
        self.klass, self.inner = position // o.members, position % o.members
        share = np.log((member_tokens[order] + 0.5) / (member_tokens.sum() + 0.5 * o.total)).reshape(o.classes, o.members)
        # rows of one table: hashed rows of the class softmax, its bias, hashed rows of the member softmax, its bias by class
        self.class_rows = 3 * o.total + 2 * o.pair_rows
        width = max(o.classes, o.members)
        self.table = np.zeros((self.class_rows + 1 + o.word_rows + o.classes, width), np.float32)
        self.table[self.class_rows, : o.classes] = np.logaddexp.reduce(share, axis=1)
        self.table[-o.classes :, : o.members] = share

    def rows(self, members: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows for the class softmax, and for the member softmax within the token's own class, of tokens after ``a`` (one
        place back), ``b`` and ``c``."""
        o = self.options
        pair = remainder(a * 7919 + b * 104_729, o.pair_rows)
        skip = remainder(a * 15_485_863 + c * 32_452_843, o.pair_rows)
        near, far, farther = (self.member_of[x] for x in (a, b, c))
        context = near, o.total + far, 2 * o.total + farther, 3 * o.total + pair, 3 * o.total + o.pair_rows + skip
        klass, seen = self.klass[members], len(self.member_of)
        first = np.stack([*context, np.full(len(members), self.class_rows)]).T
        hashed = [remainder((x * o.classes + klass) * 2_654_435_761 >> 7, o.word_rows) for x in (a, seen + b, 3 * seen + pair)]
        second = np.stack([*(h + (self.class_rows + 1) for h in hashed), self.class_rows + 1 + o.word_rows + klass]).T
        return first, second

    def softmaxes(self, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        out = []
        for rows, width in ((first, self.options.classes), (second, self.options.members)):
            # whole rows are taken faster than parts of them
            logits = self.table.take(rows[:, 0], axis=0)[:, :width]
            for k in range(1, rows.shape[1]):
                logits += self.table.take(rows[:, k], axis=0)[:, :width]
            out.append(softmax(logits))
        return out[0], out[1]

    def log10(self, kinds: np.ndarray, lengths: np.ndarray, at_once: int = 1 << 16) -> np.ndarray:
        """log10 of the probability of every token's member."""
        out = np.zeros(len(kinds))
        members, contexts = self.member_of[kinds], [before(kinds, lengths, k) for k in (1, 2, 3)]
        for i in range(0, len(members), at_once):
            m = members[i : i + at_once]
            p, q = self.softmaxes(*self.rows(m, *(x[i : i + at_once] for x in contexts)))
            row = np.arange(len(m))
            out[i : i + at_once] = np.log10(p[row, self.klass[m]].astype(float)) + np.log10(q[row, self.inner[m]].astype(float))
        return out

    def train(self, kinds: np.ndarray, lengths: np.ndarray, squares: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of gradient steps over small batches, with step sizes that shrink row by row."""
        o = self.options
        members, contexts = self.member_of[kinds], [before(kinds, lengths, k) for k in (1, 2, 3)]
        order = rng.permutation(len(members))
        for i in range(0, len(order), o.batch):
            some = order[i : i + o.batch]
            first, second = self.rows(members[some], *(x[some] for x in contexts))
            p, q = self.softmaxes(first, second)
            row = np.arange(len(some))
            p[row, self.klass[members[some]]] -= 1
            q[row, self.inner[members[some]]] -= 1
            for rows, error in ((first, p), (second, q)):
                for k in range(rows.shape[1]):
                    descend(self.table, squares, rows[:, k], error, o.rate)


class LanguageModel:
    """The parts of the model that every trainer has: softmaxes over classes and members, and over the lots of each group."""

    def __init__(self, options: Options, order: np.ndarray, vocabulary: Vocabulary):
        self.options = options
        self.members = MaxEnt(options, order, vocabulary.member_tokens, options.member_of_kind())
        lots = vocabulary.lot_tokens.reshape(-1, options.lots)
        rows = 16 + (lots.sum(axis=1) / max(1, lots.sum()) * (options.lot_rows - 16 * options.endings)).astype(np.int64)
        self.lots = Softmaxes(lots + 0.5, np.arange(options.endings), rows)

    def tables(self) -> list[np.ndarray]:
        return [self.members.table, self.lots.table]

    def weights(self) -> np.ndarray:
        """All weights, one table after the other."""
        return np.concatenate([t.ravel() for t in self.tables()])

    def no_squares(self) -> tuple[np.ndarray, np.ndarray]:
        return np.zeros(len(self.members.table), np.float32), np.zeros(len(self.lots.table), np.float32)

    def take(self, weights: np.ndarray) -> None:
        begin = 0
        for t in self.tables():
            t[:] = weights[begin : begin + t.size].reshape(t.shape)
            begin += t.size

    def in_groups(self, kinds: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """Which tokens are in groups; their groups and lots, and the kinds one and two places before."""
        o = self.options
        some = np.flatnonzero(kinds >= o.frequent)
        lot = (kinds[some] - o.frequent) // o.slots
        return some, lot // o.lots, lot % o.lots, before(kinds, lengths, 1)[some], before(kinds, lengths, 2)[some]

    def log10(self, kinds: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """log10 of the probability of every token's member, and lot where it has one."""
        out = self.members.log10(kinds, lengths)
        some, *steps = self.in_groups(kinds, lengths)
        out[some] += self.lots.log10(*steps)
        return out

    def train(self, kinds: np.ndarray, lengths: np.ndarray, squares: tuple[np.ndarray, np.ndarray], rng: np.random.Generator) -> None:
        self.members.train(kinds, lengths, squares[0], rng)
        _, *steps = self.in_groups(kinds, lengths)
        self.lots.train(*steps, squares[1], rng, self.options.rate, self.options.batch)


def fit(streams: DataFrame, vocabulary: Vocabulary, options: Options) -> LanguageModel:
    """Distributed training: in each round every trainer starts from the same weights and takes its share of the blocks; the
    weights are then averaged, weighted by tokens.  Over all rounds every training token is used once.

    The number of trainers follows the number of blocks.  Their tables are averaged part by part, some at a time, level by
    level; only the final table, of a fixed size, comes to the driver.
    """
    trainers = max(options.trainers, -(-streams.count() // (options.rounds * options.trainer_blocks)))
    model = LanguageModel(options, balanced_classes(neighbours(streams, options), options.classes), vocabulary)
    streams, length = streams.select("block", "kinds", "lengths"), 1 << 13
    for turn in range(options.rounds):
        shared = streams.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, squares, tokens = shared.value, None, 0
            start = own.weights()
            rng = np.random.default_rng(turn)
            for batch in batches:
                for data, lengths in zip(batch.column("kinds").to_pylist(), batch.column("lengths").to_pylist()):
                    kinds = unsqueezed(data)
                    squares = own.no_squares() if squares is None else squares
                    own.train(kinds, unsqueezed(lengths), squares, rng)
                    tokens += len(kinds)
            if tokens:
                trained = own.weights()
                parts = [trained[i : i + length] for i in range(0, len(start), length)]
                share = TaskContext.get().partitionId()
                columns = [range(len(parts)), [share] * len(parts), [tokens] * len(parts), [p.tobytes() for p in parts]]
                types = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(columns, types)], names=["part", "share", "tokens", "weights"]
                )
            own.take(start)  # a worker may be used again

        def mean(table: pa.Table) -> pa.Table:
            tokens = table.column("tokens").to_numpy().astype(float)
            rows = [np.frombuffer(w, np.float32) for w in table.column("weights").to_pylist()]
            total = sum(w * t for w, t in zip(rows, tokens / tokens.sum())).astype(np.float32)
            return pa.table(
                {
                    **{c: table.column(c).slice(0, 1) for c in ("part", "share")},
                    "tokens": pa.array([int(tokens.sum())]),
                    "weights": pa.array([total.tobytes()], pa.binary()),
                }
            )

        dealt = streams.where(F.pmod(F.xxhash64("block"), F.lit(options.rounds)) == turn).repartition(trainers, "block")
        schema = "part long, share long, tokens long, weights binary"
        trained, left = map_arrow(dealt, run, schema), trainers
        while left > 1:
            left = -(-left // options.averaged)
            shares = trained.withColumn("share", F.floor(F.col("share") / options.averaged))
            trained = shares.groupBy("part", "share").applyInArrow(mean, schema)
        weights = model.weights()
        for r in trained.collect():
            some = np.frombuffer(r.weights, np.float32)
            weights[r.part * length : r.part * length + len(some)] = some
        model.take(weights)
    return model


def score(docs: DataFrame, held_out: F.Column, options: Options = Options()) -> DataFrame:
    """Per document ``doc_id``, ``held_out``, ``n_tokens`` (words and one end), ``n_known`` tokens that the training texts
    have, ``train_tokens``, ``base_score`` and ``score``: log10 probabilities of the whole text, an empty one being its end.

    The training texts are those not ``held_out``.  ``base_score`` adds log10((c + s) / (N + s (V + 1))) over the tokens, with
    c a token's count, N all and V the distinct tokens in training, and s the smoothing; ``score`` is the model's.

    Texts are cut up once and kept, by block, in shared storage.  Counts of words are joined back to the blocks' own lists of
    words, not to tokens, so no word is hot.  What lies below lots is worked out part by part and added up by text; each block
    is then scored by itself.
    """
    blocks = materialise(tokenized(docs, held_out))
    counted = materialise(word_counts(blocks, options))
    vocabulary = vocabulary_of(counted, options)
    streams = materialise(word_streams(blocks, vocabulary.frequent, options))
    others = slice(options.frequent, None)
    parts = options.parts(int(vocabulary.member_tokens[others].sum()), int(vocabulary.member_words[others].sum()))
    below = materialise(word_sums(word_pieces(blocks, vocabulary.frequent, options, parts), options))
    shared = docs.sparkSession.sparkContext.broadcast((fit(streams, vocabulary, options), vocabulary))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, v = shared.value
        s = options.smoothing
        order = np.argsort(right.column("place").to_numpy())
        count = right.column("c").to_numpy()[order]
        base = np.log10((count + s) / (v.tokens + s * (v.words + 1)))
        out = []
        for i in range(left.num_rows):
            kinds, lengths, tokens = (unsqueezed(left.column(c)[i].as_py()) for c in ("places", "lengths", "tokens"))
            begins = np.cumsum(lengths) - lengths
            total = model.log10(kinds[tokens], lengths)
            sums = [np.add.reduceat(x, begins) for x in ((count[tokens] > 0).astype(np.int64), base[tokens], total)]
            for some, more in zip(left.column("some_texts")[i].as_py() or [], left.column("some_sums")[i].as_py() or []):
                sums[2][np.cumsum(unsqueezed(some))] += np.frombuffer(more, np.float32)
            ids = left.column("doc_ids")[i].values
            out.append(pa.table([ids, *map(pa.array, (lengths, *sums))], names=["doc_id", "n_tokens", "n_known", "base_score", "score"]))
        return pa.concat_tables(out)

    by_block = below.groupBy("block").agg(F.collect_list(F.struct("texts", "sums")).alias("sums"))
    by_block = by_block.selectExpr("block", "sums.texts AS some_texts", "sums.sums AS some_sums")
    texts = blocks.select("block", "tokens", "lengths", "doc_ids").join(streams.select("block", "places"), "block")
    texts = texts.join(by_block, "block", "left")
    known = counted.select("block", "place", "c")
    scored = texts.groupBy("block").cogroup(known.groupBy("block")).applyInArrow(run, SCORES)
    return scored.withColumn("train_tokens", F.lit(vocabulary.tokens).cast("long"))
