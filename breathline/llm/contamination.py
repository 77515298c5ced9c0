"""Benchmark passages in training documents, by a positional inverted index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import materialise
from .language_model import squeezed, unsqueezed
from .text import LOWER_ALNUM, gathered, keyed, map_arrow, mapped, row_key, slices, texts, words

SEGMENT = (
    "vocabulary array<string>, counts binary, postings binary, first_position binary, n_words binary, gap int, "
    "doc_ids array<long>, keys array<struct<a: long, b: long>>"
)
# Text of a segment: building and searching one takes a worker some ten times that; each repeats its terms and is searched once.
SEGMENT_BYTES = 4 << 20
FOUND = (
    "doc_id long, key struct<a: long, b: long>, n_words long, spans array<struct<start: long, end: long>>, "
    "items array<string>, near_items array<string>"
)


def _numbers(array: pa.Array) -> np.ndarray:
    return array.to_numpy(zero_copy_only=False).astype(np.int64)


class TestSet:
    """The phrases to look for, as stretches of the items' term numbers, each once; for every phrase, the items that have it.

    Terms are numbered in the order of the words, items in that of their ids; all of it is flat arrays, a few times the size of
    the items' text.
    """

    def __init__(self, items: pa.Array, texts_: pa.LargeStringArray, window: int):
        flat, begins = words(mapped(texts_, LOWER_ALNUM))
        coded = pc.dictionary_encode(flat)
        in_order = pc.sort_indices(coded.dictionary)
        self.vocabulary: pa.LargeStringArray = coded.dictionary.take(in_order)
        number = np.empty(len(in_order), np.int32)
        number[_numbers(in_order)] = np.arange(len(in_order))
        self.terms = number[_numbers(coded.indices)]
        self.items = sorted({i for i in items.to_pylist() if i is not None})
        self.owner = _numbers(pc.index_in(items, value_set=pa.array(self.items, items.type)).fill_null(-1))
        self.begins = begins
        size = np.diff(begins)
        # a window begins at each word with enough words of its item behind it; a shorter item is one window
        n_windows = np.where(size > 0, np.maximum(1, size - window + 1), 0)
        which = np.repeat(np.arange(len(size)), n_windows)
        start = begins[which] + np.arange(len(which)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
        length = np.minimum(size, window)[which]
        self.phrases: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            own, some = start[length == n], self.owner[which[length == n]]
            rows = np.ascontiguousarray(self.stretches(own, n)).view(np.dtype((np.void, 4 * n))).ravel()
            _, first, phrase = np.unique(rows, return_index=True, return_inverse=True)
            pairs = np.unique(np.stack([phrase, some], axis=1)[some >= 0], axis=0)
            owners = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1))
            self.phrases.append((n, own[first].astype(np.int32), owners, pairs[:, 1]))

    def stretches(self, starts: np.ndarray, n: int) -> np.ndarray:
        return self.terms[starts[:, None] + np.arange(n)]

    def choose_rarest(self, counts: np.ndarray, rarest: int) -> None:
        """For every item with more than two different words, its rarest ones, from the rarest on, by how often all documents
        have them and then by the word.  An item with a word that none has stands near nowhere."""
        self.rarest: list[tuple[int, np.ndarray]] = []
        for item, a, b in zip(self.owner.tolist(), self.begins[:-1].tolist(), self.begins[1:].tolist()):
            own = np.unique(self.terms[a:b])
            if item >= 0 and len(own) > 2:
                own = own[np.argsort(counts[own], kind="stable")[:rarest]]
                if counts[own[0]]:
                    self.rarest.append((item, own))


def _held(values: np.ndarray, sorted_values: np.ndarray) -> np.ndarray:
    at = np.searchsorted(sorted_values, values)
    at[at == len(sorted_values)] = 0
    return sorted_values[at] == values if len(sorted_values) else np.zeros(len(values), bool)


def _numbered(column: pa.LargeStringArray) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """The distinct words of all texts by first occurrence, every word as a place in that list, and how many words each text has.

    Words take many times the space of their texts, so only some texts are held as words at a time.
    """
    coded, n_words = [], []
    for part in slices(column, 2 << 20):
        flat, begins = words(mapped(part, LOWER_ALNUM))
        coded.append(pc.dictionary_encode(flat))
        n_words.append(np.diff(begins))
    chunks = pa.chunked_array(coded).unify_dictionaries().chunks
    term = np.concatenate([c.indices.to_numpy(zero_copy_only=False) for c in chunks])
    return chunks[0].dictionary.cast(pa.string()), term, np.concatenate(n_words)


def index_documents(docs: DataFrame, gap: int = 17) -> DataFrame:
    """The positional inverted index of whole documents: one row, a segment, per some megabytes of them, with every term that
    occurs there and the sorted positions at which it does.

    A position counts words through all documents of the segment, with ``gap`` unused positions after each document, so no
    phrase and no neighbourhood of less than ``gap`` words reaches from one document into the next.  Lists are kept as
    differences and compressed.  The index knows nothing of any benchmark: written once, it serves them all.
    """

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(texts(batch.column("text")), SEGMENT_BYTES):
                yield segment(part, *(batch.column(c).slice(done, len(part)) for c in ("doc_id", "key")))
                done += len(part)

    def segment(column: pa.LargeStringArray, *names: pa.Array) -> pa.RecordBatch:
        vocabulary, term, n_words = _numbered(column)
        counts = np.bincount(term, minlength=len(vocabulary))
        before = gap * np.arange(len(n_words))
        first = np.cumsum(n_words) - n_words + before
        # four bytes a position, as the lists are kept
        position = np.arange(len(term), dtype=np.uint32)
        position += np.repeat(before.astype(np.uint32), n_words)
        position = position[np.argsort(term, kind="stable")]
        at = np.cumsum(counts) - counts
        steps = np.diff(position, prepend=np.uint32(0))
        steps[at] = position[at]
        return pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(pa.array([0, len(vocabulary)], pa.int32()), vocabulary),
                *(pa.array([squeezed(x)], pa.binary()) for x in (counts, steps, first, n_words)),
                pa.array([gap], pa.int32()),
                *(pa.ListArray.from_arrays(pa.array([0, len(column)], pa.int32()), c) for c in names),
            ],
            names=["vocabulary", "counts", "postings", "first_position", "n_words", "gap", "doc_ids", "keys"],
        )

    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        row_key("doc_id", "text").alias("key"),
        F.col("text").cast("string").alias("text"),
    )
    return map_arrow(given, build, SEGMENT)


def _known(batch: pa.RecordBatch, i: int, vocabulary: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a segment, the places in its list of terms that hold a term of ``vocabulary``, these terms' numbers, and how often it
    has each of its terms."""
    own = batch.column("vocabulary")[i].values.cast(pa.large_string())
    number = _numbers(pc.index_in(own, value_set=vocabulary).fill_null(-1))
    places = np.flatnonzero(number >= 0)
    return places, number[places], unsqueezed(batch.column("counts")[i].as_py())


def term_counts(index: DataFrame, vocabulary: pa.LargeStringArray) -> np.ndarray:
    """How often all indexed documents have each term of ``vocabulary``."""
    shared = index.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                places, numbers, counts = _known(batch, i, shared.value)
                yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(counts[places])], names=["term", "n"])

    rows = map_arrow(index.select("vocabulary", "counts"), run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found, out = rows.toArrow(), np.zeros(len(vocabulary), np.int64)
    out[_numbers(found.column("term").combine_chunks())] = _numbers(found.column("n").combine_chunks())
    return out


class Segment:
    """The postings of some terms in one segment; other terms are not unpacked."""

    def __init__(self, batch: pa.RecordBatch, i: int, vocabulary: pa.LargeStringArray):
        places, numbers, counts = _known(batch, i, vocabulary)
        steps, self.first, self.n_words = (unsqueezed(batch.column(c)[i].as_py()) for c in ("postings", "first_position", "n_words"))
        self.gap = batch.column("gap")[i].as_py()
        steps = gathered(steps, np.cumsum(counts) - counts, counts, places)
        counts = counts[places]
        begins = np.cumsum(counts) - counts
        self.count = np.zeros(len(vocabulary), np.int64)
        self.count[numbers] = counts
        self.begin = np.zeros(len(vocabulary), np.int64)
        self.begin[numbers] = begins
        # running sums within each list
        total = np.cumsum(steps)
        self.position = total - np.repeat(total[begins] - steps[begins], counts) if len(steps) else total

    def postings(self, term: int) -> np.ndarray:
        return self.position[self.begin[term] : self.begin[term] + self.count[term]]

    def starts(self, phrase: np.ndarray) -> np.ndarray:
        """Where the phrase begins: lists shifted by each term's offset, intersected from the rarest term on."""
        order = np.argsort(self.count[phrase], kind="stable")
        found = self.postings(phrase[order[0]]) - order[0]
        for j in order[1:]:
            if not len(found):
                break
            found = found[_held(found + j, self.postings(phrase[j]))]
        return found

    def together(self, terms: np.ndarray, within: int) -> np.ndarray:
        """Positions of the first term that have all others at most ``within`` words away."""
        found = self.postings(terms[0])
        for term in terms[1:]:
            other = self.postings(term)
            if not len(found) or not len(other):
                return found[:0]
            at = np.minimum(np.searchsorted(other, found - within), len(other) - 1)
            found = found[np.abs(other[at] - found) <= within]
        return found

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, position, side="right") - 1


def _search(segment: Segment, tests: TestSet, near: int) -> tuple[list[list[dict]], list[set], list[set]]:
    n_docs = len(segment.n_words)
    items: list[set] = [set() for _ in range(n_docs)]
    close: list[set] = [set() for _ in range(n_docs)]
    end = int(segment.first[-1] + segment.n_words[-1]) if n_docs else 0
    change = np.zeros(end + 1, np.int32)
    for length, begins, owners, owner in tests.phrases:
        for some in range(0, len(begins), 1 << 16):
            matrix = tests.stretches(begins[some : some + (1 << 16)], length)
            for p in np.flatnonzero(segment.count[matrix].min(axis=1) > 0).tolist():
                starts = segment.starts(matrix[p])
                if len(starts):
                    change[starts] += 1
                    change[starts + length] -= 1
                    having = owner[owners[some + p] : owners[some + p + 1]].tolist()
                    for d in np.unique(segment.document(starts)).tolist():
                        items[d].update(having)
    for item, terms in tests.rarest:
        if segment.count[terms].min() > 0:
            for d in np.unique(segment.document(segment.together(terms, near))).tolist():
                close[d].add(item)
    hit = np.cumsum(change) > 0
    edges = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8))).reshape(-1, 2)
    spans: list[list[dict]] = [[] for _ in range(n_docs)]
    owner = segment.document(edges[:, 0]) if len(edges) else np.zeros(0, np.int64)
    for d, (a, b) in zip(owner.tolist(), edges.tolist()):
        spans[d].append({"start": a - int(segment.first[d]), "end": b - int(segment.first[d])})
    return spans, items, close


def _found(index: DataFrame, tests: TestSet, near: int) -> DataFrame:
    """One row per indexed document; a task holds one segment at a time."""
    shared = index.sparkSession.sparkContext.broadcast(tests)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tests = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                segment = Segment(batch, i, tests.vocabulary)
                if near >= segment.gap:
                    raise ValueError(f"an index with gaps of {segment.gap} words cannot tell what is {near} words near")
                spans, items, close = _search(segment, tests, near)
                named = ([[tests.items[k] for k in sorted(x)] for x in some] for some in (items, close))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("doc_ids")[i].values,
                        batch.column("keys")[i].values,
                        pa.array(segment.n_words),
                        pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
                        *(pa.array(x, pa.list_(pa.string())) for x in named),
                    ],
                    names=["doc_id", "key", "n_words", "spans", "items", "near_items"],
                )

    return map_arrow(index, search, FOUND)


def search_index(
    index: DataFrame, benchmark: DataFrame, window: int = 13, near: int = 16, rarest: int = 4, block_bytes: int = 4 << 20
) -> DataFrame:
    """``find_contamination`` in documents that ``index_documents`` has indexed, with a gap of more than ``near``.

    Test items are taken in blocks of about ``block_bytes`` of text (or one longer item), spread by hash; only one block's
    phrases are ever on the driver and broadcast.  Each block is one pass over the index, which unpacks the postings of the
    block's own terms, after one over its lists of terms for how rare these are in all documents.
    """
    given = benchmark.select(F.col("item_id").cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    given = given.where(F.length("text") > 0).distinct()
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-total // block_bytes))
    found = []
    for block in range(blocks):
        part = given.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == block).toArrow()
        tests = TestSet(part.column("item").combine_chunks(), texts(part.column("text")), window)
        tests.choose_rarest(term_counts(index, tests.vocabulary), rarest)
        found.append(_found(index, tests, near))
    return found[0] if len(found) == 1 else _merged(found)


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 13,
    near: int = 16,
    rarest: int = 4,
    block_bytes: int = 4 << 20,
) -> DataFrame:
    """Exact and close occurrences of ``benchmark`` items (``item_id``, ``text``) in whole documents, one row per document.

    Texts are lower-cased (A-Z) and cut into words of letters, digits and characters beyond ASCII.  ``spans`` are the
    stretches of words covered by windows of ``window`` consecutive item words (a shorter item is one window), disjoint and
    in order; ``items`` the items with such a window, ``near_items`` those with more than two different words whose ``rarest``
    rarest ones, counted over all documents, stand at most ``near`` words from the rarest of them.  ``key`` identifies the
    row's content.

    The index of all documents is written to shared storage in one pass, without a shuffle, and searched without one.  To
    search it for several benchmarks, use ``index_documents`` and ``search_index``.

    Rows of one ``item_id`` are one item; an item without id marks words but is not listed.  Null and empty texts have no
    words and an empty benchmark marks nothing.
    """
    return search_index(materialise(index_documents(docs, near + 1)), benchmark, window, near, rarest, block_bytes)


def _merged(found: list[DataFrame]) -> DataFrame:
    """Results of several blocks: rows of the same content have the same spans, so sets of them stay small."""
    every = found[0]
    for other in found[1:]:
        every = every.unionByName(other)

    def gathered(name: str) -> F.Column:
        return F.flatten(F.collect_set(name))

    whole = every.groupBy("key", "doc_id", "n_words").agg(
        (F.count("*") / len(found)).cast("int").alias("copies"),
        F.array_sort(gathered("spans")).alias("spans"),
        *[F.array_sort(F.array_distinct(gathered(c))).alias(c) for c in ("items", "near_items")],
    )
    # overlapping and touching spans become one
    joined = """aggregate(spans, CAST(array() AS array<struct<start: bigint, end: bigint>>), (done, s) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).end >= s.start
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
                  'start', element_at(done, -1).start, 'end', greatest(element_at(done, -1).end, s.end))))
             ELSE concat(done, array(s)) END)"""
    return whole.selectExpr(
        "doc_id", "key", "n_words", f"{joined} AS spans", "items", "near_items", "explode(sequence(1, copies)) AS copy"
    ).drop("copy")


def words_hit() -> F.Column:
    """Number of words under ``spans``."""
    return F.expr("aggregate(spans, 0L, (n, s) -> n + s.end - s.start)")


def is_contaminated(share: int = 20) -> F.Column:
    """One word in ``share`` or more is under a span."""
    return (words_hit() > 0) & (share * words_hit() >= F.col("n_words"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, share: int = 20, **options) -> DataFrame:
    """The documents less those that are contaminated; all columns stay."""
    bad = find_contamination(docs, benchmark, **options).where(is_contaminated(share)).select("key.a", "key.b").distinct()
    return keyed(docs, "doc_id", "text").join(bad, ["a", "b"], "left_anti").select("doc.*")
