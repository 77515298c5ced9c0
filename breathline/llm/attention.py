"""Document quality by attention-based multiple-instance learning: a document is a bag of passages, and only it is labelled.

Every passage of a text is encoded; gated attention weighs the passages against each other; the weighted mean is scored.
Which passages matter is learnt from the labels of whole documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import map_arrow, slices, texts

# Classes of bytes; what stands between words comes first, bytes of longer characters count as letters.
_CLASSES = ("space", "newline", "lower", "upper", "digit", "stop", "symbol", "other")


def _byte_class(b: int) -> int:
    c = chr(b)
    if b > 0x7F or "a" <= c <= "z":
        return 2
    if c == "\n":
        return 1
    if c == " " or 9 <= b <= 13:
        return 0
    return 3 if "A" <= c <= "Z" else 4 if c.isdigit() else 5 if c in ".,;:!?" else 6 if c in "#*$%&|<>" else 7


_CLASS = np.array([_byte_class(b) for b in range(256)], np.int64)
_SHAPES = len(_CLASSES) ** 3
# besides shapes: shares of words equal to one of the four words before, word length, characters, words, newlines
_EXTRA = 8
FEATURES = _SHAPES + _EXTRA
_PRIME = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Options:
    passage_words: int = 64
    sample: int = 5000  # labelled documents to learn from, at most
    hidden: int = 24
    attention: int = 12
    epochs: int = 12
    batch: int = 64
    rate: float = 0.005
    decay: float = 1e-4
    seed: int = 11


def passage_features(column: pa.LargeStringArray, passage_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of all passages (``passage_words`` words each, a text's last one maybe fewer), and where each text's passages
    begin (one more at the end).  Words stand between ASCII white space.  A text without words is one passage of zeros.

    Features are how often each sequence of three byte classes occurs, relative to the passage, and a few shares that
    tell how words repeat.  They say nothing about which words there are, and so fit any language.
    """
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if n else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = _CLASS[data]
    inside = kind > 1
    first = np.zeros(len(data), bool)
    if len(data):
        first[1:] = inside[1:] & ~inside[:-1]
        begins = offsets[:-1][offsets[:-1] < offsets[1:]]
        first[begins] = inside[begins]
    start = np.flatnonzero(first)
    word_begin = np.searchsorted(start, offsets)
    n_words = np.diff(word_begin)
    passages = np.maximum(1, -(-n_words // passage_words))
    bag = np.concatenate([[0], np.cumsum(passages)])
    total = int(bag[-1])
    if not len(start):
        return np.zeros((total, FEATURES), np.float32), bag
    document = np.repeat(np.arange(n), n_words)
    passage = bag[document] + (np.arange(len(start)) - word_begin[document]) // passage_words
    # a byte belongs to the word that began last; those before a text's first word are left out
    word = np.cumsum(first) - 1
    text = np.repeat(np.arange(n), np.diff(offsets))
    owned = word >= word_begin[text]
    code = kind[:-2] * 64 + kind[1:-1] * 8 + kind[2:] if len(kind) > 2 else np.zeros(0, np.int64)
    at = np.flatnonzero(owned[: len(code)] & (text[: len(code)] == text[2:]))
    cell = passage[word[at]] * _SHAPES + code[at]
    shapes = np.bincount(cell, minlength=total * _SHAPES).reshape(total, _SHAPES).astype(np.float32)
    size = np.bincount(passage[word[owned]], minlength=total)
    shapes /= np.maximum(size, 1)[:, None]
    # words as numbers: a running sum of bytes times powers, of which a word's own part is taken and shifted to the front
    stop = np.append(start[1:], len(data))
    powers = np.cumprod(np.full(64, _PRIME))
    place = np.arange(len(data)) - start[np.maximum(word, 0)]
    value = np.where(inside & owned, (data.astype(np.uint64) + np.uint64(1)) * powers[place % 64], np.uint64(0))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
    number = sums[stop] - sums[start]
    length = np.bincount(word[inside & owned], minlength=len(start))
    words_in = np.maximum(np.bincount(passage, minlength=total), 1)
    extra = np.zeros((total, _EXTRA), np.float32)
    for lag in range(1, 5):
        same = (number[lag:] == number[:-lag]) & (document[lag:] == document[:-lag])
        extra[:, lag - 1] = np.bincount(passage[lag:][same], minlength=total) / words_in
    # words and blank stretches have no greatest length; on a log scale they fit half precision, and one outlier spreads little
    extra[:, 4] = np.log1p(np.bincount(passage, weights=length, minlength=total) / words_in) / 2
    extra[:, 5] = np.bincount(passage, weights=length > 14, minlength=total) / words_in
    extra[:, 6] = np.log1p(np.bincount(passage, minlength=total)) / 4
    extra[:, 7] = np.log1p(np.bincount(passage[word[owned & (kind == 1)]], minlength=total) / words_in)
    return np.concatenate([shapes, extra], axis=1), bag


class AttentionModel:
    """Encoder ``tanh(x E)``; attention ``softmax(w . (tanh(h V) * sigmoid(h U)))`` over a document's passages; logistic
    output on the weighted mean."""

    def __init__(self, options: Options):
        rng = np.random.default_rng(options.seed)
        h, a = options.hidden, options.attention
        self.options = options
        self.mean, self.spread = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)
        self.p = {
            "E": rng.normal(0, FEATURES**-0.5, (FEATURES, h)),
            "V": rng.normal(0, h**-0.5, (h, a)),
            "U": rng.normal(0, h**-0.5, (h, a)),
            "w": rng.normal(0, a**-0.5, a),
            "c": rng.normal(0, h**-0.5, h),
            "b": np.zeros(1),
        }
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def _forward(self, x: np.ndarray, bag: np.ndarray):
        p = self.p
        h = np.tanh(x @ p["E"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        e = (t * g) @ p["w"]
        starts, sizes = bag[:-1], np.diff(bag)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(a[:, None] * h, starts, axis=0)
        return z @ p["c"] + p["b"][0], (h, t, g, a, z, starts, sizes)

    def probability(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        logit = self._forward((x - self.mean) / self.spread, bag)[0]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30).astype(float)))

    def attention(self, x: np.ndarray, bag: np.ndarray) -> np.ndarray:
        """Weight of every passage in its document."""
        return self._forward((x - self.mean) / self.spread, bag)[1][3]

    def _gradients(self, x: np.ndarray, bag: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        p = self.p
        logit, (h, t, g, a, z, starts, sizes) = self._forward(x, bag)
        error = ((1 / (1 + np.exp(-logit)) - wanted) / len(wanted)).astype(np.float32)
        d_z = np.repeat(error[:, None] * p["c"], sizes, axis=0)
        d_a = (d_z * h).sum(axis=1)
        d_e = a * (d_a - np.repeat(np.add.reduceat(a * d_a, starts), sizes))
        d_t, d_g = d_e[:, None] * p["w"] * g * (1 - t * t), d_e[:, None] * p["w"] * t * g * (1 - g)
        d_h = a[:, None] * d_z + d_t @ p["V"].T + d_g @ p["U"].T
        d_h = d_h * (1 - h * h)
        return {
            "E": x.T @ d_h,
            "V": h.T @ d_t,
            "U": h.T @ d_g,
            "w": (t * g).T @ d_e,
            "c": z.T @ error,
            "b": np.array([error.sum()], np.float32),
        }

    def fit(self, x: np.ndarray, bag: np.ndarray, labels: np.ndarray) -> None:
        """Adam over small batches of documents.  ``x`` is standardised in place, since it is large."""
        o, rng = self.options, np.random.default_rng(self.options.seed)
        self.mean = x.mean(axis=0)
        variance = sum(np.square(x[i : i + 1024] - self.mean).sum(axis=0) for i in range(0, len(x), 1024)) / len(x)
        self.spread = np.maximum(np.sqrt(variance), 0.02).astype(np.float32)
        x -= self.mean
        x /= self.spread
        mean, square, step = {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        for _ in range(o.epochs):
            order = rng.permutation(len(labels))
            for i in range(0, len(order), o.batch):
                some = order[i : i + o.batch]
                own = np.concatenate([[0], np.cumsum(bag[some + 1] - bag[some])])
                rows = np.concatenate([np.arange(bag[k], bag[k + 1]) for k in some])
                step += 1
                for k, grad in self._gradients(x[rows], own, labels[some]).items():
                    grad = grad + o.decay * self.p[k]
                    mean[k] = 0.9 * mean[k] + 0.1 * grad
                    square[k] = 0.999 * square[k] + 0.001 * grad * grad
                    rate = o.rate * (1 - 0.999**step) ** 0.5 / (1 - 0.9**step)
                    self.p[k] = (self.p[k] - rate * mean[k] / (np.sqrt(square[k]) + 1e-8)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, options: Options = Options()) -> AttentionModel | float:
    """The model, from at most ``options.sample`` of the ``labels`` (``doc_id``, ``label`` 0 or 1), the first in a fixed
    random order; or, where these are all alike or none, the share of 1 (a half of none).

    Labels that are null or contradict each other for one document are left out.  Only passages of the sample reach the
    driver.
    """
    agreed = (
        labels.where("doc_id IS NOT NULL AND label IN (0, 1)")
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"), F.max("label").alias("most"))
        .where("label = most")
        .select("doc_id", "label")
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(options.sample)
    )
    # the sample has a bound, so it may be broadcast to the texts
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(
        F.broadcast(agreed), "doc_id"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for part in slices(texts(batch.column("text"))):
                x, bag = passage_features(part, options.passage_words)
                x = x.astype(np.float16)
                data += [x[a:b].tobytes() for a, b in zip(bag, bag[1:])]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array(data, pa.binary())], names=["doc_id", "label", "x"]
            )

    rows = map_arrow(chosen.repartition(1 + options.sample // 500, "doc_id"), run, "doc_id long, label int, x binary")
    # rows that share an id would exceed the bound
    rows = sorted(rows.orderBy("doc_id", "x").limit(options.sample).collect(), key=lambda r: (r.doc_id, r.x))
    wanted = np.array([r.label for r in rows], np.float32)
    if not len(rows) or wanted.min() == wanted.max():
        return float(wanted.mean()) if len(rows) else 0.5
    model = AttentionModel(options)
    bag = np.concatenate([[0], np.cumsum([len(r.x) // (2 * FEATURES) for r in rows])])
    x = np.empty((bag[-1], FEATURES), np.float32)
    for i, r in enumerate(rows):
        x[bag[i] : bag[i + 1]] = np.frombuffer(r.x, np.float16).reshape(-1, FEATURES)
    del rows
    model.fit(x, bag, wanted)
    return model


def score_quality(docs: DataFrame, model: AttentionModel | float, passage_words: int = Options.passage_words) -> DataFrame:
    """``doc_id`` and ``score``, the probability of label 1, of every whole text; an empty one is a passage without words.

    Long texts are scored in full; a task holds the passages of some four megabytes of text, or of one longer text.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [np.zeros(0)]
            for part in slices(texts(batch.column("text"))):
                if isinstance(shared.value, float):
                    scores.append(np.full(len(part), shared.value))
                else:
                    scores.append(shared.value.probability(*passage_features(part, passage_words)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(np.concatenate(scores))], names=["doc_id", "score"]
            )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(given, run, "doc_id long, score double")
