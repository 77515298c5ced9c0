"""Secrets in documents: fixed patterns, and a small character network that judges everything else that could be one."""

from __future__ import annotations

import copy
import random
import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.lineage import materialise
from .text import map_arrow, slices, texts

# The patterns.  Of the last two, a run that is too short holds no longer one, so the least length can stand
# in the pattern; a match of the first that fails still uses up its text.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII
)
ASSIGN_LEAST = 12
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "model")
# What the network judges: runs that mix letters and digits, and longer ones that mix cases.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
CANDIDATE_MARK = re.compile(r"[A-Za-z0-9+/_=-]")
_LETTER, _DIGIT, _MIXED = re.compile(r"[A-Za-z]"), re.compile(r"[0-9]"), re.compile(r"[a-z][A-Z]")
MIXED_LEAST = 12
# What it sees of other text while it learns: one in so many ordinary words, by hash.
WORD = re.compile(r"[^\W\d_]{8,}")
ONE_WORD_IN = 97

_HEX_BYTES = np.array([chr(b) in "0123456789abcdef" for b in range(256)])
_RUN_BYTES = np.array([b < 128 and (chr(b).isalnum() or chr(b) in "+/_=-") for b in range(256)])
_DIGIT_BYTES = np.array([chr(b) in "0123456789" for b in range(256)])
_LOWER_BYTES = np.array([b < 128 and chr(b).islower() for b in range(256)])
_UPPER_BYTES = np.array([b < 128 and chr(b).isupper() for b in range(256)])

FINDING = "label int, text string, begin int, end int"
PACKED = "block long, codes binary, sizes array<int>, begins array<int>, ends array<int>, secret array<boolean>"
STATES = "share long, block long, findings long, state binary"
SPANS = "spans array<struct<kind: string, start: long, end: long, score: double>>"


# planted findings ------------------------------------------------------------------------------------------------

_LOWER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "0123456789"
_ALNUM = _LOWER + _LOWER.upper() + _DIGITS


def _drawn(rng: random.Random, alphabet: str, least: int, most: int | None = None) -> str:
    return "".join(rng.choices(alphabet, k=rng.randint(least, most or least)))


# Secrets of forms that the patterns do not know.
PLANTED: dict[str, Callable[[random.Random], str]] = {
    "base64": lambda r: _drawn(r, _ALNUM + "+/", 4 * r.randint(5, 12) - 1) + "=",
    "alphanumeric": lambda r: _drawn(r, _ALNUM, 16, 40),
    "upper hex": lambda r: _drawn(r, _DIGITS + "ABCDEF", r.choice((16, 24, 32, 40))),
    "base32": lambda r: _drawn(r, _LOWER.upper() + "234567", 16, 32),
    "short hex": lambda r: _drawn(r, _DIGITS + "abcdef", 10, 15),
    "uuid": lambda r: "-".join(_drawn(r, _DIGITS + "abcdef", n) for n in (8, 4, 4, 4, 12)),
    "prefixed": lambda r: _drawn(r, _LOWER, 2, 4) + "_" + _drawn(r, _ALNUM, 20, 36),
    "grouped": lambda r: "-".join(_drawn(r, _LOWER.upper() + _DIGITS, 5) for _ in range(r.randint(3, 5))),
}
# Harmless runs of the same characters, made of words of the text.
LOOKALIKES: dict[str, Callable[[random.Random, list[str]], str]] = {
    "numbered": lambda r, w: r.choice(w) + _drawn(r, _DIGITS, 1, 4),
    "hyphenated": lambda r, w: "-".join([*r.choices(w, k=r.randint(1, 3)), _drawn(r, _DIGITS, 1, 3)]),
    "snake case": lambda r, w: "_".join([*r.choices(w, k=r.randint(1, 3)), _drawn(r, _DIGITS, 1, 2)]).lower(),
    "camel case": lambda r, w: r.choice(w).lower() + "".join(x.capitalize() for x in r.choices(w, k=r.randint(1, 3))),
    "constant": lambda r, w: "_".join([*r.choices(w, k=r.randint(1, 3)), _drawn(r, _DIGITS, 1, 2)]).upper(),
    "dated": lambda r, w: f"{r.choice(w)}-{r.randint(1970, 2039)}-{r.randint(1, 12):02}-{r.randint(1, 28):02}",
    "path": lambda r, w: "/".join([*r.choices(w, k=r.randint(1, 3)), f"v{r.randint(1, 20)}"]),
}
# What may stand before either, so that it tells nothing.
_LEADS = ("", "", "", "key: ", "id: ", "ref ", "auth ", "\"")
_PLAIN_WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{3,}")


@dataclass(frozen=True)
class Options:
    before: int = 32  # characters of context on either side of a candidate
    after: int = 16
    embedding: int = 8
    filters: int = 24
    width: int = 5
    epochs: int = 12
    block: int = 8192  # findings that one trainer takes; more findings mean more trainers
    averaged: int = 32  # sums of weights that come to the driver after an epoch, at most
    recall: float = 0.98  # of labelled secrets not trained on, the share that a threshold must catch
    fewest: int = 30  # findings of either label; with fewer there is nothing to learn from, and no network
    stretch: int = 1024  # characters of a finding in one training window; a longer finding gives several
    planted: tuple[str, ...] = tuple(PLANTED)  # kinds of secrets put into ordinary text to learn from
    lookalikes: tuple[str, ...] = tuple(LOOKALIKES)  # kinds of harmless identifiers put there
    one_text_in: int = 4  # texts, by hash, has them put in; every distinct text counts
    seed: int = 7


# For whole tables: every text shows the network a planted secret and a look-alike.
EVERY_TEXT = Options(one_text_in=1)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all matches of the patterns, in order."""
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end() - m.start(2) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, taken: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """Runs of mixed characters that touch no span of the patterns."""
    found = []
    for m in CANDIDATE.finditer(text):
        if _DIGIT.search(m[0]) and _LETTER.search(m[0]) or len(m[0]) >= MIXED_LEAST and _MIXED.search(m[0]):
            found.append(m.span())
    if not found or not taken:
        return found
    starts = np.array([a for a, _, _ in taken])
    reach = np.maximum.accumulate([b for _, _, b in taken])
    i = np.searchsorted(starts, [b for _, b in found], side="left")
    return [c for c, k in zip(found, i.tolist()) if k == 0 or reach[k - 1] <= c[0]]


def suspects(column: pa.LargeStringArray) -> np.ndarray:
    """Which texts can hold anything at all: those with an assignment sign, the start of an access key id, a long hexadecimal
    run, a run with a digit, or a capital after a small letter.  Found on bytes, many texts at once; runs end with their text,
    and a mark of several bytes over the end of a text only adds a suspect."""
    return np.concatenate([np.zeros(0, bool), *map(_suspects, slices(column))])


def _suspects(column: pa.LargeStringArray) -> np.ndarray:
    n = len(column)
    hit = np.zeros(n, bool)
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]

    def mark(places: np.ndarray) -> None:
        hit[np.searchsorted(offsets, places, side="right") - 1] = True

    mark(np.flatnonzero((data == ord("=")) | (data == ord(":"))))
    mark(np.flatnonzero(_LOWER_BYTES[data[:-1]] & _UPPER_BYTES[data[1:]]))
    # key ids need no digit
    mark(_places(data, b"AKIA"))
    for table, least, digits in ((_HEX_BYTES, 16, False), (_RUN_BYTES, 8, True)):
        inside = table[data]
        # a byte outside any run, or one of another text, on either side
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        starts = offsets[:-1][offsets[:-1] < offsets[1:]]
        ends = offsets[1:][offsets[:-1] < offsets[1:]] - 1
        first[starts], last[ends] = inside[starts], inside[ends]
        begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
        long = end - begin >= least
        begin, end = begin[long], end[long]
        if digits and len(begin):
            before = np.concatenate([[0], np.cumsum(_DIGIT_BYTES[data])])
            some = before[end] > before[begin]
            begin, end = begin[some], end[some]
        mark(begin)
    return hit


def _places(data: np.ndarray, wanted: bytes) -> np.ndarray:
    """Where the bytes stand."""
    at = np.flatnonzero(data[: max(0, len(data) - len(wanted) + 1)] == wanted[0])
    for k in range(1, len(wanted)):
        at = at[data[at + k] == wanted[k]]
    return at


def window(text: str, begin: int, end: int, options: Options) -> tuple[str, int, int]:
    left = max(0, begin - options.before)
    return text[left : end + options.after], begin - left, end - left


# the network -----------------------------------------------------------------------------------------------------

# Characters: printable ASCII, white space, anything else, and padding.
_OTHER, _SPACE, _PAD, _CODES = 95, 96, 97, 98


def _codes(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32).astype(np.int64)
    return np.where((points > 32) & (points < 127), points - 32, np.where((points == 32) | ((points > 8) & (points < 14)), _SPACE, _OTHER))


@dataclass
class Windows:
    """Windows as codes of their characters, one after the other; begins and ends of the candidates count from the window's."""

    codes: np.ndarray
    sizes: np.ndarray
    begins: np.ndarray
    ends: np.ndarray

    def __post_init__(self):
        self.starts = np.cumsum(self.sizes) - self.sizes

    @classmethod
    def of(cls, windows: list[tuple[str, int, int]]) -> Windows:
        sizes, begins, ends = (np.array(c, np.int64) for c in ([len(t) for t, _, _ in windows], *list(zip(*windows))[1:]))
        return cls(_codes("".join(t for t, _, _ in windows)), sizes, begins, ends)


class CharNetwork:
    """Embedded characters, one convolution over candidate and context, the largest and the mean response of each filter,
    and a logistic output.  A character also says whether it is inside the candidate.  Windows may have any length."""

    def __init__(self, options: Options):
        self.options = options
        rng = np.random.default_rng(options.seed)
        depth, f, w = options.embedding + 1, options.filters, options.width
        self.p = {
            "embed": rng.normal(0, 0.3, (_CODES, options.embedding)),
            "conv": rng.normal(0, (2 / (w * depth)) ** 0.5, (w * depth, f)),
            "bias": np.zeros(f),
            "out": rng.normal(0, 0.1, 2 * f),
            "shift": np.zeros(1),
        }
        self.p["embed"][_PAD] = 0
        # running means of the gradients and of their squares, and the steps made
        self.mean, self.square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        self.step = 0.0
        self.scale, self.offset = 1.0, 0.0
        self.thresholds: dict[str, float] = {}
        self.precision: dict[str, float | None] = {}

    def _padded(self, windows: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
        return self._batch(Windows.of(windows), np.arange(len(windows)))

    def _batch(self, windows: Windows, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        sizes = windows.sizes[some][:, None]
        place = np.arange(sizes.max() + self.options.width - 1) - self.options.width // 2
        at = np.clip(windows.starts[some][:, None] + place, 0, max(0, len(windows.codes) - 1))
        codes = np.where((place >= 0) & (place < sizes), windows.codes[at] if len(windows.codes) else _PAD, _PAD)
        inside = (place >= windows.begins[some][:, None]) & (place < windows.ends[some][:, None])
        return codes, inside.astype(self.p["embed"].dtype)

    def _forward(self, codes: np.ndarray, inside: np.ndarray):
        p, w = self.p, self.options.width
        x = np.concatenate([p["embed"].take(codes, axis=0), inside[:, :, None]], axis=2)
        n, length, depth = x.shape
        patches = np.lib.stride_tricks.sliding_window_view(x, w, axis=1).transpose(0, 1, 3, 2).reshape(-1, w * depth)
        response = patches @ p["conv"]
        response += p["bias"]
        response = np.maximum(response, 0, out=response).reshape(n, length - w + 1, -1)
        # positions whose middle character is padding do not count
        real = (codes[:, w // 2 : w // 2 + length - w + 1] != _PAD)[:, :, None]
        response *= real
        size = real.sum(axis=1).astype(response.dtype)
        pooled = np.concatenate([response.max(axis=1), response.sum(axis=1) / size], axis=1)
        return pooled @ p["out"] + p["shift"][0], (patches, response, real, size, pooled, depth)

    def logits(self, windows: list[tuple[str, int, int]]) -> np.ndarray:
        """In small batches of like length, so that a very long candidate pads no others."""
        order = sorted(range(len(windows)), key=lambda i: len(windows[i][0]))
        out, i = np.zeros(len(windows)), 0
        while i < len(order):
            longest = len(windows[order[i]][0])
            some = [k for k in order[i : i + max(1, min(256, 65536 // longest))] if len(windows[k][0]) <= 2 * longest]
            out[some] = self._forward(*self._padded([windows[k] for k in some]))[0]
            i += len(some)
        return out

    def _gradients(self, codes: np.ndarray, inside: np.ndarray, wanted: np.ndarray) -> dict[str, np.ndarray]:
        p, w = self.p, self.options.width
        z, (patches, response, real, size, pooled, depth) = self._forward(codes, inside)
        # a response in which nothing was found passes nothing back
        error = ((1 / (1 + np.exp(-z)) - wanted) / len(wanted)).astype(z.dtype)
        f = self.options.filters
        d_pooled = error[:, None] * p["out"]
        d_response = (response > 0) * (d_pooled[:, f:] / size)[:, None, :]
        top = response.argmax(axis=1)
        rows = np.arange(len(wanted))[:, None]
        d_response[rows, top, np.arange(f)] += d_pooled[:, :f] * (pooled[:, :f] > 0)
        flat = d_response.reshape(-1, f)
        d_patches = (flat @ p["conv"].T).reshape(len(wanted), -1, w, depth)
        positions = d_patches.shape[1]
        d_x = np.zeros((*codes.shape, depth), d_patches.dtype)
        for k in range(w):
            d_x[:, k : k + positions] += d_patches[:, :, k]
        flat_codes, d_x = codes.ravel(), d_x.reshape(-1, depth)
        d_embed = np.stack([np.bincount(flat_codes, d_x[:, i], _CODES) for i in range(depth - 1)], axis=1).astype(z.dtype)
        d_embed[_PAD] = 0
        return {
            "embed": d_embed,
            "conv": patches.T @ flat,
            "bias": flat.sum(axis=0),
            "out": pooled.T @ error,
            "shift": np.array([error.sum()]),
        }

    def learn(self, windows: Windows, secret: np.ndarray, rng: np.random.Generator) -> None:
        """One pass of gradient steps over small batches, in single precision."""
        for own in (self.p, self.mean, self.square):
            own.update({k: v.astype(np.float32) for k, v in own.items()})
        order = rng.permutation(len(secret))
        for i in range(0, len(order), 32):
            some = order[i : i + 32]
            found = self._gradients(*self._batch(windows, some), secret[some])
            self.step += 1
            rate = 0.01 * (1 - 0.999**self.step) ** 0.5 / (1 - 0.9**self.step)
            for k, g in found.items():
                self.mean[k] = 0.9 * self.mean[k] + 0.1 * g
                self.square[k] = 0.999 * self.square[k] + 0.001 * g * g
                self.p[k] = self.p[k] - rate * self.mean[k] / (self.square[k] ** 0.5 + 1e-8)

    @property
    def state(self) -> np.ndarray:
        """All that changes while the network learns, as one vector, so that it can be averaged."""
        parts = [v.ravel() for own in (self.p, self.mean, self.square) for v in own.values()]
        return np.concatenate([*parts, [self.step]]).astype(float)

    @state.setter
    def state(self, values: np.ndarray) -> None:
        at = 0
        for own in (self.p, self.mean, self.square):
            for k, v in own.items():
                own[k], at = values[at : at + v.size].reshape(v.shape).copy(), at + v.size
        self.step = float(values[at])

    def fit(self, windows: list[tuple[str, int, int]], labels: np.ndarray) -> None:
        """Train on two thirds; calibrate on the rest."""
        rng = np.random.default_rng(self.options.seed)
        order = rng.permutation(len(windows))
        held, used = order[: len(order) // 3], order[len(order) // 3 :]
        given = Windows.of([windows[k] for k in used])
        for _ in range(self.options.epochs):
            self.learn(given, labels[used], rng)
        counted = Counter((bool(labels[k]), *cell) for k, cell in zip(held, self.cells([windows[k] for k in held])))
        self.calibrate([(*key, n) for key, n in counted.items()])

    def cells(self, windows: list[tuple[str, int, int]]) -> list[tuple[str, int]]:
        """The form of each candidate, and its logit, rounded down to a ``CELLS``-th."""
        cell = np.floor(self.logits(windows) * CELLS).astype(int).tolist()
        return [(form(t[a:b]), c) for (t, a, b), c in zip(windows, cell)]

    def calibrate(self, counted: list[tuple[bool, str, int, int]]) -> None:
        """From (known secret, form, cell of the logit, how many) of all findings not trained on: calibrate, and set for each
        form of secret the threshold that still catches the wanted share of known ones.  A threshold is where a cell begins,
        so rounding loses none of them."""
        if not counted:
            self.thresholds, self.precision = dict.fromkeys(FORMS, 1.0), dict.fromkeys(FORMS)
            return
        # in a fixed order
        known, forms, cell, n = (np.array(c) for c in zip(*sorted(counted)))
        z = cell / CELLS
        scale, offset = 1.0, 0.0
        # logistic regression on the logit, with targets that are never quite 0 or 1
        yes, no = n[known].sum(), n[~known].sum()
        wanted = np.where(known, (yes + 1) / (yes + 2), 1 / (no + 2))
        for _ in range(200):
            q = 1 / (1 + np.exp(-np.clip(scale * z + offset, -30, 30)))
            scale -= 0.05 * float(np.average((q - wanted) * z, weights=n))
            offset -= 0.05 * float(np.average(q - wanted, weights=n))
        self.scale, self.offset = max(scale, 1e-3), offset
        for name in FORMS:
            some = known & (forms == name)
            some = some if n[some].sum() >= 20 else known
            # the recall wanted is the constraint; what precision it leaves is measured, not set
            least = None
            if some.any():
                order = np.argsort(z[some], kind="stable")
                reached = np.cumsum(n[some][order])
                rank = int((reached[-1] - 1) * (1 - self.options.recall))
                least = z[some][order][np.searchsorted(reached, rank, side="right")]
            self.thresholds[name] = 1.0 if least is None else float(self.probability(least))
            caught = (forms == name) & (z >= (np.inf if least is None else least))
            self.precision[name] = float(np.average(known[caught], weights=n[caught])) if caught.any() else None

    def probability(self, z: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.offset, -30, 30)))


FORMS = ("hex", "upper", "mixed")
# Logits are counted by cells, this many to one unit.
CELLS = 1024


def form(candidate: str) -> str:
    if re.fullmatch(r"[0-9a-f]+", candidate):
        return "hex"
    return "upper" if candidate == candidate.upper() else "mixed"


# on documents ----------------------------------------------------------------------------------------------------


def plant(text: str, taken: list[tuple[int, int, int]], options: Options) -> Iterator[tuple[int, str, int, int]]:
    """(label, text, begin, end) of a secret (2) and of a look-alike (3), each in place of one word of the text."""
    rng = random.Random(zlib.crc32(text.encode("utf-8", "replace")))
    for label, kinds in ((2, options.planted), (3, options.lookalikes)):
        word = _PLAIN_WORD.search(text, rng.randrange(len(text) + 1))
        if not word or not kinds:
            continue
        a, b = word.span()
        left, right = text[max(0, a - options.before) : a], text[b : b + options.after]
        if any(s < b and a < e for s, _, e in taken) or CANDIDATE_MARK.match(right):
            continue
        kind = rng.choice(kinds)
        value = PLANTED[kind](rng) if label == 2 else LOOKALIKES[kind](rng, [text[a:b], *_PLAIN_WORD.findall(left + right)])
        # what the patterns find, and what the network is never asked, teaches nothing
        if not base_spans(value) and candidates(value, []) == [(0, len(value))]:
            lead = left + rng.choice(_LEADS)
            yield label, *window(lead + value + right, len(lead), len(lead) + len(value), options)


def findings(docs: DataFrame, options: Options) -> DataFrame:
    """Labelled findings with context, of all documents that can hold any: secrets of the patterns (1), and candidates and
    some ordinary words, which are none (0).  A finding of more than ``options.stretch`` characters is several, stretch by
    stretch, so none is too long to be learnt from.

    The patterns show the network nothing but what they find themselves.  So one text in
    ``options.one_text_in``, by hash, also gives a planted secret (2), of a form that the patterns do not know, and a harmless
    look-alike (3), each in place of a word.  Which ones depends on the text alone, so a task that runs again plants the same."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = texts(batch.column("text"))
            chosen = batch.column("chosen").to_numpy(zero_copy_only=False)
            suspected = suspects(column)
            rows = []
            for i in np.flatnonzero(suspected | chosen).tolist():
                text = column[i].as_py()
                taken = base_spans(text) if suspected[i] else []
                if chosen[i]:
                    rows += plant(text, taken, options)
                if not suspected[i]:
                    continue
                marked = []
                for start, kind, end in taken:
                    begin = ASSIGN.match(text, start).start(2) if kind == 0 else start
                    marked.append((1, begin, end))
                marked += [(0, a, b) for a, b in candidates(text, taken)]
                ordinary = [m.span() for m in WORD.finditer(text) if zlib.crc32(m[0].encode("utf-8", "replace")) % ONE_WORD_IN == 0]
                marked += [(0, a, b) for a, b in ordinary if not any(a < e and s < b for s, _, e in taken)]
                for label, a, b in marked:
                    for begin in range(a, b, options.stretch):
                        rows.append((label, *window(text, begin, min(b, begin + options.stretch), options)))
            columns = list(zip(*rows)) if rows else [()] * 4
            types = (pa.int32(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=["label", "text", "begin", "end"])

    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    given = docs.select(text.alias("text"), (F.pmod(F.xxhash64(text), F.lit(options.one_text_in)) == 0).alias("chosen"))
    return map_arrow(given, run, FINDING).distinct()


def packed(found: DataFrame, options: Options) -> DataFrame:
    """The findings in blocks of some ``options.block``, dealt by hash; one row a block, characters as codes."""
    blocks = max(1, -(-found.count() // options.block))

    def pack(key: tuple[pa.Scalar], table: pa.Table) -> pa.Table:
        # in a fixed order
        table = table.sort_by([(c, "ascending") for c in ("order", "text", "begin", "end", "label")])
        texts_of = table.column("text").to_pylist()
        secret = np.isin(table.column("label").to_numpy(), (1, 2))
        columns = [
            key[0].as_py(),
            _codes("".join(texts_of)).astype(np.uint8).tobytes(),
            [len(t) for t in texts_of],
            table.column("begin").to_pylist(),
            table.column("end").to_pylist(),
            secret.tolist(),
        ]
        return pa.table([pa.array([c], f.type) for c, f in zip(columns, arrow)], schema=arrow)

    arrow = to_arrow_schema(StructType.fromDDL(PACKED))
    dealt = found.withColumn("block", F.pmod(F.xxhash64("order", F.lit("block")), F.lit(blocks)))
    return dealt.groupBy("block").applyInArrow(pack, PACKED)


def learn_all(network: CharNetwork, blocks: DataFrame, options: Options) -> None:
    """Distributed training: in each epoch every block starts from the same weights and takes its steps over all its findings;
    the weights are then averaged, weighted by findings.  Blocks do not depend on the tasks they come to."""
    n = blocks.count()
    for epoch in range(options.epochs):
        shared = blocks.sparkSession.sparkContext.broadcast(network)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    block, codes = (batch.column(c)[row].as_py() for c in ("block", "codes"))
                    sizes, begins, ends = (batch.column(c)[row].values.to_numpy().astype(np.int64) for c in ("sizes", "begins", "ends"))
                    secret = batch.column("secret")[row].values.to_numpy(zero_copy_only=False)
                    own = copy.deepcopy(shared.value)
                    windows = Windows(np.frombuffer(codes, np.uint8).astype(np.int64), sizes, begins, ends)
                    own.learn(windows, secret, np.random.default_rng([options.seed, epoch, block]))
                    rows = [block % options.averaged, block, len(secret), (own.state * len(secret)).tobytes()]
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in rows], names=["share", "block", "findings", "state"])

        def summed(table: pa.Table) -> pa.Table:
            table = table.sort_by("block")
            total = sum(np.frombuffer(x) for x in table.column("state").to_pylist())
            return pa.table(
                {
                    **{c: table.column(c).slice(0, 1) for c in ("share", "block")},
                    "findings": pa.array([sum(table.column("findings").to_pylist())]),
                    "state": pa.array([total.tobytes()], pa.binary()),
                }
            )

        trained = map_arrow(blocks.repartition(n, "block"), run, STATES) if n > 1 else map_arrow(blocks, run, STATES)
        shares = sorted(trained.groupBy("share").applyInArrow(summed, STATES).collect(), key=lambda r: r.share)
        if shares:
            network.state = sum(np.frombuffer(r.state) for r in shares) / sum(r.findings for r in shares)


def train(docs: DataFrame, options: Options = Options()) -> CharNetwork | None:
    """The network: two thirds of all distinct findings, by hash, train it, in parallel; all others calibrate it and set its
    thresholds.  None if there are fewer than ``options.fewest`` secrets or others, planted ones included."""
    # written once, or each epoch would read all texts again
    found = materialise(findings(docs, options).withColumn("order", F.xxhash64("text", "begin", "end")))
    labels = {r.label: r["count"] for r in found.groupBy("label").count().collect()}
    if min(labels.get(0, 0) + labels.get(3, 0), labels.get(1, 0) + labels.get(2, 0)) < options.fewest:
        return None
    network = CharNetwork(options)
    held = F.pmod(F.xxhash64("order", F.lit(options.seed)), F.lit(3)) == 0
    learn_all(network, materialise(packed(found.where(~held), options)), options)
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            windows = list(zip(*(batch.column(c).to_pylist() for c in ("text", "begin", "end"))))
            forms, cells = zip(*shared.value.cells(windows)) if windows else ((), ())
            columns = [batch.column("secret"), pa.array(forms, pa.string()), pa.array(cells, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["secret", "form", "cell"])

    given = found.where(held).select(F.col("label").isin(1, 2).alias("secret"), "text", "begin", "end")
    counted = map_arrow(given, run, "secret boolean, form string, cell long").groupBy("secret", "form", "cell").count()
    network.calibrate([tuple(r) for r in counted.collect()])
    return network


def judged(text: str, network: CharNetwork | None, options: Options) -> list[tuple[int, int, int, float]]:
    """(start, kind, end, score) of all secrets of a text, in order."""
    taken = base_spans(text)
    found = [(*span, 1.0) for span in taken]
    some = candidates(text, taken) if network else []
    if some:
        scores = network.probability(network.logits([window(text, a, b, options) for a, b in some]))
        for (a, b), score in zip(some, scores.tolist()):
            if score >= network.thresholds[form(text[a:b])]:
                found.append((a, 3, b, score))
    return sorted(found)


def scan_secrets(docs: DataFrame, carry: list[str] | None = None, options: Options = Options()) -> DataFrame:
    """The ``carry`` columns (all if not given) and ``spans``: secrets of every whole text, by start, then kind.

    Kinds: ``assign``, a value given to a name such as ``password``; ``access``, an access key id; ``hex``, a long
    hexadecimal run; each leftmost and without overlaps within its kind; and ``model``, what the network takes for a secret
    among runs of 8 characters or more that mix letters and digits, or of 12 or more that mix small and capital letters.
    Positions count code points; the end is exclusive.

    One pass gathers labelled findings, plants more (``findings``) and writes both to shared storage.  All of these train the
    network or set its thresholds, in tasks (``train``); another pass scans.  Neither shuffles texts.  With fewer secrets or others among
    them than ``options.fewest`` there is nothing to learn from, and there are no ``model`` spans.  A threshold is the one
    that catches ``options.recall`` of the known secrets of its form that the network was not trained on, whatever precision
    that leaves (``CharNetwork.precision``).
    """
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, options))
    carry = docs.columns if carry is None else carry
    names = [f"c{i}" for i in range(len(carry))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = shared.value
        for batch in batches:
            column = texts(batch.column("text"))
            spans: list[list[dict]] = [[] for _ in range(len(column))]
            for i in np.flatnonzero(suspects(column)).tolist():
                spans[i] = [
                    {"kind": KINDS[k], "start": a, "end": b, "score": s} for a, k, b, s in judged(column[i].as_py(), network, options)
                ]
            kind = pa.list_(
                pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())])
            )
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in names), pa.array(spans, kind)], names=[*names, "spans"]
            )

    carried = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(carry, names)], F.col("text").cast("string").alias("text"))
    schema = StructType([*carried.schema.fields[:-1], *StructType.fromDDL(SPANS).fields])
    found = map_arrow(carried, run, schema)
    return found.select(F.struct(*[F.col(n).alias(c) for n, c in zip(names, carry)]).alias("doc"), "spans")


def redact(docs: DataFrame, mark: str = "[secret]", options: Options = Options()) -> DataFrame:
    """The documents with every secret replaced by ``mark``, overlapping ones by one; all columns stay, ``n_chars`` (if there
    is one) counts the new text.  No document goes."""
    merged = """aggregate(spans, CAST(array() AS array<struct<s: bigint, e: bigint>>), (done, x) ->
        CASE WHEN size(done) > 0 AND element_at(done, -1).e > x.start
             THEN concat(slice(done, 1, size(done) - 1), array(named_struct(
                  's', element_at(done, -1).s, 'e', greatest(element_at(done, -1).e, x.end))))
             ELSE concat(done, array(named_struct('s', x.start, 'e', x.end))) END)"""
    literal = mark.replace("\\", "\\\\").replace("'", "\\'")
    pieces = f"""concat(array_join(transform(merged, (x, i) -> concat(
        substr(doc.text, int(if(i = 0, 0, get(merged, i - 1).e)) + 1, int(x.s - if(i = 0, 0, get(merged, i - 1).e))),
        '{literal}')), ''), substr(doc.text, int(element_at(merged, -1).e) + 1))"""
    found = scan_secrets(docs, options=options).selectExpr("doc", f"{merged} AS merged")
    text = F.when(F.size("merged") == 0, F.col("doc.text")).otherwise(F.expr(pieces))
    out = found.select("doc", text.alias("cleaned"), (F.size("merged") > 0).alias("changed"))
    columns = []
    for field in docs.schema.fields:
        column = F.col("doc").getField(field.name)
        if field.name == "text":
            column = F.col("cleaned")
        elif field.name == "n_chars":
            column = F.when(F.col("changed"), F.length("cleaned")).otherwise(column)
        columns.append(column.cast(field.dataType).alias(field.name))
    return out.select(*columns)
