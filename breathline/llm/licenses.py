"""Licence texts and notices in documents, by a generalised suffix automaton of licence words."""

from __future__ import annotations

from bisect import bisect_left
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import LOWER_ALNUM, map_arrow, mapped, slices, texts, words

# Phrases that name a licence.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
# The notices that public licences ask for.
NOTICES = (
    (
        "apache",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the"
        " license you may obtain a copy of the license at",
    ),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public"
        " license as published by the free software foundation either version 3 of the license or at your option any later"
        " version",
    ),
    (
        "lgpl",
        "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general"
        " public license as published by the free software foundation either version 2 1 of the license or at your option"
        " any later version",
    ),
    (
        "mpl",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not"
        " distributed with this file you can obtain one at",
    ),
)
# The parts of Creative Commons licences, and their versions in use.
CREATIVE_COMMONS = (("by",), ("by", "sa"), ("by", "nd"), ("by", "nc"), ("by", "nc", "sa"), ("by", "nc", "nd"))
PARTS = {"by": "attribution", "sa": "sharealike", "nd": "noderivatives", "nc": "noncommercial"}
VERSIONS = ("3 0", "4 0")
# whole public licence texts, one file each, named by label and version
FOLDER = Path(__file__).resolve().parent / "licences"


def creative_commons() -> list[tuple[str, str]]:
    """Short and long notice of every Creative Commons licence."""
    return [
        ("cc-" + "-".join(parts), f"this work is licensed under {name} {version}{more}")
        for parts in CREATIVE_COMMONS
        for version in VERSIONS
        for name, more in (
            ("cc " + " ".join(parts), ""),
            ("a creative commons " + " ".join(PARTS[p] for p in parts), " international license"),
        )
    ]


def template_words(text: str) -> str:
    return " ".join(words(mapped(pa.array([text], pa.large_string()), LOWER_ALNUM))[0].to_pylist())


@lru_cache(maxsize=4)
def licence_templates(folder: Path = FOLDER) -> tuple[tuple[str, str], ...]:
    """(label, words) of the whole texts in a folder, whose files are named ``<label>.<version>.txt``, and of the notices."""
    whole = [(p.name.split(".")[0], template_words(p.read_text("utf-8"))) for p in sorted(folder.glob("*.txt"))]
    return (*whole, *NOTICES, *creative_commons())


FOUND = (
    "doc_id long, n_words long, places array<struct<label: string, start: long>>, "
    "spans array<struct<label: string, start: long, end: long, coverage: double>>"
)


class SuffixAutomaton:
    """All stretches of several word sequences.  A state stands for the stretches that end at the same places."""

    def __init__(self, sequences: Sequence[Sequence[int]]):
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for number, sequence in enumerate(sequences):
            last = 0
            for i, word in enumerate(sequence):
                last = self._extend(last, word, ends)
                ends[last].append((number, i + 1))
        # a stretch also ends wherever one that it is a suffix of does, which are the states below it in the tree of links: in
        # the order of that tree these ends lie next to each other, each kept once
        below: list[list[int]] = [[] for _ in self.next]
        for state in range(1, len(self.next)):
            below[self.link[state]].append(state)
        order, waiting = [], [0]
        while waiting:
            state = waiting.pop()
            order.append(state)
            waiting += below[state]
        self.flat_ends: list[tuple[int, int]] = []
        self.first_end, counts = [0] * len(self.next), [len(e) for e in ends]
        for state in order:
            self.first_end[state] = len(self.flat_ends)
            self.flat_ends += ends[state]
        for state in reversed(order[1:]):
            counts[self.link[state]] += counts[state]
        self.n_ends = counts

    def ends(self, state: int) -> list[tuple[int, int]]:
        """Every (sequence, end) at which the stretches of a state end."""
        return self.flat_ends[self.first_end[state] : self.first_end[state] + self.n_ends[state]]

    def _new(self, length: int, ends: list) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        ends.append([])
        return len(self.next) - 1

    def _split(self, above: int, word: int, ends: list) -> int:
        """The state for the longest stretch of ``above`` with ``word``, taken out of a larger class if need be."""
        whole = self.next[above][word]
        if self.length[whole] == self.length[above] + 1:
            return whole
        part = self._new(self.length[above] + 1, ends)
        self.next[part] = dict(self.next[whole])
        self.link[part], self.link[whole] = self.link[whole], part
        while above >= 0 and self.next[above].get(word) == whole:
            self.next[above][word] = part
            above = self.link[above]
        return part

    def _extend(self, last: int, word: int, ends: list) -> int:
        if word in self.next[last]:
            return self._split(last, word, ends)
        state = self._new(self.length[last] + 1, ends)
        above = last
        while above >= 0 and word not in self.next[above]:
            self.next[above][word] = state
            above = self.link[above]
        self.link[state] = self._split(above, word, ends) if above >= 0 else 0
        return state

    def statistics(self, sequence: Sequence[int]) -> Iterator[tuple[int, int]]:
        """After each word: the state and length of the longest stretch that ends there."""
        state = length = 0
        for word in sequence:
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield state, length


@dataclass(frozen=True)
class Match:
    start: int
    begin: int  # in the template
    length: int

    @property
    def end(self) -> int:
        return self.start + self.length

    @property
    def reached(self) -> int:
        return self.begin + self.length


class Scanner:
    def __init__(self, phrases, templates, min_match: int, max_gap: int):
        self.min_match, self.max_gap = min_match, max_gap
        self.labels = [label for _, label in phrases] + [label for label, _ in templates]
        sequences = [text.split() for text, _ in phrases] + [text.split() for _, text in templates]
        self.n_phrases = len(phrases)
        self.sizes = [len(s) for s in sequences]
        self.vocabulary = sorted({w for s in sequences for w in s})
        number = {w: i for i, w in enumerate(self.vocabulary)}
        coded = [[number[w] for w in s] for s in sequences]
        self.automaton = SuffixAutomaton(coded)
        # the phrases that every stretch of a state ends with; of the state where a phrase itself is, the long enough ones
        links, lengths = self.automaton.link, self.automaton.length
        self.phrases_at: list[list[int]] = [[] for _ in links]
        for p in range(self.n_phrases):
            *_, (state, _) = self.automaton.statistics(coded[p])
            self.phrases_at[state].append(p)
        for state in sorted(range(1, len(links)), key=lengths.__getitem__):
            self.phrases_at[state] += self.phrases_at[links[state]]
        n = len(self.vocabulary)
        self.pairs = np.zeros(n * n, bool)
        for s in coded:
            for a, b in zip(s, s[1:]):
                self.pairs[a * n + b] = True
        self.single = np.zeros(n, bool)
        self.single[[s[0] for s in coded if len(s) == 1]] = True

    def runs(self, term: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Begin and end of every stretch of words in which each two neighbours are neighbours in a template.

        A longer match cannot leave such a stretch, so only these go through the automaton.
        """
        n = len(self.vocabulary)
        linked = np.zeros(len(term) + 1, bool)
        if len(term) > 1:
            both = (term[:-1] >= 0) & (term[1:] >= 0)
            linked[1:-1] = both & self.pairs[np.where(both, term[:-1] * n + term[1:], 0)]
        linked[begins] = False
        alone = (term >= 0) & self.single[np.maximum(term, 0)]
        inside = linked[1:] | linked[:-1] | alone
        first, last = inside & ~linked[:-1], inside & ~linked[1:]
        return np.stack([np.flatnonzero(first), np.flatnonzero(last) + 1], axis=1)

    def scan(self, words_: list[int], start: int, places: list[dict], matches: list[list[Match]]) -> None:
        """Add what one run, which begins at word ``start`` of its document, holds."""
        found = list(self.automaton.statistics(words_))
        for i, (state, length) in enumerate(found):
            for phrase in self.phrases_at[state]:
                if length >= self.sizes[phrase]:
                    places.append({"label": self.labels[phrase], "start": start + i + 1 - self.sizes[phrase]})
            if length >= self.min_match and (i + 1 == len(found) or found[i + 1][1] != length + 1):
                for template, end in self.automaton.ends(state):
                    matches[template].append(Match(start + i + 1 - length, end - length, length))

    def chained(self, template: int, matches: list[Match]) -> list[dict]:
        """Chains of matches, in the order of the document, that go on in the template: each match is put behind the one that
        makes its chain cover most words, and chains are then read off from the longest on.  No match is on two of them."""
        covered, behind = [], []
        near: deque[int] = deque()
        for n, m in enumerate(matches):
            while near and matches[near[0]].end < m.start - self.max_gap:
                near.popleft()
            best, before = m.length, -1
            for i in near:
                o = matches[i]
                ahead = min(m.end - max(m.start, o.end), m.reached - max(m.begin, o.reached))
                if ahead > 0 and covered[i] + ahead > best:
                    best, before = covered[i] + ahead, i
            covered.append(best)
            behind.append(before)
            near.append(n)
        used = [False] * len(matches)
        size, label = self.sizes[template], self.labels[template]
        chains = []
        for last in sorted(range(len(matches)), key=lambda n: (-covered[n], n)):
            first = n = last
            while n >= 0 and not used[n]:
                used[n], first, n = True, n, behind[n]
            words_ = covered[last] - (covered[n] if n >= 0 else 0)
            if n != last:
                share = min(1.0, words_ / size)
                place = {"label": label, "start": matches[first].start, "end": matches[last].end}
                chains.append(place | {"coverage": share, "covered": words_})
        return chains

    def spans(self, by_template: list[list[Match]], coverage: float) -> list[dict]:
        """Spans of one document that cover enough of a template.  Licences share passages: of spans that overlap by more than
        half of the shorter one, the one that covers more words stays, then the one with more of its template, then the first."""
        found = []
        for t, some in enumerate(by_template[self.n_phrases :], self.n_phrases):
            if sum(m.length for m in some) >= coverage * self.sizes[t]:
                found += [s for s in self.chained(t, some) if s["coverage"] >= coverage]
        found.sort(key=lambda s: (-s["covered"], -s["coverage"], s["start"], s["label"]))
        kept = Taken()
        return sorted((s for s in found if kept.take(s["start"], s["end"])), key=lambda s: (s["start"], s["end"], s["label"]))


class Taken:
    """Stretches of a text, none of which lies for more than half of the shorter one in another."""

    def __init__(self):
        self.stretches: list[tuple[int, int]] = []

    def take(self, start: int, end: int) -> bool:
        """Add a stretch that is no longer in words than those before, unless too much of it is taken."""
        at = bisect_left(self.stretches, (start, end))
        for a, b in self.stretches[max(0, at - 2) : at + 2]:
            if 2 * (min(end, b) - max(start, a)) > min(end - start, b - a):
                return False
        self.stretches.insert(at, (start, end))
        return True


@lru_cache(maxsize=4)
def own_scanner(phrases, templates, min_match: int, max_gap: int) -> Scanner:
    """The scanner of a Python worker, kept from task to task."""
    return Scanner(phrases, templates, min_match, max_gap)


def scan_licenses(
    docs: DataFrame, phrases=PHRASES, templates=None, min_match: int = 4, max_gap: int = 8, coverage: float = 0.6
) -> DataFrame:
    """One row per document: ``places`` where a phrase's words stand consecutively, all of them, and ``spans`` that cover at
    least ``coverage`` of a template; positions count words from 0.

    A-Z are lower-cased; words are letters, digits and characters beyond ASCII.  The automaton holds all phrases and templates,
    which are parameters.  Each whole text is streamed through it; where a match of ``min_match`` words or more cannot be
    continued it is noted with every place in a template that reads the same, and matches at most ``max_gap`` words apart that
    go on in the same template are chained into one span.  Where spans overlap, the one that covers most words stays.  Without
    ``templates``, they are ``licence_templates()``: whole licence texts and notices.  Nothing is shuffled.

    A null or empty text has no words, places or spans; repeated rows each give a row of their own, also without ``doc_id``.
    """
    templates = licence_templates() if templates is None else tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = 0
            for part in slices(texts(batch.column("text")), 8 << 20):
                yield found_in(part, batch.column("doc_id").slice(done, len(part)))
                done += len(part)

    def found_in(column: pa.LargeStringArray, doc_ids: pa.Array) -> pa.RecordBatch:
        scanner = own_scanner(phrases, templates, min_match, max_gap)
        flat, begins = words(mapped(column, LOWER_ALNUM))
        term = pc.index_in(flat, value_set=pa.array(scanner.vocabulary, pa.large_string())).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        n = len(begins) - 1
        runs = scanner.runs(term, begins)
        owner = np.searchsorted(begins, runs[:, 0], side="right") - 1
        places: list[list[dict]] = [[] for _ in range(n)]
        matches: dict[int, list[list[Match]]] = {}
        for d, (a, b) in zip(owner.tolist(), runs.tolist()):
            own = matches.setdefault(d, [[] for _ in scanner.labels])
            scanner.scan(term[a:b].tolist(), a - int(begins[d]), places[d], own)
        spans: list[list[dict]] = [[] for _ in range(n)]
        for d, by_template in matches.items():
            spans[d] = [{k: s[k] for k in ("label", "start", "end", "coverage")} for s in scanner.spans(by_template, coverage)]
        return pa.RecordBatch.from_arrays(
            [
                doc_ids,
                pa.array(np.diff(begins).astype(np.int64)),
                pa.array(places, pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64())]))),
                pa.array(
                    spans,
                    pa.list_(
                        pa.struct(
                            [("label", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("coverage", pa.float64())]
                        )
                    ),
                ),
            ],
            names=["doc_id", "n_words", "places", "spans"],
        )

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(given, run, FOUND)
