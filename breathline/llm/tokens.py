"""Token ids of Arrow text columns by a tokenizer file of the ``tokenizers`` library."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .text import gathered, slices, words

# Runs of letters that normalisation leaves as they are but for case, and punctuation that starts no contraction.  A chunk
# of letters and then punctuation is tokenized as the letters, then the punctuation.
LETTERS = "[A-Za-zÀ-ÖØ-öø-ÿ]+"
PUNCTUATION = "".join(chr(c) for c in range(0x21, 0x7F) if not chr(c).isalnum() and chr(c) != "'")
PLAIN = re.compile(LETTERS)
ID = np.dtype("<u4")
# Bytes of text at a time, so that what is worked out per word stays small beside a batch.
SLICE = 6 << 20


class Runs:
    """Runs of ids, one after the other."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray):
        self.ids, self.lengths = ids, lengths

    @classmethod
    def of(cls, parts: list[list[int]]) -> Runs:
        lengths = np.array([len(p) for p in parts], np.int64)
        return cls(np.fromiter(chain.from_iterable(parts), ID, int(lengths.sum())), lengths)

    def __add__(self, other: Runs) -> Runs:
        return Runs(np.concatenate([self.ids, other.ids]), np.concatenate([self.lengths, other.lengths]))

    def take(self, picks: np.ndarray) -> np.ndarray:
        return gathered(self.ids, np.cumsum(self.lengths) - self.lengths, self.lengths, picks)

    def pick(self, picks: np.ndarray) -> Runs:
        return Runs(self.take(picks), self.lengths[picks])


class Encoder:
    """Encodes whole columns.

    A tokenizer that drops white space and never looks across it (``word_bpe_49k.json`` is one) gives a text the ids of
    its white-space-separated chunks.  Each distinct chunk of some megabytes of text is looked at once; one of letters and
    then punctuation is looked up by its letters in lower case, anything else as it is.  Up to ``remembered`` of these keys
    are kept from slice to slice, the most frequent ones of a slice first if there is no room for all.  Keys and ids are
    flat arrays, some tens of megabytes.  With ``by_chunk=False`` texts are encoded as they are, by any tokenizer.
    """

    def __init__(self, path: str, by_chunk: bool = True, remembered: int = 500_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_chunk, self.remembered = by_chunk, remembered
        vocabulary = self.tokenizer.get_vocab()
        self.size = max(vocabulary.values()) + 1
        described = json.loads(self.tokenizer.to_str())
        suffix = described["model"].get("end_of_word_suffix")
        self.ends = np.zeros(self.size, bool)
        if suffix:
            self.ends[[i for token, i in vocabulary.items() if token.endswith(suffix)]] = True
        # for letters that are normalised already
        self.bare = Tokenizer.from_str(json.dumps(described | {"normalizer": None}))
        self.keys = pa.array([], pa.large_string())
        self.runs = Runs.of([])
        self.tails: dict[str, list[int]] = {"": []}

    def _whole(self, given: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(given, add_special_tokens=False)]

    def _letters(self, given: list[str]) -> Runs:
        """Lower-case runs of letters, many in one call; the ids that end a word tell them apart."""
        out = [Runs.of([])]
        for i in range(0, len(given), 2000):
            part = given[i : i + 2000]
            ids = np.array(self.bare.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, ID)
            lengths = np.diff(np.flatnonzero(self.ends[ids]) + 1, prepend=0)
            out.append(Runs(ids, lengths) if len(lengths) == len(part) else Runs.of(self._whole(part)))
        return Runs(np.concatenate([r.ids for r in out]), np.concatenate([r.lengths for r in out]))

    def _new(self, keys: list[str]) -> Runs:
        plain = np.array([PLAIN.fullmatch(k) is not None for k in keys], bool)
        found = self._letters([k for k, p in zip(keys, plain) if p]) + Runs.of(self._whole([k for k, p in zip(keys, plain) if not p]))
        at = np.empty(len(keys), np.int64)
        at[np.concatenate([np.flatnonzero(plain), np.flatnonzero(~plain)])] = np.arange(len(keys))
        return found.pick(at)

    def _split(self, chunks: pa.LargeStringArray) -> tuple[pa.LargeStringArray, pa.LargeStringArray]:
        """The key of each chunk, and the punctuation after it."""
        heads = pc.utf8_rtrim(chunks, characters=PUNCTUATION)
        plain = pc.match_substring_regex(heads, pattern=f"^{LETTERS}$")
        keys = pc.if_else(plain, pc.utf8_lower(heads), chunks)
        offsets = np.frombuffer(chunks.buffers()[1], np.int64)[chunks.offset : chunks.offset + len(chunks) + 1]
        begins = offsets[:-1] + pc.binary_length(heads).to_numpy(zero_copy_only=False)
        lengths = np.where(plain.to_numpy(zero_copy_only=False), offsets[1:] - begins, 0)
        data = gathered(np.frombuffer(chunks.buffers()[2] or b"", np.uint8), begins, lengths, np.arange(len(chunks)))
        ends = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64)
        return keys, pa.LargeStringArray.from_buffers(len(chunks), pa.py_buffer(ends.tobytes()), pa.py_buffer(data.tobytes()))

    def encode(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and where each text's begin (one more at the end)."""
        ids, begins, total = [np.zeros(0, ID)], [np.zeros(1, np.int64)], 0
        for part in slices(column, SLICE):
            own, at = self._encode(part)
            ids.append(own)
            begins.append(at[1:] + total)
            total += len(own)
        return np.concatenate(ids), np.concatenate(begins)

    def _encode(self, column: pa.LargeStringArray) -> tuple[np.ndarray, np.ndarray]:
        if not self.by_chunk:
            runs = Runs.of(self._whole(column.to_pylist()))
            return runs.ids, np.concatenate([[0], np.cumsum(runs.lengths)]).astype(np.int64)
        flat, firsts = words(column)
        if not len(flat):
            return np.zeros(0, ID), np.zeros(len(firsts), np.int64)
        coded = pc.dictionary_encode(flat)
        picks = coded.indices.to_numpy(zero_copy_only=False)
        keys, tails = self._split(coded.dictionary)
        known = pc.index_in(keys, value_set=self.keys)
        missing = known.is_null().to_numpy(zero_copy_only=False)
        at = known.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        runs = self.runs
        if missing.any():
            new = pc.dictionary_encode(keys.filter(pa.array(missing)))
            own = new.indices.to_numpy(zero_copy_only=False)
            at[missing] = len(self.keys) + own
            found = self._new(new.dictionary.to_pylist())
            runs = runs + found
            if room := self.remembered - len(self.keys):
                count = np.bincount(own, weights=np.bincount(picks, minlength=len(keys))[missing])
                kept = np.argsort(-count, kind="stable")[:room]
                self.keys = pa.concat_arrays([self.keys, new.dictionary.take(pa.array(kept))])
                self.runs = self.runs + found.pick(kept)
        after = pc.dictionary_encode(tails)
        endings = after.dictionary.to_pylist()
        unseen = [t for t in endings if t not in self.tails]
        more = dict(zip(unseen, self._whole(unseen)))
        if len(self.tails) < 10_000:
            self.tails |= more
        runs = runs + Runs.of([more[t] if t in more else self.tails[t] for t in endings])
        # a chunk is two runs, its key's and its punctuation's
        both = np.empty(2 * len(keys), np.int64)
        both[::2], both[1::2] = at, len(runs.lengths) - len(endings) + after.indices.to_numpy(zero_copy_only=False)
        chunks = Runs(runs.take(both), runs.lengths[both[::2]] + runs.lengths[both[1::2]])
        before = np.concatenate([[0], np.cumsum(chunks.lengths[picks])]).astype(np.int64)
        return chunks.take(picks), before[firsts]


@lru_cache(maxsize=1)
def encoder(path: str, by_chunk: bool = True) -> Encoder:
    """The encoder of a Python worker, kept from task to task."""
    return Encoder(path, by_chunk)
