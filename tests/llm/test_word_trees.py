import random
from collections import defaultdict
from dataclasses import replace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from samples import documents
from test_models import SMALL

from breathline.llm import language_model
from breathline.llm.word_trees import EQUAL, Softmaxes, descend, softmax, summed, ways


def test_rare_words_are_judged_by_the_words_before(spark):
    """300 pairs of words, all equally frequent and with the same endings; texts of true pairs are likelier than of others."""
    rng = random.Random(1)
    spell = lambda kind, i: f"{kind}{''.join(chr(97 + int(d)) for d in f'{i:03d}')}ing"
    pairs = [(spell("l", i), spell("r", i)) for i in range(300)]
    rows = []
    for i in range(120):
        rng.shuffle(pairs)
        rows.append((i, " ".join(" ".join(p) for p in pairs)))
    lefts, rights = zip(*sorted(pairs))
    rows.append((1000, " ".join(f"{a} {b}" for a, b in zip(lefts, rights))))
    rows.append((1001, " ".join(f"{a} {b}" for a, b in zip(lefts, rights[1:] + rights[:1]))))
    docs = documents(spark, rows).repartition(3)
    found = {r.doc_id: r for r in language_model.score(docs, F.col("doc_id") >= 1000, SMALL).where("doc_id >= 1000").collect()}
    assert found[1000].n_known == found[1001].n_known == 601
    assert found[1000].base_score == pytest.approx(found[1001].base_score)
    assert found[1000].score > found[1001].score + 100


@pytest.mark.parametrize("weight", [[5, 1, 1, 1], [10**6, 3, 1, 0.1], [1] * 400, [0.1], list(range(1, 90))])
def test_untrained_trees_give_shares_of_weight(weight):
    weight = np.array([*weight, 7, 2.0])
    tree = np.array([4] * (len(weight) - 2) + [9, 9])
    order = np.random.default_rng(0).permutation(len(weight))
    found = ways(tree[order], weight[order])
    assert (found.tree == 9).sum() == 1
    leaf = np.arange(len(order))
    which, at = found.items(leaf)
    softmaxes = Softmaxes(found.shares, np.searchsorted([4, 9], found.tree), np.array([64, 64]))
    zero = np.zeros(len(at), int)
    p = np.bincount(which, softmaxes.log10(found.node[at], found.child[at], zero, zero), len(leaf))
    total = {t: weight[tree == t].sum() for t in (4, 9)}
    assert 10**p == pytest.approx([weight[i] / total[tree[i]] for i in order], rel=1e-3)
    paths = {(tree[order[i]], *map(tuple, zip(found.node[at[which == i]], found.child[at[which == i]]))) for i in leaf}
    assert len(paths) == len(leaf)


def test_words_of_a_lot_and_an_unknown_one_add_up_to_one():
    options = replace(SMALL, lots=2)
    rng = np.random.default_rng(1)
    kinds = options.frequent + rng.integers(0, 2 * options.slots, 200)
    words = [np.unique(kinds.astype(np.int64) << 32 | rng.integers(0, 1 << 32, 200)) for _ in range(2)]
    places = [rng.integers(0, len(w), 3000) for w in words]
    training = [p % 5 > 0 for p in places]
    part = language_model.Part(words, zip(places, training), options)
    a, b = rng.integers(0, options.kinds, (2, 3000))
    part.train([part.steps(words[0], *(x[training[0]] for x in (places[0], a, b)))], rng)
    lot = ((part.words >> 32) - options.frequent) // options.slots
    for before in rng.integers(0, options.kinds, (5, 2)):
        for number in (0, 1):
            leaves = np.unique(part.leaf[lot == number])
            which, at = part.ways.items(leaves)
            node, child = part.ways.node[at], part.ways.child[at]
            log = part.softmaxes.log10(node, child, *(np.full(len(at), x) for x in before))
            assert (10 ** np.bincount(which, log, len(leaves))).sum() == pytest.approx(1, abs=1e-4)


def test_sums_and_steps_by_row_against_plain_loops():
    rng = np.random.default_rng(2)
    for n, kinds in ((1, 1), (40, 3), (500, 200), (3000, 40)):
        rows, error = rng.zipf(1.5, n) % kinds, rng.normal(0, 1, (n, 6)).astype(np.float32)
        wanted = defaultdict(lambda: np.zeros(6))
        for r, e in zip(rows.tolist(), error):
            wanted[r] += e
        found, sums = summed(rows, kinds, error)
        assert sorted(found.tolist()) == sorted(wanted)
        assert sums == pytest.approx(np.array([wanted[r] for r in found.tolist()]), abs=1e-3)
        table, squares = rng.normal(0, 1, (kinds, 8)).astype(np.float32), np.full(kinds, 0.5, np.float32)
        after = table.copy()
        descend(after, squares, rows, error, 0.15)
        for r in range(kinds):
            square = 0.5 + (wanted[r] ** 2).sum() / EQUAL
            assert squares[r] == pytest.approx(square, rel=1e-3)
            assert after[r, :6] == pytest.approx(table[r, :6] - 0.15 * wanted[r] / np.sqrt(square + 1), abs=1e-3)
            assert after[r, 6:].tolist() == table[r, 6:].tolist()  # rows may be wider than a softmax


def test_softmax_of_great_numbers():
    logits = np.array([[1000, 999, -1000], [0, 0, 0]], np.float32)
    wanted = [[0.731059, 0.268941, 0], [1 / 3] * 3]
    assert softmax(logits) == pytest.approx(np.array(wanted), abs=1e-5)


def test_kinds_tell_members_and_lots():
    options = language_model.Options()
    some = pa.array(["", "the", "walking", "talking", "walking.", "é"], pa.large_string())
    hashes = np.array([3, -5, 7, 1 << 62, -(1 << 60), 9])
    kinds = language_model.kinds_of(some, hashes, ["", "the"], options)
    assert kinds[:2].tolist() == [0, 1] and kinds.max() < options.kinds < 1 << 16
    assert options.member_of_kind()[kinds].tolist()[2:] == (options.frequent + language_model.ending_bucket(some, options.endings))[2:].tolist()
    assert ((kinds - options.frequent) // options.slots % options.lots).tolist()[2:] == (hashes % options.lots)[2:].tolist()
