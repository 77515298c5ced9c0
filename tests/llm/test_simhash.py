import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from samples import LONG, ODD, documents, prose, rows_of

from breathline.llm import simhash
from breathline.llm.text import row_key

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint_of(text, n=3):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate(A_TO_Z)) if w]
    shingles = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, limit):
    group = list(range(len(prints)))

    def top(i):
        while group[i] != i:
            i = group[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= limit:
                group[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(prints))]


def near_copies(seed=0):
    rng = random.Random(seed)
    rows = list(ODD)
    for base in prose(6, seed, 200):
        words = base.split()
        for _ in range(8):
            words = list(words)
            words[rng.randrange(len(words))] = "anders"
            rows.append((rng.randrange(1000, 9999), " ".join(words)))
        rows += [(rng.randrange(1000, 9999), base)] * 3
    return rows + [(100 + i, t) for i, t in enumerate(prose(30, seed + 1))]


def test_groups_against_all_pairs(spark):
    rows = near_copies()
    prints = [fingerprint_of(t) for _, t in rows]
    assert len(LONG) > 100_000
    group = components(prints, 3)
    smallest = {}
    for (i, _), g in zip(rows, group):
        if i is not None:
            smallest[g] = min(i, smallest.get(g, i))
    found = simhash.near_duplicates(documents(spark, rows))
    assert rows_of(found.select("doc_id", "fingerprint", "first.doc_id")) == sorted(
        [(i, p - (p >> 63 << 64), smallest.get(g)) for (i, _), p, g in zip(rows, prints, group)], key=repr
    )
    kept = simhash.deduplicate(documents(spark, rows))
    assert kept.columns == documents(spark, []).columns
    texts = {}
    for r in kept.collect():
        texts.setdefault(fingerprint_of(r.text), []).append(r.doc_id)
    by_group = dict(zip(prints, group))
    assert sorted(by_group[p] for p in texts) == sorted(set(group))
    assert all(ids == [smallest.get(by_group[p])] for p, ids in texts.items())


@pytest.mark.parametrize("n", [0, 1, 2, 3, 64, 257])
def test_index_finds_every_pair(n):
    rng = np.random.default_rng(n)
    prints = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
    if n > 3:
        flips = rng.integers(0, 64, (n // 2, 3)).astype(np.uint64)
        prints = np.unique(np.append(prints, prints[: n // 2] ^ np.bitwise_or.reduce(np.uint64(1) << flips, axis=1)))
    if not len(prints):
        return
    index = simhash.GrayIndex(prints)
    ranks = simhash.gray_rank(index.prints)
    assert (ranks[1:] > ranks[:-1]).all()
    queries = np.append(prints[::3], ~prints[:5])
    found = {(int(q), int(f)) for qs, fs in index.within(queries, 3, at_once=50) for q, f in zip(qs, fs)}
    apart = np.bitwise_count(queries[:, None] ^ index.prints)
    assert found == set(map(tuple, np.argwhere(apart <= 3).tolist()))


def test_gray_rank_counts_the_code():
    code = [i ^ i >> 1 for i in range(64)]
    assert simhash.gray_rank(np.array(code, np.uint64)).tolist() == list(range(64))


@pytest.mark.parametrize("options", [{}, {"block_size": 40}, {"block_size": 40, "visitors": 50}])
def test_links_connect_what_all_pairs_do(spark, options):
    rng = np.random.default_rng(8)
    some = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    # a dense ball, chains, and strangers; fingerprints with the highest bit as well
    ball = some[0] ^ (np.uint64(1) << rng.integers(0, 64, 80).astype(np.uint64))
    chain = np.bitwise_xor.accumulate(np.append(some[1], np.uint64(7) << (np.uint64(3) * np.arange(1, 20, dtype=np.uint64))))
    prints = np.unique(np.concatenate([some, ball, chain, ~chain, np.zeros(1, np.uint64)]))
    df = spark.createDataFrame(pa.table({"fingerprint": prints.view(np.int64)}).to_pandas())
    edges = simhash.links(df, 3, **options)
    for x, y in edges.collect():
        assert x != y
    labels = {r.node: r.label for r in simhash.connected(edges).collect()}
    values = [int(v) for v in prints]
    group = components(values, 3)
    signed = prints.view(np.int64).tolist()
    mine = [labels.get(v, v) for v in signed]
    assert len(set(zip(group, mine))) == len(set(group)) == len(set(mine))


def test_long_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501)], "x long, y long")
    assert rows_of(simhash.connected(edges)) == sorted([(i, 0) for i in range(201)] + [(500, 500), (501, 500)], key=repr)


def test_no_documents(spark):
    assert simhash.near_duplicates(documents(spark, [])).count() == 0
    assert simhash.deduplicate(documents(spark, [])).count() == 0


def test_row_keys_tell_nulls_apart(spark):
    df = spark.createDataFrame([(None, "a"), (1, None), (None, None), (1, "a"), (42, "a"), (1, "")], "doc_id long, text string")
    assert df.select(row_key("doc_id", "text")).distinct().count() == 6
