import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from samples import LONG, ODD, documents, prose, rows_of

from breathline.llm import contamination, licenses
from breathline.llm.language_model import unsqueezed
from breathline.llm.licenses import SuffixAutomaton

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(A_TO_Z))


def windows_of(text, window):
    w = words_of(text)
    return [tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))] if w else []


def contamination_of(text, items, window):
    w, hit, found = words_of(text), set(), set()
    places = defaultdict(list)
    lengths = {len(p) for _, t in items for p in windows_of(t, window)}
    for n in lengths:
        for i in range(len(w) - n + 1):
            places[tuple(w[i : i + n])].append(i)
    for item, t in items:
        for phrase in windows_of(t, window):
            for i in places.get(phrase, ()):
                hit.update(range(i, i + len(phrase)))
                if item is not None:
                    found.add(str(item))
    return len(w), len(hit), tuple(sorted(found))


@pytest.mark.parametrize("block_bytes", [1 << 24, 300])
def test_windows_against_brute_force(spark, block_bytes):
    rng = random.Random(1)
    source = prose(12, 5, 60, 60)
    items = [(i, t) for i, t in enumerate(source[:6])] + [(6, "Zwei Wörter"), (6, "und drei, mehr"), (7, None), (8, ""), (9, "..")]
    items += [(None, source[6]), (2, source[7]), (10, "ja ja ja ja"), (11, source[0]), (0, source[0])]
    rows = ODD + [(50, source[0] + " x " + source[0]), (51, "ja " * 9), (52, "ein ZWEI wörter, und Drei mehr"), (53, source[6])]
    for i in range(40):
        a, b = rng.choice(source).split(), rng.choice(source).split()
        k, m = rng.randrange(len(a)), rng.randrange(20)
        rows.append((100 + i, " ".join(a[:k] + b[m : m + rng.randint(5, 40)] + a[k:])))
    rows += [rows[-1], rows[-1]]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found = contamination.find_contamination(documents(spark, rows), benchmark, window=7, block_bytes=block_bytes)
    assert rows_of(found.select("doc_id", "n_words", contamination.words_hit(), "items")) == sorted(
        [(i, n, h, list(f)) for i, t in rows for n, h, f in [contamination_of(t, items, 7)]], key=repr
    )
    judged = found.select("doc_id", "spans", "n_words", contamination.is_contaminated())
    for _, spans, n, bad in judged.collect():
        hit = sum(s.end - s.start for s in spans)
        assert bad == (hit > 0 and 20 * hit >= n)
        assert all(a.end < b.start for a, b in zip(spans, spans[1:]))
    clean = contamination.decontaminate(documents(spark, rows), benchmark, window=7, block_bytes=block_bytes)
    kept = sorted(([i, t] for i, t in rows for n, h, _ in [contamination_of(t, items, 7)] if not (h and 20 * h >= n)), key=repr)
    assert sorted(([r.doc_id, r.text] for r in clean.collect()), key=repr) == kept
    assert len(LONG) > 100_000


def test_close_terms(spark):
    benchmark = spark.createDataFrame([("q", "rote blaue gelbe grüne kugeln")], "item_id string, text string")
    rows = [(1, "gelbe x kugeln y rote z blaue grüne"), (2, "gelbe " + "x " * 40 + "kugeln rote blaue grüne"), (3, "gelbe kugeln rote")]
    found = contamination.find_contamination(documents(spark, rows), benchmark, near=10, rarest=4)
    assert rows_of(found.select("doc_id", "items", "near_items")) == [(1, [], ["q"]), (2, [], []), (3, [], [])]


def near_items_of(rows, items, near, rarest):
    """Plain definition: counts over all documents, then the distance of every place of the rarest word to the others."""
    texts_ = [words_of(t) for _, t in rows]
    counts = Counter(w for t in texts_ for w in t)
    found = []
    for (i, _), w in zip(rows, texts_):
        close = set()
        for item, t in items:
            own = sorted(set(words_of(t)), key=lambda x: (counts[x], x.encode()))
            if item is None or len(own) < 3 or not counts[own[0]]:
                continue
            places = [[k for k, x in enumerate(w) if x == term] for term in own[:rarest]]
            if any(all(any(abs(k - j) <= near for j in other) for other in places[1:]) for k in places[0]):
                close.add(str(item))
        found.append((i, sorted(close)))
    return found


def test_one_index_serves_several_benchmarks(spark, tmp_path):
    """Written once, searched for two benchmarks; what is near does not depend on how documents fall into segments."""
    rng = random.Random(8)
    source = prose(20, 9, 40, 120)
    rows = [*ODD[:-1]]
    for i in range(60):
        a, b = rng.choice(source).split(), rng.choice(source).split()
        k = rng.randrange(len(a))
        rows.append((100 + i, " ".join(a[:k] + rng.sample(b, min(len(b), 12)) + a[k:])))
    for parts in (1, 7):
        folder = str(tmp_path / f"index{parts}")
        contamination.index_documents(documents(spark, rows).repartition(parts), gap=9).write.parquet(folder)
        index = spark.read.parquet(folder)
        assert index.count() == parts
        for items in (list(enumerate(source[:8])), [(f"q{i}", t) for i, t in enumerate(source[5:])] + [("q1", "zwei wörter"), (None, source[1])]):
            benchmark = spark.createDataFrame([(str(i) if i is not None else None, t) for i, t in items], "item_id string, text string")
            for block_bytes in (1 << 22, 900):
                found = contamination.search_index(index, benchmark, 5, near=8, rarest=3, block_bytes=block_bytes)
                wanted = [(i, n, h, list(f)) for i, t in rows for n, h, f in [contamination_of(t, items, 5)]]
                assert rows_of(found.select("doc_id", "n_words", contamination.words_hit(), "items")) == sorted(wanted, key=repr)
                assert rows_of(found.select("doc_id", "near_items")) == sorted(near_items_of(rows, items, 8, 3), key=repr)


def test_a_large_batch_is_indexed_in_bounded_memory(spark, monkeypatch):
    """Segments of some megabytes whatever a batch holds, no word lost where stretches and segments meet."""
    monkeypatch.setattr(contamination, "map_arrow", lambda given, function, schema: function)
    build = contamination.index_documents(documents(spark, []), gap=5)
    rng = random.Random(4)
    known = [f"w{i:x}" for i in range(20_000)]
    rows = [" ".join(rng.choices(known, k=rng.choice([0, 1, 400, 2000]))) for _ in range(4_000)]
    ids = pa.array(range(len(rows)), pa.int64())
    key = pa.StructArray.from_arrays([ids, ids], names=["a", "b"])
    batch = pa.RecordBatch.from_arrays([ids, key, pa.array([r or None for r in rows])], names=["doc_id", "key", "text"])
    assert sum(map(len, rows)) > 12 << 20
    tracemalloc.start()
    try:
        segments = list(build(iter([batch])))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 64 << 20
    done = 0
    for segment in segments:
        names = np.array(segment.column("vocabulary")[0].as_py())
        counts, steps, first, n_words = (
            unsqueezed(segment.column(c)[0].as_py()) for c in ("counts", "postings", "first_position", "n_words")
        )
        at = np.full(first[-1] + n_words[-1], "", names.dtype)
        for term, of in zip(names, np.split(steps, np.cumsum(counts)[:-1])):
            at[np.cumsum(of)] = term
        for a, n in zip(first.tolist(), n_words.tolist()):
            assert at[a : a + n].tolist() == rows[done].split() and (at[a + n : a + n + 5] == "").all()
            done += 1
    assert done == len(rows)


def test_an_index_with_small_gaps_is_refused(spark):
    index = contamination.index_documents(documents(spark, [(1, "a b c")]), gap=3)
    benchmark = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    with pytest.raises(Exception, match="gaps of 3 words"):
        contamination.search_index(index, benchmark, near=3).collect()


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert rows_of(contamination.find_contamination(documents(spark, [(1, "a b")]), none).select("n_words", "spans")) == [(2, [])]
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert contamination.find_contamination(documents(spark, []), some).count() == 0
    assert licenses.scan_licenses(documents(spark, [])).count() == 0


def longest_suffix(sequence, i, sources):
    for n in range(i, 0, -1):
        if any(sequence[i - n : i] == s[k : k + n] for s in sources for k in range(len(s) - n + 1)):
            return n
    return 0


@pytest.mark.parametrize("seed", range(20))
def test_matching_statistics(seed):
    rng = random.Random(seed)
    sources = [[rng.randrange(3) for _ in range(rng.randint(1, 12))] for _ in range(rng.randint(1, 4))]
    automaton = SuffixAutomaton(sources)
    text = [rng.randrange(4) for _ in range(40)]
    for i, (state, length) in enumerate(automaton.statistics(text), 1):
        assert length == longest_suffix(text, i, sources)
        stretch = text[i - length : i]
        ends = [(n, k + length) for n, s in enumerate(sources) for k in range(len(s) - length + 1) if s[k : k + length] == stretch]
        assert length == 0 or sorted(automaton.ends(state)) == ends


def places_of(text, phrases):
    w = words_of(text)
    found = []
    for phrase, label in phrases:
        p = phrase.split()
        found += [(label, i) for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    return sorted(found)


def test_places_of_phrases(spark):
    rng = random.Random(2)
    known = ["mit", "license", "apache", "general", "public", "the", "under", "gnu", "released", "x"]
    rows = ODD + [(100 + i, rng.choice([" ", ", ", " / "]).join(rng.choice(known) for _ in range(60))) for i in range(60)]
    rows += [(200, "mit License " * 3000), (201, "MIT LICENSE"), (202, "licens mit"), (203, "permit license")]
    phrases = (*licenses.PHRASES, ("license", "any"), ("public license", "public"))
    found = licenses.scan_licenses(documents(spark, rows), phrases=phrases)
    order = lambda r: (repr(r[0]), r[1])
    got = [(r.doc_id, r.n_words, sorted((p.label, p.start) for p in r.places)) for r in found.collect()]
    assert sorted(got, key=order) == sorted([(i, len(words_of(t)), places_of(t, phrases)) for i, t in rows], key=order)


def whole(name):
    return (licenses.FOLDER / name).read_text("utf-8")


def spans_of(spark, rows, **options):
    found = licenses.scan_licenses(documents(spark, rows), **options).collect()
    return {r.doc_id: [(s.label, s.start, s.end, round(s.coverage, 2)) for s in r.spans] for r in found}


def test_spans_cover_templates(spark):
    mit = words_of(whole("mit.MIT.txt"))
    changed = [w if i % 15 != 7 else "anders" for i, w in enumerate(mit)]
    rows = [
        (1, "vor " * 5 + " ".join(mit) + " nach"),
        (2, "vor " * 5 + " ".join(changed) + " nach"),
        (3, " ".join(mit[:40])),
        (4, "Licensed under CC BY-NC 4.0."),
        (5, " ".join(mit) + " und noch einmal " + " ".join(mit)),
        (6, "the software is provided to the person and the license of the"),
        (7, "This work is licensed under CC BY-NC-SA 4.0"),
    ]
    found, n = spans_of(spark, rows), len(mit)
    assert found[1] == [("mit", 5, 5 + n, 1.0)]
    (label, start, end, coverage), = found[2]
    assert (label, start, end) == ("mit", 5, 5 + n) and 0.85 <= coverage < 1
    assert found[3] == [] and found[6] == []
    assert found[4] == [("cc-by-nc", 0, 7, 0.7)]
    assert found[5] == [("mit", 0, n, 1.0), ("mit", n + 3, 2 * n + 3, 1.0)]
    assert found[7] == [("cc-by-nc-sa", 0, 11, 1.0)]


def test_every_whole_licence_is_known(spark):
    """Each text as it is, reworded (every 23rd word another one), interrupted by six foreign words every 60, and its half."""
    names = sorted(p.name for p in licenses.FOLDER.glob("*.txt"))
    assert {n.split(".")[0] for n in names} == {"apache", "bsd", "cc0", "gpl", "isc", "lgpl", "mit", "mpl"}
    rows = []
    for k, name in enumerate(names):
        w = words_of(whole(name))
        reworded = [x if i % 23 != 11 else "anders" for i, x in enumerate(w)]
        interrupted = [y for i, x in enumerate(w) for y in ([x] if i % 60 != 59 else [*("fremd " * 6).split(), x])]
        rows += [(4 * k + j, " ".join(x)) for j, x in enumerate((w, reworded, interrupted, w[: len(w) // 2]))]
    found = spans_of(spark, rows)
    for k, name in enumerate(names):
        label, n = name.split(".")[0], len(words_of(whole(name)))
        assert found[4 * k] == [(label, 0, n, 1.0)]
        for j, least in ((1, 0.8), (2, 0.95)):
            (other, start, end, coverage), = found[4 * k + j]
            assert other == label and start == 0 and end >= n and coverage >= least, (name, found[4 * k + j])
        # half of a text is not that text, but may hold all of a notice, or of a shorter licence
        assert all(end - start < 0.6 * n for _, start, end, _ in found[4 * k + 3]), (name, found[4 * k + 3])


def test_ends_are_kept_once():
    """Whole licence texts: as many ends as words, where copies up the links would be many more."""
    scanner = licenses.own_scanner(licenses.PHRASES, licenses.licence_templates(), 4, 8)
    assert len(scanner.automaton.flat_ends) == sum(scanner.sizes)


def test_templates_are_a_parameter(spark, tmp_path):
    (tmp_path / "own.1.txt").write_text("Do as you like with this, but do not blame us for it.")
    templates = licenses.licence_templates(tmp_path)
    assert templates[0] == ("own", "do as you like with this but do not blame us for it")
    text = "So: do as you like with this; but do NOT blame us for it!"
    assert spans_of(spark, [(1, text), (2, None), (3, "")], templates=templates) == {1: [("own", 1, 14, 1.0)], 2: [], 3: []}
