import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from samples import LONG, ODD, documents, prose
from tokenizers import Tokenizer

from breathline.functions.lineage import new_path
from breathline.llm import packing, records
from breathline.llm.text import texts
from breathline.llm.tokens import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)
ENCODER = Encoder(PATH, remembered=50)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=60), st.text("ab'sté.,<|endoftxsar> \n\t\x85\u00a0İΣ1", max_size=60)), max_size=8))
def test_chunks_encode_like_whole_texts(some):
    ids, begins = ENCODER.encode(texts(pa.array(some, pa.string())))
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [ids_of(t) for t in some]


def test_whole_texts_by_any_tokenizer():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids, begins = Encoder(path, by_chunk=False).encode(texts(pa.array(["a  b\n", None, "c"])))
    whole = Tokenizer.from_file(path)
    assert [ids[a:b].tolist() for a, b in zip(begins, begins[1:])] == [whole.encode(t).ids for t in ("a  b\n", "", "c")]


def test_records_round_trip(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(prose(40))]
    folder = new_path(spark)
    records.write_records(documents(spark, rows), folder, PATH, end_id=2)
    read = records.read_records(spark, folder, 3).collect()
    wanted = sorted([(i, [*ids_of(t), 2]) for i, t in rows], key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    found = sorted(
        [(r.doc_id, np.frombuffer(r.ids, "<u4").tolist()) for r in read], key=lambda r: (r[0] is not None, r[0] or 0, r[1])
    )
    assert found == wanted
    # the records follow each other, in the order of their ids
    read.sort(key=lambda r: r.start)
    assert [r.start for r in read] == np.cumsum([0] + [len(r.ids) // 4 for r in read])[:-1].tolist()
    order = [-1 if r.doc_id is None else r.doc_id for r in read]
    assert order == sorted(order)
    shuffled = records.read_shuffled(spark, folder, seed=5).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in shuffled) == sorted(
        (r.doc_id is None, r.doc_id or 0, bytes(r.ids)) for r in read
    )
    assert [r.place for r in shuffled] == sorted(r.place for r in shuffled)
    assert [r.place for r in shuffled] != [r.place for r in records.read_shuffled(spark, folder, seed=6).collect()]


def test_no_documents(spark):
    folder = new_path(spark)
    records.write_records(documents(spark, []), folder, PATH, end_id=2)
    assert records.read_records(spark, folder).count() == 0
    assert packing.pack(documents(spark, []), PATH, 0).count() == 0


def test_frames_show_damage():
    data = records.frame(b"payload") + records.frame(b"")
    content, after = records.unframe(data)
    assert content == b"payload" and records.unframe(data, after) == (b"", len(data))
    for i in range(len(records.frame(b"payload"))):
        broken = bytearray(data)
        broken[i] ^= 1
        with pytest.raises(ValueError):
            records.unframe(bytes(broken))
    with pytest.raises(ValueError):
        records.unframe(data[:-1], after)
    assert records.masked(b"") == records.MASK
    crc = zlib.crc32(b"abc")
    assert records.masked(b"abc") == (((crc >> 15) | (crc << 17 & 0xFFFFFFFF)) + records.MASK) & 0xFFFFFFFF


def naive_sum_of_squares(sizes, capacity):
    gaps, bins = [], []
    for size in sizes:
        options = []
        for at in [*range(len(gaps)), None]:
            after = [*gaps]
            if at is None:
                after.append(capacity - size)
            elif gaps[at] >= size:
                after[at] -= size
            else:
                continue
            open_gaps = [g for g in after if g]
            options.append((sum(open_gaps.count(g) ** 2 for g in set(open_gaps)), at is None, gaps[at] if at is not None else 0))
        _, new, gap = min(options)
        if new:
            gaps.append(capacity - size)
        else:
            gaps[gaps.index(gap)] -= size
        bins.append(sorted(gaps))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=25))
def test_sum_of_squares_rule(sizes):
    bins, used, states = packing.SumOfSquares(12), {}, []
    for size in sizes:
        chosen, offset = bins.place(size)
        assert used.get(chosen, 0) == offset
        used[chosen] = offset + size
        states.append(sorted(12 - u for u in used.values()))
    assert states == naive_sum_of_squares(sizes, 12)


def test_packing(spark):
    rows = ODD + [(100 + i, t) for i, t in enumerate(prose(60))]
    found = packing.pack(documents(spark, rows).coalesce(2), PATH, end_id=0, capacity=256).collect()
    by_sequence = {}
    for r in found:
        assert r.length == len(r.ids) // 4 <= 256
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 256
    total = sum(r.length for r in found)
    assert len(by_sequence) <= 1.02 * total / 256 + 6
    wanted = []
    for i, t in rows:
        ids = [*ids_of(t), 0]
        wanted += [(i is None, i or 0, k // 256, k, ids[k : k + 256]) for k in range(0, len(ids), 256)]
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in found) == sorted(wanted)
    assert len(LONG) > 100_000


@pytest.mark.parametrize(("splits", "group_pieces"), [(1, 200_000), (8, 200_000), (200, 200_000), (40, 300)])
def test_splits_hardly_cost_any_sequences(spark, splits, group_pieces):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(splits)
    found = packing.pack(docs, PATH, end_id=0, group_pieces=group_pieces).drop("ids").collect()
    by_sequence = {}
    for r in found:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        places.sort()
        assert [a for a, _ in places] == [0, *np.cumsum([n for _, n in places])[:-1].tolist()]
        assert sum(n for _, n in places) <= 2048
    assert len({(r.doc_id, r.piece) for r in found}) == len(found)
    least = -(-sum(r.length for r in found) // 2048)
    groups = 1 + len(found) // group_pieces
    assert len(by_sequence) <= 1.01 * least + groups


def test_packing_of_nothing(spark):
    assert packing.pack(documents(spark, []), PATH, end_id=0).collect() == []
    (only,) = packing.pack(documents(spark, [(None, None)]), PATH, end_id=9).collect()
    assert (only.doc_id, only.piece, only.length, only.offset, bytes(only.ids)) == (None, 0, 1, 0, b"\x09\0\0\0")
