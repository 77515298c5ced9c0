import hashlib
import math
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from test_contamination_licenses import places_of, words_of
from test_models import held, plain_spans, tokens_of
from test_records_packing import ids_of
from test_simhash import components, fingerprint_of

import __spark_entry__ as entry
import corpus_pipeline
from breathline.functions.lineage import materialise
from breathline.llm import licenses
from breathline.llm.queries import ORACLE_SQL, QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_is_registered():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES] == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLE_SQL) <= set(QUERIES)
    assert "pipeline" not in entry.oracle_sql()


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_against_sql(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "pages", "benchmark", "labels", "conversations"):
        connection.sql(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[name](spark, FOLDER)
    wanted = connection.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert found == sorted((tuple(r[wanted.columns.index(c)] for c in columns) for r in wanted.fetchall()), key=repr)


def test_pipeline(spark):
    docs = before = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialise(stage(spark, docs, FOLDER))
        assert docs.columns == before.columns, name
        kept.append({r.doc_id: r.text for r in docs.collect()})
        assert len(kept[-1]) == docs.count()
    good, distinct, clean, redacted = kept
    assert set(redacted) == set(clean) <= set(distinct) <= set(good)
    group = components([fingerprint_of(t) for t in good.values()], 3)
    ids = list(good)
    first = {}
    for i, g in zip(ids, group):
        first[g] = min(i, first.get(g, i))
    assert set(distinct) == set(first.values())
    assert not any(re.search(r"AKIA[A-Z0-9]{14}|[0-9a-f]{16}", t) for t in redacted.values())
    packed = corpus_pipeline.run(spark, FOLDER).collect()
    assert {r.doc_id for r in packed} == set(redacted)


@pytest.fixture(scope="module")
def texts():
    rows = duckdb.connect().sql(f"SELECT doc_id, text FROM '{FOLDER}/documents.parquet' ORDER BY doc_id").fetchall()
    assert len(rows) >= 200
    return rows


def rows_by_id(spark, name, *columns):
    rows = QUERIES[name](spark, FOLDER).collect()
    return sorted([tuple(r[c] for c in ("doc_id", *columns)) for r in rows], key=repr)


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_op1(spark, texts):
    wanted, start = [], 0
    for i, t in texts:
        ids = [*ids_of(t), 2]
        wanted.append((i, start, len(ids), crc(ids)))
        start += len(ids)
    assert rows_by_id(spark, "op1_token_records", "start", "n_tokens", "ids_crc32") == sorted(wanted, key=repr)


def test_op4(spark, texts):
    count = Counter(w for i, t in texts if not held(i) for w in tokens_of(t))
    n, v = sum(count.values()), len(count)
    found = rows_by_id(spark, "op4_language_model", "held_out", "n_tokens", "n_known", "train_tokens", "base_score")
    by_id = dict(texts)
    assert sorted(r[0] for r in found) == sorted(by_id)
    for row in found:
        i, t = row[0], by_id[row[0]]
        w = tokens_of(t)
        base = sum(math.log10((count[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w)
        assert row[:5] == (i, held(i), len(w), sum(count[x] > 0 for x in w), n)
        assert row[5] == pytest.approx(base, rel=1e-9)


def test_op5(spark, texts):
    wanted = []
    for i, t in texts:
        ids = [*ids_of(t), 0]
        wanted += [(i, k // 2048, k, len(ids[k : k + 2048]), crc(ids[k : k + 2048])) for k in range(0, len(ids), 2048)]
    found = rows_by_id(spark, "op5_best_fit_packing", "piece", "start", "length", "ids_crc32")
    assert found == sorted(wanted, key=repr)


def test_op7(spark, texts):
    columns = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    by_id = dict(texts)
    for row in rows_by_id(spark, "op7_license_scan", *columns):
        i, t = row[0], by_id[row[0]]
        places = places_of(t, licenses.PHRASES)
        starts = [s for _, s in places]
        labels = ",".join(sorted({a for a, _ in places}))
        assert row[:6] == (i, len(words_of(t)), len(places), min(starts, default=None), max(starts, default=None), labels)
        assert set(labels.split(",")) - {""} <= set(row[6].split(",")) and 0 <= row[7] <= 1


def test_op8(spark, texts):
    prints = [fingerprint_of(t) for _, t in texts]
    first = {}
    for (i, _), g in zip(texts, components(prints, 3)):
        first[g] = min(i, first.get(g, i))
    wanted = [(i, f"{p:016x}", first[g]) for (i, _), p, g in zip(texts, prints, components(prints, 3))]
    assert rows_by_id(spark, "op8_simhash_near_duplicates", "fingerprint", "component_id") == sorted(wanted, key=repr)


def test_op9(spark, texts):
    rows = rows_by_id(spark, "op9_attention_quality", "held_out", "score", "predicted")
    assert sorted(r[0] for r in rows) == sorted(i for i, _ in texts)
    for i, out, score, predicted in rows:
        assert out == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= score <= 1 and predicted == (score >= 0.3)


def test_op10(spark, texts):
    columns = ("n_assign", "n_access", "n_hex", "base_sha256", "spans")
    by_id = dict(texts)
    for row in rows_by_id(spark, "op10_secret_scan", *columns):
        i, t = row[0], by_id[row[0]]
        spans = plain_spans(t or "")
        listed = [f"{kind}:{a}:{b}" for a, kind, b in spans]
        kinds = [kind for _, kind, _ in spans]
        assert row[1:4] == tuple(kinds.count(k) for k in ("assign", "access", "hex"))
        assert row[4] == hashlib.sha256(",".join(listed).encode()).hexdigest()
        assert [s for s in row[5].split(",") if s and not s.startswith("model")] == listed


def test_quality_sql_on_odd_separators_and_combining_marks(spark, tmp_path):
    hindi = "यह एक साफ़ हिन्दी वाक्य है जिसमें कई मात्राएँ हैं।"
    rows = [(1, "\r".join(f"word{i}" for i in range(60)) + "."), (2, "\x0b".join(f"w{i}" for i in range(70)))]
    rows += [(3, "\x0c".join(f"x{i}" for i in range(55)) + "\r\n!"), (4, " ".join(f"{hindi}{i}" for i in range(12)))]
    rows += [(5, None), (6, ""), (7, "\x0b\x0c\r"), (8, "a\x1cb\x85c " * 60)]
    rows += [(10 + i, " ".join(f"wort{(i * 7 + k) % 211}" for k in range(90)) + ".") for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    connection = duckdb.connect()
    connection.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    df, wanted = QUERIES["op3_quality_rules"](spark, str(tmp_path)), connection.sql(ORACLE_SQL["op3_quality_rules"])
    columns = sorted(df.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert found == sorted((tuple(r[wanted.columns.index(c)] for c in columns) for r in wanted.fetchall()), key=repr)
    assert {r.doc_id: r.n_words for r in df.collect()}[1] == 60
