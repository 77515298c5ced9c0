"""The operators on the given tables, as registered queries, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import new_path
from . import attention, chat_queries, contamination, language_model, licenses, packing, quality, records, secrets, simhash, urls
from .text import id_remainder

WORD_BPE = "word_bpe_49k.json"


def tokenizer(name: str = WORD_BPE) -> str:
    """Path of an installed public tokenizer file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_token_records(spark: SparkSession, folder: str) -> DataFrame:
    target = new_path(spark)
    records.write_records(table(spark, folder, "documents"), target, tokenizer(), end_id=2)
    return records.read_records(spark, target).select(
        "doc_id",
        "start",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.crc32("ids").alias("ids_crc32"),
    )


# The rules of the query on `pages`.
URL_RULES = [
    urls.Rule("block", "net", "/"),
    urls.Rule("allow", "example.net", "/en/"),
    urls.Rule("block", "example.com", "/de/"),
    urls.Rule("allow", "org", "/fr/"),
]


def op2_url_rules(spark: SparkSession, folder: str) -> DataFrame:
    return urls.judge(table(spark, folder, "pages"), urls.rule_table(spark, URL_RULES))


def op3_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality.judge(table(spark, folder, "documents"), carry=["doc_id"])
    return judged.select(
        "doc.doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        "kept",
        F.round("probability", 6).alias("probability"),
    )


def op4_language_model(spark: SparkSession, folder: str) -> DataFrame:
    held_out = id_remainder("doc_id", 10) == 0
    scored = language_model.score(table(spark, folder, "documents"), held_out)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op5_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    packed = packing.pack(table(spark, folder, "documents"), tokenizer(), end_id=0, capacity=2048)
    return packed.select(
        "doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"), "sequence_id", "offset"
    )


def op6_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contamination.find_contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        contamination.words_hit().alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.is_contaminated().alias("contaminated"),
    )


def op7_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan_licenses(table(spark, folder, "documents"))
    starts = "transform(places, p -> p.start)"
    base, more = "transform(places, p -> p.label)", "transform(spans, s -> s.label)"
    return found.selectExpr(
        "doc_id",
        "n_words",
        "CAST(size(places) AS long) AS n_base",
        f"array_min({starts}) AS first_word",
        f"array_max({starts}) AS last_word",
        f"array_join(array_sort(array_distinct({base})), ',') AS base_labels",
        f"array_join(array_sort(array_distinct(concat({base}, {more}))), ',') AS labels",
        "greatest(if(size(places) > 0, 1D, 0D), coalesce(array_max(transform(spans, s -> s.coverage)), 0D)) AS score",
    )


def op8_simhash_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, folder, "documents"), shingle=3, max_bits=3)
    return found.select(
        "doc_id",
        F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"),
        F.col("first.doc_id").alias("component_id"),
    )


def op9_attention_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    usable = labels.where(id_remainder("doc_id", 5) != 0).select("doc_id", F.col("quality").alias("label"))
    options = attention.Options()
    scored = attention.score_quality(docs, attention.train(docs, usable, options), options.passage_words)
    return scored.select(
        "doc_id",
        (id_remainder("doc_id", 5) == 0).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"),
    )


def op10_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan_secrets(table(spark, folder, "documents"), ["doc_id"], secrets.EVERY_TEXT)
    base = "filter(spans, s -> s.kind <> 'model')"

    def listed(spans: str) -> str:
        return f"array_join(transform({spans}, s -> concat(s.kind, ':', s.start, ':', s.end)), ',')"

    return found.selectExpr(
        "doc.doc_id",
        *[f"CAST(size(filter(spans, s -> s.kind = '{k}')) AS long) AS n_{k}" for k in ("assign", "access", "hex")],
        f"sha2({listed(base)}, 256) AS base_sha256",
        f"{listed('spans')} AS spans",
    )


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_records,
        op2_url_rules,
        op3_quality_rules,
        op4_language_model,
        op5_best_fit_packing,
        op6_benchmark_decontamination,
        op7_license_scan,
        op8_simhash_near_duplicates,
        op9_attention_quality,
        op10_secret_scan,
    )
} | chat_queries.QUERIES

# Words of a text, lower-cased A-Z, for the oracle.
_FOLDED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = rf"regexp_extract_all({_FOLDED}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"


def _votes_sql() -> str:
    """The rules' votes as a list, straight from their two conditions each."""
    cases = [
        f"CASE WHEN n_words = 0 THEN 0 WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END" for good, bad in quality.RULES.values()
    ]
    return f"[{', '.join(cases)}]"


def _share_sql(wanted: int, weight: str, least: float) -> str:
    """How often the rules vote as wanted, in the mean over documents weighted by what they are believed to be."""

    def total(condition: str) -> str:
        return f"list_sum(list_transform(e, lambda x: CASE WHEN {condition} THEN x.n * {weight} ELSE 0.0 END))"

    return (
        f"list_transform(range(1, {len(quality.RULES) + 1}), lambda j: greatest({least}::DOUBLE,"
        f" (1 + {total(f'x.v[j] = {wanted}')}) / (2 + {total('x.v[j] <> 0')})))"
    )


def _believed_sql(votes: str) -> str:
    rules = f"range(1, {len(quality.RULES) + 1})"

    def product(for_vote: str, rate: str) -> str:
        against = "-1" if for_vote == "1" else "1"
        each = f"CASE {votes}[j] WHEN {for_vote} THEN {rate}[j] WHEN {against} THEN 1 - {rate}[j] ELSE 1.0 END"
        return f"list_aggregate(list_transform({rules}, lambda j: {each}), 'product')"

    good, bad = f"prior * {product('1', 'good')}", f"(1 - prior) * {product('-1', 'bad')}"
    return f"({good}) / ({good} + {bad})"


ORACLE_SQL = {
    "op3_quality_rules": rf"""
        WITH RECURSIVE docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
        cut AS (
            SELECT r, doc_id, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
                   list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l FROM docs),
        windows AS (
            SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS phrase
            FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM cut)),
        twice AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, phrase) > 1),
        covered AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r),
        measured AS (
            SELECT r, doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars,
                   length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols,
                   len(l) - len(list_distinct(l)) AS n_dup_lines, len(l) AS n_lines, coalesce(n, 0) AS n_repeat_words,
                   length(regexp_replace(t, '[^\p{{L}}\p{{M}}\p{{N}}]+', '', 'g')) AS n_alphanumeric,
                   length(regexp_replace(t, '[^\p{{Lu}}]+', '', 'g')) AS n_capitals,
                   length(regexp_replace(t, '[^!]+', '', 'g')) AS n_exclamations,
                   length(regexp_replace(t, '[^.!?]+', '', 'g')) AS n_stops, len(list_distinct(w)) AS n_distinct
            FROM cut LEFT JOIN covered USING (r)),
        voted AS (
            SELECT *, {_votes_sql()} AS v, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM measured),
        patterns AS (SELECT list({{'v': v, 'n': n}} ORDER BY v) AS ps FROM (
            SELECT v, count(*) FILTER (NOT base_failed)::DOUBLE AS n FROM voted GROUP BY v)),
        em(i, prior, good, bad) AS (
            SELECT 0, 0.8::DOUBLE, list_transform(range({len(quality.RULES)}), lambda x: 0.99::DOUBLE),
                   list_transform(range({len(quality.RULES)}), lambda x: 0.25::DOUBLE)
            UNION ALL
            SELECT i + 1,
                   (1 + list_sum(list_transform(e, lambda x: x.n * x.q))) / (2 + list_sum(list_transform(e, lambda x: x.n))),
                   {_share_sql(1, 'x.q', 1 - 1 / quality.TRUSTED)}, {_share_sql(-1, '(1 - x.q)', 0)}
            FROM (SELECT i, list_transform(ps, lambda p: {{'v': p.v, 'n': p.n, 'q': {_believed_sql('p.v')}}}) AS e
                  FROM em CROSS JOIN patterns WHERE i < {quality.ITERATIONS})),
        believed AS (SELECT v, {_believed_sql('v')} AS probability
                     FROM (SELECT DISTINCT v FROM voted) CROSS JOIN em WHERE i = {quality.ITERATIONS})
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND probability >= 0.5 AS kept, round(probability, 6) AS probability
        FROM voted JOIN believed USING (v)""",
    "op2_url_rules": """
        WITH rules(host, path, verdict) AS (
            VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'),
                   ('org', '/fr/', 'allow')),
        rests AS (
            SELECT row_number() OVER () AS r, page_id,
                   CASE WHEN contains(url, '://') THEN url[strpos(url, '://') + 3:] ELSE '' END AS rest FROM pages),
        parts AS (
            SELECT r, page_id, regexp_extract(rest, '^[^/?#]*') AS raw, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM rests),
        hosts AS (
            SELECT r, page_id, path,
                   translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM parts),
        best AS (
            SELECT h.r, max_by(u.host || u.path, length(u.host || u.path)) AS rule,
                   max_by(verdict, length(u.host || u.path)) AS verdict
            FROM hosts h JOIN rules u
                 ON (h.host = u.host OR ends_with(h.host, '.' || u.host)) AND starts_with(h.path, u.path)
            GROUP BY h.r)
        SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM hosts LEFT JOIN best USING (r)""",
    "op6_benchmark_decontamination": f"""
        WITH item_words AS (SELECT item_id, {_ALNUM} AS w FROM benchmark),
        windows AS (
            SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS phrase
            FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM item_words WHERE len(w) > 0)),
        doc_words AS (SELECT doc_id, row_number() OVER () AS r, {_ALNUM} AS w FROM documents),
        places AS (
            SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS phrase
            FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM doc_words CROSS JOIN (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)),
        found AS (SELECT r, i, n, item_id FROM places JOIN windows USING (n, phrase)),
        hits AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM found) GROUP BY r),
        items AS (
            SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed
            FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM found) GROUP BY r)
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
               CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(listed, '')) AS items_sha256,
               coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM doc_words LEFT JOIN hits USING (r) LEFT JOIN items USING (r)""",
} | chat_queries.ORACLE_SQL
