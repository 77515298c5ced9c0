import random
import re

import pytest
from samples import LONG, ODD, documents, prose, rows_of

from breathline.llm import quality, urls

A_TO_Z = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts_of(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    return host.translate(A_TO_Z), re.match(r"[^?#]*", rest[len(host) :])[0]


def verdict_of(url, rules):
    host, path = parts_of(url)
    fitting = [
        (len(r.host + r.path), len(r.host), r.verdict == "block", r)
        for r in rules
        if host and (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)
    ]
    if not fitting:
        return host, path, None, "allow"
    best = max(fitting, key=lambda f: f[:3])[-1]
    return host, path, best.host + best.path, best.verdict


@pytest.mark.parametrize("seed", range(2))
def test_sweep_against_every_rule(spark, seed):
    rng = random.Random(seed)
    labels, steps = ["a", "b", "com", "net", "x-y"], ["/", "/p", "/p/q", "/p/q/r", "/pq", "/ü"]

    def host():
        return ".".join(rng.choice(labels) for _ in range(rng.randint(1, 4)))

    rules = [urls.Rule(rng.choice(["block", "allow"]), host(), rng.choice(steps)) for _ in range(60)]
    rules += [rules[0], urls.Rule("block", rules[1].host, rules[1].path)]
    given = [
        rng.choice(["http://", "HTTPS://", "", "//"]) + rng.choice([str, str.upper])(host()) + rng.choice(steps + [""])
        + rng.choice(["", "/more", "?q=1", "#f", "?a://b"])
        for _ in range(400)
    ]
    given += [None, "", "://", "http://", "http:///p", "http://a..com/p", "x://com?net/", given[0], given[0]]
    pages = [(None if i == 3 else i, u, "clash") for i, u in enumerate(given)] + [(0, given[0], "clash")]
    df = spark.createDataFrame(pages, "page_id long, url string, host string").repartition(3)
    found = rows_of(urls.judge(df, urls.rule_table(spark, rules)))
    assert found == sorted([(i, *verdict_of(u, rules)) for i, u, _ in pages], key=repr)


def test_no_pages_and_no_rules(spark):
    none = spark.createDataFrame([], "page_id string, url string")
    assert urls.judge(none, urls.rule_table(spark, [urls.Rule("block", "net")])).count() == 0
    one = spark.createDataFrame([("p", "http://x.net/")], "page_id string, url string")
    assert rows_of(urls.judge(one, urls.rule_table(spark, []), "block")) == [("p", "x.net", "/", None, "block")]


def measures_of(text):
    text = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = {}
    for w in windows:
        counts[w] = counts.get(w, 0) + 1
    covered = {i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(3)}
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


REPEATS = [
    (20, "a b c a b c d"),
    (21, "x x x x"),
    (22, "eins zwei drei\nvier\n\neins zwei drei\n \nvier\x0bfünf $$ <a|b>\r\nvier"),
    (23, "la la la " * 400),
    (24, "p q r s p q r t " * 3 + "p q"),
]


def test_measures(spark):
    rows = ODD + REPEATS + [(100 + i, t) for i, t in enumerate(prose(5))]
    judged = quality.judge(documents(spark, rows))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    assert rows_of(judged.select("doc.doc_id", *names)) == sorted([(i, *measures_of(t)) for i, t in rows], key=repr)
    assert judged.where("kept AND base_failed").count() == 0
    assert len(LONG) > 100_000


def expectation_maximisation(patterns, k, rounds):
    prior, good, bad = 0.8, [0.99] * k, [0.25] * k

    def posterior(votes):
        g, b = prior, 1 - prior
        for j, v in enumerate(votes):
            g *= good[j] if v == 1 else 1 - good[j] if v == -1 else 1
            b *= bad[j] if v == -1 else 1 - bad[j] if v == 1 else 1
        return g / (g + b)

    for _ in range(rounds):
        q = {votes: posterior(votes) for votes in patterns}
        total = sum(patterns.values())
        prior = (1 + sum(n * q[v] for v, n in patterns.items())) / (2 + total)
        good, bad = (
            [
                max(least, (1 + sum(n * w(q[v]) for v, n in patterns.items() if v[j] == wanted))
                / (2 + sum(n * w(q[v]) for v, n in patterns.items() if v[j])))
                for j in range(k)
            ]
            for wanted, w, least in ((1, lambda x: x, 1 - 1 / quality.TRUSTED), (-1, lambda x: 1 - x, 0))
        )
    return {v: posterior(v) for v in patterns}


def test_model_against_plain_loops(spark):
    rng = random.Random(4)
    patterns = {tuple(rng.choice([-1, 0, 1, 1]) for _ in range(3)): rng.randint(1, 50) for _ in range(12)}
    rows = [(sum((v + 1) * 3**j for j, v in enumerate(votes)), n % 7 == 9) for votes, n in patterns.items() for _ in range(n)]
    voted = spark.createDataFrame(rows + [(0, True)] * 5, "pattern int, base_failed boolean")
    rules = dict.fromkeys("xyz", ("", ""))
    model = quality.fit(voted, rules, 7).selectExpr("explode(patterns) AS p", "m")
    found = model.selectExpr("p.votes", f"{quality._posterior('p.votes', 3)} AS q").collect()
    wanted = expectation_maximisation(patterns, 3, 7)
    checked = [(tuple(r.votes), r.q) for r in found if tuple(r.votes) in wanted]
    assert len(checked) == len(wanted)
    for votes, q in checked:
        assert q == pytest.approx(wanted[votes], rel=1e-9)


def test_junk_of_several_kinds_goes(spark):
    clean = prose(300, words=200, vocabulary=3000)
    junk = [" ".join(w + "###" for w in t.split()) for t in prose(20, 1, 200, 3000)]
    junk += [" | ".join(t.split()) for t in prose(20, 2, 200, 3000)]
    junk += [" ".join(w.upper() + "!!" for w in t.split()) for t in prose(20, 3, 200, 3000)]
    docs = documents(spark, list(enumerate(clean + junk)))
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == list(range(300))


def test_clean_texts_in_scripts_with_combining_marks_stay(spark):
    rng = random.Random(8)

    def script(letters, marks):
        """Words of letters that each carry a vowel sign in most places."""
        known = ["".join(rng.choice(letters) + rng.choice(marks + [""]) for _ in range(rng.randint(2, 5))) for _ in range(3000)]
        words = [rng.choice(known) + ("." if k % 12 == 11 else "") for k in range(200)]
        return " ".join(words)

    hindi = ([chr(c) for c in range(0x915, 0x939)], [chr(c) for c in range(0x93E, 0x94D)])
    tamil = (list("கஙசஞடணதநபமயரலவ"), list("ாிீுூெேைொோௌ்"))
    arabic = (list("بتثجحخدذرزسشصضطظعغفقكلمنهي"), [chr(c) for c in range(0x64B, 0x653)])
    clean = prose(200, words=200, vocabulary=3000)
    clean += [script(*s) for s in (hindi, tamil, arabic) for _ in range(34)]
    junk = [" ".join(w + "###" for w in t.split()) for t in prose(20, 1, 200, 3000)]
    kept = quality.keep_good(documents(spark, list(enumerate(clean + junk))))
    assert sorted(r.doc_id for r in kept.collect()) == list(range(len(clean)))


def test_no_documents(spark):
    assert quality.judge(documents(spark, [])).count() == 0
