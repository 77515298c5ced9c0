import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from test_records_packing import ids_of

from breathline.llm import chat, prefix_trie, repair
from breathline.llm.chat_queries import ORACLE_SQL, QUERIES, SPIKED, tokenizer

FOLDER = "/root/testdata/sf0.001"
SCHEMA = "conv_id long, turn long, role string, text string"
LONG = "Ein langer Satz mit vielen Worten. " * 30_000
ODD = [
    # nulls everywhere, also in the ids; ties; repeated rows
    *[(None, None, None, None), (None, None, None, None), (None, 3, "user", "No id.")],
    *[(0, None, "system", "Null turn first."), (0, 0, "user", "Hi."), (0, 0, "user", "Hi."), (0, 0, "assistant", "tie")],
    *[(1, 5, "user", ""), (1, 7, "assistant", " \t\n"), (1, 9, None, "Nobody."), (1, 9, "tool", None)],
    *[(3, 0, "assistant", "First."), (3, 1, "assistant", "Second"), (3, 2, "system", "Late system.")],
    # only a source, a turnless rebuilt conversation, roles with control strings and new lines
    *[(5, 0, "user", "Shared?"), (5, 1, "assistant", "Yes!"), (6, 0, "user", "Own.")],
    *[(12, 0, "us\ner", "Odd\nrole."), (12, 1, "<|text|>", "<s>[\\INST] </s>"), (12, 2, "", "é漢字   é?")],
    *[(20, 0, "system", LONG), (20, 1, "user", LONG + "?"), (20, 2, "assistant", LONG), (20, 3, "user", "Short.")],
    *[(30, t, ("user", "assistant")[t % 2], f"Turn {t} of many words, all of them short.") for t in range(300)],
]


def conversations(spark, rows, clashes=True):
    """``rows`` with further columns whose names the operators use themselves."""
    df = spark.createDataFrame(rows, SCHEMA)
    names = ("before", "tokens", "fault", "copy", "own", "digest", "size", "family", "borrowed", "window", "id")
    return df.selectExpr("*", *[f"'x' AS `{n}`" for n in names]) if clashes else df


def saved(spark, tmp_path, rows):
    conversations(spark, rows).repartition(3).write.parquet(f"{tmp_path}/conversations.parquet")
    return str(tmp_path)


def against_sql(spark, name, folder):
    connection = duckdb.connect()
    files = f"{folder}/conversations.parquet"
    connection.sql(f"CREATE VIEW conversations AS SELECT * FROM '{files if folder == FOLDER else files + '/*.parquet'}'")
    df, wanted = QUERIES[name](spark, folder), connection.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert columns == sorted(wanted.columns)
    found = sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)
    assert found == sorted((tuple(r[wanted.columns.index(c)] for c in columns) for r in wanted.fetchall()), key=repr)
    return found


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_odd_rows_against_sql(spark, tmp_path, name):
    assert against_sql(spark, name, saved(spark, tmp_path, ODD))


@pytest.mark.parametrize("name", list(ORACLE_SQL))
def test_random_conversations_against_sql(spark, tmp_path, name):
    rng = random.Random(7)
    says = ["Yes.", "No!", "Why", "", " ", "Same text?", None]
    roles = ["system", "user", "user", "assistant", "assistant", "tool", None]
    rows = [
        (c, rng.choice([t, t, t, 0, None]), rng.choice(roles), rng.choice(says))
        for c in [*range(120), *range(200, 203)]
        for t in range(rng.randint(1, 9))
    ]
    assert against_sql(spark, name, saved(spark, tmp_path, rows))


def test_empty_tables(spark, tmp_path):
    folder = saved(spark, tmp_path, [])
    assert [r.conv_id for r in QUERIES["op11_chat_formatting"](spark, folder).collect()] == [-1]
    for name in ORACLE_SQL:
        assert against_sql(spark, name, folder) == []


# chat formatting ----------------------------------------------------------------------------------------------------


def in_order(rows):
    """Conversations as lists of (role, text), by turn, nulls first, then role and text."""
    out = {}
    for c, t, r, x in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, (r[2] or "").encode(), (r[3] or "").encode())):
        out.setdefault(c, []).append((r or "", x or ""))
    return out


def plain_windows(turns, template, limits):
    """The windows of one conversation as lists of indices: (repeated, new)."""
    cost = [
        len(ids_of(template.escape(x))) + (2 if r in template.marks else 3 + len(ids_of(r))) for r, x in turns
    ]
    system = 0 if turns[0][0] == "system" else None
    out, at = [], 0
    while at < len(turns):
        kept = [system] if system is not None and at > 0 else []
        used = template.mark_tokens + sum(cost[i] for i in kept)
        room = min(limits.history, limits.budget - used - cost[at])
        back = at
        while back > (1 if system is not None else 0) and sum(cost[back - 1 : at]) <= room:
            back -= 1
        kept += range(back, at)
        used += sum(cost[back:at])
        stop = at + 1
        used += cost[at]
        while stop < len(turns) and used + cost[stop] <= limits.budget:
            used += cost[stop]
            stop += 1
        out.append((kept, list(range(at, stop)), used))
        at = stop
    return out


@pytest.mark.parametrize("limits", [chat.Limits(), chat.Limits(60, 30), chat.Limits(20, 0), chat.Limits(100, 1000)])
def test_windows_against_plain_loops(spark, limits):
    template = chat.Template()
    rows = conversations(spark, ODD).repartition(5)
    found = {}
    for w in chat.format_chats(rows, tokenizer(), template, limits).collect():
        found.setdefault(w.conv_id, {})[w.window] = w
    for conv_id, turns in in_order(ODD).items():
        for n, (kept, new, tokens) in enumerate(plain_windows(turns, template, limits)):
            window = found[conv_id].pop(n)
            assert template.parse(window.text) == [turns[i] for i in [*kept, *new]]
            assert (window.repeated, window.n_tokens) == (len(kept), tokens)
            assert tokens <= limits.budget or len(new) == 1
            targets = [template.unescape(window.text[a:b]) for a, b in zip(window.loss_begins, window.loss_ends)]
            assert targets == [turns[i][1] for i in new if turns[i][0] == "assistant"]
        assert not found.pop(conv_id)
    assert not found


def test_turns_come_back(spark):
    windows = chat.format_chats(conversations(spark, ODD), tokenizer(), limits=chat.Limits(80, 20))
    read = {}
    for r in chat.read_turns(windows).collect():
        read.setdefault(r.conv_id, []).append((r.window, r.role, r.text))
    wanted = in_order(ODD)
    assert {c: [(r, t) for _, r, t in sorted(rows, key=lambda x: x[0])] for c, rows in read.items()} == wanted


def test_escaping_is_reversible_and_leaves_no_control_string():
    template, rng = chat.Template(), random.Random(3)
    bits = [*template.controls, "\\", "<", "[", "|", "/", "s>", "INST]", "SYS>>", "x", " ", "\n", "<\\/s>", "[\\\\INST]"]
    for _ in range(20_000):
        turns = [
            (rng.choice(["system", "user", "assistant", "", "<|text|>", " x"]), "".join(rng.choices(bits, k=rng.randint(0, 6))))
            for _ in range(rng.randint(0, 4))
        ]
        escaped = [template.escape(x) for _, x in turns]
        assert not any(c in e for c in template.controls for e in escaped)
        assert [template.unescape(e) for e in escaped] == [x for _, x in turns]
        whole = template.begin + "".join(template.turn(r, e)[0] for (r, _), e in zip(turns, escaped))
        assert template.parse(whole) == turns


def test_templates_that_cannot_be_read_back_are_refused():
    with pytest.raises(ValueError, match="control string"):
        chat.Template(marks={"user": ("U: ", "\n")})
    with pytest.raises(ValueError, match="overlap"):
        chat.Template(controls=(*chat.Template().controls, "<<s>"))
    with pytest.raises(ValueError, match="begins with another"):
        chat.Template(marks={"user": ("[INST] ", "[/INST]"), "tool": ("[INST] x", "</s>")})
    with pytest.raises(ValueError):
        chat.Template().parse("<s>[INST] never closed")


def test_op11(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", SPIKED), (-1, 1, "assistant", SPIKED)]
    template = chat.Template()
    wanted = []
    for c, turns in in_order(rows).items():
        said = "".join(f"{r}\n{x}\n" for r, x in turns)
        loss = "".join(x for r, x in turns if r == "assistant")
        chars = sum(
            len(template.begin) + sum(len(template.turn(turns[i][0], template.escape(turns[i][1]))[0]) for i in [*kept, *new])
            for kept, new, _ in plain_windows(turns, template, chat.Limits())
        )
        wanted.append((c, len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars))
    assert sorted(tuple(r) for r in QUERIES["op11_chat_formatting"](spark, FOLDER).collect()) == sorted(wanted)


# structure repair ---------------------------------------------------------------------------------------------------


def cheapest(rows, costs):
    """By trying everything, with at most two insertions in one place: (cost, audit)."""
    follows = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    best = None

    def go(i, place, cost, audit, inserted):
        nonlocal best
        if best and cost > best[0]:
            return
        if i == len(rows) and place in (0, 3):
            best = min(best or (cost, audit), (cost, audit))
        if inserted < 2:
            for x in "ua":
                if x in follows[place]:
                    go(i, follows[place][x], cost + costs.insert, audit + "I", inserted + 1)
        if i < len(rows):
            initial, unwanted, late = rows[i]
            go(i + 1, place, cost + costs.delete, audit + "D", 0)
            if not unwanted:
                late = costs.truncated if late else 0
                if initial in follows[place]:
                    go(i + 1, follows[place][initial], cost + late, audit + "K", 0)
                for x in "ua":
                    if x in follows[place]:
                        go(i + 1, follows[place][x], cost + costs.rerole + late, audit + "R", 0)

    go(0, 0, 0, "", 0)
    return best


@pytest.mark.parametrize("costs", [repair.Costs(), repair.Costs(1, 1, 1, 0), repair.Costs(5, 2, 3, 4)])
def test_parser_against_every_repair(costs):
    automaton, rng = repair.Automaton(), random.Random(11)
    for _ in range(1500):
        rows = [(rng.choice(["s", "u", "a", "u", "a", "x", ""]), rng.random() < 0.25, rng.random() < 0.3) for _ in range(rng.randint(0, 6))]
        parser, edits = repair.Repairer(automaton, costs), []
        for k, (initial, unwanted, late) in enumerate(rows):
            edits += parser.push(k, initial, unwanted, late)
        edits += parser.finish()
        audit = "".join(e for e, _, _ in edits)
        each = {"K": 0, "R": costs.rerole, "D": costs.delete, "I": costs.insert}
        cost = sum(each[e] + (costs.truncated if e in "KR" and rows[row][2] else 0) for e, row, _ in edits)
        assert (cost, audit) == cheapest(rows, costs)
        assert [row for _, row, _ in edits if row is not None] == list(range(len(rows)))
        roles = "".join(symbol for e, _, symbol in edits if e != "D")
        assert re.fullmatch("(s?(ua)+)?", roles)


def test_parser_holds_few_rows_of_a_long_conversation():
    parser, most = repair.Repairer(repair.Automaton(), repair.Costs()), 0
    rng = random.Random(5)
    for k in range(20_000):
        parser.push(k, rng.choice("uaua s"), rng.random() < 0.1, False)
        most = max(most, len(parser.pending))
    assert most < 50


def test_edits(spark):
    rows = [(1, 0, "system", "Be brief."), (1, 1, "user", "Hi."), (1, 1, "user", "Hi."), (1, 2, "user", "And"), (2, 0, "assistant", "Ok.")]
    edits = repair.repair_conversations(conversations(spark, rows)).collect()
    told = [(r.conv_id, r.edit, r.role, r.text, r.fault, r.cost) for r in edits]
    assert [t[1:] for t in told if t[0] == 1] == [
        ("K", "system", "Be brief.", None, 0),
        ("K", "user", "Hi.", None, 0),
        ("D", "user", "Hi.", "duplicate", 3),
        ("R", "assistant", "And", "truncated", 3),
    ]
    assert [t[1:] for t in told if t[0] == 2] == [("I", "user", "", None, 2), ("K", "assistant", "Ok.", None, 0)]


# prefix trie --------------------------------------------------------------------------------------------------------


def test_perfect_hash():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.zeros(n, prefix_trie.KEY)
        keys["a"], keys["b"] = rng.integers(0, 1 << 40, n), np.arange(n)
        table = prefix_trie.PerfectHash(keys)
        assert sorted(table.slots(keys).tolist()) == list(range(n))
        assert (table.keys[table.slots(keys)] == keys).all()
        others = keys.copy()
        others["b"] += np.uint64(n)
        assert (table.slots(others) == -1).all()


def test_repeated_keys_are_refused():
    with pytest.raises(ValueError, match="distinct"):
        prefix_trie.PerfectHash(np.zeros(2, prefix_trie.KEY))


def test_shards_do_not_change_the_trie(spark):
    rng = random.Random(2)
    rows = [(c, t, "user", rng.choice("AB")) for c in range(300) for t in range(rng.randint(1, 6))]
    df, zero = conversations(spark, rows), "0L"
    from pyspark.sql import functions as F

    def trie(shard_rows):
        found = prefix_trie.prefix_trie(df, F.col("conv_id"), F.expr(zero), shard_rows)
        return sorted((tuple(r) for r in found.collect()), key=repr)

    whole = trie(400_000)
    assert trie(20) == whole
    chains = [tuple(x for _, x in turns) for turns in in_order(rows).values()]
    nodes = {c[:d] for c in chains for d in range(len(c) + 1)}
    assert len(whole) == len(nodes)
    root = next(r for r in whole if r[1] == 0)
    leaves = [n for n in nodes if not any(m[:-1] == n for m in nodes if m)]
    saved = sum((sum(c[: len(n)] == n for c in chains) - 1) * len(n[-1]) for n in nodes if n)
    assert root[:7] == (0, 0, None, 300, len({c[0] for c in chains}), len(leaves), saved)


def test_ends_of_a_hot_node_are_in_numerical_order(spark):
    rows = [(c, 0, "user", "Same.") for c in range(3000, 20_000, 2)]
    from pyspark.sql import functions as F

    found = prefix_trie.prefix_trie(conversations(spark, rows), F.col("conv_id"), F.expr("0L"), 1000).collect()
    wanted = hashlib.sha256(",".join(str(r[0]) for r in rows).encode()).hexdigest()
    assert sorted((r.depth, r.n_convs, r.ends_sha256) for r in found) == [
        (0, 8500, hashlib.sha256(b"").hexdigest()),
        (1, 8500, wanted),
    ]


def test_borrowing_follows_the_checksum(spark):
    assert QUERIES["op13_prefix_trie"](spark, FOLDER).where("depth = 0").first().n_convs == len(
        {r.conv_id for r in spark.read.parquet(f"{FOLDER}/conversations.parquet").collect()}
    )
    assert zlib.crc32(b"7") % 9 == spark.sql("SELECT crc32(CAST('7' AS binary)) % 9 AS h").first().h
