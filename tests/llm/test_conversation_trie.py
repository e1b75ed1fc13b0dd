import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from galley.llm import conversation_trie as T
from galley.llm.queries import op11_conversation_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string, digest string, name string"


def table(spark, convs):
    rows = [(c, t, r, x, "d", "g", "n") for c, turns in convs.items() for t, (r, x) in enumerate(turns)]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, SCHEMA)


def brute(convs):
    nodes = {}
    for c, turns in convs.items():
        turns = [(r or "", x or "") for r, x in turns]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append((c, len(turns)))
    children = {}
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    leaves, saved = {}, {}
    for k in sorted(nodes, key=len, reverse=True):
        own = (len(nodes[k]) - 1) * len(k[-1][1].encode()) if k else 0
        saved[k] = own + sum(saved[c] for c in children.get(k, []))
        leaves[k] = sum(leaves[c] for c in children.get(k, [])) or 1
    top = lambda k: min(c for c, _ in nodes[k])
    ends = lambda k: hashlib.sha256(",".join(str(c) for c, n in sorted(nodes[k]) if n == len(k)).encode()).hexdigest()
    return sorted((top(k), len(k), top(k[:-1]) if k else -1, len(nodes[k]), len(children.get(k, [])), leaves[k], saved[k], ends(k)) for k in nodes)


def found(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends) for r in df.collect())


def random_convs(rng, n, longest):
    words = ["hi", "", "ja", "é", None]
    out = {}
    for c in range(n):
        turns = [(rng.choice(["user", "bot", None]), rng.choice(words)) for _ in range(rng.randint(1, longest))]
        if out and rng.random() < 0.7:
            other = out[rng.choice(list(out))]
            turns = other[: rng.randint(0, len(other))] + (turns if rng.random() < 0.7 else [])
        out[c] = turns or [("user", "x")]
    return out


@pytest.mark.parametrize("seed, n, longest", [(1, 30, 3), (2, 25, 9), (3, 6, 40)])
def test_against_brute_force(spark, seed, n, longest):
    convs = random_convs(random.Random(seed), n, longest)
    assert found(T.conversation_trie(table(spark, convs))) == brute(convs)


def test_many_members_are_hashed_list_by_list(spark):
    convs = {c: [("user", "same")] for c in range(-40, 60)}
    turns = T.turns_of(table(spark, convs))
    got = T.prefix_trie(turns, turns.groupBy("conv_id").agg(F.count("*").alias("length")), ends_block=7)
    assert found(got) == [(-40, 0, -1, 100, 1, 1, 99 * 4, hashlib.sha256(b"").hexdigest()), (-40, 1, -40, 100, 0, 1, 99 * 4, hashlib.sha256(",".join(map(str, range(-40, 60))).encode()).hexdigest())]


def test_turns_are_numbered_over_all_tasks(spark):
    rows = [(7, None if t == 0 else t, "user", str(t), "", "", "") for t in range(3000)] + [(8, 1, "a", "x", "", "", ""), (8, 1, "a", "x", "", "", ""), (None, 1, "a", "x", "", "", "")]
    turns = T.turns_of(spark.createDataFrame(rows, SCHEMA).repartition(8))
    by = {}
    for r in turns.collect():
        by.setdefault(r.conv_id, []).append((r.depth, bytes(r.digest)))
    assert {c: sorted(d for d, _ in v) for c, v in by.items()} == {7: list(range(1, 3001)), 8: [1, 2]}
    assert [g for _, g in sorted(by[7])] == [hashlib.sha256(f"4:user{t}".encode()).digest() for t in range(3000)]


def test_query_has_the_rows_of_its_twin_with_turnless_and_missing_bases(spark, tmp_path):
    rng = random.Random(9)
    convs = {c: v for c, v in random_convs(rng, 60, 12).items() if c % 5 or c % 10}
    d = str(tmp_path)
    table(spark, convs).select("conv_id", "turn", "role", "text").write.parquet(f"{d}/conversations.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{d}/conversations.parquet/*.parquet'")
    want = con.sql(T.ORACLE_SQL)
    got = op11_conversation_trie(spark, d).select(*want.columns).collect()
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want.fetchall()))


def test_no_conversation(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert T.conversation_trie(empty).count() == 0
