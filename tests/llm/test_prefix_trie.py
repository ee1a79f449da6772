"""The prefix trie against a trie of Python tuples."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from draftmill.llm import prefix_trie
from draftmill.llm.catalog import op13_prefix_trie

TURNS = "conv_id long, turn long, role string, text string, name string, depth int"


def plain(convs):
    """Rows of all nodes for {conv_id: ((role, text), ...)}."""
    members, below, ends = defaultdict(list), defaultdict(set), defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(c)
            if d:
                below[turns[: d - 1]].add(turns[:d])
        ends[turns].append(c)
    rows = []
    for node in members:
        subtree = [n for n in members if n[: len(node)] == node]
        saved = sum((len(members[n]) - 1) * len(n[-1][1].encode()) for n in subtree if n)
        sha = hashlib.sha256(",".join(map(str, sorted(ends[node]))).encode()).hexdigest()
        rows.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below[node]), sum(not below[n] for n in subtree), saved, sha))
    return sorted(rows, key=repr)


def frame(spark, convs):
    rows = [(c, k, r, t, "x", 1) for c, turns in convs.items() for k, (r, t) in enumerate(turns)]
    return spark.createDataFrame(rows, TURNS).repartition(3)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def some(seed, n, deep, kinds):
    rng = np.random.default_rng(seed)
    return {int(c): tuple(("user", "t" * int(x) + "é") for x in rng.integers(0, kinds, rng.integers(1, deep))) for c in rng.permutation(3 * n)[:n]}


@pytest.mark.parametrize("limit", [3, 40, None])
def test_nodes_are_those_of_a_plain_trie(spark, limit):
    convs = some(1, 120, 6, 3)
    convs |= {1000 + k: (("user", "hot"), ("assistant", "same"), ("user", "hot"), ("user", str(k))) for k in range(60)}  # a third, with a path in common
    convs |= {2000 + k: (("user", "copy"), ("user", "copy")) for k in range(60)}
    assert found(prefix_trie.trie(prefix_trie.sequences(frame(spark, convs)), limit)) == plain(convs)


def test_ends_of_many_blocks_are_hashed_in_numeric_order(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "BLOCK_BITS", 3)
    convs = {k: (("user", "copy"),) for k in (2, 11, 3, 100, 99, 1000, 5)} | {7: (("user", "copy"), ("user", "more")), 9: (("system", "copy"),)}
    convs |= {10_000 + k: (("user", "copy"), ("user", "more")) for k in range(40)}
    for limit in (1, None):
        assert found(prefix_trie.trie(prefix_trie.sequences(frame(spark, convs)), limit)) == plain(convs)


def test_a_very_long_conversation(spark):
    convs = {1: tuple(("user", str(k)) for k in range(3000)), 2: tuple(("user", str(k)) for k in range(2000)), 3: (("user", "0"),)}
    got = {(r["depth"], r["conv_id"]): r for r in prefix_trie.trie(prefix_trie.sequences(frame(spark, convs)), 100).collect()}
    assert len(got) == 3001 and got[0, 1]["n_leaves"] == 1
    assert got[0, 1]["saved_tokens"] == 2 + sum(len(str(k)) for k in range(1, 2000))
    assert got[3000, 1]["n_convs"] == 1 and got[2000, 1]["n_convs"] == 2


def test_rebuilt_conversations_and_messy_rows(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(int(c), int(t), "user", f"c{c} t{t}", "x", 1) for c in rng.permutation(200)[:90] for t in range(int(rng.integers(1, 12)))]
    rows += [(300, None, None, None, None, None), (300, 1, "user", None, None, None), (301, None, "", "", "x", 1), (302, 5, "user", "x", "x", 1), (302, 5, "user", "x", "x", 1), (None, 1, "user", "lost", "x", 1), (303, 1, "user", "y" * 100_000, "x", 1)]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, TURNS).repartition(4).write.parquet(path)
    own = defaultdict(list)
    for c, t, r, x, *_ in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        if c is not None:
            own[c].append((r or "", x or ""))
    convs = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        convs[c] = (*own.get(c - c % 5, [])[:h], *turns[h:])
    assert any(not t for t in convs.values())
    out = op13_prefix_trie(spark, str(tmp_path))
    assert found(out) == plain(convs) and out.columns == [c.split()[0] for c in prefix_trie.NODE.split(", ")]


def test_empty_tables(spark):
    assert prefix_trie.trie(prefix_trie.sequences(spark.createDataFrame([], TURNS))).count() == 0
    only = spark.createDataFrame([(4,)], "conv_id long").withColumn("turns", F.expr("cast(array() as array<struct<digest:string,size:bigint>>)"))
    assert found(prefix_trie.trie(only)) == plain({4: ()})
