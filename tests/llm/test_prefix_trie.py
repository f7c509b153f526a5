"""The trie against a dictionary of all prefixes."""

import hashlib
import random
import zlib

import duckdb
import pytest

from complaintflow.llm import prefix_trie as op
from complaintflow.llm.checksums import crc32_sql

TURNS = "conv_id long, turn long, role string, text string, node string, path string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "mine", "mine") for r in rows], TURNS).repartition(3)


def conversations(rows):
    found = {}
    for c, at, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.md5(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            found.setdefault(c, []).append((at is not None, at or 0, tie, (role, text)))
    return {c: [t[3] for t in sorted(turns)] for c, turns in found.items()}


def rebuilt(paths):
    out = {}
    for c, path in paths.items():
        h = zlib.crc32(str(c).encode()) % 9
        out[c] = paths.get(c - c % 5, [])[:h] + path[h:]
    return out


def brute(paths):
    members, ends = {}, {}
    for c in sorted(paths):
        for d in range(len(paths[c]) + 1):
            members.setdefault(tuple(paths[c][:d]), []).append(c)
        ends.setdefault(tuple(paths[c]), []).append(c)
    children = {}
    for node in members:
        if node:
            children.setdefault(node[:-1], []).append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        below = children.get(node, [])
        leaves[node] = sum(leaves[b] for b in below) if below else 1
        saved[node] = (len(members[node]) - 1) * (len(node[-1][1].encode()) if node else 0) + sum(saved[b] for b in below)
    return sorted((members[n][0], len(n), members[n[:-1]][0] if n else None, len(members[n]), len(children.get(n, [])), leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, ends.get(n, []))).encode()).hexdigest()) for n in members)


NAMES = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def got(df):
    return sorted(tuple(r[n] for n in NAMES) for r in df.collect())


def many(rng, n, kinds=3, longest=8):
    rows = []
    for c in range(n):
        length = rng.randint(1, longest)
        texts = [f"text {rng.randrange(kinds)}" for _ in range(length)]
        if rng.random() < 0.3:
            texts = ["hot"] * length
        rows += [(c, k, "user" if k % 2 else "assistant", t) for k, t in enumerate(texts)]
    return rows


@pytest.mark.parametrize("shard", [3, 40, 1 << 15])
def test_shards_of_any_size_give_the_same_trie(spark, tmp_path, monkeypatch, shard):
    monkeypatch.setattr(op, "SHARD_PATHS", shard)
    monkeypatch.setattr(op, "SORT_TURNS", 2)
    rng = random.Random(shard)
    rows = many(rng, 250) + [(None, 1, "user", "nobody"), (300, None, None, None), (301, 1, "user", "é" * 40), (301, 1, "user", "é" * 40), (302, 5, "a", ""),
                             (302, None, "b", "later"), (-7, 0, "user", "hot"), (1 << 40, 0, "user", "x" * 70_000)]
    frame(spark, rows).write.parquet(f"{tmp_path}/conversations.parquet")
    assert got(op.query(spark, str(tmp_path))) == brute(rebuilt(conversations(rows)))


def test_long_conversations_with_long_common_beginnings(spark, monkeypatch):
    monkeypatch.setattr(op, "SHARD_PATHS", 4)
    rng = random.Random(5)
    paths = {c: [("user", f"t{k}") for k in range(150)] + [("user", f"u{rng.randrange(3)}") for _ in range(rng.randint(0, 6))] for c in range(60)}
    rows = [(c, k, *t) for c, path in paths.items() for k, t in enumerate(path)]
    nodes, members = op.prefix_trie(op.sequences(frame(spark, rows)))
    wanted = brute(paths)
    found = {(r["conv_id"], r["depth"]): r for r in nodes.collect()}
    assert len(found) == len(wanted) and members.count() == 60
    for w in wanted:
        r = found[w[:2]]
        assert (r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]) == w[3:7]


def test_empty_tables_and_turnless_conversations(spark):
    assert op.prefix_trie(op.sequences(frame(spark, []).limit(0)))[0].count() == 0
    paths = spark.createDataFrame([(4, []), (2, [])], "conv_id long, path array<struct<turn: binary, size: long>>")
    nodes, members = op.prefix_trie(paths)
    assert [tuple(r) for r in nodes.select("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens").collect()] == [(0, 2, 2, 0, 1, 0)]
    assert [r["ids"] for r in op.ends(members).collect()] == ["2,4"]


def test_median_first_keeps_the_tree_balanced():
    assert sorted(op.median_first(100)) == list(range(100))
    tree = op.TernarySearchTree()
    for i in op.median_first(1023):
        assert tree.depth[tree.insert([i, 5])[-1]] == 2
    steps, at = {tree.first[0]: 1}, [tree.first[0]]
    while at:
        v = at.pop()
        for link in (tree.lower[v], tree.higher[v]):
            if link:
                steps[link] = steps[v] + 1
                at.append(link)
    assert len(steps) == 1023 and max(steps.values()) == 10


def test_sql_and_brute_force_agree(tmp_path):
    con = duckdb.connect()
    ids = con.execute(f"SELECT x, {crc32_sql('CAST(x AS VARCHAR)')} FROM range(-50, 2000) t(x)").fetchall()
    assert all(zlib.crc32(str(x).encode()) == c for x, c in ids)
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    found = con.execute(f"SELECT {', '.join(NAMES)} FROM ({op.SQL})").fetchall()
    rows = con.execute("SELECT conv_id, turn, role, text FROM conversations").fetchall()
    assert sorted(found) == brute(rebuilt(conversations(rows)))


def test_query_against_sql(spark):
    con = duckdb.connect()
    con.execute("CREATE VIEW conversations AS SELECT * FROM '/root/testdata/sf0.01/conversations.parquet'")
    assert got(op.query(spark, "/root/testdata/sf0.01")) == sorted(con.execute(f"SELECT {', '.join(NAMES)} FROM ({op.SQL})").fetchall())
