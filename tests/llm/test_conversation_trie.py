"""Operator 12 against brute force: every prefix of every rebuilt conversation."""

import hashlib
import random
import zlib

import pytest

from tastemill.llm import conversation_trie as trie


def brute(rows):
    own = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(turns)] for c, turns in own.items()}
    nodes = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        turns = own.get(base, [])[:h] + turns[h:]
        for d in range(len(turns) + 1):
            node = nodes.setdefault(tuple(turns[:d]), ([], []))
            node[0].append(c)
            if d == len(turns):
                node[1].append(c)
    below = {k: [[], 0] for k in nodes}
    children = {k: 0 for k in nodes}
    for k in nodes:
        if k:
            children[k[:-1]] += 1
    for k, (members, _) in nodes.items():
        for d in range(len(k) + 1):
            below[k[:d]][0] += [k] * (not children[k])
            below[k[:d]][1] += (len(members) - 1) * len(k[-1][1]) if k else 0
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return sorted((min(m), len(k), min(nodes[k[:-1]][0]) if k else -1, len(m), children[k], len(below[k][0]), below[k][1], digest(ends)) for k, (m, ends) in nodes.items())


def conversations(seed=1, n=120):
    rng, rows = random.Random(seed), []
    for _ in range(n):
        c = rng.choice([0, 100, 200, -100, 700]) + rng.randrange(60)
        for t in range(rng.choice([1, 2, 3, 7])):
            rows.append((c, rng.choice([t, t, t, None]), rng.choice(["user", "assistant", None]), rng.choice(["a", "é日", "", None, "long text"])))
    rows += [(1, 3, "user", "tie"), (1, 3, "user", "eit"), (1, 3, "user", "tie"), (None, 1, "user", "no conversation"), (5000, None, None, None), (2, 50, "user", "very long " * 30_000)]
    rows += [(c, t, "user", "the same") for c in range(1000, 1100) for t in range(4)]
    rows += [(77, t, "user", f"turn {t}") for t in range(400)]
    return rows


def table(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.selectExpr("*", "1 AS ids", "'x' AS chars", "2 AS conv")


def got(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def test_against_brute_force(spark):
    rows = conversations()
    assert got(trie.conversation_trie(table(spark, rows).repartition(3))) == brute(rows)
    assert trie.conversation_trie(table(spark, [])).count() == 0
    assert trie.conversation_trie(table(spark, [(None, 1, "user", "x")])).count() == 0


@pytest.mark.parametrize(("shard", "fan"), [(300, 2), (1000, 3)])
def test_many_shards(spark, shard, fan):
    """Boundary nodes over several levels; one sequence's members lie in several shards."""
    rows = [r for r in conversations(2) if r[0] != 77]
    sequences = trie.rebuilt(trie.encoded(table(spark, rows)))
    assert got(trie.prefix_trie(sequences, shard, fan)) == brute(rows)


def test_pieces_of_a_list(spark, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 60)
    rows = [(c, 0, "user", "x") for c in range(300, 350)]
    assert got(trie.conversation_trie(table(spark, rows))) == brute(rows)


def test_balanced():
    assert sorted(trie.medians(100)) == list(range(100))
    tree = trie.TernaryTree()
    for i in trie.medians(1023):
        tree.insert([i], [1])
    depth = {0: 0}
    for x in tree.walk():
        for y in (tree.low[x], tree.high[x], tree.equal[x]):
            depth[y] = depth[x] + 1
    assert max(depth.values()) == 11
