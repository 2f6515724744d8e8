"""Operator 12: the trie of conversation prefixes, from ternary search trees on range shards.

Turns are dictionary-encoded: a turn's id is its rank among the distinct (role, text). The
conversations, as sequences of ids, are cut into ranges of their sorted order. A task hangs
the distinct sequences of its shard in a ternary search tree, medians first, so that the
tree is balanced, and walks it without recursion to add up members, leaves and savings.
Only nodes on the way to a shard's first or last sequence can have members in other shards.
These boundary nodes are merged, FAN neighbouring shards at a time, until none is open.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._jobs import parts, written
from tastemill.llm._text import release_memory

#: shards whose boundary nodes meet in a task
FAN = 64
#: bytes of a shard's sequences, eight for each turn
SHARD = 2 << 20
#: bytes of a piece of a list of ids
PIECE = 1 << 20

COUNTS = ("depth", "conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "chars")
#: final nodes, open nodes and pieces of lists of ids
NODES = "kind int, shard long, key binary, parent binary, parent_conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", is_left boolean, is_right boolean, ends_sha256 string, number long, piece binary"
FINAL, OPEN, ENDS = 0, 1, 2
_TYPES = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_(), "string": pa.string()}
_FIELDS = [(name, _TYPES[kind]) for name, kind in (x.split() for x in NODES.split(", "))]

NONE = -1
EMPTY = hashlib.sha256(b"").hexdigest()


def _batches(rows: Iterator[dict], most: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Rows as batches of bounded bytes; names that a row lacks are null."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += 1 + len(row.get("piece") or b"") * most // (8 << 20)
        if size >= most:
            yield _batch(held)
            held, size = [], 0
    yield _batch(held)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(name) for r in rows], t) for name, t in _FIELDS], names=[name for name, _ in _FIELDS])


class Totals:
    """Nodes of a trie with what is below them; node 0 is the root. Nodes come after their parents in ``order``."""

    def __init__(self):
        self.parent, self.depth, self.chars = [NONE], [0], [0]
        self.least: list[int | None] = [None]
        self.n, self.children, self.leaves, self.saved, self.sha = [0], [0], [0], [0], [None]

    def add(self, parent: int, depth: int, chars: int) -> int:
        for column, value in ((self.parent, parent), (self.depth, depth), (self.chars, chars), (self.least, None), (self.n, 0), (self.children, 0), (self.leaves, 0), (self.saved, 0), (self.sha, None)):
            column.append(value)
        return len(self.parent) - 1

    def member(self, x: int, least: int | None, n: int) -> None:
        if least is not None:
            self.least[x] = least if self.least[x] is None else min(least, self.least[x])
        self.n[x] += n

    def close(self, order: list[int], open_: set[int]) -> None:
        """Fold every node that is not open into its parent, deepest first."""
        for x in reversed(order):
            if x not in open_:
                self.leaves[x] = self.leaves[x] or 1
                self.saved[x] += (self.n[x] - 1) * self.chars[x]
                up = self.parent[x]
                if up != NONE:
                    self.member(up, self.least[x], self.n[x])
                    self.children[up] += 1
                    self.leaves[up] += self.leaves[x]
                    self.saved[up] += self.saved[x]

    def row(self, x: int) -> dict:
        return {"depth": self.depth[x], "conv_id": self.least[x], "n_convs": self.n[x], "n_children": self.children[x], "n_leaves": self.leaves[x], "saved_tokens": self.saved[x], "chars": self.chars[x], "ends_sha256": self.sha[x]}


class TernaryTree(Totals):
    """Sequences of turn ids; a node is the prefix that ends with its id, with smaller and larger ids beside it."""

    def __init__(self):
        super().__init__()
        self.id, self.low, self.equal, self.high = [0], [NONE], [NONE], [NONE]

    def insert(self, ids: list[int], chars: list[int]) -> list[int]:
        """The nodes on the way of a sequence, the root first."""
        at, way = 0, [0]
        for depth, (wanted, size) in enumerate(zip(ids, chars, strict=True), 1):
            side, where = self.equal, at
            while (x := side[where]) != NONE and self.id[x] != wanted:
                side, where = (self.low if wanted < self.id[x] else self.high), x
            if x == NONE:
                side[where] = x = self.add(at, depth, size)
                for column, value in ((self.id, wanted), (self.low, NONE), (self.equal, NONE), (self.high, NONE)):
                    column.append(value)
            at = x
            way.append(x)
        return way

    def walk(self) -> list[int]:
        """All nodes, each before those that hang from it."""
        order, todo = [], [0]
        while todo:
            x = todo.pop()
            order.append(x)
            todo += [y for y in (self.low[x], self.high[x], self.equal[x]) if y != NONE]
        return order


def medians(n: int) -> Iterator[int]:
    """0 .. n - 1, the middle of every range before its halves."""
    todo = [(0, n)]
    while todo:
        low, high = todo.pop()
        if low < high:
            middle = (low + high) // 2
            yield middle
            todo += [(middle + 1, high), (low, middle)]


def chain(ids: list[int]) -> list[bytes]:
    """A key of every prefix, the empty one first, by SHA-256 from one to the next."""
    keys = [b""]
    for x in ids:
        keys.append(hashlib.sha256(keys[-1] + x.to_bytes(8, "little", signed=True)).digest())
    return keys


def _shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Nodes of a shard; the input (ids, chars, conv) is sorted."""
    number = TaskContext.get().partitionId()
    found: list[tuple[list[int], list[int], list[int]]] = []
    for batch in batches:
        for ids, chars, conv in zip(*(batch.column(c).to_pylist() for c in ("ids", "chars", "conv")), strict=True):
            if not found or found[-1][0] != ids:
                found.append((ids, chars, []))
            found[-1][2].append(conv)
    if found:
        yield from _batches(_nodes(number, found))
    release_memory()


def _nodes(shard: int, found: list[tuple[list[int], list[int], list[int]]]) -> Iterator[dict]:
    tree, edge = TernaryTree(), {0, len(found) - 1}
    ways, keys = {}, {0: b""}
    for i in medians(len(found)):
        ids, chars, convs = found[i]
        way = tree.insert(ids, chars)
        tree.member(way[-1], convs[0], len(convs))
        if i in edge:
            ways[i] = way
            keys.update(zip(way, chain(ids), strict=True))
        else:
            tree.sha[way[-1]] = hashlib.sha256(",".join(map(str, convs)).encode()).hexdigest()
    for i in edge:  # their lists may go on in other shards
        convs, key = found[i][2], keys[ways[i][-1]]
        for at in range(0, len(convs), PIECE // 20):
            yield {"kind": ENDS, "shard": shard, "key": key, "number": at, "piece": ",".join(map(str, convs[at : at + PIECE // 20])).encode()}
    left, right = set(ways[0]), set(ways[len(found) - 1])
    order = tree.walk()
    tree.close(order, set(keys))
    for x in order:
        up = tree.parent[x]
        if x in keys:
            yield tree.row(x) | {"kind": OPEN, "shard": shard, "key": keys[x], "parent": keys.get(up), "is_left": x in left, "is_right": x in right}
        elif up in keys:
            yield tree.row(x) | {"kind": FINAL, "parent": keys[up]}
        else:
            yield tree.row(x) | {"kind": FINAL, "parent_conv_id": tree.least[up]}


def _merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
    """Boundary nodes of neighbouring shards as those of one; the input is sorted by (group, shard, depth)."""

    def rows() -> Iterator[dict]:
        for batch in batches:
            yield from batch.to_pylist()

    def out() -> Iterator[dict]:
        for group, own in groupby(rows(), key=lambda r: r["group"]):
            yield from _merged(group, list(own), last)

    yield from _batches(out())


def _merged(group: int, own: list[dict], last: bool) -> Iterator[dict]:
    trie, at = Totals(), {b"": 0}
    first, final = own[0]["shard"], own[-1]["shard"]
    left, right = set(), set()
    for r in own:
        x = at.get(r["key"])
        if x is None:  # parents come first
            x = at[r["key"]] = trie.add(at[r["parent"]], r["depth"], r["chars"])
        trie.member(x, r["conv_id"], r["n_convs"])
        trie.children[x] += r["n_children"]
        trie.leaves[x] += r["n_leaves"]
        trie.saved[x] += r["saved_tokens"]
        trie.sha[x] = trie.sha[x] or r["ends_sha256"]
        if r["shard"] == first and r["is_left"]:
            left.add(x)
        if r["shard"] == final and r["is_right"]:
            right.add(x)
    open_ = set() if last else left | right
    # in the order of making: parents come before children
    trie.close(list(range(len(trie.parent))), open_)
    keys = {x: key for key, x in at.items()}
    for x in range(len(trie.parent)):
        up = trie.parent[x]
        row = trie.row(x) | {"key": keys[x], "parent": keys.get(up)}
        if x in open_:
            yield row | {"kind": OPEN, "shard": group, "is_left": x in left, "is_right": x in right}
        else:
            yield row | {"kind": FINAL}


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, sha) of lists of ids in pieces; the input is sorted by (key, shard, number). One piece is held at a time."""

    def rows() -> Iterator[tuple[bytes, bytes]]:
        for batch in batches:
            for i in range(batch.num_rows):
                yield batch.column(0)[i].as_py(), batch.column(1)[i].as_py()

    for key, own in groupby(rows(), key=lambda r: r[0]):
        sha = hashlib.sha256()
        for i, (_, piece) in enumerate(own):
            sha.update(b"," * (i > 0) + piece)
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([sha.hexdigest()])], names=["list", "sha"])


def encoded(df: DataFrame) -> DataFrame:
    """(conv, ids, chars): the turns of each conversation of (conv_id, turn, role, text), by turn, null first, then role and SHA-256 of the text.

    ``ids`` are ranks among the distinct (role, text), compared by the texts' SHA-256; texts
    are not shuffled. ``chars`` are their code points.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = df.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").alias("turn"), role.alias("role"), F.unhex(F.sha2(text, 256)).alias("digest"), F.length(text).cast("long").alias("chars"))
    distinct = rows.groupBy(F.col("role").alias("role_"), F.col("digest").alias("digest_")).agg(F.max("chars").alias("chars_"))
    words = written(distinct.sort("role_", "digest_").withColumn("id", F.monotonically_increasing_id()), "trie-dictionary")
    coded = rows.join(words, (F.col("role") == F.col("role_")) & (F.col("digest") == F.col("digest_")))
    turns = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("known"), F.coalesce("turn", F.lit(0)).alias("turn"), F.col("id"), F.col("chars"))))
    own = coded.groupBy("conv").agg(turns.alias("turns"))
    return own.select("conv", F.col("turns.id").alias("ids"), F.col("turns.chars").alias("chars"))


def rebuilt(own: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """Sequences (conv, ids, chars) of which each begins with the first turns of the one that its id, rounded down to ``every``, names.

    Of conversation c these are crc32(c) modulo ``most`` turns, or as many as there are; c's
    own turns follow after so many of its own.
    """
    base = own.where(F.col("conv") % every == 0).select(F.col("conv").alias("base"), F.slice("ids", 1, most - 1).alias("base_ids"), F.slice("chars", 1, most - 1).alias("base_chars"))
    h = (F.crc32(F.col("conv").cast("string")) % most).cast("int")
    both = own.join(base, F.col("conv") - F.col("conv") % every == F.col("base"), "left").withColumn("h", h)
    joined = lambda c: F.concat(F.slice(F.coalesce(f"base_{c}", F.array().cast("array<long>")), F.lit(1), F.col("h")), F.slice(c, F.col("h") + 1, F.size(c))).alias(c)
    return both.select("conv", joined("ids"), joined("chars"))


def prefix_trie(sequences: DataFrame, shard: int = SHARD, fan: int = FAN) -> DataFrame:
    """One row per distinct prefix of the sequences (conv, ids, chars), ids being unique numbers of turns.

    Columns: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. ``shard`` bounds the bytes of sequences in a task; one
    sequence is always in one task. No sequences: no rows.
    """
    spark = sequences.sparkSession
    rows = written(sequences, "trie-sequences")
    size = rows.agg(F.sum(F.size("ids") * 8 + 16)).first()[0] or 0
    n = parts(spark, size, shard)
    dealt = rows.repartitionByRange(n, "ids", "conv").sortWithinPartitions("ids", "conv")
    found = written(dealt.select("ids", "chars", "conv").mapInArrow(_shard, NODES), "trie-shards", ("kind",))
    inner = found.where(F.col("kind") == FINAL)
    open_, merged, level = found.where(F.col("kind") == OPEN), None, 0
    shards = open_.agg(F.max("shard") + 1).first()[0] or 0  # also what the session raises n to
    while True:
        last = shards <= fan
        grouped = open_.withColumn("group", F.floor(F.col("shard") / fan)).repartition("group").sortWithinPartitions("group", "shard", "depth")
        out = written(grouped.mapInArrow(lambda b, last=last: _merge(b, last), NODES), f"trie-level{level}", ("kind",))
        done = out.where(F.col("kind") == FINAL)
        merged = done if merged is None else merged.unionByName(done)
        if last:
            break
        open_, shards, level = out.where(F.col("kind") == OPEN), -(-shards // fan), level + 1
    pieces = found.where(F.col("kind") == ENDS).repartition("key").sortWithinPartitions("key", "shard", "number")
    lists = pieces.select("key", "piece").mapInArrow(_digests, "list binary, sha string")
    merged = merged.join(lists.hint("merge"), F.col("key") == F.col("list"), "left").withColumn("ends_sha256", F.coalesce("ends_sha256", "sha"))
    merged = written(merged.drop("list", "sha"), "trie-merged")
    names = merged.select(F.col("key").alias("above"), F.col("conv_id").alias("name"))
    known = inner.where("parent is null")
    # one boundary node, the root above all, can have a third of the nodes: the adaptive skew join splits it
    hung = inner.where("parent is not null").unionByName(merged).join(names.hint("merge"), F.col("parent") == F.col("above"), "left").withColumn("parent_conv_id", F.col("name"))
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")]
    return known.select(*columns).unionByName(hung.select(*columns))


def conversation_trie(df: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """The prefix trie of the rebuilt conversations of (conv_id, turn, role, text); see rebuilt and prefix_trie.

    Turns are ordered by turn, null first; of equal ones by role, then SHA-256 of the text,
    and repeated rows are turns one by one. Null role or text is empty. Rows without a
    conv_id belong to no conversation. Very long texts count by their code points; a
    conversation is one sequence of numbers in a task. Empty table: no rows, no root either.
    Other columns are ignored.
    """
    return prefix_trie(rebuilt(encoded(df), every, most))


def op12_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


ORACLE = """
WITH byte AS (
  SELECT i, list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i) AS x FROM range(256) t(i)
), t AS (SELECT list(x ORDER BY i) AS crc FROM byte),
own AS (
  SELECT conv_id, list({'role': coalesce(role, ''), 'text': coalesce(text, '')} ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(coalesce(text, ''))) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), h AS (
  SELECT conv_id, s, xor(list_reduce(list_transform(string_split(conv_id::VARCHAR, ''), lambda a: ascii(a)::BIGINT), lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 6 AS h FROM own, t
), r AS (
  SELECT c.conv_id, coalesce(b.s, [])[1:c.h] || c.s[c.h + 1:] AS s FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 100
), p AS (SELECT conv_id, d, s[1:d] AS k, d = len(s) AS ends FROM r, unnest(range(len(s) + 1)) u(d)),
n AS (
  SELECT k, any_value(d) AS depth, min(conv_id) AS conv_id, count(*) AS n, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM p GROUP BY k
), c AS (SELECT k[1:depth - 1] AS up, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY ALL),
m AS (SELECT n.*, coalesce(c.n_children, 0) AS n_children FROM n LEFT JOIN c ON c.up = n.k),
s AS (
  SELECT k[1:u.d] AS top, count(*) FILTER (n_children = 0) AS n_leaves, sum((n - 1) * CASE WHEN depth = 0 THEN 0 ELSE length(k[depth].text) END) AS saved_tokens FROM m, unnest(range(depth + 1)) u(d) GROUP BY ALL
)
SELECT m.conv_id, m.depth, up.conv_id AS parent_conv_id, m.n AS n_convs, m.n_children, s.n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s ON s.top = m.k LEFT JOIN m up ON m.depth > 0 AND up.k = m.k[1:m.depth - 1]
"""
