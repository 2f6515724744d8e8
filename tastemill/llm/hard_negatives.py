"""Operator 13: hard negatives by a vertical scan that prunes on bounds (BOND).

Vectors lie in columnar blocks: one array per dimension, rows ordered by label, with the least
and largest value of each dimension. For an anchor the dimensions are read by descending
magnitude of its own components. After each few of them, what the others can still add, from
the block's least and largest values, bounds every candidate's score; candidates whose bounds
can no longer change the result leave the bitmap. A first pass finds an anchor's positives,
a second one the rows of other labels whose scores lie in the windows that these set.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.llm._jobs import NO_ID, written
from tastemill.llm._text import release_memory

#: rows of a columnar block, and anchors that a task holds
BLOCK, ANCHORS = 4096, 4096
#: dimensions read between two prunings
STEP = 8
#: scaled components beyond it count as it, so that products of 2048 dimensions fit a long
LARGEST = 1 << 26
POSITIVES, NEGATIVES = 5, 5

BLOCKS = "block long, n int, width int, ids binary, labels binary, columns binary"
PAIRS = "anchor long, item long, score long"
MINED = "anchor long, positive long, positive_score long, item long, score long"


def scaled(df: DataFrame) -> DataFrame:
    """(id, label, vector) of the rows (vec_id, label, embedding) that take part; the vector in whole 256ths."""
    x = F.col("embedding")
    whole = F.forall(x, lambda v: v.isNotNull() & (F.abs(v.cast("double")) < float("inf")))
    vector = F.transform(x, lambda v: F.least(F.greatest(F.floor(v.cast("double") * 256), F.lit(-LARGEST)), F.lit(LARGEST)).cast("int"))
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    taking = df.where(F.col("label").isNotNull() & x.isNotNull() & whole)
    return taking.select(F.coalesce(F.col("vec_id").cast("long"), F.lit(NO_ID)).alias("id"), label.cast("long").alias("label"), vector.alias("vector"))


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columnar blocks of rows (block, id, label, vector), sorted by (block, label, id)."""
    for block, table in _groups(batches, "block"):
        vectors = table["vector"].combine_chunks()
        lengths = np.asarray(vectors.value_lengths())
        width, n = int(lengths.max(initial=0)), len(table)
        matrix = np.zeros((n, width), dtype=np.int32)  # shorter vectors end in zeros
        row = np.repeat(np.arange(n), lengths)
        matrix[row, np.arange(len(row)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = vectors.flatten().to_numpy()
        fields = [np.int64(block), np.int32(n), np.int32(width), table["id"].to_numpy().tobytes(), table["label"].to_numpy().tobytes(), np.ascontiguousarray(matrix.T).tobytes()]
        yield _row(BLOCKS, fields)
    release_memory()


def _row(schema: str, fields: list) -> pa.RecordBatch:
    types = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    named = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([f], types[t]) for f, (_, t) in zip(fields, named, strict=True)], names=[n for n, _ in named])


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple]:
    """(key, table) of each group of a sorted input; one group is held at a time."""
    held: list[pa.RecordBatch] = []
    at = None
    for batch in batches:
        values = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        start = 0
        for key, own in groupby(values):
            n = len(list(own))
            if key != at and held:
                yield at if len(keys) > 1 else at[0], pa.Table.from_batches(held)
                held = []
            at = key
            held.append(batch.slice(start, n))
            start += n
    if held:
        yield at if len(keys) > 1 else at[0], pa.Table.from_batches(held)


class Block:
    """A columnar block, with the range of every dimension over all its rows."""

    def __init__(self, r: dict):
        self.ids, self.labels = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["labels"], np.int64)
        self.columns = np.frombuffer(r["columns"], np.int32).reshape(r["width"], r["n"]).astype(np.int64)
        self.least, self.most = self.columns.min(axis=1, initial=LARGEST), self.columns.max(axis=1, initial=-LARGEST)

    def span(self, label: int) -> tuple[int, int]:
        """The rows of a label."""
        return tuple(np.searchsorted(self.labels, [label, label + 1]).tolist())


def scan(block: Block, rows: np.ndarray, vector: np.ndarray, prune) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the candidates that are left after all dimensions.

    ``prune(rows, low, high)`` says which candidates stay, given bounds of their scores.
    """
    width = min(len(vector), len(block.columns))
    order = np.argsort(-np.abs(vector[:width]), kind="stable")
    a = vector[order]
    ends = np.stack([a * block.least[order], a * block.most[order]])
    # what the dimensions from each place of the order on can add
    low, high = (np.append(np.cumsum(e[::-1])[::-1], 0) for e in (ends.min(axis=0), ends.max(axis=0)))
    sums, at = np.zeros(len(rows), dtype=np.int64), 0
    while True:
        stay = prune(rows, sums + low[at], sums + high[at])
        if not stay.all():
            rows, sums = rows[stay], sums[stay]
        if at == width or not len(rows):
            return rows, sums
        whole = len(rows) == len(block.ids)
        for d in range(at, min(at + STEP, width)):
            column = block.columns[order[d]]
            sums = sums + a[d] * (column if whole else column[rows])
        at = min(at + STEP, width)


def kth(values: np.ndarray, k: int) -> int:
    """The k-th largest value, or one below all scores."""
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -(2**63)


class Best:
    """The first k rows of a window, by score, then id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def floor(self) -> int:
        return kth(self.scores, self.k)

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        if len(ids):
            ids, scores = np.append(self.ids, ids), np.append(self.scores, scores)
            best = np.lexsort((ids, -scores))[: self.k]
            self.ids, self.scores = ids[best], scores[best]


def _positives(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best rows of its own label for each anchor of a group; see _tasks for the input."""
    for anchors, blocks in _tasks(batches):
        best = [Best(k) for _ in anchors]
        for block in blocks:
            for a, own in zip(anchors, best, strict=True):
                rows = np.arange(*block.span(a["label"]))
                rows = rows[block.ids[rows] != a["id"]]
                known = own.floor()
                prune = lambda r, low, high: high >= max(known, kth(low, k))  # noqa: B023, E731
                rows, scores = scan(block, rows, a["vector"], prune)
                own.add(block.ids[rows], scores)
        yield _pairs(PAIRS, [np.repeat([a["anchor"] for a in anchors], [len(b.ids) for b in best]), np.concatenate([b.ids for b in best]), np.concatenate([b.scores for b in best])])
    release_memory()


def _negatives(batches: Iterator[pa.RecordBatch], k: int, share: tuple[int, int]) -> Iterator[pa.RecordBatch]:
    """The k best rows of other labels in each of its windows for each anchor of a group."""
    p, q = share
    for anchors, blocks in _tasks(batches):
        # p * positive <= q * score <= q * positive
        windows = [[(-(-p * s // q), s, Best(k)) for s in a["scores"]] for a in anchors]
        for block in blocks:
            for a, own in zip(anchors, windows, strict=True):
                begin, end = block.span(a["label"])
                rows = np.append(np.arange(begin), np.arange(end, len(block.ids)))

                def prune(r: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
                    stay = np.zeros(len(r), dtype=bool)
                    for least, most, best in own:  # noqa: B023
                        sure = low[(low >= least) & (high <= most)]
                        stay |= (high >= max(least, best.floor(), kth(sure, k))) & (low <= most)
                    return stay

                rows, scores = scan(block, rows, a["vector"], prune)
                for least, most, best in own:
                    inside = (scores >= least) & (scores <= most)
                    best.add(block.ids[rows[inside]], scores[inside])
        out = [(a["anchor"], positive, s, best) for a, own in zip(anchors, windows, strict=True) for positive, s, (_, _, best) in zip(a["positives"], a["scores"], own, strict=True)]
        n = [len(o[3].ids) for o in out]
        columns = [np.repeat(np.array([o[i] for o in out], dtype=np.int64), n) for i in range(3)]
        yield _pairs(MINED, [*columns, *(np.concatenate([getattr(o[3], c) for o in out]) if out else np.zeros(0, np.int64) for c in ("ids", "scores"))])
    release_memory()


def _pairs(schema: str, columns: list[np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c.astype(np.int64)) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[dict], Iterator[Block]]]:
    """(anchors, blocks) of each task; the input is sorted by (task, kind), anchors have kind 0, blocks come one at a time."""
    rows = (r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist())
    for _, own in groupby(rows, key=lambda r: r["task"]):
        anchors, first = [], None
        for first in own:
            if first["kind"]:
                break
            anchors.append(first | {"vector": np.array(first["vector"], dtype=np.int64)})
            first = None
        if anchors and first:
            yield anchors, (Block(r) for part in ([first], own) for r in part)


def _dealt(anchors: DataFrame, blocks: DataFrame, groups: int, batches: int, extra: tuple[str, ...] = ()) -> DataFrame:
    """Rows of each task: every group of blocks meets every batch of anchors."""
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = anchors.withColumns({"g": every(groups), "b": F.pmod(F.xxhash64("anchor"), F.lit(batches)).cast("int")})
    r = blocks.withColumns({"g": F.pmod(F.col("block"), F.lit(groups)).cast("int"), "b": every(batches)})
    task = (F.col("g").cast("long") * batches + F.col("b")).alias("task")
    both = a.select(task, F.lit(0).alias("kind"), "anchor", "id", "label", "vector", *extra).unionByName(r.select(task, F.lit(1).alias("kind"), "n", "width", "ids", "labels", "columns"), allowMissingColumns=True)
    return both.repartition(max(groups * batches, 1), "task").sortWithinPartitions("task", "kind")


def _first(df: DataFrame, by: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "item")
    return df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def hard_negatives(df: DataFrame, anchors: Column, share: tuple[int, int] = (80, 100), positives: int = POSITIVES, negatives: int = NEGATIVES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of (vec_id, label, embedding).

    ``anchors`` says which rows are anchors, by the columns id and label. Components become floor(256 * x); scores are
    inner products of these with the anchor. An anchor's positives are its first
    ``positives`` rows of the same label and another vec_id; for each, the first
    ``negatives`` rows of other labels with share[0] * positive_score <= share[1] *
    negative_score <= share[1] * positive_score are returned, ranked from 1. Higher scores
    come first, ties go to the smaller vec_id. Labels of vec_ids divisible by 7 are first
    moved on by one, modulo 10.

    Rows with a null label or vector, or a component that is null, NaN or infinite, take no
    part. Null vec_id is smaller than any other and shows as null. Empty vectors score 0, and
    shorter vectors end in zeros. Components beyond 2**18 count as 2**18. Rows that repeat a
    vec_id are rows of their own, and so are anchors. Empty table: no rows. Other columns
    are ignored.
    """
    spark = df.sparkSession
    base = scaled(df)
    asked = written(base.where(anchors).withColumn("anchor", F.monotonically_increasing_id()), "bond-anchors")
    n, n_anchors = base.count(), asked.count()
    n_blocks = max(1, -(-n // BLOCK))
    # rows are dealt evenly, repeated ones too: a common vector or label is in every block
    dealt = base.withColumn("block", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(n_blocks)))
    at_once = int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks = written(dealt.repartition(min(n_blocks, max(at_once, n_blocks // 16)), "block").sortWithinPartitions("block", "label", "id").mapInArrow(_columns, BLOCKS), "bond-blocks")
    groups, batches = min(n_blocks, max(at_once, n_blocks // 16)), max(1, -(-n_anchors // ANCHORS))
    found = _dealt(asked, blocks, groups, batches).mapInArrow(lambda b: _positives(b, positives), PAIRS)
    best = _first(found, ["anchor"], positives).groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "item", "score"))).alias("best"))
    windows = written(asked.join(best.withColumnRenamed("anchor", "of"), F.col("anchor") == F.col("of")).select("anchor", "id", "label", "vector", F.col("best.item").alias("positives"), F.col("best.score").alias("scores")), "bond-windows")
    mined = _dealt(windows, blocks, groups, batches, ("positives", "scores")).mapInArrow(lambda b: _negatives(b, negatives, share), MINED)
    ranked = _first(mined, ["anchor", "positive", "positive_score"], negatives)
    names = windows.select(F.col("anchor").alias("of"), "id")
    out = ranked.join(names, F.col("anchor") == F.col("of"))
    shown = lambda c, name: F.nullif(c, F.lit(NO_ID)).alias(name)
    return out.select(shown("id", "anchor_id"), shown("positive", "positive_id"), "rank", shown("item", "negative_id"), "positive_score", F.col("score").alias("negative_score"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("id") % 100 == 0)


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same, list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i]))::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT anchor_id, positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
WINDOW w AS (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER w <= 5
"""
