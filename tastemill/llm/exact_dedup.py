"""Operator 2: Grace hash deduplication.

Records are dealt to buckets by a hash of their content (the spill files are Spark's
shuffle files), and each bucket goes through an open-addressing table that compares
complete contents. A table holds a bounded number of bytes: records that find it full
are dealt again by another hash, level by level, until none is left over. Equal records
of one input task are merged before the first deal, so a text that fills a third of the
corpus reaches its bucket once per task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tastemill.llm._jobs import NO_ID, every_column, id_key, parts, split_listed, written
from tastemill.llm._text import _IS_SPACE, column_bytes, pieces, release_memory

ROWS = "link boolean, row long, doc long, n_chars long, n_bytes long, digest binary, content binary, n long"
GROUPS = "full boolean, digest binary, content binary, n long, n_chars long, doc long, row long"


class ContentTable:
    """Open addressing with linear probing; an entry is found by hash and equal content."""

    def __init__(self, limit: int):
        self.limit = limit
        self.clear()

    def clear(self) -> None:
        self.slots, self.bytes = [-1] * 64, 0
        self.hashes: list[int] = []
        self.contents: list[bytes] = []
        self.digests: list[bytes] = []
        self.counts: list[int] = []
        self.best: list[tuple[int, int, int]] = []

    def add(self, content: bytes, digest: bytes, n: int, best: tuple[int, int, int]) -> bool:
        """Merge a record, the smallest ``best`` of its content wins; False: it is new and the table is full."""
        h = int.from_bytes(digest[:8], "little")
        mask = len(self.slots) - 1
        at = h & mask
        while (e := self.slots[at]) >= 0:
            if self.hashes[e] == h and self.contents[e] == content:
                self.counts[e] += n
                if best < self.best[e]:
                    self.best[e] = best
                return True
            at = (at + 1) & mask
        if self.contents and self.bytes + len(content) > self.limit:
            return False
        self.slots[at] = len(self.contents)
        self.hashes.append(h)
        self.contents.append(content)
        self.digests.append(digest)
        self.counts.append(n)
        self.best.append(best)
        self.bytes += len(content) + 200
        if 2 * len(self.contents) > len(self.slots):
            self._grow()
        return True

    def _grow(self) -> None:
        self.slots = [-1] * (2 * len(self.slots))
        mask = len(self.slots) - 1
        for e, h in enumerate(self.hashes):
            at = h & mask
            while self.slots[at] >= 0:
                at = (at + 1) & mask
            self.slots[at] = e


def _records(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """A link for every row, and one content record for equal rows of this task while they fit the table."""
    table, row = ContentTable(limit), TaskContext.get().partitionId() << 36
    for piece in pieces(batches, "text"):
        buf, offsets = column_bytes(piece.column(1))
        chars = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum((buf & 0xC0) != 0x80, out=chars[1:])
        solid = ~_IS_SPACE[buf]
        kept = np.zeros(len(buf) + 1, dtype=np.int64)
        np.cumsum(solid, out=kept[1:])
        data, cut, n_chars = buf[solid].tobytes(), kept[offsets].tolist(), np.diff(chars[offsets]).tolist()
        docs, digests = piece.column(0).to_pylist(), []
        for i, doc in enumerate(docs):
            content = data[cut[i] : cut[i + 1]]
            digests.append(digest := hashlib.sha256(content).digest())
            best = (-n_chars[i], doc, row + i)
            if not table.add(content, digest, 1, best):
                yield _contents(table)
                table.clear()
                table.add(content, digest, 1, best)
        m = len(docs)
        none = pa.nulls(m, pa.binary())
        yield _batch(ROWS, [pa.array([True] * m), pa.array(range(row, row + m), pa.int64()), piece.column(0), pa.array(n_chars, pa.int64()), pa.array(np.diff(cut)), pa.array(digests, pa.binary()), none, pa.array([1] * m, pa.int64())])
        row += m
    if table.contents:
        yield _contents(table)
    table.clear()
    release_memory()


def _contents(t: ContentTable) -> pa.RecordBatch:
    m = len(t.contents)
    return _batch(ROWS, [pa.array([False] * m), pa.array([b[2] for b in t.best], pa.int64()), pa.array([b[1] for b in t.best], pa.int64()), pa.array([-b[0] for b in t.best], pa.int64()), pa.array([len(c) for c in t.contents], pa.int64()), pa.array(t.digests, pa.binary()), pa.array(t.contents, pa.binary()), pa.array(t.counts, pa.int64())])


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in schema.split(", ")])


def _bucket(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Groups of a bucket; records that don't fit come out with full = true, to be dealt again."""
    table = ContentTable(limit)
    for batch in pieces(batches, "content"):
        left = []
        for content, digest, n, n_chars, doc, row in zip(*(batch.column(c).to_pylist() for c in ("content", "digest", "n", "n_chars", "doc", "row")), strict=True):
            if not table.add(content, digest, n, (-n_chars, doc, row)):
                left.append((True, digest, content, n, n_chars, doc, row))
        if left:
            yield _groups(left)
    for lo in range(0, len(table.contents), 20_000):
        part = slice(lo, lo + 20_000)
        yield _groups([(False, d, None, n, -b[0], b[1], b[2]) for d, n, b in zip(table.digests[part], table.counts[part], table.best[part], strict=True)])
    table.clear()
    release_memory()


def _groups(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.bool_(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
    return _batch(GROUPS, [pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)])


def exact_groups(df: DataFrame, memory: int = 48 << 20) -> DataFrame:
    """One row per row of (doc_id, text): its group of texts that are equal without white space.

    Columns: doc_id, keep_id, group_size, kept, text_sha256. White space is
    ``[\\x20\\x09-\\x0D]``. The row with the most code points in its original text stays,
    then the smallest doc_id; of rows that repeat both, exactly one. ``memory`` bounds the
    bytes of content in a task's table.

    Null text: empty; empty and blank texts form one group. Null doc_id: smaller than any
    other; keep_id is then null. Empty table: no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    base = df.select(id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    rows = written(base.mapInArrow(lambda b: _records(b, memory), ROWS), "exact-rows", ("link",))
    todo = rows.where("not link").select("content", "digest", "n", "n_chars", "doc", "row")
    size = rows.where("not link").agg(F.sum("n_bytes")).first()[0] or 0
    groups, level = None, 0
    while True:
        n = parts(spark, size, memory // 2)
        dealt = todo.repartition(n, F.xxhash64("digest", F.lit(level)))
        out = written(dealt.mapInArrow(lambda b: _bucket(b, memory), GROUPS), f"exact-level{level}", ("full",))
        done = out.where("not full").select("digest", "n", "doc", "row")
        groups = done if groups is None else groups.unionByName(done)
        todo = out.where("full").select("content", "digest", "n", "n_chars", "doc", "row")
        size = todo.agg(F.sum(F.octet_length("content").cast("long"))).first()[0]
        if size is None:
            break
        level += 1
    links = rows.where("link").select("doc", "row", "digest")
    groups = groups.select(F.col("digest").alias("g"), F.col("n").alias("group_size"), F.col("doc").alias("keep"), F.col("row").alias("keep_row"))
    # links and groups are small rows; a digest that a third of the links share is split by the adaptive skew join
    return links.join(groups, F.col("digest") == F.col("g")).select(
        F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.nullif("keep", F.lit(NO_ID)).alias("keep_id"), "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256")
    )


def drop_copies(df: DataFrame) -> DataFrame:
    """The rows of ``df``, all columns, that stay: one of each group of equal texts (see exact_groups).

    Null, empty and blank texts are one group, of which one row stays. Null doc_id is smaller
    than any other. Of rows that repeat an id and a text without white space, one with
    the longest original stays; which of them, if several are as long, is not defined. Empty table: no rows. Columns may have any names.
    """
    groups = exact_groups(df.select("doc_id", "text")).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("gone_id"), F.col("text_sha256").alias("gone_digest"), "kept")
    gone = groups.groupBy("gone_id", "gone_digest").agg(F.max("kept").alias("kept"), F.count("*").alias("n"))
    gone = written(gone.where("not kept or n > 1"), "exact-dropped").drop("n")
    digest = F.sha2(F.regexp_replace(F.coalesce(F.col("text").cast("string"), F.lit("")), r"[\x20\x09-\x0D]+", ""), 256)
    rows = df.select(id_key().alias("id"), digest.alias("digest"), every_column(df).alias("row"))
    stay, asked = split_listed(rows, ["id", "digest"], gone, ["gone_id", "gone_digest"])
    own = asked.join(gone.hint("merge"), (F.col("id") == F.col("gone_id")) & (F.col("digest") == F.col("gone_digest")), "left")
    # rows that repeat an id and a text without white space are all listed: the longest original stays
    size = F.length(F.coalesce(F.col("row.text").cast("string"), F.lit("")))
    # a place of 1 is all that is asked for, so each task sends one row of an id and a digest on
    place = F.row_number().over(Window.partitionBy("id", "digest").orderBy(size.desc()))
    own = own.where("kept is null or kept").withColumn("place", place).where("place = 1")
    return stay.select("row").unionByName(own.select("row")).select("row.*")


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(norm) AS text_sha256
FROM d WINDOW w AS (PARTITION BY norm ORDER BY n DESC, doc_id)
"""
