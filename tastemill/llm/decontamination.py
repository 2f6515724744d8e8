"""Operator 7: benchmark decontamination by size-partitioned MinHash containment search.

A test item is searched by the smallest hashes of its shingles (its bottom-k MinHash
sketch), with k chosen by the item's size: k = floor((1 - t) * size) + 1. A document that
holds the share t of an item's shingles leaves out fewer than k of them, so it holds one
of the k, and no leak is missed. Items lie in partitions by size; a document is looked up
only in partitions whose items it is long enough to contain. Items of fewer words than a
shingle are one shingle of their own width. Candidates are verified on the words themselves.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._jobs import NO_ID, id_key, without, written
from tastemill.llm._text import Words, distinct_by_row, pieces, shingles

MATCHES = "doc long, item_id long, n_item_shingles long, n_shared long, containment double"


def _shingle_set(text: str, k: int) -> set[bytes]:
    words = _lower(text.encode("utf-8", "replace")).translate(_TO_SPACE).split(b" ")
    words = [w for w in words if w]
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)}


_TO_SPACE = bytes(0x20 if b in range(0x09, 0x0E) else b for b in range(256))


def _lower(raw: bytes) -> bytes:
    return raw.lower()  # of bytes: A-Z only


class ItemIndex:
    """Sketches of a block of items, by width of their shingles and size partition (powers of two)."""

    def __init__(self, items: list[tuple[int | None, str | None]], k: int, threshold: float):
        self.threshold = threshold
        self.ids, self.sets = [], []
        words = Words(pa.array([t for _, t in items], pa.string()), lower=True)
        width_of = np.minimum(words.counts, k)
        #: by width: (fewest shingles of a document, sketch hashes in order, their items, filter)
        self.partitions: dict[int, list[tuple[float, np.ndarray, np.ndarray, np.ndarray]]] = {}
        for width in sorted(set(width_of[width_of > 0].tolist())):
            rows, hashed = distinct_by_row(*shingles(words, width, short=False))
            cuts = np.searchsorted(rows, np.arange(len(items) + 1))
            own: dict[int, list[tuple[np.ndarray, int]]] = {}
            for i in np.flatnonzero(width_of == width).tolist():
                h = hashed[cuts[i] : cuts[i + 1]]  # ascending
                own.setdefault(len(h).bit_length(), []).append((h[: int((1 - threshold) * len(h) + 1e-9) + 1], len(self.ids)))
                self.ids.append(items[i][0])
                self.sets.append(_shingle_set(items[i][1], width))
            self.partitions[width] = [self._partition(size, sketches) for size, sketches in sorted(own.items())]

    def _partition(self, size: int, sketches: list[tuple[np.ndarray, int]]) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        values = np.concatenate([s for s, _ in sketches])
        item = np.repeat([i for _, i in sketches], [len(s) for s, _ in sketches])
        order = np.argsort(values, kind="stable")
        maybe = np.zeros(1 << 18, dtype=bool)
        maybe[(values & np.uint64((1 << 18) - 1)).astype(np.int64)] = True
        return self.threshold * (1 << (size - 1)), values[order], item[order], maybe

    def candidates(self, words: Words, width: int) -> set[tuple[int, int]]:
        """(row, item) that share a hash of an item's sketch."""
        rows, hashed = shingles(words, width, short=False)
        counts = np.bincount(rows, minlength=len(words.counts))
        found: set[tuple[int, int]] = set()
        low = (hashed & np.uint64((1 << 18) - 1)).astype(np.int64)
        for least, values, item, maybe in self.partitions[width]:
            at = np.flatnonzero(maybe[low])
            at = at[(counts[rows[at]] >= least) & (hashed[at] <= values[-1])]
            lo, hi = np.searchsorted(values, hashed[at], "left"), np.searchsorted(values, hashed[at], "right")
            at, n, lo = at[hi > lo], (hi - lo)[hi > lo], lo[hi > lo]
            if len(at):
                ends = np.cumsum(n)
                entry = np.repeat(lo - (ends - n), n) + np.arange(ends[-1])
                found.update(zip(np.repeat(rows[at], n).tolist(), item[entry].tolist(), strict=True))
        return found


def leaks(docs: DataFrame, items: DataFrame, k: int = 5, threshold: float = 0.8, block: int = 20_000, block_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of documents that hold an item.

    A document (doc_id, text) holds an item (item_id, text) if at least ``threshold`` of
    the item's distinct ``k``-word shingles occur in it. Words are separated by
    ``[\\x20\\x09-\\x0D]`` and A-Z are lower-cased. Items are a list that people have made:
    they are read in blocks of at most ``block`` items and about ``block_bytes`` of text (the
    bound of what is broadcast); every block is searched in all documents.

    An item of fewer than ``k`` words is one shingle, its whole sequence, and is found where
    these words follow one another. Empty and null texts hold nothing and are found
    nowhere. Null ids are kept as null. Repeated documents or items match row by row.
    Empty tables: no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    base = docs.select(id_key().alias("doc"), F.col("text").cast("string").alias("text"))
    found = []
    own = items.select(F.col("item_id").cast("long"), F.col("text").cast("string"))
    taken: list[tuple] = []
    size = 0

    def search(part: list[tuple]) -> DataFrame:
        shared = spark.sparkContext.broadcast(ItemIndex(part, k, threshold))
        return base.mapInArrow(lambda b: _search(b, shared.value), MATCHES)

    for row in own.toLocalIterator():
        taken.append((row[0], row[1]))
        size += len(row[1] or "")
        if len(taken) == block or size >= block_bytes:
            found.append(written(search(taken), "leaks"))
            taken, size = [], 0
    if taken or not found:
        found.append(search(taken))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "item_id", "n_item_shingles", "n_shared", "containment")


def _search(batches: Iterator[pa.RecordBatch], index: ItemIndex) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words, out = Words(piece.column(1), lower=True), []
        for width in index.partitions:
            last, have = -1, set()
            for row, item in sorted(index.candidates(words, width)):
                if row != last:
                    last, have = row, _shingle_set(piece.column(1)[row].as_py(), width)
                want = index.sets[item]
                shared = len(want & have)
                if shared >= index.threshold * len(want) - 1e-9:
                    out.append((piece.column(0)[row].as_py(), index.ids[item], len(want), shared, shared / len(want)))
        names = [x.split()[0] for x in MATCHES.split(", ")]
        types = [pa.int64()] * 4 + [pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], type=t) for j, t in enumerate(types)], names=names)


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item (see leaks).

    Null and empty texts hold none and stay. Rows that repeat an id stay or go together.
    Empty tables: nothing goes. Columns may have any names.
    """
    found = leaks(docs.select("doc_id", "text"), items).select(F.coalesce("doc_id", F.lit(NO_ID)).alias("leak")).distinct()
    return without(docs, written(found, "leaks-dropped"), {"leak": id_key()})


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH words AS (
  SELECT kind, id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark)
), width AS (
  SELECT DISTINCT least(5, len(w)) AS k FROM words WHERE kind = 'b' AND len(w) > 0
), shingle AS (
  SELECT DISTINCT kind, id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM words, width WHERE len(w) >= k AND (kind = 'd' OR len(w) = k OR k = 5)
), size AS (
  SELECT id, count(*) AS n FROM shingle WHERE kind = 'b' GROUP BY id
)
SELECT d.id AS doc_id, b.id AS item_id, max(z.n) AS n_item_shingles, count(*) AS n_shared, count(*) / max(z.n) AS containment
FROM shingle d JOIN shingle b ON d.kind = 'd' AND b.kind = 'b' AND d.k = b.k AND d.s = b.s JOIN size z ON z.id = b.id
GROUP BY d.id, b.id HAVING 10 * count(*) >= 8 * max(z.n)
"""
