"""Operator 11: SimHash near-duplicates by covering locality-sensitive hashing.

A text's fingerprint has a bit for each position that more than half of its shingle hashes
set. Fingerprints within a radius r are linked. Every bit position has a nonzero vector of
r + 1 bits; each nonzero vector v of that space gives a table, whose mask keeps the positions
with an odd inner product with v. Up to r differing positions span less than the whole space,
so some v is orthogonal to all of them: in its table both fingerprints have the same key.
No pair within the radius is missed, with 2**(r + 1) - 1 tables and half of the bits a key.
Overfull buckets are dealt again by further masks, drawn with other vectors for the positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._components import components
from tastemill.llm._jobs import NO_ID, id_key, parts, split_listed, written
from tastemill.llm._text import Words, pieces, release_memory

BITS, SEED = 64, 42
#: distinct fingerprints that one bucket holds in a task
MOST = 2048
PRINTS = "doc long, fp long"
LINKS = "a long, b long"

#: the bits of a byte as eight counters of a byte each
_LANES = np.array([sum(1 << 8 * i for i in range(8) if v >> i & 1) for v in range(256)], dtype=np.uint64)
#: counters of a byte hold so many ones
_RUN = 255


def fingerprints(column: pa.Array, k: int = 3) -> np.ndarray:
    """The fingerprint of each row: words lower-cased in A-Z, shingles of ``k`` words with repeats, joined by a space."""
    words = Words(column, lower=True)
    text, starts, ends = words.joined()
    counts, first = words.counts, words.row_words[:-1]
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    row = np.repeat(np.arange(len(n)), n)
    number = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = first[row] + number
    last = at + np.minimum(counts[row], k) - 1
    view, digest = memoryview(text), xxhash.xxh64_intdigest
    hashed = np.fromiter((digest(view[a:b], SEED) for a, b in zip(starts[at].tolist(), ends[last].tolist(), strict=True)), np.dtype("<u8"), len(row))
    ones = np.zeros((len(n), BITS), dtype=np.int64)
    cut = np.flatnonzero(number % _RUN == 0)
    if len(cut):
        lanes = np.add.reduceat(_LANES[hashed.view(np.uint8).reshape(-1, 8)], cut, axis=0)
        np.add.at(ones, row[cut], lanes.astype("<u8").view(np.uint8).reshape(-1, BITS))
    return np.packbits(2 * ones > n[:, None], axis=1, bitorder="little").view("<u8").ravel().astype(np.uint64)


def _prints(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(fingerprints(piece.column(1), k).view(np.int64))], names=["doc", "fp"])
    release_memory()


def masks(radius: int, level: int) -> list[int]:
    """The masks of a covering family; other levels give the positions other vectors."""
    size = (1 << radius + 1) - 1
    vectors = np.random.default_rng(level).permutation(np.resize(np.arange(1, size + 1), BITS)).tolist()
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() & 1) for v in range(1, size + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _keys(radius: int, level: int) -> Column:
    """A fingerprint's bucket in each table. Buckets whose hashes clash are one: pairs are compared in the end."""
    own = [F.xxhash64("bucket", F.lit(v), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for v, m in enumerate(masks(radius, level))]
    return F.explode(F.array(*own)).alias("bucket")


def _spanning(prints: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what is connected, at most one a fingerprint: each one looks for those not reached yet."""
    out, left = [], prints
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            x = front.pop()
            near = np.bitwise_count(left ^ x) <= radius
            if near.any():
                found = left[near]
                out += [(int(x), int(y)) for y in found]
                front.extend(found)
                left = left[~near]
    return out


def _near(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Links of each bucket; the input (bucket, fp) is sorted, a bucket holds at most about MOST fingerprints."""
    held_b, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    for batch in batches:
        held_b = np.append(held_b, batch.column(0).to_numpy())
        held_f = np.append(held_f, batch.column(1).to_numpy().view(np.uint64))
        if not len(held_b):
            continue
        whole = int(np.searchsorted(held_b, held_b[-1]))  # the last bucket may go on
        yield _bucket_links(held_b[:whole], held_f[:whole], radius)
        held_b, held_f = held_b[whole:], held_f[whole:]
    yield _bucket_links(held_b, held_f, radius)


def _bucket_links(bucket: np.ndarray, fp: np.ndarray, radius: int) -> pa.RecordBatch:
    cuts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    sizes = np.diff(np.append(cuts, len(bucket)))
    pair = cuts[sizes == 2]
    pair = pair[np.bitwise_count(fp[pair] ^ fp[pair + 1]) <= radius]
    a, b = [fp[pair]], [fp[pair + 1]]
    for at, n in zip(cuts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
        found = _spanning(np.unique(fp[at : at + n]), radius)
        a.append(np.array([x for x, _ in found], dtype=np.uint64))
        b.append(np.array([y for _, y in found], dtype=np.uint64))
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])


def near_links(prints: DataFrame, radius: int = 3, most: int = MOST) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of (fp) that connect all that are within the radius, over any number of steps.

    Bucket sizes are counted first, with partial counts before the shuffle; buckets of more
    than ``most`` fingerprints are never gathered, but dealt again by another covering family.
    """
    spark, todo, level, found = prints.sparkSession, prints.select(F.lit(0).cast("long").alias("bucket"), "fp"), 0, None
    while True:
        keyed = todo.select(_keys(radius, level), "fp")
        # a bucket with so many members has over 11 positions that no mask has fixed yet, and a further family fixes half of them
        hot = written(keyed.groupBy(F.col("bucket").alias("hot")).count().where(F.col("count") > most).select("hot"), f"simhash-hot{level}")
        again = None
        if not hot.isEmpty():
            stay, asked = split_listed(keyed, ["bucket"], hot, ["hot"])
            asked = asked.join(hot.hint("merge"), F.col("bucket") == F.col("hot"), "left")
            keyed = stay.unionByName(asked.where("hot is null").drop("hot"))
            again = written(asked.where("hot is not null").drop("hot"), f"simhash-again{level}")
        n = parts(spark, 16 * ((1 << radius + 1) - 1) * todo.count())
        links = keyed.repartition(n, "bucket").sortWithinPartitions("bucket", "fp").mapInArrow(lambda b: _near(b, radius), LINKS)
        links = written(links.distinct(), f"simhash-links{level}")
        found = links if found is None else found.unionByName(links)
        if again is None:
            return found
        todo, level = again, level + 1


def near_groups(df: DataFrame, radius: int = 3, k: int = 3, most: int = MOST) -> DataFrame:
    """(doc_id, fingerprint, component_id) of each row of (doc_id, text).

    fingerprint: 16 lowercase hex digits of the SimHash of the whole text, A-Z lower-cased,
    words being runs of bytes other than ``[\\x20\\x09-\\x0D]``; shingles of ``k`` words, repeats
    included, or the whole sequence where there are fewer, hashed by XXH64 with seed 42. Rows
    whose fingerprints differ in at most ``radius`` bits link; component_id is the smallest
    doc_id that links lead to, itself included.

    Null, empty and blank texts have fingerprint zero and link like any other. Null doc_id is
    smaller than any other and shows as null (as does the id -2**63). Rows that repeat an id
    are linked by their own texts. Empty table: no rows. Other columns are ignored.
    """
    docs = df.select(id_key().alias("doc"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = written(docs.mapInArrow(lambda b: _prints(b, k), PRINTS), "simhash-rows")
    classes = written(rows.groupBy("fp").agg(F.min("doc").alias("least")), "simhash-classes")
    roots = components(near_links(classes.select("fp"), radius, most))
    labelled = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = labelled.groupBy(F.col("root").alias("r")).agg(F.min("least").alias("component"))
    labels = labelled.join(least, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component")
    # a fingerprint that a third of the rows share is split by the adaptive skew join
    out = rows.join(labels, F.col("fp") == F.col("f"))
    return out.select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("component", F.lit(NO_ID)).alias("component_id"))


def op11_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
