"""Operator 3: repeated word windows by super-k-mer partitioning.

A document is the sequence of its words; every window of k words has a minimiser, the
smallest hash among its m-word grams. Consecutive windows with one minimiser travel as one
packed string (a super-k-mer) to the minimiser's bucket, so equal windows always meet.
There the windows are sorted, and all but the earliest of equal ones are removed. Grams
that are very frequent in the corpus rank behind all others, so that a common line does
not draw its neighbours' windows into one bucket. A bucket that still holds too many
different windows is dealt again, each window by its own hash.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._jobs import NO_ID, parts, text_bytes
from tastemill.llm._spans import FOUND, again_batch, covered, heavy, keyed, ranges, span_batch, spans_and_rest, with_spans
from tastemill.llm._text import Words, mix, pieces, release_memory, sliding_min, span_hashes, window_hashes

PACKED = "bucket int, packed binary"
KEPT = "doc long, text string, n_words long, n_removed long"
_FIELDS = (np.int64, np.int64, np.int32, np.int32, np.int32)


def _runs(words: Words, k: int, m: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, minimiser) of the super-k-mers of some rows; a window is named by its first word."""
    counts = words.counts
    windows = np.maximum(counts - k + 1, 0)
    if not windows.sum():
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    grams = window_hashes(words.hashes(), m) >> np.uint64(1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | np.uint64(1 << 63), grams)
    least = sliding_min(grams, k - m + 1)
    first = words.row_words[:-1][windows > 0]
    own = ranges(first, windows[windows > 0])
    new = np.ones(len(own), dtype=bool)
    new[1:] = (least[own][1:] != least[own][:-1]) | (own[1:] != own[:-1] + 1)
    new[np.cumsum(windows[windows > 0])[:-1]] = True
    at = np.flatnonzero(new)
    return own[at], np.diff(np.append(at, len(own))), least[own[at]]


def _frequent(batches: Iterator[pa.RecordBatch], k: int, m: int) -> Iterator[pa.RecordBatch]:
    """The grams that are minimisers of many windows in a piece, with their numbers of windows."""
    none = np.zeros(0, np.uint64)
    for piece in pieces(batches, "text"):
        _, n, least = _runs(Words(piece.column(1)), k, m, none)
        keys, at = np.unique(least, return_inverse=True)
        sums = np.bincount(at, n, minlength=len(keys)).astype(np.int64)
        often = sums > max(64, sums.sum() / 2000)
        rest = int(sums[~often].sum())
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often].astype(np.int64), -1)), pa.array(np.append(sums[often], rest))], names=["key", "n"])


def _pack(columns: list, data: bytes) -> bytes:
    head = b"".join(np.asarray(c, dtype=t).tobytes() for c, t in zip(columns, _FIELDS, strict=True))
    return zstandard.ZstdCompressor(level=3).compress(struct.pack("<q", len(columns[0])) + head + data)


def _unpack(packed: bytes) -> tuple[list[np.ndarray], bytes]:
    raw = zstandard.ZstdDecompressor().decompress(packed)
    n, at, out = struct.unpack_from("<q", raw)[0], 8, []
    for t in _FIELDS:
        out.append(np.frombuffer(raw, t, n, at))
        at += n * np.dtype(t).itemsize
    return out, raw[at:]


def _send(batches: Iterator[pa.RecordBatch], k: int, m: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Super-k-mers packed by bucket. Of equal ones in a piece the earliest is sent; the others are known to be repeats.

    A packed string holds (doc, tie, first word, windows, bytes) and the text of its
    super-k-mers; entries of zero bytes are spans found here, as (doc, tie, start, end).
    """
    for piece in pieces(batches, "text", 3 << 20):
        piece = piece.take(pa.array(np.argsort(piece.column(0).to_numpy(), kind="stable")))
        words = Words(piece.column(2))
        at, n, least = _runs(words, k, m, hot)
        if not len(at):
            continue
        data, starts, ends = words.joined()
        view = data.tobytes()
        row = np.searchsorted(words.row_words, at, "right") - 1
        doc, tie = piece.column(0).to_numpy()[row], piece.column(1).to_numpy()[row]
        place = at - words.row_words[row]
        texts = [view[a:b] for a, b in zip(starts[at].tolist(), ends[at + n + k - 2].tolist(), strict=True)]
        seen: dict[bytes, int] = {}
        sent, spans = np.ones(len(at), dtype=bool), []
        for i, text in enumerate(texts):
            j = seen.setdefault(text, i)
            if j != i:
                if doc[i] == doc[j] and place[i] == place[j]:  # rows with one id: neither is earlier
                    sent[i] = bool(tie[i] != tie[j])
                else:
                    sent[i] = False
                    spans.append(i)
        bucket = (mix(least, 7) % np.uint64(buckets)).astype(np.int64)
        order = np.flatnonzero(sent)
        order = order[np.argsort(bucket[order], kind="stable")]
        out, size = [], np.fromiter(map(len, texts), np.int64, len(texts))
        for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
            if len(group):
                out.append((int(bucket[group[0]]), _pack([doc[group], tie[group], place[group], n[group], size[group]], b" ".join(texts[i] for i in group))))
        if spans:
            s = np.array(spans)
            out.append((int(mix(tie[s[:1]].astype(np.uint64))[0] % np.uint64(buckets)), _pack([doc[s], tie[s], place[s], place[s] + n[s] + k - 1, np.zeros(len(s))], b"")))
        yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "packed"])


class Bucket:
    """Super-k-mers that have come in; ``settle`` finds the repeats and forgets what holds no first window."""

    def __init__(self, k: int):
        self.k = k
        self.columns: list[list[np.ndarray]] = []
        self.texts: list[bytes] = []
        self.bytes = 0

    def add(self, columns: list[np.ndarray], data: bytes) -> None:
        ends = np.cumsum(columns[4].astype(np.int64) + 1) - 1
        self.texts += [data[e - size : e] for e, size in zip(ends.tolist(), columns[4].tolist(), strict=True)]
        self.columns.append(columns)
        self.bytes += len(data)

    def packed(self) -> Iterator[bytes]:
        """All that is held, in strings of about a megabyte."""
        columns = [np.concatenate([c[i] for c in self.columns]) for i in range(5)]
        size = np.cumsum(columns[4])
        cuts = [0, *(np.flatnonzero(np.diff(size >> 20)) + 1).tolist(), len(size)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            yield _pack([c[a:b] for c in columns], b" ".join(self.texts[a:b]))

    def settle(self) -> pa.RecordBatch:
        doc, tie, place, n, _ = (np.concatenate([c[i] for c in self.columns]).astype(np.int64) for i in range(5))
        order = np.lexsort((place, doc))
        doc, tie, place, n = doc[order], tie[order], place[order], n[order]
        texts = [self.texts[i] for i in order.tolist()]
        data = b" ".join(texts) + b" "
        buf = np.frombuffer(data, np.uint8)
        ends = np.flatnonzero(buf == 0x20)
        starts = np.append(0, ends[:-1] + 1)
        first = np.cumsum(n + self.k - 1) - (n + self.k - 1)
        word = ranges(first, n)  # the first word of each window
        of = np.repeat(np.arange(len(n)), n)
        at = place[of] + word - first[of]
        hashed = window_hashes(span_hashes(buf, starts, ends), self.k)[word]
        by = np.argsort(hashed, kind="stable")  # the windows of equal hash stay in document order
        new = np.ones(len(by), dtype=bool)
        new[1:] = hashed[by][1:] != hashed[by][:-1]
        earliest = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
        other = np.full(len(by), -1)
        other[by] = earliest
        repeat = (other != np.arange(len(by))) & ((doc[of] != doc[of][other]) | (at != at[other]))
        x = np.flatnonzero(repeat)
        if len(x):
            y = other[x]
            fresh = np.ones(len(x), dtype=bool)
            fresh[1:] = (x[1:] != x[:-1] + 1) | (y[1:] != y[:-1] + 1) | (of[x][1:] != of[x][:-1]) | (of[y][1:] != of[y][:-1])
            lo = np.flatnonzero(fresh)
            hi = np.append(lo[1:], len(x)) - 1
            a, b, c, d = (v.tolist() for v in (starts[word[x[lo]]], ends[word[x[hi]] + self.k - 1], starts[word[y[lo]]], ends[word[y[hi]] + self.k - 1]))
            if any(data[p:q] != data[r:s] for p, q, r, s in zip(a, b, c, d, strict=True)):
                x = self._by_content(data, starts, ends, word, doc[of], at)  # two windows share a hash
                fresh = np.ones(len(x), dtype=bool)
                fresh[1:] = (x[1:] != x[:-1] + 1) | (of[x][1:] != of[x][:-1])
                lo = np.flatnonzero(fresh)
                hi = np.append(lo[1:], len(x)) - 1
                repeat = np.zeros(len(by), dtype=bool)
                repeat[x] = True
            out = span_batch(doc[of[x[lo]]], tie[of[x[lo]]], at[x[lo]], at[x[hi]] + self.k)
        else:
            out = span_batch(*[np.zeros(0)] * 4)
        keep = np.flatnonzero(np.bincount(of, ~repeat, minlength=len(n)))
        self.columns = [[v[keep] for v in (doc, tie, place, n)] + [np.array([len(texts[i]) for i in keep.tolist()])]]
        self.texts = [texts[i] for i in keep.tolist()]
        self.bytes = sum(map(len, self.texts))
        return out

    def _by_content(self, data: bytes, starts: np.ndarray, ends: np.ndarray, word: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
        seen: dict[bytes, int] = {}
        out = []
        for i, w in enumerate(word.tolist()):
            j = seen.setdefault(data[starts[w] : ends[w + self.k - 1]], i)
            if j != i and (doc[i] != doc[j] or at[i] != at[j]):
                out.append(i)
        return np.array(out, dtype=np.int64)


def _count(batches: Iterator[pa.RecordBatch], k: int, limit: int, most: int | None) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, bucket by bucket, as FOUND.

    A bucket is settled after every ``limit`` bytes. If more than ``most`` bytes of different
    windows are left then, these and what follows come out to be dealt again.
    """

    def rows() -> Iterator[tuple[int, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

    for _, own in groupby(rows(), key=lambda r: r[0]):
        bucket, step, full = Bucket(k), limit, False
        for _, packed in own:
            columns, data = _unpack(packed)
            if not data:
                yield span_batch(columns[0], columns[1], columns[2], columns[3])
                continue
            if full:
                yield again_batch([packed])
                continue
            bucket.add(columns, data)
            if bucket.bytes > step:
                yield bucket.settle()
                step = bucket.bytes + limit
                if most is not None and bucket.bytes > most:
                    for held in bucket.packed():
                        yield again_batch([held])
                    bucket, full = Bucket(k), True
        if bucket.columns:
            yield bucket.settle()
        del bucket
        release_memory()


def _send_windows(batches: Iterator[pa.RecordBatch], k: int, buckets: int) -> Iterator[pa.RecordBatch]:
    """Packed super-k-mers again, each window by itself to the bucket of its hash."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            (doc, tie, place, n, _), data = _unpack(packed)
            n = n.astype(np.int64)
            buf = np.frombuffer(data + b" ", np.uint8)
            ends = np.flatnonzero(buf == 0x20)
            starts = np.append(0, ends[:-1] + 1)
            first = np.cumsum(n + k - 1) - (n + k - 1)
            word, of = ranges(first, n), np.repeat(np.arange(len(n)), n)
            bucket = (mix(window_hashes(span_hashes(buf, starts, ends), k)[word], 8) % np.uint64(buckets)).astype(np.int64)
            at, a, b = place[of] + word - first[of], starts[word], ends[word + k - 1]
            order = np.argsort(bucket, kind="stable")
            out = []
            for group in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
                texts = [data[x:y] for x, y in zip(a[group].tolist(), b[group].tolist(), strict=True)]
                out.append((int(bucket[group[0]]), _pack([doc[of[group]], tie[of[group]], at[group], np.ones(len(group)), (b - a)[group]], b" ".join(texts))))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in out], pa.int32()), pa.array([p for _, p in out], pa.binary())], names=["bucket", "packed"])


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        words = Words(piece.column(1))
        gone = covered(len(words), words.row_words[:-1], piece.column(2), piece.column(3))
        length = words.ends - words.starts
        kept = np.repeat(~gone, length)
        size = np.where(gone, 0, length + 1)
        ends = np.cumsum(size)
        out = np.full(int(ends[-1]) if len(ends) else 0, 0x20, dtype=np.uint8)
        solid = np.ones(len(out), dtype=bool)
        solid[ends[~gone] - 1] = False
        out[solid] = words.buf[words.solid][kept]
        removed = np.diff(np.concatenate([[0], np.cumsum(gone)])[words.row_words])
        cut = np.concatenate([[0], ends])[words.row_words].tolist()
        raw = out.tobytes()
        texts = pa.array([raw[a : max(a, b - 1)] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary()).view(pa.string())
        yield pa.RecordBatch.from_arrays([piece.column(0), texts, pa.array(words.counts), pa.array(removed)], names=["doc", "text", "n_words", "n_removed"])


def repeated_windows(docs: DataFrame, k: int = 20, m: int = 3, memory: int = 12 << 20) -> DataFrame:
    """(doc, tie, s, e): word ranges of keyed() documents covered by a window that also starts earlier.

    A task holds about 4 * ``memory`` bytes of packed strings at most.
    """
    spark = docs.sparkSession
    n = parts(spark, 3 * text_bytes(docs))
    buckets = 4 * n
    narrow = docs.select("doc", "text")
    often = heavy(narrow.mapInArrow(lambda b: _frequent(b, k, m), "key long, n long"))
    hot = np.array(sorted(x for x in often if x >= 0), dtype=np.uint64)
    sent = docs.mapInArrow(lambda b: _send(b, k, m, buckets, hot), PACKED)
    counted = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _count(b, k, memory, 3 * memory), FOUND)
    spans, rest, size = spans_and_rest(counted, "repeated-windows")
    if not size:
        return spans
    n = parts(spark, 3 * k * size)
    alone = rest.mapInArrow(lambda b: _send_windows(b, k, 4 * n), PACKED)
    counted = alone.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b: _count(b, k, memory, None), FOUND)
    return spans.unionByName(spans_and_rest(counted, "repeated-windows-again")[0])


def drop_repeats(df: DataFrame, k: int = 20) -> DataFrame:
    """(doc_id, text, n_words, n_removed): each row's words without repeated windows, joined by one space.

    Words are runs of bytes other than ``[\\x20\\x09-\\x0D]``, unchanged. A word goes if a
    window of ``k`` words that covers it starts earlier too (in a smaller doc_id, or before
    in the same document), judged on the whole input.

    Null, empty or short texts lose nothing; null text comes back as "". Null doc_id is
    smaller than any other. Rows that repeat an id count as one document: windows at the
    same place in them are not earlier than each other, so repeated rows come out alike.
    Empty table: no rows. Other columns are ignored.
    """
    docs = keyed(df)
    return with_spans(docs, repeated_windows(docs, k)).mapInArrow(_keep, KEPT).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "text", "n_words", "n_removed")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), win AS (
  SELECT doc_id, i, array_to_string(w[i:i+19], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)
), hit AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM win) WHERE r > 1
), gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM hit
), word AS (
  SELECT doc_id, p, w[p] AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM d)
), kept AS (
  SELECT word.doc_id, count(*) AS n_words, count(gone.p) AS n_removed, coalesce(string_agg(x, ' ' ORDER BY p) FILTER (gone.p IS NULL), '') AS t
  FROM word LEFT JOIN gone USING (doc_id, p) GROUP BY word.doc_id
)
SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
