"""Operator 9: repeated byte strings by a distributed merge sort of suffixes.

The suffixes that are sorted start at anchors: each window of ``length`` bytes has one,
the leftmost of its ``q``-byte grams with the smallest hash, so equal windows hold equal
anchors at equal offsets and only one suffix in some ninety has to be sorted. Every task
sorts its suffixes into runs, front-codes them and sends each slice to the task of its
bucket. Buckets are ranges of the anchors' hashes and not of the suffixes themselves: equal
windows have to meet, and no suffix array of the whole corpus is wanted. A loser tree
merges the runs there: it carries the length of the prefix that each candidate shares with
the last winner, decides by that number where it can, and otherwise compares from there
on. Shared prefixes with the neighbours to the right of an anchor, and the same to its
left, say which windows occur more than once. A bucket that holds too much is dealt again
by anchors of another hash, and at last window by window.
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
from tastemill.llm._text import column_bytes, mix, pieces, release_memory, sliding_min, window_hashes

RUNS = "bucket int, run binary"
#: how often overfull buckets are dealt again by other anchors, before each window goes by itself
LEVELS = 3
KEPT = "doc long, kept binary, n_bytes long, n_removed long, n_spans long"
_FIELDS = (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32)  # doc, tie, place, left, shared, tail


def _gram_hashes(buf: np.ndarray, q: int, level: int = 0) -> np.ndarray:
    """Upper 32 bits of the hash of every q bytes; every level has its own order."""
    hashed = window_hashes(buf, q)
    return (mix(hashed, 40 + level) if level else hashed) >> np.uint64(32)


def _anchors(buf: np.ndarray, offsets: np.ndarray, length: int, q: int, hot: np.ndarray, level: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first window, windows, anchor, gram hash) of the runs of windows with one anchor; a window is named by its first byte."""
    windows = np.maximum(np.diff(offsets) - length + 1, 0)
    if not windows.sum():
        return (np.zeros(0, np.int64),) * 4
    if level > LEVELS:  # each window by itself
        own = ranges(offsets[:-1][windows > 0], windows[windows > 0])
        return own, np.ones(len(own), np.int64), own, (window_hashes(buf, length)[own] >> np.uint64(32)).astype(np.int64)
    grams = _gram_hashes(buf, q, level)
    grams &= np.uint64((1 << 31) - 1)
    if len(hot):
        at = np.minimum(np.searchsorted(hot, grams), len(hot) - 1)
        grams = np.where(hot[at] == grams, grams | np.uint64(1 << 31), grams)
    # value and place in one number: the smallest is the leftmost of the smallest grams
    best = sliding_min((grams << np.uint64(32)) | np.arange(len(grams), dtype=np.uint64), length - q + 1)
    own = ranges(offsets[:-1][windows > 0], windows[windows > 0])
    best = best[own]
    new = np.ones(len(own), dtype=bool)
    new[1:] = best[1:] != best[:-1]
    at = np.flatnonzero(new)
    return own[at], np.diff(np.append(at, len(own))), (best[at] & np.uint64(0xFFFFFFFF)).astype(np.int64), (best[at] >> np.uint64(32)).astype(np.int64)


def _frequent(batches: Iterator[pa.RecordBatch], length: int, q: int) -> Iterator[pa.RecordBatch]:
    """The grams that anchor many windows in a piece, with their numbers of runs."""
    for piece in pieces(batches, "text", 3 << 20):
        buf, offsets = column_bytes(piece.column(1))
        _, _, anchor, gram = _anchors(buf, offsets, length, q, np.zeros(0, np.uint64))
        keys, n = np.unique(gram, return_counts=True)
        often = n > max(16, n.sum() / 2000)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(keys[often], -1)), pa.array(np.append(n[often], n[~often].sum()).astype(np.int64))], names=["key", "n"])


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix; the first ``known`` bytes are known to be equal."""
    n = min(len(a), len(b))
    x, y = a[known:n], b[known:n]
    if x == y:
        return n
    differ = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
    return n - (differ + 7) // 8


def front_coded(suffixes: list[bytes]) -> tuple[list[int], list[bytes]]:
    """Of sorted suffixes: the length shared with the one before, and the bytes behind that."""
    shared, tails, last = [], [], b""
    for s in suffixes:
        n = shared_prefix(last, s)
        shared.append(n)
        tails.append(s[n:])
        last = s
    return shared, tails


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


def _send(batches: Iterator[pa.RecordBatch], length: int, q: int, buckets: int, hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Runs of the documents, piece by piece."""
    for piece in pieces(batches, "text", 3 << 20):
        buf, offsets = column_bytes(piece.column(2))
        doc, tie = piece.column(0).to_numpy(), piece.column(1).to_numpy()
        yield from _runs(buf, offsets, doc, tie, np.zeros(len(doc), np.int64), length, q, buckets, hot, 0)


def _send_again(batches: Iterator[pa.RecordBatch], length: int, q: int, buckets: int, level: int) -> Iterator[pa.RecordBatch]:
    """Runs of the entries of packed runs by the anchors of a level."""
    for batch in batches:
        for packed in batch.column(0).to_pylist():
            (doc, tie, place, left, shared, tails), data = _unpack(packed)
            ends = int(tails.sum()) + np.cumsum(left, dtype=np.int64)
            sides = [data[e - n : e] for e, n in zip(ends.tolist(), left.tolist(), strict=True)]
            texts = [side + right for side, (_, right, _) in zip(sides, _decoded(shared.tolist(), tails.tolist(), data, 0), strict=True)]
            offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
            cuts = [0, *(np.flatnonzero(np.diff(offsets[1:] >> 22)) + 1).tolist(), len(texts)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                buf = np.frombuffer(b"".join(texts[a:b]), np.uint8)
                yield from _runs(buf, offsets[a : b + 1] - offsets[a], doc[a:b], tie[a:b], (place - left)[a:b], length, q, buckets, np.zeros(0, np.uint64), level)


def _runs(buf: np.ndarray, offsets: np.ndarray, docs: np.ndarray, ties: np.ndarray, base: np.ndarray, length: int, q: int, buckets: int, hot: np.ndarray, level: int) -> Iterator[pa.RecordBatch]:
    """Sorted, front-coded runs of some texts' suffixes by bucket; a text starts ``base`` bytes into its document.

    An entry has (doc, tie, place of its anchor, bytes to the left of it, shared, tail);
    the data hold all tails, then all left sides. Of entries with equal bytes one is sent;
    all of their windows are repeats, and are put down as spans: entries with shared < 0,
    from place to left.
    """
    at, n, anchor, gram = _anchors(buf, offsets, length, q, hot, level)
    if not len(at):
        return
    raw = buf.tobytes()
    row = np.searchsorted(offsets, at, "right") - 1
    doc, tie, base = docs[row], ties[row], base[row]
    place, left = base + anchor - offsets[row], anchor - at
    bucket = (mix(gram.astype(np.uint64), 9) % np.uint64(buckets)).astype(np.int64)
    ends = at + n + length - 1
    seen: dict[tuple[bytes, int], int] = {}
    sent, again = np.ones(len(at), dtype=bool), np.zeros(len(at), dtype=bool)
    for i, (a, b, c) in enumerate(zip(at.tolist(), ends.tolist(), left.tolist(), strict=True)):
        j = seen.setdefault((raw[a:b], c), i)
        if j != i:
            sent[i] = False
            again[i] = again[j] = True
    del seen
    order = np.flatnonzero(sent)
    right = [raw[a:b] for a, b in zip(anchor[order].tolist(), ends[order].tolist(), strict=True)]
    own = bucket[order].tolist()
    by = sorted(range(len(right)), key=lambda i: (own[i], right[i]))
    out = []
    for b, group in groupby(by, key=lambda i: own[i]):
        g = list(group)
        shared, tails = front_coded([right[i] for i in g])
        i = order[g]
        sides = [raw[x:y] for x, y in zip(at[i].tolist(), anchor[i].tolist(), strict=True)]
        out.append((b, _pack([doc[i], tie[i], place[i], left[i], shared, list(map(len, tails))], b"".join(tails) + b"".join(sides))))
    if again.any():
        i = np.flatnonzero(again)
        s = base[i] + at[i] - offsets[row[i]]
        out.append((int(bucket[i[0]]), _pack([doc[i], tie[i], s, s + n[i] + length - 1, np.full(len(i), -1), np.zeros(len(i))], b"")))
    yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int32()), pa.array([r for _, r in out], pa.binary())], names=["bucket", "run"])


class PrefixLoserTree:
    """Merge sorted runs of (shared with the one before, suffix, value) without comparing known prefixes twice.

    Each run's head keeps the length it shares with the last winner that it was compared
    with on its path. Of two heads, the one that shares more with the same winner comes
    first; only where both share as much are bytes compared, from there on.
    """

    def __init__(self, runs: list[Iterator[tuple[int, bytes, int]]]):
        self.runs = runs
        self.k = max(1, len(runs))
        self.head = [next(r, None) for r in runs] or [None]
        #: shared with the last winner; the first winner is the empty string
        self.shared = [0] * self.k
        self.losers = [-1] * self.k
        for run in range(self.k):
            self._play(run)

    def _play(self, run: int) -> None:
        head, shared, losers = self.head, self.shared, self.losers
        node = (run + self.k) // 2
        while node > 0:
            other = losers[node]
            if other < 0:
                losers[node] = run
                return
            a, b = head[run], head[other]
            if b is not None:
                if a is None or shared[other] > shared[run]:
                    losers[node], run = run, other
                elif shared[other] == shared[run]:
                    x, y = a[1], b[1]
                    n = shared_prefix(x, y, shared[run])
                    # the loser now shares n bytes with the winner, which will be the last winner when it plays again
                    if n == len(y) and n < len(x) or n < len(y) and n < len(x) and y[n] < x[n] or x == y and other < run:
                        losers[node], run, other = run, other, run
                    shared[other] = n
                # a loser that shares less than the winner with the last one shares as much with the winner
            node //= 2
        losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, bytes, int]]:
        """(shared with the suffix before, suffix, value) in order."""
        while (top := self.head[run := self.losers[0]]) is not None:
            yield self.shared[run], top[1], top[2]
            self.head[run] = next(self.runs[run], None)
            # within its run, the next one knows what it shares with the winner just given out
            self.shared[run] = self.head[run][0] if self.head[run] is not None else 0
            self._play(run)


def _decoded(shared: list[int], tails: list[int], data: bytes, base: int) -> Iterator[tuple[int, bytes, int]]:
    last, at = b"", 0
    for i, (n, t) in enumerate(zip(shared, tails, strict=True)):
        last = last[:n] + data[at : at + t]
        at += t
        yield n, last, base + i


def repeated_offsets(right: list[bytes], shared: np.ndarray, left: list[bytes], length: int, q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(entry, first offset, last offset) of the windows that other entries hold too.

    ``right`` are the sorted suffixes, shared[i] what i shares with i - 1, ``left`` the bytes
    before each anchor. A window has ``o`` bytes before its anchor. Two are equal if the
    suffixes share length - o bytes to the right and o bytes to the left.
    """
    m = len(right)
    group = np.cumsum(shared < q)
    size = np.bincount(group)
    often = size[group] > 1
    pick = np.flatnonzero(often)
    if not len(pick):
        return (np.zeros(0, np.int64),) * 3
    back = [left[i][::-1] for i in pick.tolist()]
    of = group[pick].tolist()
    order = sorted(range(len(pick)), key=lambda i: (of[i], back[i]))
    left_shared = np.zeros(len(pick), dtype=np.int64)
    for j in range(1, len(order)):
        a, b = order[j - 1], order[j]
        left_shared[j] = shared_prefix(back[a], back[b]) if of[a] == of[b] else -1
    order = np.array(order)
    rank = np.empty(len(pick), dtype=np.int64)
    rank[order] = np.arange(len(pick))
    n_left = np.array([len(left[i]) for i in pick.tolist()])
    n_right = np.array([len(right[i]) for i in pick.tolist()])
    right_shared = np.where(np.arange(m) == 0, -1, shared)
    # what a picked entry shares with the picked one before: the least on the way between them
    cuts = np.minimum.reduceat(right_shared[: pick[-1] + 1], np.append(0, pick[:-1] + 1))
    hit = np.zeros((len(pick), length - q + 1), dtype=bool)
    for o in range(length - q + 1):
        own = np.flatnonzero((n_left >= o) & (n_right >= length - o))
        if len(own) < 2:
            continue
        key = np.cumsum(cuts < length - o)[own] * (len(pick) + 1) + np.cumsum(left_shared < o)[rank[own]]
        by = np.argsort(key)
        same = key[by][1:] == key[by][:-1]
        hit[own[by[1:][same]], o] = True
        hit[own[by[:-1][same]], o] = True
    edge = np.diff(np.pad(hit, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    entry, first = np.nonzero(edge == 1)
    return pick[entry], first, np.nonzero(edge == -1)[1] - 1


def _fresh(
    doc: np.ndarray, tie: np.ndarray, place: np.ndarray, n_left: np.ndarray, shared: np.ndarray, tails: np.ndarray, data: bytes, seen: dict, base: int
) -> tuple[list[tuple[int, bytes, int]], list[bytes], np.ndarray, np.ndarray]:
    """A packed run without the entries whose bytes ``seen`` has: (run, left sides, numbers of its entries, spans of the copies).

    All windows of an entry and its copy are repeats, so both are put down as spans at once,
    and only the first is kept to be met by others.
    """
    ends = (int(tails.sum()) + np.cumsum(n_left, dtype=np.int64)).tolist()
    run, sides, fresh, copies, common = [], [], [], [], None
    for i, (n, suffix, _) in enumerate(_decoded(shared.tolist(), tails.tolist(), data, 0)):
        side = data[ends[i] - int(n_left[i]) : ends[i]]
        cover = (int(doc[i]), int(tie[i]), int(place[i] - n_left[i]), int(place[i]) + len(suffix))
        common = n if common is None else min(common, n)  # with the last entry that is kept
        if (side, suffix) in seen:
            first = seen[side, suffix]
            seen[side, suffix] = None
            copies += [cover] if first is None else [first, cover]
            continue
        seen[side, suffix] = cover
        run.append((common, suffix, base + len(run)))
        sides.append(side)
        fresh.append(i)
        common = None
    return run, sides, np.array(fresh, dtype=np.int64), np.array(copies, dtype=np.int64).reshape(-1, 4)


def _merge(batches: Iterator[pa.RecordBatch], length: int, q: int, most: int | None, fan_in: int = 256) -> Iterator[pa.RecordBatch]:
    """Spans of repeated windows, bucket by bucket, as FOUND; a bucket of more than ``most`` bytes comes out to be dealt again."""

    def rows() -> Iterator[tuple[int, bytes]]:
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)

    for _, own in groupby(rows(), key=lambda r: r[0]):
        columns: list[list[np.ndarray]] = []
        left: list[bytes] = []
        runs: list[Iterator[tuple[int, bytes, int]]] = []
        held: list[bytes] = []
        #: (bytes to the left, suffix): what the first entry of its kind covers, until that is told
        seen: dict[tuple[bytes, bytes], tuple[int, int, int, int] | None] = {}
        size = packed_size = 0
        for _, packed in own:
            (doc, tie, place, n_left, shared, tails), data = _unpack(packed)
            if len(shared) and shared[0] < 0:
                yield span_batch(doc, tie, place, n_left)
                continue
            if size < 0:
                yield again_batch([packed])
                continue
            if most is not None:
                held.append(packed)
                packed_size += len(packed)
            run, sides, fresh, copies = _fresh(doc, tie, place, n_left, shared, tails, data, seen, len(left))
            if len(copies):
                yield span_batch(*copies.T)
            if len(run):
                runs.append(iter(run))
                left += sides
                columns.append([doc[fresh], tie[fresh], place[fresh]])
            size += sum(len(x) for _, x, _ in run) + sum(map(len, sides)) + 300 * len(run)
            if most is not None and max(size, packed_size) > most:
                for run in held:
                    yield again_batch([run])
                columns, left, runs, held, seen, size = [], [], [], [], {}, -1
        del held, seen
        if not columns:
            continue
        while len(runs) > fan_in:
            runs = [iter(list(PrefixLoserTree(runs[i : i + fan_in]))) for i in range(0, len(runs), fan_in)]
        merged = list(PrefixLoserTree(runs))
        value = np.array([v for _, _, v in merged])
        entry, first, last = repeated_offsets([s for _, s, _ in merged], np.array([n for n, _, _ in merged]), [left[v] for v in value.tolist()], length, q)
        doc, tie, place = (np.concatenate([c[i] for c in columns])[value[entry]] for i in range(3))
        yield span_batch(doc, tie, place - last, place - first + length)
        del merged, left, runs, columns
        release_memory()


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for piece in pieces(batches, "text"):
        buf, offsets = column_bytes(piece.column(1))
        gone = covered(len(buf), offsets[:-1], piece.column(2), piece.column(3))
        sums = np.concatenate([[0], np.cumsum(gone)])
        removed = np.diff(sums[offsets])
        first = gone.copy()
        first[1:] &= ~gone[:-1]
        starts = offsets[:-1][offsets[:-1] < len(buf)]
        first[starts] = gone[starts]
        spans = np.diff(np.concatenate([[0], np.cumsum(first)])[offsets])
        raw = buf[~gone].tobytes()
        cut = (offsets - sums[offsets]).tolist()
        kept = pa.array([raw[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([piece.column(0), kept, pa.array(np.diff(offsets)), pa.array(removed), pa.array(spans)], names=["doc", "kept", "n_bytes", "n_removed", "n_spans"])


def repeated_strings(docs: DataFrame, length: int = 200, q: int = 16, memory: int = 96 << 20) -> DataFrame:
    """(doc, tie, s, e): byte ranges of keyed() documents covered by a string of ``length`` bytes that also starts elsewhere.

    ``memory`` bounds the bytes of a bucket's different entries in a task, but for what is left after
    all levels; copies of one entry are not held.
    """
    spark, q = docs.sparkSession, min(q, length)
    n = parts(spark, 3.2 * text_bytes(docs))
    often = heavy(docs.select("doc", "text").mapInArrow(lambda b: _frequent(b, length, q), "key long, n long"))
    hot = np.array(sorted(x for x in often if x >= 0), dtype=np.uint64)
    sent, spans, level = docs.mapInArrow(lambda b, k=4 * n: _send(b, length, q, k, hot), RUNS), None, 0
    while True:
        most = memory if level <= LEVELS else None
        merged = sent.repartition(n, "bucket").sortWithinPartitions("bucket").mapInArrow(lambda b, most=most: _merge(b, length, q, most), FOUND)
        found, rest, size = spans_and_rest(merged, f"repeated-strings-{level}")
        spans = found if spans is None else spans.unionByName(found)
        if not size:
            return spans
        level += 1
        n = parts(spark, 4 * size if level <= LEVELS else 2 * length * size)
        sent = rest.mapInArrow(lambda b, k=4 * n, level=level: _send_again(b, length, q, k, level), RUNS)


def drop_repeated_strings(df: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, kept, n_bytes, n_removed, n_spans): each row's UTF-8 bytes without repeated strings.

    A byte goes if a string of ``length`` bytes that covers it starts anywhere else too, in
    the same or another document; overlaps count, and all copies go. ``kept`` is binary,
    as a cut may fall inside a character; ``n_spans`` counts the maximal removed runs.

    Null, empty or short texts lose nothing. Rows that repeat an id and a text are copies
    of one another: all they share goes. Null doc_id is an id like others. Empty table: no rows. Other columns
    are ignored.
    """
    docs = keyed(df)
    return with_spans(docs, repeated_strings(docs, length)).mapInArrow(_keep, KEPT).select(F.nullif("doc", F.lit(NO_ID)).alias("doc_id"), "kept", "n_bytes", "n_removed", "n_spans")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = drop_repeated_strings(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
