"""Operator 10: hierarchical multi-length packing of token sequences.

Documents are routed to context-size tiers, each tier's windows are packed, gaps of
long windows are filled from the same or shorter tiers, and the finished windows are
dealt to step groups of even cost. All of it happens inside the partitions of the
input, so nothing is shuffled; a task holds at most ``buffer`` unfinished documents.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._bpe import encoder
from tastemill.llm._text import pieces, release_memory

TIERS = (256, 512, 1024, 2048)
PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tier int, step_group long"


class Packer:
    """Packs the documents of one partition; pieces come out as (doc, start, ids, ...)."""

    def __init__(self, tiers: tuple[int, ...], step_tokens: int, buffer: int, first_id: int):
        self.tiers, self.window = tiers, tiers[-1]
        self.per_step, self.buffer = max(1, step_tokens // self.window), buffer
        self.next_sequence = self.next_group = first_id
        #: by tier: sorted (length, number) and the piece of each number
        self.waiting: list[list[tuple[int, int]]] = [[] for _ in tiers]
        self.piece: dict[int, tuple] = {}
        self.number = 0
        self.finished: list[list[tuple]] = []
        self.out: list[tuple] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        n = len(ids)
        full = n - n % self.window
        for at in range(0, full, self.window):
            self.finished.append([(doc, at, ids[at : at + self.window], n)])
        if full < n:
            self._wait((doc, full, ids[full:].copy(), n))
        if len(self.piece) >= self.buffer or len(self.finished) >= self.buffer:
            self._pack(last=False)

    def close(self) -> None:
        self._pack(last=True)

    def _wait(self, piece: tuple) -> None:
        tier = bisect.bisect_left(self.tiers, len(piece[2]))
        bisect.insort(self.waiting[tier], (len(piece[2]), self.number))
        self.piece[self.number] = piece
        self.number += 1

    def _take(self, tier: int, at: int) -> tuple:
        return self.piece.pop(self.waiting[tier].pop(at)[1])

    def _pack(self, last: bool) -> None:
        for tier in range(len(self.tiers) - 1, -1, -1):
            while self.waiting[tier]:
                window, room = [], self.tiers[tier]
                self._put(window, self._take(tier, -1))
                room -= len(window[0][2])
                while room and (filler := self._filler(tier, room)) is not None:
                    self._put(window, filler)
                    room -= len(filler[2])
                if not room:
                    self.finished.append(window)
                elif not last:  # the next documents fill it
                    for piece in window:
                        self._wait(piece)
                    self._deal()
                    return
                else:
                    self._split(window)
        self._deal()

    @staticmethod
    def _put(window: list[tuple], piece: tuple) -> None:
        window.append(piece)

    def _filler(self, tier: int, room: int) -> tuple | None:
        """The longest waiting piece that fits, of this tier or shorter; else a cut of the shortest one."""
        for t in range(tier, -1, -1):
            at = bisect.bisect_right(self.waiting[t], (room, self.number))
            if at:
                return self._take(t, at - 1)
        for t in range(tier + 1):
            if self.waiting[t]:
                doc, start, ids, n = self._take(t, 0)
                self._wait((doc, start + room, ids[room:], n))
                return doc, start, ids[:room], n
        return None

    def _split(self, window: list[tuple]) -> None:
        """A last unfilled window becomes windows whose lengths are powers of two."""
        left = sum(len(p[2]) for p in window)
        while left:
            size = 1 << (left.bit_length() - 1)
            own, room = [], size
            while room:
                doc, start, ids, n = window[0]
                own.append((doc, start, ids[:room], n))
                if len(ids) > room:
                    window[0] = (doc, start + room, ids[room:], n)
                else:
                    window.pop(0)
                room -= len(own[-1][2])
            self.finished.append(own)
            left -= size

    def _deal(self) -> None:
        """Finished windows go round the step groups, the longest first, so groups cost the same."""
        self.finished.sort(key=lambda w: -sum(len(p[2]) for p in w))
        tokens = sum(len(p[2]) for w in self.finished for p in w)
        groups = max(1, round(tokens / (self.per_step * self.window)))
        for i, window in enumerate(self.finished):
            turn, at = divmod(i, groups)
            group = self.next_group + (at if turn % 2 == 0 else groups - 1 - at)
            size, offset = sum(len(p[2]) for p in window), 0
            for doc, start, ids, n in window:
                self.out.append((doc, start, len(ids), ids.astype("<u4").tobytes(), n, self.next_sequence, offset, size, group))
                offset += len(ids)
            self.next_sequence += 1
        self.next_group += groups if self.finished else 0
        self.finished = []


def pack(df: DataFrame, tokenizer_json: str, end_id: int = 1, tiers: tuple[int, ...] = TIERS, step_tokens: int = 16 * 2048, buffer: int = 4096) -> DataFrame:
    """Token pieces of (doc_id, text) packed into sequences without padding.

    Each text's ids, followed by ``end_id``, are cut so that every id lies in exactly
    one piece. Every sequence is full (the length of a tier, all powers of two); what
    is left at the end of a partition is closed at smaller powers of two. One row per
    piece: doc_id, start (ids of its document before it), length, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id, offset (in its sequence), tier (the
    sequence's length) and step_group. ``step_tokens`` is the aim for a step group.

    Null or empty text: the end id alone. Null doc_id: packed, with null doc_id. Rows
    repeated or with equal ids are packed once each. Empty table: no rows. Other
    columns are ignored. Ids depend on how the input is partitioned, and on nothing else.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be increasing powers of two")
    spec = df.sparkSession.sparkContext.broadcast(tokenizer_json)  # a vocabulary: a few MB whatever the input

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = encoder(spec.value)
        packer = Packer(tiers, step_tokens, buffer, TaskContext.get().partitionId() << 32)
        for piece in pieces(batches, "text", 2 << 20):
            ids, offsets = ids_of.encode(piece.column(1))
            for i, doc in enumerate(piece.column(0).to_pylist()):
                packer.add(doc, np.append(ids[offsets[i] : offsets[i + 1]], np.int32(end_id)))
                if len(packer.out) >= 20_000:
                    yield flush(packer)
        packer.close()
        yield flush(packer)
        ids_of.forget()
        release_memory()

    def flush(packer: Packer) -> pa.RecordBatch:
        rows, packer.out = packer.out, []
        types = [pa.int64()] * 3 + [pa.binary()] + [pa.int64()] * 3 + [pa.int32(), pa.int64()]
        names = [x.split()[0] for x in PIECES.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=names)

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, PIECES)


def tokenizer_text(path: str | None = None) -> str:
    """The JSON of the public byte-level vocabulary, or of the file at ``path``; read on the driver."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.json")
    with open(path, encoding="utf-8") as f:
        return f.read()


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return digest(pack(docs, tokenizer_text()))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier", "step_group")
