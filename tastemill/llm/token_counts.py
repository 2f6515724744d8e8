"""Operator 1: greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie with a failure link at every node. Where a node has no child
for the next byte, its link leads to the node that is reached after the longest piece
has been cut off, and a number stored with the link says how many pieces were cut.
A word is thus read once, byte by byte, and no piece is ever built. The automaton is
held in NumPy arrays; all words of a piece of the input advance together, one byte a
step.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.llm._bpe import vocabulary
from tastemill.llm._text import Words, pieces
from tastemill.llm.packing import tokenizer_text

COUNTS = "doc_id long, n_words long, n_bytes long, n_tokens long"


class Automaton:
    """``start`` stands before each word; a word that the vocabulary can't cover counts one (unknown) piece."""

    def __init__(self, words: Iterator[bytes], start: bytes = b"", follow: bytes = b""):
        """``start``: written before every word. ``follow``: marks pieces that don't begin a word (``##``)."""
        children: list[dict[int, int]] = [{}, {}] if follow else [{}]
        final = [False] * len(children)
        roots = {True: 0, False: 1 if follow else 0}
        for w in words:
            first = not (follow and w.startswith(follow) and len(w) > len(follow))
            node = roots[first]
            for byte in w if first else w[len(follow) :]:
                if byte not in children[node]:
                    children[node][byte] = len(children)
                    children.append({})
                    final.append(False)
                node = children[node][byte]
            final[node] = node not in roots.values()
        n, root = len(children), roots[False]
        fail, popped = np.full(n, -1, dtype=np.int32), np.zeros(n, dtype=np.int32)
        queue = deque((child, byte, parent) for parent in dict.fromkeys(roots.values()) for byte, child in children[parent].items())
        while queue:
            node, byte, parent = queue.popleft()
            queue.extend((child, b, node) for b, child in children[node].items())
            if final[node]:
                fail[node], popped[node] = root, 1
                continue
            at, cut = fail[parent], popped[parent]
            while at >= 0 and byte not in children[at]:
                cut += popped[at]
                at = fail[at]
            if at >= 0:
                fail[node], popped[node] = children[at][byte], cut
        self.fail, self.popped, self.root, self.head = fail, popped, root, roots[True]
        self._fill(children)
        self.start = start
        state, count = self._step_through(start, self.head)
        self.start_state, self.start_count = state, count

    def _fill(self, children: list[dict[int, int]]) -> None:
        """Rows of children laid over one another in one array (base + byte, with the owner to check)."""
        n = len(children)
        base = np.zeros(n, dtype=np.int32)
        size = 1024 + 2 * sum(map(len, children))
        owner = np.full(size, -1, dtype=np.int32)
        target = np.zeros(size, dtype=np.int32)

        def grown(least: int) -> None:
            nonlocal owner, target
            if least > len(owner):
                more = max(least - len(owner), len(owner))
                owner, target = np.concatenate([owner, np.full(more, -1, np.int32)]), np.concatenate([target, np.zeros(more, np.int32)])

        low, block = 0, np.arange(2048)
        for node in sorted((i for i in range(n) if len(children[i]) > 1), key=lambda i: -len(children[i])):
            codes = np.fromiter(children[node], dtype=np.int64)
            at = low
            while True:
                grown(at + len(block) + 256)
                fits = (owner[at + block[:, None] + codes] < 0).all(axis=1)
                if fits.any():
                    at += int(fits.argmax())
                    break
                at += len(block)
            low = max(low, at - 2 * len(block))
            base[node] = at
            owner[at + codes] = node
            target[at + codes] = list(children[node].values())
        lone = [i for i in range(n) if len(children[i]) == 1]
        grown(len(owner) + len(lone) + 256)
        free = 256 + np.flatnonzero(owner[256:] < 0)[: len(lone)]
        owner[free] = lone
        target[free] = [next(iter(children[i].values())) for i in lone]
        base[lone] = free - [next(iter(children[i])) for i in lone]
        grown(int(base.max()) + 256)
        self.base, self.owner, self.target = base, owner, target

    def _step_through(self, data: bytes, state: int, count: int = 0) -> tuple[int, int]:
        for byte in data:
            while state >= 0 and self.owner[at := self.base[state] + byte] != state:
                count, state = count + int(self.popped[state]), int(self.fail[state])
            if state < 0:
                return -1, count
            state = int(self.target[at])
        return state, count

    def counts(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces of each word buf[start:end]."""
        n = len(starts)
        out = np.full(n, self.start_count, dtype=np.int64)
        state = np.full(n, self.start_state, dtype=np.int32)
        order = np.argsort(starts - ends, kind="stable")  # the longest first
        lengths = (ends - starts)[order]
        active, step = n, 0
        s, first, total = state[order], starts[order], out[order]
        while True:
            active = int(np.searchsorted(-lengths[:active], -step, "left"))
            if active == 0:
                break
            if active <= 8:  # very long words end one by one
                for i in range(active):
                    if s[i] >= 0:
                        s[i], total[i] = self._step_through(buf[first[i] + step : first[i] + lengths[i]].tobytes(), int(s[i]), int(total[i]))
                break
            byte = buf[first[:active] + step].astype(np.int32)
            own = s[:active]
            at = self.base[own] + byte
            bad = np.flatnonzero((self.owner[at] != own) & (own >= 0))
            while len(bad):
                total[bad] += self.popped[own[bad]]
                own[bad] = self.fail[own[bad]]
                bad = bad[own[bad] >= 0]
                at[bad] = self.base[own[bad]] + byte[bad]
                bad = bad[self.owner[at[bad]] != own[bad]]
            s[:active] = np.where(own >= 0, self.target[at], -1)
            step += 1
        while True:  # what is still held at the word's end
            held = np.flatnonzero((s >= 0) & (s != self.root) & (s != self.head))
            if not len(held):
                break
            total[held] += self.popped[s[held]]
            s[held] = self.fail[s[held]]
        out[order] = np.where(s < 0, 1, total)
        return out


def token_counts(df: DataFrame, automaton: Automaton) -> DataFrame:
    """(doc_id, n_words, n_bytes, n_tokens) of each row's whole text.

    Words are runs of bytes other than space and 0x09-0x0D; n_tokens sums the greedy
    longest-match pieces of every word. Null or empty text: zeros. Null doc_id, repeated
    rows: counted row by row. Empty table: no rows. Other columns are ignored.
    """
    shared = df.sparkSession.sparkContext.broadcast(automaton)  # fixed by the vocabulary

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for piece in pieces(batches, "text"):
            words = Words(piece.column(1))
            each = own.counts(words.buf, words.starts, words.ends)
            total = np.concatenate([[0], np.cumsum(each)])[words.row_words]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(words.counts), pa.array(np.diff(words.offsets)), pa.array(np.diff(total))], names=["doc_id", "n_words", "n_bytes", "n_tokens"])

    return df.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(task, COUNTS)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return token_counts(docs, Automaton(iter(vocabulary(tokenizer_text())), start=b" "))
