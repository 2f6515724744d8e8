"""Byte-pair token ids of whole text columns.

Ids equal those of the public tokenizer file. Word splitting runs as array
operations over code points; each distinct split is encoded once per Python
worker and remembered in a bounded table.
"""

from __future__ import annotations

import json
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa

from tastemill.llm._text import column_bytes, eights, equal_spans, span_hashes

_SPACE, _LETTER, _NUMBER, _OTHER = 0, 1, 2, 3
# Unicode White_Space, and the English endings that split at an apostrophe.
_WHITE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    kinds = {"L": _LETTER, "N": _NUMBER}
    table = np.fromiter((kinds.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    table[_WHITE] = _SPACE
    return table


def split_starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where splits start in the code points of several texts (offsets: n + 1 values).

    A split is an apostrophe ending, a run of letters, numbers or other signs with
    at most one leading space, or white space; white space before a word leaves its
    last character to the word.
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = _classes()[points]
    text_start = np.zeros(n + 1, dtype=bool)
    text_start[offsets] = True
    start = np.ones(n + 1, dtype=bool)
    start[1:n] = (kind[1:] != kind[:-1]) | text_start[1:n]
    runs = np.flatnonzero(start)
    begin, end = runs[:-1], runs[1:]
    inner = (kind[begin] == _SPACE) & ~text_start[end]
    tail = end[inner]
    start[tail - 1] = True
    start[tail[points[tail - 1] == 0x20]] = False
    single = begin[(end - begin == 1) & (points[begin] == 0x27)]
    single = single[start[single] & (single + 1 < n)]
    for ending in _ENDINGS:
        at = single[single + len(ending) < n]
        hit = np.ones(len(at), dtype=bool)
        for j, c in enumerate(ending, 1):
            hit &= (points[at + j] == ord(c)) & ~text_start[at + j]
        at = at[hit]
        start[at + 1] = False
        start[at + len(ending) + 1] = True
    return np.flatnonzero(start[:n])


class Encoder:
    """Ids of many texts at once; ``special`` strings are encoded as their own ids."""

    SLOTS = 1 << 20

    def __init__(self, tokenizer_json: str):
        import tiktoken

        spec = json.loads(tokenizer_json)
        letters = _byte_letters()
        self.ranks = {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if all(c in letters for c in k)}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        for text in self.special:
            self.ranks.pop(text.encode(), None)
        self.core = tiktoken.Encoding("own", pat_str=r"\S+|\s+", mergeable_ranks=self.ranks, special_tokens={})._core_bpe
        self.json = tokenizer_json
        self._reset()

    def _reset(self) -> None:
        self.key = np.zeros(self.SLOTS, dtype=np.uint64)
        self.entry = np.full(self.SLOTS, -1, dtype=np.int32)
        self.first, self.count, self.flat = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        #: the bytes of all entries, and where each starts; n + 1 values
        self.bytes, self.edge = np.zeros(0, np.uint8), np.zeros(1, np.int64)
        self.view = eights(self.bytes)

    def forget(self) -> None:
        """Empty the table after a task; the vocabulary stays."""
        self._reset()

    def _find(self, hashed: np.ndarray, view: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Entry of each split, found by hash and equal bytes, or -1."""
        out = np.full(len(hashed), -1, dtype=np.int64)
        todo, slot = np.arange(len(hashed)), (hashed & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            entry = self.entry[slot]
            same = (entry >= 0) & (self.key[slot] == hashed[todo])
            at, own = np.flatnonzero(same), entry[same]
            same[at] = equal_spans(view, starts[todo[at]], ends[todo[at]], self.view, self.edge[own], self.edge[own + 1])
            out[todo[same]] = entry[same]
            on = (entry >= 0) & ~same
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)
        return out

    def _add(self, hashed: np.ndarray, pieces: list[bytes]) -> None:
        if len(self.first) + len(hashed) > self.SLOTS // 2:
            self._reset()
        ids = [self.core.encode_single_piece(p) for p in pieces]
        count = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        base, total = len(self.first), len(self.flat)
        self.first = np.concatenate([self.first, total + np.cumsum(count) - count])
        self.count = np.concatenate([self.count, count])
        self.flat = np.concatenate([self.flat, np.fromiter((x for p in ids for x in p), dtype=np.int32, count=int(count.sum()))])
        self.bytes = np.concatenate([self.bytes, np.frombuffer(b"".join(pieces), np.uint8)])
        self.edge = np.concatenate([self.edge, self.edge[-1] + np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))])
        self.view = eights(self.bytes)
        todo, slot = np.arange(len(hashed)), (hashed & np.uint64(self.SLOTS - 1)).astype(np.int64)
        while len(todo):
            free = self.entry[slot] < 0
            self.entry[slot[free]] = base + todo[free]
            self.key[slot[free]] = hashed[todo[free]]
            on = self.entry[slot] != base + todo  # taken before, or by another of these
            todo, slot = todo[on], (slot[on] + 1) & (self.SLOTS - 1)

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and n + 1 offsets of the rows; null is empty."""
        raw, byte_offsets = column_bytes(column)
        data = raw.tobytes()
        if any(s.encode() in data for s in self.special):
            return self._encode_plainly(column)
        try:
            text = data.decode()
        except UnicodeDecodeError:
            return self._encode_plainly(column)
        points = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        lead = np.flatnonzero((raw & 0xC0) != 0x80)
        chars = np.searchsorted(lead, byte_offsets)
        split = split_starts(points, chars)
        starts = lead[split]
        ends = np.append(starts[1:], len(raw))[: len(starts)]
        hashed, view = span_hashes(raw, starts, ends), eights(raw)
        entry = self._find(hashed, view, starts, ends)
        # splits with one hash are added one after another, as equal bytes decide
        while len(missing := np.flatnonzero(entry < 0)):
            fresh, at = np.unique(hashed[missing], return_index=True)
            at = missing[at]
            for lo in range(0, len(fresh), self.SLOTS // 4):
                part = slice(lo, lo + self.SLOTS // 4)
                before = len(self.first)
                self._add(fresh[part], [data[a:b] for a, b in zip(starts[at[part]].tolist(), ends[at[part]].tolist(), strict=True)])
                if len(self.first) < before:  # the table was emptied
                    return self._encode_again(column) if column.nbytes and len(fresh) < self.SLOTS // 4 else self._encode_plainly(column)
            entry[missing] = self._find(hashed[missing], view, starts[missing], ends[missing])
        count = self.count[entry]
        done = np.zeros(len(count) + 1, dtype=np.int64)
        np.cumsum(count, out=done[1:])
        ids = self.flat[np.repeat(self.first[entry] - done[:-1], count) + np.arange(done[-1])]
        return ids, done[np.searchsorted(split, chars)]

    def _encode_again(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        self._reset()
        return self.encode(column)

    def _encode_plainly(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Through the tokenizers library, where a text holds a special token's string or broken UTF-8."""
        raw, at = column_bytes(column)
        texts = [raw[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        ids = [x.ids for x in _tokenizer(self.json).encode_batch(texts, add_special_tokens=False)]
        offsets = np.zeros(len(ids) + 1, dtype=np.int64)
        np.cumsum([len(x) for x in ids], out=offsets[1:])
        return np.fromiter((x for row in ids for x in row), dtype=np.int32, count=int(offsets[-1])), offsets


@lru_cache(maxsize=2)
def _tokenizer(tokenizer_json: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    return Tokenizer.from_str(tokenizer_json)


@lru_cache(maxsize=2)
def encoder(tokenizer_json: str) -> Encoder:
    return Encoder(tokenizer_json)


def _byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(tokenizer_json: str) -> dict[bytes, int]:
    """Byte strings of a byte-level vocabulary, without added tokens."""
    spec = json.loads(tokenizer_json)
    letters, added = _byte_letters(), {x["content"] for x in spec.get("added_tokens", [])}
    return {bytes(letters[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added and all(c in letters for c in k)}


