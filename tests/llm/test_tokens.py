import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import documents

from tastemill.llm import packing, token_counts
from tastemill.llm._bpe import Encoder, vocabulary


@pytest.fixture(scope="module")
def spec():
    return packing.tokenizer_text()


def greedy(vocab, word):
    n, at = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in vocab), None)
        if end is None:
            return 1
        n, at = n + 1, end
    return n


TEXTS = ["", " ", "it's we'll they're 's 'tis x''s\n's 'sa", "a  b\n\n c\t d  ", "日本語 é １２", "'re'r", "x" * 5000, "don't <|endoftext|> stop", "ab" * 300 + " c"]


def test_ids_equal_the_tokenizer(spec):
    from tokenizers import Tokenizer

    own, tokenizer = Encoder(spec), Tokenizer.from_str(spec)
    for texts in [TEXTS, *([t] for t in TEXTS)]:
        ids, offsets = own.encode(pa.array(texts))
        assert [ids[a:b].tolist() for a, b in zip(offsets[:-1], offsets[1:], strict=True)] == [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_automaton_equals_greedy_search(spec):
    rng = random.Random(1)
    vocab = {bytes(rng.choice(b"abc") for _ in range(rng.randint(1, 5))) for _ in range(60)} | {b"a", b"b"}
    words = [bytes(rng.choice(b"abcd") for _ in range(rng.randint(1, 30))) for _ in range(500)]
    own = token_counts.Automaton(iter(sorted(vocab)))
    buf = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    assert own.counts(buf, ends - [len(w) for w in words], ends).tolist() == [greedy(vocab, w) for w in words]


def test_continuation_pieces():
    own = token_counts.Automaton(iter([b"un", b"##aff", b"##able", b"##a", b"a"]), follow=b"##")
    words = [b"unaffable", b"un", b"una", b"aff", b"ab", b"able", b"unx"]
    ends = np.cumsum([len(w) for w in words])
    assert own.counts(np.frombuffer(b"".join(words), np.uint8), ends - [len(w) for w in words], ends).tolist() == [3, 1, 2, 1, 1, 1, 1]


def test_counts_of_a_table(spark, spec):
    vocab = vocabulary(spec)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "x y"), (7, None), (7, None)]
    out = token_counts.token_counts(documents(spark, rows), token_counts.Automaton(iter(vocab), start=b" ")).collect()
    want = sorted((str(i), len((t or "").encode()), sum(greedy(vocab, b" " + w) for w in (t or "").encode().split())) for i, t in rows)
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens) for r in out) == want
    assert token_counts.token_counts(documents(spark, []), token_counts.Automaton(iter([b"a"]))).count() == 0


@pytest.mark.parametrize("size", [1, 40, 3000])
def test_packing_round_trip(spark, spec, size):
    from tokenizers import Tokenizer

    rng = random.Random(size)
    tokenizer = Tokenizer.from_str(spec)
    rows = [(i, " ".join(rng.choice(["alpha", "béta", "gamma.", "x1"]) for _ in range(rng.choice([0, 3, 50, 700, size])))) for i in range(120)] + [(500, None), (501, "")]
    out = packing.pack(documents(spark, rows).repartition(3), spec, step_tokens=8192, buffer=16).collect()
    assert packing.pack(documents(spark, []), spec).count() == 0
    got, sequences = {}, {}
    for r in out:
        got.setdefault(r.doc_id, []).append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length, r.tier))
    for i, text in rows:
        want = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        at = 0
        for start, ids, n, length in sorted(got[i]):
            assert (start, n, length) == (at, len(want), len(ids)) and length > 0
            assert ids == want[at : at + length]
            at += length
        assert at == len(want)
    for parts in sequences.values():
        at = 0
        for offset, length, _ in sorted(parts):
            assert offset == at
            at += length
        assert at == parts[0][2] <= 2048 and at & (at - 1) == 0


def test_digest(spark, spec):
    r = packing.digest(packing.pack(documents(spark, [(1, "a b")]), spec)).where("length > 1").first()
    ids = Encoder(spec).encode(pa.array(["a b"]))[0].tolist() + [1]
    assert r.ids_crc32 == zlib.crc32(np.array(ids[: r.length], "<u4").tobytes())
