"""Operators 2, 3, 6 and 9 against brute force, with nulls, ties and repeated rows."""

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from tests.llm.conftest import documents

from tastemill.llm import exact_dedup, ngram_join, substring_dedup, suffix_dedup

SEP = r"[\x20\x09-\x0D]"


def corpus(seed, n=60, words=12):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(words)] + ["É", "X", "日本"]
    base = [rng.choice(vocab) for _ in range(150)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.3:
            a = rng.randint(0, 120)
            w = base[a : a + rng.randint(0, 60)] + [rng.choice(vocab) for _ in range(rng.randint(0, 10))]
        elif kind < 0.5 and rows:
            w = (rng.choice(rows)[1] or "").split()
            if w and rng.random() < 0.7:
                w[rng.randrange(len(w))] = "changed"
        else:
            w = [rng.choice(vocab) for _ in range(rng.randint(0, 40))]
        rows.append((i, rng.choice([" ", "  ", "\n"]).join(w)))
    return [*rows, (900, None), (901, ""), (902, " \t "), (None, rows[0][1]), (5, rows[5][1]), (6, "another text of six")]


def low(i):
    return -(2**63) if i is None else i


@pytest.mark.parametrize("memory", [100, 48 << 20])
def test_exact_groups(spark, memory):
    rows = corpus(1)
    out = exact_dedup.exact_groups(documents(spark, rows).repartition(3), memory).collect()
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(SEP, "", t or ""), []).append((-len(t or ""), low(i)))
    want = sorted((low(i), min(groups[n])[1], len(groups[n]), hashlib.sha256(n.encode()).hexdigest()) for i, t in rows for n in [re.sub(SEP, "", t or "")])
    assert sorted((low(r.doc_id), low(r.keep_id), r.group_size, r.text_sha256) for r in out) == want
    assert sum(r.kept for r in out) == len(groups)
    kept = exact_dedup.drop_copies(documents(spark, rows))
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert kept.count() == len(groups)
    assert exact_dedup.exact_groups(documents(spark, [])).count() == 0


@pytest.mark.parametrize("memory", [50, 24 << 20])
def test_repeated_windows(spark, memory):
    rows = corpus(2)
    k = 6
    split = [(low(i), [w for w in re.split(SEP + "+", t or "") if w]) for i, t in rows]
    first, gone = {}, [set() for _ in rows]
    for i, w in split:
        for s in range(len(w) - k + 1):
            key = tuple(w[s : s + k])
            first[key] = min(first.get(key, (i, s)), (i, s))
    for r, (i, w) in enumerate(split):
        for s in range(len(w) - k + 1):
            if first[tuple(w[s : s + k])] < (i, s):
                gone[r].update(range(s, s + k))
    want = sorted((i, len(w), len(gone[r]), " ".join(x for p, x in enumerate(w) if p not in gone[r])) for r, (i, w) in enumerate(split))
    docs = substring_dedup.keyed(documents(spark, rows).repartition(3))
    spans = substring_dedup.repeated_windows(docs, k, 2, memory)
    got = substring_dedup.with_spans(docs, spans).mapInArrow(substring_dedup._keep, substring_dedup.KEPT).collect()
    assert sorted((r.doc, r.n_words, r.n_removed, r.text) for r in got) == want
    assert substring_dedup.drop_repeats(documents(spark, [])).count() == 0


def test_windows_that_share_a_hash(monkeypatch):
    import numpy as np

    from tastemill.llm._text import window_hashes

    monkeypatch.setattr(substring_dedup, "window_hashes", lambda v, k: window_hashes(v, k) % np.uint64(2))
    bucket = substring_dedup.Bucket(2)
    texts = [b"a b c", b"b c", b"x y z"]
    column = lambda *v: np.array(v)
    bucket.add([column(1, 2, 3), column(0, 0, 0), column(0, 0, 0), column(2, 1, 2), column(5, 3, 5)], b" ".join(texts))
    assert bucket.settle().to_pylist() == [{"again": False, "doc": 2, "tie": 0, "s": 0, "e": 2, "packed": None}]


@pytest.mark.parametrize("memory", [0, 900, 96 << 20])
def test_repeated_strings(spark, memory, monkeypatch):
    monkeypatch.setattr(suffix_dedup.repeated_strings, "__defaults__", (200, 16, memory))
    rows = corpus(3)
    length = 30
    raw = [(low(i), (t or "").encode()) for i, t in rows]
    seen = {}
    for _, t in raw:
        for s in range(len(t) - length + 1):
            seen[t[s : s + length]] = seen.get(t[s : s + length], 0) + 1
    want = []
    for i, t in raw:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if seen[t[s : s + length]] > 1:
                gone[s : s + length] = b"\1" * length
        want.append((i, bytes(b for b, g in zip(t, gone, strict=True) if not g), len(t), sum(gone), len(re.findall(b"\1+", bytes(gone)))))
    got = suffix_dedup.drop_repeated_strings(documents(spark, rows).repartition(3), length).collect()
    assert sorted((low(r.doc_id), bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in got) == sorted(want)
    assert suffix_dedup.drop_repeated_strings(documents(spark, [])).count() == 0


def test_prefix_loser_tree_merges_and_knows_shared_prefixes():
    rng = random.Random(4)
    for _ in range(100):
        runs = [sorted(bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 8))) for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 9))]
        coded = [(*suffix_dedup.front_coded(r), r) for r in runs]
        merged = list(suffix_dedup.PrefixLoserTree([suffix_dedup._decoded(s, list(map(len, t)), b"".join(t), 0) for s, t, _ in coded]))
        assert [m[1] for m in merged] == sorted(x for r in runs for x in r)
        assert all(b[0] == suffix_dedup.shared_prefix(a[1], b[1]) for a, b in zip(merged, merged[1:], strict=False))


def shingle_sets(rows, k):
    def shingles(t):
        w = re.split(SEP + "+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
        w = [x for x in w if x]
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()

    return [(low(i), shingles(t)) for i, t in rows]


def brute_components(rows, k, p, q):
    sets = shingle_sets(rows, k)
    root = {i: i for i, _ in sets}
    changed = True
    while changed:
        changed = False
        for i, a in sets:
            for j, b in sets:
                if a and b and q * len(a & b) >= p * len(a | b) and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    return sorted((i, len(s), root[i]) for i, s in sets)


@pytest.mark.parametrize(("k", "p", "q", "most"), [(3, 9, 10, 4096), (2, 7, 10, 4096), (2, 6, 10, 6)])
def test_similar_groups(spark, k, p, q, most):
    rows = corpus(5, n=80)
    got = ngram_join.similar_groups(documents(spark, rows).repartition(3), k, (p, q), most=most).collect()
    assert sorted((low(r.doc_id), r.n_shingles, low(r.component_id)) for r in got) == brute_components(rows, k, p, q)


@pytest.mark.parametrize(("k", "p", "q", "most"), [(3, 9, 10, 4096), (2, 7, 10, 4096), (2, 6, 10, 6)])
def test_link_counts(spark, k, p, q, most):
    rows = [*corpus(5, n=80), (5, "yet another text of five"), (2, "yet another text of five")]
    sets = shingle_sets(rows, k)
    want = sorted((i, len(a), sum(bool(x != y and a and b and q * len(a & b) >= p * len(a | b)) for y, (_, b) in enumerate(sets))) for x, (i, a) in enumerate(sets))
    got = ngram_join.link_counts(documents(spark, rows).repartition(3), k, (p, q), most=most).collect()
    assert sorted((low(r.doc_id), r.n_shingles, r.n_links) for r in got) == want


def test_similar_groups_of_an_empty_table(spark):
    assert ngram_join.similar_groups(documents(spark, [])).count() == 0
    assert ngram_join.link_counts(documents(spark, [])).count() == 0


def test_drop_similar_keeps_columns_and_one_of_each_group(spark):
    text = " ".join(f"word{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, "something else entirely"), (4, None), (5, None)]
    out = ngram_join.drop_similar(documents(spark, rows))
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r.doc_id for r in out.collect()) == [1, 3, 4, 5]


def test_hot_grams_of_either_top_bit_are_demoted():
    text = np.frombuffer(hashlib.sha512(b"grams").digest() * 2, np.uint8)
    offsets, length, q = np.array([0, len(text)]), 24, 8
    hashes = suffix_dedup._gram_hashes(text, q)
    assert len(set((hashes >> np.uint64(31)).tolist())) == 2
    for h in sorted(set(hashes.tolist())):
        low = h & ((1 << 31) - 1)
        _, _, anchor, gram = suffix_dedup._anchors(text, offsets, length, q, np.array([low], dtype=np.uint64))
        assert low not in gram.tolist() and h not in hashes[anchor].tolist()


@pytest.mark.parametrize("turned", [False, True])
def test_the_longest_original_of_one_id_stays(spark, turned):
    rows = [(1, "ab"), (1, "a  b"), (2, "a b"), (None, "x"), (None, " x "), (3, "y")]
    kept = exact_dedup.drop_copies(documents(spark, rows[::-1] if turned else rows).coalesce(1)).collect()
    assert sorted((low(r.doc_id), r.text) for r in kept) == [(low(None), " x "), (1, "a  b"), (3, "y")]


@pytest.mark.parametrize(("k", "share"), [(5, (8, 10)), (3, (9, 10))])
def test_unrelated_short_texts_share_no_key(spark, k, share):
    """Sets with few strong parts or empty ones are no candidates of sets that they share nothing with."""
    rng = random.Random(7)
    df = documents(spark, [(i, " ".join(f"{i}x{rng.random()}" for _ in range(9 if i % 2 else 12))) for i in range(20_000)])
    assert ngram_join._candidates(df.selectExpr("doc_id AS doc", "text"), k, share)[2].count() == 0


@pytest.mark.parametrize(("k", "share"), [(5, (8, 10)), (3, (9, 10)), (1, (5, 10))])
def test_short_sets_lose_no_link(spark, monkeypatch, k, share):
    """Small sets, many of them with empty parts, with and without very frequent shingles."""
    rng, rows = random.Random(11), []
    for i in range(150):
        words = [f"w{rng.randrange(30)}" for _ in range(rng.randint(k + 1, k + 14))]
        rows.append((10 * i, " ".join(words)))
        rows.append((10 * i + 1, " ".join([*words, "tail"])))
        rows.append((10 * i + 2, " ".join(words[1:])))
    sets = {i: {tuple(w[j : j + k]) for w in [t.split()] for j in range(len(w) - k + 1)} or {tuple(t.split())} for i, t in rows}
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and share[1] * len(sets[i] & sets[j]) >= share[0] * len(sets[i] | sets[j]) and label[i] != label[j]:
                a, b = label[i], label[j]
                label = {x: min(a, b) if v in (a, b) else v for x, v in label.items()}
    out = ngram_join.similar_groups(documents(spark, rows), k, share).collect()
    assert {r.doc_id: r.component_id for r in out} == label
    common = np.sort(np.array([h for t in ("w1", "w2", "tail") for h in ngram_join._sets(pa.array([t]), 1)[1]], dtype=np.uint64))
    monkeypatch.setattr(ngram_join, "_hot", lambda *a: common if k == 1 else np.zeros(0, np.uint64))
    out = ngram_join.similar_groups(documents(spark, rows), k, share).collect()
    assert {r.doc_id: r.component_id for r in out} == label


def test_copies_of_one_string_take_no_memory():
    """Ten times the pieces with one and the same entry: as much is held, and all copies are put down."""
    import tracemalloc

    suffix, side = bytes(range(200)), b"left"
    rest = [suffix_dedup._pack([[10**6 + i], [0], [0], [0], [0], [300]], bytes([i]) * 300) for i in range(5)]
    peaks = []
    for n in (3_000, 30_000):
        packed = (suffix_dedup._pack([[i], [0], [4], [4], [0], [200]], suffix + side) for i in range(n))
        rows = (pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.array([r])], names=["bucket", "run"]) for part in (packed, rest) for r in part)
        tracemalloc.start()
        spans = 0
        for batch in suffix_dedup._merge(rows, 200, 16, None):
            spans += sum(s is not None for s in batch.column(0).to_pylist())
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
        assert spans == n
    assert peaks[1] < 1.5 * peaks[0]

def test_a_chain_of_candidates_is_not_paired_with_itself(spark, monkeypatch):
    """Sets of a cluster beyond a task are sent to a bounded number of others, not to all of the cluster."""
    sent, join = [], ngram_join._tree_join

    def counted(texts, units, *rest):
        sent.append(units.count())
        return join(texts, units, *rest)

    monkeypatch.setattr(ngram_join, "_tree_join", counted)
    words = np.random.default_rng(5).integers(0, 10**9, 2050).astype(str)
    rows = [(i, " ".join(words[10 * i : 10 * i + 60])) for i in range(200)]  # neighbours share 46 of 66 shingles, and are not alike
    got = ngram_join.similar_groups(documents(spark, rows).repartition(3), 5, (8, 10), most=16).collect()
    assert [r for r in got if r.component_id != r.doc_id] == [] and len(got) == 200
    assert 0 < sum(sent) <= 5 * 200
