"""Operator 11 against brute force: fingerprints word by word, links pair by pair."""

import random
import re

import pyarrow as pa
import pytest
import xxhash
from tests.llm.conftest import documents

from tastemill.llm import simhash

SEP = r"[\x20\x09-\x0D]+"


def brute_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in re.split(SEP, low) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashed = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashed) > len(hashed))


def brute_groups(prints, radius):
    """The smallest id that each row reaches; prints: (id, fingerprint)."""
    label = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= radius:
                a, b = label[i], label[j]
                label = [a if x == b else x for x in label]
    return [min(prints[j][0] for j in range(len(prints)) if label[j] == x) for x in label]


def low(i):
    return -(2**63) if i is None else i


def corpus():
    rng = random.Random(3)
    rows = [(None, "Ab c d"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "ONE"), (7, "É É É"), (8, "long " * 20_000), (9, "x y z " * 300)]
    for i in range(10, 120):
        if i % 3:
            words = rows[rng.randrange(10, len(rows))][1].split() if len(rows) > 10 else ["start"]
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = f"w{rng.randrange(50)}"
        else:
            words = [f"w{rng.randrange(500)}" for _ in range(rng.randint(30, 400))]
        rows.append((i, rng.choice([" ", "\x0b", "  "]).join(words)))
    return [*rows, (5, "two words"), (6, "something else altogether here"), (200, rows[20][1].upper())]


def test_fingerprints():
    texts = [t for _, t in corpus()]
    assert simhash.fingerprints(pa.array(texts)).tolist() == [brute_print(t) for t in texts]


@pytest.mark.parametrize("most", [8, 2048])
def test_groups(spark, most):
    rows = corpus()
    df = documents(spark, rows).withColumnRenamed("source", "fp").withColumnRenamed("lang", "bucket")
    out = simhash.near_groups(df.repartition(3), most=most).collect()
    prints = [(low(i), brute_print(t)) for i, t in rows]
    want = sorted((i, f"{fp:016x}", c) for (i, fp), c in zip(prints, brute_groups(prints, 3), strict=True))
    assert sorted((low(r.doc_id), r.fingerprint, low(r.component_id)) for r in out) == want
    assert simhash.near_groups(documents(spark, [])).count() == 0


def test_every_pair_within_the_radius_meets():
    rng = random.Random(5)
    for radius in (1, 2, 3):
        for level in range(4):
            family = simhash.masks(radius, level)
            assert len(family) == 2 ** (radius + 1) - 1
            for _ in range(500):
                diff = sum(1 << b for b in rng.sample(range(64), radius))
                assert any(not diff & m for m in family)


@pytest.mark.parametrize("most", [40, 2048])
def test_overfull_buckets(spark, most):
    """Fingerprints around a few centres: buckets beyond ``most`` are dealt again, and no link is lost."""
    rng = random.Random(9)
    prints = {0, (1 << 64) - 1}
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(250):
            prints.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    prints = sorted(prints)
    df = spark.createDataFrame([(simhash._signed(p),) for p in prints], "fp long")
    found = [((r.a + 2**64) % 2**64, (r.b + 2**64) % 2**64) for r in simhash.near_links(df, most=most).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in found)
    label = {p: p for p in prints}
    for a, b in found:
        x, y = label[a], label[b]
        label = {p: x if v == y else v for p, v in label.items()}
    want = brute_groups([(p, p) for p in prints], 3)
    least = {}
    for p in prints:
        least.setdefault(label[p], p)
    assert [least[label[p]] for p in prints] == want
