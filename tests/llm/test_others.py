"""Operators 4, 5, 7 and 8, and the pipeline, against brute force, with nulls, ties and repeated rows."""

import datetime as dt
import gzip
import hashlib
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import documents

from tastemill.llm import decontamination, pii, quality, warc
from tastemill.llm._merge import LoserTree

KEY = b"test"


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, date string")


def test_warc_round_trip(spark):
    long = "x" * 150 + "\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc é"
    day = "2024-01-0{}T00:00:00Z".format
    rows = [
        (1, "http://b.example.com/p?q=1#f", long, day(1)), (2, "https://WWW.Example.com", long, day(2)), (3, "http://a.example.com/", "short", day(1)), (4, "http://a.example.com/", "short", day(3)),
        (5, None, None, day(1)), (6, "http://a.example.com/", "", day(2)), (None, "http://z.org/", long, day(4)), (7, "http://z.org/\r\nX: y", "y" * 100, day(1)), (7, "http://z.org/\r\nX: y", "y" * 100, day(1)),
    ]
    out = warc.archived(pages(spark, rows).repartition(3)).collect()
    digest = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    want = []
    for i, _, html, _ in rows:
        n = len((html or "").encode())
        first = min((j for j, _, h, _ in rows if j is not None and h == html), default=None) if n >= 100 else None
        revisit = first is not None and i != first
        want.append((i or -1, n, digest(html), "revisit" if revisit else "response", first if revisit else None))
    assert sorted(map(str, want)) == sorted(str((r.page_id or -1, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to)) for r in out)
    order = [(r.url_key, r.timestamp, r.page_id or -1) for r in sorted(out, key=lambda r: (r.range_no, r.position))]
    assert order == sorted(order)
    assert "com,example)/" in {r.url_key for r in out} and "com,example,b)/p?q=1" in {r.url_key for r in out}
    assert warc.archived(pages(spark, [])).count() == 0


def test_archives_are_warc_files(spark, tmp_path):
    warc.write_archives(pages(spark, [(i, f"http://h/{i}", "t" * i, "2024-01-01T00:00:00Z") for i in range(5)]).coalesce(1), str(tmp_path / "w"), per_file=2)
    files = sorted((tmp_path / "w").rglob("part-*.gz"))
    assert len(files) == 3
    data = gzip.decompress(files[0].read_bytes())
    assert data.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and data.endswith(b"\r\n\r\n")
    # members of one record each, as other writers make them
    parts = b"".join(gzip.compress(data[a:b]) for a, b in itertools.pairwise([0, data.index(b"WARC/1.1", 5), len(data)]))
    assert [f["warc-record-id"] for _, f, _ in warc.parse(parts)] == [f["warc-record-id"] for _, f, _ in warc.parse(data)]
    for cut in (data[:30], data[:-10]):
        with pytest.raises(ValueError):
            list(warc.parse(cut))


def test_many_ranges(spark, monkeypatch):
    monkeypatch.setattr(warc, "parts", lambda *a: 5)
    rows = [(i, "http://hot.org/" if i % 3 else f"http://h{i % 10}.org/", str(i), f"2024-01-{1 + i % 28:02d}T00:00:00Z") for i in range(200)]
    out = sorted(warc.archived(pages(spark, rows).repartition(4)).collect(), key=lambda r: (r.range_no, r.position))
    keys = [(r.url_key, r.timestamp, r.page_id) for r in out]
    assert len(keys) == 200 and keys == sorted(keys) and len({r.range_no for r in out}) > 2


def test_loser_tree():
    rng = random.Random(1)
    for _ in range(50):
        runs = [sorted((rng.randint(0, 9), i) for i in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 7))]
        assert [k for k, _ in LoserTree([iter([(k, v) for k, v in r]) for r in runs])] == sorted(k for r in runs for k, _ in r)


def test_permutations_are_permutations():
    for size in (1, 2, 7, 100, 365):
        assert sorted(pii.permute(i, size, KEY, "t") for i in range(size)) == list(range(size))
    assert pii.permute(5, 1000, KEY, "t") != pii.permute(5, 1000, b"other", "t")


def test_pseudonyms_keep_formats_and_links():
    text = 'pay 4111 1111-1111 1111 or 4111111111111111, IBAN GB82 WEST 1234 5698 7654 32, ssn 078-05-1120, call +1 (212) 555-0100, 10.1.2.3, me@site.org on 2024-02-29 or 31/12/1999, token = "abcd1234abcd1234"'
    new, found = pii.pseudonymise(text, KEY)
    assert found == {"card": 2, "account": 1, "social": 1, "phone": 1, "address": 1, "email": 1, "date": 2, "secret": 1}
    assert not any(v in new for v in ("4111", "WEST", "078-05-1120", "555-0100", "10.1.2.3", "me@site", "2024-02-29", "31/12/1999", "abcd1234abcd"))
    cards = re.findall(r"\d{4} \d{4}-\d{4} \d{4}|\d{16}", new)
    assert len({re.sub(r"\D", "", c) for c in cards}) == 1 and pii.luhn_ok(re.sub(r"\D", "", cards[0]))
    iban = re.search(r"IBAN ((?:\w{4} ){5}\w\w)", new)[1].replace(" ", "")
    assert pii._mod97(iban[4:] + iban[:4]) == 1
    dt.date.fromisoformat(re.search(r"\d{4}-\d\d-\d\d", new)[0])
    dt.datetime.strptime(re.search(r"\d\d/\d\d/\d{4}", new)[0], "%m/%d/%Y" if "12/" in new else "%d/%m/%Y")
    assert pii.pseudonymise(text, KEY) == (new, found)


@pytest.mark.parametrize("text", ["", "plain words only", "1234567890123456 is no card", "999.1.2.3 and 1.2.3", "30/02/2020", "a = b: c", "12 34", "666-12-3456", "é" * 50, "1 2 3 4 5 6 7 8 9 0 1 2 3"])
def test_what_is_not_valid_stays(text):
    assert pii.pseudonymise(text, KEY) == (text, {})


def test_groups_that_touch():
    new, found = pii.pseudonymise("4451718024887799 27.65.93.188 and 4451718024887799 12", KEY)
    assert found == {"card": 2, "address": 1} and new.endswith(" 12") and "4451718024887799" not in new


def test_pseudonyms_of_a_table(spark):
    rows = [(1, "mail a@b.org"), (2, "mail a@b.org " + "w " * 5000), (3, None), (4, ""), (None, "x"), (1, "mail a@b.org")]
    out = pii.pseudonyms(documents(spark, rows), KEY).collect()
    texts = [r.text for r in out if r.doc_id in (1, 2)]
    assert len({t.split()[1] for t in texts}) == 1 and all("a@b.org" not in t for t in texts)
    assert {r.doc_id: r.text for r in out if r.doc_id in (3, 4, None)} == {3: None, 4: "", None: "x"}
    assert pii.pseudonyms(documents(spark, []), KEY).count() == 0


def test_leaks(spark):
    rng = random.Random(2)
    vocab = [f"t{i}" for i in range(40)]
    items = [(i, " ".join(rng.choice(vocab) for _ in range(rng.choice([3, 6, 12, 40, 200])))) for i in range(30)] + [(90, None), (91, ""), (None, " ".join(vocab)), (5, " ".join(vocab[:9]))]
    rows = []
    for i in range(60):
        own = [rng.choice(vocab) for _ in range(rng.randint(0, 300))]
        leak = (rng.choice(items)[1] or "").upper().split()
        for _ in range(rng.randint(0, 2)):
            if leak:
                leak[rng.randrange(len(leak))] = "changed"
        rows.append((i, " ".join(own) + "\n" + " ".join(leak)))
    rows += [(None, rows[0][1]), (3, rows[3][1]), (99, None)]

    def grams(t, k):
        w = (t or "").lower().split()
        return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}

    def held(q, t):  # an item shorter than five words is one shingle
        k = min(5, len((q or "").split()))
        want = grams(q, k) if k else set()
        shared = len(want & grams(t, k)) if k else 0
        return (len(want), shared) if want and 10 * shared >= 8 * len(want) else None

    want = sorted(str((i, j, *own)) for i, t in rows for j, q in items if (own := held(q, t)))
    assert any(len((q or "").split()) == 3 and held(q, t) for _, t in rows for _, q in items)
    table = spark.createDataFrame(items, "item_id long, text string")
    for block, size in ((7, 16 << 20), (20_000, 500), (20_000, 16 << 20)):
        out = decontamination.leaks(documents(spark, rows).repartition(3), table, block=block, block_bytes=size).collect()
        assert sorted(str((r.doc_id, r.item_id, r.n_item_shingles, r.n_shared)) for r in out) == want
    kept = decontamination.drop_leaks(documents(spark, rows), table)
    hit = {i for i, t in rows for _, q in items if held(q, t)}
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in rows if i not in hit)
    assert decontamination.leaks(documents(spark, []), table).count() == 0 and decontamination.leaks(documents(spark, rows), table.where("false")).count() == 0


def test_forward_backward_equals_all_labellings():
    rng = np.random.default_rng(3)
    lengths = [0, 1, 4, 3]
    rows = np.concatenate([[0], np.cumsum(lengths)])
    logit, transition = rng.normal(size=8), rng.normal(size=(2, 2))
    good, pairs = quality.forward_backward(logit, rows, transition)
    for d, n in enumerate(lengths):
        u = logit[rows[d] : rows[d + 1]]
        weights = {y: np.exp(sum(u[t] / 2 * (1 if y[t] else -1) for t in range(n)) + sum(transition[y[t], y[t + 1]] for t in range(n - 1))) for y in itertools.product((0, 1), repeat=n)}
        z = sum(weights.values())
        for t in range(n):
            assert good[rows[d] + t] == pytest.approx(sum(w for y, w in weights.items() if y[t]) / z)
        for a, b in itertools.product((0, 1), repeat=2):
            assert pairs[d, a, b] == pytest.approx(sum(w * sum(y[t] == a and y[t + 1] == b for t in range(n - 1)) for y, w in weights.items()) / z, abs=1e-9)


def lines(rng, good):
    words = [rng.choice(["the", "a", "house", "river", "walks", "green"]) for _ in range(8)]
    return " ".join(words).capitalize() + "." if good else " | ".join(w.upper() + "!!" for w in words)


def labelled(n, seed=4):
    rng = random.Random(seed)
    rows = [(i, "\n".join(lines(rng, i % 3 > 0) for _ in range(rng.randint(1, 9))), int(i % 3 > 0)) for i in range(n)]
    return [(i, t) for i, t, _ in rows], [(i, q, 0) for i, _, q in rows]


def test_quality_on_held_out_rows(spark):
    docs, labels = labelled(200)
    table = documents(spark, [*docs, (900, None), (901, ""), (902, " \n "), (None, "x")])
    own = spark.createDataFrame([*labels, (None, 1, 0), (1, None, 0), (7777, 1, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(table, own.where(~quality.held_out()), sample=100)
    scores = {r.doc_id: r.score for r in quality.quality_scores(table, field).collect()}
    assert len(scores) == 204 and all(0 <= s <= 1 for s in scores.values())
    assert scores[900] == scores[901] == scores[902] == pytest.approx(field.prior)
    truth = {i: q for i, q, _ in labels}
    assert np.mean([(scores[i] >= 0.5) == truth[i] for i in truth]) > 0.97
    assert quality.quality_scores(documents(spark, []), field).count() == 0
    kept = quality.keep_good(table, own)
    assert kept.columns == ["doc_id", "text", "lang", "source", "n_chars"] and kept.where("doc_id % 3 = 1 and doc_id < 200").count() == 67
    # without labels there is nothing to learn: every row has the prior
    blank = quality.train(table, own.where("false"))
    assert {round(r.score, 6) for r in quality.quality_scores(table, blank).collect()} == {0.5}


def test_line_features_keep_to_their_rows():
    texts = ["One line.\n\nTWO!! | x", "", "solo"]
    x, size, rows = quality.line_features(pa.array(texts))
    weights = np.random.default_rng(5).normal(size=quality.FEATURES)
    assert np.allclose(quality.logits(x, rows, weights), quality.with_neighbours(x, rows) @ weights, atol=1e-5)
    assert quality.with_neighbours(x, rows)[:, -2:].tolist() == [[0, 1], [1, 0], [0, 0]]  # a line before, a line after
    assert rows.tolist() == [0, 2, 2, 3] and len(size) == 3
    for i, t in enumerate(texts):
        own, _, _ = quality.line_features(pa.array([t]))
        assert np.allclose(own, x[rows[i] : rows[i + 1]])


def test_pipeline_keeps_one_clean_copy(spark, tmp_path):
    import corpus_pipeline

    docs, labels = labelled(240, 5)
    rng = random.Random(6)
    unique = lambda n: " ".join(f"u{rng.randrange(10**9)}" for _ in range(n)).capitalize() + "."
    clean = [(1000 + i, unique(60)) for i in range(20)]
    item = unique(30)
    rows = [*docs, *clean, (2000, clean[0][1] + " \n"), (2001, clean[1][1] + " tail."), (2002, unique(20) + "\n" + item + "\n" + unique(20)), (2003, None)]
    documents(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = table
        table = stage(spark, table, str(tmp_path))
        assert table.columns == before.columns
        kept[name] = {r.doc_id for r in table.collect()}
    assert not any(i % 3 == 0 for i in kept["quality"] if i < 240)
    assert 1000 not in kept["exact"] and 2000 in kept["exact"]  # the longer original stays
    assert 1001 in kept["near"] and 2001 not in kept["near"]
    assert 2002 in kept["near"] and 2002 not in kept["leaks"]
    assert {1000 + i for i in range(1, 20)} <= kept["leaks"]
    out = corpus_pipeline.run(spark, str(tmp_path)).groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    assert {r.doc_id for r in out} == kept["leaks"] and all(r.n == r.t for r in out)
