"""Colliding texts, clashing column names, very long texts, hot groups and the joins with listed keys."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tests.llm.conftest import documents

from tastemill.llm import _components, _jobs, _spans, decontamination, exact_dedup, ngram_join, packing, quality, substring_dedup, suffix_dedup, warc
from tastemill.llm._bpe import Encoder
from tastemill.llm._components import components
from tastemill.llm._text import Words, span_hashes


def mirrored(letters="ab", steps=12):
    """Two texts whose polynomial hashes modulo 2**64 are equal for every odd base."""
    one, two = letters
    for _ in range(steps):
        one, two = one + two, two + one
    return one, two


def test_self_similar_words_have_different_hashes():
    one, two = mirrored()
    assert len(set(Words(pa.array([one, two, "x" + one, "x" + two])).hashes().tolist())) == 4
    raw = np.frombuffer(b"abcdefgh" * 3 + b"\0\0", np.uint8)
    starts, ends = np.array([0, 8, 16, 0, 24, 24]), np.array([8, 16, 24, 7, 25, 26])
    h = span_hashes(raw, starts, ends).tolist()
    assert h[0] == h[1] == h[2] and len(set(h)) == 4  # zeros at the end count


def test_operators_tell_self_similar_texts_apart(spark):
    one, two = mirrored(steps=10)
    rows = [(1, one), (2, two), (3, f"p q {one} r"), (4, f"p q {two} r")]
    table = documents(spark, rows)
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(table).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(table, 3).collect()} == dict.fromkeys(range(1, 5), 0)
    assert len({r.keep_id for r in exact_dedup.exact_groups(table).collect()}) == 4
    want = {}
    for i, t in rows:
        places = {}
        for j, u in rows:
            for s in range(len(u) - 199):
                places.setdefault(u[s : s + 200], set()).add((j, s))
        gone = set().union(*(range(s, s + 200) for s in range(len(t) - 199) if len(places[t[s : s + 200]]) > 1), set())
        want[i] = len(gone)
    assert {r.doc_id: r.n_removed for r in suffix_dedup.drop_repeated_strings(table).collect()} == want


def test_tokenizer_tells_self_similar_splits_apart(monkeypatch):
    from tokenizers import Tokenizer

    from tastemill.llm import _bpe

    spec = packing.tokenizer_text()
    own, tokenizer = Encoder(spec), Tokenizer.from_str(spec)
    texts = [*mirrored(steps=12), "a bb ccc dddd " + mirrored("xy", 11)[1], "é" * 9]
    ids = lambda e, t: [e.encode(pa.array([x]))[0].tolist() for x in t]
    want = [x.ids for x in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert ids(own, texts) == want
    # and where all hashes collide, bytes decide
    monkeypatch.setattr(_bpe, "span_hashes", lambda buf, a, b: span_hashes(buf, a, b) % np.uint64(3))
    assert ids(Encoder(spec), texts) == want
    broken = pa.array([b"ab\xff c"], pa.binary()).view(pa.string())
    assert own.encode(broken)[0].tolist() == tokenizer.encode("ab\ufffd c", add_special_tokens=False).ids


NAMES = ["row", "id", "digest", "gone", "leak", "score", "k0", "g0", "kept", "a.b", "__hit", "__p", "__bits", "__id", "__gone", "__digest", "unit", "set"]


def clashing(spark, rows):
    return documents(spark, rows).select("*", *(F.lit(f"v{i}").alias(n) for i, n in enumerate(NAMES)))


@pytest.mark.parametrize("stage", ["quality", "exact", "near", "leaks"])
def test_stages_keep_columns_of_any_name(spark, tmp_path, stage):
    import corpus_pipeline

    text = " ".join(f"word{i}" for i in range(60)).capitalize() + "."
    rows = [(1, text), (2, text), (3, text + " More."), (4, "Another text of some words, with item words of the list."), (5, None), (5, None), (None, "x"), (-(2**63), "y")]
    table = clashing(spark, rows)
    spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "item words of the list.")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    out = dict(corpus_pipeline.STAGES)[stage](spark, table, str(tmp_path))
    assert out.columns == table.columns and out.schema == table.schema
    got = out.collect()
    assert all(r[n] == f"v{i}" for r in got for i, n in enumerate(NAMES))
    ids = sorted((r.doc_id is not None, r.doc_id or 0) for r in got)
    want = {"exact": {(True, 1), (True, 3), (True, 4), (True, 5), (False, 0), (True, -(2**63))}, "near": {(True, 1), (True, 4), (True, 5), (False, 0), (True, -(2**63))}, "leaks": {(True, 1), (True, 2), (True, 3), (True, 5), (False, 0), (True, -(2**63))}}
    assert stage not in want or set(ids) == want[stage]
    assert stage != "exact" or len(ids) == 6
    assert dict(corpus_pipeline.STAGES)[stage](spark, table.where("false"), str(tmp_path)).count() == 0


def test_queries_ignore_columns_of_any_name(spark):
    table = clashing(spark, [(1, "a b c d e f"), (2, "a b c d e f"), (None, None)])
    assert exact_dedup.exact_groups(table).count() == substring_dedup.drop_repeats(table, 3).count() == suffix_dedup.drop_repeated_strings(table, 4).count() == ngram_join.similar_groups(table).count() == 3
    items = table.select(F.col("doc_id").alias("item_id"), "text", *(F.col(f"`{n}`") for n in NAMES))
    assert decontamination.leaks(table, items).count() == 4
    assert packing.pack(table, packing.tokenizer_text()).select("doc_id").distinct().count() == 3
    pages = table.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), F.lit("2024-01-01T00:00:00Z").alias("date"), *(F.col(f"`{n}`") for n in NAMES))
    assert warc.archived(pages).count() == 3


def test_very_long_texts(spark, tmp_path):
    rng = random.Random(1)
    long = " ".join(str(rng.randrange(10**6)) for _ in range(400_000))
    near = long + " tail"
    rows = [(1, long), (2, near), (3, "\n".join("x" * 300_000)), (4, "y" * 3_000_000), (5, long)]
    table = documents(spark, rows)
    groups = {r.doc_id: r.keep_id for r in exact_dedup.exact_groups(table).collect()}
    assert groups == {1: 1, 2: 2, 3: 3, 4: 4, 5: 1}
    words = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.drop_repeats(table).collect()}
    assert words == {1: (400_000, 0), 2: (400_001, 400_000), 3: (300_000, 300_000 - 1), 4: (1, 0), 5: (400_000, 400_000)}
    assert {r.doc_id: r.component_id for r in ngram_join.similar_groups(table).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 1}
    left = {r.doc_id: r.n_bytes - r.n_removed for r in suffix_dedup.drop_repeated_strings(table).collect()}
    assert left == {1: 0, 2: 5, 3: 0, 4: 0, 5: 0}
    item = spark.createDataFrame([(9, " ".join(long.split()[200_000:200_060]))], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(table, item).collect()} == {1, 2, 5}
    field = quality.train(table, spark.createDataFrame([(1, 1), (4, 0)], "doc_id long, quality int"))
    assert quality.quality_scores(table, field).where("score between 0 and 1").count() == 5
    pages = table.select(F.col("doc_id").alias("page_id"), F.lit("http://h/").alias("url"), F.col("text").alias("html"), F.lit("2024-01-01T00:00:00Z").alias("date"))
    out = {r.page_id: (r.payload_bytes, r.payload_digest, r.refers_to) for r in warc.archived(pages).collect()}
    assert out == {i: (len(t), hashlib.sha256(t.encode()).hexdigest(), 1 if i == 5 else None) for i, t in rows}


def test_archives_are_cut_by_bytes(spark, tmp_path):
    rows = [(i, f"http://h/{i}", str(i) * (4000 if i % 2 else 10), "2024-01-01T00:00:00Z") for i in range(10, 50)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string, date string").coalesce(1)
    warc.write_archives(table, str(tmp_path / "w"), per_file=8, small=1 << 10)
    import gzip

    sizes = [len(gzip.decompress(f.read_bytes())) for f in (tmp_path / "w").rglob("part-*.gz")]
    assert len(sizes) > 10 and max(sizes) < 4 * 8 << 10
    assert {r.page_id for r in warc.capture_histories(spark, str(tmp_path / "w")).collect()} == set(range(10, 50))
    assert len({(r.file, r.at) for r in warc.capture_histories(spark, str(tmp_path / "w")).collect()}) == 40


@pytest.mark.parametrize("bits", [32768, 1 << 26])
def test_joins_with_listed_keys(spark, monkeypatch, bits):
    monkeypatch.setattr(_jobs, "FILTER_BITS", bits)  # few bits: many rows are asked for in vain
    rows = spark.range(5000).select(F.col("id").alias("doc"), F.lit("t").alias("text"))
    gone = spark.range(0, 5000, 3).select(F.col("id").alias("gone"))
    assert {r.doc for r in _jobs.without(rows, gone, {"gone": F.col("doc")}).collect()} == {i for i in range(5000) if i % 3}
    own = gone.withColumn("v", F.lit(1))
    assert _jobs.among(rows, ["doc"], own, ["gone"]).count() == gone.count()
    rest = _jobs.among(rows, ["doc"], own, ["gone"], rest=True)
    assert rest.count() == 5000 and rest.where("v = 1").count() == gone.count()
    assert _jobs.without(rows, gone.where("false"), {"gone": F.col("doc")}).count() == 5000


def test_rows_that_repeat_an_id_and_a_text_share_their_spans(spark):
    docs = _spans.keyed(documents(spark, [(1, "a b c d e f g h")] * 30 + [(2, "x")]))
    out = _spans.with_spans(docs, suffix_dedup.repeated_strings(docs, 10)).collect()
    assert len(out) == 31 and max(len(r.starts or ()) for r in out) == 6  # one for each window, however many rows


@pytest.mark.parametrize("stars", [512, 2])
def test_components_of_stars_and_chains(spark, monkeypatch, stars):
    monkeypatch.setattr(_components, "STARS", stars)  # all nodes are stars, or next to none
    edges = [(0, i) for i in range(1, 300)] + [(i, i + 1) for i in range(1000, 1060)] + [(7, 7), (2000, 2001), (2001, 2000), (2000, 2001)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(300), 0), **dict.fromkeys(range(1000, 1061), 1000), 2000: 2000, 2001: 2000}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_common_lines_in_many_documents(spark):
    """A line in a third of all documents is demoted as an anchor; results do not change."""
    rng = random.Random(2)
    line = " ".join(f"common{i}" for i in range(25))
    rows = [(i, " ".join(str(rng.random()) for _ in range(30)) + " " + (line if i % 3 == 0 else "") + " " + " ".join(str(rng.random()) for _ in range(30))) for i in range(150)]
    table = documents(spark, rows).repartition(3)
    hot = _spans.heavy(_spans.keyed(table).select("doc", "text").mapInArrow(lambda b: suffix_dedup._frequent(b, 100, 16), "key long, n long"), 1 / 2000)
    assert any(x >= 0 for x in hot)
    removed = {r.doc_id: (r.n_removed, r.n_spans) for r in suffix_dedup.drop_repeated_strings(table, 100).collect()}
    assert all((removed[i][0] >= len(line)) == (i % 3 == 0) and removed[i][1] == (i % 3 == 0) for i in range(150))
    words = {r.doc_id: r.n_removed for r in substring_dedup.drop_repeats(table).collect()}
    assert words == {i: 25 if i % 3 == 0 and i else 0 for i in range(150)}
