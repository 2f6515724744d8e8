import math
import os
from concurrent.futures import ThreadPoolExecutor
from itertools import combinations
from pathlib import Path

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tastemill.operators import dependence, joins, machine, mining, models, popularity, profile, ranking, ranks, retrieval, sketches, splits, vertical
from tastemill.plans import analysis, fixtures, study
from tastemill.sources.folders import kept, passing, shared_folder
from tastemill.streaming import jobs


def test_global_numbers_equal_one_window(spark):
    rows = spark.createDataFrame([(i * 7 % 50, i) for i in range(300)], "a int, b int")
    got = ranks.global_row_number(rows, ["a", "b"], offset=10).collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.rn)] == sorted((r.a, r.b) for r in got)
    assert sorted(r.rn for r in got) == list(range(11, 311))


def test_buckets_and_hash_split(spark):
    assert [splits.cumulative_buckets(w) for w in ([8, 1, 1], [1, 1, 1], [29, 71])] == [[80, 90, 100], [33, 66, 99], [28, 99]]
    import hashlib

    rows = spark.range(200).withColumn("s", F.concat(F.lit("k"), "id"))
    out = splits.hash_split(rows, {"a": 1, "b": 1, "c": 1}, ["id", "s"]).collect()
    for r in out:
        bucket = int(hashlib.sha256(f"{r.id}|{r.s}".encode()).hexdigest(), 16) % 99
        assert r.split == ("a" if bucket < 33 else "b" if bucket < 66 else "c")
    with pytest.raises(TypeError):
        splits.hash_split(rows.withColumn("x", F.lit(1.5)), {"a": 1}, ["x"])


def test_splits_are_disjoint_and_complete(spark):
    rows = spark.createDataFrame([(u, i, i % 9) for u, n in ((1, 1), (2, 2), (3, 3), (4, 10)) for i in range(n)], "user_id int, movie_id int, timestamp int")
    by_time = splits.time_split(rows, {"train": 0.8, "val": 0.1, "test": 0.1}, ["timestamp", "user_id", "movie_id"])
    assert {r.split: r.n for r in profile.split_counts(by_time).collect()} == {"train": 12, "val": 2, "test": 2}
    more = splits.time_split(spark.range(19), {"train": 0.8, "val": 0.1, "test": 0.1}, ["id"])
    assert {r.split: r.n for r in profile.split_counts(more).collect()} == {"train": 15, "val": 2, "test": 2}
    own = splits.per_user_split(rows, [F.col("movie_id")])
    names = {(r.user_id, r.movie_id): r.split for r in own.collect()}
    assert len(names) == 16 and names[3, 0] == "test" and names[3, 1] == "val" and names[3, 2] == "train"
    assert [names[4, i] for i in range(3, 10)] == ["train"] * 5 + ["val", "test"]
    assert sorted(r.user_id for r in splits.users_missing_a_split(own).collect()) == [1, 2]
    users = splits.time_user_split(rows, ["timestamp", "user_id", "movie_id"]).collect()
    assert len(users) == 16 and sum(r.split == "test" for r in users) == 2
    assert all(len({r.split for r in users if r.user_id == u and r.split != "test"}) <= 1 for u in (1, 2, 3, 4))
    sizes = [r.n for r in profile.frequencies(splits.assign_batches(rows.select("movie_id").distinct(), 4, "movie_id"), "batch_id").collect()]
    assert sorted(sizes) == [2, 4, 4]


def test_single_genre_users(spark):
    movies = spark.createDataFrame([(1, "War"), (2, "War|Drama"), (3, "Drama")], "movie_id int, genres string")
    ratings = spark.createDataFrame([(1, 1, 5), (1, 2, 3), (2, 1, 5), (2, 3, 5), (3, 2, 5), (4, 1, 4)], "user_id int, movie_id int, rating int")
    users = spark.createDataFrame([(i,) for i in range(1, 5)], "user_id int")
    assert [r.user_id for r in splits.single_genre_users(ratings, movies, users).collect()] == [1]


def folded(steps, alpha):
    b, last = 1.0, 0
    for s in sorted(set(steps)):
        b, last = (1 - alpha) * b + alpha * (s - last), s
    return b


IDS = {"twice": 1, "first": 2, "gap": 3}
EVENTS = [("twice", 3), ("twice", 3), ("twice", 5), ("first", 1), ("gap", 2), ("gap", 90)]


def test_item_gap_and_its_stream(spark, tmp_path):
    rows = spark.createDataFrame([(IDS[n], n, s) for n, s in EVENTS], "item long, name string, step long")
    got = {r.item: r for r in popularity.item_gap(rows, "item", "step", 0.1).collect()}
    for name in ("twice", "first", "gap"):
        item, steps = IDS[name], [s for n, s in EVENTS if n == name]
        assert got[item].b == pytest.approx(folded(steps, 0.1))
        assert got[item].p == pytest.approx(1 / folded(steps, 0.1))
    hours = rows.select("item", "step", (F.timestamp_seconds(F.lit(0)) + F.make_interval(hours=F.col("step").cast("int"))).alias("ts"))
    out = pd.DataFrame([r.asDict() for r in streamed(hours, tmp_path, ["step = 5", "step < 3", "step in (3, 90)"], "10 hours").collect()])
    last = out.sort_values("micro_batch").groupby("item").b.last()
    # step 2 and 3 come after step 5, step 90 closes them all
    assert last.to_dict() == pytest.approx({i: r.b for i, r in got.items()})


def streamed(rows, folder, parts, late, forget=None):
    """The parts of ``rows`` as micro-batches of the stream, in their order."""
    for part in parts:
        rows.where(part).coalesce(1).write.mode("append").parquet(str(folder / "in"))
    source = rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))
    return jobs.run_available(jobs.stream_item_gap(source, "item", "step", 0.1, "ts", late, forget), str(folder / "out"), str(folder / "state"), "update")


def test_timers_fold_late_steps_and_forget(spark, tmp_path):
    """Steps behind the watermark are dropped; an item that nothing came for starts anew."""
    times = spark.createDataFrame([(1, s) for s in (1, 4, 2, 50, 3, 51)] + [(2, s) for s in (1, 60, 200, 201)] + [(3, 170), (3, 171)], "item long, step long")
    rows = times.select("item", "step", (F.timestamp_seconds(F.lit(0)) + F.make_interval(hours=F.col("step").cast("int"))).alias("ts"))
    parts = ["item = 1 and step in (1, 4)", "step = 2", "item = 1 and step = 50", "item = 1 and step in (3, 51)"]
    out = streamed(rows, tmp_path / "late", parts, "5 hours").collect()
    last = max((r for r in out if r.item == 1), key=lambda r: (r.micro_batch, r.n))
    assert (last.n, last.b) == (5, pytest.approx(folded([1, 2, 4, 50, 51], 0.1)))  # step 3 came 47 hours late
    out = streamed(rows, tmp_path / "forget", ["item = 2 and step = 1", "item = 2 and step = 60", "step = 170", "step = 171", "item = 2 and step = 200", "item = 2 and step = 201"], "1 hour", 100 * 3600 * 1000).collect()
    last = max((r for r in out if r.item == 2), key=lambda r: r.micro_batch)
    assert (last.n, last.b) == (2, pytest.approx(folded([200, 201], 0.1)))


def test_watermark_drops_late_rows(spark, tmp_path):
    movies = spark.createDataFrame([(1, "War|Drama")], "movie_id long, genres string")
    for i, times in enumerate((["2024-01-01 01:00", "2024-01-05 00:00"], ["2024-01-01 02:00", "2024-01-05 03:00"], ["2024-01-09 00:00"])):
        spark.createDataFrame([(t, 1, 4) for t in times], "t string, movie_id long, rating int").select(F.col("t").cast("timestamp").alias("ts"), "movie_id", "rating").coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        rows = spark.readStream.schema("ts timestamp, movie_id long, rating int").parquet(f"{tmp_path}/in/*")
        out = jobs.run_available(jobs.stream_genre_trend(rows, movies, "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.genre, r.n) for r in out.collect()) == [("Drama", 1), ("Drama", 2), ("War", 1), ("War", 2)]


def vectors(spark, n=24):
    rng = np.random.default_rng(1)
    data = [(i, i % 2, rng.normal(size=4).tolist(), rng.normal(size=4).tolist(), i % 5, float(i % 3)) for i in range(n)]
    return data, spark.createDataFrame(data, "id long, batch long, q array<double>, c array<double>, mask int, w double")


def test_ranks_agree_and_match_numpy(spark):
    data, df = vectors(spark)
    a = {r.qid: r for r in ranking.inbatch_ranks(df, "batch", "id", "q", "c", "mask", "w", "arrow").collect()}
    b = {r.qid: r for r in ranking.inbatch_ranks(df, "batch", "id", "q", "c", "mask", "w", "sql").collect()}
    for i, batch, q, _, mask, w in data:
        s = {j: float(np.dot(q, c)) for j, b2, _, c, m2, _ in data if b2 == batch and (j == i or m2 != mask)}
        for got in (a[i], b[i]):
            assert got["rank"] == sum(v >= s[i] - 1e-6 for v in s.values())
            assert got.best == max(s, key=s.get) and got.weight == w
            assert got.log_sum == pytest.approx(math.log(sum(math.exp(v) for v in s.values())))
    ranks_ = spark.createDataFrame([(1, 1, 2.0), (2, 3, 1.0), (3, 30, 1.0)], "qid long, rank long, weight double")
    m = ranking.ranking_metrics(ranks_, 20).first()
    assert (m.hit_rate, m.recall) == (0.5, 0.75) and m.mrr == pytest.approx((2 + 1 / 3) / 4) and m.ndcg == pytest.approx((2 + 0.5) / 4)
    assert ranking.ranking_metrics(ranks_.where("false"), 20).first().ndcg == 0


def test_losses(spark):
    row = spark.createDataFrame([(1, 2, 3.0, 1.0, 2.5)], "qid long, rank long, weight double, true_score double, log_sum double")
    loss = {k: ranking.inbatch_loss(row, k).first().loss for k in ("softmax", "heuristic", "lambda")}
    assert loss == pytest.approx({"softmax": 1.5, "heuristic": 1.5 * 3 / math.log(3), "lambda": 1.5 * (7 * (1 - 1 / math.log2(3)) + 1)})


def test_top_k_in_blocks(spark):
    data, df = vectors(spark, 30)
    items = df.select(F.col("id").alias("item"), F.col("c").alias("vector"), (F.col("mask") / 10).alias("bias"))
    for size in (1, 200, 1 << 20):
        got = ranking.top_k(df.select(F.col("id").alias("qid"), F.col("q").alias("vector")), items, 3, size, "bias").collect()
        for i, _, q, *_ in data:
            best = sorted(((-float(np.dot(q, c)) - m / 10, j) for j, _, _, c, m, _ in data))[:3]
            assert [r.item for r in sorted((r for r in got if r.qid == i), key=lambda r: r.rank)] == [j for _, j in best]


def test_profiles(spark):
    rows = spark.createDataFrame([(float(i % 7), float(i * i % 11), "a" if i % 3 else None) for i in range(60)], "x double, y double, s string")
    h = profile.histogram(rows, "x", 3).collect()
    assert sorted((r.bin, r.n) for r in h) == [(b, n) for b, n in zip(*np.unique(np.minimum(np.floor(np.arange(60) % 7 / 2), 2).astype(int), return_counts=True), strict=True)]
    assert profile.histogram(rows.select(F.lit(1.0).alias("x")), "x").collect()[0].n == 60
    p = [r.value for r in profile.percentiles(rows, "y", [20, 50, 99]).orderBy("p").collect()]
    assert p == pytest.approx(np.percentile([i * i % 11 for i in range(60)], [20, 50, 99]))
    x, y = np.arange(60) % 7, np.arange(60) ** 2 % 11
    a, b = np.abs(x[:, None] - x), np.abs(y[:, None] - y)
    center = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    cov, va, vb = (max((center(p) * center(q)).mean(), 0) for p, q in ((a, b), (a, a), (b, b)))
    d = profile.distance_correlation(rows, "x", "y").first()
    assert d.dcov == pytest.approx(math.sqrt(cov)) and d.dcor == pytest.approx(math.sqrt(cov / math.sqrt(va * vb)))
    assert (d.n, d.cells) == (60, len({*zip(x, y, strict=True)}))
    assert profile.distance_correlation(rows, "x", "y", grid=4).first().cells <= 16
    matrix = {(r.x, r.y): r.dcor for r in profile.distance_matrix(rows.withColumn("z", F.lit(1.0)), ["x", "y", "z"]).collect()}
    assert matrix == {("x", "y"): pytest.approx(d.dcor), ("x", "z"): 0.0, ("y", "z"): 0.0}
    stats = {r.feature: r for r in profile.feature_stats(rows, None).collect()}
    assert stats["s"].missing == 20 and stats["x"].zeros == 9
    found = profile.anomalies(rows, profile.load_constraints('[{"feature": "s", "type": "string", "min_fraction": 1.0, "domain": ["b"]}, {"feature": "x", "type": "int"}, {"feature": "z", "type": "int"}]'))
    assert sorted((r.feature, r.problem, r.n) for r in found.collect()) == [("s", "missing values", 20), ("s", "out of domain", 40), ("x", "wrong type", 1), ("y", "unexpected column", 1), ("z", "missing column", 1)]
    with pytest.raises(ValueError):
        profile.load_constraints('[{"type": "int"}]')


def brute_dcor(x, y):
    center = lambda m: m - m.mean(0) - m.mean(1)[:, None] + m.mean()
    a, b = center(np.abs(x[:, None] - x)), center(np.abs(y[:, None] - y))
    return math.sqrt((a * b).mean()), math.sqrt((a * b).mean() / math.sqrt((a * a).mean() * (b * b).mean()))


def test_distance_correlation_of_continuous_columns(spark):
    """Ranks, levels and cuts of a few points each give what all pairs give."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=400)
    data = {"x": x, "y": x**2 + rng.normal(size=400), "few": np.round(x), "hot": np.where(rng.random(400) < 0.4, 7.0, rng.normal(size=400))}
    rows = spark.createDataFrame(pd.DataFrame(data)).unionByName(spark.createDataFrame([(None, 1.0, 2.0, 3.0)], "x double, y double, few double, hot double"))
    pairs = list(combinations(data, 2))
    for run in (16, 1 << 16):
        got = {(r.x, r.y): r for r in dependence.distance_pairs(rows, pairs, run=run).collect()}
        for p, q in pairs:
            assert (got[p, q].dcov, got[p, q].dcor) == pytest.approx(brute_dcor(data[p], data[q])) if p == "x" else got[p, q].n == 401


def test_distance_correlation_in_chunks_of_both_orders(spark, monkeypatch):
    """Columns with more values than are chunks of their own: pairs within a chunk of x, of y, and across both."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=300)
    data = {"x": x, "y": x**2 + rng.normal(size=300), "few": np.round(x), "hot": np.where(rng.random(300) < 0.4, 7.0, rng.normal(size=300)), "flat": np.full(300, 0.1)}
    rows = spark.createDataFrame(pd.DataFrame(data))
    monkeypatch.setattr(dependence, "FEW", 8)
    pairs = list(combinations(data, 2))
    for run in (1, 7, 1 << 16):
        got = {(r.x, r.y): r for r in dependence.distance_pairs(rows, pairs, run=run).collect()}
        for p, q in pairs:
            assert (got[p, q].n, got[p, q].cells) == (300, len(set(zip(data[p], data[q], strict=True))))
            assert (got[p, q].dcov, got[p, q].dcor) == ((0.0, 0.0) if q == "flat" else pytest.approx(brute_dcor(data[p], data[q])))
    assert dependence.distance_pairs(rows.limit(0), pairs).count() == 0


def _shuffled(spark) -> int:
    """Records that the session has shuffled so far."""
    sc = spark.sparkContext
    none, quantiles = sc._jvm.java.util.ArrayList(), sc._gateway.new_array(sc._jvm.double, 0)
    stages = sc._jsc.sc().statusStore().stageList(none, False, False, quantiles, none)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_points_are_shuffled_twice_whatever_the_number_of_values(spark):
    """Once to count equal points and once into the order of y; they were copied for each halving of x before."""
    rows = spark.range(20_000).select((F.col("id") % 64).cast("double").alias("x"), F.col("id").cast("double").alias("y"))
    before = _shuffled(spark)
    assert dependence.distance_pairs(rows, [("x", "y")]).first().cells == 20_000
    assert _shuffled(spark) - before < 3 * 20_000


def test_ranges_follow_the_number_of_rows(spark):
    """Ranges are cut by every column of the order, so one common value does not stay whole."""
    rows = spark.range(1000).select(F.lit(1).alias("a"), F.col("id").alias("b"), (F.col("id") % 3).alias("v"))
    got = ranks.running(rows, ["a", "b"], {"before": F.col("v")}, each=50)
    assert len(got.inputFiles()) >= 20
    out = got.orderBy("b").collect()
    assert [(r["__rn"], r.before) for r in out] == [(i, sum(j % 3 for j in range(i))) for i in range(1000)]
    # percentiles work their input out once, however often the counts are read
    plan = profile.box_stats(rows, "v", ["a"])._jdf.queryExecution().optimizedPlan().toString()
    assert "Range (0, 1000" not in plan


def test_itemsets_agree_with_cooccurrence(spark, tmp_path):
    rows = spark.createDataFrame([(u, i) for u in range(20) for i in range(6) if (u * 7 + i * 3) % 4], "user long, item long")
    baskets = mining.baskets(rows, "user", "item")
    model = mining.fit_itemsets(baskets, 0.05, 0.1)
    pairs = {tuple(r["items"]): r.freq for r in mining.frequent_itemsets(model, 20, 2).where("size(items) = 2").collect()}
    assert pairs == {(r.item_a, r.item_b): r.n for r in profile.cooccurrence(baskets, "items").where("item_a < item_b").collect()}
    again = mining.save_model(model, str(tmp_path / "model"))
    assert mining.apply_rules(again, baskets).count() == 20
    rules = mining.association_rules(model, 0.5, 2).collect()
    assert rules and all(len(r.antecedent) >= 2 and r.confidence >= 0.5 for r in rules)
    ordered = spark.createDataFrame([(u, t, "ab"[t % 2]) for u in range(4) for t in range(4)], "user long, t long, item string")
    found = {r.label: r.freq for r in mining.sequential_patterns(ordered, "user", "item", ["t"], 0.9, 3).collect()}
    assert found["(a) -> (b) -> (a)"] == 4 and "(b) -> (b) -> (b)" not in found
    assert pd.DataFrame([r.asDict() for r in mining.patterns_by_length(mining.sequential_patterns(ordered, "user", "item", ["t"], 0.9, 2)).collect()]).set_index("length").patterns.to_dict() == {1: 2, 2: 4}


def genre_days(spark):
    rows = [(u, 0, [g for i, g in enumerate(("Action", "Comedy", "Drama", "War")) if (u * 7 + i * 3) % 4 or u % 5 == i]) for u in range(60)]
    return rows, spark.createDataFrame(rows, "user_id long, day long, items array<string>")


def test_longer_itemsets_and_rules_equal_brute_force(spark, monkeypatch):
    rows, days = genre_days(spark)
    monkeypatch.setattr(analysis, "_genre_baskets", lambda *_: days)
    count = lambda s: sum(set(s) <= set(r[2]) for r in rows)
    sets = {s: count(s) for k in (3, 4) for s in combinations(("Action", "Comedy", "Drama", "War"), k) if count(s) >= 0.005 * 60}
    label = lambda s: "[" + ",".join(f'"{x}"' for x in s) + "]"
    found = {r.label: (r.freq, r.size, r.support) for r in analysis.long_itemsets(spark, "").collect()}
    assert found == {label(s): (n, len(s), round(n / 60, 6)) for s, n in sets.items()} and max(map(len, sets)) == 4
    want = {}
    for s, n in sets.items():
        for y in s:
            x = tuple(g for g in s if g != y)
            if n / count(x) >= 0.6:
                want[label(x), label((y,))] = pytest.approx((n / count(x), n / count(x) / (count((y,)) / 60), n / 60), abs=1e-6)
    assert {(r.antecedent, r.consequent): (r.confidence, r.lift, r.support) for r in analysis.long_rules(spark, "").collect()} == want


def test_rules_applied_have_two_genres_before_the_arrow(spark, monkeypatch):
    rows, days = genre_days(spark)
    rows += [(61, 0, ["Action"]), (63, 0, ["Action", "Drama"]), (65, 0, None), (67, 0, [])]
    days = days.unionByName(spark.createDataFrame(rows[-4:], days.schema))
    monkeypatch.setattr(analysis, "_genre_baskets", lambda *_: days)
    fit = [set(r[2]) for r in rows if r[0] % 2 == 0]
    genres, count = sorted(set().union(*fit)), lambda s: sum(set(s) <= b for b in fit)

    def led_to(basket, least):
        rules = ((x, y) for k in range(least, 4) for x in combinations(sorted(basket), k) for y in genres if y not in basket)
        return sorted({y for x, y in rules if count(x) and count((*x, y)) >= max(0.01 * len(fit), 1) and count((*x, y)) / count(x) >= 0.3})

    want = {r[0]: ",".join(led_to(r[2] or (), 2)) for r in rows if r[0] % 2}
    assert want[61] == "" and want[63] and led_to(["Action"], 1)
    assert {r.user_id: r.prediction for r in analysis.rules_applied(spark, "").collect()} == want
    model = mining.fit_itemsets(days.where("user_id % 2 = 0").select("items"), 0.01, 0.3)
    plain = lambda df: {r.user_id: sorted(r.prediction) for r in df.collect()}
    assert plain(mining.apply_rules(model, days)) == plain(model.transform(days))


def test_seq_patterns_are_long_and_rare_ones_too(spark, monkeypatch):
    days = [[1, 2, 3, 4, 5, 1, 2]] * 3 + [[4, 4, 2]] + [[3]] * 96  # supports of 3 %, 1 % and 96 %
    rows = [(100 * u + i, u, r, i) for u, ratings in enumerate(days) for i, r in enumerate(ratings)]
    monkeypatch.setattr(fixtures, "events", lambda *_: spark.createDataFrame(rows, "event_id long, user_id long, rating int, timestamp long"))
    want = {}
    for ratings in days:
        for s in {s for k in range(1, len(ratings) + 1) for s in combinations(ratings, k)}:
            want[s] = want.get(s, 0) + 1
    label = lambda s: " -> ".join(f"({x})" for x in s)
    assert {r.label: (r.length, r.freq) for r in analysis.seq_patterns(spark, "").collect()} == {label(s): (len(s), n) for s, n in want.items()}
    assert max(map(len, want)) == 7


def test_rating_machine_gradient_and_real_movie_ids(spark, monkeypatch, tmp_path):
    rng = np.random.default_rng(2)
    w = [rng.normal(size=s) for s in ((1,), (3,), (3, 2), (18,), (18, 2))]
    movie, genres, n, mean = np.array([0, 2, 1]), rng.random((3, 18)), np.array([1, 4, 2]), rng.random(3)

    def loss():
        v = np.concatenate([w[2], w[4]])
        x = np.concatenate([np.eye(3)[movie], genres], 1)
        pairs = sum(np.outer(x[:, i] * x[:, j], v[i] @ v[j])[:, 0] for i in range(21) for j in range(i))
        return (n * (w[0] + x @ np.concatenate([w[1], w[3]]) + pairs - mean) ** 2).sum()

    a, b, c, d, e = machine.gradient(w, movie, genres, n, mean)
    for at, got in ((0, a), (3, b), (4, c), (1, d[[0, 2, 1]]), (2, e[[0, 2, 1]])):
        for place in np.ndindex(w[at].shape):
            w[at][place] += 1e-5
            up = loss()
            w[at][place] -= 2e-5
            assert got[place] == pytest.approx((up - loss()) / 2e-5, rel=1e-4, abs=1e-4)
            w[at][place] += 1e-5
    # movies 500 apart, of one genre, with opposite ratings; one id is beyond an int
    ids = [7, 507, 10**10, 10**10 + 500]
    rows = [(u, m, 5 if k % 2 else 1, u, "Drama", u, k, m, u) for u in range(60) for k, m in enumerate(ids)]
    joined = spark.createDataFrame(rows, "user_id long, movie_id long, rating int, timestamp long, genres string, l_orderkey long, l_linenumber long, l_partkey long, l_suppkey long")
    monkeypatch.setattr(analysis, "_joined", lambda *_: joined)
    out = analysis.fm_rating(spark, "").collect()
    assert sorted(r.factors for r in out) == [2, 4] and sum(r.best for r in out) == 1 and all(r.rmse < 0.1 for r in out)
    held = {r.movie_id: r.n for r in analysis._rated_features(spark, "").where("held").groupBy("movie_id").agg(F.count("*").alias("n")).collect()}
    assert set(held) == set(ids) and 0 < sum(held.values()) < 120
    model = models.fit_rating(analysis._rated_features(spark, "").where("not held"), factors=2)
    model.save(str(tmp_path / "machine"))
    asked = models.genre_vectors(analysis._rated_features(spark, "").select("genres").limit(1).crossJoin(spark.createDataFrame([(7,), (507,), (8,)], "movie_id long")))
    for m in (model, models.RatingMachine.load(spark, str(tmp_path / "machine"))):
        got = {r.movie_id: r.prediction for r in models.score_batches(asked, m).collect()}
        assert got[7] < 0.2 and got[507] > 0.8 and 0.2 < got[8] < 0.8  # a new movie rests on its genres


def test_exact_percentiles_by_group(spark):
    rng = np.random.default_rng(6)
    data = [(k, float(v)) for k in ("a", "b", None) for v in rng.integers(0, 40, size=rng.integers(1, 300))] + [("a", None), ("c", None)]
    df = spark.createDataFrame(data, "k string, v double")
    ps = [0.0, 0.2, 0.5, 0.99, 1.0]
    got = {r.k: (r.n, list(r.q)) for r in profile.exact_percentiles(df, "v", ps, ("k",)).collect()}
    for k in ("a", "b", None):
        values = [v for g, v in data if g == k and v is not None]
        assert got.pop(k) == (len(values), pytest.approx(np.percentile(values, [100 * p for p in ps])))
    assert got == {}  # a group without values
    assert profile.exact_percentiles(df.where("false"), "v", ps).first().q == [None] * 5
    assert [r.value for r in profile.percentiles(spark.range(1, 100_001).select(F.col("id").cast("double").alias("x")), "x", [50]).collect()] == [50_000.5]


def test_a_worse_candidate_is_not_approved(spark):
    rows = [(u, m, 1.0 if m == 1 else 0.0) for u in range(40) for m in (1, 2)]
    df = models.genre_vectors(spark.createDataFrame(rows, "user_id long, movie_id long, rating float").withColumn("genres", F.expr("transform(sequence(1, 18), x -> float(0))")))
    good = models.fit_rating(df, factors=2)
    bad = models.fit_rating(df.withColumn("rating", 1 - F.col("rating")), factors=2)

    def errors(model):
        e = ranking.error_metrics(models.clipped(models.score_batches(df, model)), "rating", "prediction").first()
        return {"rmse": -float(e["rmse"]), "count": float(e["n"])}

    verdict, model = models.approve(bad, good, errors, {"rmse": -0.5, "count": 10.0}, df)
    assert model is good and all(r.passed for r in verdict.collect())
    verdict, model = models.approve(good, bad, errors, {"rmse": -2.0}, df)
    assert model is good and {r.metric: r.passed for r in verdict.collect()} == {"rmse": False, "count": True}
    verdict, model = models.approve(bad, good, errors, {"count": 1000.0}, df)  # better, on too few rows
    assert model is bad and {r.metric: r.passed for r in verdict.collect()} == {"rmse": True, "count": False}


def test_features_keep_large_ids_apart(spark):
    from tastemill.functions.features import featurize, metadata_features

    big = 1 << 24
    rows = spark.createDataFrame([(big + i, big + 1 - i, 3, 978300760 + i, "F", 25, 1, "War|Drama") for i in range(2)], "user_id long, movie_id long, rating int, timestamp long, gender string, age int, occupation int, genres string")
    assert {(r.user_id, r.movie_id) for r in featurize(rows).collect()} == {(big, big + 1), (big + 1, big)}
    assert len({r.sec_into_yr for r in featurize(rows).collect()}) == 2
    assert {r.movie_id for r in metadata_features(rows).collect()} == {big, big + 1}


def test_sessions_end_after_a_gap(spark, tmp_path):
    for i, times in enumerate((["2024-01-01 01:00", "2024-01-01 01:20", "2024-01-01 03:00"], ["2024-01-03 00:00"])):
        spark.createDataFrame([(1, t) for t in times], "user long, t string").select("user", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(str(tmp_path / "in" / str(i)))
        stream = spark.readStream.schema("user long, ts timestamp").parquet(f"{tmp_path}/in/*")
        out = jobs.run_available(jobs.stream_sessions(stream, "user", "ts"), str(tmp_path / "out"), str(tmp_path / "state"))
    assert sorted((r.start, r.n) for r in out.select(F.date_format("start", "HH:mm").alias("start"), "n").collect()) == [("01:00", 2), ("03:00", 1)]


def test_top_k_of_empty_sides_and_constraints(spark):
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "item long, vector array<double>")
    asked = items.withColumnRenamed("item", "qid")
    assert ranking.top_k(asked.where("false"), items, 2).count() == ranking.top_k(asked, items.where("false"), 2).count() == 0
    df = spark.createDataFrame([("a", 1, [1.0]), (None, 2, [1.0])], "s string, i int, v array<double>")
    got = {r.feature: (r.type, r.min_fraction, r.min_count, r.shape, r.domain) for r in profile.infer_constraints(df, 5).collect()}
    assert got == {"s": ("string", 0.5, 1, 1, ["a"]), "i": ("int", 1.0, 1, 1, None), "v": ("array", 1.0, 1, 1, None)}


def test_vertical_sets_and_rules(spark):
    """Against all subsets of each basket; owners past a word of 64, a repeated row, nulls, and a group of its own."""
    rng = np.random.default_rng(3)
    rows = [(g, f"u{u}", int(i)) for g in ("a", "b") for u in range(150) for i in np.unique(rng.integers(0, 7 if g == "a" else 12, rng.integers(1, 7)))]
    df = spark.createDataFrame([*rows, rows[0], ("a", None, 1), ("a", "u1", None), (None, "u1", 3), (None, "u2", 3)], "g string, u string, i int")
    for size in (None, 2):
        want = {}
        for g in ("a", "b", None):
            baskets = {}
            for h, u, i in [*rows, (None, "u1", 3), (None, "u2", 3)]:
                if h == g:
                    baskets.setdefault(u, set()).add(i)
            for b in baskets.values():
                for k in range(1, (size or 6) + 1):
                    for s in combinations(sorted(b), k):
                        want[g, s] = want.get((g, s), 0) + 1
            want = {k: n for k, n in want.items() if k[0] != g or n >= 0.1 * len(baskets)}
        sets = vertical.frequent_sets(df, ["g"], "u", "i", 0.1, size)
        assert {(r.g, tuple(r["items"])): r.freq for r in sets.collect()} == want
    alone = vertical.frequent_sets(df.where("g = 'a'"), [], "u", "i", 0.1, 2).collect()
    assert {("a", tuple(r["items"])): r.freq for r in alone} == {k: n for k, n in want.items() if k[0] == "a"}
    rules = vertical.set_rules(sets, ["g"], 0.3, 1).collect()
    assert {(r.g, tuple(r.antecedent), r.consequent): r.confidence for r in rules} == {
        (g, (x,), y): pytest.approx(want[g, s] / want[g, (x,)]) for (g, s) in want if len(s) == 2 for x, y in (s, s[::-1]) if want[g, s] / want[g, (x,)] >= 0.3
    }
    assert vertical.frequent_sets(df.where("false"), ["g"], "u", "i").count() == 0


def test_vertical_sequences(spark):
    """Against the subsequences of each owner, with repeated items and equal times."""
    rng = np.random.default_rng(5)
    rows = [(f"u{u}", t // 2, t, "abcd"[rng.integers(4)]) for u in range(40) for t in range(rng.integers(1, 8))]
    df = spark.createDataFrame(rows, "u string, t int, k int, i string")
    want = {}
    for u in {r[0] for r in rows}:
        items = [r[3] for r in sorted(rows, key=lambda r: r[1:]) if r[0] == u]
        for s in {c for k in range(1, 8) for c in combinations(items, k)}:
            want[s] = want.get(s, 0) + 1
    got = vertical.frequent_sequences(df, [], "u", "i", ["t", "k"], 0.1).collect()
    assert {tuple(r["items"]): r.freq for r in got} == {s: n for s, n in want.items() if n >= 4}
    assert max(r.length for r in got) >= 3
    short = vertical.frequent_sequences(df, [], "u", "i", ["t", "k"], 0.1, 2).collect()
    assert max(r.length for r in short) == 2


def test_search_skips_blocks_and_loses_nothing(spark):
    """Norms over several powers of two, ties, negative scores, fewer items than k; most blocks are skipped."""
    rng = np.random.default_rng(8)
    items = rng.normal(size=(300, 6)) * 2.0 ** rng.integers(-6, 4, 300)[:, None]
    items[5] = items[9]
    asked = np.vstack([rng.normal(size=(19, 6)), np.zeros(6)])
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], f"{name} long, vector array<double>")
    for k, each in ((3, 480), (400, 2000)):
        search = retrieval.Search(frame(asked, "qid"), frame(items, "item"), k, each)
        got = {(r.qid, r.rank): r.item for r in search.result().collect()}
        for q, v in enumerate(asked):
            s = items @ v
            best = sorted(range(300), key=lambda i: (-s[i], i))[:k]
            assert [got[q, r + 1] for r in range(len(best))] == best
        pairs = search.pairs().collect()
        assert all(r.scanned + r.skipped == search.n_items for r in pairs)
        if k == 3:
            assert sum(r.queries_sent for r in pairs) < 0.5 * 20 * search.n_items and max(r.skipped for r in pairs) > 0


def test_catalogue_ranks_and_biases(spark):
    rng = np.random.default_rng(2)
    items, asked = rng.normal(size=(50, 4)), rng.normal(size=(7, 4))
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(m)], f"{name} long, vector array<double>, bias double")
    pairs = [(q, int(i)) for q in range(7) for i in rng.choice(50, 4, replace=False)]
    seen = [(q, int(i)) for q in range(7) for i in rng.choice(50, 10, replace=False)]
    known = spark.createDataFrame([*pairs, (99, 1), (1, 99)], "qid long, item long")
    for block in (200, 1 << 20):
        got = retrieval.catalogue_ranks(known, frame(asked, "qid"), frame(items, "item"), "bias", spark.createDataFrame(seen, "qid long, item long"), block).collect()
        want = {}
        for q, i in set(pairs):
            s = items @ asked[q] + np.arange(50) % 3
            want[q, i] = sum(s[j] >= s[i] - 1e-6 for j in range(50) if j == i or (q, j) not in seen)
        assert {(r.qid, r.item): r["rank"] for r in got} == want
    chance = retrieval.random_metrics(1000)
    assert chance["recall"] == 0.02 and chance["mrr"] == pytest.approx(sum(1 / r for r in range(1, 21)) / 1000)
    rows = [(u, m, 1 + (u * 3 + m * 5) % 5) for u in range(20) for m in range(15) if (u + m) % 3]
    mean, users, movies = retrieval.rating_biases(spark.createDataFrame(rows, "user_id long, movie_id long, rating int"), 30)
    bu, bm = {r.user_id: r.bias for r in users.collect()}, {r.movie_id: r.bias for r in movies.collect()}
    assert mean == pytest.approx(np.mean([r for *_, r in rows]))
    for m in range(15):  # a fixed point
        own = [r - mean - bu[u] for u, n, r in rows if n == m]
        assert bm[m] == pytest.approx(sum(own) / (len(own) + 25), abs=1e-6)


def test_sketches_merge_as_one_scan(spark):
    rng = np.random.default_rng(1)
    data = [(("a", "b")[i % 2], ("x", "y", "z")[i % 3], int(v), None if i % 7 == 0 else f"k{int(v) % 50}", float("nan") if False else None if i % 5 == 0 else float(v) / 3) for i, v in enumerate(rng.integers(0, 9000, 12_000))]
    df = spark.createDataFrame(data, "split string, version string, n int, s string, x double")
    table = sketches.sketched(df, ["split", "version"])
    got = {(r.split, r.feature): r for r in sketches.statistics(sketches.merged(table, ["split"])).collect()}
    for split in "ab":
        own = pd.DataFrame([d for d in data if d[0] == split], columns=["split", "version", "n", "s", "x"])
        for c in ("n", "x"):
            r, v = got[split, c], own[c].dropna()
            assert (r.n, r.missing, r.min, r.max) == (len(own), int(own[c].isna().sum()), v.min(), v.max())
            assert (r["mean"], r["std"]) == pytest.approx((v.mean(), v.std()))
            assert r.distinct == pytest.approx(v.nunique(), rel=4 * sketches.DISTINCT_ERROR)
            for q, estimate in ((0.25, r.q25), (0.5, r.median), (0.75, r.q75)):
                assert abs((v <= estimate).mean() - q) < 2 * sketches.RANK_ERROR
        r = got[split, "s"]
        assert (r.n, r.missing, r.distinct, r["mean"], r["std"], r.median) == (len(own), int(own.s.isna().sum()), 50, None, None, None)
    both = sketches.overlaps(sketches.merged(table, ["split"]), "split", "n").collect()
    sets = [{d[2] for d in data if d[0] == s} for s in "ab"]
    assert len(both) == 1 and both[0].in_both == pytest.approx(len(sets[0] & sets[1]), abs=4 * sketches.OVERLAP_ERROR * len(sets[0] | sets[1]))
    top = {(r.split, r.place): (r.value, r.n) for r in sketches.top_texts(df.drop("version"), ["split"], 3).collect() if r.feature == "s"}
    counts = sorted(((-n, k) for k, n in pd.Series([d[3] for d in data if d[0] == "a"]).value_counts().items()))[:3]
    assert [top["a", i + 1] for i in range(3)] == [(k, -n) for n, k in counts]


def test_merged_spreads_keep_their_digits(spark):
    """Values far from zero: a difference of sums of squares would leave nothing of the spread."""
    rows = spark.range(2000).select(F.lit("a").alias("split"), (F.col("id") % 3).cast("string").alias("version"), (1_000_000_000_000 + F.col("id")).alias("n"), F.when(F.col("id") < 0, 1).alias("none"))
    got = {r.feature: r for r in sketches.statistics(sketches.merged(sketches.sketched(rows, ["split", "version"]), ["split"])).collect()}
    assert got["n"]["std"] == pytest.approx(math.sqrt(2000 * 2001 / 12), rel=1e-6)
    assert got["n"]["mean"] == 1_000_000_000_999.5
    assert (got["none"].missing, got["none"]["mean"], got["none"]["std"]) == (2000, None, None)
    exact = {r.feature: r.distinct for r in sketches.distinct_cells(rows.drop("version"), ["split"]).collect()}
    assert exact == {"n": 2000}


def test_a_bridge_shuffles_the_fact_once(spark):
    """Same rows and errors as the fact's own join with the dimension, which meets the bridge instead."""
    fact = spark.createDataFrame([(1, 5), (1, 6), (2, 7), (9, 8)], "line long, part long")
    bridge = spark.createDataFrame([(1, 10), (2, 20), (3, 30)], "order long, user long")
    people = spark.createDataFrame([(10, "a"), (20, "b")], "user long, name string")
    on = ("line", "order")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        # the order 3 has no line, so its user may be missing
        out = joins.join_over(fact, bridge, on, people, "user")
        assert sorted(tuple(r) for r in out.collect()) == [(1, 5, 10, "a"), (1, 6, 10, "a"), (2, 7, 20, "b")]
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(line#") == 1 and plan.count("Exchange hashpartitioning(user#") == 2  # bridge and dimension
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert joins.join_over(fact, bridge, on, people, "user").count() == 3
    for bad in (people.where("user = 10"), people.unionByName(people)):
        with pytest.raises(Exception, match="user without exactly one right row"):
            joins.join_over(fact, bridge, on, bad, "user").count()


def test_merged_stats_join_the_ratings_once(spark, monkeypatch):
    seen, versions = spark.sparkContext.accumulator(0), study._versions

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    monkeypatch.setattr(study, "_versions", lambda *a: (rows := versions(*a)).mapInArrow(counted, rows.schema))
    small = "/root/testdata/sf0.001"
    out = study.merged_stats(spark, small).collect()
    assert len(out) == 24 and all(r.distinct_ok and r.median_ok for r in out)
    assert seen.value == sum(r.n for r in out if r.feature == "rating")


def test_halving_and_single_features(spark):
    seen = []

    def score(share, a):
        seen.append((share, a))
        return -abs(a - 3) * share

    found = models.halving([{"a": a} for a in range(8)], score, [0.25, 0.5, 1.0])
    assert [sum(r[0] == rung for r in found) for rung in range(3)] == [8, 4, 2]
    assert [r[2] for r in found if r[0] == 2 and r[4]] == [{"a": 3}] and len(seen) == 14
    rows = spark.createDataFrame([(i, float(i % 4), float(i % 2), i // 50) for i in range(400)], "i long, y double, f double, chunk long")
    out = models.estimate_by_feature(rows.where("i < 200"), rows.where("i >= 200"), ["f", "i"], "y", "f").collect()
    assert {r.feature for r in out} == {"f", "i"} and all(r.n == 50 for r in out)
    for r in out:
        if r.feature == "f":  # errors are 0 or 2, half of each, whatever the value
            assert (r.mae, r.rmse) == pytest.approx((1.0, math.sqrt(2)))


def test_losses_rank_once(spark):
    _, df = vectors(spark)
    ranks = ranking.inbatch_ranks(df, "batch", "id", "q", "c", "mask", "w")
    out = ranking.inbatch_losses(ranks)
    assert out._jdf.queryExecution().executedPlan().toString().count("FlatMapGroupsIn") == 1
    assert {r.kind: r.loss for r in out.collect()} == {k: pytest.approx(ranking.inbatch_loss(ranks, k).first().loss) for k in ranking.LOSSES}


def test_ranks_up_to_a_place_are_settled_early(spark):
    rng = np.random.default_rng(4)
    items, asked = rng.normal(size=(600, 4)) * rng.uniform(0.1, 3, size=(600, 1)), rng.normal(size=(9, 4))
    frame = lambda m, name: spark.createDataFrame([(i, v.tolist(), float(i % 3)) for i, v in enumerate(m)], f"{name} long, vector array<double>, bias double")
    known = spark.createDataFrame([(q, int(i)) for q in range(9) for i in np.argsort(-(items @ asked[q]))[[0, 3, 9, 15, 30, 300]]], "qid long, item long")
    seen = spark.createDataFrame([(q, int(i)) for q in range(9) for i in rng.choice(600, 60, replace=False)], "qid long, item long")
    for own in (seen, None):
        every = {(r.qid, r.item): r for r in retrieval.catalogue_ranks(known, frame(asked, "qid"), frame(items, "item"), "bias", own).collect()}
        for head in (4, 4096):  # three rounds, and one
            part = retrieval.catalogue_ranks(known, frame(asked, "qid"), frame(items, "item"), "bias", own, upto=5, head=head).collect()
            assert {(r.qid, r.item): min(r["rank"], 6) for r in part} == {k: min(r["rank"], 6) for k, r in every.items()} and len(part) == 54
            assert all(r.score == pytest.approx(every[r.qid, r.item].score) for r in part)


def test_counting_holds_few_scores_at_once(spark, monkeypatch):
    import pyarrow as pa

    rng, held = np.random.default_rng(5), []
    q = pa.table({"qid": np.arange(300) // 3, "item": np.arange(300), "score": rng.normal(size=300), "vector": [[float(i // 3)] for i in range(300)]})
    items = pa.table({"item": np.arange(50), "vector": rng.normal(size=(50, 1)).tolist()})
    want = retrieval._reached(q, items, 0.0)["n"].to_pylist()
    monkeypatch.setattr(retrieval, "SCORES", 8 * 50 * 7)
    count = np.count_nonzero
    monkeypatch.setattr(np, "count_nonzero", lambda a, axis: held.append(a.shape) or count(a, axis=axis))
    assert retrieval._reached(q, items, 0.0)["n"].to_pylist() == want
    assert max(n for n, _ in held) == 7


def test_an_item_sets_one_timer_a_batch():
    import types

    timers, gaps = [], jobs.ItemGaps(0.1)
    cell = types.SimpleNamespace(value=None)
    gaps.handle = types.SimpleNamespace(registerTimer=timers.append)
    gaps.folded = types.SimpleNamespace(exists=lambda: cell.value is not None, get=lambda: cell.value, update=lambda v: setattr(cell, "value", v))
    held = types.SimpleNamespace(value=[])
    gaps.pending = types.SimpleNamespace(get=lambda: iter(held.value), put=lambda v: setattr(held, "value", v))
    rows = lambda steps: iter([pd.DataFrame({"step": steps, "at": [1000 * s for s in steps]})])
    first = list(gaps.handleInputRows((1,), rows(range(1, 301)), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 0)))
    then = list(gaps.handleInputRows((1,), rows([301, 303]), types.SimpleNamespace(getCurrentWatermarkInMs=lambda: 250_000)))
    assert len(timers) == 2 and timers == [300_001, 303_001]
    assert [len(held.value), cell.value[:2]] == [53, (249, 249)]
    assert first[0].n[0] == 300 and (then[0].n[0], then[0].b[0]) == (302, pytest.approx(folded([*range(1, 302), 303], 0.1)))


def test_stream_popularity_where_times_do_not_order_the_steps(spark, tmp_path):
    rows = spark.range(4000).select(F.col("id").alias("event_id"), F.timestamp_seconds(F.pmod(F.col("id"), F.lit(1000)) * 2592).cast("timestamp_ntz").alias("ts"), F.format_string('{"k": %d}', F.col("id") % 7).alias("props"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    got = {r.item: (r.n, r.last_step, r.b) for r in analysis.stream_popularity(spark, str(tmp_path)).collect()}
    for item in range(7):
        steps = {i // 50 + 1 for i in range(item, 4000, 7)}
        assert got[item] == (len(steps), max(steps), pytest.approx(folded(steps, 0.1), abs=1e-6))


def test_best_of_a_block_holds_few_scores_at_once(monkeypatch):
    import pyarrow as pa

    rng, held = np.random.default_rng(6), []
    vectors_, asked = rng.integers(-2, 3, size=(60, 3)).astype(float), rng.integers(-2, 3, size=(40, 3)).astype(float)  # many ties
    items, q = pa.table({"item": np.arange(60)[::-1], "vector": vectors_[::-1].tolist()}), pa.table({"qid": np.arange(40), "vector": asked.tolist()})
    monkeypatch.setattr(retrieval, "SCORES", 8 * 60 * 7)
    part = np.partition
    monkeypatch.setattr(np, "partition", lambda a, *rest, **more: held.append(len(a)) or part(a, *rest, **more))
    got = retrieval._best(q, items, 5)
    want = [(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(60), -(vectors_ @ asked[i])))[:5]]
    assert list(zip(got["qid"].to_pylist(), got["item"].to_pylist(), strict=True)) == want
    assert max(held) == 7
    assert retrieval._best(q, items.slice(0, 3), 5).num_rows == 120


def test_many_distinct_keys_are_dealt_before_they_are_grouped(spark):
    from tastemill.operators import joins

    rows = spark.range(1000).select((F.col("id") % 300).alias("a"))
    got = joins.dataset_diff(rows, rows.where("a < 200"), ["a"], 9)
    assert {(r.a, r.n_a, r.n_b) for r in got.collect()} == {(i, 4 if i < 100 else 3, 0) for i in range(200, 300)}
    assert ranks.in_parts(rows, ["a"], 9).rdd.getNumPartitions() == 9 and ranks.in_parts(rows, ["a"], 3) is rows
    plan = got._jdf.queryExecution().executedPlan().toString()
    plan = plan.split("Initial Plan")[0]
    assert plan.count("HashAggregate") == 2 and "REPARTITION_BY_NUM" in plan  # no partial count before the rows are dealt


def test_top_by_rating_in_parts(spark, monkeypatch):
    from tastemill.plans import relations

    parts = []
    monkeypatch.setattr(fixtures, "rating_parts", lambda *_: 9)
    monkeypatch.setattr(relations, "in_parts", lambda df, keys, n: parts.append((keys, n)) or ranks.in_parts(df, keys, n))
    got = relations.top_by_rating(spark, "/root/testdata/sf0.001").collect()
    assert parts == [(["rating", "movie_id"], 9)] and all(r.place <= 20 for r in got) and {r.rating for r in got} == {1, 2, 3, 4, 5}


def test_item_biases_are_the_first_half_round(spark):
    rows = spark.createDataFrame([(u, m, 1 + (u * 3 + m * 5) % 5) for u in range(20) for m in range(15) if (u + m) % 3], "user_id long, movie_id long, rating int")
    mean, items = retrieval.item_biases(rows)
    want, _, first = retrieval.rating_biases(rows, 1)
    assert mean == want and {r.movie_id: r.bias for r in items.collect()} == pytest.approx({r.movie_id: r.bias for r in first.collect()})


def test_halves_are_chunked_in_one_order(spark):
    rows = spark.range(101).select(((F.col("id") * 37) % 101).alias("t"))
    got = {r.t: (r.period, r.chunk) for r in models.halves(rows, ["t"], 20).collect()}
    parts = models.halves(rows, ["t"])
    assert {r.t: r.period for r in parts.collect()} == {t: p for t, (p, _) in got.items()}
    want = {r.t: r.chunk for r in models.chunked(parts.where("period = 'analysis'"), ["t"], 20).collect()}
    assert {t: c for t, (p, c) in got.items() if p == "analysis"} == want and all(c is None for p, c in got.values() if p == "reference")


def test_scores_are_compiled(spark):
    rng = np.random.default_rng(7)
    shared, own, g = rng.normal(size=1 + machine.WIDTH * 3), rng.normal(size=3), rng.normal(size=machine.WIDTH)
    movies = spark.createDataFrame([(1, own.tolist())], "movie_id long, weights array<double>")
    out = machine.RatingMachine(movies, shared.tolist(), 2).transform(spark.createDataFrame([(1, g.tolist()), (2, g.tolist())], "movie_id long, genre_weights array<double>"))
    assert "lambdafunction" not in out._jdf.queryExecution().optimizedPlan().toString()
    _, w, v = machine._shared(shared, 2)
    for r in out.collect():
        mine = own if r.movie_id == 1 else np.zeros(3)
        pairs = ((mine[1:] + g @ v) ** 2 - mine[1:] ** 2 - (g**2) @ (v**2)).sum() / 2
        assert r.prediction == pytest.approx(shared[0] + mine[0] + g @ w + pairs)


def test_a_trial_leaves_no_tables(spark, monkeypatch):
    """What a trial of the search keeps goes with it; else the folder holds the tables of all trials."""
    monkeypatch.setattr(study.models, "halving", lambda grid, score, shares: [(0, 1.0, grid[0], score(share=1.0, **grid[0]), True)])
    folder = Path(shared_folder(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    assert study.search_by_ndcg(spark, "/root/testdata/sf0.001").count() == 1
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert {"search-rows", "search-parts"} <= left <= {"search-rows", "search-parts", "running", "running-input"}


def test_passing_deletes_what_is_kept_inside(spark):
    outside = kept(spark.range(5), "outside")
    with passing(spark):
        inside = kept(spark.range(7), "inside")
        with passing(spark):
            innermost = kept(spark.range(9), "inside")
        assert inside.count() == 7 and not os.path.exists(innermost.inputFiles()[0].removeprefix("file://"))
    assert outside.count() == 5 and not os.path.exists(inside.inputFiles()[0].removeprefix("file://"))
    with ThreadPoolExecutor(1) as pool, passing(spark):  # other threads' tables are theirs
        other = pool.submit(lambda: kept(spark.range(3), "other")).result()
    assert other.count() == 3
