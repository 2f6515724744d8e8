"""Registered queries on continuous dependence, mining of movies, retrieval over the catalogue and merged statistics."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.operators import joins, mining, models, popularity, profile, ranking, retrieval, scoring, sketches, vertical
from tastemill.plans import fixtures
from tastemill.plans.analysis import R, _guessed, _round
from tastemill.plans.relations import ORACLES, TIME_ORDER, query
from tastemill.sources import delimited, shards, sinks
from tastemill.sources.folders import kept, passing, release, shared_path

# each of the few quantities against all prices, by running sums in the order of price
_PRICES = """
WITH raw AS (SELECT l_quantity AS x, l_extendedprice AS y FROM lineitem), mean AS (SELECT avg(x) AS mx, avg(y) AS my FROM raw),
c AS (SELECT x - mx AS x, y - my AS y, count(*)::double AS w FROM raw, mean GROUP BY ALL), v AS (SELECT x AS x2, sum(w) AS t0, sum(w * y) AS ty FROM c GROUP BY x),
k AS (SELECT x, y, w, x2, t0, ty, sum(CASE WHEN x = x2 THEN w ELSE 0 END) OVER u AS k0, sum(CASE WHEN x = x2 THEN w * y ELSE 0 END) OVER u AS ky FROM c, v WINDOW u AS (PARTITION BY x2 ORDER BY y)),
b AS (SELECT x, y, w, sum(abs(x - x2) * t0) AS ra, sum(2 * (y * k0 - ky) + ty - y * t0) AS rb, sum(abs(x - x2) * (2 * (y * k0 - ky) + ty - y * t0)) AS ab FROM k GROUP BY x, y, w),
s AS (SELECT sum(w) AS n, sum(w * ra) AS sa, sum(w * rb) AS sb, sum(w * ab) AS sab, 2 * (sum(w) * sum(w * x * x) - pow(sum(w * x), 2)) AS saa, 2 * (sum(w) * sum(w * y * y) - pow(sum(w * y), 2)) AS sbb, sum(w * ra * rb) AS mab, sum(w * ra * ra) AS maa, sum(w * rb * rb) AS mbb, count(*) AS cells FROM b),
d AS (SELECT n, cells, sab / pow(n, 2) - 2 * mab / pow(n, 3) + sa * sb / pow(n, 4) AS vab, saa / pow(n, 2) - 2 * maa / pow(n, 3) + sa * sa / pow(n, 4) AS vaa, sbb / pow(n, 2) - 2 * mbb / pow(n, 3) + sb * sb / pow(n, 4) AS vbb FROM s)
SELECT CAST(n AS bigint) AS n, cells, round(sqrt(vab), 3) AS dcov, round(sqrt(vab / sqrt(vaa * vbb)), 6) AS dcor FROM d"""


@query(_PRICES, views=False)
def distance_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance correlation of quantity and price, of which nearly every row has another pair."""
    out = profile.distance_correlation(fixtures.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice")
    return out.select("n", "cells", F.round("dcov", 3).alias("dcov"), F.round("dcor", R).alias("dcor"))


# sets grow by a larger item as long as enough users of the rating hold them
_SETS = """
, t AS (SELECT DISTINCT rating, user_id, movie_id AS m FROM fx_events), n AS (SELECT rating, count(DISTINCT user_id) AS n FROM t GROUP BY rating),
g AS (SELECT rating, user_id, [m] AS items, m AS last FROM t JOIN n USING (rating) QUALIFY count(*) OVER (PARTITION BY rating, m) >= ceil({s} * n)
 UNION ALL SELECT g.rating, g.user_id, list_append(items, m), m FROM g JOIN t ON t.rating = g.rating AND t.user_id = g.user_id AND t.m > g.last JOIN n ON n.rating = g.rating QUALIFY count(*) OVER (PARTITION BY g.rating, list_append(items, m)) >= ceil({s} * n)),
f AS (SELECT rating, items, len(items) AS size, count(*) AS freq FROM g GROUP BY rating, items)"""


def _recursive(sql: str) -> str:
    return sql.replace("WITH ", "WITH RECURSIVE ", 1)


def _movie_sets(spark: SparkSession, sf_dir: str, support: float = 0.02) -> DataFrame:
    return vertical.frequent_sets(fixtures.events(spark, sf_dir), ["rating"], "user_id", "movie_id", support)


def _items(column: str):
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",")


@query(_SETS.format(s=0.02) + """
SELECT rating, array_to_string(items, ',') AS items, CAST(size AS int) AS size, freq, round(freq / n, 6) AS support FROM f JOIN n USING (rating)""")
def movie_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sets of movies, of any size, that a fiftieth of the users of a rating share."""
    out = _movie_sets(spark, sf_dir)
    return out.select("rating", _items("items").alias("items"), "size", "freq", F.round("support", R).alias("support"))


@query(_SETS.format(s=0.02) + """
, r AS (SELECT rating, items, freq, unnest(items) AS y FROM f WHERE size >= 3)
SELECT r.rating, array_to_string(p.items, ',') AS antecedent, y AS consequent, round(r.freq / p.freq, 6) AS confidence, round(r.freq / p.freq / (q.freq / n), 6) AS lift, round(r.freq / n, 6) AS support
FROM r JOIN n USING (rating) JOIN f p ON p.rating = r.rating AND p.items = list_filter(r.items, lambda x: x <> y) JOIN f q ON q.rating = r.rating AND q.items = [y] WHERE r.freq / p.freq >= 0.6""")
def movie_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from two movies and more to another, within a rating."""
    out = vertical.set_rules(_movie_sets(spark, sf_dir), ["rating"], 0.6, 2)
    return out.select("rating", _items("antecedent").alias("antecedent"), "consequent", *(F.round(c, R).alias(c) for c in ("confidence", "lift", "support")))


@query("""
, t AS (SELECT rating, user_id, movie_id AS m, row_number() OVER (ORDER BY timestamp, event_id) AS pos FROM fx_events), n AS (SELECT rating, count(DISTINCT user_id) AS n FROM t GROUP BY rating),
g AS (SELECT rating, user_id, [m] AS items, min(pos) AS ends FROM t JOIN n USING (rating) GROUP BY rating, user_id, m, n QUALIFY count(*) OVER (PARTITION BY rating, m) >= ceil(0.02 * n)
 UNION ALL SELECT g.rating, g.user_id, list_append(items, m) AS items, min(pos) AS ends FROM g JOIN t ON t.rating = g.rating AND t.user_id = g.user_id AND t.pos > g.ends JOIN n ON n.rating = g.rating GROUP BY g.rating, g.user_id, items, m, n QUALIFY count(*) OVER (PARTITION BY g.rating, list_append(items, m)) >= ceil(0.02 * n))
SELECT rating, array_to_string(items, ' > ') AS items, CAST(len(items) AS int) AS length, count(*) AS freq FROM g GROUP BY ALL""")
def movie_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies in the order of time, of any length, that a fiftieth of the users of a rating share."""
    out = vertical.frequent_sequences(fixtures.events(spark, sf_dir), ["rating"], "user_id", "movie_id", ["timestamp", "event_id"], 0.02)
    return out.select("rating", F.array_join(F.transform("items", lambda x: x.cast("string")), " > ").alias("items"), "length", "freq")


for _name in ("movie_itemsets", "movie_rules", "movie_sequences"):
    ORACLES[_name] = _recursive(ORACLES[_name])


# vectors of ten lengths, so that blocks by norm differ
_SCALED = "WITH e AS (SELECT vec_id, list_transform(CAST(embedding AS double[]), lambda x: x * pow(2, label)) AS v, CAST(embedding AS double[]) AS q, label FROM embeddings)"


def _scaled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = fixtures.table(spark, sf_dir, "embeddings")
    items = rows.select(F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x * F.pow(F.lit(2.0), F.col("label"))).alias("vector"))
    return rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector")), items


def _search(spark: SparkSession, sf_dir: str) -> retrieval.Search:
    """A search in about sixteen blocks of items."""
    queries, items = _scaled(spark, sf_dir)
    return retrieval.Search(queries, items, 10, max(1, items.count() * 64 * 8 // 16))


@query(_SCALED + """
, s AS (SELECT q.vec_id AS qid, i.vec_id AS item, list_dot_product(q.q, i.v) AS score FROM e q JOIN e i ON q.vec_id % 20 = 0), r AS (SELECT qid, item, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""", views=False)
def topk_by_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top k of items of very different lengths, most blocks of which no query has to meet."""
    return _round(_search(spark, sf_dir).result(), "score")


@query()
def topk_blocks_skipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many blocks of items each block of queries met in topk_by_norm, and how many it skipped."""
    return _search(spark, sf_dir).pairs()


@query("""
WITH e AS (SELECT vec_id, CAST(embedding AS double[]) AS v, label / 100.0::double AS bias, count(*) OVER () AS n FROM embeddings),
k AS (SELECT q.vec_id AS qid, q.v, i.vec_id AS item, list_dot_product(q.v, i.v) + i.bias AS score FROM e q JOIN e i ON i.vec_id = (q.vec_id * 7 + 3) % q.n WHERE q.vec_id % 20 = 0)
SELECT qid, item, count(*) FILTER (list_dot_product(k.v, e.v) + e.bias >= score - 1e-6) AS rank, round(score, 6) AS score FROM k, e GROUP BY qid, item, score""", views=False)
def catalogue_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of one known item for each query among all items."""
    rows = fixtures.table(spark, sf_dir, "embeddings")
    n = rows.count()
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    items = rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), (F.col("label") / 100.0).alias("bias"))
    out = retrieval.catalogue_ranks(queries.select("qid", ((F.col("qid") * 7 + 3) % n).alias("item")), queries, items, "bias")
    return out.select("qid", "item", "rank", F.round("score", R).alias("score"))


def _bias_sql(rounds: int) -> str:
    """Alternating shrunken means, a table for each half round."""
    sql = ", r AS (SELECT user_id, movie_id, rating::double AS rating FROM fx_ratings), m AS (SELECT avg(rating) AS mean FROM r), u0 AS (SELECT DISTINCT user_id, 0.0::double AS b FROM r)"
    for i in range(rounds):
        sql += f", i{i + 1} AS (SELECT movie_id, sum(rating - mean - b) / (count(*) + 25) AS b FROM r JOIN u{i} USING (user_id), m GROUP BY movie_id), u{i + 1} AS (SELECT user_id, sum(rating - mean - b) / (count(*) + 10) AS b FROM r JOIN i{i + 1} USING (movie_id), m GROUP BY user_id)"
    return "\n" + sql + f"\nSELECT 'user' AS side, user_id AS id, round(b, 6) AS bias FROM u{rounds} UNION ALL SELECT 'item', movie_id, round(b, 6) FROM i{rounds}"


@query(_bias_sql(4))
def rating_biases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What users and movies add to the mean rating, after four rounds."""
    _, users, items = retrieval.rating_biases(fixtures.ratings(spark, sf_dir), 4)
    both = users.select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "bias").unionByName(items.select(F.lit("item").alias("side"), F.col("movie_id").alias("id"), "bias"))
    return _round(both, "bias")


@query()
def retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics at 20 of held-out likes in the whole catalogue: trained factors, with the items' biases, and a random order."""
    rows = kept(fixtures.ratings(spark, sf_dir, True).withColumn("held", F.pmod(F.xxhash64(*fixtures.TIES), F.lit(5)) == 0), "retrieval-rows")
    train = rows.where("not held")
    users, items = models.embedding_tables(models.fit_embeddings(train))
    _, _, bias = retrieval.rating_biases(train)
    queries = users.select(F.col("id").alias("qid"), F.col("embedding").alias("vector"))
    table = kept(items.join(bias, F.col("id") == F.col("movie_id"), "left").select(F.col("id").alias("item"), F.col("embedding").alias("vector"), F.coalesce("bias", F.lit(0.0)).alias("bias")), "retrieval-items")
    likes = lambda part: part.where("rating >= 4").select(F.col("user_id").alias("qid"), F.col("movie_id").alias("item")).distinct()
    seen = likes(train)
    held = likes(rows.where("held")).join(seen, ["qid", "item"], "left_anti")
    out = None
    for kind, column in (("factors", None), ("factors and biases", "bias")):
        ranks = retrieval.catalogue_ranks(held, queries, table, column, seen, upto=20)
        one = ranking.ranking_metrics(ranks).select(F.lit(kind).alias("kind"), "queries", "hit_rate", "mrr", "ndcg", "recall")
        out = one if out is None else out.unionByName(one)
    chance = retrieval.random_metrics(table.count())
    row = out.agg(F.max("queries").alias("queries")).select(F.lit("random order").alias("kind"), "queries", *(F.lit(chance[c]).alias(c) for c in ("hit_rate", "mrr", "ndcg", "recall")))
    return _round(out.unionByName(row), "hit_rate", "mrr", "ndcg", "recall")


_PARTS = "CASE WHEN timestamp < 900000000 THEN 'train' WHEN user_id % 2 = 0 THEN 'val' ELSE 'test' END"


def _versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings with users' columns in three splits and two versions."""
    rows = fixtures.rated_by_users(spark, sf_dir)
    split = F.when(F.col("timestamp") < 900000000, "train").when(F.col("user_id") % 2 == 0, "val").otherwise("test")
    return rows.withColumns({"split": split, "version": F.when(F.col("movie_id") % 2 == 0, "v1").otherwise("v2")})


def _sketches(rows: DataFrame) -> DataFrame:
    """The table of sketches by split and version, as it would be kept from run to run."""
    return kept(sketches.sketched(rows, ["split", "version"]), "sketches")


_UNION = f"""
, r AS (SELECT *, {_PARTS} AS split FROM fx_ratings JOIN fx_users USING (user_id))
"""
_NUMBER = "count(*) AS n, count(*) - count({c}) AS missing, count(*) FILTER ({c} = 0) AS zeros, round(avg({c}), 5) AS mean, round(stddev({c}), 4) AS std, min({c})::double AS min, max({c})::double AS max"


@query(_UNION + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, {_NUMBER.format(c=c)}, true AS distinct_ok, true AS median_ok FROM r GROUP BY split" for c in ("user_id", "movie_id", "rating", "timestamp", "age", "occupation"))
       + " UNION ALL " + " UNION ALL ".join(f"SELECT split, '{c}' AS feature, count(*), count(*) - count({c}), 0, NULL, NULL, NULL, NULL, true, true FROM r GROUP BY split" for c in ("gender", "zipcode")))
def merged_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of both versions of each split from their kept sketches; estimates are held against exact values."""
    rows = kept(_versions(spark, sf_dir), "versions")  # joined once, read for the sketches and for the exact values
    table = kept(sketches.statistics(sketches.merged(_sketches(rows), ["split"])), "statistics")
    own = rows.drop("version")
    median = F.col("m.median")
    low, high = F.count_if(F.col("value") < median), F.count_if(F.col("value") <= median)
    # the median's rank lies between the shares of values below it and up to it; the table has a row for each split and feature
    ranks = sketches._cells(own, ["split"], None).alias("x").join(F.broadcast(table.alias("m")), ["split", "feature"]).groupBy("split", "feature").agg(low.alias("low"), high.alias("high"), F.count("value").alias("k"))
    exact = ranks.join(sketches.distinct_cells(own, ["split"]).withColumnRenamed("distinct", "exact"), ["split", "feature"], "left").fillna(0, ["exact"])
    ok = (F.col("k") == 0) | (F.col("low") <= (0.5 + 2 * sketches.RANK_ERROR) * F.col("k")) & (F.col("high") >= (0.5 - 2 * sketches.RANK_ERROR) * F.col("k"))
    out = table.join(exact, ["split", "feature"])
    return out.select("split", "feature", "n", "missing", "zeros", F.round("mean", 5).alias("mean"), F.round("std", 4).alias("std"), "min", "max", sketches.within(F.col("distinct"), F.col("exact"), sketches.DISTINCT_ERROR).alias("distinct_ok"), ok.alias("median_ok"))


@query(_UNION + ", u AS (SELECT DISTINCT split, user_id FROM r), s AS (SELECT a.split AS a, b.split AS b, count(*) AS k FROM u a JOIN u b ON a.user_id = b.user_id AND a.split < b.split GROUP BY ALL) SELECT a, b, k AS exact, true AS ok FROM s")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users that two splits share, estimated from theta sketches and counted."""
    rows = _versions(spark, sf_dir)
    shared = sketches.overlaps(sketches.merged(_sketches(rows), ["split"]), "split", "user_id")
    users = rows.select("split", "user_id").distinct()
    each = users.groupBy("user_id").agg(F.sort_array(F.collect_set("split")).alias("splits"))  # at most three
    pairs = each.select(F.explode("splits").alias("p"), "splits").select("p", F.explode("splits").alias("q")).where("p < q").groupBy("p", "q").agg(F.count("*").alias("exact"))
    both = shared.join(pairs, (F.col("a") == F.col("p")) & (F.col("b") == F.col("q")))
    # the error of an intersection is that of the union
    return both.select("a", "b", "exact", (F.abs(F.col("in_both") - F.col("exact")) <= F.greatest(4 * sketches.OVERLAP_ERROR * F.col("in_either"), F.lit(1.0))).alias("ok"))


@query(_UNION + """, c AS (SELECT split, 'gender' AS feature, gender AS value, count(*) AS n FROM r GROUP BY ALL UNION ALL SELECT split, 'zipcode', zipcode, count(*) FROM r GROUP BY ALL)
SELECT split, feature, value, n, CAST(row_number() OVER w AS int) AS place FROM c WINDOW w AS (PARTITION BY split, feature ORDER BY n DESC, value) QUALIFY row_number() OVER w <= 10""")
def string_top_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten most frequent values of each string column by split."""
    return sketches.top_texts(_versions(spark, sf_dir).drop("version"), ["split"])


@query()
def search_by_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Successive halving of factor models by composite NDCG over popularity parts, on hash shares of the users."""
    rows = kept(fixtures.ratings(spark, sf_dir, True).withColumn("held", F.pmod(F.xxhash64(*fixtures.TIES), F.lit(5)) == 0), "search-rows")
    steps = rows.where("not held").select("movie_id", F.floor(F.col("timestamp") / 86400).alias("step"))
    parts = kept(popularity.with_parts(popularity.item_gap(steps, "movie_id", "step", 0.1)).select("movie_id", "part"), "search-parts")

    def composite(share: float, rank: int, reg: float) -> float:
        own = rows.where(F.pmod(F.xxhash64("user_id"), F.lit(1000)) < int(1000 * share))
        # of the fit only the tables stay, so its shuffle files go before the ranks make theirs
        users, items = (kept(t, "search-factors") for t in models.embedding_tables(models.fit_embeddings(own.where("not held"), rank, reg=reg)))
        release(spark)
        likes = own.where("rating >= 4 and held").select(F.col("user_id").alias("qid"), F.col("movie_id").alias("item")).distinct()
        ranks = retrieval.catalogue_ranks(likes, users.select(F.col("id").alias("qid"), F.col("embedding").alias("vector")), items.select(F.col("id").alias("item"), F.col("embedding").alias("vector")), upto=20)
        by_part = ranking.ranking_metrics(ranks.join(parts, F.col("item") == F.col("movie_id")), by=("part",))
        return float(ranking.composite_ndcg(by_part).first()["composite"])

    def trial(**params: float) -> float:
        with passing(spark):
            return composite(**params)

    grid = [{"rank": rank, "reg": reg} for rank in (8, 16) for reg in (0.05, 0.5)]
    found = models.halving(grid, trial, [0.25, 0.5, 1.0])
    return spark.createDataFrame([(rung, share, p["rank"], p["reg"], value, stays) for rung, share, p, value, stays in found], "rung int, share double, rank int, reg double, composite double, stays boolean")


@query("""
SELECT user_id, gender, age, genres FROM fx_events JOIN fx_users USING (user_id) JOIN fx_movies USING (movie_id) WHERE rating >= 4""")
def shard_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Liked events in JSON shards, written twice and published at once each time, the second in place of the first, read back."""
    liked = joins.join_ratings(fixtures.events(spark, sf_dir), fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir)).where("rating >= 4")
    rows, path = liked.select("user_id", "gender", "age", "genres"), shared_path(spark, "shards")
    shards.write_shards(rows.limit(0), path)
    shards.write_shards(rows, path, "overwrite")
    return shards.read_shards(spark, path, rows.schema)


def _likings(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The items' biases, sorted by item."""
    table = scoring.read_table(path).sort_by("movie_id")
    return table["movie_id"].to_numpy(), table["bias"].to_numpy()


def _liked(likings: tuple[np.ndarray, np.ndarray], batch: pa.RecordBatch) -> pa.RecordBatch:
    ids, bias = likings
    asked = batch.column(1).to_numpy()
    at = np.minimum(np.searchsorted(ids, asked), max(len(ids) - 1, 0))
    found = np.where(ids[at] == asked, bias[at], 0.0) if len(ids) else np.zeros(len(asked))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found)], names=["event_id", "movie_id", "score"])


@query("""
, r AS (SELECT movie_id, rating::double AS rating FROM fx_ratings), m AS (SELECT avg(rating) AS mean FROM r), i AS (SELECT movie_id, sum(rating - mean) / (count(*) + 25) AS b FROM r, m GROUP BY movie_id)
SELECT event_id, movie_id, round(coalesce(b, 0), 6) AS score FROM fx_events LEFT JOIN i USING (movie_id)""")
def scored_by_worker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events scored by their movie's bias, from a table that each worker loads once."""
    _, _, bias = retrieval.rating_biases(fixtures.ratings(spark, sf_dir), 1)
    path = shared_path(spark, "scorer")
    bias.coalesce(1).write.parquet(path)
    out = scoring.score_with(fixtures.events(spark, sf_dir).select("event_id", "movie_id"), _likings, path, _liked, "event_id long, movie_id long, score double")
    return _round(out, "score")


# ratings in the order of time, the first half known, and a guess from the items' means there
_HALVES = """
, r AS (SELECT user_id, movie_id, rating::double AS rating, timestamp, row_number() OVER (ORDER BY timestamp, user_id, movie_id, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER () AS total FROM fx_ratings),
m AS (SELECT avg(rating) AS mean FROM r WHERE rn <= total // 2), i AS (SELECT movie_id, sum(rating - mean) / (count(*) + 25) AS b FROM r, m WHERE rn <= total // 2 GROUP BY movie_id),
g AS (SELECT r.*, mean + coalesce(b, 0) AS guess FROM r LEFT JOIN i USING (movie_id), m)"""


def _one_feature(name: str) -> str:
    cuts = ", ".join(str(i / 20) for i in range(1, 20))
    return f"""(WITH q AS (SELECT quantile_cont({name}::double, [{cuts}]) AS cuts FROM g WHERE rn <= total // 2), b AS (SELECT g.*, len(list_filter(cuts, lambda c: c < {name})) AS bin FROM g, q),
k AS (SELECT bin, avg(abs(rating - guess)) AS a, avg(pow(rating - guess, 2)) AS s FROM b WHERE rn <= total // 2 GROUP BY bin)
SELECT '{name}' AS feature, CAST(floor((rn - total // 2 - 1) / 6000) AS bigint) AS chunk, count(*) AS n, round(avg(a), 6) AS mae, round(sqrt(avg(s)), 6) AS rmse FROM b LEFT JOIN k USING (bin) WHERE rn > total // 2 GROUP BY 2)"""


@query(_HALVES + "\n" + " UNION ALL ".join(_one_feature(c) for c in ("timestamp", "movie_id", "user_id")))
def drift_by_feature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors expected of a fitted guess on the second half in time, by chunk, from one feature at a time."""
    rows = kept(models.halves(fixtures.ratings(spark, sf_dir, True), TIME_ORDER, 6000).drop(*fixtures.TIES), "drift-halves")
    known = rows.where("period = 'reference'")
    guessed = kept(_guessed(rows, known), "drift-guessed")
    analysis = guessed.where("period = 'analysis'")
    out = models.estimate_by_feature(guessed.where("period = 'reference'"), analysis, ["timestamp", "movie_id", "user_id"], "rating", "guess")
    return _round(out, "mae", "rmse")


@query()
def pattern_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patterns of each length there are among movie_sequences, and the most frequent one's count."""
    out = vertical.frequent_sequences(fixtures.events(spark, sf_dir), ["rating"], "user_id", "movie_id", ["timestamp", "event_id"], 0.02)
    return mining.patterns_by_length(out)


ORACLES["pattern_lengths"] = f"SELECT length, count(*) AS patterns, max(freq) AS max_freq FROM ({ORACLES['movie_sequences']}) GROUP BY length"


@query("""
SELECT fault, message, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey) AS n FROM (VALUES ('list lengths', 'ratings: 2 columns and 1 types'), ('no path', 'ratings: path, separator and fields are needed'), ('repeated column', 'ratings: repeated column names'), ('type', 'ratings.x: type <class ''list''> is not int, float, str or bytes'), ('unknown relation', 'unknown relation ''films''; one of (''ratings'', ''users'', ''movies'')'))
 v(fault, message)""", views=False)
def rejected_catalogs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the check of a catalog says of wrong specifications of an export, and the rows that the right one reads."""
    path = shared_path(spark, "catalog")
    rows = fixtures.ratings(spark, sf_dir).select("user_id", "rating")
    sinks.write_delimited(rows, path)
    good = delimited.specs_from_lists("ratings", path, ["user_id", "rating"], [int, int])
    wrong = {
        "list lengths": lambda: delimited.specs_from_lists("ratings", path, ["user_id", "rating"], [int]),
        "no path": lambda: delimited.SourceSpec("ratings", "", good.fields),
        "repeated column": lambda: delimited.SourceSpec("ratings", path, (("x", int), ("x", int))),
        "type": lambda: delimited.SourceSpec("ratings", path, (("x", list),)),
        "unknown relation": lambda: delimited.SourceSpec("films", path, good.fields),
    }
    said = []
    for fault, make in wrong.items():
        try:
            make()
        except ValueError as e:
            said.append((fault, str(e)))
    read = delimited.read_delimited(spark, good).agg(F.count("*").alias("n"))  # one row
    return spark.createDataFrame(said, "fault string, message string").crossJoin(read)
