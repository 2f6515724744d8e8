"""Registered queries on profiles, popularity, ranking, mining, models and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions import features as fx
from tastemill.functions.vocab import GENRES
from tastemill.operators import joins, mining, models, popularity, profile, ranking, retrieval, splits
from tastemill.plans import fixtures
from tastemill.plans.fixtures import TIES
from tastemill.plans.relations import TIME_ORDER, _joined, query
from tastemill.sources.folders import kept, shared_path
from tastemill.streaming import jobs

R = 6  # decimals that both engines are compared on


def _round(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(c, R) for c in columns})


@query("""
SELECT user_id, array_to_string(list_sort(list(DISTINCT movie_id)), ',') AS items, count(DISTINCT movie_id) AS n FROM fx_events GROUP BY user_id""")
def user_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mining.baskets(fixtures.events(spark, sf_dir), "user_id", "movie_id")
    return out.select("user_id", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"), F.size("items").cast("long").alias("n"))


@query("""
, t AS (SELECT DISTINCT movie_id, unnest(string_split(replace(genres, 'Children''s', 'Children'), '|')) AS g FROM fx_movies)
SELECT a.g AS item_a, b.g AS item_b, count(*) AS n FROM t a JOIN t b USING (movie_id) GROUP BY ALL""")
def cooccurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.cooccurrence(fixtures.movies(spark, sf_dir).select(fx.genre_names(F.col("genres")).alias("g")), "g")


@query("""
, e AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem)
SELECT CAST(least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) AS int) AS bin, round(lo + least(floor((l_extendedprice - lo) / ((hi - lo) / 10)), 9) * ((hi - lo) / 10), 4) AS low, count(*) AS n FROM lineitem, e GROUP BY ALL""")
def hist_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram(fixtures.table(spark, sf_dir, "lineitem"), "l_extendedprice").select("bin", F.round("low", 4).alias("low"), "n")


@query("""
, e AS (SELECT min(l_quantity) AS a, max(l_quantity) AS b, min(l_extendedprice) AS c, max(l_extendedprice) AS d FROM lineitem)
SELECT CAST(least(floor((l_quantity - a) / ((b - a) / 8)), 7) AS int) AS x_bin, CAST(least(floor((l_extendedprice - c) / ((d - c) / 8)), 7) AS int) AS y_bin, count(*) AS n FROM lineitem, e GROUP BY ALL""")
def hist_2d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.histogram2d(fixtures.table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", 8)


@query("""
SELECT gender, occupation, round(quantile_cont(rating, 0.0), 6) AS low, round(quantile_cont(rating, 0.25), 6) AS q25, round(quantile_cont(rating, 0.5), 6) AS q50, round(quantile_cont(rating, 0.75), 6) AS q75, round(quantile_cont(rating, 1.0), 6) AS high, count(*) AS n
FROM fx_ratings JOIN fx_users USING (user_id) GROUP BY ALL""")
def box_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.box_stats(_joined(spark, sf_dir), "rating", ["gender", "occupation"]), "low", "q25", "q50", "q75", "high")


_GAP = """
, s AS (SELECT DISTINCT movie_id, CAST(floor(event_id / 50) AS bigint) + 1 AS step FROM fx_events),
g AS (SELECT movie_id, step, step - coalesce(lag(step) OVER w, 0) AS gap, row_number() OVER w AS k, count(*) OVER (PARTITION BY movie_id) AS n FROM s WINDOW w AS (PARTITION BY movie_id ORDER BY step)),
b AS (SELECT movie_id, max(n) AS n, max(step) AS last_step, pow(0.9::double, max(n)) + sum(0.1::double * pow(0.9::double, n - k) * gap) AS b FROM g GROUP BY movie_id)"""


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.events(spark, sf_dir).select("movie_id", (F.floor(F.col("event_id") / 50) + 1).alias("step"))


@query(_GAP + """
SELECT movie_id, n, last_step, round(b, 6) AS b, round(1 / greatest(b, 1e-6), 6) AS p FROM b""")
def popularity_ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(popularity.item_gap(_steps(spark, sf_dir), "movie_id", "step", 0.1), "b", "p")


@query(_GAP + """
, c AS (SELECT quantile_cont(b, 0.2) AS lo, quantile_cont(b, 0.8) AS hi FROM b)
SELECT movie_id, round(b, 6) AS b, CASE WHEN b <= lo THEN 'head' WHEN b >= hi THEN 'tail' ELSE 'torso' END AS part FROM b, c""")
def popularity_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = popularity.with_parts(popularity.item_gap(_steps(spark, sf_dir), "movie_id", "step", 0.1))
    return _round(out.select("movie_id", "b", "part"), "b")


@query(_GAP + """
, e AS (SELECT min(b) AS lo, max(b) AS hi FROM b)
SELECT 'n' AS kind, 0.0::double AS at, count(*)::double AS value FROM b UNION ALL SELECT 'min', 0, round(min(b), 6) FROM b UNION ALL SELECT 'max', 0, round(max(b), 6) FROM b UNION ALL SELECT 'mean', 0, round(avg(b), 6) FROM b
UNION ALL SELECT 'percentile', 20, round(quantile_cont(b, 0.2), 6) FROM b UNION ALL SELECT 'percentile', 50, round(quantile_cont(b, 0.5), 6) FROM b UNION ALL SELECT 'percentile', 80, round(quantile_cont(b, 0.8), 6) FROM b UNION ALL SELECT 'percentile', 99, round(quantile_cont(b, 0.99), 6) FROM b
UNION ALL SELECT 'bin', least(floor((b - lo) / ((hi - lo) / 10)), 9), count(*) FROM b, e GROUP BY 2""")
def popularity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(popularity.gap_report(popularity.item_gap(_steps(spark, sf_dir), "movie_id", "step", 0.1)), "value")


_PAIRS = """
WITH e AS (SELECT vec_id, vec_id % {groups} AS batch, CAST(embedding AS double[]) AS q, list_reverse(CAST(embedding AS double[])) AS c, label FROM embeddings),
s AS (SELECT a.batch, a.vec_id AS qid, b.vec_id AS cid, list_dot_product(a.q, b.c) AS score, a.label + 1.0 AS weight FROM e a JOIN e b ON a.batch = b.batch AND (a.vec_id = b.vec_id OR a.label <> b.label)),
t AS (SELECT qid, score AS t FROM s WHERE qid = cid),
r AS (SELECT batch, s.qid, weight, count(*) FILTER (score >= t - 1e-6) AS rank, max(t) AS true_score, max(score) AS max_score, ln(sum(exp(score - t))) + max(t) AS log_sum, arg_max(cid, score) AS best FROM s JOIN t USING (qid) GROUP BY ALL)"""


def _batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings in batches of about 512; each vector's partner is its reverse, its label a mask and a weight."""
    rows = fixtures.table(spark, sf_dir, "embeddings")
    n = max(4, rows.count() // 512)
    return rows.select("vec_id", (F.col("vec_id") % n).alias("batch"), F.col("embedding").alias("q"), F.reverse("embedding").alias("c"), "label", (F.col("label") + 1.0).alias("weight"))


def _ranks(spark: SparkSession, sf_dir: str, method: str = "arrow") -> DataFrame:
    return ranking.inbatch_ranks(_batches(spark, sf_dir), "batch", "vec_id", "q", "c", "label", "weight", method)


_P4 = _PAIRS.format(groups="greatest(4, (SELECT count(*) FROM embeddings) // 512)")
_METRICS = """round(sum(CASE WHEN rank = 1 THEN weight ELSE 0 END) / sum(weight), 6) AS hit_rate, round(sum(CASE WHEN rank <= 20 THEN weight / rank ELSE 0 END) / sum(weight), 6) AS mrr,
 round(sum(CASE WHEN rank <= 20 THEN weight / log2(rank + 1) ELSE 0 END) / sum(weight), 6) AS ndcg, round(sum(CASE WHEN rank <= 20 THEN weight ELSE 0 END) / sum(weight), 6) AS recall"""


@query(_P4 + "SELECT qid, rank, round(true_score, 6) AS true_score, round(max_score, 6) AS max_score, round(log_sum, 6) AS log_sum, best FROM r", views=False)
def inbatch_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(_ranks(spark, sf_dir), "true_score", "max_score", "log_sum").select("qid", "rank", "true_score", "max_score", "log_sum", "best")


@query(_P4 + f"SELECT count(*) AS queries, {_METRICS} FROM r", views=False)
def inbatch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranking.ranking_metrics(_ranks(spark, sf_dir)), "hit_rate", "mrr", "ndcg", "recall")


@query(_P4 + f", p AS (SELECT vec_id AS qid, CASE label % 3 WHEN 0 THEN 'head' WHEN 1 THEN 'torso' ELSE 'tail' END AS part FROM e) SELECT part, count(*) AS queries, {_METRICS} FROM r JOIN p USING (qid) GROUP BY part", views=False)
def ndcg_by_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranking.ndcg_by_part(_ranks(spark, sf_dir), _parts(spark, sf_dir)), "hit_rate", "mrr", "ndcg", "recall")


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(F.col("label") % 3 == 0, "head").when(F.col("label") % 3 == 1, "torso").otherwise("tail")
    return fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("qid"), part.alias("part"))


@query(_P4 + """, p AS (SELECT vec_id AS qid, label % 3 AS k FROM e), n AS (SELECT k, sum(CASE WHEN rank <= 20 THEN weight / log2(rank + 1) ELSE 0 END) / sum(weight) AS v FROM r JOIN p USING (qid) GROUP BY k)
SELECT round(coalesce(max(v) FILTER (k = 0), 0), 6) AS ndcg_head, round(coalesce(max(v) FILTER (k = 1), 0), 6) AS ndcg_torso, round(coalesce(max(v) FILTER (k = 2), 0), 6) AS ndcg_tail,
  round(0.15 * coalesce(max(v) FILTER (k = 0), 0) + 0.35 * coalesce(max(v) FILTER (k = 1), 0) + 0.5 * coalesce(max(v) FILTER (k = 2), 0), 6) AS composite FROM n""", views=False)
def composite_ndcg(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ranking.composite_ndcg(ranking.ndcg_by_part(_ranks(spark, sf_dir), _parts(spark, sf_dir)))
    return _round(out, "ndcg_head", "ndcg_torso", "ndcg_tail", "composite")


@query(_P4 + """SELECT 'softmax' AS kind, round(avg(log_sum - true_score), 6) AS loss FROM r UNION ALL SELECT 'heuristic', round(avg((log_sum - true_score) * weight / ln(rank + 1)), 6) FROM r
UNION ALL SELECT 'lambda', round(avg((log_sum - true_score) * ((pow(2.0::double, weight) - 1) * (1 - 1 / log2(rank + 1)) + 1)), 6) FROM r""", views=False)
def inbatch_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(ranking.inbatch_losses(_ranks(spark, sf_dir)), "loss")


@query("""
WITH e AS (SELECT vec_id, vec_id % greatest(64, (SELECT count(*) FROM embeddings) // 64) AS batch, CAST(embedding AS double[]) AS q, list_reverse(CAST(embedding AS double[])) AS c, 1.0::double / (1 + label) AS p FROM embeddings),
s AS (SELECT a.batch, a.vec_id AS qid, b.vec_id AS cid, list_dot_product(a.q, b.c) / 0.1 - 0.5 * ln(greatest(b.p, 1e-6)) AS score FROM e a JOIN e b USING (batch))
SELECT batch, round(min(score), 6) AS min_score, round(max(score), 6) AS max_score, round(avg(score), 6) AS mean_score FROM s GROUP BY batch""", views=False)
def corrected_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score statistics of batches after temperature and log-q correction, through the SQL form of the pairs."""
    rows = _batches(spark, sf_dir)
    rows = rows.withColumn("batch", F.col("vec_id") % max(64, rows.count() // 64))  # batches of about 64
    p = rows.select(F.col("vec_id").alias("cid"), (1.0 / F.col("weight")).alias("p"))
    scores = ranking.log_q(ranking.score_pairs(rows, "batch", "vec_id", "q", "c"), p, 0.1, 0.5)
    return _round(ranking.score_stats(scores), "min_score", "max_score", "mean_score")


@query("""
WITH s AS (SELECT q.vec_id AS qid, i.vec_id AS item, list_dot_product(CAST(q.embedding AS double[]), CAST(i.embedding AS double[])) + i.label / 100.0::double AS score FROM embeddings q JOIN embeddings i ON q.vec_id % 20 = 0),
r AS (SELECT qid, item, round(score, 6) AS score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, item) AS rank FROM s)
SELECT * FROM r WHERE rank <= 10""", views=False)
def topk_retrieval(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "embeddings")
    queries = rows.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("vector"))
    items = rows.select(F.col("vec_id").alias("item"), F.col("embedding").alias("vector"), (F.col("label") / 100.0).alias("bias"))
    return _round(ranking.top_k(queries, items, 10, bias="bias"), "score")


_STATS = "count(*) AS n, count(*) FILTER ({c} IS NULL) AS missing, round(avg({c}), 6) AS mean, round(stddev({c}), 6) AS std, round(min({c}), 6) AS min, round(max({c}), 6) AS max, count(*) FILTER ({c} = 0) AS zeros"


@query("\n" + " UNION ALL ".join(f"SELECT CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split, '{c}' AS feature, {_STATS.format(c=c)} FROM fx_ratings GROUP BY ALL" for c in ("user_id", "movie_id", "rating", "timestamp")))
def feature_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.ratings(spark, sf_dir).withColumn("split", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    out = profile.feature_stats(rows).select("split", "feature", "n", "missing", "mean", "std", "min", "max", "zeros")
    return _round(out, "mean", "std", "min", "max")


@query("""
SELECT 'l_quantity' AS feature, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(stddev(l_quantity), 6) AS std, min(l_quantity)::double AS min, round(quantile_cont(l_quantity, 0.25), 6) AS q25, round(quantile_cont(l_quantity, 0.5), 6) AS q50, round(quantile_cont(l_quantity, 0.75), 6) AS q75, max(l_quantity)::double AS max FROM lineitem
UNION ALL SELECT 'l_discount', count(*), round(avg(l_discount), 6), round(stddev(l_discount), 6), min(l_discount), round(quantile_cont(l_discount, 0.25), 6), round(quantile_cont(l_discount, 0.5), 6), round(quantile_cont(l_discount, 0.75), 6), max(l_discount) FROM lineitem""")
def relation_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round(profile.summary(fixtures.table(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"]), "mean", "std", "q25", "q50", "q75")


@query("""
SELECT CASE WHEN timestamp < 900000000 THEN 'train' ELSE 'eval' END AS split, count(*) AS n FROM fx_ratings GROUP BY ALL""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.ratings(spark, sf_dir)
    return profile.split_counts(splits.from_presplit({"train": rows.where("timestamp < 900000000"), "eval": rows.where("timestamp >= 900000000")}))


_REVIEWED = """[{"feature": "user_id", "type": "int", "min_fraction": 1.0}, {"feature": "gender", "type": "string", "domain": ["F"]}, {"feature": "age", "type": "int", "domain": null},
 {"feature": "occupation", "type": "float"}, {"feature": "height", "type": "float"}]"""


@query("""
SELECT 'gender' AS feature, 'out of domain' AS problem, count(*) AS n FROM fx_users WHERE gender NOT IN ('F') HAVING count(*) > 0
UNION ALL VALUES ('occupation', 'wrong type', 1), ('height', 'missing column', 1), ('zipcode', 'unexpected column', 1)""")
def schema_anomalies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.anomalies(fixtures.users(spark, sf_dir), profile.load_constraints(_REVIEWED))


@query("""
SELECT 'user_id' AS feature, 'int' AS type, 1.0::double AS min_fraction, NULL AS domain UNION ALL SELECT 'gender', 'string', 1.0, array_to_string(list_sort(list(DISTINCT gender)), ',') FROM fx_users
UNION ALL SELECT 'age', 'int', 1.0, NULL UNION ALL SELECT 'occupation', 'int', 1.0, NULL""")
def constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.infer_constraints(fixtures.users(spark, sf_dir).drop("zipcode"))
    return out.select("feature", "type", "min_fraction", F.array_join("domain", ",").alias("domain"))


@query("""
, a AS (SELECT user_id, movie_id, count(*) AS n FROM fx_ratings WHERE rating >= 3 GROUP BY ALL), b AS (SELECT user_id, movie_id, count(*) AS n FROM fx_ratings WHERE rating <= 3 GROUP BY ALL)
SELECT coalesce(a.user_id, b.user_id) AS user_id, coalesce(a.movie_id, b.movie_id) AS movie_id, coalesce(a.n, 0) AS n_a, coalesce(b.n, 0) AS n_b
FROM a FULL JOIN b ON a.user_id = b.user_id AND a.movie_id = b.movie_id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""")
def dataset_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.ratings(spark, sf_dir)
    return joins.dataset_diff(rows.where("rating >= 3"), rows.where("rating <= 3"), ["user_id", "movie_id"], fixtures.rating_parts(spark, sf_dir))


# a guess for each rating: the mean and what its movie adds to it
_GUESS = """
, m AS (SELECT avg(rating::double) AS mean FROM fx_ratings), i AS (SELECT movie_id, sum(rating - mean) / (count(*) + 25) AS b FROM fx_ratings, m GROUP BY movie_id), g AS (SELECT fx_ratings.*, mean + b AS guess FROM fx_ratings JOIN i USING (movie_id), m)"""
_ERRORS = "round(sqrt(avg(pow(rating - guess, 2))), 6) AS rmse, round(avg(abs(rating - guess)), 6) AS mae, round(avg(pow(rating - guess, 2)), 6) AS mse"


def _guessed(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Adds ``guess``, fitted on ``known`` (all rows): the mean rating and the movie's bias."""
    mean, bias = retrieval.item_biases(rows if known is None else known)
    own = bias.select(F.col("movie_id").alias("__m"), F.col("bias").alias("__b"))
    return rows.join(own, F.col("movie_id") == F.col("__m"), "left").withColumn("guess", mean + F.coalesce("__b", F.lit(0.0))).drop("__m", "__b")


@query(_GUESS + f"""
, r AS (SELECT *, row_number() OVER (ORDER BY timestamp, user_id, movie_id, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn FROM g)
SELECT CAST(floor((rn - 1) / 6000) AS bigint) AS chunk, count(*) AS n, {_ERRORS} FROM r GROUP BY 1""")
def error_by_chunk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tastemill.operators.ranks import global_row_number
    rows = global_row_number(_guessed(fixtures.ratings(spark, sf_dir, True)), TIME_ORDER).withColumn("chunk", F.floor((F.col("rn") - 1) / 6000))
    return _round(ranking.error_metrics(rows, "rating", "guess", ("chunk",)), "rmse", "mae", "mse")


@query(_GUESS + f"""
SELECT gender, occupation, count(*) AS n, {_ERRORS}
FROM g JOIN fx_users USING (user_id) GROUP BY ROLLUP (gender, occupation)""")
def error_by_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors overall, by gender, and by gender and occupation."""
    rows = _guessed(_joined(spark, sf_dir), fixtures.ratings(spark, sf_dir))
    return _round(ranking.error_metrics(rows, "rating", "guess", ("gender", "occupation"), rollup=True), "rmse", "mae", "mse")


@query("""
SELECT zipcode, count(*) AS n FROM fx_users JOIN fx_ratings USING (user_id) GROUP BY zipcode ORDER BY n DESC, zipcode LIMIT 20""")
def top_zipcodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.join_one(fixtures.ratings(spark, sf_dir), fixtures.users(spark, sf_dir), "user_id")
    return profile.top_values(rows, "zipcode", 20)


@query("""
, h AS (SELECT 'odd' AS side, avg(CASE WHEN rating > 3 THEN 1.0::double ELSE 0 END) AS liked, count(*)::double AS n FROM fx_ratings WHERE user_id % 2 = 1), b AS (SELECT avg(CASE WHEN rating > 3 THEN 1.0::double ELSE 0 END) AS liked FROM fx_ratings WHERE user_id % 2 = 0)
SELECT 'liked' AS metric, round(h.liked, 6) AS value, round(greatest(0.1, b.liked), 6) AS bound, h.liked >= greatest(0.1, b.liked) AS passed FROM h, b
UNION ALL SELECT 'n', n, 1000.0, n >= 1000 FROM h""")
def gate_against_baseline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of liked ratings of the odd users must reach that of the even ones, on enough rows."""
    rows = fixtures.ratings(spark, sf_dir)

    def metrics(part: DataFrame) -> DataFrame:
        one = part.agg(F.avg((F.col("rating") > 3).cast("double")).alias("liked"), F.count("*").cast("double").alias("n"))
        return one.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in one.columns))).alias("m")).select("m.*")

    base = metrics(rows.where("user_id % 2 = 0")).where("metric = 'liked'")
    return _round(ranking.quality_gate(metrics(rows.where("user_id % 2 = 1")), {"liked": 0.1, "n": 1000.0}, base), "value", "bound")


@query(_GUESS + """
, v AS (SELECT unnest(['rmse', 'mae', 'count']) AS metric, unnest([-sqrt(avg(pow(rating - guess, 2))), -avg(abs(rating - guess)), count(*)::double]) AS value FROM g)
SELECT metric, round(value, 6) AS value, bound, value >= bound AS passed FROM v JOIN (VALUES ('rmse', -2.0::double), ('mae', -0.5), ('count', 100.0)) b(metric, bound) USING (metric)""")
def quality_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = ranking.error_metrics(_guessed(fixtures.ratings(spark, sf_dir)), "rating", "guess")
    metrics = e.select(F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), c.cast("double").alias("value")) for n, c in (("rmse", -F.col("rmse")), ("mae", -F.col("mae")), ("count", F.col("n")))))).alias("m")).select("m.*")
    return _round(ranking.quality_gate(metrics, {"rmse": -2.0, "mae": -0.5, "count": 100.0}), "value")


def _distance_sql(x: str, y: str, tail: str) -> str:
    """Double sums over pairs of cells, in a view ``v``; then ``tail``."""
    return f"""(WITH c AS (SELECT {x}::double AS x, {y}::double AS y, count(*)::double AS w FROM fx_ratings JOIN fx_users USING (user_id) GROUP BY ALL), n AS (SELECT sum(w) AS n FROM c),
p AS (SELECT a.x, a.y, a.w, b.w AS w2, abs(a.x - b.x) AS a, abs(a.y - b.y) AS b FROM c a, c b),
r AS (SELECT x, y, w, sum(w2 * a) AS ra, sum(w2 * b) AS rb, sum(w2 * a * b) AS ab, sum(w2 * a * a) AS aa, sum(w2 * b * b) AS bb FROM p GROUP BY x, y, w),
s AS (SELECT sum(w * ra) AS sa, sum(w * rb) AS sb, sum(w * ab) AS sab, sum(w * aa) AS saa, sum(w * bb) AS sbb, sum(w * ra * rb) AS mab, sum(w * ra * ra) AS maa, sum(w * rb * rb) AS mbb FROM r),
v AS (SELECT n, sab / pow(n, 2) - 2 * mab / pow(n, 3) + sa * sb / pow(n, 4) AS vab, saa / pow(n, 2) - 2 * maa / pow(n, 3) + sa * sa / pow(n, 4) AS vaa, sbb / pow(n, 2) - 2 * mbb / pow(n, 3) + sb * sb / pow(n, 4) AS vbb FROM s, n)
SELECT '{x}' AS x, '{y}' AS y, CAST(n AS bigint) AS n, round(sqrt(greatest(vab, 0)), 5) AS dcov, round(sqrt(greatest(vab, 0) / sqrt(vaa * vbb)), 5) AS dcor{tail} FROM v)"""


_NUMBERS = ("rating", "age", "occupation", "movie_id % 10")


@query("\n" + "\nUNION ALL ".join(_distance_sql(x, y, "").replace("'movie_id % 10'", "'movie_digit'") for i, x in enumerate(_NUMBERS) for y in _NUMBERS[i + 1 :]))
def distance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distance correlation of all pairs of four columns, exact."""
    rows = _joined(spark, sf_dir).select("rating", "age", "occupation", (F.col("movie_id") % 10).alias("movie_digit"))
    return profile.distance_matrix(rows, rows.columns).select("x", "y", "n", F.round("dcov", 5).alias("dcov"), F.round("dcor", 5).alias("dcor"))


@query("\nSELECT * FROM " + _distance_sql("rating", "occupation", ", n * greatest(vab, 0) >= 3.841459 AS dependent"))
def distance_corr(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = profile.independence(_joined(spark, sf_dir), "rating", "occupation")
    return out.select("x", "y", "n", F.round("dcov", 5).alias("dcov"), F.round("dcor", 5).alias("dcor"), "dependent")


@query("""
, t AS (SELECT DISTINCT user_id, movie_id FROM fx_events), n AS (SELECT count(DISTINCT user_id) AS n FROM t)
SELECT a.movie_id || ',' || b.movie_id AS items, count(*) AS freq, round(count(*) / max(n), 6) AS support FROM t a JOIN t b ON a.user_id = b.user_id AND a.movie_id < b.movie_id, n GROUP BY a.movie_id, b.movie_id HAVING count(*) >= 0.1 * max(n)""")
def frequent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of items in a tenth of the baskets, counted exactly: items that are rarer themselves make no pairs."""
    rows = fixtures.events(spark, sf_dir).select("user_id", "movie_id").distinct()
    n = rows.select("user_id").distinct().count()
    often = rows.groupBy("movie_id").agg(F.count("*").alias("n")).where(F.col("n") >= 0.1 * n).select("movie_id")
    baskets = mining.baskets(rows.join(often, "movie_id", "left_semi"), "user_id", "movie_id")
    pairs = profile.cooccurrence(baskets, "items").where(f"item_a < item_b and n >= 0.1 * {n}")
    return pairs.select(F.concat_ws(",", "item_a", "item_b").alias("items"), F.col("n").alias("freq"), F.round(F.col("n") / n, R).alias("support"))


def _genre_baskets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The genres of the movies that each user of the events touched on one day: short baskets over few items."""
    rows = joins.join_one(fixtures.events(spark, sf_dir), fixtures.movies(spark, sf_dir), "movie_id", ("title",))
    each = rows.select("user_id", F.floor(F.col("timestamp") / 86400).alias("day"), F.explode(fx.genre_names(F.col("genres"))).alias("genre")).distinct()
    return each.groupBy("user_id", "day").agg(F.sort_array(F.collect_list("genre")).alias("items"))


_BASKETS = """
, b AS (SELECT user_id, CAST(floor(timestamp / 86400) AS bigint) AS day, unnest(string_split(replace(genres, 'Children''s', 'Children'), '|')) AS g FROM fx_events JOIN fx_movies USING (movie_id)),
t AS (SELECT DISTINCT user_id, day, g FROM b), n AS (SELECT count(*) AS n FROM (SELECT DISTINCT user_id, day FROM t)),
i1 AS (SELECT g, count(*) AS f FROM t GROUP BY g), i2 AS (SELECT x.g AS a, y.g AS b, count(*) AS f FROM t x JOIN t y ON x.user_id = y.user_id AND x.day = y.day AND x.g < y.g GROUP BY ALL)"""


@query(_BASKETS + """
SELECT '["' || g || '"]' AS label, f AS freq, round(f / n, 6) AS support FROM i1, n WHERE f >= ceil(0.005 * n) UNION ALL SELECT '["' || a || '","' || b || '"]', f, round(f / n, 6) FROM i2, n WHERE f >= ceil(0.005 * n)""")
def frequent_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-growth itemsets of one and two genres, which counting can confirm; the longer ones are in long_itemsets."""
    rows = kept(_genre_baskets(spark, sf_dir).select("items"), "baskets")
    model = mining.fit_itemsets(rows, min_confidence=0.1)
    return mining.frequent_itemsets(model, rows.count()).where(F.size("items") <= 2).select("label", "freq", F.round("support", R).alias("support"))


@query(_BASKETS + """
, d AS (SELECT a AS x, b AS y, f FROM i2 UNION ALL SELECT b, a, f FROM i2)
SELECT '["' || x || '"]' AS antecedent, '["' || y || '"]' AS consequent, round(d.f / p.f, 6) AS confidence, round(d.f / p.f / (q.f / n), 6) AS lift
FROM d JOIN i1 p ON p.g = x JOIN i1 q ON q.g = y, n WHERE d.f >= ceil(0.005 * n) AND d.f / p.f >= 0.1""")
def assoc_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules from one genre to another; longer antecedents are in long_rules."""
    model = mining.fit_itemsets(kept(_genre_baskets(spark, sf_dir).select("items"), "baskets"), min_confidence=0.1)
    rules = mining.association_rules(model, 0.1, 1).where(F.size("antecedent") == 1)
    return rules.select(fx.itemset_label(F.col("antecedent")).alias("antecedent"), fx.itemset_label(F.col("consequent")).alias("consequent"), F.round("confidence", R).alias("confidence"), F.round("lift", R).alias("lift"))


_ITEMS = (*GENRES, "Unknown")
# every set of items is a number; its baskets are counted by adding up, item by item, the sets that hold it
_SETS = _BASKETS + f"""
, names AS (SELECT unnest({fixtures._list(_ITEMS)}) AS g, unnest(range({len(_ITEMS)})) AS i),
masks AS (SELECT mask, count(*) AS f FROM (SELECT user_id, day, bit_or(1 << CAST(i AS int)) AS mask FROM t JOIN names USING (g) GROUP BY user_id, day) GROUP BY mask),
z0 AS (SELECT CAST(r AS int) AS m, coalesce(f, 0) AS f FROM range({1 << len(_ITEMS)}) x(r) LEFT JOIN masks ON mask = r)""" + "".join(
    f", z{k + 1} AS (SELECT m, CASE WHEN m & {1 << k} = 0 THEN sum(f) OVER (PARTITION BY m & {~(1 << k) & ((1 << len(_ITEMS)) - 1)}) ELSE f END AS f FROM z{k})" for k in range(len(_ITEMS))
) + f", z AS MATERIALIZED (SELECT m, CAST(f AS bigint) AS f FROM z{len(_ITEMS)} WHERE f > 0)"
_NAMED = "(SELECT '[\"' || string_agg(g, '\",\"' ORDER BY g) || '\"]' FROM names WHERE {m} & (1 << CAST(i AS int)) <> 0)"


@query(_SETS + f"""
SELECT {_NAMED.format(m="m")} AS label, CAST(bit_count(m) AS int) AS size, f AS freq, round(f / n, 6) AS support FROM z, n WHERE bit_count(m) >= 3 AND f >= ceil(0.005 * n)""")
def long_itemsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """FP-growth itemsets of three genres and more, at the operator's own support."""
    rows = kept(_genre_baskets(spark, sf_dir).select("items"), "baskets")  # grouped once, read by the fit's passes and the count
    model = mining.fit_itemsets(rows, min_confidence=0.1)
    return mining.frequent_itemsets(model, rows.count(), 3).select("label", F.size("items").alias("size"), "freq", F.round("support", R).alias("support"))


@query(_SETS + f"""
, s AS (SELECT m, f, m - (1 << CAST(i AS int)) AS x, 1 << CAST(i AS int) AS y FROM z JOIN names ON m & (1 << CAST(i AS int)) <> 0, n WHERE bit_count(m) >= 3 AND f >= ceil(0.005 * n))
SELECT {_NAMED.format(m="s.x")} AS antecedent, {_NAMED.format(m="s.y")} AS consequent, round(s.f / p.f, 6) AS confidence, round(s.f / p.f / (q.f / n), 6) AS lift, round(s.f / n, 6) AS support
FROM s JOIN z p ON p.m = s.x JOIN z q ON q.m = s.y, n WHERE s.f / p.f >= 0.6""")
def long_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules with two genres and more before the arrow, at the operator's own support and confidence, by lift."""
    model = mining.fit_itemsets(kept(_genre_baskets(spark, sf_dir).select("items"), "baskets"))
    rules = mining.association_rules(model)
    return rules.select(fx.itemset_label(F.col("antecedent")).alias("antecedent"), fx.itemset_label(F.col("consequent")).alias("consequent"), *(F.round(c, R).alias(c) for c in ("confidence", "lift", "support")))


_EVEN = _SETS.replace("FROM t JOIN names USING (g) GROUP BY", "FROM t JOIN names USING (g) WHERE user_id % 2 = 0 GROUP BY").replace("(SELECT DISTINCT user_id, day FROM t)", "(SELECT DISTINCT user_id, day FROM t WHERE user_id % 2 = 0)")


@query(_EVEN + """
, s AS (SELECT m, f, m - (1 << CAST(i AS int)) AS x, 1 << CAST(i AS int) AS y, g FROM z JOIN names ON m & (1 << CAST(i AS int)) <> 0, n WHERE bit_count(m) >= 3 AND f >= ceil(0.01 * n)),
r AS (SELECT x, y, s.g FROM s JOIN z p ON p.m = s.x WHERE s.f / p.f >= 0.3),
o AS (SELECT user_id, day, bit_or(1 << CAST(i AS int)) AS mask, string_agg(g, ',' ORDER BY g) AS items FROM t JOIN names USING (g) WHERE user_id % 2 = 1 GROUP BY user_id, day),
k AS (SELECT mask, string_agg(g, ',' ORDER BY g) AS prediction FROM (SELECT DISTINCT mask, r.g FROM (SELECT DISTINCT mask FROM o) JOIN r ON mask & x = x AND mask & y = 0) GROUP BY mask)
SELECT user_id, day, items, coalesce(prediction, '') AS prediction FROM o LEFT JOIN k USING (mask)""")
def rules_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules of the even users' baskets, with at least two genres before the arrow, applied to the odd users'."""
    rows = _genre_baskets(spark, sf_dir)
    model = mining.save_model(mining.fit_itemsets(rows.where("user_id % 2 = 0"), 0.01, 0.3), shared_path(spark, "rules"))
    return mining.apply_rules(model, rows.where("user_id % 2 = 1"), 2).select("user_id", "day", F.array_join("items", ",").alias("items"), F.array_join(F.sort_array("prediction"), ",").alias("prediction"))


@query()
def seq_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patterns in each user's ratings of the day, in order of time, at the operator's own support and length."""
    rows = fixtures.events(spark, sf_dir).withColumn("owner", F.concat_ws("-", "user_id", F.floor(F.col("timestamp") / 86400)))
    return mining.sequential_patterns(rows, "owner", "rating", ["timestamp", "event_id"]).select("label", "length", "freq")


@query()
def als_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User and item tables of implicit factors of the liked ratings."""
    users, items = models.embedding_tables(models.fit_embeddings(fixtures.ratings(spark, sf_dir)))
    return users.withColumn("side", F.lit("user")).unionByName(items.withColumn("side", F.lit("item"))).select("side", "id", F.size("embedding").alias("width"))


def _rated_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features by real movie ids; a fifth of the ratings, by the hash of their keys, is held out."""
    rows = _joined(spark, sf_dir, True)
    # weights are made once for each text of genres, not for each rating
    texts = rows.select("genres").distinct().select(F.col("genres").alias("__text"), fx.multi_hot_scaled(fx.genre_names(F.col("genres"))).alias("weights"))
    rows = rows.join(texts, F.col("genres").eqNullSafe(F.col("__text")))
    return rows.select("movie_id", fx.rating01(F.col("rating")).cast("float").alias("rating"), F.col("weights").alias("genres"), (F.pmod(F.xxhash64(*TIES), F.lit(5)) == 0).alias("held"))


@query()
def fm_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of the rating machine for two grid points, the better one marked."""
    rows = kept(_rated_features(spark, sf_dir), "rated-features")
    train, held = rows.where("not held"), rows.where("held")

    def errors(model) -> float:
        out = models.clipped(models.score_batches(models.genre_vectors(held), model))
        return ranking.error_metrics(out, "rating", "prediction").first()["rmse"]

    best, _, trials = models.search(lambda factors: models.fit_rating(train, factors=factors), [{"factors": 2}, {"factors": 4}], errors, largest=False)
    return spark.createDataFrame([(t["factors"], float(v), t == best) for t, v in trials], "factors int, rmse double, best boolean")


def _approved(spark: SparkSession, sf_dir: str):
    """A baseline on genres alone, a candidate that knows the movies too, and the gate between them."""
    rows = kept(_rated_features(spark, sf_dir), "rated-features")
    train, held = rows.where("not held"), models.genre_vectors(rows.where("held"))
    baseline = models.fit_rating(train.withColumn("movie_id", F.lit(0)))
    candidate = models.fit_rating(train)

    def metrics(model) -> dict[str, float]:
        e = ranking.error_metrics(models.clipped(models.score_batches(held, model)), "rating", "prediction").first()
        return {"rmse": -float(e["rmse"]), "mae": -float(e["mae"]), "count": float(e["n"])}

    return rows, *models.approve(baseline, candidate, metrics, {"rmse": -0.5, "count": 100.0}, rows)


@query()
def candidate_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Held-out metrics of the candidate, what it had to reach, and whether it did; errors are negative."""
    return _approved(spark, sf_dir)[1]


@query()
def approved_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every rating scored in a batch by the approved model, which is saved and loaded, summed up by movie."""
    rows, _, model = _approved(spark, sf_dir)
    path = shared_path(spark, "approved")
    model.save(path)
    scored = models.clipped(models.score_batches(models.genre_vectors(rows), models.RatingMachine.load(spark, path)))
    return scored.groupBy("movie_id").agg(F.count("*").alias("n"), F.avg("prediction").alias("mean_prediction"), F.avg("rating").alias("mean_rating"))


@query()
def drift_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors expected on the second half in time, by chunk, from a model of the first half's errors."""
    rows = kept(models.halves(fixtures.ratings(spark, sf_dir, True).withColumn("hr_wk", fx.hour_of_week(F.col("timestamp")).cast("double")), TIME_ORDER, 6000).drop(*TIES), "drift-rows")
    rows = kept(_guessed(rows, rows.where("period = 'reference'")), "drift-guessed")  # read by every pass of the fits
    analysis = rows.where("period = 'analysis'")
    return models.estimate_error(rows.where("period = 'reference'"), analysis, ["hr_wk", "movie_id"], "rating", "guess")


def _stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    path = f"{sf_dir}/{name}.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path if "*" in path else f"{sf_dir}/{name}.parque[t]")


@query(_GAP + """
SELECT movie_id AS item, n, last_step, round(b, 6) AS b, round(1 / greatest(b, 1e-6), 6) AS p FROM b""")
def stream_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """popularity_ema as keyed state over a stream of four micro-batches, some rows of which come a batch late; each item's last update."""
    rows = fixtures.table(spark, sf_dir, "events").select(F.get_json_object("props", "$.k").cast("bigint").alias("movie_id"), (F.floor(F.col("event_id") / 50) + 1).alias("step"), "event_id")
    ends = rows.agg(F.min("step").alias("low"), F.max("step").alias("high"))  # one row
    # event time has to order the steps, which ts need not do: they are spread evenly over 30 days after the first watermark, 0
    share = (F.col("step") - F.col("low")) / (F.col("high") - F.col("low") + 1)
    quarter = F.floor(4 * share) + (F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0).cast("int")
    dealt = kept(rows.crossJoin(F.broadcast(ends)).select("movie_id", "step", F.timestamp_micros(((1 + share * 30) * 86_400_000_000).cast("long")).alias("ts"), F.least(quarter, F.lit(3)).alias("part")), "stream-parts")
    source = shared_path(spark, "stream-source")
    for part in range(4):  # file by file, in the order of writing
        dealt.where(F.col("part") == part).drop("part").coalesce(1).write.mode("append").parquet(source)
    events = spark.readStream.schema(dealt.drop("part").schema).option("maxFilesPerTrigger", 1).parquet(source)
    out = jobs.run_available(jobs.stream_item_gap(events, "movie_id", "step", 0.1, "ts", "9 days"), shared_path(spark, "stream"), shared_path(spark, "state"), "update")
    return _round(out.groupBy("item").agg(F.max_by(F.struct("n", "last_step", "b", "p"), "micro_batch").alias("s")).select("item", "s.*"), "b", "p")


@query("""
SELECT user_id, movie_id, rating, (rating - 1) / 4 AS rating01, CASE gender WHEN 'F' THEN 0.0::double ELSE 1 END AS gender FROM fx_events JOIN fx_users USING (user_id) JOIN fx_movies USING (movie_id)""")
def stream_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows from a stream of events with static users and movies."""
    raw = _stream(spark, sf_dir, "events")
    kind = F.col("event_type")
    rating = F.when(kind == "purchase", 5).when(kind == "click", 4).when(kind == "view", 3).when(kind == "signup", 2).otherwise(1)
    rows = raw.select("user_id", F.get_json_object("props", "$.k").cast("bigint").alias("movie_id"), rating.alias("rating"), fixtures._epoch("ts").alias("timestamp"))
    out = jobs.run_available(jobs.stream_features(rows, fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir)), shared_path(spark, "stream"), shared_path(spark, "state"))
    return out.select("user_id", "movie_id", (F.col("rating") * 4 + 1).cast("int").alias("rating"), F.col("rating").cast("double").alias("rating01"), F.col("gender").cast("double").alias("gender"))


@query("""
, t AS (SELECT ts, r.rating, unnest(string_split(replace(genres, 'Children''s', 'Children'), '|')) AS genre FROM fx_events r JOIN events USING (event_id) JOIN fx_movies m ON m.movie_id = r.movie_id)
SELECT time_bucket(INTERVAL '1 day', ts) AS day, genre, count(*) AS n, round(avg(rating), 6) AS mean_rating FROM t GROUP BY ALL""")
def genre_trend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trend by day as a stream, complete after its last micro-batch."""
    raw = _stream(spark, sf_dir, "events")
    kind = F.col("event_type")
    rating = F.when(kind == "purchase", 5).when(kind == "click", 4).when(kind == "view", 3).when(kind == "signup", 2).otherwise(1)
    rows = raw.select(F.to_timestamp_ltz(F.col("ts").cast("string")).alias("ts"), F.get_json_object("props", "$.k").cast("bigint").alias("movie_id"), rating.alias("rating"))
    out = jobs.run_available(jobs.stream_genre_trend(rows, fixtures.movies(spark, sf_dir), "ts"), shared_path(spark, "stream"), shared_path(spark, "state"), "update")
    last = out.groupBy("start", "genre").agg(F.max_by(F.struct("n", "mean_rating"), "micro_batch").alias("s"))
    return last.select(F.col("start").cast("timestamp_ntz").alias("day"), "genre", "s.n", F.round("s.mean_rating", R).alias("mean_rating"))
