"""Registered queries on joins, features and splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions import features as fx
from tastemill.functions.vocab import GENRES, OCCUPATIONS
from tastemill.operators import joins, ranks, splits
from tastemill.operators.ranks import in_parts
from tastemill.plans import fixtures
from tastemill.plans.fixtures import SQL, TIES
from tastemill.sources import delimited, sinks
from tastemill.sources.folders import shared_path

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TIME_ORDER = ["timestamp", "user_id", "movie_id", *TIES]


def query(oracle: str | None = None, views: bool = True):
    """Register a query under its function's name; the SQL may use the fixture views."""

    def add(f):
        QUERIES[f.__name__] = f
        if oracle is not None:
            ORACLES[f.__name__] = f"WITH {SQL}{oracle}" if views else oracle
        return f

    return add


def _joined(spark: SparkSession, sf_dir: str, ties: bool = False) -> DataFrame:
    return joins.join_ratings(fixtures.ratings(spark, sf_dir, ties), fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir), keep=TIES if ties else ())


_JOINED = """
SELECT user_id, movie_id, rating, timestamp, gender, age, occupation, genres FROM fx_ratings JOIN fx_users USING (user_id) JOIN fx_movies USING (movie_id)"""


@query(_JOINED)
def joined_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined(spark, sf_dir)


@query(_JOINED)
def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with dimensions sent to all tasks while they are small, and shuffled beyond."""
    users, movies = fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir)
    small = lambda d: "broadcast" if d.count() <= 200_000 else None  # noqa: E731  at most about 20 MB
    out = joins.join_one(fixtures.ratings(spark, sf_dir), users, "user_id", ("zipcode",), hint=small(users))
    return joins.join_one(out, movies, "movie_id", ("title",), hint=small(movies)).select(*joins.JOINED)


@query("""
, m AS (SELECT movie_id FROM fx_movies WHERE movie_id % 10 <> 0 UNION ALL SELECT movie_id FROM fx_movies WHERE movie_id % 10 = 1)
SELECT movie_id, 'duplicate' AS problem, count(*) AS n FROM m GROUP BY movie_id HAVING count(*) > 1
UNION ALL SELECT movie_id, 'missing', count(*) FROM fx_ratings WHERE movie_id % 10 = 0 GROUP BY movie_id""")
def key_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = fixtures.movies(spark, sf_dir)
    broken = movies.where("movie_id % 10 <> 0").unionByName(movies.where("movie_id % 10 = 1"))
    return joins.key_violations(fixtures.ratings(spark, sf_dir), broken, "movie_id")


@query("""
, t AS (SELECT rating, unnest(string_split(replace(genres, 'Children''s', 'Children'), '|')) AS genre FROM fx_ratings JOIN fx_users USING (user_id) JOIN fx_movies USING (movie_id))
SELECT rating, genre, count(*) AS n FROM t WHERE genre <> 'Unknown' GROUP BY ALL""")
def rating_genre_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _joined(spark, sf_dir).select("rating", F.explode(fx.genre_names(F.col("genres"))).alias("genre"))
    return rows.where(F.col("genre").isin(*GENRES)).groupBy("rating", "genre").agg(F.count("*").alias("n"))


_DATES = """
, d AS (SELECT *, CAST(floor(timestamp / 86400) AS bigint) AS days FROM {source}),
y AS (SELECT *, 1 + CAST(floor((days - 730) / 1461) AS bigint) AS ly FROM d),
z AS (SELECT *, CAST(floor((days - 730 - ly * 366) / 365) AS bigint) AS nly FROM y)"""
_SCALARS = """
SELECT user_id, movie_id, timestamp, round((rating - 1) / 4, 6) AS rating01, CASE gender WHEN 'F' THEN 0 WHEN 'M' THEN 1 ELSE -1 END AS gender,
  round(coalesce(list_position([1, 18, 25, 35, 45, 50, 56], age) - 1, -1) / 6, 6) AS age01, occupation,
  CAST(floor(timestamp / 3600) AS bigint) % 24 AS hr, (days + 3) % 7 AS weekday, (days + 3) % 7 * 24 + CAST(floor(timestamp / 3600) AS bigint) % 24 AS hr_wk,
  CAST(floor(days / 30) AS bigint) % 12 AS mon, 1972 + ly + nly AS yr, round(greatest(0, least(1, (1972 + ly + nly - 2000) / 50)), 6) AS yr_z,
  timestamp - (366 * ly + 365 * (nly + 2)) * 86400 AS sec_into_yr, year(make_date(CAST(days AS int))) AS cal_yr, month(make_date(CAST(days AS int))) - 1 AS cal_mon,
  timestamp - CAST(epoch(date_trunc('year', make_date(CAST(days AS int)))) AS bigint) AS cal_sec,
  greatest(0, least(999, movie_id - 500)) AS clipped, round(sin((days + 3) % 7 * 2 * pi() / 7), 6) AS week_sin, round(cos((days + 3) % 7 * 2 * pi() / 7), 6) AS week_cos
FROM z JOIN fx_users USING (user_id)"""


def _scalars(rows: DataFrame) -> DataFrame:
    ts = F.col("timestamp")
    week = fx.cyclical(fx.weekday(ts), 7)
    return rows.select(
        "user_id", "movie_id", "timestamp", F.round(fx.rating01(F.col("rating")), 6).alias("rating01"), fx.gender_code(F.col("gender")).alias("gender"), F.round(fx.age_scaled(F.col("age")), 6).alias("age01"), "occupation",
        fx.hour(ts).alias("hr"), fx.weekday(ts).alias("weekday"), fx.hour_of_week(ts).alias("hr_wk"), fx.month(ts).alias("mon"), fx.year(ts).alias("yr"), F.round(fx.year_scaled(ts), 6).alias("yr_z"), fx.seconds_into_year(ts).alias("sec_into_yr"),
        fx.year(ts, "calendar").alias("cal_yr"), fx.month(ts, "calendar").alias("cal_mon"), fx.seconds_into_year(ts, "calendar").alias("cal_sec"),
        fx.clip_id(F.col("movie_id"), 500, 1000).alias("clipped"), F.round(F.get(week, 0), 6).alias("week_sin"), F.round(F.get(week, 1), 6).alias("week_cos"),
    )


@query(_DATES.format(source="fx_events") + _SCALARS)
def feature_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalars(joins.join_one(fixtures.events(spark, sf_dir), fixtures.users(spark, sf_dir), "user_id", ("zipcode",)))


@query(_DATES.format(source="fx_ratings") + _SCALARS)
def feature_scalars_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on ratings, whose dates cover two leap years."""
    return _scalars(joins.join_one(fixtures.ratings(spark, sf_dir), fixtures.users(spark, sf_dir), "user_id", ("zipcode",)))


_HOT = ", ".join(f"len(list_filter(t, lambda x: x = '{g}')) AS c{i}" for i, g in enumerate(GENRES))


@query(f"""
, t AS (SELECT movie_id, string_split(replace(genres, 'Children''s', 'Children'), '|') AS t FROM fx_movies),
c AS (SELECT movie_id, {_HOT} FROM t), s AS (SELECT *, {' + '.join(f'c{i}' for i in range(18))} AS total FROM c)
SELECT movie_id, {', '.join(f'round(c{i} / nullif(total, 0), 6) AS g{i}' for i in range(18))}, concat_ws('|', {', '.join(f"CASE WHEN c{i} > 0 THEN '{g}' END" for i, g in enumerate(GENRES))}) AS names,
  {' + '.join(f'CASE WHEN c{i} > 0 THEN 1 ELSE 0 END' for i in range(18))} AS n_flags FROM s""")
def genre_multihot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.movies(spark, sf_dir).withColumn("w", fx.multi_hot_scaled(fx.genre_names(F.col("genres"))))
    names = [f"g{i}" for i in range(18)]
    spread = fx.spread(F.transform("w", lambda x: F.round(x.cast("double"), 6)), tuple(names))
    n_flags = F.coalesce(F.aggregate(fx.flags(F.col("w")), F.lit(0), lambda a, x: a + x), F.lit(0)).cast("long")
    return rows.select("movie_id", *spread, F.array_join(fx.names_of(F.col("w")), "|").alias("names"), n_flags.alias("n_flags"))


@query(f"""
SELECT user_id, {', '.join(f'CASE WHEN occupation = {i} THEN 1 ELSE 0 END AS o{i}' for i in range(21))}, CASE gender WHEN 'F' THEN 1 ELSE 0 END AS s0, CASE gender WHEN 'M' THEN 1 ELSE 0 END AS s1 FROM fx_users""")
def one_hot_occupation(spark: SparkSession, sf_dir: str) -> DataFrame:
    hot = fx.one_hot(F.col("occupation"), 21)
    return fixtures.users(spark, sf_dir).select("user_id", *fx.spread(hot, tuple(f"o{i}" for i in range(21))), *fx.spread(fx.one_hot(fx.gender_code(F.col("gender")), 2), ("s0", "s1")))


@query(f"""
SELECT movie_id, user_id, coalesce([{', '.join(repr(o) for o in OCCUPATIONS)}][occupation + 1], CAST(occupation AS varchar)) AS occupation, coalesce([{', '.join(repr(o) for o in OCCUPATIONS)}][occupation + 11], CAST(occupation + 10 AS varchar)) AS shifted,
  user_id || '::' || movie_id || '::' || rating || '::' || timestamp AS line, '[' || movie_id || ',' || user_id || ']' AS items, '(' || movie_id || ') -> (' || user_id || ')' AS pattern FROM fx_events JOIN fx_users USING (user_id)""")
def labels_and_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = joins.join_one(fixtures.events(spark, sf_dir), fixtures.users(spark, sf_dir), "user_id")
    pair = F.array("movie_id", "user_id")
    return rows.select(
        "movie_id", "user_id", fx.occupation_label(F.col("occupation")).alias("occupation"), fx.occupation_label(F.col("occupation") + 10).alias("shifted"),
        F.concat_ws("::", "user_id", "movie_id", "rating", "timestamp").alias("line"), fx.itemset_label(pair).alias("items"), fx.pattern_label(fx.singles(pair)).alias("pattern"),
    )


@query("""
SELECT user_id, movie_id, rating, timestamp, CASE WHEN rating > 3 THEN 'liked' WHEN rating = 3 THEN 'neutral' ELSE 'disliked' END AS sentiment FROM fx_ratings""")
def rating_sentiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.sentiment_split(fixtures.ratings(spark, sf_dir))


@query("""
, f AS (SELECT user_id FROM fx_ratings JOIN fx_movies USING (movie_id) WHERE rating >= 5 GROUP BY user_id HAVING count(*) FILTER (contains(genres, '|')) = 0 AND count(DISTINCT genres) = 1)
SELECT * FROM fx_users WHERE user_id IN (SELECT user_id FROM f)""")
def single_genre_users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.single_genre_users(fixtures.ratings(spark, sf_dir), fixtures.movies(spark, sf_dir), fixtures.users(spark, sf_dir))


@query("""
SELECT user_id, gender, occupation FROM fx_users WHERE occupation IN (1, 4, 12) AND user_id IN (SELECT user_id FROM fx_ratings WHERE rating = 5)""")
def selected_occupations(spark: SparkSession, sf_dir: str) -> DataFrame:
    fans = fixtures.ratings(spark, sf_dir).where("rating = 5").select("user_id")
    return fixtures.users(spark, sf_dir).where(F.col("occupation").isin(1, 4, 12)).join(fans, "user_id", "left_semi").select("user_id", "gender", "occupation")


@query("""
SELECT * FROM fx_movies WHERE movie_id NOT IN (SELECT movie_id FROM fx_events)""")
def unrated_movies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.without_partner(fixtures.movies(spark, sf_dir), fixtures.events(spark, sf_dir), "movie_id")


@query(f"""
SELECT m.movie_id, {', '.join(f'count(*) FILTER (rating = {s}) AS "{s}"' for s in range(1, 6))}, round(avg(rating), 6) AS mean_rating FROM fx_movies m LEFT JOIN fx_events USING (movie_id) GROUP BY m.movie_id""")
def rating_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = joins.pivot_mean(joins.rating_pivot(fixtures.events(spark, sf_dir), fixtures.movies(spark, sf_dir)))
    return out.withColumn("mean_rating", F.round("mean_rating", 6))


@query("""
SELECT CAST(floor(avg(timestamp)) AS bigint) AS mean_timestamp FROM fx_ratings""")
def mean_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.mean_timestamp(fixtures.ratings(spark, sf_dir))


@query("""
, n AS (SELECT occupation, count(*) AS group_size FROM fx_users GROUP BY occupation)
SELECT user_id, occupation, group_size FROM fx_users JOIN n USING (occupation)""")
def group_frequency_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.with_group_size(fixtures.users(spark, sf_dir), "occupation").select("user_id", "occupation", "group_size").orderBy(F.desc("group_size"), "occupation", "user_id")


@query("""
, m AS (SELECT movie_id AS movie_id_orig, 6040 + row_number() OVER (ORDER BY title, movie_id) AS movie_id FROM fx_movies)
SELECT r.user_id, m.movie_id, m.movie_id_orig, r.rating FROM fx_events r LEFT JOIN m ON m.movie_id_orig = r.movie_id""")
def id_renumber(spark: SparkSession, sf_dir: str) -> DataFrame:
    movies = fixtures.movies(spark, sf_dir)
    _, mapping = ranks.renumber(movies, "movie_id", ["title", "movie_id"], 6040)
    return fixtures.events(spark, sf_dir).withColumnRenamed("movie_id", "movie_id_orig").join(mapping, "movie_id_orig", "left").select("user_id", "movie_id", "movie_id_orig", "rating")



_RN = """
, r AS (SELECT *, row_number() OVER (ORDER BY timestamp, user_id, movie_id, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rn, count(*) OVER () AS n FROM fx_ratings)"""
_KEYS = "user_id, movie_id, rating, timestamp, l_orderkey, l_linenumber, l_suppkey"
_COLUMNS = [c.strip() for c in _KEYS.split(",")]


@query(_RN + f"""
SELECT {_KEYS}, CASE WHEN rn <= floor(n * 0.8) THEN 'train' WHEN rn <= floor(n * 0.8) + floor((n - floor(n * 0.8)) / 2) THEN 'val' ELSE 'test' END AS split FROM r""")
def time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.time_split(fixtures.ratings(spark, sf_dir, True), {"train": 0.8, "val": 0.1, "test": 0.1}, TIME_ORDER)
    return out.select(*_COLUMNS, "split")


@query(_RN + f"""
, u AS (SELECT user_id, row_number() OVER (ORDER BY (user_id % 2147483647 * 2654435761 + 42 * 40503) % 4294967296, user_id) AS k, count(*) OVER () AS nu FROM (SELECT DISTINCT user_id FROM r WHERE rn <= floor(n * 0.9)))
SELECT {_KEYS}, CASE WHEN rn > floor(n * 0.9) THEN 'test' WHEN k <= floor(nu * 0.8889) THEN 'train' ELSE 'val' END AS split FROM r LEFT JOIN u USING (user_id)""")
def user_time_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.time_user_split(fixtures.ratings(spark, sf_dir, True), TIME_ORDER).select(*_COLUMNS, "split")


@query(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (l_orderkey % 2147483647 * 2654435761 + 7 * 40503) % 4294967296, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos, count(*) OVER (PARTITION BY user_id) AS n FROM fx_ratings)
SELECT {_KEYS}, CASE WHEN pos = 0 THEN 'test' WHEN pos = 1 THEN 'val' WHEN pos = 2 THEN 'train' WHEN CAST(pos AS double) / n < 0.8::double THEN 'train' WHEN CAST(pos AS double) / n < 0.9::double THEN 'val' ELSE 'test' END AS split FROM r""")
def per_user_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = [ranks.shared_hash(F.col("l_orderkey"), 7), *(F.col(c) for c in TIES)]
    return splits.per_user_split(fixtures.ratings(spark, sf_dir, True), order).select(*_COLUMNS, "split")


@query("""
, h AS (SELECT *, sha256(concat_ws('|', user_id, movie_id, timestamp)) AS h FROM fx_ratings),
b AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(i * 8 + 1 AS int), 8))::bigint), lambda a, x: (a * 4294967296 + x) % 100, 0) AS b FROM h)
SELECT user_id, movie_id, timestamp, rating, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'eval' ELSE 'test' END AS split FROM b""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = splits.hash_split(fixtures.ratings(spark, sf_dir), {"train": 8, "eval": 1, "test": 1}, ["user_id", "movie_id", "timestamp"])
    return out.select("user_id", "movie_id", "timestamp", "rating", "split")


@query(f"""
, r AS (SELECT *, row_number() OVER (PARTITION BY rating > 3 ORDER BY timestamp, user_id, movie_id, l_orderkey, l_linenumber, l_partkey, l_suppkey) AS k FROM fx_ratings)
SELECT {_KEYS}, CASE WHEN rating > 3 THEN 'liked' ELSE 'other' END AS kind FROM r WHERE k <= 1000""")
def dev_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.ratings(spark, sf_dir, True).withColumn("kind", F.when(F.col("rating") > 3, "liked").otherwise("other"))
    return splits.dev_tier(rows, ["kind"], 1000, TIME_ORDER).select(*_COLUMNS, "kind")


@query("""
, p AS (SELECT *, row_number() OVER (PARTITION BY rating ORDER BY n DESC, movie_id) AS place FROM (SELECT rating, movie_id, count(*) AS n FROM fx_ratings GROUP BY ALL))
SELECT rating, movie_id, n, place FROM p WHERE place <= 20""")
def top_by_rating(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = in_parts(fixtures.ratings(spark, sf_dir).select("rating", "movie_id"), ["rating", "movie_id"], fixtures.rating_parts(spark, sf_dir))
    counts = rows.groupBy("rating", "movie_id").agg(F.count("*").alias("n"))
    return splits.top_by(counts, ["rating"], [F.desc("n"), F.col("movie_id")], 20)


@query("""
, o AS (SELECT user_id, row_number() OVER (ORDER BY (user_id % 2147483647 * 2654435761 + 3 * 40503) % 4294967296, user_id) - 1 AS i FROM fx_users)
SELECT user_id, CAST(floor(i / 256) AS bigint) AS batch_id, count(*) OVER (PARTITION BY floor(i / 256)) AS batch_rows FROM o""")
def batch_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = splits.assign_batches(fixtures.users(spark, sf_dir).select("user_id"), 256, "user_id", 3)
    return joins.with_group_size(rows, "batch_id", "batch_rows")


@query("""
SELECT event_id, true AS ok, date_trunc('second', ts) AS rebuilt, round(ln(rating), 6) AS log_rating, round(log2(rating + 1), 6) AS log2_rating,
  round(pow(2.0, rating) - 1, 6) AS gain, 'r' || rating AS first_set, rating + 1 AS with_bias_last, rating || ',' || rating + 1 || ',' || rating * 2 AS joined, CAST(round(rating / 2, 0) AS bigint) AS half_up, CAST(ceil(rating / 2) AS bigint) AS up
FROM fx_events JOIN (SELECT event_id, ts FROM events) USING (event_id)""")
def feature_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts, rating = F.col("timestamp"), F.col("rating")
    rebuilt = fx.timestamp_of(fx.year(ts, "calendar"), fx.seconds_into_year(ts, "calendar"))
    vector = fx.append_bias(F.array(rating), rating + 1)
    return fixtures.events(spark, sf_dir).select(
        "event_id", rebuilt.isNotNull().alias("ok"), rebuilt.alias("rebuilt"), F.round(F.log(rating), 6).alias("log_rating"), F.round(F.log2(rating + 1), 6).alias("log2_rating"), F.round(F.pow(F.lit(2.0), rating) - 1, 6).alias("gain"),
        F.concat(F.lit("r"), F.get(F.get(fx.singles(F.array(rating)), 0), 0).cast("string")).alias("first_set"), F.get(vector, 1).alias("with_bias_last"), F.array_join(fx.concat_vectors(vector, F.array(rating * 2)).cast("array<string>"), ",").alias("joined"), F.round(rating / 2).cast("long").alias("half_up"), F.ceil(rating / 2).alias("up"),
    )


@query("""
SELECT u.user_id, u.gender, u.age, u.occupation, (SELECT CAST(floor(avg(timestamp)) AS bigint) FROM fx_events) AS timestamp, 0 AS movie_id, '' AS genres FROM fx_users u
UNION ALL SELECT 0, '', 0, 0, -1, movie_id, genres FROM fx_movies""")
def entity_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = joins.mean_timestamp(fixtures.events(spark, sf_dir)).first()[0]
    users, movies = delimited.entity_inputs(fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir), mean)
    empty = {"user_id": 0, "gender": "", "age": 0, "occupation": 0, "timestamp": -1, "movie_id": 0, "genres": ""}
    return fx.with_defaults(users, empty).unionByName(fx.with_defaults(movies, empty))


@query("""
SELECT user_id, movie_id, rating, timestamp FROM fx_ratings""")
def roundtrip_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "text")
    sinks.write_delimited(fixtures.ratings(spark, sf_dir), path)
    spec = delimited.SourceSpec("ratings", path, (("user_id", int), ("movie_id", int), ("rating", int), ("timestamp", int)))
    return delimited.read_delimited(spark, spec)


@query("""
SELECT user_id, movie_id, rating, timestamp, CASE WHEN rating > 3 THEN 'liked' WHEN rating = 3 THEN 'neutral' ELSE 'disliked' END AS sentiment, CASE WHEN user_id % 2 = 0 THEN 'even' ELSE 'odd' END AS split FROM fx_ratings""")
def roundtrip_parquet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "export")
    rows = fixtures.ratings(spark, sf_dir).withColumn("split", F.when(F.col("user_id") % 2 == 0, "even").otherwise("odd"))
    sinks.export_ratings(rows, path)
    return spark.read.parquet(path)


@query("""
SELECT user_id, movie_id, rating, timestamp, CASE WHEN timestamp < 900000000 THEN 'train' ELSE 'eval' END AS split FROM fx_ratings""")
def presplit_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.ratings(spark, sf_dir)
    return splits.from_presplit({"train": rows.where("timestamp < 900000000"), "eval": rows.where("timestamp >= 900000000")})


@query("""
SELECT 'user' AS side, user_id AS id, zipcode AS label, occupation AS number FROM fx_users UNION ALL SELECT 'movie', movie_id, title, length(genres) FROM fx_movies""")
def roundtrip_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "entities")
    sinks.export_entities(fixtures.users(spark, sf_dir), fixtures.movies(spark, sf_dir), path)
    users = spark.read.parquet(f"{path}/users").select(F.lit("user").alias("side"), F.col("user_id").alias("id"), F.col("zipcode").alias("label"), F.col("occupation").alias("number"))
    return users.unionByName(spark.read.parquet(f"{path}/movies").select(F.lit("movie").alias("side"), F.col("movie_id").alias("id"), F.col("title").alias("label"), F.length("genres").alias("number")))


@query("""
SELECT user_id, movie_id, round((rating - 1) / 4, 6) AS rating, occupation, CAST(floor(timestamp / 3600) AS bigint) % 24 AS hr, CASE WHEN timestamp < 900000000 THEN 'train' ELSE 'eval' END AS split,
  len(list_distinct(list_filter(string_split(replace(genres, 'Children''s', 'Children'), '|'), lambda x: x <> 'Unknown'))) AS n_genres FROM fx_ratings JOIN fx_users USING (user_id) JOIN fx_movies USING (movie_id)""")
def roundtrip_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature rows written by split and read back, arrays included."""
    path = shared_path(spark, "features")
    sinks.export_features(_joined(spark, sf_dir).withColumn("split", F.when(F.col("timestamp") < 900_000_000, "train").otherwise("eval")), path)
    rows = spark.read.parquet(path)
    n_genres = F.size(F.filter("genres", lambda x: x > 0)).cast("long")
    return rows.select("user_id", "movie_id", F.round(F.col("rating").cast("double"), 6).alias("rating"), F.col("occupation").cast("int").alias("occupation"), F.col("hr").cast("long").alias("hr"), "split", n_genres.alias("n_genres"))


@query("""
, f AS (SELECT user_id FROM fx_ratings JOIN fx_movies USING (movie_id) WHERE rating >= 5 GROUP BY user_id HAVING count(*) FILTER (contains(genres, '|')) = 0 AND count(DISTINCT genres) = 1)
SELECT kind, user_id, gender, age, occupation, zipcode FROM fx_users, (VALUES ('text'), ('parquet')) k(kind) WHERE user_id IN (SELECT user_id FROM f)""")
def roundtrip_single_genre(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The single-genre users as text and as Parquet, read back from both."""
    path = shared_path(spark, "single-genre")
    sinks.export_rows(splits.single_genre_users(fixtures.ratings(spark, sf_dir), fixtures.movies(spark, sf_dir), fixtures.users(spark, sf_dir)), path)
    spec = delimited.SourceSpec("users", f"{path}/text", (("user_id", int), ("gender", str), ("age", int), ("occupation", int), ("zipcode", str)))
    text = delimited.read_delimited(spark, spec).withColumn("occupation", F.col("occupation").cast("int"))
    return text.select(F.lit("text").alias("kind"), "*").unionByName(spark.read.parquet(f"{path}/parquet").select(F.lit("parquet").alias("kind"), "*"))


@query("""
SELECT 6040 + row_number() OVER (ORDER BY title, movie_id) AS movie_id, movie_id AS movie_id_orig FROM fx_movies""")
def roundtrip_mapping(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mapping of renumbered movies, written as text and read back."""
    path = shared_path(spark, "mapping")
    _, mapping = ranks.renumber(fixtures.movies(spark, sf_dir), "movie_id", ["title", "movie_id"], 6040)
    sinks.write_mapping(mapping, path)
    spec = delimited.SourceSpec("movies", path, (("movie_id", int), ("movie_id_orig", int)), sep=",", header=True)
    return delimited.read_delimited(spark, spec)


@query("""
, h AS (SELECT *, sha256(concat_ws('|', user_id, gender, age, occupation, zipcode)) AS h FROM fx_users),
b AS (SELECT *, list_reduce(list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(i * 8 + 1 AS int), 8))::bigint), lambda a, x: (a * 4294967296 + x) % 100, 0) AS b FROM h)
SELECT user_id, gender, age, CAST(occupation AS bigint) AS occupation, zipcode, CASE WHEN b < 80 THEN 'train' WHEN b < 90 THEN 'eval' ELSE 'test' END AS split FROM b""")
def source_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users written with commas, read as a source that splits itself 8 : 1 : 1 by the hash of each row."""
    path = shared_path(spark, "source")
    sinks.write_delimited(fixtures.users(spark, sf_dir), path, ",")
    return delimited.read_split(spark, delimited.SourceSpec("users", path, (("user_id", int), ("gender", str), ("age", int), ("occupation", int), ("zipcode", str)), sep=","))


_USER_FIELDS = (("user_id", int), ("gender", str), ("age", int), ("occupation", int), ("zipcode", str))


@query("""
SELECT movie_id, title || ' é' AS title, genres FROM fx_movies""")
def mixed_encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Movies with an accent in each title, written half in UTF-8 and half in ISO-8859-1, read as one relation."""
    path = shared_path(spark, "mixed")
    rows = fixtures.movies(spark, sf_dir).select("movie_id", F.concat("title", F.lit(" é")).alias("title"), "genres")
    for odd, charset in ((0, "UTF-8"), (1, "ISO-8859-1")):
        rows.where(F.col("movie_id") % 2 == odd).write.option("sep", "::").option("encoding", charset).option("quote", "").csv(f"{path}/{charset}")
    return delimited.read_delimited(spark, delimited.SourceSpec("movies", f"{path}/*", (("movie_id", int), ("title", str), ("genres", str))))


@query("""
SELECT CASE WHEN user_id % 10 <> 0 THEN user_id END AS user_id, gender, CASE WHEN user_id % 15 <> 0 THEN age END AS age, CAST(occupation AS bigint) AS occupation, zipcode,
  concat_ws(',', CASE WHEN user_id % 10 = 0 THEN 'user_id' END, CASE WHEN user_id % 15 = 0 THEN 'age' END) AS rejected FROM fx_users""")
def rejected_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as text, some cells spoilt, cast to the declared types; the columns at fault are named."""
    spoilt = {"user_id": F.when(F.col("user_id") % 10 == 0, "no id").otherwise(F.col("user_id").cast("string")), "age": F.when(F.col("user_id") % 15 == 0, "old").otherwise(F.col("age").cast("string")), "occupation": F.col("occupation").cast("string")}
    schema = delimited.SourceSpec("users", "as text", _USER_FIELDS).schema
    out = delimited.cast_typed(fixtures.users(spark, sf_dir).withColumns(spoilt), schema, "reject")
    return out.withColumn("rejected", F.array_join("rejected", ","))


@query("""
SELECT user_id % 10 = 0 AS corrupt, count(*) AS n, count(DISTINCT zipcode) FILTER (user_id % 10 <> 0) AS zipcodes FROM fx_users GROUP BY ALL""")
def corrupt_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users as text with a header, every tenth id spoilt, read so that bad rows are kept apart."""
    path = shared_path(spark, "corrupt")
    sinks.write_delimited(fixtures.users(spark, sf_dir).withColumn("user_id", F.when(F.col("user_id") % 10 == 0, "no id").otherwise(F.col("user_id").cast("string"))), path, ",", header=True)
    rows = delimited.read_delimited(spark, delimited.SourceSpec("users", path, _USER_FIELDS, sep=",", header=True), "PERMISSIVE")
    corrupt = F.col("_corrupt").isNotNull()
    return rows.groupBy(corrupt.alias("corrupt")).agg(F.count("*").alias("n"), F.countDistinct(F.when(~F.col("_corrupt").isNotNull(), F.col("zipcode"))).alias("zipcodes"))


@query("""
SELECT 'joined' AS source, movie_id, count(*) AS n, CAST(sum(rating) AS bigint) AS stars FROM fx_ratings WHERE rating >= 3 GROUP BY movie_id""")
def kept_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joined ratings with a fixed column list, written by prefix, rewritten, and left alone where they are there; read by prefix."""
    path, columns = shared_path(spark, "kept"), ["user_id", "movie_id", "rating", "genres"]
    rows = _joined(spark, sf_dir)
    target = f"{path}/joined-1.parquet"
    sinks.write_dataset(rows, target, (), columns=columns)
    sinks.write_dataset(rows.where("rating >= 3"), target, (), "overwrite", columns=columns)
    sinks.write_dataset(rows, target, (), "ignore", columns=columns)
    out = delimited.read_parquet_prefix(spark, path, "joined")
    return out.groupBy("movie_id").agg(F.count("*").alias("n"), F.sum("rating").alias("stars")).select(F.lit("joined").alias("source"), "movie_id", "n", "stars")


@query("""
SELECT CAST(vec_id AS int) AS id, len(embedding) AS width, round(CAST(embedding[1] AS double), 5) AS first, round(CAST(embedding[len(embedding)] AS double), 5) AS last, '' AS problems FROM embeddings""", views=False)
def roundtrip_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings written as 32-bit ids and float lists and read back, with what differs from the source."""
    path = shared_path(spark, "embeddings")
    rows = fixtures.table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("int").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    sinks.write_embeddings(rows, path)
    back = spark.read.parquet(path)
    problems = ", ".join(sinks.readback_problems(back, rows))
    ends = [F.round(F.element_at("embedding", i).cast("double"), 5).alias(n) for i, n in ((1, "first"), (-1, "last"))]
    return back.select("id", F.size("embedding").cast("long").alias("width"), *ends, F.lit(problems).alias("problems"))
