import datetime as dt

import pytest
from pyspark.sql import functions as F

from tastemill.functions import features as fx
from tastemill.operators import joins


def stamp(y, m, d, h=0):
    return int(dt.datetime(y, m, d, h, tzinfo=dt.timezone.utc).timestamp())


DATES = [(2000, 1, 1), (2000, 12, 31), (2023, 1, 1), (2023, 12, 31), (2024, 1, 1), (2024, 12, 31), (2001, 6, 15), (1969, 12, 31)]


def test_dates(spark):
    rows = spark.createDataFrame([(stamp(*d, 5),) for d in DATES], "ts long")
    ts = F.col("ts")
    out = rows.select("ts", fx.hour(ts).alias("hr"), fx.weekday(ts).alias("wd"), fx.year(ts).alias("y"), fx.seconds_into_year(ts).alias("s"), fx.month(ts).alias("m"),
                      fx.year(ts, "calendar").alias("cy"), fx.seconds_into_year(ts, "calendar").alias("cs"), fx.month(ts, "calendar").alias("cm"),
                      fx.timestamp_of(fx.year(ts, "calendar"), fx.seconds_into_year(ts, "calendar")).alias("back")).collect()
    for r in out:
        when = dt.datetime.fromtimestamp(r.ts, dt.timezone.utc)
        assert (r.hr, r.wd, r.cy, r.cm) == (when.hour, when.weekday(), when.year, when.month - 1)
        assert r.cs == r.ts - stamp(when.year, 1, 1)
        assert r.back == when.replace(tzinfo=None)
        days = r.ts // 86400
        leap = 1 + (days - 730) // 1461
        other = (days - 730 - leap * 366) // 365
        assert (r.y, r.s, r.m) == (1972 + leap + other, r.ts - (366 * leap + 365 * (other + 2)) * 86400, days // 30 % 12)
    by = {r.ts: r for r in out}
    assert by[stamp(2023, 1, 1, 5)].y == 2023
    assert by[stamp(2024, 1, 1, 5)].y == 2023  # the first day of a leap year still counts to the year before


def test_genres_and_unknown_codes(spark):
    rows = spark.createDataFrame([("Action|Children's",), ("Action|Action|War",), ("Nothing",), ("",)], "g string")
    got = [r[0] for r in rows.select(fx.multi_hot_scaled(fx.genre_names(F.col("g")))).collect()]
    assert got[0][0] == 0.5 and got[0][3] == 0.5 and sum(got[0]) == 1
    assert got[1][0] == pytest.approx(2 / 3) and got[1][16] == pytest.approx(1 / 3)
    assert got[2] == got[3] == [None] * 18
    names = rows.select(fx.names_of(fx.multi_hot_scaled(fx.genre_names(F.col("g")))).alias("n")).collect()
    assert names[0].n == ["Action", "Children"] and names[2].n == []
    people = spark.createDataFrame([("F", 1), ("M", 56), ("?", 99), (None, None)], "g string, a int")
    assert [tuple(r) for r in people.select(fx.gender_code(F.col("g")), fx.age_scaled(F.col("a"))).collect()] == [(0, 0.0), (1, 1.0), (-1, -1 / 6), (-1, -1 / 6)]


def test_small_columns(spark):
    one = spark.createDataFrame([(3, 7.0, [1.0, 2.0])], "i int, x double, v array<double>")
    r = one.select(fx.one_hot(F.col("i"), 5).alias("hot"), fx.clip_id(F.col("i"), 10, 4).alias("clip"), fx.append_bias(F.col("v"), F.col("x")).alias("b"), fx.dot(F.col("v"), F.col("v")).alias("d"),
                   fx.rating_from01(F.lit(0.75)).alias("r"), fx.pattern_label(fx.singles(F.array(F.lit(1), F.lit(2)))).alias("p"), fx.occupation_label(F.lit(99)).alias("o")).first()
    assert (r.hot, r.clip, r.b, r.d, r.r, r.p, r.o) == ([0, 0, 0, 1, 0], 0, [1.0, 2.0, 7.0], 5.0, 4.0, "(1) -> (2)", "99")


def test_defaults(spark):
    rows = spark.createDataFrame([(1, None)], "a int, b string")
    assert fx.with_defaults(rows, {"a": 0, "b": "", "c": -1}).first().asDict() == {"a": 1, "b": "", "c": -1}


def test_enforced_join(spark):
    left = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    good = spark.createDataFrame([(1, "a", "z"), (2, "b", "z"), (3, "c", "z")], "k int, w string, zip string")
    assert sorted(tuple(r) for r in joins.join_one(left, good, "k", ("zip",)).collect()) == [(1, "x", "a"), (2, "y", "b")]
    for bad in (good.where("k <> 2"), good.unionByName(good.where("k = 2"))):
        with pytest.raises(Exception, match="without exactly one right row"):
            joins.join_one(left, bad, "k").count()
        with pytest.raises(Exception, match="without exactly one right row"):
            joins.join_one(left, bad, "k").collect()
    assert joins.join_one(left, good.where("k <> 2"), "k", enforce="drop").count() == 1
    problems = joins.key_violations(left, good.where("k <> 2").unionByName(good.where("k = 1")), "k")
    assert sorted(tuple(r) for r in problems.collect()) == [(1, "duplicate", 2), (2, "missing", 1)]


def test_pivot_and_diff(spark):
    ratings = spark.createDataFrame([(1, 5), (1, 5), (1, 3), (1, 9), (2, 1)], "movie_id int, rating int")
    movies = spark.createDataFrame([(1,), (2,), (3,)], "movie_id int")
    out = {r.movie_id: r for r in joins.pivot_mean(joins.rating_pivot(ratings, movies)).collect()}
    assert (out[1]["5"], out[1]["3"], out[1].mean_rating) == (2, 1, 13 / 3)
    assert out[3]["1"] == 0 and out[3].mean_rating is None
    other = ratings.where("movie_id = 1").unionByName(ratings.where("rating = 3"))
    assert sorted(tuple(r) for r in joins.dataset_diff(ratings, other, ["movie_id", "rating"]).collect()) == [(1, 3, 1, 2), (2, 1, 1, 0)]
