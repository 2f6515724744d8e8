"""Reproducible splits: by hash, time, user and cohort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.features import sentiment
from tastemill.operators.ranks import global_row_number, shared_hash


def cumulative_buckets(weights: list[int]) -> list[int]:
    """Upper bounds of the splits, each truncated on its own; the last one is the modulus."""
    total, out, at = sum(weights), [], 0
    for w in weights:
        at += int(100 * (w / total))
        out.append(at)
    return out


def hash_bucket(key: Column, modulus: int) -> Column:
    """SHA-256 of a text as a number modulo a small one, folded over eight 32-bit parts."""
    digest = F.sha2(key.cast("string"), 256)
    out = F.lit(0).cast("long")
    for i in range(8):  # unrolled, so it stays inside generated code
        out = (out * 4294967296 + F.conv(F.substring(digest, i * 8 + 1, 8), 16, 10).cast("long")) % modulus
    return out


def hash_split(df: DataFrame, weights: dict[str, int], key_cols: list[str]) -> DataFrame:
    """Adds ``split``; equal keys get equal splits. Keys are integers or strings."""
    allowed = ("string", "bigint", "int", "smallint", "tinyint")
    for c, kind in df.select(*key_cols).dtypes:
        if kind not in allowed:
            raise TypeError(f"split key {c} is {kind}; integers and strings only")
    bounds = cumulative_buckets(list(weights.values()))
    bucket = hash_bucket(F.concat_ws("|", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in key_cols)), bounds[-1])
    out = df.withColumn("__bucket", bucket)
    split = F.lit(None).cast("string")
    for name, bound in reversed(list(zip(weights, bounds, strict=True))):
        split = F.when(F.col("__bucket") < bound, name).otherwise(split)
    return out.withColumn("split", split).drop("__bucket")


def from_presplit(frames: dict[str, DataFrame]) -> DataFrame:
    """One dataset from given parts, with their names in ``split``."""
    out = None
    for name, df in frames.items():
        part = df.withColumn("split", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out


def time_split(df: DataFrame, fractions: dict[str, float], order_by: list[str]) -> DataFrame:
    """Adds ``split`` by position in time: each split takes the floor of its share of what those before it leave.

    So of 19 rows at 0.8, 0.1, 0.1, train has 15, and val half of the other 4.
    """
    n = df.count()
    numbered = global_row_number(df, order_by, name="__rn")
    names, bound, left, split = list(fractions), 0, sum(fractions.values()), None
    for name in names[:-1]:
        bound += int((n - bound) * fractions[name] / left + 1e-9)
        left -= fractions[name]
        split = F.when(F.col("__rn") <= bound, name) if split is None else split.when(F.col("__rn") <= bound, name)
    return numbered.withColumn("split", split.otherwise(names[-1])).drop("__rn")


def time_user_split(df: DataFrame, order_by: list[str], test: float = 0.1, train_users: float = 0.8889, seed: int = 42) -> DataFrame:
    """The last rows in time are test; of the other rows' users a seeded share is train, the rest val."""
    n = df.count()
    numbered = global_row_number(df, order_by, name="__rn")
    rest = numbered.where(F.col("__rn") <= int(n * (1 - test) + 1e-9))
    users = rest.select("user_id").distinct().withColumn("__h", shared_hash(F.col("user_id"), seed))
    ranked = global_row_number(users, ["__h", "user_id"], name="__rank")
    chosen = ranked.select("user_id", (F.col("__rank") <= int(users.count() * train_users)).alias("__train"))
    split = F.when(F.col("__rn") > int(n * (1 - test) + 1e-9), "test").when(F.col("__train"), "train").otherwise("val")
    return numbered.join(chosen, "user_id", "left").withColumn("split", split).drop("__rn", "__train")


def per_user_split(df: DataFrame, order_by: list[Column], user: str = "user_id") -> DataFrame:
    """80 / 10 / 10 within each user: row 0 is test, 1 val, 2 train, then by relative position."""
    at = F.row_number().over(Window.partitionBy(user).orderBy(*order_by)) - 1
    out = df.withColumns({"__at": at, "__n": F.count("*").over(Window.partitionBy(user))})
    position = F.col("__at") / F.col("__n")
    split = F.when(F.col("__at") == 0, "test").when(F.col("__at") == 1, "val").when(F.col("__at") == 2, "train").when(position < 0.8, "train").when(position < 0.9, "val").otherwise("test")
    return out.withColumn("split", split).drop("__at", "__n")


def users_missing_a_split(df: DataFrame, n_splits: int = 3, user: str = "user_id") -> DataFrame:
    return df.groupBy(user).agg(F.countDistinct("split").alias("n_splits")).where(F.col("n_splits") < n_splits)


def sentiment_split(df: DataFrame) -> DataFrame:
    return df.withColumn("sentiment", sentiment(F.col("rating")))


def dev_tier(df: DataFrame, by: list[str], n: int, order_by: list[str]) -> DataFrame:
    """The first n rows of each group: a development tier."""
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))).where(F.col("__rn") <= n).drop("__rn")


def single_genre_users(ratings: DataFrame, movies: DataFrame, users: DataFrame, min_rating: int = 5) -> DataFrame:
    """Users whose high ratings all go to movies of one single genre."""
    liked = ratings.where(F.col("rating") >= min_rating).join(movies.select("movie_id", "genres"), "movie_id")
    fans = liked.groupBy("user_id").agg(F.count_if(F.contains("genres", F.lit("|"))).alias("multi"), F.countDistinct("genres").alias("genres"))
    return users.join(fans.where("multi = 0 and genres = 1").select("user_id"), "user_id", "left_semi")


def assign_batches(df: DataFrame, size: int, key: str, seed: int = 0) -> DataFrame:
    """Adds ``batch_id``: rows in a seeded order, cut into batches of ``size``."""
    rows = df.withColumn("__h", shared_hash(F.col(key), seed))
    numbered = global_row_number(rows, ["__h", key], name="__rn")
    return numbered.withColumn("batch_id", F.floor((F.col("__rn") - 1) / size)).drop("__rn", "__h")


def top_by(df: DataFrame, by: list[str], order_by: list[Column], n: int, name: str = "place") -> DataFrame:
    """The first n rows of each group, with their places."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order_by))).where(F.col(name) <= n)
