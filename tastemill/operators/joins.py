"""Enforced dimension joins, set differences and the joined ratings relation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tastemill.operators.ranks import in_parts

JOINED = ("user_id", "movie_id", "rating", "timestamp", "gender", "age", "occupation", "genres")


def key_violations(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, problem, n): keys of the left side that the right side lacks, and keys it has more than once."""
    right_keys = right.groupBy(key).agg(F.count("*").alias("n"))
    repeated = right_keys.where("n > 1").select(key, F.lit("duplicate").alias("problem"), "n")
    missing = left.join(right_keys, key, "left_anti").groupBy(key).agg(F.count("*").alias("n")).select(key, F.lit("missing").alias("problem"), "n")
    return repeated.unionByName(missing)


def _counted(right: DataFrame, key: str) -> DataFrame:
    """A row for each key with ``__n``, how many the dimension has."""
    return right.groupBy(key).agg(F.count("*").alias("__n"), *(F.first(c).alias(c) for c in right.columns if c != key))


def _checked(key: str, *row: str) -> Column:
    """True where there is one right row, an error elsewhere; ``row`` names columns that the message adds."""
    said = [F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in (key, *row)]
    message = F.concat(F.lit(f"{key} without exactly one right row: "), F.concat_ws(", ", *said))
    return F.when(F.coalesce("__n", F.lit(0)) == 1, F.lit(True)).otherwise(F.raise_error(message).cast("boolean"))


def join_one(left: DataFrame, right: DataFrame, key: str, drop: tuple[str, ...] = (), enforce: str = "error", hint: str | None = None) -> DataFrame:
    """Join a fact with a dimension that has one row for each key.

    ``enforce="error"`` fails when a left key is missing or repeated on the right side;
    ``"drop"`` is an inner join. ``hint`` may be "broadcast" for a dimension of known size.
    """
    dim = right.drop(*drop)
    if enforce == "drop":
        return left.join(dim.hint(hint) if hint else dim, key, "inner")
    if enforce != "error":
        raise ValueError("enforce is 'error' or 'drop'")
    one = _counted(dim, key)
    joined = left.join(one.hint(hint) if hint else one, key, "left")
    # as a filter the check can't be pruned, whatever columns are used later
    return joined.where(_checked(key)).select(*left.columns, *(c for c in dim.columns if c != key))


def join_over(left: DataFrame, bridge: DataFrame, on: tuple[str, str], right: DataFrame, key: str) -> DataFrame:
    """A fact joined with a bridge, whose column ``key`` it gets, and with a dimension that has one row for each of these keys.

    As join_one of the fact and the bridge, with the same error; but the dimension meets the
    bridge, which has fewer rows, so the fact is shuffled once. ``on`` names the columns of
    fact and bridge that are equal. Rows of the bridge that no fact has are not checked.
    """
    met = bridge.join(_counted(right, key), key, "left")
    joined = left.join(met, F.col(on[0]) == F.col(on[1]))
    # a filter that reads a column of the fact can't be moved below the join, to bridge rows without a fact
    return joined.where(_checked(key, next(c for c in left.columns if c != on[0]))).select(*left.columns, key, *(c for c in right.columns if c != key))


def join_ratings(ratings: DataFrame, users: DataFrame, movies: DataFrame, enforce: str = "error", hint: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Ratings with user and movie columns, zipcode and title left out; ``keep`` names further rating columns."""
    out = join_one(ratings, users, "user_id", ("zipcode",), enforce, hint)
    return join_one(out, movies, "movie_id", ("title",), enforce, hint).select(*JOINED, *keep)


def missing_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Distinct keys of the left side that the right side lacks."""
    return left.select(key).join(right.select(key), key, "left_anti").distinct()


def without_partner(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Rows of the left side whose key the right side lacks."""
    return left.join(right.select(key), key, "left_anti")


def rating_pivot(ratings: DataFrame, movies: DataFrame, stars: range = range(1, 6)) -> DataFrame:
    """Counts of each rating by movie, with zero rows for movies that nobody rated."""
    rated = ratings.groupBy("movie_id").agg(*(F.count_if(F.col("rating") == s).alias(str(s)) for s in stars))
    unrated = missing_keys(movies, ratings, "movie_id").select("movie_id", *(F.lit(0).cast("long").alias(str(s)) for s in stars))
    return rated.unionByName(unrated)


def pivot_mean(pivot: DataFrame, stars: range = range(1, 6)) -> DataFrame:
    """Adds the mean rating of each row; null where there are no votes."""
    votes, total = sum((F.col(str(s)) for s in stars), F.lit(0)), sum((F.col(str(s)) * s for s in stars), F.lit(0))
    return pivot.withColumn("mean_rating", F.try_divide(total, votes))


def mean_timestamp(df: DataFrame, column: str = "timestamp") -> DataFrame:
    return df.agg(F.floor(F.avg(column)).cast("long").alias("mean_timestamp"))


def with_group_size(df: DataFrame, by: str, name: str = "group_size") -> DataFrame:
    """Each row with the number of rows of its group: an aggregate joined back, so that no group meets in one task."""
    sizes = df.groupBy(F.col(by).alias("__by")).agg(F.count("*").alias(name))
    return df.join(sizes, F.col(by).eqNullSafe(F.col("__by")), "left").drop("__by")


def dataset_diff(a: DataFrame, b: DataFrame, columns: list[str], parts: int | None = None) -> DataFrame:
    """Rows whose numbers of copies differ, with both numbers; ``parts``: see ranks.in_parts."""
    one = lambda d, n: d.select(*columns, *(F.lit(int(n == c)).cast("long").alias(c) for c in ("n_a", "n_b")))
    # equal keys null-safely: a union and one aggregate instead of a full join
    both = in_parts(one(a, "n_a").unionByName(one(b, "n_b")), columns, parts)
    return both.groupBy(*columns).agg(F.sum("n_a").alias("n_a"), F.sum("n_b").alias("n_b")).where("n_a <> n_b")
