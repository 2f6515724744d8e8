"""A factorization machine of movies and genres whose movie weights are a table."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.functions.vocab import GENRES
from tastemill.sources.folders import kept

WIDTH = len(GENRES)
STATE = "movie_id long, inputs array<struct<genre_weights:array<double>,n:long,mean:double>>, state array<double>, partial array<double>"
#: steps after which the movies' weights are written, so that lineage stays short
WRITE_EVERY = 10


def gradient(weights: list[np.ndarray], movie: np.ndarray, genres: np.ndarray, n: np.ndarray, mean: np.ndarray) -> list[np.ndarray]:
    """Of the summed squared loss: for the intercept, genres and genre factors, and for each input's movie and its factors."""
    intercept, w_movie, v_movie, w_genre, v_genre = weights
    v = v_movie[movie]
    side = genres @ v_genre
    both = v + side
    guess = intercept + w_movie[movie] + genres @ w_genre + (both**2 - v**2 - genres**2 @ v_genre**2).sum(1) / 2
    d = 2 * n * (guess - mean)
    return [d.sum(keepdims=True), genres.T @ d, genres.T @ (d[:, None] * both) - (genres.T**2 @ d)[:, None] * v_genre, d, d[:, None] * side]


class Adam:
    """Steps of one size for a flat array of weights."""

    def __init__(self, step: float):
        self.step = step

    def __call__(self, w: np.ndarray, first: np.ndarray, second: np.ndarray, g: np.ndarray, i: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        return w - self.step * (first / (1 - 0.9**i)) / (np.sqrt(second / (1 - 0.999**i)) + 1e-8), first, second


def _shared(flat: np.ndarray, factors: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(intercept, genre weights, genre factors) of their flat array."""
    return flat[:1], flat[1 : 1 + WIDTH], flat[1 + WIDTH :].reshape(WIDTH, factors)


def _advance(batches: Iterator[pa.RecordBatch], shared: np.ndarray, total: float, factors: int, adam: Adam, i: int) -> Iterator[pa.RecordBatch]:
    """The movies of a partition after a step of their own, and one row with the partition's part of the shared gradient."""
    partial = np.zeros(len(shared))
    intercept, w_genre, v_genre = _shared(shared, factors)
    for b in batches:
        if not b.num_rows:
            continue
        inputs = b.column(1)
        lengths = np.asarray(inputs.value_lengths())
        rows = inputs.flatten()
        genres, n, mean = (rows.field(c) for c in ("genre_weights", "n", "mean"))
        state = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, 3, 1 + factors)
        movie = np.repeat(np.arange(b.num_rows), lengths)
        g = gradient([intercept, state[:, 0, 0], state[:, 0, 1:], w_genre, v_genre], movie, genres.flatten().to_numpy().reshape(-1, WIDTH), n.to_numpy(), mean.to_numpy())
        partial += np.concatenate([x.ravel() for x in g[:3]])
        own = np.zeros((b.num_rows, 1 + factors))
        np.add.at(own, movie, np.concatenate([g[3][:, None], g[4]], axis=1))
        new = np.stack(adam(state[:, 0], state[:, 1], state[:, 2], own / total, i), axis=1)
        flat = pa.array(new.ravel())
        moved = pa.ListArray.from_arrays(np.arange(b.num_rows + 1, dtype=np.int32) * (3 * (1 + factors)), flat)
        yield pa.RecordBatch.from_arrays([b.column(0), inputs, moved, pa.nulls(b.num_rows, pa.list_(pa.float64()))], names=["movie_id", "inputs", "state", "partial"])
    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, inputs_type()), pa.nulls(1, pa.list_(pa.float64())), pa.array([partial.tolist()])], names=["movie_id", "inputs", "state", "partial"])


def inputs_type() -> pa.DataType:
    return pa.list_(pa.struct([("genre_weights", pa.list_(pa.float64())), ("n", pa.int64()), ("mean", pa.float64())]))


class RatingMachine:
    """prediction = intercept + movie weight + genre weights + products of the factors of movie and genres."""

    def __init__(self, movies: DataFrame, shared: list[float], factors: int):
        #: (movie_id, weights): a movie's own weight, then its factors
        self.movies, self.shared, self.factors = movies, shared, factors

    def transform(self, df: DataFrame) -> DataFrame:
        """Adds ``prediction`` to rows with movie_id and genre_weights; a new movie weighs nothing."""
        _, w_genre, v_genre = _shared(np.array(self.shared), self.factors)
        g = F.col("genre_weights")
        # term by term, which is compiled, and not by functions on arrays, which are called for each element
        product = lambda ws: sum((F.get(g, i) * float(x) for i, x in enumerate(ws)), F.lit(0.0))
        squares = sum((F.get(g, i) * F.get(g, i) * float(x) for i, x in enumerate((v_genre**2).sum(axis=1))), F.lit(0.0))
        own = lambda i: F.coalesce(F.get("__own", F.lit(i)), F.lit(0.0))
        pairs = -squares
        for f in range(self.factors):
            side = product(v_genre[:, f])
            pairs = pairs + 2 * own(f + 1) * side + side * side  # (v + side)^2 - v^2
        named = self.movies.select(F.col("movie_id").alias("__movie"), F.col("weights").alias("__own"))
        out = df.join(named, F.col("movie_id") == F.col("__movie"), "left")
        return out.withColumn("prediction", F.lit(float(self.shared[0])) + own(0) + product(w_genre) + pairs / 2).drop("__movie", "__own")

    def save(self, path: str) -> None:
        """The movies' weights as a table, the rest, a few numbers, beside it."""
        self.movies.write.parquet(f"{path}/movies")
        note = json.dumps({"shared": list(self.shared), "factors": self.factors})
        self.movies.sparkSession.createDataFrame([(note,)], "value string").coalesce(1).write.text(f"{path}/shared")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> RatingMachine:
        note = json.loads(spark.read.text(f"{path}/shared").first()[0])
        return cls(spark.read.parquet(f"{path}/movies"), note["shared"], note["factors"])


def genre_vectors(df: DataFrame) -> DataFrame:
    """Adds genre_weights (array of doubles); unknown genres weigh nothing."""
    return df.withColumn("genre_weights", F.transform(F.coalesce("genres", F.array_repeat(F.lit(0.0).cast("float"), WIDTH)), lambda x: F.coalesce(x, F.lit(0.0)).cast("double")))


def fit_rating(df: DataFrame, factors: int = 4, iterations: int = 30, step: float = 0.05, seed: int = 1) -> RatingMachine:
    """A machine for the rating in [0, 1]; input: movie_id, genres (array), rating, which must not be null.

    Ratings are first counted by distinct input, with their mean. A movie's inputs, weights
    and moments are one row, so a step of Adam moves the movies where they lie, without a
    shuffle; what reaches the driver is the sum of the gradients of intercept, genre weights
    and genre factors, whose number does not depend on the data.
    """
    rating = F.coalesce(F.col("rating").cast("double"), F.raise_error(F.lit("a rating is null")).cast("double"))
    inputs = genre_vectors(df).groupBy(F.col("movie_id").cast("long").alias("movie_id"), "genre_weights").agg(F.count("*").alias("n"), F.avg(rating).alias("mean"))
    rows = inputs.groupBy("movie_id").agg(F.collect_list(F.struct("genre_weights", "n", "mean")).alias("inputs"))
    # small starting factors that depend on the movie alone
    start = F.concat(F.array(F.lit(0.0)), F.array(*(0.01 * (F.pmod(F.xxhash64("movie_id", F.lit(seed), F.lit(f)), F.lit(2000)) / 1000 - 1) for f in range(factors))), F.array_repeat(F.lit(0.0), 2 * (1 + factors)))
    state = kept(rows.select("movie_id", "inputs", start.alias("state")), "machine-0")
    total = state.select(F.explode("inputs.n").alias("n")).agg(F.sum("n")).first()[0] or 1
    shared = np.concatenate([np.zeros(1 + WIDTH), np.random.default_rng(seed).normal(0, 0.01, WIDTH * factors)])
    first, second, adam, before = np.zeros_like(shared), np.zeros_like(shared), Adam(step), None
    for i in range(1, iterations + 1):
        out = state.mapInArrow(lambda b, s=shared, i=i: _advance(b, s, total, factors, adam, i), STATE).persist(StorageLevel.MEMORY_AND_DISK)
        parts = out.where("partial is not null").select(F.posexplode("partial")).groupBy("pos").agg(F.sum("col").alias("g"))
        g = np.zeros_like(shared)
        for r in parts.collect():  # one row for each shared weight
            g[r.pos] = r.g
        shared, first, second = adam(shared, first, second, g / total, i)
        state = out.where("partial is null").select("movie_id", "inputs", "state")
        if before is not None:
            before.unpersist()
        before = out
        if i % WRITE_EVERY == 0 or i == iterations:
            state = kept(state, f"machine-{i}")
            before.unpersist()
            before = None
    return RatingMachine(state.select("movie_id", F.slice("state", 1, 1 + factors).alias("weights")), shared.tolist(), factors)
