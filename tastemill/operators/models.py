"""Embeddings and rating models, their search, batch scoring and error estimates."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.recommendation import ALS, ALSModel
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.operators.machine import RatingMachine, fit_rating, genre_vectors
from tastemill.operators.profile import exact_percentiles
from tastemill.operators.ranking import quality_gate
from tastemill.operators.ranks import global_row_number, running

__all__ = ["RatingMachine", "approve", "chunked", "clipped", "embedding_tables", "estimate_by_feature", "estimate_error", "fit_embeddings", "fit_rating", "genre_vectors", "halves", "halving", "score_batches", "search"]


def fit_embeddings(ratings: DataFrame, rank: int = 16, iterations: int = 5, alpha: float = 10.0, reg: float = 0.05, seed: int = 1, min_rating: int = 4, confidence: str | None = None) -> ALSModel:
    """Implicit factors of liked ratings; ``confidence`` names a column that scales a row's confidence.

    Where the context has a checkpoint folder each iteration's item factors go there, for then
    ALS deletes the shuffle files that made them.
    """
    liked = ratings.where(F.col("rating") >= min_rating).select(F.col("user_id").cast("int").alias("user_id"), F.col("movie_id").cast("int").alias("movie_id"), (F.col(confidence) if confidence else F.lit(1.0)).cast("float").alias("preference"))
    return ALS(userCol="user_id", itemCol="movie_id", ratingCol="preference", implicitPrefs=True, rank=rank, maxIter=iterations, alpha=alpha, regParam=reg, seed=seed, coldStartStrategy="drop", checkpointInterval=1).fit(liked)


def embedding_tables(model: ALSModel) -> tuple[DataFrame, DataFrame]:
    """(user table, item table), both (id int, embedding array<float>)."""
    return model.userFactors.select("id", F.col("features").alias("embedding")), model.itemFactors.select("id", F.col("features").alias("embedding"))


def clipped(predictions: DataFrame, column: str = "prediction") -> DataFrame:
    """Predictions of a share, held in [0, 1]."""
    return predictions.withColumn(column, F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(column))))


def search(fit: Callable[..., object], grid: Iterable[dict], score: Callable[[object], float], largest: bool = True, at_once: int = 2) -> tuple[dict, object, list[tuple[dict, float]]]:
    """(best parameters, its model, all trials): every grid point is fitted and scored, ``at_once`` at a time; of equal ones the earlier is best."""

    def trial(params: dict) -> tuple[dict, object, float]:
        model = fit(**params)
        return params, model, score(model)

    with ThreadPoolExecutor(at_once) as pool:
        trials = list(pool.map(trial, grid))
    best = (max if largest else min)(trials, key=lambda t: t[2])
    return best[0], best[1], [(params, value) for params, _, value in trials]


def halving(grid: list[dict], score: Callable[..., float], shares: list[float], keep: float = 0.5, at_once: int = 2) -> list[tuple[int, float, dict, float, bool]]:
    """(rung, share, parameters, value, stays) of a search by successive halving; higher values are better.

    On each rung the trials that are left are scored on a larger share of the data, ``at_once``
    of them at a time, and the best ``keep`` of them go on; of equal ones the earlier. The
    last rung's best is the winner.
    """
    out, left = [], list(grid)
    for rung, share in enumerate(shares):
        with ThreadPoolExecutor(at_once) as pool:
            values = list(pool.map(lambda p, share=share: score(share=share, **p), left))
        order = sorted(range(len(left)), key=lambda i: (-values[i], i))
        best = set(order[: 1 if rung == len(shares) - 1 else max(1, round(len(left) * keep))])
        out += [(rung, share, left[i], values[i], i in best) for i in range(len(left))]
        left = [left[i] for i in sorted(best)]
    return out


def approve(baseline: RatingMachine, candidate: RatingMachine, errors: Callable[[RatingMachine], dict[str, float]], bounds: dict[str, float], df: DataFrame) -> tuple[DataFrame, RatingMachine]:
    """((metric, value, bound, passed), the approved model): a candidate must reach lower bounds and a baseline's values.

    ``errors`` gives a model's metrics on held-out rows, higher being better; the baseline stays
    approved if any of them fails. ``df`` only lends its session.
    """
    rows = lambda m: df.sparkSession.createDataFrame(sorted(errors(m).items()), "metric string, value double")
    verdict = quality_gate(rows(candidate), bounds, rows(baseline))
    return verdict, candidate if all(r.passed for r in verdict.select("passed").collect()) else baseline


def score_batches(df: DataFrame, model: RatingMachine) -> DataFrame:
    return model.transform(df)


def chunked(df: DataFrame, order_by: list[str], size: int) -> DataFrame:
    """Adds ``chunk``: consecutive rows in groups of ``size``."""
    return global_row_number(df, order_by, name="__rn").withColumn("chunk", F.floor((F.col("__rn") - 1) / size)).drop("__rn")


def halves(df: DataFrame, order_by: list[str], size: int | None = None) -> DataFrame:
    """Adds ``period``: the first half in order is reference, the rest analysis; with ``size`` also ``chunk``, as chunked gives it to the analysis."""
    placed = running(df, order_by)
    half = placed.count() // 2
    period = F.when(F.col("__rn") < half, "reference").otherwise("analysis")
    if size is None:
        return placed.withColumn("period", period).drop("__rn")
    return placed.withColumns({"period": period, "chunk": F.when(F.col("__rn") >= half, F.floor((F.col("__rn") - half) / size))}).drop("__rn")


def estimate_error(reference: DataFrame, analysis: DataFrame, features: list[str], y: str, y_hat: str, seed: int = 1, trees: int = 10) -> DataFrame:
    """(chunk, n, mae, rmse) expected on ``analysis`` before its labels are known.

    Two boosted-tree regressors learn the absolute and the squared error on ``reference``;
    their predictions are averaged by the column ``chunk`` of ``analysis``.
    """
    assembler = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    e = F.col(y) - F.col(y_hat)
    known = assembler.transform(reference.withColumns({"__abs": F.abs(e).cast("double"), "__sq": (e * e).cast("double")}))
    out = assembler.transform(analysis)
    for label in ("__abs", "__sq"):
        model = GBTRegressor(featuresCol="__features", labelCol=label, predictionCol=f"{label}_hat", maxIter=trees, maxDepth=3, seed=seed).fit(known)
        out = model.transform(out)
    return out.groupBy("chunk").agg(F.count("*").alias("n"), F.avg("__abs_hat").alias("mae"), F.sqrt(F.greatest(F.avg("__sq_hat"), F.lit(0.0))).alias("rmse"))


def estimate_by_feature(reference: DataFrame, analysis: DataFrame, features: list[str], y: str, y_hat: str, bins: int = 20) -> DataFrame:
    """(feature, chunk, n, mae, rmse) expected on ``analysis`` from one feature at a time.

    A feature's values are cut at its percentiles on ``reference``; a bin's mean errors there
    are what its rows are expected to have. Which feature moves the estimate is what it shows.
    """
    e, out = F.col(y) - F.col(y_hat), None
    shares = [i / bins for i in range(1, bins)]
    for name in features:
        cuts = exact_percentiles(reference, name, shares, name="__cuts").select("__cuts")  # one row
        value = F.col(name)
        place = F.size(F.filter("__cuts", lambda c: c < value)).alias("__bin")  # noqa: B023
        known = reference.crossJoin(F.broadcast(cuts)).groupBy(place).agg(F.avg(F.abs(e)).alias("__abs"), F.avg(e * e).alias("__sq"))
        rows = analysis.crossJoin(F.broadcast(cuts)).select("chunk", place)
        counted = rows.groupBy("chunk", "__bin").agg(F.count("*").alias("__n"))
        both = counted.join(known.withColumnRenamed("__bin", "__b"), F.col("__bin") == F.col("__b"), "left")
        mean = lambda c: F.sum(F.col("__n") * F.col(c)) / F.sum(F.when(F.col(c).isNotNull(), F.col("__n")))
        one = both.groupBy("chunk").agg(F.sum("__n").alias("n"), mean("__abs").alias("mae"), F.sqrt(mean("__sq")).alias("rmse")).select(F.lit(name).alias("feature"), "chunk", "n", "mae", "rmse")
        out = one if out is None else out.unionByName(one)
    return out
