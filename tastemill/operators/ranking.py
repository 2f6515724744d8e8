"""In-batch scores, ranks of the true item, ranking metrics and losses, and top-k retrieval.

Score frames have (batch, qid, cid, score, weight): all queries of a batch against all its
candidates, the diagonal (qid = cid) being the true pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.functions.features import dot
from tastemill.operators.retrieval import BLOCK, Search

SCORES = "batch long, qid long, cid long, score double, weight double"
QUERIES = "batch long, qid long, rank long, weight double, true_score double, max_score double, log_sum double, best long"


def score_pairs(df: DataFrame, batch: str, key: str, query: str, cand: str, mask: str | None = None, weight: str | None = None) -> DataFrame:
    """Scores of all pairs of each batch; pairs that share ``mask`` are left out, but for the diagonal."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    q = df.select(F.col(batch).alias("batch"), F.col(key).alias("qid"), F.col(query).alias("__q"), w.alias("weight"), *([F.col(mask).alias("__qm")] if mask else []))
    c = df.select(F.col(batch).alias("__b"), F.col(key).alias("cid"), F.col(cand).alias("__c"), *([F.col(mask).alias("__cm")] if mask else []))
    pairs = q.join(c, F.col("batch") == F.col("__b"))
    if mask:
        pairs = pairs.where((F.col("qid") == F.col("cid")) | (F.col("__qm") != F.col("__cm")))
    return pairs.select("batch", "qid", "cid", dot(F.col("__q"), F.col("__c")).alias("score"), "weight")


def log_q(scores: DataFrame, frequency: DataFrame, temperature: float = 1.0, beta: float = 1.0) -> DataFrame:
    """Scores over the temperature, less ``beta`` times the log of each candidate's frequency (cid, p)."""
    p = F.greatest(F.coalesce(F.col("p"), F.lit(1e-6)), F.lit(1e-6))
    own = frequency.select(F.col("cid").alias("__cid"), "p")
    return scores.join(own, F.col("cid") == F.col("__cid"), "left").select("batch", "qid", "cid", (F.col("score") / temperature - beta * F.log(p)).alias("score"), "weight")


def query_ranks(scores: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """One row a query: rank of the true item, its score, the largest score, log of the sum of exponentials, best item."""
    # two aggregates by query on one partitioning: the true score first, then what is compared with it
    true = scores.where("qid = cid").select(F.col("batch").alias("__b"), F.col("qid").alias("__q"), F.col("score").alias("__true"))
    with_true = scores.join(true, (F.col("batch") == F.col("__b")) & (F.col("qid") == F.col("__q")))
    top = with_true.groupBy("batch", "qid", "weight", "__true").agg(
        F.count_if(F.col("score") >= F.col("__true") - tolerance).alias("rank"), F.max("score").alias("max_score"), F.log(F.sum(F.exp(F.col("score") - F.col("__true")))).alias("__l"), F.max_by("cid", F.struct("score", -F.col("cid"))).alias("best")
    )
    return top.select("batch", "qid", "rank", "weight", F.col("__true").alias("true_score"), "max_score", (F.col("__l") + F.col("__true")).alias("log_sum"), "best")


def inbatch_ranks(df: DataFrame, batch: str, key: str, query: str, cand: str, mask: str | None = None, weight: str | None = None, method: str = "arrow", temperature: float = 1.0, tolerance: float = 1e-6) -> DataFrame:
    """query_ranks of all pairs of each batch. "sql" joins the pairs; "arrow" makes one matrix product a batch.

    A batch is bounded by its size (assign_batches), so a task holds size ** 2 scores.
    """
    if method == "sql":
        scores = score_pairs(df, batch, key, query, cand, mask, weight)
        return query_ranks(scores.withColumn("score", F.col("score") / temperature), tolerance)
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    rows = df.select(F.col(batch).cast("long").alias("batch"), F.col(key).cast("long").alias("qid"), F.col(query).cast("array<double>").alias("q"), F.col(cand).cast("array<double>").alias("c"), w.alias("weight"), (F.col(mask) if mask else F.col(key)).cast("string").alias("mask"))

    def one(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("qid").reset_index(drop=True)
        s = np.stack(group.q.to_list()) @ np.stack(group.c.to_list()).T / temperature
        code = pd.factorize(group["mask"])[0]
        drop = code[:, None] == code[None, :]
        np.fill_diagonal(drop, False)
        s[drop] = -np.inf
        true, top = np.diag(s), s.max(axis=1)
        log_sum = np.log(np.exp(s - top[:, None]).sum(axis=1)) + top
        return pd.DataFrame({"batch": group.batch, "qid": group.qid, "rank": (s >= true[:, None] - tolerance).sum(axis=1), "weight": group.weight, "true_score": true, "max_score": top, "log_sum": log_sum, "best": group.qid.to_numpy()[s.argmax(axis=1)]})

    return rows.groupBy("batch").applyInPandas(one, QUERIES)


def weighted_mean(value: Column, weight: Column) -> Column:
    """A ratio that is 0 where no weight is."""
    return F.coalesce(F.try_divide(F.sum(value * weight), F.sum(weight)), F.lit(0.0))


def ranking_metrics(ranks: DataFrame, k: int = 20, by: tuple[str, ...] = ()) -> DataFrame:
    """Hit rate, and MRR, NDCG and recall at k; rows weigh by ``weight``."""
    r, w = F.col("rank"), F.col("weight")
    top = r <= k
    return ranks.groupBy(*by).agg(
        F.count("*").alias("queries"),
        weighted_mean((r == 1).cast("double"), w).alias("hit_rate"),
        weighted_mean(F.when(top, 1 / r).otherwise(0.0), w).alias("mrr"),
        weighted_mean(F.when(top, 1 / F.log2(r + 1)).otherwise(0.0), w).alias("ndcg"),
        weighted_mean(top.cast("double"), w).alias("recall"),
    )


def ndcg_by_part(ranks: DataFrame, parts: DataFrame, k: int = 20) -> DataFrame:
    """ranking_metrics by popularity part; ``parts`` has (qid, part)."""
    own = parts.select(F.col("qid").alias("__qid"), "part")
    return ranking_metrics(ranks.join(own, F.col("qid") == F.col("__qid")), k, ("part",))


def composite_ndcg(by_part: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted sum of the parts' NDCG; a part without queries counts 0."""
    weights = weights or {"head": 0.15, "torso": 0.35, "tail": 0.5}
    one = lambda p: F.coalesce(F.max(F.when(F.col("part") == p, F.col("ndcg"))), F.lit(0.0))
    return by_part.agg(*(one(p).alias(f"ndcg_{p}") for p in weights)).withColumn("composite", sum((F.col(f"ndcg_{p}") * w for p, w in weights.items()), F.lit(0.0)))


LOSSES = ("softmax", "heuristic", "lambda")


def inbatch_losses(ranks: DataFrame, kinds: tuple[str, ...] = LOSSES, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, kind, loss): means over queries, all kinds in one aggregate.

    softmax; weighted by 1 / ln(rank + 1) and relevance (heuristic); or by the NDCG to gain (lambda).
    """
    ce, r, y = F.col("log_sum") - F.col("true_score"), F.col("rank"), F.col("weight")
    loss = {
        "softmax": ce,
        "heuristic": ce * y / F.log(r + 1),
        "lambda": ce * ((F.pow(F.lit(2.0), y) - 1) * (1 - 1 / F.log2(r + 1)) + 1),
    }
    means = ranks.groupBy(*by).agg(*(F.avg(loss[k]).alias(k) for k in kinds))
    return means.select(*by, F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("loss")) for k in kinds))).alias("__l")).select(*by, "__l.*")


def inbatch_loss(ranks: DataFrame, kind: str = "softmax", by: tuple[str, ...] = ()) -> DataFrame:
    return inbatch_losses(ranks, (kind,), by).select(*by, "loss")


def score_stats(scores: DataFrame, by: tuple[str, ...] = ("batch",)) -> DataFrame:
    return scores.groupBy(*by).agg(F.min("score").alias("min_score"), F.max("score").alias("max_score"), F.avg("score").alias("mean_score"))


def error_metrics(df: DataFrame, y: str, y_hat: str, by: tuple[str, ...] = (), rollup: bool = False) -> DataFrame:
    e = F.col(y) - F.col(y_hat)
    group = df.rollup(*by) if rollup else df.groupBy(*by)
    return group.agg(F.count("*").alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.avg(e * e).alias("mse"))


def quality_gate(metrics: DataFrame, thresholds: dict[str, float], baseline: DataFrame | None = None) -> DataFrame:
    """(metric, value, bound, passed): metrics (metric, value) against lower bounds, and against a baseline's values."""
    bound = F.coalesce(*(F.when(F.col("metric") == m, F.lit(float(v))) for m, v in thresholds.items()), F.lit(float("-inf")))
    out = metrics.select("metric", F.col("value").cast("double").alias("value"), bound.alias("bound"))
    if baseline is not None:
        base = baseline.select(F.col("metric").alias("__m"), F.col("value").cast("double").alias("__v"))
        out = out.join(base, F.col("metric") == F.col("__m"), "left").select("metric", "value", F.greatest("bound", F.coalesce("__v", "bound")).alias("bound"))
    return out.withColumn("passed", F.col("value") >= F.col("bound"))


def top_k(queries: DataFrame, items: DataFrame, k: int, item_bytes: int = BLOCK, bias: str | None = None) -> DataFrame:
    """(qid, item, score, rank): the k items of largest inner product for each query (see retrieval.Search)."""
    return Search(queries, items, k, item_bytes, bias).result()
