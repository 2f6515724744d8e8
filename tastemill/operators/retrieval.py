"""Retrieval over the whole catalogue: exact top k that rules out blocks, ranks of known items, and rating biases."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.ranks import running
from tastemill.sources.folders import kept

TOP = "qid long, item long, score double"
COUNTED = "qid long, item long, n long"
#: bytes of the vectors of a block
BLOCK = 64 << 20
#: bytes of the scores that a task holds at once
SCORES = 64 << 20
#: products are compared with bounds and known scores up to rounding
SLACK = 1e-9


def _wide(df: DataFrame, key: str, last: Column | None) -> DataFrame:
    """(key, vector as doubles with ``last`` behind it, its norm)."""
    vector = F.col("vector").cast("array<double>")
    wide = df.select(F.col(key).cast("long").alias(key), (F.array_append(vector, last.cast("double")) if last is not None else vector).alias("vector"))
    return wide.withColumn("norm", F.sqrt(F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)))


def _blocks(df: DataFrame, each: int) -> int:
    n, width = df.agg(F.count("*"), F.max(F.size("vector"))).first()
    return max(1, min(n, -(-n * 8 * max(width or 0, 1) // each)))


def _matrix(t: pa.Table) -> np.ndarray:
    return t["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(t.num_rows, -1)


def _best(q: pa.Table, items: pa.Table, k: int) -> pa.Table:
    """The k best items of a block for each query of a block."""
    items = items.sort_by("item")
    names, qids, out = items["item"].to_numpy(), q["qid"].to_numpy(), []
    if len(names) and len(qids):
        matrix, asked = _matrix(items), _matrix(q)
        step = max(1, SCORES // (8 * len(matrix)))
        for at in range(0, len(qids), step):
            s = asked[at : at + step] @ matrix.T
            r = np.where(np.isnan(s), -np.inf, s) if np.isnan(s).any() else s
            # the k-th best score of each query; what reaches it, ties included, is sorted
            least = np.partition(r, len(names) - k, axis=1)[:, len(names) - k, None] if k < len(names) else r.min(axis=1, keepdims=True)
            q_, i_ = np.nonzero(r >= least)
            order = np.lexsort((i_, -r[q_, i_], q_))
            q_, i_ = q_[order], i_[order]
            best = np.arange(len(q_)) - np.searchsorted(q_, q_) < k
            q_, i_ = q_[best], i_[best]
            out.append((qids[at : at + step][q_], names[i_], s[q_, i_]))
    columns = [np.concatenate([o[i] for o in out]) if out else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64))]
    return pa.table(columns, names=["qid", "item", "score"])


class Search:
    """Exact top k by inner product: (qid, vector) against (item, vector), ``bias`` being an item column that is added.

    Items lie in blocks of about ``item_bytes`` by descending norm, and are searched one block
    first, then two, four and so on. The k-th best score that a query has by then is what the
    next blocks have to reach. Its product with a block's items is at most its norm times the
    block's largest one, so it goes to those blocks only that this lets through, and the
    search ends when none is left. Nothing is approximate: ties go to the smaller item.
    """

    def __init__(self, queries: DataFrame, items: DataFrame, k: int, item_bytes: int = BLOCK, bias: str | None = None):
        self.k = k
        wide = _wide(items, "item", F.col(bias) if bias else None).withColumn("turned", -F.col("norm"))
        asked = _wide(queries, "qid", F.lit(1.0) if bias else None)
        self.n_items, self.n_queries = _blocks(wide, item_bytes), _blocks(asked, item_bytes)
        ranked = running(wide, ["turned", "item"])
        n = ranked.count()
        self.items = kept(ranked.select("item", "vector", "norm", F.floor(F.col("__rn") * self.n_items / max(n, 1)).cast("int").alias("a")), "search-items")
        self.queries = kept(asked.withColumn("b", F.pmod(F.xxhash64("qid"), F.lit(self.n_queries)).cast("int")), "search-queries")
        #: (a, most): the largest norm of each block
        self.bounds = self.items.groupBy("a").agg(F.max("norm").alias("most"))
        self.found = kept(self._scan(self.queries.withColumn("a", F.lit(0)), self.items.where("a = 0")), "search-found")
        #: (a, b, qid): what each query has met
        self.met = self.queries.select(F.lit(0).alias("a"), "b", "qid")
        low, high = 1, 3
        while low < self.n_items:
            open_ = kept(self._open(low, high), "search-open")
            if open_.isEmpty():
                break  # later blocks have smaller norms
            self.met = self.met.unionByName(open_.select("a", "b", "qid"))
            new = self._scan(open_, self.items.where((F.col("a") >= low) & (F.col("a") < high)))
            self.found = kept(self._ranked(self.found.unionByName(new)).drop("rank"), "search-found")
            low, high = high, 2 * high + 1

    def _scan(self, queries: DataFrame, items: DataFrame) -> DataFrame:
        """The k best of each block for each query; both sides have their block, and items the block of queries they meet."""
        k = self.k
        met = queries.select("a", "b").distinct().withColumnsRenamed({"a": "a_", "b": "b_"})
        right = items.join(met, F.col("a") == F.col("a_")).select("a", F.col("b_").alias("b"), "item", "vector")
        return queries.select("a", "b", "qid", "vector").groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(lambda x, y: _best(x, y, k), TOP)

    def _ranked(self, found: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "item"))
        return found.withColumn("rank", rank).where(F.col("rank") <= self.k)

    def _open(self, low: int, high: int) -> DataFrame:
        """(a, b, qid, vector): each query with the blocks from low to high that may hold one of its best."""
        known = self._ranked(self.found).where(F.col("rank") == self.k).select(F.col("qid").alias("q"), "score")
        # one row: a number for each block
        norms = self.bounds.where((F.col("a") >= low) & (F.col("a") < high)).agg(F.collect_list(F.struct("a", "most")).alias("norms"))
        asked = self.queries.join(known, F.col("qid") == F.col("q"), "left").crossJoin(F.broadcast(norms))
        through = F.filter("norms", lambda x: F.col("score").isNull() | (x["most"] * F.col("norm") * (1 + SLACK) + SLACK >= F.col("score")))
        return asked.select("b", "qid", "vector", F.explode(F.transform(through, lambda x: x["a"])).alias("a"))

    def result(self) -> DataFrame:
        """(qid, item, score, rank)."""
        return self._ranked(self.found)

    def pairs(self) -> DataFrame:
        """(query_block, queries, item_blocks, scanned, skipped, queries_sent): the blocks of items that each block of queries met, and how often a query was sent to one."""
        queries = self.queries.groupBy(F.col("b").alias("query_block")).agg(F.count("*").alias("queries"))
        met = self.met.groupBy(F.col("b").alias("b_")).agg(F.countDistinct("a").alias("scanned"), F.count("*").alias("queries_sent"))
        both = queries.join(met, F.col("query_block") == F.col("b_"))
        return both.select("query_block", "queries", F.lit(self.n_items).alias("item_blocks"), "scanned", (F.lit(self.n_items) - F.col("scanned")).alias("skipped"), "queries_sent")


#: items of the first blocks that a search for places up to a limit counts, and by how many times each later round is larger
HEAD, GROWTH = 4096, 16


def _reached(q: pa.Table, items: pa.Table, slack: float) -> pa.Table:
    """How many items of a block reach the known score of each row of a block; equal queries that follow each other are scored once."""
    q = q.sort_by("qid")
    qids, known = q["qid"].to_numpy(), q["score"].to_numpy()
    n = np.zeros(len(qids), dtype=np.int64)
    if items.num_rows and len(qids):
        matrix, asked = _matrix(items), _matrix(q)
        step = max(1, SCORES // (8 * len(matrix)))
        for low in range(0, len(qids), step):
            _, first, at = np.unique(qids[low : low + step], return_index=True, return_inverse=True)
            s = asked[low : low + step][first] @ matrix.T
            n[low : low + step] = np.count_nonzero((s if len(first) == len(at) else s[at]) >= (known[low : low + step] - slack)[:, None], axis=1)
    return pa.table([q["qid"], q["item"], pa.array(n)], names=["qid", "item", "n"])


def _counted(met: DataFrame, wide: DataFrame, block: int, slack: float) -> DataFrame:
    """(qid, item, n): how many items reach the known score, block by block."""
    n_items, n_pairs = _blocks(wide, block), _blocks(met, block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = met.select("qid", "item", "vector", "score").withColumns({"b": F.pmod(F.xxhash64("qid", "item"), F.lit(n_pairs)).cast("int"), "a": every(n_items)}).groupBy("a", "b")
    right = wide.select("item", "vector").withColumns({"a": F.pmod(F.xxhash64("item"), F.lit(n_items)).cast("int"), "b": every(n_pairs)}).groupBy("a", "b")
    return left.cogroup(right).applyInArrow(lambda x, y: _reached(x, y, slack), COUNTED)


def catalogue_ranks(pairs: DataFrame, queries: DataFrame, items: DataFrame, bias: str | None = None, seen: DataFrame | None = None, block: int = BLOCK, slack: float = 1e-6, upto: int | None = None, head: int = HEAD) -> DataFrame:
    """(qid, item, rank, weight, score): the place of known items of (qid, item[, weight]) in the whole catalogue.

    rank counts the items whose product with the query reaches that of the known one, itself
    included. Blocks of pairs meet blocks of items, and a block says only how many of its
    items reach the score, so no list of scores leaves a task. Items in ``seen`` (qid, item)
    don't count, but for the known one. Pairs whose query or item has no vector are left out.

    With ``upto`` ranks are exact up to that place; one beyond it is only known to be beyond,
    and is given as ``upto + 1`` or more. That is all that metrics at ``upto`` ask for. Items
    are then met by descending norm, ``head`` of them first, then rounds of ``GROWTH`` times as
    many: a pair that more unseen items have reached than ``upto`` is settled and meets no others.
    """
    wide = kept(_wide(items, "item", F.col(bias) if bias else None), "ranks-items")
    asked = kept(_wide(queries, "qid", F.lit(1.0) if bias else None).drop("norm"), "ranks-queries")
    weight = F.col("weight").cast("double") if "weight" in pairs.columns else F.lit(1.0)
    known = pairs.select(F.col("qid").cast("long").alias("qid"), F.col("item").cast("long").alias("item"), weight.alias("weight")).dropDuplicates(["qid", "item"])
    product = F.aggregate(F.zip_with("vector", "other", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    other = wide.select(F.col("item").alias("i"), F.col("vector").alias("other"))
    asked_ = asked.select(F.col("qid").alias("q"), "vector")
    met = known.join(asked_, F.col("qid") == F.col("q")).join(other, F.col("item") == F.col("i")).select("qid", "item", "weight", "vector", product.alias("score"))
    gone = None
    if seen is not None:
        gone = kept(seen.select(F.col("qid").cast("long").alias("q"), F.col("item").cast("long").alias("gone")).distinct(), "ranks-seen")
    if upto is None:
        met = kept(met, "ranks-known")
        left, settled, counted = met, None, _counted(met, wide, block, slack)
    else:
        if gone is not None:  # at most so many of the items that reach a score don't count
            sizes = gone.groupBy(F.col("q").alias("q_")).agg(F.count("*").alias("own"))
            met = met.join(sizes, F.col("qid") == F.col("q_"), "left").withColumn("own", F.coalesce("own", F.lit(0).cast("long"))).drop("q_")
        else:
            met = met.withColumn("own", F.lit(0).cast("long"))
        left, counted, settled = kept(met.withColumn("n", F.lit(0).cast("long")), "ranks-known"), None, None
        placed = kept(running(wide.withColumn("turned", -F.col("norm")), ["turned", "item"], cheap=True).select("item", "vector", "__rn"), "ranks-placed")
        low, high, n = 0, head, placed.count()
        while low < n:
            round_ = _counted(left, placed.where((F.col("__rn") >= low) & (F.col("__rn") < high)), block, slack)
            new = round_.groupBy(F.col("qid").alias("q"), F.col("item").alias("i")).agg(F.sum("n").alias("new"))
            left = kept(left.join(new, (F.col("qid") == F.col("q")) & (F.col("item") == F.col("i"))).withColumn("n", F.col("n") + F.col("new")).drop("q", "i", "new"), "ranks-round")
            done = left.where(F.col("n") - F.col("own") > upto).select("qid", "item", (F.col("n") - F.col("own")).alias("rank"), "weight", "score")
            settled = done if settled is None else settled.unionByName(done)
            left = left.where(F.col("n") - F.col("own") <= upto)
            if left.isEmpty():
                break
            low, high = high, high * GROWTH
        counted = left.select("qid", "item", "n")
    if gone is not None:
        # an item that the query has seen is taken off again where it reaches the score
        own = left.join(gone, (F.col("qid") == F.col("q")) & (F.col("item") != F.col("gone"))).join(other, F.col("gone") == F.col("i"))
        counted = counted.unionByName(own.where(product >= F.col("score") - slack).groupBy("qid", "item").agg((-F.count("*")).alias("n")))
    total = counted.groupBy(F.col("qid").alias("q"), F.col("item").alias("i")).agg(F.sum("n").alias("rank"))
    out = left.drop("n").join(total, (F.col("qid") == F.col("q")) & (F.col("item") == F.col("i"))).select("qid", "item", "rank", "weight", "score")
    return out if settled is None else out.unionByName(settled)


def random_metrics(n: int, k: int = 20) -> dict[str, float]:
    """What ranking_metrics come to on average where the known item lies anywhere in a catalogue of n."""
    places = np.arange(1, min(k, n) + 1)
    return {"hit_rate": 1 / n, "mrr": float((1 / places).sum() / n), "ndcg": float((1 / np.log2(places + 1)).sum() / n), "recall": len(places) / n}


def item_biases(ratings: DataFrame, shrink: float = 25.0) -> tuple[float, DataFrame]:
    """(mean, (movie_id, bias)): the items of the first half round of rating_biases, in one aggregate by movie."""
    sums = kept(ratings.groupBy("movie_id").agg(F.sum(F.col("rating").cast("double")).alias("s"), F.count("rating").alias("n")), "item-sums")
    mean = float(sums.agg(F.sum("s") / F.sum("n")).first()[0] or 0.0)
    return mean, sums.select("movie_id", ((F.col("s") - mean * F.col("n")) / (F.col("n") + shrink)).alias("bias"))


def rating_biases(ratings: DataFrame, rounds: int = 10, shrink_user: float = 10.0, shrink_item: float = 25.0) -> tuple[float, DataFrame, DataFrame]:
    """(mean, (user_id, bias), (movie_id, bias)): what users and items add to the mean rating.

    Alternating shrunken means: an item's bias is the sum of what its ratings have over the
    mean and the users' biases, over their number and ``shrink_item``; then the same for
    users. Each half round is one aggregate. The mean alone reaches the driver.
    """
    cells = kept(ratings.groupBy("user_id", "movie_id").agg(F.sum(F.col("rating").cast("double")).alias("s"), F.count("rating").alias("n")), "bias-cells")
    mean = float(cells.agg(F.sum("s") / F.sum("n")).first()[0] or 0.0)
    left = F.col("s") - mean * F.col("n")

    def half(key: str, other: str, bias: DataFrame | None, shrink: float) -> DataFrame:
        rows, over = cells, left
        if bias is not None:
            rows, over = cells.join(bias.select(F.col(other).alias("k"), F.col("bias").alias("off")), F.col(other) == F.col("k")), left - F.col("n") * F.col("off")
        return kept(rows.groupBy(key).agg((F.sum(over) / (F.sum("n") + shrink)).alias("bias")), f"bias-{key}")

    users = items = None
    for _ in range(max(rounds, 1)):
        items = half("movie_id", "user_id", users, shrink_item)
        users = half("user_id", "movie_id", items, shrink_user)
    return mean, users, items
