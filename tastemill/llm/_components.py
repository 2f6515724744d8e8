"""Connected components of an edge table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm._jobs import written_at
from tastemill.sources.folders import delete

#: nodes with more than this part of all edges are stars
STARS = 512
#: edges that a task writes at least, where there are so many
ROWS = 1 << 19


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of edges (a, b): root is the smallest node that it reaches.

    Nodes are longs and not null. Repeated edges, edges in both directions and chains of any
    length count once; an edge from a node to itself says nothing, so a node with no other
    edge is not in the result. No edges: no rows. Other columns are ignored.

    Each step re-hangs edges towards smaller neighbours; minima are aggregated before the
    shuffle, and the edges of star centres are not shuffled to get them (see _with_least).
    Steps are written to the shared folder, so lineage stays short, and each is deleted once
    the next one is there. Converges in about log steps.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, mark, path = _step(e)
    while mark is not None:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_least(both, 2 * mark[0]).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large, between = written_at(_in_few(large, 2 * mark[0]), "components-large")
        small = _with_least(large, mark[0]).select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e, new, after = _step(_in_few(small.distinct(), mark[0]))
        delete(e.sparkSession, between)
        delete(e.sparkSession, path)
        path = after
        if new == mark:
            break
        mark = new
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def _in_few(edges: DataFrame, n: int) -> DataFrame:
    """At most ``n`` edges in tasks, and so in files, of ROWS each, but in no fewer than there are cores: steps are many and small."""
    return edges.coalesce(max(edges.sparkSession.sparkContext.defaultParallelism, -(-n // ROWS)))


def _with_least(edges: DataFrame, n: int) -> DataFrame:
    """Edges (u, v, m) with the least v of their u, from at most ``n`` edges (u, v).

    Nodes with more than n / STARS edges, of which there are fewer than STARS whatever the
    size, get their minimum from a broadcast; only the edges of the others are shuffled.
    """
    least = edges.groupBy(F.col("u").alias("k")).agg(F.min("v").alias("m"), F.count("*").alias("c"))
    stars = least.where(F.col("c") > n // STARS).select(F.col("k").alias("star"), "m")
    asked = edges.join(F.broadcast(stars), F.col("u") == F.col("star"), "left")
    others = asked.where("m is null").select("u", "v").join(least.where(F.col("c") <= n // STARS), F.col("u") == F.col("k"))
    return asked.where("m is not null").select("u", "v", "m").unionByName(others.select("u", "v", "m"))


def _step(e: DataFrame) -> tuple[DataFrame, tuple | None, str]:
    """The edges, written; a mark that two equal edge sets share (None: no edges); and the path."""
    out, path = written_at(e, "components")
    n, mark = out.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    return out, (n, mark) if n else None, path
