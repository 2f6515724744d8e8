"""Distance covariance and correlation in n log n, for many pairs of columns at once.

With a_ij = |x_i - x_j| and b_ij = |y_i - y_j|, the row sums of a and b follow from running
sums in the order of x and of y, whatever the order of equal values, whose distance is 0. The
sum of a_ij b_ij needs the pairs of points of which one is smaller in both. The order of x is
cut into chunks and so is that of y. Pairs of one chunk of x are added up there, pairs of one
chunk of y and two of x in that chunk of y, and all others from the sums of the cells of the
grid of chunks. So the points are sorted once in each order, and once only where x has few
values, each of which is a chunk then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.ranks import RANGE
from tastemill.sources.folders import kept

#: points of a chunk, which a task adds up at once
RUN = 1 << 18
#: values of a column that are chunks of their own, in a table that all tasks get
FEW = 1 << 12
SUMS = ("w", "wx", "wy", "wxy")
OWN = ("first", "n", "sx", "sy", "sxx", "syy", "sxy", "ra", "raa", "u", "l", "uu", "ul", "ll", "rau", "ral", "c")


def _cells(df: DataFrame, pairs: list[tuple[str, str]], grid: int | None) -> DataFrame:
    """(p, x, y, w): the distinct values of each pair of columns with their numbers of rows, both centred on their means."""
    both = [F.struct(F.lit(i).alias("p"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")) for i, (x, y) in enumerate(pairs)]
    points = df.select(F.explode(F.array(*both)).alias("c")).select("c.*").where("x is not null and y is not null")
    cells = points.groupBy("p", "x", "y").agg(F.count("*").cast("double").alias("w"))
    # one row for each pair of columns
    about = cells.groupBy(F.col("p").alias("p_")).agg(*((F.sum(F.col("w") * F.col(c)) / F.sum("w")).alias(f"m{c}") for c in "xy"), *(f(c).alias(f"{n}{c}") for c in "xy" for n, f in (("lo", F.min), ("hi", F.max))))
    cells = cells.join(F.broadcast(about), F.col("p") == F.col("p_"))
    if grid:
        snap = lambda c: F.col(f"lo{c}") + F.least(F.coalesce(F.floor(F.try_divide(F.col(c) - F.col(f"lo{c}"), (F.col(f"hi{c}") - F.col(f"lo{c}")) / grid)), F.lit(0)), F.lit(grid - 1)) * (F.col(f"hi{c}") - F.col(f"lo{c}")) / grid
        return cells.groupBy("p", snap("x").alias("x"), snap("y").alias("y")).agg(F.sum("w").alias("w"))
    return cells.select("p", *((F.col(c) - F.col(f"m{c}")).alias(c) for c in "xy"), "w")


def _chunks(batches: Iterator[pa.RecordBatch], run: int) -> Iterator[tuple[int, int, dict[str, np.ndarray]]]:
    """(p, number, columns) of at most ``run`` rows of one pair each; numbers ascend over all sorted partitions."""
    number, held = TaskContext.get().partitionId() << 32, []

    def closed():
        table = pa.Table.from_batches(held)
        return held[0].column(0)[0].as_py(), number, {c: table[c].to_numpy() for c in table.column_names[1:]}

    for batch in batches:
        while batch.num_rows:
            pairs = batch.column(0).to_numpy()
            if held and (held[0].column(0)[0].as_py() != pairs[0] or sum(b.num_rows for b in held) >= run):
                yield closed()
                number, held = number + 1, []
            take = min(int(np.searchsorted(pairs, pairs[0], "right")), run - sum(b.num_rows for b in held))
            held.append(batch.slice(0, take))
            batch = batch.slice(take)
    if held:
        yield closed()


def _beyond(v: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted values: how far each lies beyond the first, and the weighted sum of its distances from those before it."""
    u = v - v[0]
    return u, u * (np.cumsum(w) - w) - (np.cumsum(w * u) - w * u)


def _concordant(key: np.ndarray, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The sum of w_i w_j (x_i - x_j) (y_i - y_j) over j before i with key_j < key_i.

    Keys are halved bit by bit, so any two part at exactly one of them: there the left half's
    points meet those of the right half as running sums.
    """
    rank = np.unique(key, return_inverse=True)[1]
    x, y, total = x - x.mean(), y - y.mean(), 0.0
    for bit in reversed(range(int(rank.max()).bit_length())):
        block = rank >> (bit + 1)
        right = (rank >> bit & 1).astype(bool)
        starts = np.flatnonzero(np.r_[True, block[1:] != block[:-1]])
        group = np.cumsum(np.r_[False, block[1:] != block[:-1]])[right]
        left = np.where(right, 0.0, w)

        def met(values, starts=starts, group=group, right=right):
            sums = np.cumsum(values)
            return sums[right] - (sums[starts] - values[starts])[group]

        xr, yr = x[right], y[right]
        total += float(np.sum(w[right] * (xr * yr * met(left) - xr * met(left * y) - yr * met(left * x) + met(left * x * y))))
        half = rank >> bit
        order = np.argsort(half.astype(np.uint16) if int(half.max()) < 1 << 16 else half, kind="stable")
        rank, x, y, w = rank[order], x[order], y[order], w[order]
    return total


def _in_order_of_x(run: int):
    """Each point with its chunk of x and where it lies in it; a chunk's first row has the sum over the pairs in it."""

    def add(batches):
        for p, cx, c in _chunks(batches, run):
            x, y, w = c["x"], c["y"], c["w"]
            u, l = _beyond(x, w)  # noqa: E741
            pairs = np.zeros(len(x))
            pairs[0] = _concordant(y, x, y, w)
            yield pa.RecordBatch.from_pydict({"p": pa.array(np.full(len(x), p), pa.int32()), "x": x, "y": y, "w": w, "cx": np.full(len(x), cx), "u": u, "l": l, "c": pairs})

    return add


def _in_order_of_y(run: int):
    """The sums of each chunk of y, and in it of each chunk of x."""

    def add(batches):
        for p, cy, c in _chunks(batches, run):
            x, y, w, r = c["x"], c["y"], c["w"], c["rx"]
            u, l = _beyond(y, w)  # noqa: E741
            cells, at = np.unique(c["cx"], return_inverse=True)
            grid = {k: np.bincount(at, v) for k, v in zip(SUMS, (w, w * x, w * y, w * x * y), strict=True)}
            sums = (w, w * x, w * y, w * x * x, w * y * y, w * x * y, w * r, w * r * r, w * u, w * l, w * u * u, w * u * l, w * l * l, w * r * u, w * r * l)
            own = dict(zip(OWN, (y[0], *(v.sum() for v in sums), _concordant(c["cx"], x, y, w)), strict=True))
            n = len(cells)
            rows = {"p": pa.array([p] * (n + 1), pa.int32()), "cy": pa.array([cy] * (n + 1), pa.int64()), "cx": pa.array([*cells.tolist(), None], pa.int64()), "cells": pa.array([None] * n + [len(x)], pa.int64())}
            rows |= {f"g_{k}": pa.array([*v.tolist(), None], pa.float64()) for k, v in grid.items()}
            yield pa.RecordBatch.from_pydict(rows | {k: pa.array([None] * n + [float(v)], pa.float64()) for k, v in own.items()})

    return add


def _sorted_ranges(df: DataFrame, rows: int, *order: str) -> DataFrame:
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // RANGE))
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)


def _starts(chunks: DataFrame, chunk: str, w: str, v: str) -> DataFrame:
    """Adds k and r0, of which a value's row sum is r0 + k u + 2 l: r0 is that of the chunk's first value. A row for each chunk."""
    pair = Window.partitionBy("p")
    earlier = pair.orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0.0))
    k = 2 * before(w) - F.sum(w).over(pair)
    return chunks.withColumns({"k": k, "r0": F.col("first") * k + F.sum(v).over(pair) - 2 * before(v)})


def _by_value(cells: DataFrame) -> DataFrame:
    """(p, x, y, w, cx, rx): points with a chunk for each value of x, of which there are few."""
    values = cells.groupBy("p", "x").agg(F.sum("w").alias("w"))
    values = values.select(F.col("p").alias("p_"), F.col("x").alias("x_"), "p", "w", F.col("x").alias("first"), (F.col("w") * F.col("x")).alias("wx"))
    values = _starts(values.withColumn("cx", F.row_number().over(Window.partitionBy("p").orderBy("first")).cast("long")), "cx", "w", "wx")
    return cells.join(F.broadcast(values.select("p_", "x_", "cx", F.col("r0").alias("rx"))), (F.col("p") == F.col("p_")) & (F.col("x") == F.col("x_"))).select("p", "x", "y", "w", "cx", "rx")


def _by_chunk(cells: DataFrame, run: int) -> tuple[DataFrame, DataFrame]:
    """The same points with chunks of the order of x, and (p, c): the sum over the pairs that share a chunk."""
    dealt = kept(_sorted_ranges(cells, cells.count(), "p", "x", "y").mapInArrow(_in_order_of_x(run), "p int, x double, y double, w double, cx long, u double, l double, c double"), "distance-by-x")
    chunks = dealt.groupBy("p", "cx").agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("x")).alias("wx"), F.min("x").alias("first"))
    chunks = _starts(chunks, "cx", "w", "wx").select(F.col("p").alias("p_"), F.col("cx").alias("cx_"), "k", "r0")
    points = dealt.join(F.broadcast(chunks), (F.col("p") == F.col("p_")) & (F.col("cx") == F.col("cx_")))
    return points.select("p", "x", "y", "w", "cx", (F.col("r0") + F.col("k") * F.col("u") + 2 * F.col("l")).alias("rx")), dealt.groupBy("p").agg(F.sum("c").alias("c"))


def _across(table: DataFrame) -> DataFrame:
    """(p, c): the sum over pairs of points in different chunks of x and of y; all cells of the grid, as those without points pass on sums too."""
    grid, chunks = table.where("cx is not null"), table.where("cx is null").select("p", "cy")
    full = chunks.join(grid.select("p", "cx").distinct(), "p").join(grid.select("p", "cy", "cx", *(f"g_{k}" for k in SUMS)), ["p", "cy", "cx"], "left").fillna(0.0)
    earlier = lambda by, order: Window.partitionBy("p", by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    below = full.withColumns({f"b_{k}": F.coalesce(F.sum(f"g_{k}").over(earlier("cx", "cy")), F.lit(0.0)) for k in SUMS})
    both = below.withColumns({f"s_{k}": F.coalesce(F.sum(f"b_{k}").over(earlier("cy", "cx")), F.lit(0.0)) for k in SUMS})
    met = F.col("g_wxy") * F.col("s_w") - F.col("g_wx") * F.col("s_wy") - F.col("g_wy") * F.col("s_wx") + F.col("g_w") * F.col("s_wxy")
    return both.groupBy("p").agg(F.sum(met).alias("c"))


def distance_pairs(df: DataFrame, pairs: list[tuple[str, str]], grid: int | None = None, run: int = RUN) -> DataFrame:
    """(x, y, n, cells, dcov, dcor) of pairs of numeric columns, exact; rows with a null in a pair don't count for it.

    Only on request are the columns put on an even ``grid`` first, which makes the result
    approximate. A column without spread has covariance and correlation 0.
    """
    # ranks of the column with fewer values: fewer levels
    names = sorted({c for pair in pairs for c in pair})
    about = df.agg(*(F.approx_count_distinct(c).alias(f"n{i}") for i, c in enumerate(names))).first()  # one row
    few = {c: about[f"n{i}"] for i, c in enumerate(names)}
    turned = [(y, x) if few[y] < few[x] else (x, y) for x, y in pairs]
    cells = kept(_cells(df, turned, grid), "distance-cells")
    wide = [i for i, (x, _) in enumerate(turned) if few[x] > FEW]
    points, inside = None, None
    if len(wide) < len(pairs):
        points = _by_value(cells.where(~F.col("p").isin(wide)) if wide else cells)
    if wide:
        more, inside = _by_chunk(cells.where(F.col("p").isin(wide)), run)
        points = points.unionByName(more) if points is not None else more
    schema = ", ".join(["p int, cy long, cx long, cells long", *(f"g_{k} double" for k in SUMS), *(f"{k} double" for k in OWN)])
    table = kept(_sorted_ranges(points, cells.count(), "p", "y", "x").mapInArrow(_in_order_of_y(run), schema), "distance-chunks")
    k, r0 = F.col("k"), F.col("r0")
    shift = k * F.col("u") + 2 * F.col("l")
    rb = {"rb": F.col("n") * r0 + shift, "rab": r0 * F.col("ra") + k * F.col("rau") + 2 * F.col("ral")}
    rb["rbb"] = F.col("n") * r0 * r0 + 2 * r0 * shift + k * k * F.col("uu") + 4 * k * F.col("ul") + 4 * F.col("ll")
    s = _starts(table.where("cx is null"), "cy", "n", "sy").withColumns(rb).groupBy("p").agg(F.sum("cells").alias("cells"), *(F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy", "ra", "raa", "rb", "rab", "rbb")))
    c = _across(table).unionByName(table.where("cx is null").select("p", "c"))
    c = (c.unionByName(inside) if inside is not None else c).groupBy(F.col("p").alias("p_")).agg(F.sum("c").alias("c"))
    found = s.join(c, F.col("p") == F.col("p_"), "left")
    n = F.col("n")
    spread = lambda p, q: 2 * (n * F.col(f"s{p}{q}") - F.col(f"s{p}") * F.col(f"s{q}"))

    def cov(sums: Column, both: str, p: str, q: str) -> Column:
        return F.greatest(sums / n**2 - 2 * F.col(both) / n**3 + F.col(p) * F.col(q) / n**4, F.lit(0.0))

    ab = cov(4 * F.coalesce("c", F.lit(0.0)) - spread("x", "y"), "rab", "ra", "rb")
    aa, bb = cov(spread("x", "x"), "raa", "ra", "ra"), cov(spread("y", "y"), "rbb", "rb", "rb")
    dcor = F.coalesce(F.sqrt(F.try_divide(ab, F.nullif(F.sqrt(aa * bb), F.lit(0.0)))), F.lit(0.0))
    label = lambda side: F.element_at(F.array(*(F.lit(pair[side]) for pair in pairs)), F.col("p") + 1)
    flat = F.col("ra") * F.col("rb") == 0  # rounding must not make a constant column depend on anything
    return found.select(label(0).alias("x"), label(1).alias("y"), n.cast("long").alias("n"), "cells", F.when(flat, 0.0).otherwise(F.sqrt(ab)).alias("dcov"), F.when(flat, 0.0).otherwise(dcor).alias("dcor"))
