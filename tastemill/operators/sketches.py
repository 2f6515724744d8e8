"""Statistics that merge: counts, moments and sketches by split and version, kept as a small table.

A new part of the data is scanned once; what several parts hold together comes from their
rows of the table. Distinct values are HLL sketches, quantiles KLL sketches, and the
sets of values theta sketches, which also say how much two splits share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType, NumericType

#: relative standard errors of the HLL and theta sketches of 2**12 cells, and the rank error of KLL at k = 200
DISTINCT_ERROR, OVERLAP_ERROR, RANK_ERROR = 0.0163, 0.0157, 0.0133
LOG_CELLS, KLL_K = 12, 200
SUMS = ("n", "missing", "zeros", "total")


def _cells(df: DataFrame, by: list[str], columns: list[str] | None) -> DataFrame:
    """(*by, feature, text, value, whole): one row for each cell; value is null where the column is no number, whole where it is no integer."""
    keep = [f for f in df.schema if f.name not in by and (columns is None or f.name in columns)]
    number = lambda f: F.col(f.name).cast("double") if isinstance(f.dataType, NumericType) else F.lit(None).cast("double")
    whole = lambda f: F.col(f.name).cast("long") if isinstance(f.dataType, IntegralType) else F.lit(None).cast("long")
    cells = [F.struct(F.lit(f.name).alias("feature"), F.col(f.name).cast("string").alias("text"), number(f).alias("value"), whole(f).alias("whole")) for f in keep]
    return df.select(*by, F.explode(F.array(*cells)).alias("c")).select(*by, "c.*")


def sketched(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """(*by, feature, n, missing, zeros, total, spread, least, most, values, ranks, members) in one scan.

    ``spread`` sums the squared distances from the own mean, since a difference of large sums of
    squares loses its digits; the total of integers is summed as such. A feature without a value
    has null sketches, which merge as nothing.
    """
    v = F.col("value")
    total = F.coalesce(F.sum(F.col("whole").cast("decimal(20,0)")).cast("double"), F.sum(v))
    return _cells(df, by, columns).groupBy(*by, "feature").agg(
        F.count("*").alias("n"), F.count_if(F.col("text").isNull()).alias("missing"), F.count_if(v == 0).alias("zeros"), total.alias("total"), (F.var_pop(v) * F.count(v)).alias("spread"), F.min(v).alias("least"), F.max(v).alias("most"),
        F.hll_sketch_agg("text", F.lit(LOG_CELLS)).alias("values"), F.when(F.count(v) > 0, F.kll_sketch_agg_double(v, F.lit(KLL_K))).alias("ranks"), F.theta_sketch_agg("text", F.lit(LOG_CELLS)).alias("members"),
    )


def merged(table: DataFrame, by: list[str]) -> DataFrame:
    """Rows of ``sketched`` put together by fewer keys; nothing is scanned anew."""
    k = F.col("n") - F.col("missing")
    together = Window.partitionBy(*by, "feature")  # a row for each of the parts
    rows = table.withColumn("__mean", F.try_divide(F.sum("total").over(together), F.sum(k).over(together)))
    # the spread of a part about the mean of all of them
    spread = F.when(k > 0, F.col("spread") + k * F.pow(F.try_divide("total", k) - F.col("__mean"), F.lit(2.0)))
    return rows.groupBy(*by, "feature").agg(
        *(F.sum(c).alias(c) for c in SUMS), F.sum(spread).alias("spread"), F.min("least").alias("least"), F.max("most").alias("most"),
        F.hll_union_agg("values").alias("values"), F.kll_merge_agg_double("ranks").alias("ranks"), F.theta_union_agg("members", F.lit(LOG_CELLS)).alias("members"),
    )


def statistics(table: DataFrame) -> DataFrame:
    """The rows of a table in numbers: n, missing, zeros, mean, std, min, max are exact; distinct, q25, median and q75 are estimates."""
    k = F.col("n") - F.col("missing")
    mean = F.try_divide("total", F.when(F.col("total").isNotNull(), k))
    spread = F.when(k > 1, F.sqrt(F.col("spread") / (k - 1)))
    spread = F.when(F.col("total").isNotNull(), spread)
    q = lambda p: F.when(F.col("total").isNotNull(), F.kll_sketch_get_quantile_double("ranks", F.lit(p)))
    own = [c for c in table.columns if c not in {*SUMS, "spread", "least", "most", "values", "ranks", "members"}]
    return table.select(*own, "n", "missing", "zeros", mean.alias("mean"), spread.alias("std"), F.col("least").alias("min"), F.col("most").alias("max"), F.hll_sketch_estimate("values").alias("distinct"), *(q(p).alias(c) for p, c in ((0.25, "q25"), (0.5, "median"), (0.75, "q75"))))


def overlaps(table: DataFrame, split: str, feature: str) -> DataFrame:
    """(a, b, in_a, in_b, in_both, in_either): estimated numbers of a feature's distinct values in each two splits, from their sketches."""
    own = table.where(F.col("feature") == feature).select(F.col(split).alias("a"), F.col("members").alias("ma"))
    other = own.withColumnsRenamed({"a": "b", "ma": "mb"})
    size = lambda c: F.theta_sketch_estimate(c)
    pairs = own.join(other, F.col("a") < F.col("b"))  # a row for each split
    return pairs.select("a", "b", size("ma").alias("in_a"), size("mb").alias("in_b"), size(F.theta_intersection("ma", "mb")).alias("in_both"), size(F.theta_union("ma", "mb", F.lit(LOG_CELLS))).alias("in_either"))


def distinct_cells(df: DataFrame, by: list[str], columns: list[str] | None = None) -> DataFrame:
    """(*by, feature, distinct): exact numbers of distinct values; integers are told apart as numbers, which are shorter than their texts."""
    keep = [f.name for f in df.schema if f.name not in by and (columns is None or f.name in columns)]
    cells = _cells(df, by, columns).where("text is not null")
    at = F.array_position(F.array(*(F.lit(c) for c in keep)), F.col("feature")).cast("int")
    one = cells.select(*by, at.alias("at"), "whole", F.when(F.col("whole").isNull(), F.col("text")).alias("text")).distinct()
    counts = one.groupBy(*by, "at").agg(F.count("*").alias("distinct"))
    return counts.select(*by, F.element_at(F.array(*(F.lit(c) for c in keep)), F.col("at")).alias("feature"), "distinct")


def within(estimate: Column, exact: Column, error: float, sigmas: float = 4) -> Column:
    """Whether an estimate lies inside its bound: so many standard errors, or one for small numbers."""
    return F.abs(estimate - exact) <= F.greatest(sigmas * error * exact, F.lit(1.0))


def top_texts(df: DataFrame, by: list[str], k: int = 10) -> DataFrame:
    """(*by, feature, value, n, place): the k most frequent values of each string column, exact; null is no value, ties by value."""
    text = [f.name for f in df.schema if f.dataType.simpleString() == "string" and f.name not in by]
    counts = _cells(df, by, text).where("text is not null").groupBy(*by, "feature", F.col("text").alias("value")).agg(F.count("*").alias("n"))
    place = F.row_number().over(Window.partitionBy(*by, "feature").orderBy(F.desc("n"), "value"))
    return counts.withColumn("place", place).where(F.col("place") <= k)
