"""Item popularity from the gaps between occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.operators.profile import exact_percentiles, histogram, percentiles


def gaps(df: DataFrame, item: str, step: str) -> DataFrame:
    """(item, step, gap): steps since the item's last occurrence; several in one step count once; the first gap is from 0."""
    w = Window.partitionBy(item).orderBy(step)
    return df.select(item, step).distinct().withColumn("gap", F.col(step) - F.coalesce(F.lag(step).over(w), F.lit(0)))


def item_gap(df: DataFrame, item: str, step: str, alpha: float) -> DataFrame:
    """(item, n, last_step, b, p): the smoothed gap after all steps, from 1, and the frequency 1 / b.

    b is the recurrence b = (1 - alpha) b + alpha gap in closed form: each gap is weighted by
    how many occurrences follow it, which two windows count, so no item is held as an array.
    """
    w = Window.partitionBy(item)
    seen = gaps(df, item, step).withColumns({"__k": F.row_number().over(w.orderBy(step)), "__n": F.count("*").over(w)})
    weighted = F.pow(F.lit(1 - alpha), F.col("__n") - F.col("__k")) * F.col("gap") * alpha
    out = seen.groupBy(item).agg(F.count("*").alias("n"), F.max(step).alias("last_step"), F.sum(weighted).alias("__s"))
    b = F.pow(F.lit(1 - alpha), F.col("n")) + F.col("__s")
    return out.select(item, "n", "last_step", b.alias("b")).withColumn("p", 1 / F.greatest("b", F.lit(1e-6)))


def popularity_part(b: Column, head: float | Column, tail: float | Column) -> Column:
    """A small gap is a popular item."""
    return F.when(b <= head, "head").when(b >= tail, "tail").otherwise("torso")


def with_parts(gaps_: DataFrame, low: float = 0.2, high: float = 0.8) -> DataFrame:
    """Adds ``part`` with the thresholds at two percentiles of b."""
    cut = exact_percentiles(gaps_, "b", [low, high], name="__cut").select("__cut")  # one row
    return gaps_.crossJoin(F.broadcast(cut)).withColumn("part", popularity_part(F.col("b"), F.get("__cut", 0), F.get("__cut", 1))).drop("__cut")


def gap_report(gaps_: DataFrame, bins: int = 10, ps: tuple[float, ...] = (20, 50, 80, 99)) -> DataFrame:
    """(kind, at, value): count, minimum, maximum and mean of b, its percentiles, and its histogram."""
    totals = gaps_.agg(F.count("*").cast("double").alias("n"), F.min("b").alias("min"), F.max("b").alias("max"), F.avg("b").alias("mean"))
    stats = totals.select(F.explode(F.array(*(F.struct(F.lit(c).alias("kind"), F.lit(0.0).alias("at"), F.col(c).alias("value")) for c in totals.columns))).alias("x")).select("x.*")
    quantiles = percentiles(gaps_, "b", list(ps)).select(F.lit("percentile").alias("kind"), F.col("p").alias("at"), "value")
    bars = histogram(gaps_, "b", bins).select(F.lit("bin").alias("kind"), F.col("bin").cast("double").alias("at"), F.col("n").cast("double").alias("value"))
    return stats.unionByName(quantiles).unionByName(bars)
