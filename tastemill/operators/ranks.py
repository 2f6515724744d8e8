"""Global order without a global sort in one task, and a hash that other engines can repeat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tastemill.sources.folders import kept


def shared_hash(value: Column, seed: int = 0) -> Column:
    """A 32-bit multiplicative hash of an integer column, in plain integer arithmetic."""
    return F.pmod(F.pmod(value, F.lit(2147483647)).cast("long") * 2654435761 + seed * 40503, F.lit(4294967296))


#: rows of a sorted range
RANGE = 1 << 20


#: rows that one task groups by keys of which most are distinct
GROUPED = 1 << 19


def in_parts(df: DataFrame, keys: list[str], parts: int | None) -> DataFrame:
    """The rows dealt by their keys before they are grouped, where that takes more than the session's partitions.

    Keys that hardly repeat fill the memory of a task that counts its share of the input first;
    ``parts`` of about GROUPED rows bound it.
    """
    few = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *keys) if parts is not None and parts > few else df


def running(df: DataFrame, order_by: list[str], sums: dict[str, Column] | None = None, each: int = RANGE, cheap: bool = False) -> DataFrame:
    """Adds ``__rn``, the rows before a row, and for each of ``sums`` its total over those rows; the order must be unique.

    The frame is kept once (``cheap``: it is read or counted anew instead), counted, and cut into ranges of about ``each`` rows by all columns
    of the order, so that many equal first columns are cut too. Each range is sorted by a
    task and shifted by the ranges before it, of which there is one row for each.
    """
    rows, sums = df if cheap else kept(df, "running-input"), sums or {}
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // each))
    dealt = kept(rows.repartitionByRange(n, *order_by).sortWithinPartitions(*order_by).withColumn("__at", F.monotonically_increasing_id()), "running")
    # the number of the partition is in the upper bits
    part, inside = F.shiftrightunsigned("__at", 33), F.col("__at").bitwiseAND((1 << 33) - 1)
    sizes = dealt.groupBy(part.alias("__part_")).agg(F.count("*").alias("__rn_"), *(F.sum(c).alias(f"{name}_") for name, c in sums.items()))
    earlier = Window.orderBy("__part_").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__part_", *(F.coalesce(F.sum(f"{c}_").over(earlier), F.lit(0)).alias(f"{c}_") for c in ("__rn", *sums)))
    # a row for each million rows, so it can be sent to all tasks
    out = dealt.withColumn("__part", part).join(F.broadcast(before), F.col("__part") == F.col("__part_")).withColumn("__rn", inside + F.col("__rn_"))
    own = Window.partitionBy("__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)
    for name, c in sums.items():
        out = out.withColumn(name, F.coalesce(F.sum(c).over(own), F.lit(0)) + F.col(f"{name}_"))
    return out.select(*df.columns, "__rn", *sums)


def global_row_number(df: DataFrame, order_by: list[str], offset: int = 0, name: str = "rn") -> DataFrame:
    """Dense numbers from offset + 1 in the order of ``order_by``, whose last columns make it unique."""
    return running(df, order_by).select(*df.columns, (F.col("__rn") + 1 + offset).alias(name))


def renumber(df: DataFrame, id_col: str, order_by: list[str], offset: int) -> tuple[DataFrame, DataFrame]:
    """(rows with new ids, mapping of new to old ids)."""
    numbered = global_row_number(df, order_by, offset, "__new")
    mapping = numbered.select(F.col("__new").alias(id_col), F.col(id_col).alias(f"{id_col}_orig"))
    return numbered.withColumn(id_col, F.col("__new")).drop("__new"), mapping
