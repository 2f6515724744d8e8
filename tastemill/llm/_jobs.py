"""Small Spark helpers of the corpus operators: written tables, sizes, row keys, joins of whole rows with listed keys."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tastemill.sources.folders import shared_folder, shared_path

__all__ = ["NO_ID", "among", "every_column", "id_key", "parts", "shared_folder", "shared_path", "text_bytes", "without", "written"]

#: stands for a null document id in orders and keys; a document with this very id counts as one with null
NO_ID = -(2**63)


def written(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write a frame as a Parquet table in the shared folder and read it: lineage ends here."""
    return written_at(df, name, partition_by)[0]


def written_at(df: DataFrame, name: str, partition_by: tuple[str, ...] = ()) -> tuple[DataFrame, str]:
    """The written table, and its path."""
    spark = df.sparkSession
    path = shared_path(spark, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def text_bytes(df: DataFrame, column: str = "text") -> int:
    """Bytes of a text column; one number reaches the driver."""
    return int(df.agg(F.sum(F.octet_length(F.col(column)).cast("long"))).first()[0] or 0)


def parts(spark: SparkSession, size: float, each: int = 64 << 20) -> int:
    """Shuffle partitions for so many bytes: the session's number, or more for large inputs."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(size / each))


def id_key(column: str = "doc_id") -> Column:
    return F.coalesce(F.col(column).cast("long"), F.lit(NO_ID))


#: bits of a key filter: 8 MB, whatever the number of keys
FILTER_BITS = 1 << 26


def every_column(df: DataFrame) -> Column:
    """All columns as one struct, whatever they are called; ``select("row.*")`` brings them back."""
    return F.struct(*(F.col("`" + c.replace("`", "``") + "`") for c in df.columns))


def _place(*keys: Column) -> Column:
    return F.pmod(F.xxhash64(*keys), F.lit(FILTER_BITS))


def split_listed(rows: DataFrame, keys: list[str], listed: DataFrame, listed_keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows whose keys surely aren't listed, rows whose keys may be).

    The listed keys' hashes set bits in a filter of FILTER_BITS, which is all that is
    broadcast. Both parts scan ``rows``; only the second one has to be shuffled for a join.
    """
    bits = listed.select(_place(*(F.col(k) for k in listed_keys)).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    place = _place(*(F.col(k) for k in keys))
    at = F.bitmap_bit_position(place)
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*(F.lit(1 << i) for i in range(8))), (at % 8).cast("int") + 1)) != 0
    # at most FILTER_BITS / 32768 rows of 4 KB
    tested = rows.withColumn("__p", F.bitmap_bucket_number(place)).join(F.broadcast(bits), F.col("__p") == F.col("__bucket"), "left").withColumn("__hit", F.coalesce(bit, F.lit(False)))
    return tested.where("not __hit").select(*rows.columns), tested.where("__hit").select(*rows.columns)


def without(df: DataFrame, gone: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """The rows of ``df``, all columns, whose keys are not in ``gone``; ``keys``: gone's columns and what they equal in df, both never null."""
    rows = df.select(*(c.alias(f"k{i}") for i, c in enumerate(keys.values())), every_column(df).alias("row"))
    names = [f"k{i}" for i in range(len(keys))]
    listed = gone.select(*(F.col(c).alias(f"g{i}") for i, c in enumerate(keys)))
    stay, asked = split_listed(rows, names, listed, [f"g{i}" for i in range(len(keys))])
    same = [F.col(f"k{i}") == F.col(f"g{i}") for i in range(len(keys))]
    return stay.select("row").unionByName(asked.join(listed.hint("merge"), same, "left_anti").select("row")).select("row.*")


def among(rows: DataFrame, keys: list[str], listed: DataFrame, listed_keys: list[str], rest: bool = False) -> DataFrame:
    """rows joined with ``listed`` on their keys (names all differ); with ``rest``, the other rows too, with nulls."""
    stay, asked = split_listed(rows, keys, listed, listed_keys)
    out = asked.join(listed.hint("merge"), [F.col(a) == F.col(b) for a, b in zip(keys, listed_keys, strict=True)], "left" if rest else "inner")
    return out.unionByName(stay, allowMissingColumns=True) if rest else out
