"""Sinks: Parquet datasets, delimited text, embedding tables and development exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.functions.features import featurize
from tastemill.operators.splits import dev_tier, sentiment_split


def write_dataset(df: DataFrame, path: str, partition_by: tuple[str, ...] = ("split",), mode: str = "error", files: int | None = None, columns: list[str] | None = None) -> None:
    """Parquet by partition columns. ``mode="ignore"`` skips what is there, ``"overwrite"`` rewrites it.

    Rows are spread evenly over the writers: over ``files`` of them, or by an adaptive
    rebalance that splits large splits and joins small ones.
    """
    out = df.select(*columns) if columns else df
    if files:
        out = out.repartition(files)
    elif partition_by:
        out = out.hint("rebalance", *partition_by)
    writer = out.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def write_delimited(df: DataFrame, path: str, sep: str = "::", header: bool = False, mode: str = "error") -> None:
    """Text without quoting; null is empty. With a header, every file starts with the column names."""
    if header:
        df.write.mode(mode).option("sep", sep).option("header", True).option("quote", "").csv(path)
    else:
        df.select(F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)).alias("value")).write.mode(mode).text(path)


def write_embeddings(df: DataFrame, path: str, mode: str = "error", single: bool = False) -> None:
    """(id int, embedding array<float>), snappy; one file only on request."""
    out = df.select(F.col("id").cast("int").alias("id"), F.col("embedding").cast("array<float>").alias("embedding"))
    (out.coalesce(1) if single else out).write.mode(mode).option("compression", "snappy").parquet(path)


def export_ratings(df: DataFrame, path: str, tier: str = "full", order_by: tuple[str, ...] = ("timestamp", "user_id", "movie_id"), mode: str = "error") -> None:
    """Ratings by (split, sentiment); the tiers "small" and "tiny" hold 1000 and 100 rows of each."""
    out = sentiment_split(df)
    if tier != "full":
        out = dev_tier(out, ["split", "sentiment"], {"small": 1000, "tiny": 100}[tier], list(order_by))
    write_dataset(out, path, ("split", "sentiment"), mode)


def export_entities(users: DataFrame, movies: DataFrame, path: str, mode: str = "error") -> None:
    """The users and movies that go with exported ratings, as Parquet under path/users and path/movies."""
    write_dataset(users, f"{path}/users", (), mode)
    write_dataset(movies, f"{path}/movies", (), mode)


def export_features(joined: DataFrame, path: str, split: str = "split", mode: str = "error") -> None:
    """Feature rows of joined ratings, by split; ``genres`` stays an array of floats."""
    features = featurize(joined, keep=(split,))
    write_dataset(features, path, (split,), mode)


def export_rows(df: DataFrame, path: str, mode: str = "error") -> None:
    """A small cohort both as text (path/text) and as Parquet (path/parquet)."""
    write_delimited(df, f"{path}/text", mode=mode)
    write_dataset(df, f"{path}/parquet", (), mode)


def write_mapping(mapping: DataFrame, path: str, mode: str = "error") -> None:
    """New and old ids as comma-separated text with a header."""
    write_delimited(mapping, path, ",", True, mode)


def readback_problems(written: DataFrame, source: DataFrame) -> list[str]:
    """What differs between a file read back and its source: columns, types, number of rows."""
    problems = []
    kinds, have = dict(source.dtypes), dict(written.dtypes)
    problems += [f"{c}: {kinds[c]} written as {have.get(c)}" for c in kinds if have.get(c) != kinds[c]]
    a, b = source.count(), written.count()
    if a != b:
        problems.append(f"{a} rows written, {b} read")
    return problems
