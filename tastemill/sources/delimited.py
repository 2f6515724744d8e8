"""Delimited text relations: specifications, typed reading, decoding and rejects."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DoubleType, LongType, StringType, StructField, StructType

from tastemill.operators.splits import hash_split

_TYPES: dict[object, DataType] = {int: LongType(), float: DoubleType(), str: StringType(), bytes: StringType()}
RELATIONS = ("ratings", "users", "movies")


@dataclass(frozen=True)
class SourceSpec:
    """One relation as text files: its name, path (a glob or folder), (column, type) fields and format.

    ``encoding``: a Java charset, or "utf-8-or-latin1" for files whose fields are UTF-8
    where they can be and ISO-8859-1 otherwise.
    """

    name: str
    path: str
    fields: tuple[tuple[str, type], ...]
    sep: str = "::"
    header: bool = False
    encoding: str = "utf-8-or-latin1"
    version: int = 0
    #: columns that may be empty
    optional: tuple[str, ...] = field(default=())

    def __post_init__(self) -> None:
        self.validate()

    def validate(self) -> None:
        if self.name not in RELATIONS:
            raise ValueError(f"unknown relation {self.name!r}; one of {RELATIONS}")
        if not self.path or not self.sep or not self.fields:
            raise ValueError(f"{self.name}: path, separator and fields are needed")
        names = [n for n, _ in self.fields]
        if len(set(names)) != len(names):
            raise ValueError(f"{self.name}: repeated column names")
        for n, t in self.fields:
            if t not in _TYPES:
                raise ValueError(f"{self.name}.{n}: type {t} is not int, float, str or bytes")

    @property
    def schema(self) -> StructType:
        return StructType([StructField(n, _TYPES[t]) for n, t in self.fields])


def specs_from_lists(name: str, path: str, columns: list[str], types: list[type], **options) -> SourceSpec:
    if len(columns) != len(types):
        raise ValueError(f"{name}: {len(columns)} columns and {len(types)} types")
    return SourceSpec(name, path, tuple(zip(columns, types, strict=True)), **options)


def decoded(c: Column) -> Column:
    """Text that was read as ISO-8859-1: its UTF-8 reading where its bytes are valid UTF-8."""
    raw = F.encode(c, "ISO-8859-1")
    return F.when(F.is_valid_utf8(raw.cast("string")), F.decode(raw, "UTF-8")).otherwise(c)


def read_delimited(spark: SparkSession, spec: SourceSpec, mode: str = "FAILFAST") -> DataFrame:
    """A typed relation. ``mode``: FAILFAST raises on a bad cell of the columns that are read; PERMISSIVE adds ``_corrupt`` with the row's text where any cell is bad."""
    spec.validate()
    mixed = spec.encoding == "utf-8-or-latin1"
    schema = StructType([*spec.schema.fields, StructField("_corrupt", StringType())]) if mode == "PERMISSIVE" else spec.schema
    reader = spark.read.schema(schema).option("sep", spec.sep).option("header", spec.header).option("encoding", "ISO-8859-1" if mixed else spec.encoding).option("mode", mode).option("quote", "")
    if mode == "PERMISSIVE":
        reader = reader.option("columnNameOfCorruptRecord", "_corrupt")
    df = reader.csv(spec.path)
    if mode == "PERMISSIVE":  # the condition always holds; it keeps every column in the scan, as a cell that isn't parsed can't be found bad
        df = df.withColumn("_corrupt", F.when(F.bit_count(F.hash(*(n for n, _ in spec.fields))) >= 0, F.col("_corrupt")))
    return df.withColumns({n: decoded(F.col(n)) for n, t in spec.fields if t in (str, bytes)}) if mixed else df


def read_relations(spark: SparkSession, specs: list[SourceSpec]) -> dict[str, DataFrame]:
    return {s.name: read_delimited(spark, s) for s in specs}


def read_split(spark: SparkSession, spec: SourceSpec, weights: dict[str, int] | None = None, keys: tuple[str, ...] | None = None) -> DataFrame:
    """A relation with ``split`` added: by the hash of its key columns (all columns), 8 : 1 : 1 where no weights are given."""
    rows = read_delimited(spark, spec)
    return hash_split(rows, weights or {"train": 8, "eval": 1, "test": 1}, list(keys or rows.columns))


def read_parquet_prefix(spark: SparkSession, folder: str, key: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{key}*.parquet")


def cast_typed(df: DataFrame, schema: StructType, on_error: str = "fail") -> DataFrame:
    """Text columns to declared types: "fail" raises on a bad cell, "reject" adds ``rejected`` with the columns at fault."""
    missing = [f.name for f in schema if f.name not in df.columns]
    if missing:
        raise ValueError(f"columns missing: {missing}")
    if on_error == "fail":
        return df.select(*(F.col(f.name).cast(f.dataType).alias(f.name) for f in schema))
    if on_error != "reject":
        raise ValueError("on_error is 'fail' or 'reject'")
    bad = F.filter(F.array(*(F.when(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull(), F.lit(f.name)) for f in schema)), lambda x: x.isNotNull())
    return df.select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema), bad.alias("rejected"))


def entity_inputs(users: DataFrame, movies: DataFrame, timestamp: Column | int) -> tuple[DataFrame, DataFrame]:
    """Model inputs of users (with a fill-in timestamp) and of movies."""
    stamp = timestamp if isinstance(timestamp, Column) else F.lit(timestamp)
    return users.select("user_id", "gender", "age", "occupation", stamp.cast("long").alias("timestamp")), movies.select("movie_id", "genres")
