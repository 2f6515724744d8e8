"""Removed parts of documents: keys, joins and masks shared by the two passage operators."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tastemill.llm._jobs import among, id_key, written

SPANS = "doc long, tie long, s long, e long"
#: spans, and packed strings of overfull buckets, which are dealt again
FOUND = "again boolean, " + SPANS + ", packed binary"


def keyed(df: DataFrame) -> DataFrame:
    """(doc, tie, text): the id, a hash that tells texts of one id apart, and the text (null: empty)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return df.select(id_key().alias("doc"), F.xxhash64(text).alias("tie"), text.alias("text"))


def with_spans(docs: DataFrame, spans: DataFrame) -> DataFrame:
    """(doc, text, starts, ends) of every row of keyed(); the spans of a document are a small list.

    Only documents that may have spans are shuffled. Rows that repeat an id and a text find
    the same spans, so a span counts once.
    """
    own = spans.groupBy(F.col("doc").alias("d"), F.col("tie").alias("t")).agg(F.collect_set(F.struct("s", "e")).alias("x"))
    own = own.select("d", "t", F.col("x.s").alias("starts"), F.col("x.e").alias("ends"))
    return among(docs, ["doc", "tie"], own, ["d", "t"], rest=True).select("doc", "text", "starts", "ends")


def covered(n: int, first: np.ndarray, starts: pa.Array, ends: pa.Array) -> np.ndarray:
    """Which of n units lie in a span; first: the unit where each row begins."""
    delta = np.zeros(n + 1, dtype=np.int64)
    lists = np.diff(starts.offsets.to_numpy()) if len(starts) else np.zeros(0, np.int64)
    if starts.null_count:
        lists = np.where(starts.is_null().to_numpy(zero_copy_only=False), 0, lists)
    base = np.repeat(first, lists)
    np.add.at(delta, base + starts.flatten().to_numpy(), 1)
    np.add.at(delta, base + ends.flatten().to_numpy(), -1)
    return np.cumsum(delta[:n]) > 0


def span_batch(doc: np.ndarray, tie: np.ndarray, s: np.ndarray, e: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array(np.asarray(x, dtype=np.int64)) for x in (doc, tie, s, e)]
    n = len(columns[0])
    return pa.RecordBatch.from_arrays([pa.array(np.zeros(n, bool)), *columns, pa.nulls(n, pa.binary())], names=["again", "doc", "tie", "s", "e", "packed"])


def again_batch(packed: list[bytes]) -> pa.RecordBatch:
    n = len(packed)
    return pa.RecordBatch.from_arrays([pa.array(np.ones(n, bool)), *[pa.nulls(n, pa.int64())] * 4, pa.array(packed, pa.binary())], names=["again", "doc", "tie", "s", "e", "packed"])


def spans_and_rest(found: DataFrame, name: str) -> tuple[DataFrame, DataFrame, int]:
    """Of rows of FOUND, written: the spans, what is to be dealt again, and its bytes."""
    out = written(found, name, ("again",))
    rest = out.where("again").select("packed")
    return out.where("not again").select("doc", "tie", "s", "e"), rest, int(rest.agg(F.sum(F.octet_length("packed").cast("long"))).first()[0] or 0)


def ranges(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, ... (n[0] values), first[1], ..."""
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)


def heavy(df: DataFrame, share: float = 1 / 2000) -> list[int]:
    """Keys with more than ``share`` of all counts; df: (key long, n long), n summed over keys. At most 1 / share keys."""
    total = df.agg(F.sum("n")).first()[0] or 0
    return [r[0] for r in df.groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") > F.lit(share * total)).select("key").collect()]
