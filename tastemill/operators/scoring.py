"""Scoring with an object that each Python worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

#: what this process has loaded, by (loader, path), and how often it had to
_LOADED: dict[tuple[str, str], Any] = {}
LOADS: dict[tuple[str, str], int] = {}


def loaded(load: Callable[[str], Any], path: str) -> Any:
    """``load(path)``, kept for the life of the process; a path stands for one content."""
    key = (f"{load.__module__}.{load.__qualname__}", path)
    if key not in _LOADED:
        _LOADED[key] = load(path)
        LOADS[key] = LOADS.get(key, 0) + 1
    return _LOADED[key]


def score_with(df: DataFrame, load: Callable[[str], Any], path: str, score: Callable[[Any, pa.RecordBatch], pa.RecordBatch], schema: StructType | str) -> DataFrame:
    """``score(object, batch)`` over Arrow batches of ``df``, the object loaded from ``path`` once a worker, whatever the number of tasks.

    Only the path is sent to the tasks. The object has to fit a worker; a table that grows
    with the data is joined instead (see machine.RatingMachine).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield score(loaded(load, path), batch)

    return df.mapInArrow(run, schema)


def read_table(path: str) -> pa.Table:
    """A Parquet folder in any store that Arrow reaches, as one table in memory."""
    store, place = fs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
    return ds.dataset(place, format="parquet", filesystem=store, ignore_prefixes=["_", "."]).to_table()
