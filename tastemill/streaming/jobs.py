"""Streaming forms: popularity as keyed state, features on a stream, and trends by event time."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tastemill.functions.features import featurize, genre_names
from tastemill.operators.joins import join_one

GAPS = "item long, n long, last_step long, b double, p double"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class ItemGaps(StatefulProcessor):
    """The recurrence of one item: what is folded (n, last step, b), and steps that the watermark has not passed.

    A step is folded once no earlier one can come any more: with the item's next rows, or, if none
    come, by an event-time timer, of which each micro-batch sets one for the item. So steps may
    arrive in any order within the watermark's delay, as long as event time orders them. With
    ``forget`` an item's state goes when nothing has come for so many milliseconds of event
    time; it then starts anew.
    """

    def __init__(self, alpha: float, forget: int | None = None):
        self.alpha, self.forget = alpha, forget

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.folded = handle.getValueState("folded", "n long, last_step long, b double, at long")
        self.pending = handle.getListState("pending", "step long, at long")

    def _fold(self, steps: list[int]) -> tuple[int, int, float]:
        n, last, b, _ = self.folded.get() if self.folded.exists() else (0, 0, 1.0, 0)
        for s in sorted(set(steps)):
            if s > last or n == 0:
                n, last, b = n + 1, s, (1 - self.alpha) * b + self.alpha * (s - last)
        return n, last, b

    def _row(self, key: tuple[Any, ...], steps: list[int]) -> pd.DataFrame:
        n, last, b = self._fold(steps)
        return pd.DataFrame({"item": [key[0]], "n": [n], "last_step": [last], "b": [b], "p": [1 / max(b, 1e-6)]})

    def handleInputRows(self, key: tuple[Any, ...], rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        passed = timerValues.getCurrentWatermarkInMs()
        new = {(int(s), int(t)) for df in rows for s, t in zip(df["step"], df["at"], strict=True) if t >= passed}
        if not new:
            return
        steps, newest = new | {tuple(x) for x in self.pending.get()}, max(t for _, t in new)
        ripe, left = [s for s, t in steps if t < passed], sorted(x for x in steps if x[1] >= passed)
        if ripe:
            self.folded.update((*self._fold(ripe), newest))
        self.pending.put(left)
        self.handle.registerTimer(newest + 1)
        if self.forget is not None:
            self.handle.registerTimer(newest + self.forget)
        yield self._row(key, [s for s, _ in left])  # what it comes to with all steps so far

    def handleExpiredTimer(self, key: tuple[Any, ...], timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        now = expiredTimerInfo.getExpiryTimeInMs()
        steps = [tuple(x) for x in self.pending.get()]
        ripe, left = [x for x in steps if x[1] < now], [x for x in steps if x[1] >= now]
        latest = max([t for _, t in steps] + ([self.folded.get()[3]] if self.folded.exists() else []), default=None)
        if self.forget is not None and latest is not None and latest + self.forget <= now:
            self.folded.clear()
            self.pending.clear()
        elif ripe:
            self.folded.update((*self._fold([s for s, _ in ripe]), latest))
            if left:
                self.pending.put(left)
            else:
                self.pending.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_item_gap(events: DataFrame, item: str, step: str, alpha: float, ts: str, late: str = "1 hour", forget: int | None = None) -> DataFrame:
    """The batch operator item_gap as keyed state on a stream of (item, step) with an event time ``ts``.

    Update mode: one row for each item of a micro-batch, with all steps seen so far, in the
    order of the steps. Rows later than ``late`` are dropped; ``forget``: see ItemGaps. The
    session's state store must be RocksDB's (run_available sees to it).
    """
    rows = events.withWatermark(ts, late).select(F.col(item).cast("long").alias("item"), F.col(step).cast("long").alias("step"), F.unix_millis(F.col(ts)).alias("at"), F.col(ts))
    return rows.groupBy("item").transformWithStateInPandas(ItemGaps(alpha, forget), GAPS, "Update", "EventTime")


def stream_features(ratings: DataFrame, users: DataFrame, movies: DataFrame, dates: str = "compat") -> DataFrame:
    """Feature rows of a stream of ratings, joined with static users and movies."""
    joined = join_one(ratings, users, "user_id", ("zipcode",), "drop")
    return featurize(join_one(joined, movies, "movie_id", ("title",), "drop"), dates=dates)


def stream_genre_trend(ratings: DataFrame, movies: DataFrame, ts: str, window: str = "1 day", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, end, genre, n, mean_rating) by window of event time; rows later than ``late`` are dropped."""
    rows = join_one(ratings.withWatermark(ts, late), movies.select("movie_id", "genres"), "movie_id", (), "drop")
    exploded = rows.select(ts, "rating", F.explode(genre_names(F.col("genres"))).alias("genre"))
    w = F.window(ts, window, slide) if slide else F.window(ts, window)
    out = exploded.groupBy(w.alias("w"), "genre").agg(F.count("*").alias("n"), F.avg("rating").alias("mean_rating"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "genre", "n", "mean_rating")


def stream_sessions(events: DataFrame, user: str, ts: str, gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(user, start, end, n): sessions that end after a gap without events."""
    rows = events.withWatermark(ts, late).groupBy(user, F.session_window(ts, gap).alias("s")).agg(F.count("*").alias("n"))
    return rows.select(user, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, into Parquet; the latest micro-batch wins in update mode."""
    spark = df.sparkSession

    def save(batch: DataFrame, number: int) -> None:
        batch.withColumn("micro_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key, None)
    spark.conf.set(key, ROCKS)  # state with timers lies outside the executors' heaps
    try:
        query = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.option("basePath", path).parquet(f"{path}/batch=*")
