"""Structured Streaming over the event log and over a watched folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stratalens.operators.log import latest_by_key


def read_log_stream(spark: SparkSession, path: str, schema: str, files_per_trigger: int = 100) -> DataFrame:
    """JSON-lines files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).json(path)


def latest_state(log: DataFrame) -> DataFrame:
    """The streaming twin of latest_by_key (update or complete mode): state is one row a key.

    Events carry their line, so the result does not depend on the order of arrival.
    """
    return latest_by_key(log)


def windowed_counts(log: DataFrame, late: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """Counts by window and action; rows later than `late` are dropped by the watermark."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.window("at", window).alias("w"), "action").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "action", "n")


def bursts(log: DataFrame, key: str, gap: str = "500 milliseconds", late: str = "10 minutes") -> DataFrame:
    """Debounced activity: one row a key and burst."""
    timed = log.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy(F.session_window("at", gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")


def open_items_stream(log: DataFrame, opened: str, closed: str, late: str = "10 minutes") -> DataFrame:
    """ckey, ts, open: the standing of every key that a batch touches; the streaming twin of open_items (update mode).

    log: line, ts, action, ckey.  Of the last row of a key, `open` says whether it stands on the list of open
    items and `ts` since when.  State is the newest opening and the newest closing of a key, by time and
    then by the least line, so neither order nor repeats of events matter; events later than `late` behind the
    newest one are dropped by the watermark.  A closed key's state is dropped by a timer once the watermark
    has passed its closing, since what can still arrive is newer; an open one stays.  A null key is a key.
    """
    timed = log.where(F.col("action").isin(opened, closed)).withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    rows = timed.select("ckey", "at", F.unix_micros("at").alias("us"), "line", (F.col("action") == opened).alias("opens"))

    def best(pdf: pd.DataFrame, old: tuple | None) -> tuple | None:
        found = [(int(us), -int(line)) for us, line in zip(pdf["us"], pdf["line"], strict=True)]
        return max(found + ([old] if old else []), default=None)

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        a, b = None, None
        if state.exists:
            held = state.get
            a, b = (tuple(held[:2]) if held[0] is not None else None), (tuple(held[2:]) if held[2] is not None else None)
        for pdf in parts:
            a, b = best(pdf[pdf["opens"]], a), best(pdf[~pdf["opens"]], b)
        state.update((a or (None, None)) + (b or (None, None)))
        # of equal times the first line counts among openings, the later one between opening and closing
        shut = a is None or (b is not None and (b[0] > a[0] or (b[0] == a[0] and -b[1] > -a[1])))
        if shut:
            newest = max(x[0] for x in (a, b) if x)
            state.setTimeoutTimestamp(max(newest // 1000, state.getCurrentWatermarkMs()) + 1)
        yield pd.DataFrame({"ckey": [key[0]], "ts": [pd.Timestamp(a[0], unit="us") if a else pd.NaT], "open": [not shut]})

    kind = "ckey string, ts timestamp, open boolean"
    return rows.groupBy("ckey").applyInPandasWithState(step, kind, "a_us long, a_line long, b_us long, b_line long", "update", GroupStateTimeout.EventTimeTimeout)


def watch(spark: SparkSession, path: str, schema: str, rerun: Callable[[DataFrame, int], None], checkpoint: str, every: str = "500 milliseconds") -> StreamingQuery:
    """Rerun a batch function on what arrived since the last run."""
    stream = read_log_stream(spark, path, schema)
    return stream.writeStream.foreachBatch(rerun).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
