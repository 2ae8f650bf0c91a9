"""K2/K5 streaming form: stateful admission control per (user, action).

Rows are decided in event time whatever order they arrive in: a row waits in
its key's state until the watermark has passed it, then a timer of the key
decides the waiting rows oldest first by the same rule as in batch.  A row older
than the watermark when it arrives can no longer be decided in order: it is
returned with ``late`` true and no decision, never dropped.

State of a key, in a store on disk: a list of the rows still waiting (those of
one watermark delay), to which arrivals are appended without reading it; and one
value with the times of the last ``max_calls`` admitted calls and of its one
timer.  A key without waiting rows whose admitted calls have all left the window is
removed.  Null users and actions are keys of their own.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from uuid import uuid4

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.admission import RecentCalls, with_limits
from ..session import ensure_checkpoint_dir, is_folder, new_table

OUT_SCHEMA = "event_id long, user_id long, action string, admitted boolean, wait_s long, late boolean"
#: The state store that lists and timers need.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def list_state(spark: SparkSession):
    """Streams started inside use the store that `admission_stream` needs; a
    stream keeps the settings it was started with."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, STORE)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _decisions(key, rows: list[tuple]) -> pd.DataFrame:
    """rows: (event_id, admitted, wait_s, late); one block of objects, as most
    keys have few rows and typed columns would take longer to set up than to fill."""
    user = None if pd.isna(key[0]) else int(key[0])
    return pd.DataFrame([(i, user, key[1], *rest) for i, *rest in rows],
                        columns=["event_id", "user_id", "action", "admitted", "wait_s", "late"], dtype=object)


class Admission(StatefulProcessor):
    """Decisions of one (user, action) after another."""

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "ts_us long, event_id long")
        self.calls = handle.getValueState(
            "calls", "admitted_us array<long>, max_calls long, window_us long, waits boolean, timer_ms long")

    def handleInputRows(self, key, batches: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()  # 0 before the first
        first = calls = window = None
        for pdf in batches:
            if pdf["event_id"].hasnans:
                pdf = pdf[pdf["event_id"].notna()]  # not the heartbeats
                if not len(pdf):
                    continue
            calls, window = int(pdf["max_calls"].iloc[0]), int(pdf["window_us"].iloc[0])
            rows = [(int(t), int(i)) for t, i in zip(pdf["ts_us"].tolist(), pdf["event_id"].tolist(), strict=True)]
            late = [i for t, i in rows if t < passed * 1000 and passed > 0]
            if late:
                yield _decisions(key, [(i, None, None, True) for i in late])
            new = [r for r in rows if r[0] >= passed * 1000 or passed <= 0]
            if new:
                self.waiting.appendList(new)
                first = min(new)[0] if first is None else min(min(new)[0], first)
        if first is None:
            return
        old = self.calls.get()
        wake = max(first // 1000 + 1, passed + 1)
        if old is None:
            self.handle.registerTimer(wake)
        elif old[4] > wake:
            self.handle.deleteTimer(old[4])
            self.handle.registerTimer(wake)
        else:
            wake = old[4]
        # the limits of the latest row hold
        self.calls.update(([] if old is None else list(old[0]), calls, window, True, wake))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs()
        times, calls, window, waits, _ = self.calls.get()
        waiting = sorted(tuple(map(int, w)) for w in self.waiting.get()) if waits else []
        recent, out = RecentCalls(calls, window, map(int, times)), []
        for t, i in waiting:
            if t >= passed * 1000:
                break
            left = recent.decide(t)
            out.append((i, left is None, left, False))
        rest, times = waiting[len(out):], list(recent.times)
        if rest:
            self.waiting.put(rest)
        elif waits:
            self.waiting.clear()
        # woken again by the next waiting row, or when no admitted call counts any more
        until = rest[0][0] // 1000 if rest else (times[-1] + window) // 1000 if times else -1
        if rest or until >= passed:
            wake = max(until + 1, passed + 1)
            self.handle.registerTimer(wake)
            self.calls.update((times, calls, window, bool(rest), wake))
        else:
            self.calls.clear()
        if out:
            yield _decisions(key, out)

    def close(self) -> None:
        pass


def admission_stream(events: DataFrame, limits: DataFrame | None = None, watermark: str = "10 minutes") -> DataFrame:
    """Streaming DataFrame of decisions from a streaming attempts frame
    (event_id, user_id, action, ts).  A row without event_id is a
    heartbeat: it moves the watermark and is no attempt.  Start it within
    `list_state`."""
    a = with_limits(events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", watermark), limits)
    # without the watermarked column itself, for whose sake Spark would drop late rows unseen
    a = a.select("event_id", "user_id", "action", "max_calls", "window_us", "ts_us")
    return a.groupBy("user_id", "action").transformWithStateInPandas(Admission(), OUT_SCHEMA, "Append", "EventTime")


def stream_table(spark: SparkSession, path: str, schema, bytes_per_trigger: int = 8 << 30) -> DataFrame:
    """File stream over a table that is a folder of part files or one file."""
    reader = spark.readStream.schema(schema).option("maxBytesPerTrigger", str(bytes_per_trigger))
    if is_folder(spark, path):
        return reader.parquet(path)
    folder, name = path.rstrip("/").rsplit("/", 1)
    return reader.option("pathGlobFilter", name).parquet(folder)


def run_available(spark: SparkSession, path: str, schema, limits: DataFrame | None = None, out_path: str | None = None,
                  watermark: str = "10 minutes", later: DataFrame | None = None) -> DataFrame:
    """Decide everything now in the table at ``path`` (trigger availableNow)
    into a parquet file sink (exactly-once via the sink log) under the shared
    checkpoint folder and return it as a batch DataFrame.  Rows younger than
    the watermark still wait when the input ends; a heartbeat behind the last
    of them, written to a second source folder, releases them.  ``later`` are
    rows (event_id, user_id, event_type, ts) delivered after that, in a load of their
    own.  No decision row passes through the driver."""
    beats, out_path = new_table(spark, "heartbeats"), out_path or new_table(spark, "admission")
    checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/admission_{uuid4().hex}"
    cols = ["event_id", "user_id", "event_type", "ts"]
    beat = spark.createDataFrame([], schema).select(*cols)
    beat.write.parquet(beats)

    def run() -> None:
        src = stream_table(spark, path, schema).select(*cols).unionByName(
            spark.readStream.schema(beat.schema).parquet(beats))
        q = (admission_stream(src.withColumnRenamed("event_type", "action"), limits, watermark)
             .writeStream.format("parquet").option("path", out_path).outputMode("append")
             .option("checkpointLocation", checkpoint).trigger(availableNow=True))
        with list_state(spark):
            q = q.start()
        q.awaitTermination()

    run()
    last = spark.read.schema(schema).parquet(path).agg(F.max("ts").alias("ts")).where("ts is not null")
    (last.select(F.lit(None).cast("long").alias("event_id"), F.lit(None).cast("long").alias("user_id"),
                 F.lit(None).cast("string").alias("event_type"),
                 (F.col("ts") + F.expr(f"INTERVAL {watermark}") + F.expr("INTERVAL 1 minute")).cast(beat.schema["ts"].dataType).alias("ts"))
     .write.mode("append").parquet(beats))
    run()
    if later is not None:
        later.select(*[F.col(c).cast(beat.schema[c].dataType) for c in cols]).write.mode("append").parquet(beats)
        run()
    return spark.read.schema(OUT_SCHEMA).parquet(out_path)
