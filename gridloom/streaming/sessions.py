"""Sessions of a stream kept in state of one's own, with timers and a watermark.

A session of a key is a stretch of events with less than a gap between neighbours. Keys are dealt over buckets; the state of
a bucket holds the open sessions of its keys as (key, start, stop, n, total), in blobs of CHUNK sessions, and a batch is
merged with them at once, as a call for each key or session would cost more than the work. A timer
closes a bucket's sessions whose stop the watermark has passed by the gap, and sets the next one. Events older than the watermark
can't change what was closed: Spark takes them out before they get here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import BinaryType, StructField, StructType

#: The store that keeps this state; a session of Spark names it in spark.sql.streaming.stateStore.providerClass.
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_OPEN = StructType([StructField("sessions", BinaryType())])
_KIND = np.dtype([("key", "i8"), ("start", "i8"), ("stop", "i8"), ("n", "i8"), ("total", "f8")])
#: Buckets of keys, and sessions of a blob.
BUCKETS, CHUNK = 1024, 4096


def joined(sessions: list[tuple[int, int, int, float]], gap: int) -> list[tuple[int, int, int, float]]:
    """Sessions in order of time, those with less than gap between them made one."""
    out: list[tuple[int, int, int, float]] = []
    for s in sorted(sessions):
        if out and s[0] - out[-1][1] < gap:
            a = out[-1]
            out[-1] = (a[0], max(a[1], s[1]), a[2] + s[2], a[3] + s[3])
        else:
            out.append(s)
    return out


def merged(sessions: np.ndarray, gap: int) -> np.ndarray:
    """:func:`joined` for each key of a table of sessions, in order of keys."""
    if not len(sessions):
        return sessions
    s = sessions[np.lexsort((sessions["start"], sessions["key"]))]
    new = np.concatenate(([True], s["key"][1:] != s["key"][:-1]))
    low = int(s["start"].min())
    # keys one after another on one line of time, too far apart to meet
    shift = (np.cumsum(new) - 1) * (int(s["stop"].max()) - low + gap + 1) - low
    stop = np.maximum.accumulate(s["stop"] + shift)
    new[1:] |= (s["start"] + shift)[1:] - stop[:-1] >= gap
    first = np.flatnonzero(new)
    out = s[first].copy()
    out["stop"] = np.maximum.reduceat(s["stop"], first)
    out["n"], out["total"] = np.add.reduceat(s["n"], first), np.add.reduceat(s["total"], first)
    return out


class Sessions(StatefulProcessor):
    """Times are whole milliseconds."""

    def __init__(self, gap: int):
        self.gap = gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getListState("open", _OPEN)

    def close(self) -> None:
        pass

    def _held(self) -> list[np.ndarray]:
        return [np.frombuffer(bytes(row[0]), _KIND) for row in self.open.get()]

    def _hold(self, sessions: np.ndarray) -> None:
        """Keep these; a timer at the end of the first of them."""
        if len(sessions):
            self.open.put([(sessions[i : i + CHUNK].tobytes(),) for i in range(0, len(sessions), CHUNK)])
            self.handle.registerTimer(int(sessions["stop"].min()) + self.gap)
        else:
            self.open.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        parts = self._held()
        for part in rows:
            fresh = np.ones(len(part), _KIND)
            fresh["key"], fresh["start"], fresh["stop"], fresh["total"] = part["key"], part["ms"], part["ms"], part["value"]
            parts.append(fresh)
        self._hold(merged(np.concatenate(parts), self.gap))
        yield _shown(np.zeros(0, _KIND))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        held = self._held()
        now = np.concatenate(held) if held else np.zeros(0, _KIND)
        over = now["stop"] + self.gap <= timerValues.getCurrentWatermarkInMs()
        if over.any():
            self._hold(now[~over])
        yield _shown(now[over])


def _shown(sessions: np.ndarray) -> pd.DataFrame:
    return pd.DataFrame({n: sessions[n] for n in _KIND.names})


def sessions(events: DataFrame, gap_ms: int, late: str) -> DataFrame:
    """(key, start, stop, n, total) of a stream (key, ts, value): closed sessions. start and stop are milliseconds.
    late: how far events may be behind the latest one before they are dropped."""
    timed = events.select(F.col("key").cast("bigint").alias("key"), "ts", F.unix_millis("ts").alias("ms"), F.col("value").cast("double").alias("value")).withWatermark("ts", late)
    dealt = timed.withColumn("bucket", F.pmod(F.xxhash64("key"), F.lit(BUCKETS)))
    return dealt.groupBy("bucket").transformWithStateInPandas(Sessions(gap_ms), outputStructType="key bigint, start bigint, stop bigint, n bigint, total double", outputMode="append", timeMode="eventTime")


def replayed(events: DataFrame, batches: list[DataFrame], folder: str, gap_ms: int, late: str) -> DataFrame:
    """What :func:`sessions` gives when batches (key, ts, value) arrive one after another, as a table; folder: a new
    one that all nodes share. A row far in the future, of no session that is given, comes last and closes all."""
    spark = events.sparkSession
    end = events.agg(F.max("ts").alias("t")).select(F.lit(-1).cast("bigint").alias("key"), (F.col("t") + F.expr("INTERVAL 400 DAYS")).alias("ts"), F.lit(0.0).alias("value")).where("ts IS NOT NULL")
    kind = "key bigint, ts timestamp, value double"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    try:
        for i, part in enumerate([*batches, end]):
            rows = part.select(F.col("key").cast("bigint").alias("key"), F.col("ts").cast("timestamp").alias("ts"), F.col("value").cast("double").alias("value"))
            rows.write.parquet(f"{folder}/in/{i}")
            stream = spark.readStream.schema(kind).option("recursiveFileLookup", "true").parquet(f"{folder}/in")
            sink = sessions(stream, gap_ms, late).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").option("path", f"{folder}/out")
            sink.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    finally:
        if before is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    return spark.read.schema("key bigint, start bigint, stop bigint, n bigint, total double").parquet(f"{folder}/out").where("key >= 0")
