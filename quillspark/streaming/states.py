"""Keyed state in variables of its own: values, lists and maps in a RocksDB store, with timers, time to live and a state to start from.

Each function takes a streaming DataFrame and returns one, as in ``streams``;
its query must run with ``rocksdb`` (``run`` and ``state`` do). State is as
large as what a key holds by design: one value, at most so many events, one
count a type of event. Rows of a key come in batches, so a key that holds a
third of all rows isn't gathered.
"""

from __future__ import annotations

import heapq
import uuid
from collections import Counter
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillspark.functions.scoring import LEAST, MOST
from quillspark.operators.learning import DECAY, RATE
from quillspark.sources.stores import exists, scratch

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

LEARNED = "user_id long, state string, value double, n long, kinds long, oldest long"


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started within keep their state in RocksDB; the session's setting is as before afterwards."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class Learner(StatefulProcessor):
    """Of each user the learned importance, the latest events and counts by type; all of it goes when its timer runs out."""

    def __init__(self, reward: float, most: int, hours: int):
        self.reward, self.most, self.life = reward, most, hours * 3_600_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.importance = handle.getValueState("importance", "value double, n long, until long")
        self.recent = handle.getListState("recent", "ms long, event_id long")
        self.kinds = handle.getMapState("kinds", "event_type string", "n long")

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.importance.update((float(initialState["value"].iloc[0]), 0, None))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # Each call to the store is a round trip: a user that has no events yet has one only.
        value, n, until = self.importance.get() or (0.0, 0, None)
        held = [tuple(r) for r in self.recent.get()] if n else []
        known = {kind[0]: times[0] for kind, times in self.kinds.iterator()} if n else {}
        counts: Counter = Counter()
        new = 0
        for batch in rows:
            new += len(batch)
            held = heapq.nlargest(self.most, held + list(zip(batch["ms"].tolist(), batch["event_id"].tolist(), strict=True)))
            counts.update(batch["event_type"].tolist())
        counts = {kind: times for kind, times in counts.items() if isinstance(kind, str)}
        # A first, clamped step; the others approach the reward, which lies within the bounds, geometrically.
        first = min(max(value + RATE * (self.reward - value), LEAST), MOST)
        value = max((self.reward + (first - self.reward) * (1 - RATE) ** (new - 1)) * DECAY, 0.0) if new else value
        latest = held[0][0] + self.life
        if until is not None and until != latest:
            self.handle.deleteTimer(until)
        if until != latest:
            self.handle.registerTimer(latest)
        self.importance.update((value, n + new, latest))
        self.recent.put(held)
        for kind, times in counts.items():
            self.kinds.updateValue((kind,), (known.get(kind, 0) + times,))
        yield self._row(key, "held", value, n + new, len(known.keys() | counts.keys()), held[-1][1])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        value, n, _ = self.importance.get()
        kinds, oldest = sum(1 for _ in self.kinds.keys()), min(tuple(r) for r in self.recent.get())[1]
        for state in (self.importance, self.recent, self.kinds):
            state.clear()
        yield self._row(key, "expired", value, n, kinds, oldest)

    @staticmethod
    def _row(key, state, value, n, kinds, oldest) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [key[0]], "state": [state], "value": [value], "n": [n], "kinds": [kinds], "oldest": [oldest]})


def learned(stream: DataFrame, start: DataFrame | None = None, reward: float = 0.6, most: int = 100, hours: int = 36, late: str = "0 seconds") -> DataFrame:
    """A row a user and batch with events: importance (a step an event, faded once a batch), events, types, the oldest of the latest ``most``; and one as the state goes, ``hours`` after the last event by the stream's time.

    Events of a later batch that are more than ``late`` behind the stream's time are left out, as its timers may have run.
    ``start`` (user_id, value; a user once) is what was learned before. Events of null type count among the events only.
    """
    rows = stream.withWatermark("ts", late).select("user_id", "ts", "event_id", "event_type", F.unix_millis("ts").alias("ms"))
    first = None if start is None else start.select(F.col("user_id").cast("long").alias("user_id"), F.col("value").cast("double").alias("value")).groupBy("user_id")
    return rows.groupBy("user_id").transformWithStateInPandas(Learner(reward, most, hours), LEARNED, "Update", "EventTime", first)


class Seen(StatefulProcessor):
    """Of each session the files that were met within the time to live."""

    def __init__(self, life_ms: int):
        self.life = life_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.files = handle.getMapState("files", "file string", "seen boolean", self.life)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            new = [f for f in batch["file"].unique() if not self.files.containsKey((f,))]
            for f in new:
                self.files.updateValue((f,), (True,))
            if new:
                yield pd.DataFrame({"session": [key[0]] * len(new), "file": new})


def first_seen(stream: DataFrame, life_ms: int) -> DataFrame:
    """A row (session, file) of a stream each time that it comes first, or again after its entry has outlived ``life_ms`` of processing time."""
    rows = stream.where("session IS NOT NULL AND file IS NOT NULL").select("session", "file")
    return rows.groupBy("session").transformWithStateInPandas(Seen(life_ms), "session string, file string", "Append", "ProcessingTime")


def run(stream: DataFrame, mode: str, path: str, once: bool = False) -> DataFrame:
    """Run a stream over what is new since the last run at ``path`` and return all rows so far, with the batch that told them.

    ``once`` is for state by processing time: such a query always has another batch to run, so it is given one.
    """
    spark = stream.sparkSession
    with rocksdb(spark):
        writer = stream.writeStream.outputMode(mode).trigger(**{"once" if once else "availableNow": True}).option("checkpointLocation", f"{path}/progress")
        writer.foreachBatch(lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/rows/batch={epoch}")).start().awaitTermination()
    if not exists(spark, f"{path}/rows"):
        return spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    return spark.read.parquet(f"{path}/rows").select(*stream.columns, "batch")


def fresh(spark: SparkSession) -> str:
    """A folder of its own for a stream's progress and rows."""
    return f"{scratch(spark)}/states/{uuid.uuid4().hex}"


def state(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A state variable of the run at ``path``, read from its store: key, and what it holds."""
    with rocksdb(spark):
        return spark.read.format("statestore").option("stateVarName", name).load(f"{path}/progress")
