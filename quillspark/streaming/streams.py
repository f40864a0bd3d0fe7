"""Incremental maintenance with Structured Streaming: counts, first observations, importance, sessions.

Each function takes a streaming DataFrame and returns one. ``drain`` runs a
query over what is there and returns the sink's rows: a parity check against
the batch operators, and a way to run a stream once a day.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.functions.scoring import LEAST, MOST
from quillspark.operators.learning import DECAY, RATE
from quillspark.sources.stores import exists, scratch


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a stream of files, timestamps as instants."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def daily_counts(stream: DataFrame) -> DataFrame:
    """Events by day and type: tumbling windows of a day, late by a day at most."""
    w = F.window("ts", "1 day")
    return stream.withWatermark("ts", "1 day").groupBy(w, "event_type").agg(F.count("*").alias("n")).select(F.date_format("window.start", "yyyy-MM-dd").alias("day"), "event_type", "n")


def sliding_counts(stream: DataFrame) -> DataFrame:
    w = F.window("ts", "2 days", "1 day")
    return stream.withWatermark("ts", "1 day").groupBy(w).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "n")


def sessions(stream: DataFrame, gap: str = "12 hours") -> DataFrame:
    w = F.session_window("ts", gap)
    return stream.withWatermark("ts", "1 day").groupBy(w, "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def first_files(stream: DataFrame) -> DataFrame:
    """One row a session and file within the watermark of two days."""
    rows = stream.where("event_type IN ('purchase', 'click')").select("ts", F.col("user_id").alias("session"), F.get_json_object("props", "$.k").alias("file"))
    return rows.withWatermark("ts", "2 days").dropDuplicatesWithinWatermark(["session", "file"]).select("session", "file")


def importance(stream: DataFrame, reward: float = 0.6) -> DataFrame:
    """Learned importance by user, kept as state: one step an event, in closed form, faded once a batch."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        value, n = state.get if state.exists else (0.0, 0)
        new = sum(map(len, batches))
        # A first, clamped step; the others approach the reward, which lies within the bounds, geometrically.
        first = min(max(value + RATE * (reward - value), LEAST), MOST)
        value = max((reward + (first - reward) * (1 - RATE) ** (new - 1)) * DECAY, 0.0) if new else value
        state.update((value, n + new))
        yield pd.DataFrame({"user_id": [key[0]], "value": [value], "n": [n + new]})

    return stream.select("user_id", "event_id").groupBy("user_id").applyInPandasWithState(step, "user_id long, value double, n long", "value double, n long", "update", GroupStateTimeout.NoTimeout)


def expiring(stream: DataFrame, hours: int = 36) -> DataFrame:
    """Users whose latest event is ``hours`` old, by the stream's own time: each has a timer; when it runs out the user is told and the state removed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            until = state.get[0]
            state.remove()
            yield pd.DataFrame({"user_id": [key[0]], "until": [until]})
            return
        last = state.get[0] if state.exists else 0
        for batch in batches:
            last = max(last, int(batch["ms"].max()) + hours * 3_600_000)
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs() + 1))

    rows = stream.withWatermark("ts", "0 seconds").select("user_id", "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, until long", "until long", "append", GroupStateTimeout.EventTimeTimeout)


def recent(stream: DataFrame, most: int = 100) -> DataFrame:
    """The latest ``most`` events of each user, kept as a list in state that is cut back with every batch: user_id, n, oldest."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = json.loads(state.get[0]) if state.exists else []
        for batch in batches:
            held = sorted(held + batch[["ms", "event_id"]].to_numpy().tolist())[-most:]
        state.update((json.dumps(held),))
        yield pd.DataFrame({"user_id": [key[0]], "n": [len(held)], "oldest": [held[0][1]]})

    rows = stream.select("user_id", "event_id", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("user_id").applyInPandasWithState(step, "user_id long, n long, oldest long", "held string", "update", GroupStateTimeout.NoTimeout)


def run(stream: DataFrame, mode: str, each: Callable[[DataFrame, int], None], progress: str | None = None) -> None:
    """Run a stream over what is there, or new since the last run with its ``progress``; that of a single run lies in the shared folder."""
    writer = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", progress or f"{scratch(stream.sparkSession)}/streams/{uuid.uuid4().hex}")
    writer.foreachBatch(each).start().awaitTermination()


def drain(stream: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a stream over what is there and return its rows, by way of files: of a complete result the last batch's, of updates the last by ``keys``.

    A batch is written under its number, so one that runs again replaces its own rows.
    """
    spark = stream.sparkSession
    path = f"{scratch(spark)}/drained/{uuid.uuid4().hex}"
    run(stream, mode, lambda batch, epoch: batch.write.mode("overwrite").parquet(f"{path}/batch={epoch}"))
    if not exists(spark, path):
        return spark.createDataFrame([], stream.schema)
    rows = spark.read.parquet(path)
    if mode == "complete":
        rows = rows.join(F.broadcast(rows.agg(F.max("batch").alias("batch"))), "batch", "left_semi")
    elif mode == "update" and keys:
        others = [c for c in stream.columns if c not in keys]
        rows = rows.groupBy(*keys).agg(F.max_by(F.struct(*others), "batch").alias("r")).select(*keys, "r.*")
    return rows.select(*stream.columns)


def keep_counters(stream: DataFrame, path: str) -> None:
    """Counts of each micro-batch by key, written under the batch's number: a batch that runs again replaces its own rows, so sums are exact."""
    run(stream, "append", lambda batch, epoch: batch.groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={epoch}"))


def ingest_changed(stream: DataFrame, path: str, progress: str | None = None) -> None:
    """Texts (name, text) of a stream whose content isn't the one last ingested under that name.

    Each batch writes its changed texts and their digests under its number;
    what is known is the last digest of every name of earlier batches, so a
    batch that runs again decides alike and replaces what it wrote.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.groupBy("name").agg(F.max("text").alias("text")).withColumn("digest", F.sha2("text", 256))
        if exists(spark, f"{path}/manifest"):
            before = spark.read.parquet(f"{path}/manifest").where(F.col("batch") < epoch)
            known = before.groupBy("name").agg(F.max_by("digest", "batch").alias("digest"))
            new = new.join(known, ["name", "digest"], "left_anti")
        new = new.select("name", "text", "digest")
        new.write.mode("overwrite").parquet(f"{path}/texts/batch={epoch}")
        spark.read.schema(new.schema).parquet(f"{path}/texts/batch={epoch}").select("name", "digest").write.mode("overwrite").parquet(f"{path}/manifest/batch={epoch}")

    run(stream, "append", each, progress)


def cycle(stream: DataFrame, steps: list[tuple[str, Callable[[DataFrame], int]]], path: str) -> None:
    """The maintenance cycle: for each batch its steps in order, each with the batch, and a log of what each did; a step that fails is logged and doesn't keep the next from running."""

    def each(batch: DataFrame, epoch: int) -> None:
        batch.persist()
        done = []
        for i, (name, step) in enumerate(steps):
            try:
                done.append((i, name, "done", int(step(batch)), None))
            except Exception as error:
                done.append((i, name, type(error).__name__, 0, str(error)))
        batch.unpersist()
        batch.sparkSession.createDataFrame(done, "place int, step string, state string, n long, message string").write.mode("overwrite").parquet(f"{path}/batch={epoch}")

    run(stream, "append", each)


def distilled(stream: DataFrame, now: Column, more_than: int = 30, days: int = 90) -> DataFrame:
    """Groups with more than so many events that aren't ``days`` old, and how many older ones were dropped."""
    old = F.col("ts") < now - F.make_dt_interval(days=F.lit(days))
    counted = stream.groupBy((F.col("user_id") % 10).alias("grp")).agg(F.count_if(~old).alias("n"), F.count_if(old).alias("dropped"))
    return counted.where(F.col("n") > more_than)
