"""State variables across restarts: folded values, bounded lists, counts by type, timers, time to live, a state to start from."""

import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from quillspark.streaming import states

START = datetime(2024, 1, 1)
SCHEMA = "user_id long, ts timestamp, event_id long, event_type string"


class Feed:
    """A folder of files that a stream reads."""

    def __init__(self, spark, path, schema):
        self.spark, self.path, self.schema = spark, f"{path}/in", schema
        spark.createDataFrame([], schema).write.parquet(self.path)

    def add(self, rows):
        self.spark.createDataFrame(rows, self.schema).coalesce(1).write.mode("append").parquet(self.path)

    def stream(self):
        return self.spark.readStream.schema(self.schema).parquet(self.path)


@pytest.fixture
def feed(spark, tmp_path):
    return Feed(spark, tmp_path, SCHEMA)


def event(user, hour, n, kind="view"):
    return (user, START + timedelta(hours=hour), n, kind)


def step(value, new, reward=0.6):
    for i in range(new):
        value += 0.2 * (reward - value)
        value = min(max(value, 0.1), 1.0)
    return value * 0.98


def told(rows):
    return {(r["batch"], r["user_id"], r["state"]): (round(r["value"], 9), r["n"], r["kinds"], r["oldest"]) for r in rows.collect()}


def test_a_restart_goes_on_from_the_kept_state(spark, tmp_path, feed):
    path = f"{tmp_path}/out"
    start = spark.createDataFrame([(1, 0.9)], "user_id long, value double")
    build = lambda: states.learned(feed.stream(), start, most=3, hours=48, late="1 day")
    feed.add([event(1, h, h, "view" if h % 2 else "click") for h in range(4)] + [event(2, 1, 50)])
    before = spark.conf.get(states._PROVIDER)
    first = {k[1:]: v for k, v in told(states.run(build(), "update", path)).items()}
    assert spark.conf.get(states._PROVIDER) == before
    one, two = step(0.9, 4), step(0.0, 1)
    assert first == {(1, "held"): (round(one, 9), 4, 2, 1), (2, "held"): (round(two, 9), 1, 1, 50)}
    feed.add([event(1, 5, 9, "error"), event(1, 0, 99)])
    rows = states.run(build(), "update", path)
    # Only what is new was read; the list holds the latest three, whenever they came.
    later = {k[1:]: v for k, v in told(rows).items() if k[1] == 1 and v[1] > 4}
    assert later == {(1, "held"): (round(step(one, 2), 9), 6, 3, 2)}
    recent = states.state(spark, path, "recent")
    held = {}
    for r in recent.select(F.col("key.user_id").alias("u"), F.col("list_element.event_id").alias("e")).collect():
        held.setdefault(r["u"], []).append(r["e"])
    assert {u: sorted(x) for u, x in held.items()} == {1: [2, 3, 9], 2: [50]}


def test_state_goes_when_its_timer_runs_out(spark, tmp_path, feed):
    path = f"{tmp_path}/out"
    build = lambda: states.learned(feed.stream(), most=3, hours=36)
    feed.add([event(1, 0, 1), event(2, 0, 2)])
    states.run(build(), "update", path)
    feed.add([event(2, 30, 3)])
    feed.add([event(3, 40, 4)])
    rows = told(states.run(build(), "update", path))
    # User 2 came again, so its first timer was taken back.
    assert {k[1] for k in rows if k[2] == "expired"} == {1}
    values = states.state(spark, path, "importance").select("key.user_id", "value.n").collect()
    assert {(r["user_id"], r["n"]) for r in values} == {(2, 2), (3, 1)}
    feed.add([event(1, 41, 5)])
    again = {k[1:]: v for k, v in told(states.run(build(), "update", path)).items() if v[3] == 5}
    assert again == {(1, "held"): (round(step(0.0, 1), 9), 1, 1, 5)}


def test_a_file_comes_again_after_its_time_to_live(spark, tmp_path):
    feed = Feed(spark, tmp_path, "session string, file string")
    build = lambda: states.first_seen(feed.stream(), 4_000)
    feed.add([("a", "x"), ("a", "x"), ("b", "x"), (None, "x"), ("a", None)])
    n = lambda rows: sorted((r["session"], r["file"]) for r in rows.collect())
    assert n(states.run(build(), "append", f"{tmp_path}/out", once=True)) == [("a", "x"), ("b", "x")]
    time.sleep(5)
    feed.add([("a", "x"), ("a", "y")])
    assert n(states.run(build(), "append", f"{tmp_path}/out", once=True)) == [("a", "x"), ("a", "x"), ("a", "y"), ("b", "x")]


def test_within_its_time_to_live_a_file_comes_once(spark, tmp_path):
    feed = Feed(spark, tmp_path, "session string, file string")
    build = lambda: states.first_seen(feed.stream(), 3_600_000)
    feed.add([("a", "x")])
    states.run(build(), "append", f"{tmp_path}/out", once=True)
    feed.add([("a", "x"), ("b", "")])
    assert {(r["session"], r["file"]) for r in states.run(build(), "append", f"{tmp_path}/out", once=True).collect()} == {("a", "x"), ("b", "")}


def test_an_event_behind_the_watermark_is_left_out(spark, tmp_path, feed):
    build = lambda: states.learned(feed.stream(), hours=48)
    feed.add([event(1, 3, 1)])
    states.run(build(), "update", f"{tmp_path}/out")
    feed.add([event(1, 0, 2), event(1, 4, 3)])
    assert max(v[1] for v in told(states.run(build(), "update", f"{tmp_path}/out")).values()) == 2


def test_an_empty_stream_has_no_rows(spark, tmp_path, feed):
    assert states.run(states.learned(feed.stream()), "update", f"{tmp_path}/out").count() == 0
