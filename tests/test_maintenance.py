"""A kept store: repairs that do what their plan says and nothing twice, and the cycle's steps."""

from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from quillspark.operators import upkeep as U
from quillspark.operators.maintenance import Kept, digest, word_graph
from quillspark.operators.providers import hashing_embedder
from quillspark.streaming import streams

NOW = datetime(2024, 2, 1)
SCHEMA = "project string, category string, session_id string, ts timestamp, ttl string, confidence string, content string, pos long"


def block(project, category, pos, content, days=1, ttl="never"):
    return (project, category, f"s{pos}", NOW - timedelta(days=days), ttl, "high", content, pos)


@pytest.fixture
def store(spark, tmp_path):
    return Kept(spark, str(tmp_path / "store"), F.lit(NOW))


def rows(spark, *given):
    return spark.createDataFrame(given, SCHEMA)


def healed(store):
    return {(r["project"], r["action"], r["fixed"]) for r in store.heal().collect()}


def test_repairs_run_once_and_only_where_needed(spark, store):
    calls = spark.sparkContext.accumulator(0)

    def counting(batch):
        calls.add(len(batch))
        return hashing_embedder(batch)

    store.embedder = counting
    store.ingest(rows(spark, block("a", "decisions", 1, "database sharding chosen\nmore"), block("a", "patterns", 2, "gone already", 9, "7d"), block("b", "patterns", 3, "streams everywhere tonight"), block("b", "bugs", 4, None)))
    every = {(p, x, True) for p in "ab" for x in ("regenerate", "embed", "build_graph")}
    assert healed(store) == every
    assert calls.value == 2
    assert {(r["project"], r["context"]) for r in store.contexts().collect()} == {("a", "database sharding chosen"), ("b", "streams everywhere tonight")}
    assert {(r["project"], r["concept"]) for r in store.concepts().collect()} == {("a", "database"), ("a", "sharding"), ("b", "streams"), ("b", "everywhere"), ("b", "tonight")}
    edges = {(r["project"], r["src"], r["dst"], r["rel_type"]) for r in store.relationships().collect()}
    assert edges == {("a", "database", "sharding", "relates-to"), ("b", "streams", "everywhere", "relates-to"), ("b", "everywhere", "tonight", "relates-to")}
    # A sound store needs nothing.
    assert healed(store) == set()
    # A changed text needs its vector alone, in its project alone.
    store.ingest(rows(spark, block("b", "patterns", 3, "streams changed")))
    assert healed(store) == {("b", "embed", True)}
    assert calls.value == 3


def test_a_repair_that_fails_to_mend_is_told(spark, store):
    store.graphs = lambda system, user: "no graph today"
    store.ingest(rows(spark, block("a", "bugs", 1, "")))
    assert ("a", "build_graph", False) in healed(store)


def test_expired_blocks_leave_and_empty_parts_go(spark, store):
    store.ingest(rows(spark, block("a", "bugs", 1, "old", 9, "7d"), block("a", "patterns", 2, "old too", 9, "7d"), block("a", "patterns", 3, "new"), block("b", "bugs", 4, "new")))
    untouched = {p.name for p in Path(store.path, "blocks", "project=b", "category=bugs").iterdir()}
    assert store.distill(None) == 2
    assert {r["pos"] for r in store.blocks().collect()} == {3, 4}
    assert not Path(store.path, "blocks", "project=a", "category=bugs").exists()
    assert {p.name for p in Path(store.path, "blocks", "project=b", "category=bugs").iterdir()} == untouched
    assert store.distill(None) == 0


def test_digests_are_bounded_and_in_order(spark):
    given = rows(spark, *(block("a", "bugs", i, "" if i == 5 else f"{'x' * 300}{i}\nmore" if i == 7 else f"line {i}\nmore", days=i // 2) for i in range(10)), block("c", "bugs", 20, None))
    got = {r["project"]: r["text"].split("\n") for r in digest(given, F.lit(NOW), lines=6, width=50).collect()}
    assert got == {"a": ["line 0", "line 1", "line 2", "line 3", "line 4", "line 6"]}


def test_offline_graphs_read_the_text_alone():
    assert '"concepts": []' in word_graph("graph", "Give concepts and relationships\n\nshort one")


def test_cycle_with_a_step_that_fails(spark, store, tmp_path):
    source = str(tmp_path / "in")
    rows(spark, block("a", "bugs", 1, "first words"), block("a", "bugs", 2, "old", 9, "7d")).coalesce(1).write.parquet(source)
    failing = ("broken", lambda batch: 1 // 0)
    streams.cycle(spark.readStream.schema(SCHEMA).parquet(source), [*store.steps(), failing], str(tmp_path / "log"))
    got = [(r["step"], r["state"], r["n"]) for r in spark.read.parquet(str(tmp_path / "log")).orderBy("batch", "place").collect()]
    assert got == [("ingest", "done", 2), ("inject", "done", 1), ("distill", "done", 1), ("doctor", "done", 3), ("quality", "done", 1), ("broken", "ZeroDivisionError", 0)]
    assert "division" in spark.read.parquet(str(tmp_path / "log")).where("step = 'broken'").first()["message"]
    assert {r["pos"] for r in store.blocks().collect()} == {1}
    assert spark.read.parquet(f"{store.path}/memory").first()["text"] == "first words"


def test_concepts_are_kept_apart_by_project(spark):
    reply = '{"concepts": [{"id": "x", "name": "X"}]}'
    got = U.graph_concepts(spark.createDataFrame([(1, "a", reply), (2, "b", reply), (3, "b", reply)], "id long, project string, reply string"), "project")
    assert {(r["project"], r["concept"]) for r in got.collect()} == {("a", "x"), ("b", "x")} and got.count() == 2
