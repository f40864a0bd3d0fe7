"""Cases of the third round's findings."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.oracle import connect, rows

from quillspark.plans import catalog


def _both(spark, place, name):
    ours, theirs = catalog.queries()[name](spark, str(place)).toPandas(), connect(str(place)).execute(catalog.oracle_sql()[name]).df()
    return rows(ours), rows(theirs)


def test_prompts_keep_a_line_feed_at_the_cut(spark, tmp_path):
    said = [(1, 0, "user", "hi"), (1, 1, "assistant", "a" * 1499 + "\nmore"), (1, 2, "user", "u" * 999 + "\nrest"), (1, 3, "assistant", "x<private>y</private>\n\n\n\nz")]
    spark.createDataFrame(said, "conv_id long, turn int, role string, text string").toPandas().to_parquet(tmp_path / "conversations.parquet")
    ours, theirs = _both(spark, tmp_path, "conversation_prompt")
    assert ours == theirs and "\\n\\n\\nUser" in ours[0].replace("\\\\n", "\\n")


def _cancelling():
    from zlib import crc32

    first = {}
    for i in range(2_000):
        h = crc32(f"w{i}".encode())
        if (h % 64, 1 - (h >> 16 & 1)) in first:
            return f"{first[h % 64, 1 - (h >> 16 & 1)]} w{i}"
        first[h % 64, h >> 16 & 1] = f"w{i}"


def test_every_text_has_a_unit_vector(spark, tmp_path):
    texts = [_cancelling(), "\n", "\t x", " ", " 　  ", "", "   ", None, " a", "plain words", "plain words"]
    spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").toPandas().to_parquet(tmp_path / "documents.parquet")
    ours, theirs = _both(spark, tmp_path, "embedded_index")
    assert ours == theirs


def _word_texts(n, rng):
    texts = [" ".join(rng.choices([f"word{i:03d}" for i in range(60)], k=rng.randint(0, 25))) for _ in range(n)]
    return [*enumerate(texts), (7, "word001 word002 word003 word050"), (n, "<!-- superseded: old -->\n" + texts[5]), (n + 1, None), (None, texts[3])]


def test_overlaps_are_counted_where_blocks_meet(spark):
    """Several parts and cells, an id with two rows; nothing but a row or three a new text leaves a task."""
    from quillspark.operators import overlaps

    df = spark.createDataFrame(_word_texts(90, random.Random(3)), "id long, content string")
    new = df.where("id % 4 = 3")
    sets: dict[int, list] = {}
    for i, text in df.collect():
        if i is not None and text is not None:
            words = list(dict.fromkeys(w for w in text.replace("<!--", "").replace(":", "").replace("-->", "").split() if len(w) > 4))
            sets.setdefault(i, []).append((words, "superseded" in text))
    expected = {}
    for i in sets:
        mine = [w for w, _ in sets[i] if len(w) >= 3]
        if i % 4 != 3 or not mine:
            continue
        for j in sets:
            theirs = [w for w, old in sets[j] if w and not old]
            shared = sum(b.count(x) for a in mine for b in theirs for x in a)
            if shared and i != j:
                expected[i, j] = shared / min(min(map(len, mine)), min(map(len, theirs)))
    got = overlaps.figures(new, df, 0.25, block=20)
    assert got.rdd.getNumPartitions() and {r.new_id: (r.candidates, r["first"], r["last"]) for r in got.collect()} == {
        i: (len(js), min(js), max(js)) for i in {i for i, _ in expected} if (js := [j for (x, j), s in expected.items() if x == i and s >= 0.25])
    }
    best = {(r.new_id, r["rank"]): (r.old_id, r.similarity) for r in overlaps.top(new, df, 3, 0.15, block=20).collect()}
    assert best == {(i, k + 1): (j, s) for i in {i for i, _ in expected} for k, (s, j) in enumerate(sorted(((-s, j) for (x, j), s in expected.items() if x == i and s > 0.15))[:3]) for s in [-s]}
    assert overlaps.figures(new.limit(0), df, 0.25).count() == overlaps.top(new, df.limit(0), 3, 0.15).count() == 0


def test_shared_words_are_not_shuffled(spark):
    """A word that all texts hold: 40 x 4,000 pairs, and no join on words."""
    from quillspark.operators import blocks

    df = spark.range(4_000).select("id", F.concat(F.lit("common shared "), F.concat(F.lit("own"), F.col("id"))).alias("content"))
    found = blocks.contradiction_figures(df.where("id % 100 = 0"), df)
    assert {(r.candidates, r["last"]) for r in found.collect()} == {(3_999, 3_999)}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan and "CoGroup" in plan


@pytest.mark.parametrize("small", [0, 4, 16])
def test_near_duplicates_of_several_blocks(spark, small):
    from quillspark.operators import overlaps

    rng = random.Random(11)
    texts = [" ".join(rng.choices([f"word{i:03d}" for i in range(90)], k=rng.choice([1, 3, 8, 30, 60]))) for _ in range(90)]
    texts += [" ".join(t.split()[: rng.randint(1, 40)]) + " other words" for t in texts[:40]] + texts[:5] + ["<!-- superseded: old -->\n" + texts[7]]
    rng.shuffle(texts)
    sets = [{w for w in t.replace("<!-- superseded: old -->\n", "superseded ").split() if len(w) > 4} for t in texts]
    expected = {j for j in range(len(texts)) if len(sets[j]) >= 5 for i in range(j) if sets[i] and "superseded" not in texts[i] and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) > 0.75}
    got = overlaps.contained(spark.createDataFrame([*enumerate(texts), (999, None)], "id long, content string"), 0.75, 5, small=small, block=25)
    assert sorted(r.new_id for r in got.collect()) == sorted(expected)


def test_lines_of_one_side_alone_take_no_search(monkeypatch):
    from quillspark.functions import diff

    old = [f"the line {i}" if i % 2 else f"line {i}" for i in range(2_000)]
    new = [v.replace("the", "THE") for v in old] + ["end"]
    monkeypatch.setattr(diff, "_middle", lambda a, b: pytest.fail("searched"))
    found = list(diff.changes("\n".join(old), "\n".join(new)))
    assert len(found) == 1_001 and {k for _, k, _, _ in found[:-1]} == {"modified"} and found[-1][1] == "added"


def test_a_diff_unpacks_some_rows_at_once(spark):
    from quillspark.operators import versioning

    rows = spark.range(300).select("id", F.lit("a\nb").alias("old"), F.concat(F.lit("a\nc"), F.col("id")).alias("new"))
    found = versioning.line_diff(rows, texts=False, at_once=7)
    assert found.where("old IS NOT NULL OR new IS NOT NULL").isEmpty() and versioning.diff_counts(found).where("modified = 1").count() == 300


def test_edges_of_a_search_are_derived_once(spark):
    from quillspark.operators import graph

    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    edges = spark.createDataFrame([(i, i + 1) for i in range(6)], "src long, dst long").coalesce(1).mapInArrow(counted, "src long, dst long")
    nodes = spark.createDataFrame([(i, f"n{i}") for i in range(7)], "id long, name string")
    found = graph.shortest_paths(nodes, edges, 0, [2, 5, 9], 8)
    assert {r.id: (r.hops, r.path[-1]) for r in found.collect()} == {2: (2, "n2"), 5: (5, "n5")}
    assert read.value == 6


def test_rounds_of_components_broadcast_nothing(spark, monkeypatch):
    from quillspark.operators import graph

    plans, write = [], graph.kept
    monkeypatch.setattr(graph, "kept", lambda df, name: (plans.append(df._jdf.queryExecution().executedPlan().toString()), write(df, name))[1])
    edges = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 4), (4, 5), (5, 3), (5, 6)], "src long, dst long")
    assert {(r.id, r.component) for r in graph.components(edges).collect()} == {(1, 1), (2, 1), (3, 3), (4, 3), (5, 3)}
    assert any("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)


def test_vectors_are_placed_some_rows_at_once():
    import pyarrow as pa

    from quillspark.operators import similar

    batch = pa.RecordBatch.from_pydict({"dims": np.array([3, 2] * 2_500), "id": np.arange(5_000)})
    parts = [(d, b.num_rows, b.column("id").to_pylist()) for d, b in similar._by_length(batch)]
    assert max(n for _, n, _ in parts) <= similar.ROWS and sorted(i for _, _, ids in parts for i in ids) == list(range(5_000))


def test_tasks_of_cosine_pairs_grow_with_the_pairs(spark, monkeypatch):
    from quillspark.operators import similar

    monkeypatch.setattr(similar, "PAIRS", 1_000)
    x = np.random.default_rng(1).normal(size=(200, 8))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")
    assert similar.blocks(df, 0.4).rdd.getNumPartitions() == 20
    u = x / np.linalg.norm(x, axis=1)[:, None]
    assert similar.groups(df, 0.4).agg(F.sum("n")).first()[0] == int(np.triu(u @ u.T >= 0.4, 1).sum())


@pytest.mark.parametrize("near", ["n", "mixed", "id"])
def test_histories_of_several_parts_equal_walking(spark, near):
    """Parts whose parents lie near, and parts dealt without any order; with roots, unknown parents and chains that lead back to themselves."""
    from quillspark.operators.history import Ancestry

    rng = random.Random(8)
    parent = {i: (None if i in (0, 300) else rng.randrange(max(0 if i < 300 else 300, i - 4), i)) for i in range(500)}
    parent |= {500: 501, 501: 502, 502: 500, 503: 500, 504: 503, 505: 999, 506: 505, 507: 505}
    rows = [(f"c{i:03d}", None if p is None else f"c{p:03d}", i, i * 37 % 101) for i, p in parent.items()]
    c = spark.createDataFrame(rows, "id string, parent string, n int, mixed int")

    def way(i):
        out = []
        while i in parent and i not in out:
            out.append(i)
            i = parent[i]
        return out

    loose = {500, 501, 502, 503, 504}
    history = Ancestry(c, near, rows=40)
    name = lambda i: None if i is None else f"c{i:03d}"
    assert {r.id: (r.root, r.depth) for r in history.depths().collect()} == {name(i): (None, None) if i in loose else (name(way(i)[-1]), len(way(i)) - 1) for i in parent}
    starts = [299, 499, 0, 504, 501, 506]
    got = history.ancestors(spark.createDataFrame([(name(s),) for s in starts], "start string")).collect()
    assert sorted((r.start, r.id, r.distance) for r in got) == sorted((name(s), name(x), n) for s in starts for n, x in enumerate(way(s)))
    pairs = {(rng.choice([*parent]), rng.choice([*parent])) for _ in range(400)} | {(i, i - 5) for i in range(5, 500)} | {(7, 7), (506, 507), (506, 999), (504, 503)}
    expected = {(name(a), name(b)): None if {a, b} & loose else name(next((x for x in way(a) if x in set(way(b))), None)) for a, b in pairs}
    found = history.merge_bases(spark.createDataFrame([(name(a), name(b)) for a, b in pairs], "a string, b string")).collect()
    assert len(found) == len(pairs) and {(r.a, r.b): r.base for r in found} == expected


def test_doubling_goes_over_gates_alone(spark):
    """A long history by its order: what is doubled is a few gates a part, not every commit."""
    from quillspark.operators.history import Ancestry

    c = spark.range(5_000).select(F.concat(F.lit("c"), "id").alias("id"), F.concat(F.lit("c"), F.col("id") - 1 - F.pmod(F.xxhash64("id"), F.lit(3))).alias("parent"), F.col("id").alias("seq"))
    history = Ancestry(c, "seq", rows=500)
    assert history.nodes.count() == 5_000 and max(level.count() for level in history.levels) <= 3 * 12


@pytest.mark.parametrize("name, folder", [("stream_ingest", "ingest/*/in/part1"), ("stream_maintenance", "maintenance/*/in")])
def test_no_task_takes_the_whole_input_of_a_stream(spark, tmp_path, monkeypatch, name, folder):
    from quillspark.plans import streams

    monkeypatch.setattr(streams, "scratch", lambda spark: str(tmp_path / "shared"))
    place = tmp_path / "tables"
    spark.range(60).select(F.col("id").alias("doc_id"), F.concat(F.lit("text of "), "id").alias("text"), (F.col("id") % 2).cast("string").alias("source")).repartition(6).write.parquet(str(place / "documents.parquet"))
    spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality")).toPandas().to_parquet(place / "labels.parquet")
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for k in before:
            spark.conf.set(k, "2000")
        got = catalog.queries()[name](spark, str(place)).collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert len(list((tmp_path / "shared").glob(f"{folder}/*.parquet"))) > 1
    if name == "stream_ingest":
        assert {(r.name, r.times) for r in got} == {(f"s{i}", 2 if i % 3 == 0 else 1) for i in range(60)}
    else:
        assert {(r.place, r.state) for r in got} == {(i, "done") for i in range(5)} and {r.n for r in got if r.place == 0} == {60}


def test_a_new_user_takes_few_calls_to_the_store():
    import pandas as pd

    from quillspark.streaming.states import Learner

    calls = []

    class State:
        def __init__(self, name, held):
            self.name, self.held = name, held

        def __getattr__(self, call):
            calls.append((self.name, call))
            return lambda *args: self.held if call == "get" else iter(self.held or ()) if call in ("iterator", "keys") else False if call in ("exists", "containsKey") else None

    def told(held, recent=(), kinds=()):
        calls.clear()
        learner = Learner(0.6, 2, 1)
        learner.handle, learner.importance, learner.recent, learner.kinds = State("handle", None), State("importance", held), State("recent", recent), State("kinds", kinds)
        rows = pd.DataFrame({"ms": [1, 3, 2], "event_id": [7, 8, 9], "event_type": ["a", None, "a"]})
        return next(learner.handleInputRows((5,), iter([rows]), None)).iloc[0]

    row = told(None)
    assert len(calls) == 5 and (row["n"], row["kinds"], row["oldest"]) == (3, 1, 9)
    row = told((0.5, 4, 10), [(9, 1), (8, 2)], [(("b",), (4,))])
    assert len(calls) == 8 and (row["n"], row["kinds"], row["oldest"]) == (7, 2, 2)


def test_a_word_index_is_built_and_opened_by_tasks_that_grow_with_it(spark, tmp_path, monkeypatch):
    """Whatever the session's number of shuffle partitions; a document's scores are summed where its block is."""
    from quillspark.operators import questions, retrieval

    monkeypatch.setattr(questions, "WORDS", 400)
    monkeypatch.setattr(questions, "SCORES", 1_000)
    rng = random.Random(4)
    chunks = spark.createDataFrame([(i, " ".join(f"w{rng.randrange(60)}" for _ in range(20))) for i in range(400)], "id long, text string")
    asked = spark.createDataFrame([(q, " ".join(f"w{rng.randrange(60)}" for _ in range(4))) for q in range(60)], "qid long, text string")
    questions.build(chunks, str(tmp_path / "index"), per_block=10)
    index = questions.Words(spark, str(tmp_path / "index"))
    weighed = index.weighed(asked)
    every = index.bounds(weighed)
    assert index.tasks == 20 and len(list((tmp_path / "index" / "postings").glob("*.parquet"))) > 10
    assert weighed.rdd.getNumPartitions() == 20
    assert index.sums(weighed, every.where("qid < 2")).rdd.getNumPartitions() == 20 and index.sums(weighed, every).rdd.getNumPartitions() == 24
    got = index.search(asked, 5).collect()
    for q in (0, 30, 59):
        text = asked.where(f"qid = {q}").first()["text"]
        assert sorted((r.id, round(r.score, 6)) for r in got if r.qid == q) == sorted((r.id, round(r.score, 6)) for r in retrieval.bm25(chunks, text, 5).collect())


def test_a_provider_is_given_some_texts_at_once(spark):
    """A batch of many or of long texts is unpacked bit by bit; nulls are empty texts, no text is lost."""
    from quillspark.operators.providers import embed

    def provider(texts):
        assert len(texts) <= 256 and (len(texts) == 1 or sum(map(len, texts)) <= 1 << 20)
        return np.array([[float(len(t)), 1.0] for t in texts])

    text = F.when(F.col("id") % 100 == 7, F.repeat(F.lit("x"), 700_000)).when(F.col("id") % 100 != 8, F.repeat(F.lit("y"), (F.col("id") % 50).cast("int")))
    rows = spark.range(0, 1_000, 1, 1).select("id", text.alias("text"))
    got = {r.id: list(r.v) for r in rows.select("id", embed("text", provider).alias("v")).collect()}
    assert got == {i: [700_000.0 if i % 100 == 7 else 0.0 if i % 100 == 8 else float(i % 50), 1.0] for i in range(1_000)}
    assert rows.where("id < 0").select(embed("text", provider).alias("v")).collect() == []
