"""Operators on small literal inputs: traps and edges that the tables don't hold."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.functions import text as T
from quillspark.operators import analytics, blocks, graph, learning, retrieval, sessions, versioning
from quillspark.sources.markdown import parse_blocks


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_truncation_ends_at_a_character(spark):
    assert one(spark, T.truncate_bytes(F.lit("aé漢😀"), 4)) == "aé"
    assert one(spark, T.truncate_bytes(F.lit("aé漢😀"), 9)) == "aé漢"
    assert one(spark, T.truncate_bytes(F.lit("abc"), 3, "...")) == "abc"
    assert one(spark, T.truncate_bytes(F.lit("abcd"), 3, "...")) == "abc..."


@pytest.mark.parametrize("text, most, n", [("a\n\nb\n\nc", 100, 1), ("x" * 800 + "\n\n" + "y" * 800, 1000, 2), ("", 100, 0), ("z" * 5000, 100, 1)])
def test_paragraph_chunks(spark, text, most, n):
    assert len(one(spark, T.chunk_paragraphs(F.lit(text), most))) == n


def test_keywords_keep_repeats_and_inner_dashes(spark):
    assert one(spark, T.keywords(F.lit("What about-- e2e-tests, tests and tests?"))) == ["e2e-tests", "tests", "tests"]


def test_confidence_reads_the_last_line(spark):
    got = one(spark, T.confidence(F.lit("a\nCONFIDENCE: low\nb\nconfidence: HIGH")))
    assert (got["content"], got["level"]) == ("a\nCONFIDENCE: low\nb", "high")
    assert one(spark, T.confidence(F.lit("plain  \n")))["level"] is None


def test_redaction_takes_every_occurrence(spark):
    key = "AKIA" + "A1B2" * 4
    assert one(spark, T.redact(F.lit(f"{key} {key}"))) == "[REDACTED:AWS Access Key] [REDACTED:AWS Access Key]"


def test_token_f1_of_nothing(spark):
    assert one(spark, T.token_f1(F.lit(""), F.lit("the"))) == 1.0
    assert one(spark, T.token_f1(F.lit("x"), F.lit(""))) == 0.0
    assert one(spark, T.token_f1(F.lit("A cat"), F.lit("the cat"))) == 1.0


@pytest.mark.parametrize("strength, days, value", [(1.0, 30, 0.368), (5.0, 30, 0.819), (None, 0, 1.0), (99.0, 30, 0.819)])
def test_retention(spark, strength, days, value):
    assert one(spark, S.retention(F.lit(strength).cast("double"), F.lit(days))) == pytest.approx(value, abs=1e-3)


def test_learning_steps(spark):
    assert one(spark, S.learn(F.lit(0.5), F.lit(0.8), 0.1)) == pytest.approx(0.53)
    assert one(spark, S.learn(F.lit(0.0), F.lit(0.3), 0.2)) == pytest.approx(0.1)


@pytest.mark.parametrize("action, days, left", [("Extend7d", 7, 14), ("Reduce3d", 7, 4), ("Reduce7d", 3, 1), ("MakePermanent", 3, None), ("Extend30d", None, 60)])
def test_ttl_actions(spark, action, days, left):
    assert one(spark, S.ttl_after(F.lit(action), F.lit(days).cast("long"))) == left


def test_days_are_whole_and_toward_zero(spark):
    a, b = F.lit("2024-01-01 23:00:00").cast("timestamp"), F.lit("2024-01-02 01:00:00").cast("timestamp")
    assert one(spark, S.days_between(a, b)) == 0


@pytest.mark.parametrize("ttl, gone", [("1d", True), ("3d", False), ("never", False), (None, False), ("x", False), ("48h", False), ("47h", True)])
def test_expiry_is_strict(spark, ttl, gone):
    ts, now = F.lit("2024-01-01 00:00:00").cast("timestamp"), F.lit("2024-01-03 00:00:00").cast("timestamp")
    assert one(spark, S.expired(ts, F.lit(ttl).cast("string"), now)) is gone


def test_cosine_of_odd_vectors(spark):
    v = lambda *x: F.array(*map(F.lit, x)) if x else F.array().cast("array<double>")
    assert one(spark, S.cosine(v(0.0, 0.0), v(1.0, 0.0))) == 0.0
    assert one(spark, S.cosine(v(1.0), v(1.0, 0.0))) == 0.0
    assert one(spark, S.cosine(v(1.0, 1.0), v(2.0, 2.0))) == pytest.approx(1.0)


def test_blocks_of_markdown(spark):
    text = "pre\n## Session: bad heading\nx\n## Session: a (2024-01-01T00:00:00Z) [confidence:high] [ttl:7d] [updated] [access:3]\n\nbody\n[x] y\n## Session: b (junk)\nlast"
    got = parse_blocks(spark.createDataFrame([(text,)], "value string")).orderBy("part").collect()
    assert [(r.session_id, r.ttl, r.confidence, r.access_count, r.ts is None) for r in got] == [("a", "7d", "high", 3, False), ("b", None, None, None, True)]
    assert got[0].content == "body\n[x] y" and got[1].preview == "last"


def test_turns_of_odd_transcripts(spark):
    rows = [("s", 0, "assistant", "early"), ("s", 1, "user", "lost"), ("s", 2, "user", "kept"), ("s", 3, "assistant", "a"), ("s", 4, "assistant", "b"), ("s", 5, "user", "open")]
    got = sessions.turns(spark.createDataFrame(rows, "session_id string, pos long, role string, text string")).orderBy("turn_no").collect()
    assert [(r.user_text, r.n_answers) for r in got] == [("lost", 1), ("kept", 2)]


def test_tools_pair_in_order_and_leftovers_stay(spark):
    uses = spark.createDataFrame([("s", "t", 1, "Bash", "x"), ("s", "t", 2, "Bash", "y"), ("s", "u", 3, "Read", "z")], "session_id string, id string, pos long, tool string, input string")
    results = spark.createDataFrame([("s", "t", 4, "ok"), ("s", "v", 5, "orphan")], "session_id string, id string, pos long, output string")
    got = {(r.id, r.use_pos, r.result_pos, r.tool) for r in sessions.pair_tools(uses, results).collect()}
    assert got == {("t", 1, 4, "Bash"), ("t", 2, None, "Bash"), ("u", 3, None, "Read"), ("v", None, 5, "unknown")}


def test_importance_fold_matches_single_steps(spark):
    rewards = spark.createDataFrame([("k", 0, 0, 0.3, 0.2, 5), ("k", 1, 0, 0.9, 0.2, 1)], "id string, ord int, at long, reward double, rate double, n long")
    value = 0.0
    for r in [0.3] * 5 + [0.9]:
        value = min(max(value + 0.2 * (r - value), 0.1), 1.0)
    assert learning.fold(rewards).first()["value"] == pytest.approx(value * 0.98)


def test_untrained_choices_take_the_last(spark):
    q = spark.createDataFrame([("s", a, 0.0) for a in learning.ACTIONS], "state string, action string, q double")
    assert learning.greedy(q).first()["action"] == "Reduce7d"
    means = spark.createDataFrame([(i, 0.0) for i in range(4)], "arm long, mean double")
    assert learning.best_arm(means).first()["arm"] == 3


def test_convergence_needs_enough_rows(spark):
    h = lambda xs: spark.createDataFrame([*enumerate(xs)], "seq long, health int")
    assert learning.converged(h([90] * 9)).first()["converged"] is False
    assert learning.converged(h([1] + [90] * 10)).first()["converged"] is True
    assert learning.converged(h([1, 90] * 5)).first()["converged"] is False


def test_graph_with_cycles_and_loops(spark):
    e = spark.createDataFrame([(1, 2), (2, 1), (2, 3), (3, 3), (4, 9)], "src long, dst long")
    assert {(r.id, r.component) for r in graph.components(e).collect()} == {(1, 1), (2, 1)}
    starts = spark.createDataFrame([(1,)], "id long")
    assert {(r.id, r.depth) for r in graph.neighbours(e, starts, 2).collect()} == {(2, 1), (3, 2)}
    assert graph.neighbours(e, starts.where("id > 5"), 2).count() == 0


def test_log_stops_at_a_cycle(spark):
    from quillspark.operators.history import Ancestry

    c = spark.createDataFrame([("a", "b", "fix 1"), ("b", "c", "add"), ("c", "a", "fix 2"), ("d", "gone", "fix")], "id string, parent string, message string")
    history = Ancestry(c)
    assert [r.id for r in history.log(c, "a", 5).collect()] == ["a", "b", "c"]
    assert [r.id for r in history.log(c, "a", 1, "fix").collect()] == ["a"]
    assert [r.id for r in history.log(c, "d").collect()] == ["d"] and history.log(c, "gone").collect() == []
    assert {r.id: (r.root, r.depth) for r in history.depths().collect()} == {"a": (None, None), "b": (None, None), "c": (None, None), "d": ("d", 0)}
    assert Ancestry(c.limit(0)).depths().collect() == []


def test_ancestry_equals_walking(spark):
    import random

    from quillspark.operators.history import Ancestry

    rng = random.Random(6)
    parent = {i: (None if i in (0, 700) else rng.randrange(max(0 if i < 700 else 700, i - 4), i)) for i in range(1100)}
    c = spark.createDataFrame([(f"c{i}", None if p is None else f"c{p}") for i, p in parent.items()], "id string, parent string")

    def way(i):
        out = []
        while i is not None:
            out.append(i)
            i = parent[i]
        return out

    history = Ancestry(c)
    assert {r.id: (r.root, r.depth) for r in history.depths().collect()} == {f"c{i}": (f"c{way(i)[-1]}", len(way(i)) - 1) for i in parent}
    starts = spark.createDataFrame([("c699",), ("c1099",), ("c0",), ("none",)], "start string")
    assert {(r.start, r.id, r.distance) for r in history.ancestors(starts).collect()} == {(f"c{s}", f"c{x}", n) for s in (699, 1099, 0) for n, x in enumerate(way(s))}
    pairs = [(rng.randrange(1100), rng.randrange(1100)) for _ in range(300)] + [(5, 5), (698, 699)]
    expected = {(f"c{a}", f"c{b}"): next((f"c{x}" for x in way(a) if x in set(way(b))), None) for a, b in pairs}
    expected["c1", "none"] = None
    frame = spark.createDataFrame([(f"c{a}", f"c{b}") for a, b in pairs] + [("c1", "none")], "a string, b string")
    assert {(r.a, r.b): r.base for r in history.merge_bases(frame).collect()} == expected


def test_line_diff_kinds(spark):
    rows = spark.createDataFrame([(1, "a\nb\nc", "a\nB\nc\nd"), (2, "x", "x"), (3, "x\ny", "x")], "id long, old string, new string")
    got = {(r.id, r.line_num, r.diff_type) for r in versioning.line_diff(rows).collect()}
    assert got == {(1, 2, "modified"), (1, 4, "added"), (3, 2, "removed")}


def test_edit_scripts_are_shortest():
    import random
    import time

    from quillspark.functions import diff

    def common(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            before = 0
            for j, y in enumerate(b):
                before, row[j + 1] = row[j + 1], before + 1 if x == y else max(row[j + 1], row[j])
        return row[-1]

    rng = random.Random(8)
    for _ in range(2000):
        letters = "abcdef"[: rng.randint(1, 6)]
        a, b = ([rng.choice(letters) for _ in range(rng.randint(0, 18))] for _ in range(2))
        if rng.random() < 0.4:
            b = [x for x in a if rng.random() < 0.8] + b[:2]
        in_a, in_b = diff.kept_lines(a, b)
        assert [x for x, k in zip(a, in_a, strict=True) if k] == [x for x, k in zip(b, in_b, strict=True) if k]
        assert in_a.sum() == in_b.sum() == common(a, b)
        out, i = [], 0
        for i1, i2, j1, j2 in diff.hunks(a, b):  # the script turns one into the other
            out += a[i:i1] + b[j1:j2]
            i = i2
        assert out + a[i:] == b
    began = time.perf_counter()
    diff.kept_lines([f"a{i}" for i in range(4000)], [f"b{i}" for i in range(4000)])
    long = [f"line {rng.random()}" for _ in range(100_000)]
    assert diff.kept_lines(long, [*long[:50_000], "new", *long[50_001:], "end"])[0].sum() == 99_999
    assert time.perf_counter() - began < 20


def test_line_budget_keeps_the_first_and_stops(spark):
    rows = [("p", "c", f"s{i}", i, f"2024-01-0{9 - i}", "x\n" * n) for i, n in enumerate([50, 1, 1])]
    b = spark.createDataFrame(rows, "project string, category string, session_id string, pos long, ts_raw string, content string")
    assert [r.session_id for r in blocks.line_budget(b, 10).collect()] == ["s0"]


def test_insights_of_one_event(spark):
    e = spark.createDataFrame([(datetime(2024, 1, 1), "Ingest", "p", 7)], "ts timestamp, event_type string, project string, tokens long")
    r = analytics.insights(e).first()
    assert (r.total_events, r.tokens_ingested, r.trend, r.trend_pct) == (1, 7, "increasing", None)


def test_bm25_counts_repeated_terms(spark):
    c = spark.createDataFrame([(1, "red fox"), (2, "red red"), (3, "blue"), (4, "")], "id long, text string")
    single = {r.id: r.score for r in retrieval.bm25(c, "red", 10).collect()}
    double = {r.id: r.score for r in retrieval.bm25(c, "red red", 10).collect()}
    assert set(single) == {1, 2} and single[2] > single[1]
    assert double[1] == pytest.approx(2 * single[1])


def test_journal_lines(spark):
    lines = ['{"type":"user","sessionId":"s","message":{"role":"user","content":"hi"}}', "", "{broken", '{"type":"other"}', '{"type":"assistant","sessionId":"s","message":{"content":[{"type":"text","text":"a"},{"type":"tool_use","id":"t"},{"type":"text","text":"b"}],"usage":{"input_tokens":3}}}']
    got = sessions.parse_journal(spark.createDataFrame([*enumerate(lines)], "pos long, value string")).orderBy("pos")
    got = got.select("type", sessions.content_text(F.col("content")).alias("text"), "input_tokens").collect()
    assert [tuple(r) for r in got] == [("user", "hi", None), ("assistant", "a\nb", 3)]


def test_line_diff_covers_every_document(spark):
    import difflib

    from quillspark.plans import versions

    sf = "/root/testdata/sf0.001"
    expected = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect():
        a, b = r.text.split("\n"), (r.text.replace("the", "THE") + "\nend").split("\n")
        ops = [o for o in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if o[0] != "equal"]
        expected[r.doc_id] = sum(max(o[2] - o[1], o[4] - o[3]) for o in ops)
    got = {r.id: r.n for r in versions.line_diff(spark, sf).groupBy("id").agg(F.count("*").alias("n")).collect()}
    assert got == expected


def test_secrets_far_into_a_text_are_found(spark, monkeypatch):
    from quillspark.plans import documents, texts

    far = "words " * 100 + "\nmore\nid AKIA" + "Z9Y8" * 4
    rows = spark.createDataFrame([(5, "p", "patterns", far), (10, "q", "patterns", "clean\ntext"), (15, "q", "bugs", far)], "pos long, project string, category string, content string")
    monkeypatch.setattr(texts, "blocks", lambda spark, d: rows)
    monkeypatch.setattr(texts, "table", lambda spark, d, name: rows.withColumnsRenamed({"pos": "doc_id", "content": "text"}))
    monkeypatch.setattr(documents, "blocks", lambda spark, d: rows)
    assert {tuple(r) for r in texts.secret_scan(spark, "").collect()} == {(5, 5, "AWS Access Key", "AKI***9Y8"), (15, 5, "AWS Access Key", "AKI***9Y8")}
    assert {tuple(r) for r in documents.pack_gate(spark, "").collect()} == {("p", 1, 1, False), ("q", 1, 0, True)}


def test_components_equal_brute_force(spark):
    import random

    for seed in range(3):
        rng = random.Random(seed)
        edges = {(rng.randint(0, 29), rng.randint(0, 29)) for _ in range(45)}
        reach = {n: {n} for n in range(30)}
        for _ in range(30):
            for a, b in edges:
                reach[a] |= reach[b]
        expected = {}
        for n in range(30):
            same = [m for m in range(30) if m in reach[n] and n in reach[m]]
            if len(same) > 1:
                expected[n] = min(same)
        got = graph.components(spark.createDataFrame([*edges], "src long, dst long"))
        assert {r.id: r.component for r in got.collect()} == expected


def test_shortest_path_of_none(spark):
    nodes = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, name string")
    edges = spark.createDataFrame([(1, 2)], "src long, dst long")
    assert graph.shortest_path(nodes, edges, 1, 3, 5).count() == 0
    assert graph.shortest_path(nodes, edges.union(edges.selectExpr("2L", "3L")), 1, 3, 5).first()["path"] == ["a", "b", "c"]
    assert graph.shortest_path(nodes, edges, 1, 1, 5).first()["path"] == ["a"]


def test_cosine_pairs_equal_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    centres = rng.normal(size=(20, 8))
    x = centres[rng.integers(0, 20, 400)] + rng.normal(size=(400, 8)) * 0.3
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, str(i % 3), v.tolist()) for i, v in enumerate(x)], "id long, category string, embedding array<double>")
    for by in (None, "category"):
        expected = {(i, j) for i in range(400) for j in range(i + 1, 400) if unit[i] @ unit[j] >= 0.9 and (by is None or i % 3 == j % 3)}
        assert {(r.a, r.b) for r in blocks.supersedable(df, 0.9, 2.0, by).collect()} == expected


def test_cosine_pairs_of_clusters_visit_few_pairs(spark):
    import numpy as np

    from quillspark.operators import similar

    rng = np.random.default_rng(1)
    centres = rng.normal(size=(100, 64))
    x = centres[rng.integers(0, 100, 3000)] + rng.normal(0, 0.4, (3000, 64))
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    met = similar.blocks(df, 0.9).groupBy("grp", "dims", "cell", "left", "right").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") > 0).alias("b"))
    told = met.agg(F.sum(F.col("a") * F.col("b")).alias("visited"), F.sum(F.col("a") + F.col("b")).alias("rows")).first()
    assert told.visited < 0.1 * 3000**2 / 2 and told.rows < 4 * 3000
    cosine = unit @ unit.T
    expected = {(int(i), int(j)) for i, j in zip(*np.nonzero(np.triu(cosine >= 0.9, 1)), strict=True)}
    assert {(r.a, r.b) for r in similar.pairs(df, 0.9, 2.0).collect()} == expected
    # Small blocks: a cell is many tasks, the pairs are the same.
    assert {(r.a, r.b) for r in similar.pairs(df, 0.9, 2.0, pivots=3, block=200).collect()} == expected
    groups = {r.anchor: (r.n, r.first, r.last) for r in similar.groups(df, 0.9, block=100).collect()}
    later = {}
    for i, j in expected:
        later.setdefault(i, []).append(j)
    assert groups == {i: (len(js), min(js), max(js)) for i, js in later.items()}


def test_cosine_pairs_of_odd_vectors(spark):
    from quillspark.operators import similar

    odd = [(1, [1.0, 0.0]), (2, [2.0, 0.0]), (3, [1.0, 0.0, 0.0]), (4, [0.0, 0.0]), (5, None), (6, []), (7, [float("nan"), 1.0]), (8, [None, 1.0]), (9, [5.0, 0.0, 0.0]), (2, [2.0, 0.0])]
    df = spark.createDataFrame(odd, "id long, embedding array<double>")
    assert sorted((r.a, r.b) for r in similar.pairs(df, 0.9, 2.0).collect()) == [(1, 2), (1, 2), (3, 9)]
    assert similar.pairs(df.limit(0), 0.9, 2.0).collect() == []


def test_near_duplicates_equal_brute_force(spark):
    import random

    rng = random.Random(7)
    texts = [" ".join(rng.choices([f"word{i:03d}" for i in range(60)], k=rng.randint(1, 25))) for _ in range(80)]
    texts += [t.replace("word00", "xxxxx0") for t in texts[:30]] + texts[:5] + ["<!-- superseded: old -->\n" + texts[7], "tiny a b"]
    sets = [{w for w in t.replace("<!-- superseded: old -->\n", "superseded ").split() if len(w) > 4} for t in texts]
    expected = {j for j in range(len(texts)) if len(sets[j]) >= 5 for i in range(j) if sets[i] and "superseded" not in texts[i] and len(sets[i] & sets[j]) / min(len(sets[i]), len(sets[j])) > 0.75}
    got = blocks.near_duplicate(spark.createDataFrame([*enumerate(texts)], "id long, content string"))
    assert {r.new_id for r in got.collect()} == expected


def test_recalls_take_several_steps(spark):
    value = 0.0
    for _ in range(5):
        value = min(max(value + (0.6 - value) * 0.2, 0.1), 1.0)
    got = learning.recalled(spark.createDataFrame([("k", 0.3)], "id string, boost double"), spark.createDataFrame([("n",)] * 5, "id string"))
    assert {r.id: round(r.boost, 9) for r in got.collect()} == {"k": 0.3, "n": round(value, 9)}


def test_branches_refuse(spark):
    from quillspark.operators import upkeep

    branches = spark.createDataFrame([("main", "a1")], "branch string, commit_id string")
    for name in ("a/b", "a b", "main", ""):
        with pytest.raises(ValueError):
            upkeep.create_branch(branches, name, "a1")
    for name in ("main", "none"):
        with pytest.raises(ValueError):
            upkeep.delete_branch(branches, name, "main")


def test_requests_are_served(spark):
    import json

    from quillspark.operators import tools
    from quillspark.plans import upkeep

    store = upkeep._store(spark, "/root/testdata/sf0.001")
    call = lambda name, **given: json.dumps({"id": 1, "method": "tools/call", "params": {"name": name, "arguments": given}})
    replies = [json.loads(r) for r in tools.serve(store, ['{"id": 0, "method": "tools/list"}', call("projects"), call("none"), "junk", call("ask", question="the tion"), call("analytics"), call("graph_query", concept="nation_3"), call("status"), call("synthesize", project="src3"), call("learned"), call("ask_hybrid", question="the tion"), call("timeline", session_id="s3"), call("search", query="licensed"), call("forget", expired=True), call("forget_stale"), call("reflect", project="src3", text="x", day="2024-02-01")])]
    assert len(replies[0]["result"]["tools"]) == 21 and replies[1]["result"]["content"]
    assert "error" in replies[2] and "error" in replies[3] and not [r for r in replies[4:] if "error" in r]


def test_state_outlives_batches(spark, tmp_path):
    from quillspark.streaming import streams

    rows = [[(1, 10 + i, f"2024-01-0{b + 1} 00:00:{i:02d}") for i in range(30)] + [(2, b, f"2024-01-0{b + 1} 12:00:00")] * (b == 0) for b in range(4)]
    for b, part in enumerate(rows):
        spark.createDataFrame(part, "user_id long, event_id long, t string").select("user_id", "event_id", F.col("t").cast("timestamp").alias("ts")).coalesce(1).write.parquet(f"{tmp_path}/in/p{b}")
    stream = lambda: spark.readStream.schema("user_id long, event_id long, ts timestamp").option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "*.parquet").parquet(f"{tmp_path}/in")
    recent = {r.user_id: (r.n, r.oldest) for r in streams.drain(streams.recent(stream(), 50), "update", ["user_id"]).collect()}
    assert recent == {1: (50, 20), 2: (1, 0)}
    assert [r.user_id for r in streams.drain(streams.expiring(stream(), 36), "append").collect()] == [2]
    value, n = 0.0, 0
    for part in rows:
        for _ in range(30):
            value = min(max(value + 0.2 * (0.6 - value), 0.1), 1.0)
        value, n = value * 0.98, n + 30
    got = {r.user_id: (round(r.value, 9), r.n) for r in streams.drain(streams.importance(stream()), "update", ["user_id"]).collect()}
    assert got[1] == (round(value, 9), n)


def test_kept_words_answer_as_single_questions_do_and_skip_postings(spark, tmp_path):
    import random

    from quillspark.operators import questions

    rng = random.Random(3)
    topics = [[f"{chr(97 + t)}{w:02d}" for w in range(40)] for t in range(20)]
    texts = [" ".join(rng.choices(topics[i // 50], k=rng.randint(5, 60)) + rng.choices(["and", "the"], k=5)) for i in range(1000)]
    chunks = spark.createDataFrame([*enumerate([*texts, "", None])], "id long, text string")
    questions.build(chunks, str(tmp_path / "index"), per_block=8)
    index = questions.Words(spark, str(tmp_path / "index"))
    asked = [(q, " ".join([*rng.choices(topics[q], k=3), "and", "and"])) for q in range(12)] + [(50, "nowhere"), (51, ""), (52, None)]
    frame = spark.createDataFrame(asked, "qid long, text string")
    got = {}
    for r in index.search(frame, 5).collect():
        got.setdefault(r.qid, []).append((r.id, round(r.score, 6)))
    for q in (0, 7, 11):
        assert sorted(got[q]) == sorted((r.id, round(r.score, 6)) for r in retrieval.bm25(chunks.na.fill(""), asked[q][1], 5).collect())
    assert set(got) == set(range(12))
    _, _, rest, bounds = index.plan(frame, 5)
    read = rest.agg(F.sum("n")).first()[0] or 0
    assert read < 0.8 * bounds.agg(F.sum("n")).first()[0]


def test_vectors_of_many_questions(spark):
    import numpy as np

    from quillspark.operators import questions

    rng = np.random.default_rng(5)
    x, q = rng.normal(size=(300, 6)), rng.normal(size=(40, 6))
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [1.0]), (302, [0.0] * 6), (303, x[0].tolist())]
    chunks = spark.createDataFrame(rows, "id long, embedding array<double>")
    asked = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(q)), (40, None), (41, [2.0])], "qid long, vector array<double>")
    cosine = np.round((q / np.linalg.norm(q, axis=1)[:, None]) @ np.vstack([x / np.linalg.norm(x, axis=1)[:, None], np.zeros((3, 6)), x[:1] / np.linalg.norm(x[0])]).T, 9)
    expected = {(i, int(j)) for i in range(40) for j in np.lexsort((np.arange(304), -cosine[i]))[:7]}
    for most in (4_096, 9):
        got = {(r.qid, r.id) for r in questions.dense(chunks, asked, 7, most).collect()}
        assert {g for g in got if g[0] != 41} == expected and (41, 301) in got
