"""Clustering, spelling variants and toxic passages against brute force, DuckDB and odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.llm import common, lloyd, spelling, toxicity
from tests.oracle import connect, rows

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, x int, cluster string, distance string"
TEXTS = "doc_id long, text string, word string, n int, run string, slot string, toxic string"


def plain_lloyd(vectors, k, rounds):
    kept = [(i, [int(np.floor(64 * v)) for v in x]) for i, x in vectors]
    order = sorted(kept, key=lambda r: (hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    centroids = [x for _, x in order[:k]]
    for turn in range(rounds + 1):
        far = [[sum((a - b) ** 2 for a, b in zip(x, c, strict=True)) for c in centroids] for _, x in kept]
        own = [f.index(min(f)) for f in far]
        if turn < rounds:
            for j in range(len(centroids)):
                mine = [x for (_, x), o in zip(kept, own, strict=True) if o == j]
                if mine:
                    centroids[j] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    return sorted((i, o, min(f)) for (i, _), o, f in zip(kept, own, far, strict=True)), centroids


@pytest.mark.parametrize(("n", "k", "rounds", "spread"), [(120, 5, 6, 1.0), (60, 16, 3, 0.05), (3, 16, 3, 1.0), (80, 4, 30, 0.2)])
def test_clusters_equal_plain_lloyd(spark, n, k, rounds, spread):
    rng = np.random.default_rng(n)
    vectors = [(i, (rng.normal(0, spread, 64)).tolist()) for i in range(n)]
    got = lloyd.cluster(lloyd.quantised(spark.createDataFrame(vectors, "vec_id long, embedding array<double>").repartition(3)), lloyd.seed_order(), k, rounds)
    expected, centroids = plain_lloyd(vectors, k, rounds)
    assert sorted(tuple(r) for r in got.state.select("vec_id", "cluster", "distance").collect()) == expected
    assert got.centroids == centroids


def test_only_what_changed_is_compared_and_moved(spark):
    rng = np.random.default_rng(1)
    x = rng.integers(-50, 50, (200, 8))
    centroids = rng.integers(-50, 50, (6, 8))
    own, far = lloyd.nearest(x, centroids, np.ones(6, bool), np.full(200, -1), np.zeros(200, np.int64))
    after = centroids.copy()
    after[[1, 4]] += 3
    moved = (after != centroids).any(axis=1)
    seen = []
    plain = lloyd.distances
    lloyd.distances = lambda a, c: seen.append((len(a), len(c))) or plain(a, c)
    try:
        new, new_far = lloyd.nearest(x, after, moved, own, far)
    finally:
        lloyd.distances = plain
    assert (new == plain(x, after).argmin(axis=1)).all() and (new_far == plain(x, after).min(axis=1)).all()
    theirs = int(np.isin(own, [1, 4]).sum())
    assert seen == [(theirs, 6), (200 - theirs, 2)]
    state = spark.createDataFrame([([1, 2], 0, 1), ([3, 4], 1, 1), ([5, -6], 2, None)], "x array<int>, cluster int, was int")
    assert sorted(lloyd.transfers(state, 2)) == [(0, 1, [1, 2]), (1, -1, [-1, -2]), (2, 1, [5, -6])]


def test_clusters_of_odd_vectors(spark):
    one, two = [0.5] * 64, [-0.25] * 64
    odd = [(1, one), (1, one), (2, two), (3, None), (4, []), (5, [0.1] * 63), (6, [float("nan")] + one[1:]), (7, [float("inf")] + one[1:]), (8, [None] + one[1:]), (None, two), (9, [0.0] * 64)]
    frame = lambda r: spark.createDataFrame([(i, v, 1, 2, "c", "d") for i, v in r], VECTORS)
    got = lloyd.report(lloyd.cluster(lloyd.quantised(frame(odd)), lloyd.seed_order())).collect()
    assert sorted((r.vec_id or -1) for r in got) == [-1, 1, 1, 2, 9] and {r.inertia for r in got} == {0}
    assert lloyd.report(lloyd.cluster(lloyd.quantised(frame([])), lloyd.seed_order())).collect() == []
    with pytest.raises(Exception, match="beyond"):
        lloyd.quantised(frame([(1, [1e30] * 64)])).collect()


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_clusters_and_forms_equal_sql(spark, sf):
    d = f"/root/testdata/{sf}"
    duck = connect(d)
    for query, sql in ((lloyd.op12_lloyd, lloyd.OP12_SQL), (spelling.op11_spelling, spelling.OP11_SQL)):
        assert rows(query(spark, d).toPandas()) == rows(duck.execute(sql).df())


def is_near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) - len(short) == 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_forms(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: c for w, c in n.items() if c >= 2}
    form, met = {}, {}
    for w in n:
        others = sorted((v for v in n if v != w and is_near(v, w)), key=lambda v: (-n[v], v))
        met[w] = len(others)
        if others and n[others[0]] >= 10 * n[w]:
            form[w] = others[0]
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], met[w], n[form[w]] if w in form else None))
    return sorted(out, key=str)


def test_forms_equal_brute_force(spark):
    rng = random.Random(4)
    bases = ["abababab", "Ünlösbar", "thethethe", "aaaaaaaaaa", "Straßenbahn", "çaçaçaça"]
    docs = []
    for i in range(60):
        words = []
        for _ in range(80):
            w = rng.choice(bases)
            at = rng.randrange(len(w))
            w = rng.choice([w] * 12 + [w[:at] + w[at + 1 :], w[:at] + "b" + w[at:], w[:at] + "a" + w[at + 1 :], w[:at] + "ba" + w[at + 1 :]])
            words.append(rng.choice([w] * 9 + [w.upper()]))
        docs.append((i, " ".join(words)))
    docs += [(None, "abababab " * 3000), (1, None), (2, ""), (3, docs[3][1]), (70, "abcdefgh1abcdefgh_" * 2), (71, ("abcdefghij" * 30_000 + " ") * 2), (72, "kk" * 150_000 + "a " + "kk" * 150_000 + "a " + "kk" * 150_000 + "b " + "kk" * 150_000 + "b")]
    frame = spark.createDataFrame([(d, t, "w", 1, "r", "s", "t") for d, t in docs], TEXTS)
    got = sorted((tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in spelling.variants(frame).collect()), key=str)
    assert got == plain_forms(docs)
    assert any(r[1] for r in got)
    assert spelling.variants(frame.limit(0)).collect() == []


def test_ways_of_several_forms_end_at_the_root(spark):
    forms = spark.createDataFrame([(i, i - 1) for i in range(1, 12)] + [(20, 0), (31, 30)], "r long, form long")
    assert {r.r: r.root for r in spelling.roots(forms).collect()} == {**{i: 0 for i in [*range(1, 12), 20]}, 31: 30}


@pytest.mark.parametrize("piece", [1 << 18, 5, 13])
def test_keys_meet_where_words_are_near(piece, monkeypatch):
    monkeypatch.setattr(spelling, "PIECE", piece)
    rng = random.Random(1)
    words = sorted({"aabbccdd", "aaaaaaaa", "aaaaaaa", "abcdefgh", "abcdefg", "éabcdefg", *("".join(rng.choices("ab", k=rng.randint(7, 11))) for _ in range(60))})
    by = defaultdict(set)
    for k1, k2, word, kind in spelling.keys(words):
        for a, b, w, t in zip(k1.tolist(), k2.tolist(), word.tolist(), kind.tolist(), strict=True):
            by[t, w].add((a, b))
    for i, w in enumerate(words):
        assert len(by[spelling.OPEN, i]) == len(w)
        for j, v in enumerate(words):
            if i != j:
                assert bool(by[spelling.OPEN, i] & by[spelling.OPEN, j]) == (len(v) == len(w) and is_near(v, w))
                assert bool(by[spelling.SHORTER, i] & by[spelling.ITSELF, j]) == (len(v) < len(w) and is_near(v, w))


def plain_segments(s):
    """The best segment, then the same left and right of it."""
    best = max(((sum(s[i:j]), -i, -j) for i in range(len(s)) for j in range(i + 1, len(s) + 1)), default=(0, 0, 0))
    if best[0] <= 0:
        return []
    i, j = -best[1], -best[2]
    return plain_segments(s[:i]) + [(i, j)] + [(a + j, b + j) for a, b in plain_segments(s[j:])]


def test_segments_equal_the_definition():
    rng = np.random.default_rng(0)
    for _ in range(150):
        s = rng.normal(-0.2, 1, rng.integers(0, 22))
        assert [(b, e) for b, e, _ in toxicity.segments(s)] == plain_segments(s.tolist())
    long = np.tile([3.0, -1.0, -1.5], 200_000)  # linear: each segment would else be looked at again
    assert len(toxicity.segments(long)) == 1
    assert len(toxicity.segments(-long)) == 200_000


def test_decay_rate_solves_its_equation():
    scores, shares = np.array([-1.0, 2.0, 5.0]), np.array([0.98, 0.015, 0.005])
    rate = toxicity.decay_rate(scores, shares)
    assert abs(shares @ np.exp(rate * scores) - 1) < 1e-9 and rate > 0
    assert toxicity.decay_rate(np.array([-1.0]), np.array([1.0])) == 1.0


def marked(spark, n=400):
    rng = random.Random(2)
    bad = ["zounds", "knave", "varlet", "churl"]
    docs, labels = [], []
    for i in range(n):
        words = [f"w{chr(97 + rng.randrange(26))}{chr(97 + rng.randrange(26))}" for _ in range(rng.randint(20, 200))]
        toxic = i % 8 == 0
        if toxic:
            at = rng.randrange(len(words))
            words[at:at] = rng.sample(bad, 3)
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_passages_are_found_and_clean_texts_have_none(spark):
    docs, labels = marked(spark)
    clean = " ".join(t for i, t in docs if i % 8)
    extra = [(1000, None), (1001, ""), (1002, "..."), (None, "zounds you knave, you varlet"), (1003, clean * 5), (1004, clean + " ZOUNDS! Knave; varlet " + clean), (1005, "x" * 500_000), (1004, clean)]
    frame = spark.createDataFrame([(d, t, "w", 1, "r", "s", "t") for d, t in docs + extra], TEXTS)
    model = toxicity.fit(frame, labels)
    got = defaultdict(list)
    for r in toxicity.score(frame, model).collect():
        got[r.doc_id].append((r.score, r.passages))
    assert all((got[i][0][0] >= 0.3) == (i % 8 == 0) for i in range(400))
    assert got[None][0][0] >= 0.3 and all(got[i][0][0] < 0.3 for i in (1000, 1001, 1002, 1003, 1005))
    found = [r for r in toxicity.passages(frame, model).collect() if r.doc_id == 1004]
    assert len(found) == 1 and found[0].passage == "ZOUNDS! Knave; varlet" and found[0].expected <= toxicity.ALPHA
    assert found[0].begin == len(clean) + 1 and found[0].end == found[0].begin + len(found[0].passage)
    assert toxicity.score(frame.limit(0), model).collect() == []
    # Marks are learned from neither held-out rows nor rows without a mark.
    ids = [r.doc_id for r in toxicity.sampled(labels).collect()]
    assert ids and all(zlib.crc32(str(i).encode()) % 4 != 2 for i in ids)


def test_without_marks_nothing_is_toxic(spark):
    docs, labels = marked(spark, 20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    for some in (labels.limit(0), labels.withColumn("toxic", F.lit(0)), labels.withColumn("toxic", F.lit(None).cast("int"))):
        assert {r.score for r in toxicity.score(frame, toxicity.fit(frame, some)).collect()} == {0.0}
    both = spark.createDataFrame([(1, 0), (1, 1), (None, 1), (3, None)], "doc_id long, toxic int")
    assert [tuple(r) for r in toxicity.sampled(both).collect()] == ([(1, 1)] if zlib.crc32(b"1") % 4 != 2 else [])


def test_toxicity_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    got = toxicity.op13_toxicity(spark, d)
    assert [f.name for f in got.schema][:4] == ["doc_id", "held_out", "score", "predicted"]
    told = got.join(common.table(spark, d, "labels"), "doc_id").where("held_out").select("predicted", "toxic").collect()
    hits = Counter((r.predicted, r.toxic) for r in told)
    assert hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.85 and hits[1, 0] / (hits[1, 0] + hits[0, 0]) < 0.02
