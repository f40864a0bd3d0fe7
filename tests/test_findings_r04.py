"""Findings of round 4: pairs by cosine at size, and at the end of a band."""

from __future__ import annotations

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.operators import similar


def _block(x, ids, left, right):
    """Arrow batches of a block: the first half of the rows meets the second one, or itself."""
    half = len(x) // 2
    sides = [(0, slice(0, half)), (1, slice(half, None)) if left != right else (1, slice(0, half))]
    for side, rows in sides:
        n = len(ids[rows])
        yield pa.RecordBatch.from_pydict({"id": pa.array(ids[rows]), "side": pa.array(np.full(n, side)), "left": pa.array(np.full(n, left)), "right": pa.array(np.full(n, right)), "vector": pa.array([v.tobytes() for v in x[rows]], pa.binary())})


def _brute(cosine, ids, others, low, itself):
    """anchor to n, first, last of two lists of ids."""
    told: dict[int, list[int]] = {}
    for p, q in zip(*np.nonzero(cosine >= low), strict=True):
        a, b = int(ids[p]), int(others[q])
        if a < b or (a > b and not itself):
            told.setdefault(min(a, b), []).append(max(a, b))
    return {a: (len(b), min(b), max(b)) for a, b in told.items()}


def _merged(batches):
    told: dict[int, tuple[int, int, int]] = {}
    for batch in batches:
        for r in batch.to_pylist():
            n, first, last = told.get(r["anchor"], (0, r["first"], r["last"]))
            told[r["anchor"]] = (n + r["n"], min(first, r["first"]), max(last, r["last"]))
    return told


@pytest.mark.parametrize(("low", "right"), [(0.4, 1), (0.4, 0), (0.02, 1), (0.02, 0), (-0.9, 1)])
def test_blocks_of_vectors_without_structure_are_multiplied_whole(monkeypatch, low, right):
    """Few and many pairs of a tile, several tiles; hardly a pair is computed by itself."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5_000, 64))
    ids = rng.permutation(np.concatenate([np.arange(4_990), np.arange(10)])).astype(np.int64)
    singly, plain = [], similar._cosines
    monkeypatch.setattr(similar, "_cosines", lambda one, two, p, q: singly.append(len(p)) or plain(one, two, p, q))
    got = _merged(similar._counted(_block(x, ids, 0, right), low))
    u, h = x / np.linalg.norm(x, axis=1)[:, None], 2_500
    others = slice(h, None) if right else slice(0, h)
    assert got == _brute(u[:h] @ u[others].T, ids[:h], ids[others], low, not right)
    assert sum(singly) < 0.001 * h * h


@pytest.mark.parametrize("low", [0.4, 0.5, 0.6])
def test_cosines_at_the_threshold_fall_as_in_sql(spark, low):
    x = np.random.default_rng(5).integers(0, 2, (300, 12)).astype(float)
    rows = [(i, v) for i, v in enumerate(x.tolist()) if any(v)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    con = duckdb.connect()
    con.register("t", pa.table({"id": [i for i, _ in rows], "embedding": [v for _, v in rows]}))
    told = con.sql("SELECT x.id AS a, y.id AS b, list_cosine_similarity(x.embedding, y.embedding) AS s FROM t x JOIN t y ON x.id < y.id").fetchall()
    expected = {(a, b): s for a, b, s in told if s >= low}
    assert any(abs(s - low) < 1e-12 for s in expected.values())
    assert {(r.a, r.b): r.similarity for r in similar.pairs(df, low, 2.0).collect()} == expected
    # The upper end, too.
    assert {(r.a, r.b) for r in similar.pairs(df, 0.2, low).collect()} == {(a, b) for a, b, s in told if 0.2 <= s <= low}
    later: dict[int, list[int]] = {}
    for a, b in expected:
        later.setdefault(a, []).append(b)
    assert {r.anchor: (r.n, r.first, r.last) for r in similar.groups(df, low, block=64).collect()} == {a: (len(b), min(b), max(b)) for a, b in later.items()}


def test_vectors_without_structure_meet_once_and_are_copied_once_a_block(spark):
    n = 2_000
    x = np.random.default_rng(6).normal(size=(n, 64))
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")
    met = similar.blocks(df, 0.4, block=250).groupBy("grp", "dims", "cell", "left", "right").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") > 0).alias("b"))
    told = met.agg(F.sum(F.col("a") * F.col("b")).alias("visited"), F.sum(F.col("a") + F.col("b")).alias("rows"), F.max(F.greatest("a", "b")).alias("most"), F.count("*").alias("blocks")).first()
    # Eight blocks: 36 pairs of them, of which eight are a block with itself.
    assert told.blocks == 36 and told.rows == 9 * n and told.most < 2 * 250
    assert n * (n - 1) / 2 <= told.visited < 0.6 * n * n


def test_visitors_are_dealt_by_their_own_number(spark):
    """Four cells that lie near each other: the lowest one is visited by the other three."""
    x = np.random.default_rng(7).normal(size=(2_000, 3)) * 0.4 + [1, 0, 0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "id long, embedding array<double>")
    met = similar.blocks(df, 0.3, pivots=4, block=100).groupBy("grp", "dims", "cell", "left", "right").agg(F.count_if(F.col("side") == 0).alias("a"), F.count_if(F.col("side") > 0).alias("b"), F.count_if(F.col("side") == 2).alias("visitors"))
    told = met.agg(F.max(F.greatest("a", "b")).alias("most"), F.sum("visitors").alias("visitors"), F.count_distinct("cell").alias("cells")).first()
    assert told.cells == 4 and told.visitors > 0 and told.most < 2 * 100
    u = x / np.linalg.norm(x, axis=1)[:, None]
    expected = np.triu(u @ u.T >= 0.3, 1)
    got = {r.anchor: (r.n, r.first, r.last) for r in similar.groups(df, 0.3, pivots=4, block=100).collect()}
    assert got == {int(i): (int(r.sum()), int(np.flatnonzero(r)[0]), int(np.flatnonzero(r)[-1])) for i, r in enumerate(expected) if r.any()}


def test_very_long_and_very_short_vectors(spark):
    x = [[3e150, 4e150], [3e150, 4.1e150], [3e-150, 4e-150], [-3e-150, -4e-150], [0.6, 0.8], [4.0, -3.0]]
    df = spark.createDataFrame([*enumerate(x)], "id long, embedding array<double>")
    assert {(r.a, r.b) for r in similar.pairs(df, 0.9, 2.0).collect()} == {(a, b) for a in (0, 1, 2, 4) for b in (0, 1, 2, 4) if a < b}


def test_vectors_without_an_id_have_no_pairs(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (None, [1.0, 0.0]), (3, [1.0, 0.1]), (None, [1.0, 0.1])], "id long, embedding array<double>")
    assert [(r.a, r.b) for r in similar.pairs(df, 0.9, 2.0).collect()] == [(1, 3)]
    assert [(r.anchor, r.n, r["first"], r["last"]) for r in similar.groups(df, 0.9).collect()] == [(1, 1, 3, 3)]
