"""Shortest paths of many pairs against a plain search."""

import random

from quillspark.operators.graph import paths_between


def plain(edges, start, end):
    """The least of the shortest paths, level by level."""
    level, seen = {start: [start]}, {start}
    while level:
        if end in level:
            return level[end]
        further = {}
        for path in level.values():
            for a, b in edges:
                if a == path[-1] and b not in seen:
                    further[b] = min(further.get(b, [float("inf")]), [*path, b])
        level, seen = further, seen | set(further)
    return None


def test_paths_of_pairs(spark):
    rng = random.Random(3)
    # A hub that a third of all edges leave, a random part, a long chain, and a part that nothing leads to.
    edges = {(0, i) for i in range(1, 40)} | {(rng.randrange(60), rng.randrange(60)) for _ in range(90)} | {(i, i + 1) for i in range(100, 109)} | {(59, 100), (200, 3)}
    pairs = {(rng.randrange(60), rng.randrange(60)) for _ in range(25)} | {(0, 109), (100, 109), (109, 100), (3, 200), (7, 7), (0, 999), (200, 109)}
    e = spark.createDataFrame([*edges, *list(edges)[:9], (None, 1), (1, None)], "src long, dst long").selectExpr("*", "1 AS id", "'x' AS path")
    p = spark.createDataFrame([*pairs, (7, 7), (None, 1), (1, None)], "start long, end long").selectExpr("*", "2 AS hops")
    found = {(r["start"], r["end"]): (r["hops"], list(r["path"])) for r in paths_between(e, p).collect()}
    want = {q: plain(edges, *q) for q in pairs}
    assert found == {q: (len(w) - 1, w) for q, w in want.items() if w}
    assert paths_between(e, p.limit(0)).isEmpty()
    assert sorted(tuple(r)[:3] for r in paths_between(e.limit(0), p).collect()) == sorted((a, b, 0) for a, b in pairs if a == b)
