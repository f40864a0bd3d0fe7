"""Best alignments against all embeddings of a pattern, and the bound that spares alignments."""

import random
from itertools import combinations

from pyspark.sql import functions as F

from quillspark.operators.fuzzy import BONUS, EACH, MORE, OPEN, _bound, fuzzy_best, fuzzy_top


def plain(name, pattern):
    name, pattern, best = name.lower(), pattern.lower(), None
    for places in combinations(range(len(name)), len(pattern)):
        if "".join(name[i] for i in places) != pattern:
            continue
        score = sum(EACH + (BONUS if i == 0 or not name[i - 1].isalnum() else 0) for i in places)
        score += sum(BONUS if b == a + 1 else -OPEN - MORE * (b - a - 2) for a, b in zip(places, places[1:]))
        best = score if best is None or score > best else best
    return best


def test_best_alignment_equals_all_embeddings(spark):
    rng = random.Random(11)
    names = ["".join(rng.choice("aAbc-é😀 ") for _ in range(rng.randrange(14))) for _ in range(150)] + ["", "a\nb c", "xaxbxc abc", "aabbcc", None]
    rows = spark.createDataFrame([(i, n, "clash") for i, n in enumerate(names)], "id long, name string, score string")
    for pattern in ("a", "abc", "AB", "bé", "a😀", "-a", "aaa"):
        want = {i: s for i, n in enumerate(names) if n is not None and (s := plain(n, pattern)) is not None}
        assert {r["id"]: r["score"] for r in fuzzy_best(rows, "name", pattern).collect()} == want
        bounds = {r["id"]: r["b"] for r in rows.select("id", _bound(F.lower("name"), pattern.lower()).alias("b")).collect()}
        assert all(bounds[i] >= s for i, s in want.items())
        for k in (1, 7, 500):
            top = [(r["score"], r["id"]) for r in fuzzy_top(rows, "name", pattern, k, "id").collect()]
            assert top == sorted(((s, i) for i, s in want.items()), key=lambda x: (-x[0], x[1]))[:k]
    assert fuzzy_best(rows, "name", "").count() == len(names) - 1
    assert fuzzy_top(rows.limit(0), "name", "ab", 3, "id").isEmpty()


def test_long_names_and_few_alignments(spark):
    rng = random.Random(2)
    long = spark.createDataFrame([(1, "a" * 100_000 + "x" * 50 + "b"), (2, "ab")], "id long, name string")
    assert {r["id"]: r["score"] for r in fuzzy_best(long, "name", "ab").collect()} == {1: 2 * EACH - OPEN - MORE * 49, 2: 2 * EACH + 2 * BONUS}
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(words)), "id long, name string")
    threshold = fuzzy_top(rows, "name", "abc", 5, "id").agg(F.min("score")).first()[0]
    could = rows.where(F.col("name").rlike("a.*b.*c")).withColumn("b", _bound(F.col("name"), "abc"))
    assert could.where(F.col("b") >= threshold).count() < 0.5 * could.count()
