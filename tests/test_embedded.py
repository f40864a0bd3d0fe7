"""The kept embedding index: what is embedded, found and left after additions, removals, two writers and compaction."""

import uuid
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.operators.embedded import Embedded
from quillspark.operators.providers import hashing_embedder
from quillspark.operators.questions import dense


@pytest.fixture
def index(spark, tmp_path):
    return Embedded(spark, f"{tmp_path}/{uuid.uuid4().hex}")


def texts(spark, rows):
    return spark.createDataFrame(rows, "id long, text string")


def held(index):
    return {r["id"]: r["embedding"] for r in index.read().collect()}


def same(index, expected):
    got = held(index)
    assert got.keys() == expected.keys()
    for k, t in expected.items():
        assert np.allclose(got[k], hashing_embedder([t])[0])


def told(index, part):
    r = index.history().where(F.col("part") == part).first()
    return r["put"], r["removed"], r["embedded"]


def test_only_changed_texts_are_embedded(spark, index):
    rows = {i: f"word{i % 7} common" for i in range(40)} | {40: "", 41: "a " * 50_000}
    calls = spark.sparkContext.accumulator(0)

    def counting(batch):
        calls.add(len(batch))
        return hashing_embedder(batch)

    index.provider = counting
    part = index.sync(texts(spark, [*rows.items()]))
    assert told(index, part) == (42, 0, 9) and calls.value == 9
    same(index, rows)
    part = index.sync(texts(spark, [*rows.items()]))
    assert told(index, part) == (0, 0, 0) and calls.value == 9
    changed = {i: ("other" if i == 3 else "word0 common" if i == 5 else t) for i, t in rows.items() if i >= 2}
    part = index.sync(texts(spark, [*changed.items()]))
    assert told(index, part) == (2, 2, 1) and calls.value == 10
    same(index, changed)
    # A text that comes back costs nothing.
    index.put(texts(spark, [(0, rows[0])]))
    assert calls.value == 10
    same(index, changed | {0: rows[0]})


def test_nulls_repeats_and_removals(spark, index):
    same(index, {})
    index.put(texts(spark, []))
    same(index, {})
    wide = spark.createDataFrame([(1, "one", "x", 0), (1, "one", "y", 0), (None, "lost", "z", 0), (2, None, "u", 0), (3, "three", "v", 0)], "id long, text string, digest string, version int")
    index.put(wide)
    same(index, {1: "one", 3: "three"})
    index.put(texts(spark, [(3, None), (4, "four")]))
    same(index, {1: "one", 4: "four"})
    part = index.remove(texts(spark, [(1, ""), (9, "")]))
    same(index, {4: "four"})
    assert told(index, part) == (0, 1, 0)


def test_two_writers_lose_no_rows(spark, index):
    index.put(texts(spark, [(1, "one"), (2, "two")]))
    a, b = (Embedded(spark, index.path) for _ in range(2))
    version = index._next()
    a._next = b._next = lambda: version  # both have read the store before either writes
    a.put(texts(spark, [(2, "second"), (3, "shared text")]))
    b.put(texts(spark, [(4, "shared text")]))
    same(index, {1: "one", 2: "second", 3: "shared text", 4: "shared text"})
    index.compact()
    same(index, {1: "one", 2: "second", 3: "shared text", 4: "shared text"})


def test_a_part_that_is_not_whole_is_not_read(spark, index):
    part = index.put(texts(spark, [(1, "one")]))
    other = index.put(texts(spark, [(1, "changed")]))
    (Path(index.path) / "deltas" / other / "_SUCCESS").unlink()
    same(index, {1: "one"})
    assert index.parts() == [part]


def test_compaction_keeps_what_is_read(spark, index):
    index.put(texts(spark, [(i, f"t{i % 5}") for i in range(20)]))
    index.put(texts(spark, [(0, "new"), (1, None)]))
    index.remove(texts(spark, [(2, "")]))
    expected = {i: f"t{i % 5}" for i in range(3, 20)} | {0: "new"}
    index.compact()
    assert len(index.parts()) == 1
    same(index, expected)
    part = index.put(texts(spark, [(2, "t3"), (30, "t4")]))
    assert told(index, part) == (2, 0, 0)
    index.compact()
    same(index, expected | {2: "t3", 30: "t4"})


def test_an_addition_during_compaction_stays(spark, index):
    index.put(texts(spark, [(1, "one"), (2, "two")]))
    index.compact()

    class Met(Embedded):
        def _cover(self, part, parts):
            whole = Path(self.path) / "vectors" / part / "_SUCCESS"
            whole.unlink()  # the other writer looks before the new vectors are there
            Embedded(spark, self.path).put(texts(spark, [(3, "one"), (1, "two")]))
            whole.touch()
            super()._cover(part, parts)

    Met(spark, index.path).compact()
    expected = {1: "two", 2: "two", 3: "one"}
    same(index, expected)
    for _ in range(3):
        index.compact()
        same(index, expected)
    assert len(list((Path(index.path) / "vectors").iterdir())) == 2


def test_search_over_the_index_equals_brute_force(spark, index):
    words = ["red", "green", "blue", "stone", "river"]
    rows = {i: " ".join(words[(i * k) % 5] for k in range(1, 4)) + f" n{i}" for i in range(60)}
    index.put(texts(spark, [*rows.items()]))
    index.remove(texts(spark, [(0, ""), (7, "")]))
    q = hashing_embedder(["red stone n7", "blue river n11"])
    asked = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(q)], "qid long, vector array<double>")
    got = {}
    for r in dense(index.read(), asked, 5).collect():
        got.setdefault(r["qid"], []).append((-r["score"], r["id"]))
    ids = [i for i in rows if i not in (0, 7)]
    x = hashing_embedder([rows[i] for i in ids])
    for i, v in enumerate(q):
        want = sorted((-round(float(c), 9), k) for c, k in zip(x @ v, ids, strict=True))[:5]
        assert [k for _, k in sorted(got[i])] == [k for _, k in want]
