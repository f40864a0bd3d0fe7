"""Tests of the findings of round 3 on training-data operators."""

import random

import numpy as np

from quillspark.llm import common, minhash


def _texts(spark):
    """Families of near copies, some of which share a beginning, and exact copies."""
    r = random.Random(4)
    word = lambda: "".join(r.choices("abcdefgh", k=5))
    texts = []
    for _ in range(12):
        base = [word() for _ in range(120)]
        for _ in range(6):
            copy = [*base]
            for at in r.sample(range(120), r.choice([0, 1, 2, 3])):
                copy[at] = word()
            texts.append(" ".join(copy))
    return spark.createDataFrame([*enumerate([*texts, texts[0], texts[7]])], "doc_id long, text string").coalesce(2)


def test_near_duplicates_are_the_same_with_few_and_many_links(spark, monkeypatch):
    df = _texts(spark)
    classes = lambda: {(r.doc_id, r.class_id, r["first"]) for r in minhash.near_duplicates(df).collect()}
    few = classes()
    monkeypatch.setattr(common, "FEW", 0)
    assert few == classes() and len({c for _, c, _ in few}) < len(few) / 2


def test_a_text_is_verified_with_many_at_once(monkeypatch):
    r = random.Random(3)
    rng = np.random.default_rng(3)
    base = np.unique(rng.integers(0, 2**63, 200, dtype=np.uint64))
    sets = []
    for _ in range(150):
        own = np.unique(np.concatenate([base[rng.random(len(base)) < 0.9], rng.integers(0, 2**63, r.randint(1, 20), dtype=np.uint64)]))
        sets.append((own, rng.random(len(own)) / 2 + 1))
    sets.append(sets[0])
    want = [[minhash.jaccard(x, y) >= 0.7 for y in sets] for x in sets]
    calls, plain = [], minhash.jaccard
    monkeypatch.setattr(minhash, "jaccard", lambda x, y: calls.append(1) or plain(x, y))
    shared, which = minhash.Shared(sets), np.arange(len(sets))
    assert [shared.reach(x, which, 0.7).tolist() for x in sets] == want
    assert 0 < sum(map(sum, want)) < len(sets) ** 2 and len(calls) < len(sets)
    assert [*minhash.runs([5, 5, 30, 1, 2], 10)] == [(0, 2), (2, 3), (3, 5)]
