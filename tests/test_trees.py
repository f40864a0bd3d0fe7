"""Trees of digests: the same id whatever the way to it, and work that follows the changes."""

import random

import pytest

from quillspark.operators.trees import EMPTY, LEAF, Snapshots


def rows(spark, held):
    return spark.createDataFrame(list(held.items()), "session_id string, hash string")


def test_edits_lead_to_the_tree_of_their_result(spark, tmp_path):
    rng = random.Random(5)
    store = Snapshots(spark, str(tmp_path / "trees"))
    held = {f"s{i}": f"{rng.getrandbits(64):016x}" for i in range(700)}
    root = store.commit(rows(spark, held))
    assert root == store.commit(rows(spark, dict(reversed(held.items())))) and store.written == 0
    # Changes and additions; then removals that make inner nodes leaves again; then all gone.
    steps = [{**{k: "changed" for k in rng.sample(sorted(held), 5)}, **{f"n{i}": "new" for i in range(400)}}, {k: None for k in sorted(held)[:650]}, {"absent": None}]
    for step in steps:
        before, root = root, store.amend(root, rows(spark, step))
        wrote, then = store.written, dict(held)
        for key, value in step.items():
            held.pop(key, None) if value is None else held.__setitem__(key, value)
        assert store.commit(rows(spark, held)) == root
        assert store.written == 0, "an edit stores the same nodes as a tree built at once"
        found = {r["session_id"]: (r["kind"], r["old"], r["new"]) for r in store.differences(before, root).collect()}
        kind = lambda k: "added" if k not in then else "removed" if k not in held else "changed"
        assert found == {k: (kind(k), then.get(k), held.get(k)) for k in {*then, *held} if then.get(k) != held.get(k)}
        assert wrote > 0 or step == steps[-1]
    assert {r["session_id"]: r["hash"] for r in store.sessions(root).collect()} == held
    assert len(held) > LEAF
    root = store.amend(root, rows(spark, dict.fromkeys(held)))
    assert store.sessions(root).isEmpty()
    assert root == store.commit(rows(spark, {})) and root == __import__("hashlib").sha256(EMPTY.encode()).hexdigest()
    assert store.amend(root, rows(spark, {"one": "x"})) == store.commit(rows(spark, {"one": "x"}))


def test_one_change_reads_and_writes_one_path(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "trees"))
    ids = spark.range(20_000).selectExpr("concat('s', id) AS session_id", "sha2(cast(id AS string), 256) AS hash")
    root = store.commit(ids)
    whole = store.written
    changed = store.amend(root, rows(spark, {"s77": "new"}))
    assert whole > 500 and store.written <= 5
    assert [tuple(r)[:2] for r in store.differences(root, changed).collect()] == [("s77", "changed")]
    assert store.visited <= 10


def test_odd_sessions_of_a_tree(spark, tmp_path):
    store = Snapshots(spark, str(tmp_path / "trees"))
    odd = spark.createDataFrame([(None, "x", 1), ("a", None, 2), ("b", "1", 3), ("b", "2", 4), ("", "3", 5)], "session_id string, hash string, digest int")
    root = store.commit(odd)
    assert {r["session_id"]: r["hash"] for r in store.sessions(root).collect()} == {"b": "2", "": "3"}
    assert store.amend(root, odd.limit(0)) == root
    with pytest.raises(ValueError):
        store.amend("0" * 64, odd)
