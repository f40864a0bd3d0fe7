"""Ancestry of commits by parts of the history: logs, depths and merge bases without a bound on their length.

A commit has one parent or none; a parent that isn't in the table counts as
none. Commits are dealt into parts of bounded size by ranges of a column along
which parents lie near their commits (``near``: a time or a number; the id
where none is named). Each part walks its own ways in one task and tells for
every commit its top, the last ancestor that the way reaches within the part,
and its exit, the top's parent in another part. Exits are gates; the graph of
gates alone is walked by pointer doubling, log2 of its longest way equi-joins
of tables of its size. What lies between gates is told by the parts again. So
every commit is shuffled a fixed number of times, and the doubling goes over
the few commits whose parents lie in another part. Where ``near`` tells nothing
these are most commits, and the doubling is that of the whole history.

Chains of commits that lead back to themselves (no sound history has them)
have no root: they end a part's walk, and the doubling after as many levels as
n gates can need; their commits have no depth and no merge base.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.sources.stores import kept

#: Commits of a part; pairs, and ways, that a task takes with a part.
ROWS, PAIRS, WAYS = 200_000, 800_000, 16


def _ups(ids: pa.ChunkedArray, parents: pa.ChunkedArray) -> np.ndarray:
    """Each commit's parent as a position within the part, -1 where it isn't there."""
    return pc.fill_null(pc.index_in(parents, value_set=ids.combine_chunks(), skip_nulls=True), -1).to_numpy().astype(np.int64)


def _levels(ups: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Positions 2^k steps up for each k, or the top; the steps to the top; whether there is one."""
    at, steps = np.where(ups < 0, np.arange(len(ups)), ups), (ups >= 0).astype(np.int64)
    levels = [at]
    while 2 ** len(levels) <= len(ups) and steps[at].any():
        steps, at = steps + steps[at], at[at]
        levels.append(at)
    return levels, steps, ups[at] < 0


def _walked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a part's commits the top, the steps to it, its parent elsewhere (exit) and whether there is a top."""
    held = list(batches)
    rows = pa.Table.from_batches(held) if held else None
    if rows is None or not rows.num_rows:
        return
    levels, steps, rooted = _levels(_ups(rows["id"], rows["up"]))
    at = pa.array(levels[-1], mask=~rooted)
    part = pa.array(np.full(rows.num_rows, TaskContext.get().partitionId(), np.int32))
    out = pa.table({"id": rows["id"], "up": rows["up"], "part": part, "top": rows["id"].take(at), "exit": rows["up"].take(at), "steps": steps, "rooted": rooted})
    yield from out.to_batches(10_000)


def _ways(nodes: pa.Table, entries: pa.Table) -> pa.Table:
    """Of each entry (start, id, distance) the commits on its way within the part."""
    ups = _ups(nodes["id"], nodes["up"]).tolist()
    first = pc.index_in(entries["id"], value_set=nodes["id"].combine_chunks()).to_pylist()
    at, far, entry = [], [], []
    for i, (x, distance) in enumerate(zip(first, entries["distance"].to_pylist(), strict=True)):
        way, seen = [], set()
        while x >= 0 and x not in seen:
            way.append(x)
            seen.add(x)
            x = ups[x]
        at.append(np.array(way, np.int64))
        far.append(np.arange(distance, distance + len(way)))
        entry.append(np.full(len(way), i))
    return pa.table({"start": entries["start"].take(pa.array(np.concatenate(entry))), "id": nodes["id"].take(pa.array(np.concatenate(at))), "distance": np.concatenate(far)})


def _met(x: str, y: str) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Of pairs of a part's commits (columns x and y) the nearest common ancestor within the part; where there is none, the base that they had."""

    def met(nodes: pa.Table, pairs: pa.Table) -> pa.Table:
        ids = nodes["id"].combine_chunks()
        levels, steps, rooted = _levels(_ups(nodes["id"], nodes["up"]))
        a, b = (pc.index_in(pairs[c], value_set=ids).to_numpy().astype(np.int64) for c in (x, y))
        common = rooted[a] & rooted[b] & (levels[-1][a] == levels[-1][b])
        ahead = steps[a] - steps[b]
        for k, level in enumerate(levels):
            a, b = np.where((ahead > 0) & (ahead >> k & 1 == 1), level[a], a), np.where((ahead < 0) & (-ahead >> k & 1 == 1), level[b], b)
        for level in reversed(levels):
            apart = level[a] != level[b]
            a, b = np.where(apart, level[a], a), np.where(apart, level[b], b)
        found = ids.take(pa.array(np.where(a == b, a, levels[0][a]), mask=~common))
        return pa.table({"a": pairs["a"], "b": pairs["b"], "base": pc.coalesce(found, pairs["base"].combine_chunks())})

    return met


def _with_parts(nodes: DataFrame, rows: DataFrame, most: int, each: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``each`` part's commits with the rows of its number: a part with many of them goes to several tasks, each with ``most`` on the average, one without to none."""
    n = F.broadcast(rows.groupBy("part").agg(F.ceil(F.count("*") / most).cast("int").alias("slots")))  # a row a part
    ours = nodes.join(n, "part").select("part", F.explode(F.sequence(F.lit(0), F.col("slots") - 1)).alias("slot"), "id", "up")
    theirs = rows.join(n, "part").withColumn("slot", F.pmod(F.xxhash64(*rows.columns), "slots").cast("int")).drop("slots")
    return ours.groupBy("part", "slot").cogroup(theirs.groupBy("part", "slot")).applyInArrow(each, schema)


def _doubled(arrows: DataFrame) -> list[DataFrame]:
    """Levels (id, up, hops, steps) of a graph whose rows name one hop, or stay where they are with none: level k names what 2^k hops reach."""
    level = kept(arrows.select("id", "up", "hops", "steps"), "level")
    n, levels, moving = level.count(), [level], level.where("hops > 0")
    while 2 ** len(levels) <= n and not moving.isEmpty():
        above = level.select(F.col("id").alias("up"), F.col("up").alias("last"), F.col("hops").alias("more"), F.col("steps").alias("further"))
        level = kept(level.join(above, "up").select("id", F.col("last").alias("up"), (F.col("hops") + F.col("more")).alias("hops"), (F.col("steps") + F.col("further")).alias("steps"), (F.col("more") > 0).alias("moved")), "level")
        moving, level = level.where("moved"), level.drop("moved")
        levels.append(level)
    return levels


class Ancestry:
    """Commits (id, parent) in parts by ranges of ``near``, their gates, and the levels of the gates."""

    def __init__(self, commits: DataFrame, near: str | Column = "id", rows: int = ROWS):
        self.type = kind = commits.schema["id"].dataType.simpleString()
        edges = commits.withColumn("near", F.col(near) if isinstance(near, str) else near).groupBy("id").agg(F.min("parent").cast(kind).alias("up"), F.min("near").alias("near"))
        parts = max(1, -(-commits.count() // rows))
        dealt = edges.repartitionByRange(parts, "near", "id").select("id", "up")
        self.nodes = kept(dealt.mapInArrow(_walked, f"id {kind}, up {kind}, part int, top {kind}, exit {kind}, steps long, rooted boolean"), "nodes")
        exits = self.nodes.where("exit IS NOT NULL").select(F.col("exit").alias("id")).distinct()
        gates = kept(self.nodes.join(exits, "id").drop("up"), "gates")
        onward = gates.select(F.col("id").alias("exit"), F.lit(1).cast("long").alias("hops"))
        arrows = gates.join(onward, "exit", "left").select("id", "part", "top", "rooted", F.col("steps").alias("rest"), F.when(F.col("hops") == 1, F.col("exit")).otherwise(F.col("id")).alias("up"), F.coalesce("hops", F.lit(0)).alias("hops"), F.when(F.col("hops") == 1, F.col("steps") + 1).otherwise(0).alias("steps"))
        arrows = kept(arrows, "arrows")
        self.levels = _doubled(arrows)
        ends = arrows.where("hops = 0 AND rooted").select(F.col("id").alias("up"), F.col("top").alias("root"), "rest")
        told = self.levels[-1].select("id", "up", "steps").join(ends, "up", "left").select("id", "root", (F.col("steps") + F.col("rest")).alias("depth"))
        # id, part, and root and depth where a root ends the way.
        self.gates = kept(arrows.select("id", "part").join(told, "id"), "gates")
        loose = self.gates.where("depth IS NULL")
        self.loops = not loose.isEmpty() or not self.nodes.where("NOT rooted").isEmpty()
        if self.loops:
            lost = loose.select(F.col("id").alias("exit"), F.lit(True).alias("lost"))
            self.nodes = kept(self.nodes.join(lost, "exit", "left").withColumn("rooted", F.col("rooted") & F.col("lost").isNull()).drop("lost"), "nodes")

    def depths(self) -> DataFrame:
        """id, root and depth, the steps to the root; commits that no root ends have neither."""
        above = self.gates.select(F.col("id").alias("exit"), "root", "depth", F.lit(True).alias("known"))
        rows = self.nodes.join(above, "exit", "left")
        root = F.when(F.col("known").isNull(), F.col("top")).otherwise(F.col("root"))
        depth = F.when(F.col("known").isNull(), F.col("steps")).otherwise(F.col("steps") + 1 + F.col("depth"))
        return rows.select("id", F.when(F.col("rooted"), root).alias("root"), F.when(F.col("rooted"), depth).alias("depth"))

    def ancestors(self, starts: DataFrame) -> DataFrame:
        """start, id and distance of every commit on the way up from each start (start), itself first."""
        first = starts.select("start").distinct().join(self.nodes.withColumnRenamed("id", "start"), "start")
        first = kept(first.select("start", "part", "exit", "steps"), "starts")
        gates = self.gates.select("id", F.col("part").alias("place"))
        found = kept(first.join(gates.select(F.col("id").alias("exit")), "exit").select("start", F.col("exit").alias("id"), (F.col("steps") + 1).alias("distance")), "found")
        for k, level in enumerate(self.levels):
            # Whoever has taken all 2^k hops is new; the last gate's shorter way is known by then.
            further = found.join(level.where(F.col("hops") == 2**k), "id").select("start", F.col("up").alias("id"), (F.col("distance") + F.col("steps")).alias("distance"))
            found = kept(found.unionByName(further), "found")
        # A chain that leads back to itself names its gates again, at greater distances.
        found = found.groupBy("start", "id").agg(F.min("distance").alias("distance")).join(gates, "id").select("start", "id", F.col("place").alias("part"), "distance")
        entries = kept(first.select("start", F.col("start").alias("id"), "part", F.lit(0).cast("long").alias("distance")).unionByName(found), "entries")
        out = _with_parts(self.nodes, entries, WAYS, _ways, f"start {self.type}, id {self.type}, distance long")
        return out.groupBy("start", "id").agg(F.min("distance").alias("distance")) if self.loops else out

    def log(self, commits: DataFrame, start: str, limit: int | None = None, grep: str | None = None) -> DataFrame:
        """Commits from ``start`` along parents, nearest first, with their depth; the limit counts those whose message or id holds ``grep``."""
        ids = commits.sparkSession.createDataFrame([(start,)], "start string")
        out = self.ancestors(ids).select("id", F.col("distance").cast("int").alias("depth")).join(commits, "id")
        if grep:
            out = out.where(F.lower("message").contains(grep.lower()) | F.lower("id").contains(grep.lower()))
        return out.orderBy("depth") if limit is None else out.orderBy("depth").limit(limit)

    def _lifted(self, pairs: DataFrame, side: str, level: DataFrame, when) -> DataFrame:
        up = level.select(F.col("id").alias(side), F.col("up").alias(f"{side}_up"))
        return pairs.join(up, side, "left").withColumn(side, F.when(when, F.col(f"{side}_up")).otherwise(F.col(side))).drop(f"{side}_up")

    def merge_bases(self, pairs: DataFrame) -> DataFrame:
        """a, b and base, the nearest common ancestor (null: none, or a commit that isn't known) of every pair.

        Pairs that meet within their part are told by it; the others go on from gate to gate."""
        place = lambda side: self.nodes.where("rooted").select(F.col("id").alias(side), F.col("part").alias(f"{side}_part"))
        rows = pairs.select("a", "b").distinct().join(place("a"), "a", "left").join(place("b"), "b", "left")
        rows = kept(rows.withColumn("base", F.lit(None).cast(self.type)), "pairs")
        told = f"a {self.type}, b {self.type}, base {self.type}"
        within = rows.where("a_part = b_part").select("a", "b", "base", F.col("a_part").alias("part"))
        near = kept(_with_parts(self.nodes, within, PAIRS, _met("a", "b"), told), "met")
        unknown = rows.where("a_part IS NULL OR b_part IS NULL").select("a", "b", "base")
        far = kept(near.where("base IS NULL").unionByName(rows.where("a_part <> b_part").select("a", "b", "base")), "far")
        done = near.where("base IS NOT NULL").unionByName(unknown)
        return done if far.isEmpty() else done.unionByName(_with_gates(self, far.select("a", "b")))


def _with_gates(history: Ancestry, pairs: DataFrame) -> DataFrame:
    """Merge bases of pairs (a, b) that don't meet within one part: both sides go from gate to gate as far as they still differ; there a part tells where their ways meet, or else it is the next gate."""
    ends = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).unionByName(history.gates.select("id")).distinct()
    known = history.gates.select(F.col("id").alias("exit"), F.lit(1).cast("long").alias("hops"))
    graph = history.nodes.where("rooted").join(ends, "id").join(known, "exit", "left")
    graph = kept(graph.select("id", "part", F.when(F.col("hops") == 1, F.col("exit")).otherwise(F.col("id")).alias("up"), F.coalesce("hops", F.lit(0)).alias("hops"), F.lit(0).cast("long").alias("steps")), "graph")
    levels = _doubled(graph)
    hops = lambda side: levels[-1].select(F.col("id").alias(side), F.col("hops").alias(f"{side}_hops"))
    rows = pairs.withColumns({"x": F.col("a"), "y": F.col("b")}).join(hops("x"), "x").join(hops("y"), "y")
    rows = kept(rows.withColumn("ahead", F.col("x_hops") - F.col("y_hops")).drop("x_hops", "y_hops"), "pairs")
    # The one of more hops goes up to the other's number, by the binary digits of the difference.
    for k, level in enumerate(levels):
        bit = lambda v: (F.shiftright(v, k) % 2) == 1  # noqa: E731, B023
        rows = history._lifted(rows, "x", level, (F.col("ahead") > 0) & bit(F.col("ahead")))
        rows = history._lifted(rows, "y", level, (F.col("ahead") < 0) & bit(-F.col("ahead")))
        if k % 4 == 3:
            rows = kept(rows, "pairs")
    # Then both go up as far as they still differ.
    for k in reversed(range(len(levels))):
        ups = [levels[k].select(F.col("id").alias(s), F.col("up").alias(f"{s}_up")) for s in ("x", "y")]
        both = rows.join(ups[0], "x").join(ups[1], "y")
        apart = (F.col("x") != F.col("y")) & (F.col("x_up") != F.col("y_up"))
        rows = both.select("a", "b", *(F.when(apart, F.col(f"{s}_up")).otherwise(F.col(s)).alias(s) for s in ("x", "y")))
        if k % 4 == 0:
            rows = kept(rows, "pairs")
    place = [graph.select(F.col("id").alias(s), F.col("part").alias(f"{s}_part"), F.col("up").alias(f"{s}_up")) for s in ("x", "y")]
    base = F.when(F.col("x") == F.col("y"), F.col("x")).when(F.col("x_up") == F.col("y_up"), F.col("x_up"))
    rows = kept(rows.join(place[0], "x").join(place[1], "y").withColumn("base", base), "pairs")
    one = rows.where("x_part = y_part").select("a", "b", "x", "y", "base", F.col("x_part").alias("part"))
    within = _with_parts(history.nodes, one, PAIRS, _met("x", "y"), f"a {history.type}, b {history.type}, base {history.type}")
    return rows.where("x_part <> y_part").select("a", "b", "base").unionByName(within)


def committed(snapshots: DataFrame) -> DataFrame:
    """branch, seq, id and parent of the commits that a branch's snapshots (branch, seq, id) make in their order: what equals the branch's head is refused, the head is the parent of the next."""
    order = Window.partitionBy("branch").orderBy("seq")
    new = snapshots.withColumn("head", F.lag("id").over(order)).where(F.col("head").isNull() | (F.col("head") != F.col("id")))
    return new.select("branch", "seq", "id", F.col("head").alias("parent"))


def heads(commits: DataFrame) -> DataFrame:
    """branch and commit_id: each branch's newest commit."""
    return commits.groupBy("branch").agg(F.max_by("id", F.struct("seq", "id")).alias("commit_id"))


def resolved(targets: DataFrame, branches: DataFrame, commits: DataFrame, least: int = 4) -> DataFrame:
    """target and commit_id of every target: the branch of that name, else the only commit whose id begins so (``least`` characters or more)."""
    names = branches.select(F.col("branch").alias("target"), F.col("commit_id").alias("named"))
    short = targets.select("target").distinct().where(F.length("target") >= least).withColumn("key", F.left("target", F.lit(least)))
    ids = commits.select("id").distinct().withColumn("key", F.left("id", F.lit(least)))
    begun = short.join(ids, "key").where(F.startswith("id", F.col("target"))).groupBy("target").agg(F.min("id").alias("first"), F.count("*").alias("n"))
    rows = targets.select("target").distinct().join(names, "target", "left").join(begun, "target", "left")
    return rows.select("target", F.coalesce("named", F.when(F.col("n") == 1, F.col("first"))).alias("commit_id"))
