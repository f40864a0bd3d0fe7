"""Snapshots as stored trees of digests: a commit rewrites the changed paths only, and two snapshots differ below unequal nodes only.

A session's place is the hex sha256 of its id, and a node is a prefix of places:
a leaf where at most ``LEAF`` sessions lie below it, else a node of up to 16
children. What lies below a prefix decides alone where nodes end, so a tree, and
with it a commit's id, depends on the sessions and their hashes and never on the
order of edits. Nodes are named by digests of their contents, kept by depth in a
folder that is only added to, and shared by all snapshots that hold them.

Sessions without an id take no part; of a session that is given twice the
greatest hash counts. A snapshot without sessions is one empty leaf. Columns
other than session_id and hash aren't read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.stores import exists, kept

#: Sessions of a leaf at most.
LEAF = 64
ENTRY = "array<struct<session_id:string,hash:string>>"
CHILD = "array<struct<digit:string,digest:string,n:bigint>>"
NODE = f"digest string, prefix string, n bigint, entries {ENTRY}, children {CHILD}"
EMPTY = "leaf\n"


def _digest(kind: str, listed, line):
    return F.sha2(F.concat(F.lit(f"{kind}\n"), F.array_join(F.transform(listed, line), "\n")), 256)


def _leaves(rows: DataFrame) -> DataFrame:
    """Leaves of rows (at, session_id, hash)."""
    g = rows.groupBy(F.col("at").alias("prefix")).agg(F.array_sort(F.collect_list(F.struct("session_id", "hash"))).alias("entries"))
    digest = _digest("leaf", F.col("entries"), lambda x: F.concat_ws(":", x["session_id"], x["hash"]))
    return g.select(digest.alias("digest"), "prefix", F.size("entries").cast("long").alias("n"), "entries", F.array().cast(CHILD).alias("children"))


def _inner(parts: DataFrame) -> DataFrame:
    """Nodes of rows (prefix, digit, digest, n), one a child."""
    g = parts.groupBy("prefix").agg(F.array_sort(F.collect_list(F.struct("digit", "digest", "n"))).alias("children"), F.sum("n").alias("n"))
    digest = _digest("node", F.col("children"), lambda x: F.concat_ws(":", x["digit"], x["digest"]))
    return g.select(digest.alias("digest"), "prefix", "n", F.array().cast(ENTRY).alias("entries"), "children")


def _opened(nodes: DataFrame, *keep: str) -> DataFrame:
    """The children of nodes: prefix, digit, digest, n."""
    return nodes.select(*keep, "prefix", F.explode("children").alias("c")).select(*keep, "prefix", "c.digit", "c.digest", "c.n")


class Snapshots:
    """Trees of digests in one folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        #: Nodes that the latest commit wrote.
        self.written = 0

    def nodes(self, depth: int) -> DataFrame:
        place = f"{self.path}/depth={depth}"
        return self.spark.read.schema(NODE).parquet(place) if exists(self.spark, place) else self.spark.createDataFrame([], NODE)

    def _found(self, wanted: DataFrame, depth: int) -> DataFrame:
        """The stored nodes of a depth that ``wanted`` names by digest."""
        return self.nodes(depth).join(wanted.select("digest").distinct(), "digest", "left_semi").dropDuplicates(["digest"])

    def _write(self, nodes: DataFrame, depth: int) -> DataFrame:
        """Store what isn't there yet; a lost job leaves nodes that no snapshot names, and the next attempt finds them."""
        nodes = kept(nodes, "nodes")
        fresh = kept(nodes.join(self.nodes(depth).select("digest"), "digest", "left_anti"), "fresh")
        self.written += fresh.count()
        fresh.select("digest", "prefix", "n", "entries", "children").write.mode("append").parquet(f"{self.path}/depth={depth}")
        return nodes

    def _below(self, nodes: DataFrame, depth: int) -> DataFrame:
        """All entries below stored nodes (digest): session_id, hash."""
        out, wanted = None, nodes.select("digest")
        while not wanted.isEmpty():
            here = kept(self._found(wanted, depth), "below")
            entries = here.select(F.inline("entries"))
            out = entries if out is None else out.unionByName(entries)
            wanted, depth = _opened(here).select("digest"), depth + 1
        return self.spark.createDataFrame([], "session_id string, hash string") if out is None else out

    def _settled(self, rows: DataFrame) -> dict[int, DataFrame]:
        """Leaves by depth, of rows (at, place, session_id, hash): a prefix with more sessions than a leaf holds goes one digit further."""
        found: dict[int, list[DataFrame]] = {}
        while not rows.isEmpty():
            # One hot prefix is one count after partial aggregation, and its rows are the side of the join that AQE splits.
            counts = rows.groupBy("at").agg(F.count("*").alias("n"))
            rows = kept(rows.join(counts, "at"), "settling")
            leaves = kept(_leaves(rows.where(F.col("n") <= LEAF)), "leaves")
            for depth in [r[0] for r in leaves.select(F.length("prefix")).distinct().collect()]:
                found.setdefault(depth, []).append(leaves.where(F.length("prefix") == depth))
            further = F.substring("place", F.lit(1), F.length("at") + 1)
            rows = rows.where(F.col("n") > LEAF).select(further.alias("at"), "place", "session_id", "hash")
        out = {}
        for depth, parts in found.items():
            out[depth] = parts[0]
            for part in parts[1:]:
                out[depth] = out[depth].unionByName(part)
        return out

    def _climbed(self, leaves: dict[int, DataFrame], paths: dict[int, DataFrame], gone: dict[int, DataFrame]) -> str:
        """Write leaves, and the nodes above them up to the root; ``paths`` are the old nodes on the way by depth, ``gone`` prefixes without sessions. Returns the root's digest."""
        deepest = max([0, *leaves, *(d + 1 for d in paths), *gone])
        above = None
        for depth in range(deepest, -1, -1):
            new = leaves.get(depth)
            if above is not None:
                new = above if new is None else new.unionByName(above)
            if new is not None:
                new = self._write(new, depth)
            if depth == 0:
                break
            old = paths.get(depth - 1)
            parts = None if new is None else new.select(F.left("prefix", F.lit(depth - 1)).alias("prefix"), F.right("prefix", F.lit(1)).alias("digit"), "digest", "n")
            if old is not None:
                stay = _opened(old)
                for taken in (new, gone.get(depth)):
                    if taken is not None:
                        stay = stay.join(taken.select(F.left("prefix", F.lit(depth - 1)).alias("prefix"), F.right("prefix", F.lit(1)).alias("digit")), ["prefix", "digit"], "left_anti")
                parts = stay if parts is None else parts.unionByName(stay)
            above = None if parts is None else _inner(parts)
        root = None if new is None else new.select("digest").first()
        if root is None:
            empty = self.spark.range(1).select(F.sha2(F.lit(EMPTY), 256).alias("digest"), F.lit("").alias("prefix"), F.lit(0).cast("long").alias("n"), F.array().cast(ENTRY).alias("entries"), F.array().cast(CHILD).alias("children"))
            root = self._write(empty, 0).select("digest").first()
        return root["digest"]

    def commit(self, sessions: DataFrame) -> str:
        """Store the snapshot of (session_id, hash) as a whole; returns its root's digest, whose first 8 digits are the commit's id."""
        self.written = 0
        rows = sessions.where("session_id IS NOT NULL AND hash IS NOT NULL").groupBy("session_id").agg(F.max("hash").alias("hash"))
        rows = kept(rows.select(F.lit("").alias("at"), F.sha2("session_id", 256).alias("place"), "session_id", "hash"), "sessions")
        return self._climbed(self._settled(rows), {}, {})

    def amend(self, root: str, changes: DataFrame) -> str:
        """Store the snapshot that changes (session_id, hash; a null hash removes) make of a stored one; returns its root's digest.

        Only nodes on the way to a changed session are read and replaced, and
        the sessions below a node that falls to a leaf's size (as many at most).
        """
        self.written = 0
        left = changes.where("session_id IS NOT NULL").groupBy("session_id").agg(F.max("hash").alias("hash"))
        left = kept(left.select(F.lit(root).alias("digest"), F.lit("").alias("at"), F.sha2("session_id", 256).alias("place"), "session_id", "hash"), "changes")
        paths, stops, old, depth = {}, [], [], 0
        while not left.isEmpty():
            here = kept(self._found(left.where("digest IS NOT NULL"), depth), "path")
            if depth == 0 and here.isEmpty():
                raise ValueError(f"no snapshot {root} in {self.path}")
            ends = here.where(F.size("children") == 0)
            inner = kept(here.where(F.size("children") > 0), "path")
            stops.append(left.join(inner, "digest", "left_anti").select("at", "place", "session_id", "hash"))
            old.append(ends.select(F.col("prefix").alias("at"), F.inline("entries")))
            if inner.isEmpty():
                break
            paths[depth] = inner
            step = left.join(inner.select("digest"), "digest", "left_semi").select(F.left("place", F.lit(depth + 1)).alias("at"), "place", "session_id", "hash")
            left = kept(step.join(_opened(inner).select(F.concat("prefix", "digit").alias("at"), "digest"), "at", "left"), "changes")
            depth += 1
        if not stops:
            return root
        stop, before = stops[0], old[0]
        for a, b in zip(stops[1:], old[1:], strict=True):
            stop, before = stop.unionByName(a), before.unionByName(b)
        stop = kept(stop, "stops")
        both = before.select("session_id", F.col("at").alias("was"), F.col("hash").alias("old")).join(stop.withColumn("hit", F.lit(True)), "session_id", "full_outer")
        value = F.when(F.col("hit"), F.col("hash")).otherwise(F.col("old"))
        now = kept(both.select(F.coalesce("at", "was").alias("at"), F.coalesce("place", F.sha2("session_id", 256)).alias("place"), "session_id", value.alias("hash"), F.col("old").isNotNull().cast("long").alias("had")), "now")
        delta = kept(now.groupBy("at").agg(F.sum(F.col("hash").isNotNull().cast("long") - F.col("had")).alias("delta"), F.count("hash").alias("n")), "delta")
        # Nodes that fall to a leaf's size, the highest of a path only, take the sessions of all their children.
        fallen: dict[int, DataFrame] = {}
        for d in sorted(paths):
            under = delta.where(F.length("at") > d).groupBy(F.left("at", F.lit(d)).alias("prefix")).agg(F.sum("delta").alias("delta"))
            low = paths[d].join(under, "prefix").where(F.col("n") + F.col("delta") <= LEAF).drop("delta")
            inside = self._within(paths[d], fallen)
            low = kept(low.join(inside.select("prefix"), "prefix", "left_anti"), "fallen")
            paths[d] = kept(paths[d].join(inside.select("prefix"), "prefix", "left_anti").join(low.select("prefix"), "prefix", "left_anti"), "path")
            if not low.isEmpty():
                fallen[d] = low
        rows = now.select("at", "place", "session_id", "hash")
        for d, low in fallen.items():
            top = low.select(F.col("prefix").alias("top"))
            rows = rows.join(top, F.left("at", F.lit(d)) == F.col("top"), "left").withColumn("at", F.coalesce("top", "at")).drop("top")
            others = self._below(low, d).join(now.select("session_id"), "session_id", "left_anti").withColumn("place", F.sha2("session_id", 256))
            rows = rows.unionByName(others.select(F.left("place", F.lit(d)).alias("at"), "place", "session_id", "hash"))
        rows = kept(rows, "rows")
        empty = kept(rows.groupBy("at").agg(F.count("hash").alias("n")).where("n = 0").select(F.col("at").alias("prefix")), "gone")
        gone = {d: empty.where(F.length("prefix") == d) for d in [r[0] for r in empty.select(F.length("prefix")).distinct().collect()]}
        return self._climbed(self._settled(rows.where("hash IS NOT NULL")), {d: p for d, p in paths.items() if not p.isEmpty()}, gone)

    @staticmethod
    def _within(nodes: DataFrame, tops: dict[int, DataFrame]) -> DataFrame:
        """The nodes that lie below one of the tops."""
        out = nodes.limit(0)
        for d, top in tops.items():
            out = out.unionByName(nodes.join(top.select(F.col("prefix").alias("top")), F.left("prefix", F.lit(d)) == F.col("top"), "left_semi"))
        return out

    def sessions(self, root: str) -> DataFrame:
        """session_id and hash of a stored snapshot."""
        return self._below(self.spark.createDataFrame([(root,)], "digest string"), 0)

    def differences(self, a: str, b: str) -> DataFrame:
        """session_id, kind (added, removed, changed), old and new between two stored snapshots: equal nodes aren't opened."""
        pairs = self.spark.createDataFrame([(a, b)], "a string, b string").where("NOT a <=> b")
        sides, depth = {"a": [], "b": []}, 0
        self.visited = 0
        while not pairs.isEmpty():
            children = {}
            for side in ("a", "b"):
                here = kept(self._found(pairs.select(F.col(side).alias("digest")).where("digest IS NOT NULL"), depth), "side")
                self.visited += here.count()
                sides[side].append(here.select(F.inline("entries")))
                children[side] = _opened(here).select(F.concat("prefix", "digit").alias("at"), F.col("digest").alias(side))
            pairs = kept(children["a"].join(children["b"], "at", "full_outer").where("NOT a <=> b").select("a", "b"), "pairs")
            depth += 1
        none = self.spark.createDataFrame([], "session_id string, hash string")
        for side, parts in sides.items():
            sides[side] = none
            for part in parts:
                sides[side] = sides[side].unionByName(part)
        rows = sides["a"].withColumnRenamed("hash", "old").join(sides["b"].withColumnRenamed("hash", "new"), "session_id", "full_outer").where("NOT old <=> new")
        kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        return rows.select("session_id", kind.alias("kind"), "old", "new")
