"""Graph operators on edge tables: neighbourhoods, paths, hubs, strongly connected components.

Edges have src and dst, and are written to the shared folder once, however
often they are derived. Walks of a few hops are one plan; what runs until
nothing changes writes each round there as well.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.sources.stores import kept


def undirected(edges: DataFrame) -> DataFrame:
    e = edges.select("src", "dst")
    return e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def neighbours(edges: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(start, id, depth) within so many hops of each start, either direction, starts left out."""
    both = kept(undirected(edges), "edges")
    seen = starts.select(F.col("id").alias("start"), "id", F.lit(0).alias("depth"))
    frontier = seen
    for depth in range(1, hops + 1):
        step = frontier.join(both, F.col("id") == F.col("src")).select("start", F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("depth", F.lit(depth))
        seen = seen.unionByName(frontier)
    return seen.where("id <> start")


def distances(edges: DataFrame, start: int, most: int) -> DataFrame:
    """Directed hops from a node to all it reaches within ``most``."""
    spark = edges.sparkSession
    e = kept(edges.select("src", "dst").distinct(), "edges")
    seen = spark.range(1).select(F.lit(start).cast(e.schema["src"].dataType).alias("id"), F.lit(0).alias("hops"))
    frontier = seen
    for k in range(1, most + 1):
        step = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = step.join(seen.select("id"), "id", "left_anti").withColumn("hops", F.lit(k))
        seen = seen.unionByName(frontier)
    return seen


def hubs(nodes: DataFrame, edges: DataFrame, n: int) -> DataFrame:
    """In and out degree, parallel edges counted, the n largest sums."""
    edges = kept(edges.select("src", "dst"), "edges")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
    both = nodes.join(out, "id", "left").join(into, "id", "left").na.fill(0, ["out_degree", "in_degree"])
    return both.withColumn("degree", F.col("in_degree") + F.col("out_degree")).orderBy(F.desc("degree"), "id").limit(n)


def shortest_paths(nodes: DataFrame, edges: DataFrame, start: int, ends: list[int], most: int) -> DataFrame:
    """id, path and hops of every end that is reached: the names along a shortest directed path of ``most`` hops at most, of several the first by name. One search for all ends."""
    names = kept(nodes.select("id", "name"), "names")
    e = kept(edges.select("src", "dst").distinct().join(names.select(F.col("id").alias("dst"), "name"), "dst"), "steps")
    seen = names.where(F.col("id") == start).select("id", F.array("name").alias("path"))
    frontier = seen
    for _ in range(most):
        if seen.where(F.col("id").isin(ends)).count() >= len(set(ends)) or frontier.isEmpty():
            break
        step = frontier.join(e, F.col("id") == F.col("src")).select(F.col("dst").alias("id"), F.array_append("path", F.col("name")).alias("path"))
        frontier = kept(step.groupBy("id").agg(F.min("path").alias("path")).join(seen.select("id"), "id", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where(F.col("id").isin(ends)).select("id", "path", (F.size("path") - 1).alias("hops"))


def shortest_path(nodes: DataFrame, edges: DataFrame, start: int, end: int, most: int) -> DataFrame:
    """One row: the path to one end; none where there is no path."""
    return shortest_paths(nodes, edges, start, [end], most).select("path", "hops")


def paths_between(edges: DataFrame, pairs: DataFrame) -> DataFrame:
    """start, end, hops and path (ids) of a shortest directed path for every pair that has one; of several the least by ids.

    A search goes on from both ends of every pair at once. In a round each
    pair's smaller frontier takes a step, so a hub at one end is met from the
    other; a pair is done when its frontiers meet, or when one of them is
    empty, and leaves the tables. A row carries the least path from its end,
    and each round is written to the shared folder. Ends that are null or equal
    (no hops) or in no edge need no search; repeated pairs and edges count once.
    """
    e = kept(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").distinct(), "edges")
    asked = kept(pairs.select("start", "end").where("start IS NOT NULL AND end IS NOT NULL").distinct(), "asked")
    done = [asked.where("start = end").select("start", "end", F.array("start").alias("path"))]
    apart = asked.where("start <> end")
    ends = {"ahead": apart.select("start", "end", F.col("start").alias("id"), F.array("start").alias("path")), "back": apart.select("start", "end", F.col("end").alias("id"), F.array("end").alias("path"))}
    seen = {side: rows.select("start", "end", "id") for side, rows in ends.items()}
    pair = ["start", "end"]
    while True:
        sizes = [ends[side].groupBy(*pair).agg(F.count("*").alias(side)) for side in ends]
        turn = kept(sizes[0].join(sizes[1], pair).select(*pair, (F.col("ahead") <= F.col("back")).alias("ahead")), "turn")
        if turn.isEmpty():
            break
        stepped = {}
        for side, near, far in (("ahead", "src", "dst"), ("back", "dst", "src")):
            moving = ends[side].join(turn.where(F.col("ahead") == (side == "ahead")).select(*pair), pair, "left_semi")
            on = moving.join(e, F.col("id") == F.col(near))
            longer = F.array_append("path", F.col(far)) if side == "ahead" else F.array_prepend("path", F.col(far))
            new = on.select(*pair, F.col(far).alias("id"), longer.alias("path")).groupBy(*pair, "id").agg(F.min("path").alias("path"))
            stepped[side] = kept(new.join(seen[side], [*pair, "id"], "left_anti"), "stepped")
        for side in ends:
            waits = ends[side].join(turn.where(F.col("ahead") != (side == "ahead")).select(*pair), pair, "left_semi")
            ends[side] = kept(stepped[side].unionByName(waits), "ends")
        # Every node that both sides have seen lies on both frontiers: they met there for the first time.
        ahead, back = ends["ahead"], ends["back"].withColumnRenamed("path", "rest")
        whole = F.concat("path", F.slice("rest", F.lit(2), F.size("rest")))
        met = kept(ahead.join(back, [*pair, "id"]).groupBy(*pair).agg(F.min(whole).alias("path")), "met")
        done.append(met)
        for side in ends:
            ends[side] = kept(ends[side].join(met, pair, "left_anti"), "ends")
            seen[side] = kept(seen[side].unionByName(stepped[side].select(*pair, "id")).join(met, pair, "left_anti").join(turn, pair, "left_semi"), "seen")
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.select(*pair, (F.size("path") - 1).alias("hops"), "path")


def components(edges: DataFrame) -> DataFrame:
    """Strongly connected components of more than one node, each by its least id: id, component.

    Nodes without an edge in or out are put aside first. Then least ids pass
    along the edges until nothing changes, and what reaches such an id within
    the nodes that carry it is its component; the rest goes round again. There
    are many rounds: their joins are merged, as tables that each round
    broadcasts would all go through the driver.
    """
    left = kept(edges.select("src", "dst").where("src <> dst").distinct(), "edges")
    found = None
    while True:
        for _ in range(2):
            left = left.join(left.select(F.col("dst").alias("src")).distinct().hint("merge"), "src", "left_semi").join(left.select(F.col("src").alias("dst")).distinct().hint("merge"), "dst", "left_semi").select("src", "dst")
        left = kept(left, "edges")
        if left.isEmpty():
            break
        colours = left.select(F.col("src").alias("id")).union(left.select("dst")).distinct().withColumn("colour", F.col("id"))
        while True:
            new = colours
            for _ in range(3):
                passed = new.join(left.hint("merge"), F.col("id") == F.col("src")).select(F.col("dst").alias("id"), "colour")
                new = new.unionByName(passed).groupBy("id").agg(F.min("colour").alias("colour"))
            new = kept(new, "colours")
            same = new.join(colours.hint("merge"), ["id", "colour"], "left_anti").isEmpty()
            colours = new
            if same:
                break
        within = left.join(colours.select(F.col("id").alias("src"), "colour").hint("merge"), "src").join(colours.select(F.col("id").alias("dst"), "colour").hint("merge"), ["dst", "colour"]).select("src", "dst", "colour")
        within = kept(within, "within")
        reach, size = colours.where("id = colour"), 0
        while True:
            for _ in range(3):
                back = reach.join(within.select("src", "dst", F.col("colour").alias("of")).hint("merge"), (F.col("id") == F.col("dst")) & (F.col("colour") == F.col("of"))).select(F.col("src").alias("id"), "colour")
                reach = reach.unionByName(back).distinct()
            reach = kept(reach, "reach")
            now = reach.count()
            if now == size:
                break
            size = now
        found = reach if found is None else found.unionByName(reach)
        left = left.join(reach.select(F.col("id").alias("src")).hint("merge"), "src", "left_anti").join(reach.select(F.col("id").alias("dst")).hint("merge"), "dst", "left_anti").select("src", "dst")
    if found is None:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    several = found.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1").select("colour")
    return found.join(several.hint("merge"), "colour", "left_semi").select("id", F.col("colour").alias("component"))


def valid_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges both of whose ends exist."""
    ids = nodes.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")


def dot_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges as lines of a DOT file; style by strength."""
    names = nodes.select("id", "name")
    style = F.when(F.col("strength") > 0.7, "bold").when(F.col("strength") > 0.4, "solid").otherwise("dashed")
    named = edges.join(names.select(F.col("id").alias("src"), F.col("name").alias("a")), "src").join(names.select(F.col("id").alias("dst"), F.col("name").alias("b")), "dst")
    return named.select(F.format_string('"%s" -> "%s" [label="%s", style=%s];', "a", "b", "rel_type", style).alias("line"))


def boosted(nodes: DataFrame, boosts: DataFrame) -> DataFrame:
    """Importance plus a learned boost, held in [0.1, 1]."""
    value = F.least(F.greatest(F.col("importance") + F.coalesce("boost", F.lit(0.0)), F.lit(0.1)), F.lit(1.0))
    return nodes.join(boosts, "id", "left").withColumn("importance", value).drop("boost")
