"""Queries of the concept graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import graph as G
from quillspark.plans.catalog import register
from quillspark.sources.views import graph_edges, graph_nodes, oracle, part_edges, table


@register("graph_bfs", oracle("""WITH RECURSIVE und AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges), walk AS (SELECT 3 AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN und ON src = id WHERE depth < 2)
  SELECT id, CAST(min(depth) AS INT) AS depth FROM walk WHERE id <> 3 GROUP BY id"""))
def graph_bfs(spark, d):
    starts = graph_nodes(spark, d).where("id = 3").select("id")
    return G.neighbours(graph_edges(spark, d), starts, 2).select("id", "depth")


@register("graph_path_len", oracle("WITH RECURSIVE walk AS (SELECT 0 AS id, 0 AS hops UNION SELECT dst, hops + 1 FROM walk JOIN graph_edges ON src = id WHERE hops < 5) SELECT CAST(id AS INT) AS id, CAST(min(hops) AS INT) AS hops FROM walk GROUP BY id"))
def graph_path_len(spark, d):
    return G.distances(graph_edges(spark, d), 0, 5)


@register("graph_hubs", oracle("SELECT id, name, COALESCE(i, 0) AS in_degree, COALESCE(o, 0) AS out_degree, COALESCE(i, 0) + COALESCE(o, 0) AS degree FROM graph_nodes LEFT JOIN (SELECT src AS id, count(*) AS o FROM graph_edges GROUP BY 1) USING (id) LEFT JOIN (SELECT dst AS id, count(*) AS i FROM graph_edges GROUP BY 1) USING (id) ORDER BY degree DESC, id LIMIT 10"))
def graph_hubs(spark, d):
    return G.hubs(graph_nodes(spark, d), graph_edges(spark, d), 10).select("id", "name", "in_degree", "out_degree", "degree")


@register("graph_scc", oracle("""WITH RECURSIVE reach AS (SELECT src, dst FROM graph_edges UNION SELECT r.src, e.dst FROM reach r JOIN graph_edges e ON r.dst = e.src)
  SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"""))
def graph_scc(spark, d):
    return G.components(graph_edges(spark, d))


@register("graph_shortest_path", oracle("""WITH RECURSIVE p AS (SELECT 0 AS id, [(SELECT name FROM graph_nodes WHERE id = 0)] AS path, 0 AS hops UNION ALL SELECT n.id, list_append(path, n.name), hops + 1 FROM p JOIN graph_edges e ON e.src = p.id JOIN graph_nodes n ON n.id = e.dst WHERE hops < 8 AND NOT list_contains(path, n.name)),
  f AS (SELECT t AS target, path, hops, row_number() OVER (PARTITION BY t ORDER BY hops, path) AS nth FROM p JOIN range(1, 6) r(t) ON p.id = t) SELECT target, array_to_string(path, ' > ') AS path, CAST(hops AS INT) AS hops FROM f WHERE nth = 1"""))
def graph_shortest_path(spark, d):
    """The names along the shortest ways from one node to five others."""
    found = G.shortest_paths(graph_nodes(spark, d), graph_edges(spark, d), 0, [1, 2, 3, 4, 5], 8)
    return found.select(F.col("id").cast("long").alias("target"), F.array_join("path", " > ").alias("path"), "hops")


@register("graph_edges_valid", oracle("SELECT src, dst, rel_type FROM (SELECT src, dst, rel_type FROM graph_edges UNION ALL SELECT 99, 1, 'dangling' UNION ALL SELECT 1, 99, 'dangling') WHERE src IN (SELECT id FROM graph_nodes) AND dst IN (SELECT id FROM graph_nodes)"))
def graph_edges_valid(spark, d):
    e = graph_edges(spark, d).select("src", "dst", "rel_type")
    dangling = spark.createDataFrame([(99, 1, "dangling"), (1, 99, "dangling")], e.schema)
    return G.valid_edges(graph_nodes(spark, d), e.unionByName(dangling))


@register("graph_dot_lines", oracle("""SELECT '"' || a.name || '" -> "' || b.name || '" [label="' || rel_type || '", style=' || CASE WHEN strength > 0.7 THEN 'bold' WHEN strength > 0.4 THEN 'solid' ELSE 'dashed' END || '];' AS line FROM graph_edges JOIN graph_nodes a ON a.id = src JOIN graph_nodes b ON b.id = dst"""))
def graph_dot_lines(spark, d):
    return G.dot_lines(graph_nodes(spark, d), graph_edges(spark, d))


@register("graph_by_category", oracle("SELECT category, count(*) AS n, string_agg(name, ',' ORDER BY id) AS names FROM graph_nodes GROUP BY 1"))
def graph_by_category(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "name"))), lambda x: x["name"]), ",")
    return graph_nodes(spark, d).groupBy("category").agg(F.count("*").alias("n"), listed.alias("names"))


@register("graph_by_type", oracle("SELECT src, dst FROM graph_edges WHERE rel_type = 'depends_on'"))
def graph_by_type(spark, d):
    return graph_edges(spark, d).where("rel_type = 'depends_on'").select("src", "dst")


@register("graph_boosts", oracle("SELECT id, round(least(greatest(importance + CASE WHEN id % 2 = 0 THEN 0.3e0 ELSE 0 END, 0.1e0), 1.0e0), 6) AS importance FROM graph_nodes"))
def graph_boosts(spark, d):
    n = graph_nodes(spark, d)
    return G.boosted(n, n.where("id % 2 = 0").select("id", F.lit(0.3).alias("boost"))).select("id", F.round("importance", 6).alias("importance"))


@register("part_paths", oracle("""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM part_edges), pairs AS (SELECT min(p_partkey) AS a, max(p_partkey) AS b FROM part GROUP BY p_brand),
  back AS (SELECT DISTINCT b, b AS id, 0 AS hops FROM pairs UNION SELECT b, src, hops + 1 FROM back JOIN e ON dst = id WHERE hops < 20),
  dist AS MATERIALIZED (SELECT b, id, min(hops) AS hops FROM back GROUP BY 1, 2),
  nxt AS MATERIALIZED (SELECT x.b, x.id, min(e.dst) AS n FROM dist x JOIN e ON e.src = x.id JOIN dist y ON y.b = x.b AND y.id = e.dst AND y.hops = x.hops - 1 GROUP BY 1, 2),
  go AS (SELECT a, b, a AS id, [a] AS path FROM pairs UNION ALL SELECT a, go.b, n, list_append(path, n) FROM go JOIN nxt ON nxt.b = go.b AND nxt.id = go.id WHERE go.id <> go.b)
  SELECT a AS start, b AS "end", CAST(len(path) - 1 AS INT) AS hops, array_to_string(path, ' > ') AS path FROM go WHERE id = b"""))
def part_paths(spark, d):
    """Shortest ways in the graph of parts, from each brand's first part to its last."""
    pairs = table(spark, d, "part").groupBy("p_brand").agg(F.min("p_partkey").alias("start"), F.max("p_partkey").alias("end"))
    return G.paths_between(part_edges(spark, d), pairs).withColumn("path", F.array_join("path", " > "))


@register("part_components", oracle("""WITH RECURSIVE e AS MATERIALIZED (SELECT src, dst FROM part_edges WHERE rank <= 2), reach AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM reach r JOIN e ON r.dst = e.src)
  SELECT a.src AS id, least(a.src, min(a.dst)) AS component FROM reach a JOIN reach b ON a.src = b.dst AND a.dst = b.src WHERE a.src <> a.dst GROUP BY a.src"""))
def part_components(spark, d):
    """Strongly connected parts by their two most frequent next parts."""
    return G.components(part_edges(spark, d).where("rank <= 2"))
