"""Queries of the composite operators and of what is left of lookups, commits and rewards."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assistant as A
from quillspark.operators import quality as Q
from quillspark.operators import retrieval as R
from quillspark.operators import history as H
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import EXPIRED
from quillspark.plans.quality import _FIGURES, _ISSUES
from quillspark.plans.retrieval import _SCORED
from quillspark.plans.sessions import _CUT
from quillspark.sources.views import CATEGORIES, blocks, chunks, commits, graph_edges, now, oracle, query_vector, table, tool_uses, turns


@register("session_chunks", oracle(f"SELECT session_id, 0 AS part, substr(sha256(content), 1, 16) AS id FROM blocks WHERE NOT {EXPIRED} AND trim(content, ' ') <> '' AND strlen(content) <= 1200 UNION ALL SELECT session_id, 0, substr(sha256(content), 1, 16) FROM blocks WHERE NOT {EXPIRED} AND strlen(content) > 1200"))
def session_chunks(spark, d):
    """The tables' texts hold no empty lines, so a longer one is one paragraph that stays whole."""
    return A.index_chunks(blocks(spark, d), now()).select("session_id", "part", "id")


@register("line_lookup", oracle("SELECT session_id, line FROM (SELECT session_id, unnest(string_split(content, chr(10))) AS line FROM blocks WHERE category IN ('decisions', 'solutions', 'patterns')) WHERE contains(lower(line), 'rights')"))
def line_lookup(spark, d):
    rows = blocks(spark, d).where(F.col("category").isin("decisions", "solutions", "patterns"))
    return rows.select("session_id", F.explode(F.filter(T.lines("content"), lambda v: F.lower(v).contains("rights"))).alias("line"))


@register("issues_by_severity", oracle(f"WITH {_FIGURES}, {_ISSUES} SELECT severity, count(*) AS n, count(DISTINCT project) AS projects FROM i GROUP BY 1"))
def issues_by_severity(spark, d):
    return Q.issues(Q.project_figures(blocks(spark, d), now())).groupBy("severity").agg(F.count("*").alias("n"), F.countDistinct("project").alias("projects"))


@register("tool_observations", oracle("SELECT session_id, pos, tool, CASE WHEN tool = 'Bash' THEN input ELSE 'f' || pos END AS target FROM tool_uses WHERE tool IN ('Bash', 'Edit')"))
def tool_observations(spark, d):
    data = F.when(F.col("tool") == "Bash", F.to_json(F.struct(F.col("input").alias("command")))).otherwise(F.to_json(F.struct(F.concat(F.lit("f"), F.col("pos").cast("string")).alias("file_path"))))
    return A.tool_observations(tool_uses(spark, d).withColumn("input", data)).select("session_id", "pos", "tool", "target")


@register("tool_inputs", oracle(f"SELECT session_id, pos, CASE WHEN pos % 5 = 0 THEN CASE WHEN strlen(text) <= 200 THEN text ELSE {_CUT.format(c='text', m=201, n=200)} || '...' END WHEN pos % 5 < 4 THEN 'p' || pos ELSE '' END AS summary FROM turns"))
def tool_inputs(spark, d):
    k = F.col("pos") % 5
    tool = F.when(k == 0, "Bash").when(k == 1, "Read").when(k == 2, "Grep").when(k == 3, "WebFetch").otherwise("Task")
    path = F.concat(F.lit("p"), F.col("pos").cast("string"))
    data = F.to_json(F.struct(F.when(k == 0, F.col("text")).alias("command"), F.when(k == 1, path).alias("file_path"), F.when(k == 2, path).alias("pattern"), F.when(k == 3, path).alias("url")))
    return turns(spark, d).select("session_id", "pos", T.tool_summary(tool, data).alias("summary"))


@register("clean_extraction", oracle("SELECT pos, CASE WHEN pos % 4 = 0 THEN NULL WHEN pos % 4 = 1 THEN NULL WHEN pos % 4 = 2 THEN 'Body ' || pos ELSE 'No more tests: run them ' || pos || ' times over, each of them' || chr(10) || 'x' END AS text FROM blocks"))
def clean_extraction(spark, d):
    k, n = F.col("pos") % 4, F.col("pos").cast("string")
    raw = F.when(k == 0, "  \n ").when(k == 1, "No decisions were found.").when(k == 2, F.concat(F.lit("UPDATE s1\nBody "), n, F.lit("\n"))).otherwise(F.concat(F.lit("No more tests: run them "), n, F.lit(" times over, each of them\nx")))
    return blocks(spark, d).select("pos", T.clean_extraction(raw).alias("text"))


@register("infer_category", oracle("SELECT pos, CASE pos % 3 WHEN 0 THEN 'bugs' WHEN 1 THEN 'patterns' END AS category FROM blocks"))
def infer_category(spark, d):
    k = F.col("pos") % 3
    sid = F.when(k == 0, F.concat("session_id", F.lit(":bugs"))).otherwise(F.concat("session_id", F.lit(":other")))
    return blocks(spark, d).select("pos", T.infer_category(sid, F.when(k == 1, "x\n - Category: Patterns").otherwise("none"), CATEGORIES).alias("category"))


@register("recursive_ask", oracle(f"SELECT session_id, category FROM blocks WHERE NOT {EXPIRED} AND session_id IN (SELECT min(session_id) FROM (SELECT session_id FROM blocks WHERE NOT {EXPIRED} ORDER BY ts_raw DESC, session_id LIMIT 200))"))
def recursive_ask(spark, d):
    """The default chooser takes the first entry of the index it is shown."""
    first = lambda entries: entries.split("]")[0].lstrip("[")
    return A.recursive_ask(blocks(spark, d), now(), first, CATEGORIES).select("session_id", "category")


@register("hybrid_ask", oracle(f"WITH {_SCORED}, f AS (SELECT session_id FROM scored ORDER BY score DESC, id LIMIT 10) SELECT session_id FROM (SELECT 's1' AS session_id UNION ALL SELECT 's2') UNION ALL SELECT session_id FROM f WHERE session_id NOT IN ('s1', 's2')"))
def hybrid_ask(spark, d):
    c = chunks(spark, d)
    found = R.dense(c, query_vector(spark, d), 10).join(c.select("id", "session_id"), "id")
    return A.hybrid_ask(spark.createDataFrame([("s1",), ("s2",)], "session_id string"), found)


@register("recall", oracle(f"SELECT project, 0 AS at, 'context of ' || project AS text FROM blocks WHERE project < 'src2' GROUP BY 1 UNION ALL SELECT project, pos, content FROM blocks WHERE NOT {EXPIRED} AND project >= 'src2'".replace(" AS at,", ' AS "at",')))
def recall(spark, d):
    b = blocks(spark, d)
    contexts = b.select("project").distinct().select("project", F.when(F.col("project") < "src2", F.concat(F.lit("context of "), "project")).alias("context"))
    return A.recall(contexts, b, now())


@register("resolve_updates", oracle("""SELECT session_id, content FROM (SELECT session_id, content, pos FROM blocks) WHERE pos % 10 NOT IN (2, 3) UNION ALL SELECT session_id, 'merged' FROM blocks WHERE pos % 10 = 2 UNION ALL SELECT 'n' || pos, 'fresh' FROM blocks WHERE pos % 10 = 0"""))
def resolve_updates(spark, d):
    b = blocks(spark, d)
    new = b.where("pos % 10 < 4").select(F.col("pos").alias("id"), F.lit("fresh").alias("content"))
    k = F.col("pos") % 10
    replies = b.where("pos % 10 < 4").select(F.col("pos").alias("id"), F.when(k == 1, "NOOP").when(k == 2, F.concat(F.lit("UPDATE "), "session_id", F.lit("\nmerged"))).when(k == 3, F.concat(F.lit("DELETE "), "session_id")).alias("reply"))
    return A.resolve(new, b, replies)


@register("prior_blocks", oracle(f"SELECT session_id FROM (SELECT session_id, row_number() OVER (PARTITION BY project, category ORDER BY pos) AS nth FROM blocks WHERE NOT {EXPIRED}) WHERE nth <= 3"))
def prior_blocks(spark, d):
    return A.prior_blocks(blocks(spark, d), now(), 3).select("session_id")


@register("evaluation_report", oracle("SELECT category, count(*) AS n, round(avg((pos % 11) / 10.0e0), 6) AS f1, round(avg(CASE WHEN pos % 3 = 0 THEN (pos % 5) / 5.0e0 END), 6) AS judge, round(avg(CASE WHEN pos % 11 = 0 THEN 1.0e0 ELSE 0 END), 6) AS not_found FROM blocks GROUP BY GROUPING SETS ((category), ())"))
def evaluation_report(spark, d):
    scored = blocks(spark, d).select("category", ((F.col("pos") % 11) / 10.0).alias("f1"), F.when(F.col("pos") % 3 == 0, (F.col("pos") % 5) / 5.0).alias("judge"), (F.col("pos") % 11 == 0).alias("missing"))
    return A.evaluation(scored).select("category", "n", F.round("f1", 6).alias("f1"), F.round("judge", 6).alias("judge"), F.round("not_found", 6).alias("not_found"))


@register("vcs_commit", oracle("SELECT session_id, category FROM blocks WHERE pos % 10 < 3 OR pos % 13 = 0"))
def vcs_commit(spark, d):
    """An additive commit: HEAD's sessions and the staged ones."""
    b = blocks(spark, d)
    head, staged = b.where("pos % 10 < 3").select("session_id"), b.where("pos % 13 = 0").select("session_id")
    return b.join(head.union(staged).distinct(), "session_id", "left_semi").select("session_id", "category")


@register("vcs_show", oracle("SELECT category, count(*) AS n, min(session_id) AS first FROM blocks WHERE pos % 10 < 7 GROUP BY 1"))
def vcs_show(spark, d):
    return blocks(spark, d).where("pos % 10 < 7").groupBy("category").agg(F.count("*").alias("n"), F.min("session_id").alias("first"))


@register("vcs_branches", oracle("SELECT branch, arg_max(id, seq) AS commit_id FROM commits GROUP BY 1"))
def vcs_branches(spark, d):
    """Branches with their newest commit."""
    return H.heads(commits(spark, d))


@register("consolidation_rewards", oracle("SELECT session_id, CASE WHEN pos % 2 = 0 THEN 0.8e0 ELSE 0.3e0 END AS reward, round(greatest(0, (pos % 7 - 3) / 100.0e0), 6) AS improvement FROM blocks"))
def consolidation_rewards(spark, d):
    p = F.col("pos")
    return blocks(spark, d).select("session_id", F.when(p % 2 == 0, 0.8).otherwise(0.3).alias("reward"), F.round(F.greatest(F.lit(0.0), (p % 7 - 3) / 100.0), 6).alias("improvement"))


@register("graph_tree", oracle("SELECT CAST(dst AS INT) AS id, rel_type, n_name AS name FROM graph_edges JOIN nation ON n_nationkey = dst WHERE src = 2"))
def graph_tree(spark, d):
    """Direct neighbours of one root, with their relation."""
    names = table(spark, d, "nation").select(F.col("n_nationkey").alias("dst"), F.col("n_name").alias("name"))
    return graph_edges(spark, d).where("src = 2").join(names, "dst").select(F.col("dst").cast("int").alias("id"), "rel_type", "name")


@register("snapshot_lines", oracle("SELECT session_id, len(string_split(content, chr(10))) AS lines FROM blocks"))
def snapshot_lines(spark, d):
    return blocks(spark, d).select("session_id", F.size(T.lines("content")).cast("long").alias("lines"))


