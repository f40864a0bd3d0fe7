"""Queries of keeping a store: additions, catalogs, reports, checks, packs, commits, learning."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.operators import blocks as B
from quillspark.operators import learning as L
from quillspark.operators import quality as Q
from quillspark.operators import sessions as SE
from quillspark.operators import upkeep as U
from quillspark.operators import history as H
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import EXPIRED
from quillspark.plans.learning import _TIERS
from quillspark.plans.quality import _C, _PROJECT, _SCORE
from quillspark.plans.sessions import _CUT, _TURNS
from quillspark.plans.texts import _QUOTED
from quillspark.sources import stores
from quillspark.sources.views import NOW, blocks, chunks, commits, now, oracle, packs, tool_uses, turns, usage_events


def _place(spark, name):
    return f"{stores.scratch(spark)}/stores/{name}-{uuid.uuid4().hex}"


@register("manual_add", oracle(f"""WITH n AS (SELECT CASE WHEN pos % 3 = 0 THEN 'src0' ELSE project END AS project, CASE WHEN pos % 3 = 0 THEN 'preferences' ELSE category END AS category, 'label' || (pos % 50) AS session_id, arg_max(content, pos) AS content FROM blocks WHERE pos % 3 < 2 AND pos % 7 <> 6 GROUP BY 1, 2, 3)
  SELECT project, category, session_id, content FROM blocks UNION ALL SELECT * FROM n"""))
def manual_add(spark, d):
    """Every block added again by a label: some as preferences, some of no category, some with a broken time to live."""
    b = blocks(spark, d)
    category = F.when(F.col("pos") % 3 == 0, "preferences").when(F.col("pos") % 3 == 1, F.col("category")).otherwise("nonsense")
    new = b.select("project", category.alias("category"), F.concat(F.lit("label"), (F.col("pos") % 50).cast("string")).alias("label"), "content", F.when(F.col("pos") % 7 == 6, "soon").when(F.col("pos") % 7 == 5, "7d").alias("ttl"), "ts_raw", "pos")
    return U.add(b, new, "src0").select("project", "category", "session_id", "content")


@register("replace_block", oracle("SELECT session_id, CASE WHEN session_id = 's9' AND category = 'patterns' THEN 'new' ELSE content END AS content, CASE WHEN session_id = 's9' AND category = 'patterns' THEN '2024-02-01T00:00:00Z' ELSE ts_raw END AS ts_raw FROM blocks"))
def replace_block(spark, d):
    return U.replace_one(blocks(spark, d), "patterns", "s9", "new", "2024-02-01T00:00:00Z").select("session_id", "content", "ts_raw")


@register("access_counts", oracle("SELECT session_id, CASE WHEN pos % 4 = 0 THEN 2 ELSE 0 END + CASE WHEN pos % 6 = 0 THEN 1 ELSE 0 END AS access_count FROM blocks"))
def access_counts(spark, d):
    b = blocks(spark, d)
    ids = b.where("pos % 4 = 0").select("session_id")
    counted = b.withColumn("access_count", F.when(F.col("pos") % 6 == 0, 1).cast("long"))
    return U.count_access(counted, ids.union(ids)).select("session_id", "access_count")


@register("lookup_packs", oracle(f"SELECT 'store' AS origin, session_id FROM blocks WHERE NOT {EXPIRED} AND contains(lower(content), 'license') UNION ALL SELECT 'pack:' || project, session_id FROM blocks WHERE category = 'patterns' AND contains(lower(content), 'license')"))
def lookup_packs(spark, d):
    """A lookup in the store, and in packs, where nothing expires."""
    b = blocks(spark, d)
    return U.lookup_packs(B.lookup(b, "License", now()), b.where("category = 'patterns'").select(F.col("project").alias("pack"), "session_id", "content"), "License")


@register("tool_results_text", oracle(f"SELECT session_id, pos, CASE WHEN strlen(x) <= 300 THEN x ELSE {_CUT.format(c='x', m=301, n=300)} || '...' END AS shown FROM (SELECT session_id, pos, text || chr(10) || 'more' AS x FROM turns)"))
def tool_results_text(spark, d):
    block = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    content = F.array(block("text", F.col("text")), block("image", F.lit("x")), block("text", F.lit("more")), block("text", F.lit(None).cast("string")))
    return turns(spark, d).select("session_id", "pos", U.tool_result(content).alias("shown"))


@register("conversation_meta", oracle(f"WITH {_TURNS}, c AS (SELECT session_id, count(*) AS n FROM t GROUP BY 1), u AS (SELECT session_id, count(*) FILTER (WHERE tool = 'Bash') AS bash, count(DISTINCT tool) AS tools FROM tool_uses GROUP BY 1) SELECT session_id, n AS turns, COALESCE(bash, 0) AS bash, COALESCE(tools, 0) AS tools FROM c LEFT JOIN u USING (session_id)"))
def conversation_meta(spark, d):
    """Meta data written as JSON and read back."""
    meta = U.conversation_meta(SE.turns(turns(spark, d)), tool_uses(spark, d))
    m = F.from_json("meta", "session_id long, turn_count long, tool_usage map<string,long>")
    return meta.select("session_id", m.alias("m")).select("session_id", F.col("m.turn_count").alias("turns"), F.coalesce(F.col("m.tool_usage")["Bash"], F.lit(0)).alias("bash"), F.size("m.tool_usage").cast("long").alias("tools"))


@register("conversation_summary", oracle(f"""WITH {_TURNS}, f AS (SELECT session_id, count(*) AS n, trim(arg_min(user_text, turn_no), ' ') AS x FROM t GROUP BY 1), k AS (SELECT session_id, tool, count(*) AS n FROM tool_uses GROUP BY 1, 2), u AS (SELECT session_id, string_agg(tool || '(' || n || ')', ', ' ORDER BY tool) AS used FROM k GROUP BY 1)
  SELECT session_id, '# ' || session_id || chr(10) || chr(10) || '**Turns:** ' || n || chr(10) || chr(10) || '**Initial request:** ' || CASE WHEN strlen(x) <= 500 THEN x ELSE {_CUT.format(c='x', m=501, n=500)} END || chr(10) || chr(10) || COALESCE('**Tools used:** ' || used || chr(10), '') AS summary FROM f LEFT JOIN u USING (session_id)"""))
def conversation_summary(spark, d):
    return U.conversation_summary(SE.turns(turns(spark, d)), tool_uses(spark, d))


def _redacted(x: str) -> str:
    for name, pattern in _QUOTED:
        x = f"regexp_replace({x}, '{pattern}', '[REDACTED:{name}]', 'g')"
    return x


_PLANTED = "CASE WHEN pos % 5 = 0 THEN content || chr(10) || 'api_key = ' || repeat('Ab1_', 6) ELSE content END"


@register("snapshot_redacted", oracle(f"SELECT project, category || '.md' AS file, pos, {_redacted(_PLANTED)} AS content FROM blocks WHERE category IN ('decisions', 'solutions', 'patterns') AND trim(content, ' ') <> '' UNION ALL SELECT project, 'context.md', 0, 'about ' || project FROM blocks GROUP BY 1"))
def snapshot_redacted(spark, d):
    b = blocks(spark, d).withColumn("content", F.when(F.col("pos") % 5 == 0, F.concat("content", F.lit("\napi_key = "), F.repeat(F.lit("Ab1_"), F.lit(6)))).otherwise(F.col("content")))
    contexts = b.select("project").distinct().select("project", F.concat(F.lit("about "), "project").alias("context"))
    return U.snapshot(b, contexts).where("file <> 'metadata.json'").select("project", "file", "pos", "content")


@register("quality_worst_first", oracle(f"WITH {_C}, {_PROJECT}, q AS (SELECT project, {_SCORE} AS score FROM p), w AS (SELECT project FROM q WHERE score < 75 ORDER BY score, project LIMIT 3) SELECT project, score, (SELECT CAST(sum(score) // count(*) AS BIGINT) FROM q) AS mean_score, project IN (SELECT project FROM w) AS attend FROM q"))
def quality_worst_first(spark, d):
    return U.worst_first(Q.project_quality(blocks(spark, d), now()))


@register("pack_sizes", oracle("SELECT project AS pack, category, CAST(sum(len(string_split('## Session: x' || chr(10) || content, '## Session:')) - 1) AS BIGINT) AS entries, CAST(sum(14 + strlen(content)) AS BIGINT) AS bytes FROM blocks GROUP BY 1, 2"))
def pack_sizes(spark, d):
    return U.pack_sizes(blocks(spark, d).select(F.col("project").alias("pack"), "category", F.concat(F.lit("## Session: x\n"), "content").alias("content")))


@register("project_overview", oracle("SELECT project, count(DISTINCT session_id) AS sessions, CAST(sum(strlen(content)) AS BIGINT) AS bytes, max(ts_raw) AS newest, project < 'src2' AS has_context FROM blocks GROUP BY 1"))
def project_overview(spark, d):
    b = blocks(spark, d)
    return U.project_overview(b, b.select("project", F.when(F.col("project") < "src2", "x").otherwise("").alias("context")).distinct())


_FIG = f"""f AS (SELECT project, project <> 'src1' AS has_dir, CASE WHEN project < 'src2' THEN 10 WHEN project < 'src6' THEN 60 END AS context_age, min(date_sub('day', ts, TIMESTAMP '{NOW}')) AS newest_age, project >= 'src3' AS has_embeddings, project < 'src5' AS has_graph,
  max(strlen(content)) * 300 AS largest, count(*) FILTER (WHERE category = 'questions') AS inbox, count(*) FILTER (WHERE {EXPIRED}) AS expired FROM blocks GROUP BY 1)"""
_RULES = """i AS (SELECT project, 'critical' AS severity, 'no_knowledge' AS issue, true AS fixable FROM f WHERE NOT has_dir UNION ALL SELECT project, 'warning', 'missing_context', true FROM f WHERE has_dir AND context_age IS NULL
  UNION ALL SELECT project, 'info', 'stale_context', true FROM f WHERE has_dir AND context_age > newest_age UNION ALL SELECT project, 'info', 'missing_embeddings', true FROM f WHERE has_dir AND NOT has_embeddings UNION ALL SELECT project, 'info', 'missing_graph', true FROM f WHERE has_dir AND NOT has_graph
  UNION ALL SELECT project, 'warning', 'large_files', false FROM f WHERE has_dir AND largest > 5242880 UNION ALL SELECT project, 'info', 'inbox_backlog', false FROM f WHERE has_dir AND inbox > 10 UNION ALL SELECT project, 'info', 'expired_entries', true FROM f WHERE has_dir AND expired > 0)"""


def _figures(spark, d):
    p = F.col("project")
    gone = S.expired(F.col("ts"), F.col("ttl"), now())
    return blocks(spark, d).groupBy("project").agg((p != "src1").alias("has_dir"), F.when(p < "src2", 10).when(p < "src6", 60).alias("context_age"), F.min(S.days_between(F.col("ts"), now())).alias("newest_age"), (p >= "src3").alias("has_embeddings"), (p < "src5").alias("has_graph"), (F.max(F.octet_length("content")) * 300).alias("largest"), F.count_if(F.col("category") == "questions").alias("inbox"), F.count_if(gone).alias("expired"))


@register("health_rules", oracle(f"WITH {_FIG}, {_RULES} SELECT * FROM i"))
def health_rules(spark, d):
    return U.project_issues(_figures(spark, d))


@register("heal_plan", oracle(f"WITH {_FIG}, {_RULES} SELECT DISTINCT project, CASE WHEN issue IN ('stale_context', 'missing_context') THEN 'regenerate' WHEN issue = 'missing_embeddings' THEN 'embed' ELSE 'build_graph' END AS action FROM i WHERE issue IN ('stale_context', 'missing_context', 'missing_embeddings', 'missing_graph')"))
def heal_plan(spark, d):
    return U.repairs(U.project_issues(_figures(spark, d)))


@register("regenerate", oracle(f"SELECT project, count(*) AS n, 'Context of ' || project AS context FROM blocks WHERE NOT {EXPIRED} GROUP BY 1"))
def regenerate(spark, d):
    """A project's context anew: active blocks counted, a provider asked once a project for the document."""
    from quillspark.operators.providers import chat_column

    known = B.active(blocks(spark, d), now()).groupBy("project").agg(F.count("*").alias("n"))
    asked = known.withColumn("asked", F.concat(F.lit("Context of "), "project"))
    return asked.select("project", "n", chat_column("asked", "context").alias("context"))


@register("success_rate", oracle("SELECT count(*) AS n, round(COALESCE(avg(CASE WHEN event_id % 5 - 2 > 0 THEN 1.0e0 ELSE 0 END), 0), 6) AS rate FROM usage_events WHERE event_type = 'Ingest'"))
def success_rate(spark, d):
    a = usage_events(spark, d).where("event_type = 'Ingest'").select((F.col("event_id") % 5 - 2).alias("improvement"))
    return U.success_rate(a).withColumn("rate", F.round("rate", 6))


_KIND = "(['technology', 'tech', 'People', 'tool', 'thing'])[CAST(pos % 5 AS INT) + 1]"


@register("graph_concepts", oracle(f"SELECT 'c' || pos AS concept, 'Name ' || pos AS name, CASE {_KIND} WHEN 'technology' THEN 'technology' WHEN 'tech' THEN 'technology' WHEN 'People' THEN 'person' WHEN 'tool' THEN 'tool' ELSE 'other' END AS category, CASE WHEN pos % 2 = 0 THEN 0.5e0 ELSE 0.75e0 END AS importance FROM blocks UNION ALL SELECT 'shared', 'shared', 'other', 0.5 FROM (SELECT 1)"))
def graph_concepts(spark, d):
    """Replies with a concept of their own and one that all have."""
    kind = F.element_at(F.array(*map(F.lit, ["technology", "tech", "People", "tool", "thing"])), (F.col("pos") % 5).cast("int") + 1)
    n = F.col("pos").cast("string")
    body = F.concat(F.lit('{"concepts": [{"id": "c'), n, F.lit('", "name": "Name '), n, F.lit('", "category": "'), kind, F.lit('"'), F.when(F.col("pos") % 2 == 0, "").otherwise(', "importance": 0.75'), F.lit('}, {"id": "shared"}], "relationships": []}'))
    return U.graph_concepts(blocks(spark, d).select(F.col("pos").alias("id"), F.when(F.col("pos") % 3 == 0, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply")))


@register("relation_aliases", oracle("SELECT pos, CASE pos % 4 WHEN 0 THEN 'depends-on' WHEN 1 THEN 'supersedes' WHEN 2 THEN 'relates-to' END AS relation FROM blocks"))
def relation_aliases(spark, d):
    x = F.element_at(F.array(*map(F.lit, ["Requires", "replaces", "related", "likes"])), (F.col("pos") % 4).cast("int") + 1)
    return blocks(spark, d).select("pos", U.relation(x).alias("relation"))


_VERSIONS = "v AS (SELECT category || '-' || CAST(floor(epoch(ts)) AS BIGINT) || '-' || event_id AS version_id, category, ts, event_id FROM usage_events WHERE event_type = 'Ingest' AND category IS NOT NULL)"


def _versions(spark, d):
    e = usage_events(spark, d).where("event_type = 'Ingest' AND category IS NOT NULL")
    return e.select(F.concat_ws("-", "category", F.unix_timestamp("ts").cast("string"), F.col("event_id").cast("string")).alias("version_id"), "category", "ts", F.sha2(F.col("event_id").cast("string"), 256).alias("content_hash"), F.col("event_id").alias("size_bytes"))


@register("versions_tracked", oracle(f"WITH {_VERSIONS}, a AS (SELECT version_id, category, ts FROM v UNION ALL SELECT 'patterns-1706745600-7', 'patterns', TIMESTAMP '{NOW}') SELECT version_id, CAST(row_number() OVER (ORDER BY ts DESC, version_id DESC) AS INT) AS nth FROM a WHERE category = 'patterns'"))
def versions_tracked(spark, d):
    """A version added, then all of its category, newest first."""
    tracked = U.track(_versions(spark, d), "patterns", now(), F.sha2(F.lit("x"), 256), F.lit(1), 7)
    nth = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("ts"), F.desc("version_id")))
    return tracked.where("category = 'patterns'").select("version_id", nth.alias("nth"))


@register("outcome_scan", oracle("SELECT strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS second, max(event_id) AS id FROM usage_events WHERE event_type = 'Ingest' GROUP BY 1"))
def outcome_scan(spark, d):
    """Outcomes written as JSON and read again, one a second."""
    path = _place(spark, "outcomes")
    e = usage_events(spark, d).where("event_type = 'Ingest'")
    e.select("ts", F.col("event_id").alias("id"), F.lit(0.5).alias("reward"), F.col("event_id").alias("written")).write.json(path)
    read = spark.read.schema("ts timestamp, id long, reward double, written long").json(path)
    return U.outcomes(read).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("second"), "id")


@register("pack_discovery", oracle("SELECT 'p' || (id % 50) AS name, min(CASE WHEN id % 3 = 0 THEN 0 ELSE 1 END) AS depth, count(*) AS copies FROM packs WHERE id % 3 < 2 GROUP BY 1"))
def pack_discovery(spark, d):
    """Manifests at the root, a folder down and two folders down, of which the last is too deep."""
    n = F.concat(F.lit("p"), (F.col("id") % 50).cast("string"))
    i = F.col("id").cast("string")
    path = F.when(F.col("id") % 3 == 0, F.concat(n, F.lit("/.pack/manifest.json"))).when(F.col("id") % 3 == 1, F.concat(F.lit("r"), i, F.lit("/"), n, F.lit("/.pack/manifest.json"))).otherwise(F.concat(F.lit("r/s"), i, F.lit("/"), n, F.lit("/.pack/manifest.json")))
    files = packs(spark, d).select(path.alias("path"))
    return U.discovered_packs(files.unionByName(files.select(F.replace("path", F.lit("manifest"), F.lit("other")).alias("path")))).select("name", "depth", "copies")


@register("pack_manifests", oracle("SELECT id, CASE id % 6 WHEN 0 THEN 'name' WHEN 1 THEN 'version' WHEN 2 THEN 'version format' WHEN 3 THEN 'repository' WHEN 4 THEN 'author' END AS wrong FROM packs"))
def pack_manifests(spark, d):
    k = F.col("id") % 6
    rows = packs(spark, d).select("id", F.when(k != 0, F.col("name")).alias("name"), F.when(k == 1, "").when(k == 2, "1").otherwise("1.0").alias("version"), F.when(k != 3, "git").alias("repository"), F.when(k != 4, "me").otherwise("").alias("author"))
    return U.valid_packs(rows)


@register("pack_checks", oracle("SELECT id, issue FROM (SELECT id, unnest([CASE WHEN id % 5 = 0 THEN 'missing_manifest' WHEN id % 5 = 1 THEN 'invalid_manifest' END, CASE WHEN id % 7 = 0 THEN 'no_knowledge' WHEN id % 7 = 1 THEN 'missing_folder' END, CASE WHEN registry = 3 THEN 'orphaned' END]) AS issue FROM packs) WHERE issue IS NOT NULL"))
def pack_checks(spark, d):
    p = packs(spark, d)
    rows = p.select("id", "registry", F.when(F.col("id") % 5 == 1, "1").when(F.col("id") % 5 > 1, "1.0").alias("version"), F.when(F.col("id") % 7 == 0, 0).when(F.col("id") % 7 > 1, 2).alias("n_files"))
    return U.pack_issues(rows, p.select("registry").where("registry < 3").distinct())


@register("pack_structure", oracle("SELECT id AS pack, CASE id % 4 WHEN 0 THEN 'manifest' WHEN 1 THEN 'knowledge folder' WHEN 2 THEN 'knowledge files' END AS wrong, id % 3 = 0 AS readme, CASE WHEN id % 4 IN (0, 3) THEN 'Decisions,Patterns' ELSE '' END AS categories FROM packs"))
def pack_structure(spark, d):
    k = F.col("id") % 4
    files = F.array(F.when(k != 0, ".pack/manifest.json"), F.when(F.col("id") % 3 == 0, "README.md"), F.when(k == 2, "knowledge/other.txt"), F.when(k.isin(0, 3), "knowledge/patterns.md"), F.when(k.isin(0, 3), "knowledge/decisions.md"), F.lit("notes.txt"))
    return U.pack_structure(packs(spark, d).select(F.col("id").alias("pack"), F.explode(F.array_compact(files)).alias("file")))


_SECRET = "project < 'src14'"


@register("pack_create", oracle(f"WITH b AS (SELECT * FROM blocks WHERE NOT {EXPIRED} AND category IN ('patterns', 'solutions')), s AS (SELECT DISTINCT project FROM b WHERE {_SECRET} OR regexp_matches(content, '{'|'.join('(' + p + ')' for _, p in _QUOTED if not p.startswith('(?i)'))}') OR regexp_matches(content, '(?i){'|'.join(p[4:] for _, p in _QUOTED if p.startswith('(?i)'))}')) SELECT project, category, session_id FROM b WHERE project NOT IN (SELECT project FROM s)"))
def pack_create(spark, d):
    """Packs of all projects, some of which hold a planted secret."""
    key = F.concat(F.lit("\nid AKIA"), F.repeat(F.lit("A1B2"), F.lit(4)))
    b = blocks(spark, d).withColumn("content", F.when(F.col("project") < "src14", F.concat("content", key)).otherwise(F.col("content")))
    return U.create_pack(b, now())[0].select("project", "category", "session_id")


@register("commit_additive", oracle("SELECT session_id FROM blocks WHERE pos % 10 < 3 UNION SELECT session_id FROM blocks WHERE pos % 13 = 0"))
def commit_additive(spark, d):
    """HEAD's sessions and picked ones, of which some don't exist."""
    b = blocks(spark, d)
    picked = b.where("pos % 13 = 0").select("session_id").union(spark.createDataFrame([("none",)], "session_id string"))
    return U.committed(b, b.where("pos % 10 < 3").select("session_id"), picked)


_MONTHS = "m AS (SELECT branch, seq // 100 AS seq, substr(sha256(CAST(count(*) FILTER (WHERE message LIKE 'Fix%') AS VARCHAR)), 1, 8) AS id FROM commits GROUP BY 1, 2)"


@register("commit_history", oracle(f"WITH {_MONTHS}, p AS (SELECT *, lag(id) OVER (PARTITION BY branch ORDER BY seq) AS parent FROM m) SELECT branch, seq, id, parent FROM p WHERE parent IS NULL OR parent <> id"))
def commit_history(spark, d):
    """A branch's snapshots, one a hundred orders, as commits: those that equal the head are refused."""
    fixes = F.count_if(F.startswith("message", F.lit("Fix")))
    snapshots = commits(spark, d).groupBy("branch", F.floor(F.col("seq") / 100).alias("seq")).agg(F.substring(F.sha2(fixes.cast("string"), 256), 1, 8).alias("id"))
    return H.committed(snapshots)


@register("branch_work", oracle("""WITH h AS (SELECT branch, arg_max(id, seq) AS commit_id FROM commits GROUP BY 1), t AS (SELECT branch AS target FROM h UNION SELECT left(id, 4) FROM commits UNION SELECT 'none'),
  b AS (SELECT target, count(*) AS n, min(id) AS first FROM t JOIN commits ON starts_with(id, target) WHERE length(target) >= 4 GROUP BY 1)
  SELECT target, COALESCE(commit_id, CASE WHEN n = 1 THEN first END) AS commit_id FROM t LEFT JOIN h ON branch = target LEFT JOIN b USING (target)"""))
def branch_work(spark, d):
    """Branches' names and the begins of all ids as targets: a name is its branch's head, a begin the only commit that has it."""
    c = commits(spark, d)
    targets = H.heads(c).select(F.col("branch").alias("target")).union(c.select(F.left("id", F.lit(4)))).union(spark.range(1).select(F.lit("none"))).distinct()
    return H.resolved(targets, H.heads(c), c)


@register("index_stored", oracle("SELECT count(*) AS n, count(DISTINCT id) AS ids, 0 AS fresh FROM chunks"))
def index_stored(spark, d):
    """An embedding index saved and loaded; where there is none, an empty one."""
    path, c = _place(spark, "index"), chunks(spark, d)
    schema = "id long, text string, embedding array<double>"
    fresh = stores.load_or_create(spark, path, schema).count()
    stores.save(c.select("id", "text", "embedding"), path)
    return stores.load_or_create(spark, path, schema).agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"), F.lit(fresh).cast("long").alias("fresh"))


@register("store_tree", oracle("SELECT project, count(DISTINCT category) AS items, true AS sized, true AS dated FROM blocks GROUP BY 1"))
def store_tree(spark, d):
    """A store's projects with their files, bytes and newest change, from the files' own data."""
    path = _place(spark, "tree")
    stores.write_blocks(blocks(spark, d).repartition("project", "category"), path)
    tree = U.file_tree(stores.catalog(spark, path, "*.parquet"))
    return tree.select("project", "items", (F.col("bytes") > 0).alias("sized"), F.col("modified").isNotNull().alias("dated"))


@register("session_files", oracle("SELECT project, session_id AS session, CAST(row_number() OVER (PARTITION BY project ORDER BY ts DESC, session_id) AS INT) AS nth FROM blocks WHERE pos % 4 < 2"))
def session_files(spark, d):
    """Files of sessions: some at the right depth, some deeper, some of another kind."""
    s, p = F.col("session_id"), F.col("project")
    path = F.when(F.col("pos") % 4 < 2, F.concat(p, F.lit("/"), s, F.lit(".jsonl"))).when(F.col("pos") % 4 == 2, F.concat(p, F.lit("/sub/"), s, F.lit(".jsonl"))).otherwise(F.concat(p, F.lit("/"), s, F.lit(".txt")))
    return U.session_catalog(blocks(spark, d).select(path.alias("path"), F.col("ts").alias("modified"))).select("project", "session", "nth")


# Learning


@register("recalled_boosts", oracle("SELECT id, round(CASE WHEN n IS NULL THEN boost ELSE least(greatest(0.6e0 + (least(greatest(boost + (0.6e0 - boost) * 0.2e0, 0.1e0), 1.0e0) - 0.6e0) * power(0.8e0, n - 1), 0.1e0), 1.0e0) END, 6) AS boost FROM (SELECT 's' || pos AS id, (pos % 10) / 10.0e0 AS boost, CASE WHEN pos % 3 > 0 THEN pos % 3 END AS n FROM blocks)"))
def recalled_boosts(spark, d):
    """Ids recalled not at all, once or twice."""
    b = blocks(spark, d)
    boosts = b.select(F.col("session_id").alias("id"), ((F.col("pos") % 10) / 10.0).alias("boost"))
    ids = b.where("pos % 3 > 0").select(F.col("session_id").alias("id")).unionByName(b.where("pos % 3 = 2").select(F.col("session_id").alias("id")))
    return L.recalled(boosts, ids).select("id", F.round("boost", 6).alias("boost"))


@register("recalled_blocks", oracle("SELECT session_id, CASE WHEN pos % 3 = 0 OR pos % 3 = 1 THEN 1 ELSE 0 END AS access_count, round(CASE WHEN pos % 3 < 2 THEN least(COALESCE(strength, 1.0e0) + 0.3e0, 5.0e0) ELSE strength END, 6) AS strength FROM blocks"))
def recalled_blocks(spark, d):
    """Blocks recalled by session, by category:session, and by a category that isn't theirs."""
    b = blocks(spark, d)
    ids = b.select(F.when(F.col("pos") % 3 == 0, F.col("session_id")).when(F.col("pos") % 3 == 1, F.concat_ws(":", "category", "session_id")).otherwise(F.concat(F.lit("none:"), "session_id")).alias("id"))
    return L.recall_blocks(b, ids).select("session_id", "access_count", F.round("strength", 6).alias("strength"))


@register("explored_actions", oracle("SELECT count(*) AS states, true AS shared, true AS greedy, true AS known FROM blocks"))
def explored_actions(spark, d):
    """A fifth of all sessions take any action, the same ones for the same seed; the others their best."""
    states = blocks(spark, d).select(F.col("session_id").alias("state"), F.lit("Extend7d").alias("action"))
    taken = L.explore(states, 0.2, 5)
    share = F.avg(F.col("explored").cast("double")).between(0.12, 0.28)
    return taken.agg(F.count("*").alias("states"), share.alias("shared"), F.bool_and(F.col("explored") | (F.col("action") == "Extend7d")).alias("greedy"), F.bool_and(F.col("action").isin(L.ACTIONS)).alias("known"))


_STATE = "importance || '/' || frequency || '/' || recency"
_ACTS = f"a AS (SELECT s.*, CASE importance WHEN 'High' THEN 'MakePermanent' WHEN 'Medium' THEN 'Extend30d' ELSE 'Reduce7d' END AS action FROM (SELECT b.*, t.importance, t.frequency, t.recency FROM t JOIN blocks b USING (session_id)) s WHERE NOT {EXPIRED} AND category <> 'procedures'), n AS (SELECT *, CASE ttl WHEN '7d' THEN 7 WHEN '2w' THEN 14 WHEN '36h' THEN 1 END AS before FROM a), c AS (SELECT *, CASE action WHEN 'MakePermanent' THEN NULL WHEN 'Extend30d' THEN COALESCE(before, 30) + 30 ELSE greatest(COALESCE(before, 7) - 7, 1) END AS after FROM n)"


def _changes(spark, d):
    b = blocks(spark, d)
    boosts = b.select(F.col("session_id").alias("id"), ((F.col("pos") % 10) / 10.0).alias("boost"))
    kinds = [(f"{i}/{f}/{r}", {"High": "MakePermanent", "Medium": "Extend30d", "Low": "Reduce7d"}[i]) for i in ("High", "Medium", "Low") for f in ("Frequent", "Occasional", "Rare") for r in ("Recent", "Normal", "Stale")]
    return b, L.ttl_changes(b, boosts, spark.createDataFrame(kinds, "state string, action string"), now())


@register("ttl_preview", oracle(f"WITH {_TIERS}, {_ACTS} SELECT category || ':' || session_id AS knowledge_id, CAST(before AS BIGINT) AS before, CAST(after AS BIGINT) AS after FROM c WHERE before IS DISTINCT FROM after"))
def ttl_preview(spark, d):
    return _changes(spark, d)[1].select("knowledge_id", "before", "after")


@register("ttl_applied", oracle(f"WITH {_TIERS}, {_ACTS} SELECT b.session_id, CASE WHEN c.session_id IS NULL THEN b.ttl WHEN c.after IS NULL THEN NULL ELSE c.after || 'd' END AS ttl FROM blocks b LEFT JOIN (SELECT * FROM c WHERE before IS DISTINCT FROM after) c ON c.session_id = b.session_id"))
def ttl_applied(spark, d):
    b, changes = _changes(spark, d)
    return L.apply_ttl(b, changes).select("session_id", "ttl")


@register("ttl_untrained", oracle("SELECT session_id, ttl FROM blocks"))
def ttl_untrained(spark, d):
    """Without an action nothing changes."""
    b = blocks(spark, d)
    none = spark.createDataFrame([], "state string, action string")
    return L.apply_ttl(b, L.ttl_changes(b, b.select(F.col("session_id").alias("id"), F.lit(0.5).alias("boost")), none, now())).select("session_id", "ttl")


@register("learning_report", oracle("WITH h AS (SELECT event_id AS seq, CAST(90 + event_id % 7 AS INT) AS health FROM usage_events), l AS (SELECT var_pop(health) < 10 AND count(*) >= 10 AS converged FROM (SELECT * FROM h ORDER BY seq DESC LIMIT 10)), b AS (SELECT string_agg(session_id, ',' ORDER BY boost DESC, session_id) AS top FROM (SELECT session_id, (pos % 97) / 97.0e0 AS boost FROM blocks ORDER BY boost DESC, session_id LIMIT 5)) SELECT arg_max(health, seq) - arg_min(health, seq) AS change, (SELECT top FROM b) AS top, 2 AS successes, CASE WHEN (SELECT converged FROM l) THEN 'low_success,reduce_exploration' WHEN count(*) > 100 THEN 'not_converging,low_success' ELSE 'low_success' END AS suggestions FROM h"))
def learning_report(spark, d):
    history = usage_events(spark, d).select(F.col("event_id").alias("seq"), (90 + F.col("event_id") % 7).cast("int").alias("health"))
    boosts = blocks(spark, d).select(F.col("session_id").alias("id"), ((F.col("pos") % 97) / 97.0).alias("boost"))
    adaptations = spark.range(10).select(F.when(F.col("id") < 2, 1).otherwise(-1).alias("improvement"))
    return L.report(history, boosts, adaptations, 0.2).select("change", "top", "successes", "suggestions")


_FEED = "list({'r': CASE WHEN event_id % 4 < 2 THEN 1.0e0 ELSE -0.2e0 END, 's': 0.0e0} ORDER BY event_id)"


@register("feedback_given", oracle(f"SELECT id, round(list_reduce(list_prepend({{'r': 0.0e0, 's': 0.4e0}}, steps), lambda s, x: {{'r': 0.0e0, 's': least(greatest(s.s + (x.r - s.s) * 0.2e0, 0.1e0), 1.0e0)}}).s, 6) AS boost FROM (SELECT 'k' || (event_id % 50) AS id, {_FEED} AS steps FROM usage_events GROUP BY 1)"))
def feedback_given(spark, d):
    given = usage_events(spark, d).select(F.concat(F.lit("k"), (F.col("event_id") % 50).cast("string")).alias("id"), (F.col("event_id") % 4 < 2).alias("useful"), F.col("event_id").alias("pos"))
    boosts = spark.range(50).select(F.concat(F.lit("k"), F.col("id").cast("string")).alias("id"), F.lit(0.4).alias("boost"))
    return L.feedback(boosts, given).select("id", F.round("boost", 6).alias("boost"))


@register("learning_reset", "SELECT 'x' AS id, 0.5e0 AS boost WHERE false")
def learning_reset(spark, d):
    return L.reset(blocks(spark, d).select(F.col("session_id").alias("id"), F.lit(0.5).alias("boost")))


def _fuzzy_sql(pattern: str) -> str:
    """The greedy score of a short pattern, place by place."""
    score = "0"
    out = "SELECT id, name, lower(name) AS n, 0 AS a0 FROM packs"
    for i, c in enumerate(pattern, 1):
        out = f"SELECT *, a{i - 1} + instr(substr(n, a{i - 1} + 1), '{c}') AS a{i} FROM ({out})"
        score += f" + 16 + CASE WHEN a{i} = 1 OR NOT regexp_matches(substr(n, a{i} - 1, 1), '[\\p{{L}}\\p{{N}}]') THEN 8 ELSE 0 END + CASE WHEN a{i - 1} > 0 AND a{i} = a{i - 1} + 1 THEN 8 ELSE 0 END"
    return f"SELECT id, name, CAST({score} AS INT) AS score FROM ({out}) WHERE regexp_matches(n, '{'.*'.join(pattern)}') ORDER BY score DESC, id LIMIT 20"


@register("fuzzy_ranked", oracle(_fuzzy_sql("rdw")))
def fuzzy_ranked(spark, d):
    from quillspark.operators.fuzzy import fuzzy_match

    return fuzzy_match(packs(spark, d), "name", "rdw").orderBy(F.desc("score"), "id").limit(20).select("id", "name", "score")



def _aligned_sql(pattern: str) -> str:
    """The best alignment of a short pattern: places of each character joined with those of the one before."""
    steps = "g AS (SELECT id, name, lower(name) AS n FROM packs), c AS (SELECT id, i, substr(n, i, 1) AS ch, CASE WHEN i = 1 OR NOT regexp_matches(substr(n, i - 1, 1), '[\\p{L}\\p{N}]') THEN 8 ELSE 0 END AS b FROM g, range(1, 1000) r(i) WHERE i <= length(n))"
    steps += f", a0 AS (SELECT id, i, 16 + b AS s FROM c WHERE ch = '{pattern[0]}')"
    for j, ch in enumerate(pattern[1:], 1):
        steps += f", a{j} AS (SELECT c.id, c.i, 16 + any_value(b) + max(s + CASE WHEN c.i = p.i + 1 THEN 8 ELSE -3 - (c.i - p.i - 2) END) AS s FROM c JOIN a{j - 1} p ON p.id = c.id AND p.i < c.i WHERE ch = '{ch}' GROUP BY 1, 2)"
    return f"WITH {steps}, f AS (SELECT id, max(s) AS score FROM a{len(pattern) - 1} GROUP BY 1) SELECT id, name, CAST(score AS INT) AS score FROM f JOIN g USING (id)"


@register("fuzzy_aligned", oracle(_aligned_sql("rdw")))
def fuzzy_aligned(spark, d):
    """All packs whose name holds a pattern, by their best alignment."""
    from quillspark.operators.fuzzy import fuzzy_best

    return fuzzy_best(packs(spark, d), "name", "rdw").select("id", "name", "score")


@register("fuzzy_best_top", oracle(f"{_aligned_sql('red')} ORDER BY score DESC, id LIMIT 20"))
def fuzzy_best_top(spark, d):
    """The best twenty of them, aligned only where a bound allows it."""
    from quillspark.operators.fuzzy import fuzzy_top

    return fuzzy_top(packs(spark, d), "name", "red", 20, "id").select("id", "name", "score")


def _store(spark, d):
    from quillspark.operators.tools import Store
    from quillspark.plans.answers import _embedder
    from quillspark.sources.views import CATEGORIES, graph_edges, graph_nodes, observations

    b = blocks(spark, d)
    contexts = b.groupBy("project").agg(F.min_by("content", "pos").alias("context"))
    pick = lambda system, entries: "s4, s9" if system == "choose" else "answer"
    return Store(b, chunks(spark, d), usage_events(spark, d), graph_nodes(spark, d), graph_edges(spark, d), contexts, observations(spark, d), now(), CATEGORIES, "src0", _embedder(spark, d), pick)


@register("tool_dispatch", oracle(f"""SELECT 'index' AS tool, count(*) AS n FROM blocks UNION ALL SELECT 'lookup', count(*) FROM blocks WHERE NOT {EXPIRED} AND contains(lower(content), 'license') UNION ALL SELECT 'projects', count(DISTINCT project) FROM blocks
  UNION ALL SELECT 'add', count(*) + 1 FROM blocks UNION ALL SELECT 'update', count(*) FROM blocks UNION ALL SELECT 'forget', count(*) FROM blocks WHERE NOT contains(lower(content), 'rights reserved') UNION ALL SELECT 'observations', count(*) FROM observations WHERE tool = 'Edit'
  UNION ALL SELECT 'ask_recursive', 1 UNION ALL SELECT 'recall', 1 UNION ALL SELECT 'search_semantic', 8"""))
def tool_dispatch(spark, d):
    """Tools called by name, and how many rows each gives."""
    from quillspark.operators.tools import dispatch

    s = _store(spark, d)
    calls = [("index", {}), ("lookup", {"query": "License"}), ("projects", {}), ("add", {"project": "p", "category": "bugs", "content": "x", "label": "l"}), ("update", {"category": "bugs", "session_id": "s3", "content": "x", "ts_raw": "t"}), ("forget", {"topic": "rights reserved"}), ("observations", {"tool": "Edit"}), ("ask_recursive", {"question": "x"}), ("recall", {"project": "src3"}), ("search_semantic", {"query": "the tion"})]
    return spark.createDataFrame([(name, dispatch(s, name, given).count()) for name, given in calls], "tool string, n long")
