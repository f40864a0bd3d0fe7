"""Queries of assembled documents, catalogs and sinks."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators import blocks as B
from quillspark.operators import documents as D
from quillspark.operators import sessions as S
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import EXPIRED
from quillspark.plans.sessions import _CUT, _TURNS
from quillspark.sources import stores
from quillspark.sources.views import CATEGORIES, blocks, now, oracle, packs, turns, usage_events

_HEAD = "'## Session: ' || session_id || ' (' || ts_raw || ')' || COALESCE(' [ttl:' || ttl || ']', '') || COALESCE(' [confidence:' || confidence || ']', '') || COALESCE(' [strength:' || printf('%.2f', strength) || ']', '')"


@register("export_markdown", oracle(f"SELECT project, category, pos, {_HEAD} || chr(10) || chr(10) || trim(content, ' ') || chr(10) AS text FROM blocks WHERE NOT {EXPIRED}"))
def export_markdown(spark, d):
    return D.export_markdown(blocks(spark, d), now())


@register("export_json", oracle(f"SELECT pos, session_id, content FROM blocks WHERE NOT {EXPIRED}"))
def export_json(spark, d):
    """Exported as JSON and read back."""
    out = D.export_json(blocks(spark, d), now())
    return out.select("pos", F.get_json_object("json", "$.session_id").alias("session_id"), F.get_json_object("json", "$.content").alias("content"))


@register("export_html", oracle(f"SELECT pos, '<section><h3>' || session_id || '</h3><pre>' || replace(replace(replace(content, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') || '</pre></section>' AS html FROM blocks WHERE NOT {EXPIRED}"))
def export_html(spark, d):
    return D.export_html(blocks(spark, d), now()).select("pos", "html")


@register("conversation_markdown", oracle(f"""WITH {_TURNS}, s AS (SELECT session_id, turn_no, CASE WHEN strlen(trim(user_text, ' ')) > 200 THEN {_CUT.format(c="trim(user_text, ' ')", m=201, n=200)} || chr(10) || chr(10) || '*[truncated]*' ELSE trim(user_text, ' ') END AS u,
  CASE WHEN strlen(trim(assistant_text, ' ')) > 200 THEN {_CUT.format(c="trim(assistant_text, ' ')", m=201, n=200)} || chr(10) || chr(10) || '*[truncated]*' ELSE trim(assistant_text, ' ') END AS a FROM t)
  SELECT session_id, '# Session: ' || session_id || chr(10) || chr(10) || '**Turns:** ' || count(*) || chr(10) || chr(10) || '---' || chr(10) || chr(10) || string_agg('## Turn ' || turn_no || chr(10) || chr(10) || '### User' || chr(10) || chr(10) || u || chr(10) || chr(10) || '### Assistant' || chr(10) || chr(10) || a, chr(10) || chr(10) ORDER BY turn_no) AS markdown FROM s GROUP BY session_id"""))
def conversation_markdown(spark, d):
    return D.render_conversation(S.turns(turns(spark, d)), 200)


@register("smart_memory", oracle("""WITH h AS (SELECT session_id, category, cat_ord, content, (pos % 97) / 100.0e0 AS score FROM blocks ORDER BY score DESC, session_id LIMIT 40), t AS (SELECT *, sum(greatest(1, strlen(content) // 4)) OVER (PARTITION BY category ORDER BY score DESC, session_id) AS total FROM h),
  s AS (SELECT category, cat_ord, string_agg('<!-- relevance: ' || CAST(floor(score * 100 + 0.5) AS INT) || '% -->' || chr(10) || trim(content, ' '), chr(10) || chr(10) ORDER BY score DESC, session_id) AS text FROM t WHERE total <= 900 GROUP BY 1, 2)
  SELECT string_agg('### ' || category || chr(10) || chr(10) || text, chr(10) || chr(10) ORDER BY cat_ord) AS memory FROM s"""))
def smart_memory(spark, d):
    """Of the 40 best hits, which is what a memory is asked of."""
    hits = blocks(spark, d).select("session_id", "category", "content", ((F.col("pos") % 97) / 100.0).alias("score")).orderBy(F.desc("score"), "session_id").limit(40)
    return D.smart_memory(hits, CATEGORIES, 900)


@register("compact_memory", oracle("""WITH c AS (SELECT project, string_split(arg_min(content, pos), chr(10)) AS ls FROM blocks GROUP BY 1), s AS (SELECT project, CASE WHEN len(ls) > 3 THEN array_to_string(ls[1:1], chr(10)) || chr(10) || '[trimmed]' ELSE array_to_string(ls, chr(10)) END AS context FROM c)
  SELECT project, '## Project: ' || project || chr(10) || chr(10) || context || chr(10) || chr(10) || '---' || chr(10) || chr(10) || CASE WHEN project < 'src2' THEN '## User Preferences' || chr(10) || chr(10) || 'x, y' || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END AS memory FROM s"""))
def compact_memory(spark, d):
    context = blocks(spark, d).groupBy("project").agg(F.min_by("content", "pos").alias("context"))
    prefs = context.where("project < 'src2'").select("project", F.lit("x, y").alias("preferences"))
    return D.compact_memory(context, prefs, 9)


@register("pack_summary", oracle("SELECT '- **pack' || (pos % 20) || '**: ' || string_agg(DISTINCT 'patterns (' || (pos % 20 % 3 + 1) || ' entries)', '') AS line FROM blocks GROUP BY pos % 20"))
def pack_summary(spark, d):
    k = F.col("pos") % 20
    files = blocks(spark, d).select(F.concat(F.lit("pack"), k.cast("string")).alias("pack"), F.lit("patterns").alias("category"), F.repeat(F.lit("## Session: x\n"), (k % 3 + 1).cast("int")).alias("content")).distinct()
    return D.pack_summary(files)


@register("project_list", oracle("SELECT project, count(DISTINCT session_id) AS sessions, CAST(sum(strlen(content)) AS BIGINT) AS bytes, max(ts_raw) AS newest FROM blocks GROUP BY 1"))
def project_list(spark, d):
    return D.project_list(blocks(spark, d))


@register("store_status", oracle("SELECT count(*) AS files, count(*) FILTER (WHERE pos % 3 = 0) AS markdown, count(*) FILTER (WHERE pos % 3 = 1) AS json, CAST(sum(strlen(content)) AS BIGINT) AS bytes, count(DISTINCT project) AS projects FROM blocks"))
def store_status(spark, d):
    ext = F.when(F.col("pos") % 3 == 0, ".md").when(F.col("pos") % 3 == 1, ".json").otherwise(".txt")
    return D.store_status(blocks(spark, d).select("project", F.concat("session_id", ext).alias("path"), F.octet_length("content").cast("long").alias("size")))


@register("pack_health", oracle("SELECT id, issue FROM (SELECT id, unnest([CASE WHEN id % 5 = 0 THEN 'invalid_manifest' END, CASE WHEN id % 7 = 0 THEN 'no_knowledge' END, CASE WHEN registry = 3 THEN 'orphaned' END]) AS issue FROM packs) WHERE issue IS NOT NULL"))
def pack_health(spark, d):
    p = packs(spark, d)
    rows = p.select("id", "registry", F.when(F.col("id") % 5 != 0, "1.0").alias("version"), F.when(F.col("id") % 7 == 0, 0).otherwise(2).alias("n_files"))
    return D.pack_health(rows, p.where("registry < 3").select("registry").distinct())


@register("pack_gate", oracle("SELECT project AS pack, count(*) AS files, count(*) FILTER (WHERE pos % 50 = 1) AS secrets, count(*) FILTER (WHERE pos % 50 = 1) = 0 AS allowed FROM blocks WHERE category IN ('patterns', 'solutions') GROUP BY 1"))
def pack_gate(spark, d):
    key = F.concat(F.lit("\nAKIA"), F.repeat(F.lit("A1B2"), F.lit(4)))
    files = blocks(spark, d).select(F.col("project").alias("pack"), "category", F.when(F.col("pos") % 50 == 1, F.concat("content", key)).otherwise(F.col("content")).alias("content"))
    return D.pack_gate(files)


@register("graph_json", oracle("SELECT pos AS id, session_id AS src, 'x' AS dst, 'uses' AS rel_type, CASE WHEN pos % 2 = 0 THEN 0.5e0 ELSE 0.9e0 END AS strength FROM blocks WHERE pos % 3 <> 0"))
def graph_json(spark, d):
    b = blocks(spark, d)
    kind = F.when(F.col("pos") % 3 == 0, "unknown").otherwise("Uses")
    body = F.concat(F.lit('{"concepts": [], "relationships": [{"from": "'), F.col("session_id"), F.lit('", "to": "x", "type": "'), kind, F.lit('"'), F.when(F.col("pos") % 2 == 0, "").otherwise(', "strength": 0.9'), F.lit("}]}"))
    replies = b.select(F.col("pos").alias("id"), F.when(F.col("pos") % 4 < 2, F.concat(F.lit("Here:\n```json\n"), body, F.lit("\n```"))).otherwise(body).alias("reply"))
    return D.graph_of_json(replies, ["uses", "depends_on"], ["tool"])


def _place(spark, name):
    return f"{stores.scratch(spark)}/stores/{name}-{uuid.uuid4().hex}"


@register("sink_events", oracle("SELECT strftime(ts, '%Y-%m-%d') AS date, count(*) AS n FROM usage_events WHERE ts >= TIMESTAMP '2024-01-20' GROUP BY 1"))
def sink_events(spark, d):
    """Events appended in two parts by day, read back with the days pruned."""
    path, e = _place(spark, "events"), usage_events(spark, d)
    for k in (0, 1):
        stores.append_events(e.where(F.col("event_id") % 2 == k), path)
    return stores.read_events(spark, path, since="2024-01-20").groupBy("date").agg(F.count("*").alias("n"))


@register("sink_upsert", oracle("SELECT session_id, CASE WHEN pos % 10 = 0 THEN 'new' ELSE content END AS content FROM blocks"))
def sink_upsert(spark, d):
    """A block store written by project and category, then upserted: only touched partitions are rewritten."""
    path, b = _place(spark, "blocks"), blocks(spark, d)
    stores.write_blocks(b, path)
    stores.upsert_blocks(spark, path, b.where("pos % 10 = 0").withColumn("content", F.lit("new")))
    return stores.read_blocks(spark, path).select("session_id", "content")


@register("sink_markdown", oracle(f"SELECT 's' || pos AS session_id, category FROM blocks WHERE NOT {EXPIRED}"))
def sink_markdown(spark, d):
    """Markdown written by project and category, files read whole and parsed."""
    path = _place(spark, "markdown")
    stores.write_markdown(D.export_markdown(blocks(spark, d), now()), path)
    return stores.read_markdown(spark, path).select("session_id", "category")


@register("catalog_scan", oracle("SELECT project, count(DISTINCT category) AS files FROM blocks GROUP BY 1"))
def catalog_scan(spark, d):
    """Files of a store by project, from their paths."""
    path = _place(spark, "catalog")
    stores.write_blocks(blocks(spark, d), path)
    return stores.catalog(spark, path, "*.parquet").groupBy("project").agg(F.countDistinct("category").alias("files"))


@register("inbox_review", oracle(f"SELECT session_id, {EXPIRED} AS expired FROM blocks WHERE category = 'questions'"))
def inbox_review(spark, d):
    return B.with_expiry(blocks(spark, d).where("category = 'questions'"), now()).select("session_id", "expired")


@register("inbox_promote", oracle("SELECT session_id, CASE WHEN session_id = 's5:dec' THEN 'decisions' ELSE category END AS category FROM (SELECT CASE WHEN session_id = 's5' THEN 's5:dec' ELSE session_id END AS session_id, category FROM blocks)"))
def inbox_promote(spark, d):
    b = blocks(spark, d)
    moved = b.where("session_id = 's5'").withColumn("session_id", F.lit("s5:dec")).withColumn("category", F.lit("decisions"))
    return B.forget(b, b.where("session_id = 's5'")).unionByName(moved).select("session_id", "category")
