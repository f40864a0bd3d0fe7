"""Queries of usage analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import analytics as A
from quillspark.plans.catalog import register
from quillspark.sources.views import NOW, chunks, now, observations, oracle, tool_uses, turns, usage_events

_SCORES = f"""scores AS (SELECT key, category, label, access_count, last_accessed, access_count / max(access_count) OVER () AS frequency, exp(-date_sub('day', last_accessed, TIMESTAMP '{NOW}') / 30.0e0) AS recency
  FROM (SELECT category || ':' || COALESCE(query, 'unknown') AS key, min(category) AS category, COALESCE(min(query), '') AS label, count(*) AS access_count, max(ts) AS last_accessed FROM usage_events WHERE category IS NOT NULL GROUP BY 1))"""
_SHOWN = "key, access_count, round(frequency, 6) AS frequency, round(recency, 6) AS recency, round(0.6e0 * frequency + 0.4e0 * recency, 6) AS importance"


def _show(df):
    return df.select("key", "access_count", *(F.round(c, 6).alias(c) for c in ("frequency", "recency", "importance")))


def _scores(spark, d):
    return A.knowledge_scores(usage_events(spark, d), now())


@register("knowledge_scores", oracle(f"WITH {_SCORES} SELECT {_SHOWN} FROM scores"))
def knowledge_scores(spark, d):
    return _show(_scores(spark, d))


@register("top_knowledge", oracle(f"WITH {_SCORES} SELECT {_SHOWN} FROM scores ORDER BY 0.6e0 * frequency + 0.4e0 * recency DESC, key LIMIT 10"))
def top_knowledge(spark, d):
    return _show(A.top_knowledge(_scores(spark, d), 10))


@register("stale_knowledge", oracle(f"WITH {_SCORES} SELECT {_SHOWN} FROM scores WHERE recency < 0.97e0"))
def stale_knowledge(spark, d):
    return _show(A.stale_knowledge(_scores(spark, d), 0.97))


@register(
    "usage_insights",
    oracle("""SELECT (SELECT count(*) FROM usage_events) AS total_events, (SELECT count(DISTINCT project) FROM usage_events) AS unique_projects,
  (SELECT project FROM usage_events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_active_project,
  (SELECT event_type FROM usage_events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1) AS most_common_event,
  (SELECT CAST(COALESCE(sum(tokens), 0) AS BIGINT) FROM usage_events WHERE event_type = 'Ingest') AS tokens_ingested,
  (SELECT CASE WHEN count(*) % 2 = 1 THEN 'increasing' ELSE 'stable' END FROM usage_events) AS trend,
  (SELECT round((count(*) - 2 * (count(*) // 2)) / (count(*) // 2) * 100.0e0, 6) FROM usage_events) AS trend_pct"""),
)
def usage_insights(spark, d):
    return A.insights(usage_events(spark, d))


@register("command_breakdown", oracle("SELECT event_type, count(*) AS n FROM usage_events GROUP BY 1"))
def command_breakdown(spark, d):
    return A.breakdown(usage_events(spark, d))


@register("events_window", oracle(f"SELECT event_id, event_type, query FROM usage_events WHERE project = 'proj3' AND ts >= TIMESTAMP '{NOW}' - INTERVAL 14 DAY"))
def events_window(spark, d):
    return A.events_window(usage_events(spark, d), now(), "proj3", 14).select("event_id", "event_type", "query")


@register("event_retention", oracle(f"SELECT event_id, event_type FROM usage_events WHERE date_trunc('day', ts) >= TIMESTAMP '{NOW}' - INTERVAL 10 DAY"))
def event_retention(spark, d):
    return A.retained(usage_events(spark, d), now(), 10).select("event_id", "event_type")


@register("tool_usage_rollup", oracle("SELECT project, tool, count(*) AS n FROM (SELECT 'p' || (session_id % 5) AS project, tool FROM tool_uses) GROUP BY GROUPING SETS ((project, tool), (tool))"))
def tool_usage_rollup(spark, d):
    uses = tool_uses(spark, d).select(F.concat(F.lit("p"), (F.col("session_id") % 5).cast("string")).alias("project"), "tool")
    return A.tool_rollup(uses)


@register("usage_merge", oracle("SELECT event_type AS key, CAST(sum(n) AS BIGINT) AS n FROM (SELECT event_type, count(*) AS n FROM usage_events WHERE event_id % 2 = 0 GROUP BY 1 UNION ALL SELECT event_type, count(*) FROM usage_events WHERE event_id % 2 = 1 GROUP BY 1) GROUP BY 1"))
def usage_merge(spark, d):
    e = usage_events(spark, d)
    part = lambda k: e.where(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("key")).agg(F.count("*").alias("n"))
    return A.merge_counters(part(0), part(1))


@register("activity_dedup", oracle("SELECT session_id, 'old' AS origin FROM usage_events WHERE event_type = 'Add' GROUP BY 1 UNION ALL SELECT DISTINCT session_id, 'new' FROM usage_events WHERE event_type = 'Lookup' AND session_id NOT IN (SELECT session_id FROM usage_events WHERE event_type = 'Add')"))
def activity_dedup(spark, d):
    e = usage_events(spark, d)
    part = lambda kind, origin: e.where(F.col("event_type") == kind).select("session_id", F.lit(origin).alias("origin")).distinct()
    return A.first_activity(part("Add", "old"), part("Lookup", "new"))


@register("store_stats", oracle("SELECT category, project, count(*) AS n FROM chunks GROUP BY GROUPING SETS ((category), (project))"))
def store_stats(spark, d):
    return A.corpus_stats(chunks(spark, d))


@register("observation_files", oracle("SELECT session_id, file, row_number() OVER (PARTITION BY session_id ORDER BY first_ts, first_id) AS nth FROM (SELECT session_id, file, min(ts) AS first_ts, arg_min(event_id, (ts, event_id)) AS first_id FROM observations GROUP BY 1, 2)"))
def observation_files(spark, d):
    return A.observed_files(observations(spark, d))


@register("observation_day", oracle("SELECT tool, count(*) AS n, count(DISTINCT file) AS files FROM observations WHERE ts >= TIMESTAMP '2024-01-10' AND ts < TIMESTAMP '2024-01-11' GROUP BY 1"))
def observation_day(spark, d):
    o = observations(spark, d).where("ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts < TIMESTAMP '2024-01-11 00:00:00'")
    return o.groupBy("tool").agg(F.count("*").alias("n"), F.countDistinct("file").alias("files"))


@register("log_tail", oracle("SELECT event_id FROM usage_events ORDER BY event_id DESC LIMIT 2500"))
def log_tail(spark, d):
    return A.keep_last(usage_events(spark, d), "event_id", 2500).select("event_id")


@register("daily_activity", oracle("SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM usage_events GROUP BY 1, 2"))
def daily_activity(spark, d):
    return A.activity_by_day(usage_events(spark, d))


@register("session_projects", oracle("SELECT session_id, count(*) AS turns, CAST(sum(octet_length(encode(text))) AS BIGINT) AS bytes, max(pos) AS last_turn FROM turns GROUP BY 1"))
def session_projects(spark, d):
    """Catalog of sessions: turns, bytes and last position."""
    return turns(spark, d).groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(F.octet_length("text").cast("long")).alias("bytes"), F.max("pos").alias("last_turn"))
