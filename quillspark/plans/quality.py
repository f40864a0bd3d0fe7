"""Queries of quality and health."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import quality as Q
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import _TTL, EXPIRED
from quillspark.sources.views import NOW, blocks, now, oracle

_AGE = f"date_sub('day', ts, TIMESTAMP '{NOW}')"
_LEFT = f"date_sub('day', TIMESTAMP '{NOW}', ts + {_TTL})"
_C = f"""x AS (SELECT *, {EXPIRED} AS gone, {_AGE} AS age, {_LEFT} AS left_ FROM blocks), c AS (SELECT project, category, count(*) FILTER (WHERE NOT gone) AS total, count(*) FILTER (WHERE gone) AS expired,
  count(*) FILTER (WHERE NOT gone AND confidence = 'high') AS high, count(*) FILTER (WHERE NOT gone AND confidence = 'low') AS low, count(*) FILTER (WHERE NOT gone AND confidence IS NULL) AS unknown,
  count(*) FILTER (WHERE NOT gone AND ttl <> 'never') AS with_ttl, count(*) FILTER (WHERE NOT gone AND left_ BETWEEN 0 AND 7) AS this_week, count(*) FILTER (WHERE NOT gone AND left_ BETWEEN 8 AND 30) AS this_month,
  count(*) FILTER (WHERE NOT gone AND left_ > 30) AS later, count(*) FILTER (WHERE NOT gone AND age > 30) AS stale, count(*) FILTER (WHERE NOT gone AND age <= 7) AS recent FROM x GROUP BY 1, 2)"""
_SCORE = "CAST(100 - CASE WHEN stale * 100 // total > 50 THEN 20 WHEN stale * 100 // total > 25 THEN 10 ELSE 0 END - CASE WHEN low * 100 // total > 20 THEN 10 ELSE 0 END - CASE WHEN unknown * 100 // total > 50 THEN 5 ELSE 0 END - CASE WHEN expired > 5 THEN 5 ELSE 0 END - CASE WHEN categories < 3 THEN 10 ELSE 0 END AS INT)"
_SUMS = "CAST(sum(total) AS BIGINT) AS total, CAST(sum(expired) AS BIGINT) AS expired, CAST(sum(stale) AS BIGINT) AS stale, CAST(sum(low) AS BIGINT) AS low, CAST(sum(unknown) AS BIGINT) AS unknown, CAST(sum(recent) AS BIGINT) AS recent, count(*) FILTER (WHERE total > 0) AS categories"
_PROJECT = f"p AS (SELECT project, {_SUMS} FROM (SELECT * FROM c WHERE total > 0 AND category <> 'procedures') GROUP BY 1)"


@register("category_quality", oracle(f"WITH {_C} SELECT project, category, total, expired, high, low, unknown, with_ttl, this_week, this_month, later, stale, recent FROM c"))
def category_quality(spark, d):
    return Q.category_quality(blocks(spark, d), now()).drop("medium", "unset")


@register("reflect_score", oracle(f"WITH {_C}, s AS (SELECT project, {_SUMS} FROM c GROUP BY 1) SELECT project, total, expired, categories, stale * 100 // total AS stale_pct, recent, {_SCORE} AS score FROM s WHERE total > 0"))
def reflect_score(spark, d):
    return Q.reflect_score(blocks(spark, d), now())


@register("project_quality", oracle(f"WITH {_C}, {_PROJECT} SELECT project, total, categories, stale * 100 // total AS stale_pct, recent, {_SCORE} AS score FROM p"))
def project_quality(spark, d):
    return Q.project_quality(blocks(spark, d), now())


@register("quality_overview", oracle(f"WITH {_C}, {_PROJECT}, q AS (SELECT project, {_SCORE} AS score FROM p) SELECT count(*) AS projects, CAST(sum(score) // count(*) AS BIGINT) AS mean_score, count(*) FILTER (WHERE score < 75) AS under_75, arg_min(project, (score, project)) AS worst FROM q"))
def quality_overview(spark, d):
    return Q.quality_overview(Q.project_quality(blocks(spark, d), now()))


@register("ttl_histogram", oracle(f"SELECT CASE WHEN ttl IS NULL OR ttl = 'never' THEN 'permanent' WHEN {_LEFT} <= 7 THEN 'week' WHEN {_LEFT} <= 30 THEN 'month' ELSE 'later' END AS bucket, count(*) AS n FROM blocks WHERE NOT {EXPIRED} GROUP BY 1"))
def ttl_histogram(spark, d):
    return Q.expiry_histogram(blocks(spark, d), now())


_FIGURES = f"f AS (SELECT project, count(*) FILTER (WHERE NOT {EXPIRED}) AS total, count(*) FILTER (WHERE {EXPIRED}) AS expired, min({_AGE}) AS newest_age, sum(octet_length(encode(content))) AS bytes, count(*) FILTER (WHERE NOT {EXPIRED} AND category = 'questions') AS questions FROM blocks GROUP BY 1)"
_ISSUES = """i AS (SELECT project, 'critical' AS severity, 'no_active_knowledge' AS issue FROM f WHERE total = 0 UNION ALL SELECT project, 'warning', 'stale_context' FROM f WHERE newest_age > 30 UNION ALL
  SELECT project, 'warning', 'large_files' FROM f WHERE bytes > 5000000 UNION ALL SELECT project, 'info', 'inbox_backlog' FROM f WHERE questions > 10 UNION ALL SELECT project, 'info', 'expired_entries' FROM f WHERE expired > 0)"""


@register("health_issues", oracle(f"WITH {_FIGURES}, {_ISSUES} SELECT * FROM i"))
def health_issues(spark, d):
    return Q.issues(Q.project_figures(blocks(spark, d), now()))


@register("health_report", oracle(f"""WITH {_FIGURES}, {_ISSUES}, s AS (SELECT project, CAST(greatest(0, 100 - COALESCE(sum(CASE severity WHEN 'critical' THEN 20 WHEN 'warning' THEN 10 WHEN 'info' THEN 5 END), 0)) AS INT) AS score, count(severity) AS issues FROM f LEFT JOIN i USING (project) GROUP BY 1)
  SELECT *, CASE WHEN score >= 90 THEN 'excellent' WHEN score >= 75 THEN 'good' WHEN score >= 50 THEN 'fair' WHEN score >= 25 THEN 'poor' ELSE 'critical' END AS status FROM s"""))
def health_report(spark, d):
    figures = Q.project_figures(blocks(spark, d), now())
    return Q.health(Q.issues(figures), figures)


@register("distill_candidates", oracle(f"SELECT project, count(*) AS active FROM blocks WHERE NOT {EXPIRED} GROUP BY 1 HAVING count(*) > 30"))
def distill_candidates(spark, d):
    return Q.distill_candidates(blocks(spark, d), now())


@register("stale_percentage", oracle(f"SELECT project, round(count(*) FILTER (WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 30 DAY) * 100.0e0 / count(*), 6) AS stale_pct, round(sum(octet_length(encode(content))) / 1048576.0e0, 6) AS size_mb FROM blocks GROUP BY 1"))
def stale_percentage(spark, d):
    return Q.stale_percentage(blocks(spark, d), now()).select("project", F.round("stale_pct", 6).alias("stale_pct"), F.round("size_mb", 6).alias("size_mb"))
