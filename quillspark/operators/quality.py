"""Quality reports over the block store: category statistics, scores, health."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions.scoring import days_between, expired, ttl_seconds

#: Points that an issue of each severity costs.
PENALTY = {"critical": 20, "warning": 10, "info": 5}


def _days_left(now: Column) -> Column:
    end = F.timestamp_micros(F.unix_micros("ts") + ttl_seconds(F.col("ttl")) * 1_000_000)
    return days_between(now, end)


def category_quality(blocks: DataFrame, now: Column, by: tuple[str, ...] = ("project", "category")) -> DataFrame:
    """Counts of a category's active blocks, and of its expired ones."""
    n = lambda c: F.count_if(c & ~F.col("gone"))
    rows = blocks.withColumn("gone", expired(F.col("ts"), F.col("ttl"), now)).withColumn("age", days_between(F.col("ts"), now)).withColumn("left", _days_left(now))
    has_ttl = F.col("ttl").isNotNull() & (F.col("ttl") != "never")
    level = lambda v: F.coalesce(F.col("confidence") == v, F.lit(False))
    return rows.groupBy(*by).agg(
        n(F.lit(True)).alias("total"),
        F.count_if("gone").alias("expired"),
        n(level("high")).alias("high"),
        n(level("medium")).alias("medium"),
        n(level("low")).alias("low"),
        n(~level("high") & ~level("medium") & ~level("low")).alias("unknown"),
        n(F.coalesce(F.col("confidence"), F.lit("")) == "").alias("unset"),
        n(has_ttl).alias("with_ttl"),
        n(has_ttl & F.col("left").between(0, 7)).alias("this_week"),
        n(has_ttl & F.col("left").between(8, 30)).alias("this_month"),
        n(has_ttl & (F.col("left") > 30)).alias("later"),
        n(F.col("age") > 30).alias("stale"),
        n(F.col("age") <= 7).alias("recent"),
    )


def _score(stale: Column, low: Column, unknown: Column, gone: Column, categories: Column, total: Column) -> Column:
    pct = lambda x: F.floor(x * 100 / total)
    return (
        100
        - F.when(pct(stale) > 50, 20).when(pct(stale) > 25, 10).otherwise(0)
        - F.when(pct(low) > 20, 10).otherwise(0)
        - F.when(pct(unknown) > 50, 5).otherwise(0)
        - F.when(gone > 5, 5).otherwise(0)
        - F.when(categories < 3, 10).otherwise(0)
    )


def reflect_score(blocks: DataFrame, now: Column) -> DataFrame:
    """Per project: totals over all categories and the quality score."""
    c = category_quality(blocks, now)
    sums = c.groupBy("project").agg(*(F.sum(x).alias(x) for x in ("total", "expired", "stale", "low", "unknown", "recent")), F.count_if(F.col("total") > 0).alias("categories")).where("total > 0")
    s = _score(F.col("stale"), F.col("low"), F.col("unknown"), F.col("expired"), F.col("categories"), F.col("total"))
    return sums.select("project", "total", "expired", "categories", F.floor(F.col("stale") * 100 / F.col("total")).alias("stale_pct"), "recent", s.cast("int").alias("score"))


def project_quality(blocks: DataFrame, now: Column) -> DataFrame:
    """The other rule: without procedures, expired ones only of categories that have active ones, unset levels as unknown."""
    c = category_quality(blocks.where("category <> 'procedures'"), now).where("total > 0")
    sums = c.groupBy("project").agg(*(F.sum(x).alias(x) for x in ("total", "expired", "stale", "low", "unset", "recent")), F.count("*").alias("categories"))
    s = F.greatest(F.lit(0), _score(F.col("stale"), F.col("low"), F.col("unset"), F.col("expired"), F.col("categories"), F.col("total")))
    return sums.select("project", "total", "categories", F.floor(F.col("stale") * 100 / F.col("total")).alias("stale_pct"), "recent", s.cast("int").alias("score"))


def quality_overview(quality: DataFrame) -> DataFrame:
    """Whole mean of the scores, the number of projects and the worst of those under 75."""
    return quality.agg(F.count("*").alias("projects"), F.floor(F.sum("score") / F.count("*")).alias("mean_score"), F.count_if(F.col("score") < 75).alias("under_75"), F.min_by("project", F.struct("score", "project")).alias("worst"))


def expiry_histogram(blocks: DataFrame, now: Column) -> DataFrame:
    left = _days_left(now)
    bucket = F.when(F.col("ttl").isNull() | (F.col("ttl") == "never"), "permanent").when(left <= 7, "week").when(left <= 30, "month").otherwise("later")
    return blocks.where(~expired(F.col("ts"), F.col("ttl"), now)).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


def issues(projects: DataFrame) -> DataFrame:
    """Rows of issues from one row of figures a project: a rule each, exploded from an array."""
    rule = lambda when, severity, category: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(category).alias("issue")))
    rules = F.array(
        rule(F.col("total") == 0, "critical", "no_active_knowledge"),
        rule(F.col("newest_age") > 30, "warning", "stale_context"),
        rule(F.col("bytes") > 5_000_000, "warning", "large_files"),
        rule(F.col("questions") > 10, "info", "inbox_backlog"),
        rule(F.col("expired") > 0, "info", "expired_entries"),
    )
    return projects.select("project", F.explode(F.array_compact(rules)).alias("i")).select("project", "i.severity", "i.issue")


def project_figures(blocks: DataFrame, now: Column) -> DataFrame:
    gone = expired(F.col("ts"), F.col("ttl"), now)
    return blocks.groupBy("project").agg(
        F.count_if(~gone).alias("total"),
        F.count_if(gone).alias("expired"),
        F.min(days_between(F.col("ts"), now)).alias("newest_age"),
        F.sum(F.octet_length("content").cast("long")).alias("bytes"),
        F.count_if(~gone & (F.col("category") == "questions")).alias("questions"),
    )


def health(issues_: DataFrame, projects: DataFrame) -> DataFrame:
    """Score 100 less each issue's points, 0 at least, and its label."""
    cost = F.coalesce(F.sum(F.when(F.col("severity") == "critical", PENALTY["critical"]).when(F.col("severity") == "warning", PENALTY["warning"]).when(F.col("severity") == "info", PENALTY["info"])), F.lit(0))
    scored = projects.select("project").join(issues_, "project", "left").groupBy("project").agg(F.greatest(F.lit(0), 100 - cost).cast("int").alias("score"), F.count("severity").alias("issues"))
    s = F.col("score")
    return scored.withColumn("status", F.when(s >= 90, "excellent").when(s >= 75, "good").when(s >= 50, "fair").when(s >= 25, "poor").otherwise("critical"))


def distill_candidates(blocks: DataFrame, now: Column, more_than: int = 30) -> DataFrame:
    return blocks.where(~expired(F.col("ts"), F.col("ttl"), now)).groupBy("project").agg(F.count("*").alias("active")).where(F.col("active") > more_than)


def stale_percentage(blocks: DataFrame, now: Column) -> DataFrame:
    old = F.col("ts") < now - F.make_dt_interval(days=F.lit(30))
    return blocks.groupBy("project").agg((F.count_if(old) * 100.0 / F.count("*")).alias("stale_pct"), (F.sum(F.octet_length("content").cast("long")) / 1048576.0).alias("size_mb"))
