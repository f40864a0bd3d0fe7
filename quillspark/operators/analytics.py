"""Usage analytics: scores of knowledge, insights, roll-ups, retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.scoring import days_between


def events_window(events: DataFrame, now: Column, project: str | None = None, days: int | None = None) -> DataFrame:
    """Events of a project in the last days; both predicates reach the scan."""
    out = events if project is None else events.where(F.col("project") == project)
    return out if days is None else out.where(F.col("ts") >= now - F.make_dt_interval(days=F.lit(days)))


def knowledge_scores(events: DataFrame, now: Column) -> DataFrame:
    """Per category:query key: count, last access, frequency, recency and importance."""
    keyed = events.where("category IS NOT NULL").withColumn("key", F.concat(F.col("category"), F.lit(":"), F.coalesce("query", F.lit("unknown"))))
    grouped = keyed.groupBy("key").agg(F.count("*").alias("access_count"), F.max("ts").alias("last_accessed"), F.min("category").alias("category"), F.coalesce(F.min("query"), F.lit("")).alias("label"))
    # One number over all keys: pre-aggregated, then met by a one-row broadcast.
    most = grouped.agg(F.max("access_count").alias("most"))
    scored = grouped.crossJoin(F.broadcast(most)).withColumn("frequency", F.col("access_count") / F.col("most")).withColumn("recency", F.exp(-days_between(F.col("last_accessed"), now) / 30.0))
    return scored.withColumn("importance", 0.6 * F.col("frequency") + 0.4 * F.col("recency")).drop("most")


def top_knowledge(scores: DataFrame, n: int) -> DataFrame:
    return scores.orderBy(F.desc("importance"), "key").limit(n)


def stale_knowledge(scores: DataFrame, threshold: float = 0.1) -> DataFrame:
    return scores.where(F.col("recency") < threshold)


def insights(events: DataFrame) -> DataFrame:
    """One row: totals, the most active project, the most common event, ingested tokens and the trend over halves of the row count."""
    by_project = events.groupBy("project").agg(F.count("*").alias("n"))
    by_type = events.groupBy("event_type").agg(F.count("*").alias("n"))
    # The greatest count, ties to the least name.
    top = lambda df, name: df.agg(F.min_by(name, F.struct(-F.col("n"), F.col(name))).alias("best"), F.count("*").alias("distinct"))
    total = events.agg(F.count("*").alias("total_events"), F.sum(F.when(F.col("event_type") == "Ingest", F.col("tokens"))).alias("tokens_ingested"))
    n = F.col("total_events")
    half, rest = F.floor(n / 2), n - F.floor(n / 2)
    return (
        total.crossJoin(top(by_project, "project").select(F.col("best").alias("most_active_project"), F.col("distinct").alias("unique_projects")))
        .crossJoin(top(by_type, "event_type").select(F.col("best").alias("most_common_event")))
        .select("total_events", "unique_projects", "most_active_project", "most_common_event", F.coalesce("tokens_ingested", F.lit(0)).alias("tokens_ingested"), F.when(rest > half, "increasing").otherwise("stable").alias("trend"), F.when(half > 0, F.round((rest - half) / half * 100, 6)).alias("trend_pct"))
    )


def breakdown(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count("*").alias("n"))


def retained(events: DataFrame, now: Column, days: int) -> DataFrame:
    """Events whose day, from midnight, isn't before now minus days."""
    return events.where(F.date_trunc("day", "ts") >= now - F.make_dt_interval(days=F.lit(days)))


def tool_rollup(uses: DataFrame) -> DataFrame:
    """Uses by (project, tool) and over all projects: grouping sets."""
    return uses.groupingSets([[F.col("project"), F.col("tool")], [F.col("tool")]], "project", "tool").agg(F.count("*").alias("n"))


def merge_counters(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old and new counters added up by key."""
    return old.unionByName(new).groupBy("key").agg(F.sum("n").alias("n"))


def first_activity(old: DataFrame, new: DataFrame) -> DataFrame:
    """Old rows, and new ones for sessions that old doesn't have."""
    return old.unionByName(new.join(old.select("session_id").distinct(), "session_id", "left_anti"))


def corpus_stats(chunks: DataFrame) -> DataFrame:
    return chunks.groupingSets([[F.col("category")], [F.col("project")]], "category", "project").agg(F.count("*").alias("n"))


def keep_last(rows: DataFrame, order: str, n: int) -> DataFrame:
    """The last n rows by order: a top-n, not a window over everything."""
    return rows.orderBy(F.desc(order)).limit(n)


def observed_files(observations: DataFrame) -> DataFrame:
    """Distinct files of each session, numbered in the order first seen."""
    first = observations.groupBy("session_id", "file").agg(F.min(F.struct("ts", "event_id")).alias("first"))
    return first.withColumn("nth", F.row_number().over(Window.partitionBy("session_id").orderBy("first"))).select("session_id", "file", "nth")


def activity_by_day(events: DataFrame) -> DataFrame:
    return events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
