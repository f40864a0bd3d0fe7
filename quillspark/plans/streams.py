"""Streaming queries, drained once."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators.maintenance import Kept
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import EXPIRED
from quillspark.sources.stores import scratch
from quillspark.sources.views import blocks, now, oracle
from quillspark.streaming import states
from quillspark.streaming import streams as S


@register("stream_daily_counts", "SELECT strftime(ts, '%Y-%m-%d') AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    return S.drain(S.daily_counts(S.events(spark, d)), "complete")


@register("stream_first_files", "SELECT DISTINCT user_id AS session, CAST(json_extract(props, '$.k') AS VARCHAR) AS file FROM events WHERE event_type IN ('purchase', 'click')")
def stream_first_files(spark, d):
    return S.drain(S.first_files(S.events(spark, d)), "append")


@register("stream_importance", "SELECT user_id, count(*) AS n, round((0.6e0 + (least(greatest(0.12e0, 0.1e0), 1.0e0) - 0.6e0) * power(0.8e0, count(*) - 1)) * 0.98e0, 6) AS value FROM events GROUP BY 1")
def stream_importance(spark, d):
    return S.drain(S.importance(S.events(spark, d)), "update", ["user_id"]).withColumn("value", F.round("value", 6))


@register("x_session_windows", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS fresh FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
  SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n FROM s GROUP BY user_id, k""")
def x_session_windows(spark, d):
    return S.drain(S.sessions(S.events(spark, d)), "complete").select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n")


@register("x_sliding_counts", "SELECT strftime(s, '%Y-%m-%d') AS start, count(*) AS n FROM (SELECT unnest([date_trunc('day', ts), date_trunc('day', ts) - INTERVAL 1 DAY]) AS s FROM events) GROUP BY 1")
def x_sliding_counts(spark, d):
    return S.drain(S.sliding_counts(S.events(spark, d)), "complete").select(F.date_format("start", "yyyy-MM-dd").alias("start"), "n")


@register("stream_counters", "SELECT event_type AS key, count(*) AS n FROM events GROUP BY 1")
def stream_counters(spark, d):
    """Counters kept by foreachBatch, summed over the batches."""
    path = f"{scratch(spark)}/counters/{uuid.uuid4().hex}"
    S.keep_counters(S.events(spark, d), path)
    return spark.read.parquet(path).groupBy("key").agg(F.sum("n").alias("n"))


@register("stream_expiry", "SELECT user_id, strftime(max(ts) + INTERVAL 36 HOUR, '%Y-%m-%d %H:%M:%S') AS until FROM events GROUP BY 1 HAVING max(ts) + INTERVAL 36 HOUR < (SELECT max(ts) FROM events)")
def stream_expiry(spark, d):
    """Users whose state ran out before the stream's last event."""
    return S.drain(S.expiring(S.events(spark, d)), "append").select("user_id", F.date_format(F.timestamp_millis("until"), "yyyy-MM-dd HH:mm:ss").alias("until"))


@register("stream_recent", "SELECT user_id, count(*) AS n, arg_min(event_id, (epoch_ms(ts), event_id)) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS nth FROM events) WHERE nth <= 100 GROUP BY 1")
def stream_recent(spark, d):
    return S.drain(S.recent(S.events(spark, d)), "update", ["user_id"])


@register("stream_distill", "SELECT user_id % 10 AS grp, count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11') AS n, count(*) FILTER (WHERE ts < TIMESTAMP '2024-01-11') AS dropped FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE ts >= TIMESTAMP '2024-01-11') > 30")
def stream_distill(spark, d):
    """Groups that have gathered more than a threshold of events, old ones left out."""
    return S.drain(S.distilled(S.events(spark, d), F.lit("2024-04-10 00:00:00").cast("timestamp")), "complete")


@register("stream_ingest", "SELECT 's' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN 2 ELSE 1 END AS times FROM documents")
def stream_ingest(spark, d):
    """All texts, then all again of which a third has changed: how often each was ingested."""
    base = f"{scratch(spark)}/ingest/{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    name = F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("name")
    for part in (0, 1):
        changed = F.concat("text", F.lit(" changed"))
        docs.select(name, F.when((F.lit(part) == 1) & (F.col("doc_id") % 3 == 0), changed).otherwise(F.col("text")).alias("text")).write.parquet(f"{base}/in/part{part}")
        # A run takes all files of its part as one batch and goes on from the one before.
        stream = spark.readStream.schema("name string, text string").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").parquet(f"{base}/in")
        S.ingest_changed(stream, f"{base}/out", f"{base}/progress")
    return spark.read.parquet(f"{base}/out/texts").groupBy("name").agg(F.count("*").alias("times"))


@register("stream_cycle", "SELECT * FROM (SELECT 0 AS place, 'ingest' AS step, 'done' AS state, count(*) AS n FROM events UNION ALL SELECT 1, 'inject', 'ValueError', 0 UNION ALL SELECT 2, 'distill', 'done', count(*) FROM events WHERE event_type = 'error' UNION ALL SELECT 3, 'doctor', 'done', count(DISTINCT user_id) FROM events)")
def stream_cycle(spark, d):
    """The cycle over one batch of events; its second step fails."""
    path = f"{scratch(spark)}/cycle/{uuid.uuid4().hex}"

    def broken(batch):
        raise ValueError("no store")

    steps = [("ingest", lambda b: b.count()), ("inject", broken), ("distill", lambda b: b.where("event_type = 'error'").count()), ("doctor", lambda b: b.select("user_id").distinct().count())]
    S.cycle(S.events(spark, d), steps, path)
    return spark.read.parquet(path).select("place", "step", "state", "n")


_GONE = "max(ts) + INTERVAL 36 HOUR < (SELECT max(ts) FROM events)"
_STEP = "(0.6e0 + (least(greatest(v + (0.6e0 - v) * 0.2e0, 0.1e0), 1.0e0) - 0.6e0) * power(0.8e0, n - 1)) * 0.98e0"
_LEARNED = f"""WITH h AS (SELECT user_id, arg_min(event_id, (epoch_ms(ts), event_id)) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY epoch_ms(ts) DESC, event_id DESC) AS nth FROM events) WHERE nth <= 10 GROUP BY 1),
  u AS (SELECT user_id, CASE WHEN user_id % 2 = 0 THEN (user_id % 10) / 10.0e0 ELSE 0 END AS v, count(*) AS n, count(DISTINCT event_type) AS kinds, {_GONE} AS gone FROM events GROUP BY 1)"""


def _learned(spark, d):
    """Users of even number have learned something before."""
    e = S.events(spark, d)
    start = spark.read.parquet(f"{d}/events.parquet").where("user_id % 2 = 0").select("user_id").distinct().select("user_id", ((F.col("user_id") % 10) / 10.0).alias("value"))
    return states.learned(e, start, most=10)


@register("stream_learned", f"{_LEARNED} SELECT user_id, state, n, kinds, oldest, round({_STEP}, 6) AS value FROM u JOIN h USING (user_id) CROSS JOIN (SELECT unnest(['held', 'expired']) AS state) WHERE gone OR state = 'held'")
def stream_learned(spark, d):
    """What each user's state held when the events were read, and once more where its timer ran out before the last event."""
    return states.run(_learned(spark, d), "update", states.fresh(spark)).drop("batch").withColumn("value", F.round("value", 6))


@register("stream_state_left", f"WITH {_LEARNED[5:]} SELECT e.user_id, event_type, count(*) AS n FROM events e JOIN u ON u.user_id = e.user_id WHERE NOT gone GROUP BY 1, 2")
def stream_state_left(spark, d):
    """Counts by type of event, read from the state store after the run: only of users whose state hasn't run out."""
    path = states.fresh(spark)
    states.run(_learned(spark, d), "update", path)
    return states.state(spark, path, "kinds").select("key.user_id", "user_map_key.event_type", F.col("user_map_value.n").alias("n"))


@register("stream_maintenance", oracle(f"""WITH a AS (SELECT * FROM blocks WHERE NOT {EXPIRED}), p AS (SELECT count(DISTINCT project) AS n FROM a WHERE trim(content) <> '')
  SELECT 0 AS place, 'ingest' AS step, 'done' AS state, count(*) AS n FROM blocks UNION ALL SELECT 1, 'inject', 'done', n FROM p UNION ALL SELECT 2, 'distill', 'done', count(*) FROM blocks WHERE {EXPIRED}
  UNION ALL SELECT 3, 'doctor', 'done', 3 * n FROM p UNION ALL SELECT 4, 'quality', 'done', count(DISTINCT project) FROM a WHERE category <> 'procedures'"""))
def stream_maintenance(spark, d):
    """The cycle with the library's own steps, over all blocks as one batch into a new store."""
    base = f"{scratch(spark)}/maintenance/{uuid.uuid4().hex}"
    b = blocks(spark, d).drop("cat_ord")
    b.write.parquet(f"{base}/in")
    store = Kept(spark, f"{base}/store", now())
    S.cycle(spark.readStream.schema(b.schema).parquet(f"{base}/in"), store.steps(), f"{base}/log")
    return spark.read.parquet(f"{base}/log").select("place", "step", "state", "n")


_LINE = "left(string_split(ltrim(content, ' '), chr(10))[1], 200)"


@register("heal_contexts", oracle(f"""WITH l AS (SELECT project, ts, pos, {_LINE} AS line FROM blocks WHERE NOT {EXPIRED}), r AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY ts DESC, pos) AS nth FROM l WHERE line <> '')
  SELECT project, string_agg(line, chr(10) ORDER BY nth) AS context FROM r WHERE nth <= 50 GROUP BY 1"""))
def heal_contexts(spark, d):
    """Contexts after the repairs of a store that has blocks alone; the provider gives back what it was shown."""
    store = Kept(spark, f"{scratch(spark)}/stores/healed-{uuid.uuid4().hex}", now())
    store.ingest(blocks(spark, d).drop("cat_ord"))
    store.heal()
    return store.contexts().select("project", "context")


@register("heal_graph", oracle(f"SELECT DISTINCT project, unnest(regexp_extract_all(content, '[a-z]{{7,}}')[1:3]) AS concept FROM blocks WHERE NOT {EXPIRED}"))
def heal_graph(spark, d):
    """Concepts after the same repairs, as the provider of graphs found them in each block."""
    store = Kept(spark, f"{scratch(spark)}/stores/healed-{uuid.uuid4().hex}", now())
    store.ingest(blocks(spark, d).drop("cat_ord"))
    store.heal()
    return store.concepts().select("project", "concept")
