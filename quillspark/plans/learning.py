"""Queries of the learning operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import scoring as S
from quillspark.operators import learning as L
from quillspark.plans.catalog import register
from quillspark.sources.views import NOW, blocks, boosts, now, oracle, usage_events

_STEP = "least(greatest(s + (x.r - s) * x.a, 0.1e0), 1.0e0)"
_SIGNALS = """k AS (SELECT category || ':' || COALESCE(query, 'unknown') AS id, event_type, event_id, value FROM usage_events WHERE category IS NOT NULL),
  sg AS (SELECT id, 0 AS ord, event_id AS place, 0.3e0 AS r, 0.2e0 AS a FROM k WHERE event_type = 'Add' UNION ALL SELECT id, 1, 0, least(count(*) / 50.0e0, 0.6e0) + 0.8e0 * 0.4e0, 0.2e0 FROM k WHERE event_type IN ('Recall', 'Search', 'Lookup') GROUP BY 1 HAVING count(*) >= 3
    UNION ALL SELECT id, 2, event_id, CASE WHEN value > 50 THEN 0.5e0 ELSE -0.2e0 END * 1.5e0, 0.24e0 FROM k WHERE event_type = 'Ingest')"""


def _rewards(spark, d):
    e = usage_events(spark, d)
    outcomes = e.where("event_type = 'Ingest' AND category IS NOT NULL").select(F.concat_ws(":", "category", F.coalesce("query", F.lit("unknown"))).alias("id"), F.col("event_id").alias("at"), F.when(F.col("value") > 50, 0.5).otherwise(-0.2).alias("reward"))
    return L.signals(e).withColumn("at", F.lit(0).cast("long")).unionByName(L.outcome_rewards(outcomes))


@register("td_importance", oracle(f"WITH {_SIGNALS} SELECT id, round(greatest(list_reduce(list_prepend({{'r': 0.0e0, 'a': 0.0e0, 's': 0.0e0}}, list({{'r': r, 'a': a, 's': 0.0e0}} ORDER BY ord, place)), lambda s, x: {{'r': 0.0e0, 'a': 0.0e0, 's': least(greatest(s.s + (x.r - s.s) * x.a, 0.1e0), 1.0e0)}}).s * 0.98e0, 0), 6) AS value FROM sg GROUP BY id"))
def td_importance(spark, d):
    return L.fold(_rewards(spark, d)).select("id", F.round("value", 6).alias("value"))


@register("frequent_signals", oracle("SELECT category || ':' || COALESCE(query, 'unknown') AS id, round(least(count(*) / 50.0e0, 0.6e0) + 0.32e0, 6) AS reward FROM usage_events WHERE category IS NOT NULL AND event_type IN ('Recall', 'Search', 'Lookup') GROUP BY 1 HAVING count(*) >= 3"))
def frequent_signals(spark, d):
    return L.signals(usage_events(spark, d)).where("ord = 1").select("id", F.round("reward", 6).alias("reward"))


_TIERS = f"t AS (SELECT session_id, pos, boost, CASE WHEN boost >= 0.7 THEN 'High' WHEN boost >= 0.4 THEN 'Medium' ELSE 'Low' END AS importance, CASE WHEN boost >= 0.5 THEN 'Frequent' WHEN boost >= 0.2 THEN 'Occasional' ELSE 'Rare' END AS frequency, CASE WHEN date_sub('day', ts, TIMESTAMP '{NOW}') < 7 THEN 'Recent' WHEN date_sub('day', ts, TIMESTAMP '{NOW}') < 30 THEN 'Normal' ELSE 'Stale' END AS recency FROM (SELECT *, (pos % 10) / 10.0e0 AS boost FROM blocks))"
_POLICY = "CASE WHEN boost >= 0.7 AND recency = 'Recent' THEN {0} WHEN boost >= 0.7 THEN {1} WHEN boost >= 0.4 AND recency <> 'Stale' THEN {2} WHEN boost >= 0.4 THEN {3} WHEN recency = 'Stale' THEN {4} ELSE {5} END"
_ACTION = _POLICY.format("'MakePermanent'", "'Extend90d'", "'Extend30d'", "'Extend7d'", "'Reduce7d'", "'Reduce1d'")
_REWARD = _POLICY.format("1.0e0", "0.8e0", "0.6e0", "0.4e0", "0.5e0", "0.3e0")


def _tiered(spark, d):
    b = blocks(spark, d).withColumn("boost", (F.col("pos") % 10) / 10.0)
    t = b.select("session_id", "pos", "boost", S.tiers(F.col("boost"), F.col("ts"), now()).alias("t")).select("session_id", "pos", "boost", "t.*")
    return t.withColumn("p", L.policy(F.col("boost"), F.col("recency"))).select("*", "p.action", "p.reward")


@register("ttl_tiers", oracle(f"WITH {_TIERS} SELECT session_id, importance, frequency, recency FROM t"))
def ttl_tiers(spark, d):
    return _tiered(spark, d).select("session_id", "importance", "frequency", "recency")


@register("q_table", oracle(f"WITH {_TIERS} SELECT importance || '/' || recency AS state, {_ACTION} AS action, round({_REWARD} * 10 * (1 - power(0.99e0, count(*))), 6) AS q, count(*) AS n FROM t GROUP BY 1, 2, {_REWARD}"))
def q_table(spark, d):
    states = _tiered(spark, d).select(F.concat_ws("/", "importance", "recency").alias("state"), "action", "reward")
    return L.q_values(states).select("state", "action", F.round("q", 6).alias("q"), "n")


@register("greedy_actions", oracle(f"WITH {_TIERS}, q AS (SELECT recency AS state, {_ACTION} AS action, round({_REWARD} * 10 * (1 - power(0.99e0, count(*))), 9) AS q FROM t GROUP BY 1, 2, {_REWARD}) SELECT state, arg_max(action, (q, list_position({L.ACTIONS}, action))) AS action FROM q GROUP BY 1"))
def greedy_actions(spark, d):
    states = _tiered(spark, d).select(F.col("recency").alias("state"), "action", "reward")
    return L.greedy(L.q_values(states).withColumn("q", F.round("q", 9)))


@register("ttl_policy", oracle(f"""WITH {_TIERS}, a AS (SELECT session_id, pos % 40 AS days, {_ACTION} AS action FROM t)
  SELECT session_id, action, CASE action WHEN 'MakePermanent' THEN NULL WHEN 'Extend90d' THEN days + 90 WHEN 'Extend30d' THEN days + 30 WHEN 'Extend7d' THEN days + 7 WHEN 'Reduce7d' THEN greatest(days - 7, 1) WHEN 'Reduce1d' THEN greatest(days - 1, 1) END AS days FROM a"""))
def ttl_policy(spark, d):
    return _tiered(spark, d).select("session_id", "action", S.ttl_after(F.col("action"), F.col("pos") % 40).alias("days"))


@register("bandit_arms", oracle("SELECT event_id % 4 AS arm, round(avg(value / 100), 6) AS mean, count(*) AS pulls FROM usage_events GROUP BY 1"))
def bandit_arms(spark, d):
    h = usage_events(spark, d).select((F.col("event_id") % 4).alias("arm"), (F.col("value") / 100).alias("reward"))
    return L.arms(h).select("arm", F.round("mean", 6).alias("mean"), "pulls")


@register("bandit_best", oracle("SELECT arm, mean FROM (SELECT event_id % 4 AS arm, round(avg(value / 100), 6) AS mean FROM usage_events GROUP BY 1) ORDER BY mean DESC, arm DESC LIMIT 1"))
def bandit_best(spark, d):
    h = usage_events(spark, d).select((F.col("event_id") % 4).alias("arm"), (F.col("value") / 100).alias("reward"))
    return L.best_arm(L.arms(h).withColumn("mean", F.round("mean", 6)))


_HISTORY = "h AS (SELECT event_id AS seq, CAST(90 + event_id % 7 AS INT) AS health FROM usage_events)"


def _history(spark, d):
    return usage_events(spark, d).select(F.col("event_id").alias("seq"), (90 + F.col("event_id") % 7).cast("int").alias("health"))


@register("converged", oracle(f"WITH {_HISTORY}, l AS (SELECT * FROM h ORDER BY seq DESC LIMIT 10) SELECT count(*) >= 10 AS enough, round(var_pop(health), 6) AS variance, count(*) >= 10 AND var_pop(health) < 10 AS converged FROM l"))
def converged(spark, d):
    return L.converged(_history(spark, d)).withColumn("variance", F.round("variance", 6))


@register("learning_dashboard", oracle(f"WITH {_HISTORY} SELECT arg_min(health, seq) AS first, arg_max(health, seq) AS last, count(*) AS n, arg_max(health, seq) - arg_min(health, seq) AS change FROM h"))
def learning_dashboard(spark, d):
    return L.dashboard(_history(spark, d))


@register("preview_changes", oracle("SELECT session_id, 0.5e0 AS before, round(least(greatest(boost, 0.1e0), 1.0e0), 6) AS after FROM (SELECT key AS session_id, boost FROM boosts) JOIN blocks USING (session_id) WHERE abs(boost - 0.5e0) > 0.01"))
def preview_changes(spark, d):
    return L.preview_changes(boosts(spark, d).withColumnRenamed("key", "session_id"), blocks(spark, d)).withColumn("after", F.round("after", 6))


@register("success_share", oracle("SELECT event_id AS seq, project AS grp, round(avg(CASE WHEN value > 30 THEN 1.0e0 ELSE 0 END) OVER (PARTITION BY project ORDER BY event_id), 6) AS share FROM usage_events"))
def success_share(spark, d):
    h = usage_events(spark, d).select(F.col("event_id").alias("seq"), F.col("project").alias("grp"), (F.col("value") > 30).alias("success"))
    return L.running(h).select("seq", "grp", F.round("share", 6).alias("share"))


@register("iteration_rewards", oracle("SELECT event_id, CASE WHEN value <= 30 THEN -0.2e0 WHEN event_id % 6 <= 1 THEN 0.9e0 WHEN event_id % 6 = 2 THEN 0.7e0 WHEN event_id % 6 = 3 THEN 0.5e0 WHEN event_id % 6 = 4 THEN 0.3e0 ELSE 0.1e0 END AS reward FROM usage_events"))
def iteration_rewards(spark, d):
    return usage_events(spark, d).select("event_id", L.iteration_reward(F.col("event_id") % 6, F.col("value") > 30).cast("double").alias("reward"))


@register("retention_curve", oracle(f"SELECT session_id, round(exp(-(epoch(TIMESTAMP '{NOW}') - epoch(ts)) / 86400.0e0 / (least(greatest(COALESCE(strength, 1.0e0), 0.1e0), 5.0e0) * 30.0e0)), 6) AS retention, round(exp(-0.005e0 * greatest(date_sub('day', ts, TIMESTAMP '{NOW}'), 0)), 6) AS decay FROM blocks"))
def retention_curve(spark, d):
    age = (F.unix_timestamp(now()) - F.unix_timestamp("ts")) / 86400.0
    return blocks(spark, d).select("session_id", F.round(S.retention(F.col("strength"), age), 6).alias("retention"), F.round(S.decay(F.col("ts"), now()), 6).alias("decay"))


