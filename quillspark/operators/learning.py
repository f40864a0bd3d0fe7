"""Learned importance: folds of rewards, action tables, bandits, time-to-live policy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import scoring as S

RATE, DECAY, FREQUENT = 0.2, 0.98, 3
OUTCOME_WEIGHT, OUTCOME_RATE = 1.5, 1.2
#: Actions in their order, later ones win ties.
ACTIONS = ["Extend7d", "Extend14d", "Extend30d", "Extend90d", "MakePermanent", "Reduce1d", "Reduce3d", "Reduce7d"]


def signals(events: DataFrame) -> DataFrame:
    """(id, ord, reward, rate): every Add, then one signal of ids read often."""
    keyed = events.where("category IS NOT NULL").withColumn("id", F.concat_ws(":", "category", F.coalesce("query", F.lit("unknown"))))
    added = keyed.where("event_type = 'Add'").groupBy("id").agg(F.count("*").alias("n")).select("id", F.lit(0).alias("ord"), F.lit(0.3).alias("reward"), F.lit(RATE).alias("rate"), "n")
    read = keyed.where("event_type IN ('Recall', 'Search', 'Lookup')").groupBy("id").agg(F.count("*").alias("c")).where(F.col("c") >= FREQUENT)
    often = read.select("id", F.lit(1).alias("ord"), (F.least(F.col("c") / 50.0, F.lit(0.6)) + 0.8 * 0.4).alias("reward"), F.lit(RATE).alias("rate"), F.lit(1).cast("long").alias("n"))
    return added.unionByName(often)


def fold(rewards: DataFrame, start: float = 0.0) -> DataFrame:
    """Importance of every id after its rewards in order (n: how often each in a row), faded once.

    Equal rewards are counted before they are gathered, so an id's list holds
    its distinct steps; a run of n equal steps has a closed form once the
    value is above the lower bound, and reaches it in one step.
    """
    steps = F.array_sort(F.collect_list(F.struct("ord", "at", "reward", "rate", "n")))

    def step(value: Column, s: Column) -> Column:
        first = S.learn(value, s["reward"], s["rate"])
        # After one clamped step, n - 1 further ones approach the reward geometrically; the bounds stay where the target is within them.
        target = S.clamp(s["reward"])
        return S.clamp(target + (first - target) * F.pow(1 - s["rate"], s["n"] - 1))

    return rewards.groupBy("id").agg(F.aggregate(steps, F.lit(start), step).alias("value")).withColumn("value", F.greatest(F.col("value") * DECAY, F.lit(0.0)))


def outcome_rewards(outcomes: DataFrame) -> DataFrame:
    """Rewards of explicit outcomes, weighed up and learned faster, by time."""
    return outcomes.select("id", F.lit(2).alias("ord"), F.col("at"), (F.col("reward") * OUTCOME_WEIGHT).alias("reward"), F.lit(RATE * OUTCOME_RATE).alias("rate"), F.lit(1).cast("long").alias("n"))


def iteration_reward(iterations: Column, success: Column) -> Column:
    """Reward of a session by the iterations it took; -0.2 if it failed."""
    return F.when(~success, -0.2).when(iterations <= 1, 0.9).when(iterations == 2, 0.7).when(iterations == 3, 0.5).when(iterations == 4, 0.3).otherwise(0.1)


def q_values(states: DataFrame, rate: float = 0.1, discount: float = 0.9) -> DataFrame:
    """Value of the one action of each state after n updates toward itself: 10 r (1 - 0.99^n) at these rates."""
    grow = 1 - rate * (1 - discount)
    return states.groupBy("state", "action", "reward").agg(F.count("*").alias("n")).withColumn("q", F.col("reward") / (1 - discount) * (1 - F.pow(F.lit(grow), F.col("n"))))


def policy(boost: Column, recency: Column) -> Column:
    """struct(action, reward) of a tier pair."""
    return (
        F.when((boost >= 0.7) & (recency == "Recent"), F.struct(F.lit("MakePermanent").alias("action"), F.lit(1.0).alias("reward")))
        .when(boost >= 0.7, F.struct(F.lit("Extend90d").alias("action"), F.lit(0.8).alias("reward")))
        .when((boost >= 0.4) & (recency != "Stale"), F.struct(F.lit("Extend30d").alias("action"), F.lit(0.6).alias("reward")))
        .when(boost >= 0.4, F.struct(F.lit("Extend7d").alias("action"), F.lit(0.4).alias("reward")))
        .when(recency == "Stale", F.struct(F.lit("Reduce7d").alias("action"), F.lit(0.5).alias("reward")))
        .otherwise(F.struct(F.lit("Reduce1d").alias("action"), F.lit(0.3).alias("reward")))
    )


def greedy(q: DataFrame) -> DataFrame:
    """The best action of each state, ties to the later one in ACTIONS."""
    at = F.array_position(F.array(*map(F.lit, ACTIONS)), F.col("action"))
    return q.groupBy("state").agg(F.max_by("action", F.struct("q", at.alias("at"))).alias("action"))


def arms(history: DataFrame) -> DataFrame:
    return history.groupBy("arm").agg(F.avg("reward").alias("mean"), F.count("*").alias("pulls"))


def best_arm(means: DataFrame) -> DataFrame:
    """The arm of the highest mean, ties to the highest number."""
    return means.agg(F.max_by("arm", F.struct("mean", "arm")).alias("arm"), F.max("mean").alias("mean"))


def recalled(boosts: DataFrame, ids: DataFrame, rate: float = RATE, reward: float = 0.6) -> DataFrame:
    """Boosts (id, boost) after one step toward the recall reward for each time an id is recalled; unknown ones begin at 0."""
    times = ids.groupBy("id").agg(F.count("*").alias("n"))
    joined = boosts.join(times, "id", "full_outer")
    first = S.learn(F.coalesce("boost", F.lit(0.0)), F.lit(reward), rate)
    # After a first, clamped step the others approach the reward geometrically.
    return joined.select("id", F.when(F.col("n").isNull(), F.col("boost")).otherwise(S.clamp(reward + (first - reward) * F.pow(F.lit(1 - rate), F.col("n") - 1))).alias("boost"))


def recall_blocks(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Blocks after recalls: of each id (session, or category:session) the first category's block gains an access and strength."""
    parts = F.split("id", ":", 2)
    asked = ids.select("id", F.when(F.size(parts) == 2, F.get(parts, F.lit(0))).alias("hint"), F.element_at(parts, -1).alias("session_id")).distinct()
    places = blocks.select("session_id", "category", "cat_ord", "pos")
    met = places.join(asked, "session_id").where(F.col("hint").isNull() | (F.col("hint") == F.col("category")))
    first = met.groupBy("id").agg(F.min(F.struct("cat_ord", "pos")).alias("f")).select(F.col("f.pos").alias("pos"))
    times = first.groupBy("pos").agg(F.count("*").alias("times"))
    grown = F.least(F.coalesce("strength", F.lit(1.0)) + 0.3 * F.col("times"), F.lit(5.0))
    return blocks.join(times, "pos", "left").withColumn("access_count", F.coalesce("times", F.lit(0))).withColumn("strength", F.when(F.col("times") > 0, grown).otherwise(F.col("strength"))).drop("times")


def explore(greedy_: DataFrame, share: float = 0.2, seed: int = 0) -> DataFrame:
    """Each state's action: its best one, or for a share of the states any of ACTIONS; both drawn from a hash of the state and a seed."""
    draw = lambda salt: F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), "state"), F.lit(1_000_000))
    other = F.element_at(F.array(*map(F.lit, ACTIONS)), (draw(2) % len(ACTIONS)).cast("int") + 1)
    wild = draw(1) < int(share * 1_000_000)
    return greedy_.select("state", F.when(wild, other).otherwise(F.col("action")).alias("action"), wild.alias("explored"))


def ttl_changes(blocks: DataFrame, boosts: DataFrame, actions: DataFrame, now: Column, categories: tuple[str, ...] = ("decisions", "solutions", "patterns", "bugs", "insights", "questions")) -> DataFrame:
    """Active blocks whose days to live an action would change: pos, knowledge_id, before, after. Actions are by state, importance/frequency/recency; without any nothing changes."""
    from quillspark.operators.blocks import active

    rows = active(blocks, now).where(F.col("category").isin(*categories)).join(boosts.select(F.col("id").alias("session_id"), "boost"), "session_id", "left")
    tier = S.tiers(F.coalesce("boost", F.lit(0.0)), F.col("ts"), now)
    stated = rows.withColumn("t", tier).withColumn("state", F.concat_ws("/", "t.importance", "t.frequency", "t.recency"))
    acted = stated.join(actions.select("state", "action"), "state")
    seconds = S.ttl_seconds(F.col("ttl"))
    before = F.when(seconds.isNotNull(), F.floor(F.greatest(seconds, F.lit(0)) / 86400))
    return acted.select("pos", F.concat_ws(":", "category", "session_id").alias("knowledge_id"), before.alias("before"), S.ttl_after(F.col("action"), before).alias("after")).where(~F.col("before").eqNullSafe(F.col("after")))


def apply_ttl(blocks: DataFrame, changes: DataFrame) -> DataFrame:
    """Blocks with their new times to live, in days; none is permanent."""
    new = changes.select("pos", F.struct(F.when(F.col("after").isNotNull(), F.concat(F.col("after").cast("string"), F.lit("d"))).alias("ttl")).alias("new"))
    return blocks.join(new, "pos", "left").withColumn("ttl", F.when(F.col("new").isNotNull(), F.col("new.ttl")).otherwise(F.col("ttl"))).drop("new")


def suggestions(sessions: Column, converged_: Column, rate: Column, adaptations: Column, exploration: Column) -> Column:
    """What a learner's figures suggest."""
    found = F.array(
        F.when((sessions > 100) & ~converged_, "not_converging"),
        F.when((rate < 0.5) & (adaptations > 5), "low_success"),
        F.when(converged_ & (exploration > 0.1), "reduce_exploration"),
    )
    return F.array_compact(found)


def report(history: DataFrame, boosts: DataFrame, adaptations: DataFrame, exploration: float, most: int = 5) -> DataFrame:
    """One row: first and last health and their difference, the strongest boosts, successes, suggestions."""
    figures = dashboard(history).crossJoin(F.broadcast(converged(history).select("converged")))
    top = boosts.orderBy(F.desc("boost"), "id").limit(most).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("boost")).alias("b"), "id"))), lambda x: x["id"]), ",").alias("top"))
    done = adaptations.agg(F.count("*").alias("adaptations"), F.count_if(F.col("improvement") > 0).alias("successes"), F.coalesce(F.avg((F.col("improvement") > 0).cast("double")), F.lit(0.0)).alias("rate"))
    rows = figures.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(done))
    return rows.withColumn("suggestions", F.array_join(suggestions(F.col("n"), F.col("converged"), F.col("rate"), F.col("adaptations"), F.lit(exploration)), ","))


def feedback(boosts: DataFrame, given: DataFrame, rate: float = RATE) -> DataFrame:
    """Boosts after explicit feedback (id, useful, pos): steps toward 1 or -0.2, in order; distinct runs only are gathered."""
    runs = given.withColumn("reward", F.when(F.col("useful"), 1.0).otherwise(-0.2))
    order = Window.partitionBy("id").orderBy("pos")
    runs = runs.withColumn("fresh", F.coalesce((F.col("reward") != F.lag("reward").over(order)).cast("int"), F.lit(1))).withColumn("run", F.sum("fresh").over(order))
    steps = runs.groupBy("id", "run", "reward").agg(F.count("*").alias("n"))
    listed = steps.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("run", "reward", "n"))).alias("steps"))

    def step(value: Column, s: Column) -> Column:
        target, first = S.clamp(s["reward"]), S.learn(value, s["reward"], rate)
        # Toward -0.2 the value falls geometrically until the lower bound holds it.
        low = s["reward"] + (value - s["reward"]) * F.pow(F.lit(1 - rate), s["n"])
        return F.when(s["reward"] < 0.1, F.greatest(low, F.lit(0.1))).otherwise(S.clamp(target + (first - target) * F.pow(F.lit(1 - rate), s["n"] - 1)))

    joined = boosts.join(listed, "id", "full_outer")
    value = F.coalesce("boost", F.lit(0.0))
    return joined.select("id", F.when(F.col("steps").isNull(), value).otherwise(F.aggregate("steps", value, step)).alias("boost"))


def reset(boosts: DataFrame) -> DataFrame:
    """No boosts: what is learned is dropped, histories stay."""
    return boosts.limit(0)


def converged(history: DataFrame, n: int = 10, below: float = 10.0) -> DataFrame:
    """Whether the population variance of the last n healths is small; false for fewer."""
    last = history.orderBy(F.desc("seq")).limit(n)
    return last.agg((F.count("*") >= n).alias("enough"), F.var_pop("health").alias("variance")).select("enough", "variance", F.coalesce(F.col("enough") & (F.col("variance") < below), F.lit(False)).alias("converged"))


def dashboard(history: DataFrame) -> DataFrame:
    """First and last figures and their difference."""
    return history.agg(F.min_by("health", "seq").alias("first"), F.max_by("health", "seq").alias("last"), F.count("*").alias("n")).withColumn("change", F.col("last") - F.col("first"))


def preview_changes(boosts: DataFrame, blocks: DataFrame) -> DataFrame:
    """Boosts far enough from neutral to change something."""
    return blocks.join(boosts, "session_id").where(F.abs(F.col("boost") - 0.5) > 0.01).select("session_id", F.lit(0.5).alias("before"), S.clamp(F.col("boost")).alias("after"))


def running(history: DataFrame) -> DataFrame:
    """Success share so far, within each group."""
    w = Window.partitionBy("grp").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return history.withColumn("share", F.avg(F.col("success").cast("double")).over(w))
