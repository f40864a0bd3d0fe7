"""Scores and times on columns: similarity, decay, learning steps, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Days after which a block of strength 1 has faded to 1/e, and the bounds of strength.
FADE_DAYS, LEAST_STRENGTH, MOST_STRENGTH = 30.0, 0.1, 5.0
DECAY_A_DAY = 0.005
LEAST, MOST = 0.1, 1.0


def ttl_seconds(ttl: Column) -> Column:
    """Seconds of <number><m|h|d|w>; null for anything else."""
    number = F.regexp_extract(ttl, r"^(-?\d+)[mhdw]$", 1)
    unit = F.substring(ttl, -1, 1)
    each = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).when(unit == "w", 604800)
    return F.when(number != "", number.try_cast("long") * each)


def days_between(earlier: Column, later: Column) -> Column:
    """Whole days elapsed, toward zero."""
    return F.timestamp_diff("DAY", earlier, later)


def expired(ts: Column, ttl: Column, now: Column) -> Column:
    """Whether now is after ts plus ttl; false where either can't be read."""
    return F.coalesce(F.unix_micros(now) > F.unix_micros(ts) + ttl_seconds(ttl) * 1_000_000, F.lit(False))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if lengths differ or a norm is 0."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (norm > 0), dot(a, b) / norm).otherwise(0.0)


def retention(strength: Column, age_days: Column) -> Column:
    return F.exp(-age_days / (F.least(F.greatest(F.coalesce(strength, F.lit(1.0)), F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH)) * FADE_DAYS))


def decay(ts: Column, now: Column) -> Column:
    return F.coalesce(F.exp(-DECAY_A_DAY * F.greatest(days_between(ts, now), F.lit(0))), F.lit(1.0))


def confidence_factor(level: Column) -> Column:
    return F.when(level == "high", 1.2).when(level == "low", 0.5).otherwise(1.0)


def clamp(x: Column, low: float = LEAST, high: float = MOST) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def learn(value: Column, reward: Column, rate: Column | float) -> Column:
    """One temporal-difference step toward a reward."""
    return clamp(value + (reward - value) * rate)


def ttl_after(action: Column, days: Column) -> Column:
    """Days to live after an action; null is permanent."""
    plus = {"Extend7d": 7, "Extend14d": 14, "Extend30d": 30, "Extend90d": 90}
    minus = {"Reduce1d": 1, "Reduce3d": 3, "Reduce7d": 7}
    out = F.when(action == "MakePermanent", F.lit(None).cast("long"))
    for name, n in plus.items():
        out = out.when(action == name, F.coalesce(days, F.lit(n)) + n)
    for name, n in minus.items():
        out = out.when(action == name, F.greatest(F.coalesce(days, F.lit(7)) - n, F.lit(1)))
    return out


def tiers(boost: Column, ts: Column, now: Column) -> Column:
    """struct(importance, frequency, recency) of a block."""
    age = days_between(ts, now)
    return F.struct(
        F.when(boost >= 0.7, "High").when(boost >= 0.4, "Medium").otherwise("Low").alias("importance"),
        F.when(boost >= 0.5, "Frequent").when(boost >= 0.2, "Occasional").otherwise("Rare").alias("frequency"),
        F.when(age < 7, "Recent").when(age < 30, "Normal").when(age.isNull(), "Normal").otherwise("Stale").alias("recency"),
    )
