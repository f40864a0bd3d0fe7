"""Fuzzy subsequence matching of names, as expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EACH, BONUS = 16, 8
#: What a gap between two matched characters costs: its first character, and every further one.
OPEN, MORE = 3, 1


def _after(name: Column, c: str, at: Column) -> Column:
    """The place of the first ``c`` behind place ``at``."""
    return at + F.instr(F.substr(name, at + 1), F.lit(c))


def fuzzy_match(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column holds the pattern's characters in order, with a score.

    Greedy from the left: EACH a character, and BONUS more for one at a word's
    begin and for one right behind the one before. The pattern is short and
    known, so its places are nested expressions, one a character.
    """
    name = F.lower(F.col(column))
    at, score = F.lit(0), F.lit(0)
    for c in pattern.lower():
        before, at = at, _after(name, c, at)
        begins = (at == 1) | ~F.substr(name, at - 1, F.lit(1)).rlike(r"[\p{L}\p{N}]")
        score = score + EACH + F.when(begins, BONUS).otherwise(0) + F.when((before > 0) & (at == before + 1), BONUS).otherwise(0)
    regex = ".*".join(re.escape(c) for c in pattern.lower())
    return rows.where(name.rlike(regex)).withColumn("score", score.cast("int"))


def _bound(name: Column, pattern: str) -> Column:
    """No alignment of the pattern scores more: characters that begin no word of the name earn no bonus there, and neighbours that stand nowhere side by side in it have a gap."""
    begins = F.array_join(F.regexp_extract_all(name, F.lit(r"(?s)(?<![\p{L}\p{N}])."), F.lit(0)), "")
    total = F.lit(EACH * len(pattern))
    for c in pattern:
        total = total + F.when(F.contains(begins, F.lit(c)), BONUS).otherwise(0)
    for pair in map("".join, zip(pattern, pattern[1:])):
        total = total + F.when(F.contains(name, F.lit(pair)), BONUS).otherwise(-OPEN)
    return total


def _best(name: Column, pattern: str) -> Column:
    """The greatest score of all ways to find the pattern in the name, in one pass over its characters.

    For each place of the pattern the state has ``at``, the best score with that
    place matched at the character just read, and ``far``, the best with it
    matched before that, its gap paid. Null stands for no way at all.
    """
    m, none = len(pattern), F.lit(None).cast("int")
    nothing = F.array(*[none] * m)
    start = F.struct(F.lit(False).alias("word"), nothing.alias("at"), nothing.alias("far"), none.alias("best"))

    def read(s, c):
        bonus = F.when(s["word"], 0).otherwise(BONUS)
        at = []
        for j, p in enumerate(pattern):
            before = F.lit(0) if j == 0 else F.greatest(s["at"][j - 1] + BONUS, s["far"][j - 1])
            at.append(F.when(c == p, before + EACH + bonus))
        far = [F.greatest(s["at"][j] - OPEN, s["far"][j] - MORE) for j in range(m)]
        return F.struct(c.rlike(r"[\p{L}\p{N}]").alias("word"), F.array(*at).alias("at"), F.array(*far).alias("far"), F.greatest(s["best"], at[-1]).alias("best"))

    return F.aggregate(F.regexp_extract_all(name, F.lit("(?s)."), F.lit(0)), start, read, lambda s: s["best"])


def fuzzy_best(rows: DataFrame, column: str, pattern: str) -> DataFrame:
    """Rows whose column holds the pattern's characters in order, with the score of the best alignment.

    EACH a character, BONUS more at a word's begin and right behind the one
    before, and less for gaps between characters (OPEN, MORE); what precedes the
    first costs nothing. Case doesn't count. Null names are no match, and an
    empty pattern matches every other with 0. A column named score is replaced.
    """
    name, wanted = F.lower(F.col(column)), pattern.lower()
    if not wanted:
        return rows.where(F.col(column).isNotNull()).withColumn("score", F.lit(0))
    return rows.where(name.rlike("(?s)" + ".*".join(re.escape(c) for c in wanted))).withColumn("score", _best(name, wanted))


def fuzzy_top(rows: DataFrame, column: str, pattern: str, k: int, key: str) -> DataFrame:
    """The k rows of best alignment, ties by ``key``: fuzzy_best's, aligned only where a bound on the score allows it.

    The k rows of greatest bound are aligned first; the least of their scores is
    a threshold, and rows whose bound lies below it can't be among the best.
    """
    wanted = pattern.lower()
    if not wanted:
        return fuzzy_best(rows, column, pattern).orderBy(key).limit(k)
    name = F.lower(F.col(column))
    held = rows.where(name.rlike("(?s)" + ".*".join(re.escape(c) for c in wanted)))
    first = fuzzy_best(held.select(key, column).withColumn("_bound", _bound(name, wanted)).orderBy(F.desc("_bound"), key).limit(k), column, pattern)
    least = first.agg(F.when(F.count("*") >= k, F.min("score")).alias("_least"))
    near = held.withColumn("_bound", _bound(name, wanted)).join(F.broadcast(least), F.col("_least").isNull() | (F.col("_bound") >= F.col("_least")))
    return fuzzy_best(near.drop("_bound", "_least"), column, pattern).orderBy(F.desc("score"), key).limit(k)
