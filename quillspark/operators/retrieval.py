"""Retrieval over chunks: dense, BM25, rank-fused, tiered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scoring import cosine, decay

K1, B, RRF, GLOBAL_PENALTY, RELAXED = 1.5, 0.75, 60, 0.85, 0.67


def score(chunks: DataFrame, query: list[float]) -> DataFrame:
    """Cosine of every chunk with a query vector, which goes into the plan as a literal."""
    vector = F.array(*(F.lit(float(x)) for x in query)) if query else F.array().cast("array<double>")
    return chunks.withColumn("score", cosine(F.col("embedding"), vector))


def dense(chunks: DataFrame, query: list[float], k: int) -> DataFrame:
    """Top k by cosine; only ids and scores are ordered."""
    return score(chunks, query).select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def search_filter(chunks: DataFrame, since: Column | None = None, category: str | None = None, hint: str | None = None) -> DataFrame:
    """Rows that a search may see; the filters stand below the scoring."""
    out = chunks
    if since is not None:
        out = out.where(F.col("ts") >= since)
    if category is not None:
        out = out.where(F.col("category") == category)
    if hint is not None:
        out = out.where(F.lower("session_id").contains(hint.lower()) | F.lower("text").contains(hint.lower()))
    return out


def dense_filtered(chunks: DataFrame, query: list[float], k: int, threshold: float, **filters) -> DataFrame:
    """Filter, score, cut to k, then drop what scores under the threshold."""
    return dense(search_filter(chunks, **filters), query, k).where(F.col("score") >= threshold)


def dense_by_project(chunks: DataFrame, query: list[float], k: int, threshold: float) -> DataFrame:
    """Top k of each project over the threshold, then top k of all."""
    rank = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("score"), "id"))
    return score(chunks, query).select("id", "project", "score").withColumn("rank", rank).where((F.col("rank") <= k) & (F.col("score") >= threshold)).drop("rank").orderBy(F.desc("score"), "id").limit(k)


def bm25(chunks: DataFrame, query: str, k: int) -> DataFrame:
    """Top k by BM25; a term that the query repeats counts as often.

    Only postings of query terms are ever made: each row counts its terms where
    it is read. Corpus figures are one row of aggregates, broadcast.
    """
    terms = chunks.sparkSession.range(1).select(T.tokens(F.lit(query)).alias("terms")).first()["terms"]
    words = chunks.select("id", T.tokens("text").alias("tokens")).withColumn("length", F.size("tokens"))
    count = lambda q: F.size(F.filter("tokens", lambda t: t == q))
    tf = [count(F.lit(q)).alias(f"tf{i}") for i, q in enumerate(terms)]
    counted = words.select("id", "length", *tf)
    figures = counted.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), *(F.sum((F.col(f"tf{i}") > 0).cast("long")).alias(f"df{i}") for i in range(len(terms))))
    joined = counted.crossJoin(F.broadcast(figures))
    total = F.lit(0.0)
    for i in range(len(terms)):
        n, f = F.col(f"df{i}"), F.col(f"tf{i}")
        idf = F.log((F.col("docs") - n + 0.5) / (n + 0.5) + 1)
        total = total + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("mean")))
    return joined.select("id", total.alias("score")).where("score > 0").orderBy(F.desc("score"), "id").limit(k)


def ranks(hits: DataFrame) -> DataFrame:
    """1 / (60 + rank) of a bounded list of hits."""
    return hits.select("id", (1.0 / (RRF + F.row_number().over(Window.orderBy(F.desc("score"), "id")))).alias("part"))


def hybrid(chunks: DataFrame, query: list[float], text: str, k: int) -> DataFrame:
    """Reciprocal rank fusion of dense and BM25 candidates, max(3k, 30) of each."""
    wide = max(3 * k, 30)
    both = ranks(dense(chunks, query, wide)).unionByName(ranks(bm25(chunks, text, wide)))
    return both.groupBy("id").agg(F.sum("part").alias("score")).orderBy(F.desc("score"), "id").limit(k)


def smart_search(chunks: DataFrame, query: list[float], text: str, now: Column, k: int, threshold: float, everywhere: DataFrame | None = None) -> DataFrame:
    """Tiered retrieval: strict cosine with decay; if none, the relaxed band; if none, BM25; plus the global store.

    Best chunk a session: score and time of the best decayed one, content and
    category of the first by raw score. The tiers are one tagged union of
    bounded lists, of which the lowest tier present stays.
    """
    meta = chunks.select("id", "session_id", "category", "text", "ts")
    found = dense(chunks, query, 3 * k).join(meta, "id").withColumn("decayed", F.col("score") * decay(F.col("ts"), now))
    tiered = found.withColumn("tier", F.when(F.col("decayed") >= threshold, 1).when(F.col("decayed") >= threshold * RELAXED, 2)).where("tier IS NOT NULL")
    # Words are looked for only where no vector is near enough: the one row that says so is broadcast, and without it this side is empty.
    none = tiered.agg(F.count("*").alias("near_enough")).where("near_enough = 0")
    lexical = bm25(chunks.select("id", "text").crossJoin(F.broadcast(none)), text, k).join(meta, "id").select("id", "score", "session_id", "category", "text", "ts", F.lit(threshold).alias("decayed"), F.lit(3).alias("tier"))
    rows = tiered.unionByName(lexical).withColumn("least", F.min("tier").over(Window.partitionBy())).where("tier = least")
    first = F.struct(-F.col("score"), F.col("id"))
    best = F.when(F.col("tier") == 1, F.struct(-F.col("decayed"), -F.col("score"), F.col("id"))).otherwise(F.struct(F.lit(0.0), -F.col("score"), F.col("id")))
    out = rows.groupBy("session_id").agg(F.min_by("category", first).alias("category"), F.min_by("text", first).alias("content"), F.min_by("decayed", best).alias("score"), F.min_by("text", best).alias("shown"))
    if everywhere is not None:
        other = dense(everywhere, query, 2 * k).where(F.col("score") >= threshold).join(everywhere.select("id", "session_id", "category", "text", "ts"), "id").withColumn("decayed", F.col("score") * decay(F.col("ts"), now) * GLOBAL_PENALTY)
        high = F.struct(-F.col("decayed"), -F.col("score"), F.col("id"))
        other = other.groupBy(F.concat(F.lit("global:"), "session_id").alias("session_id")).agg(F.min_by("category", first).alias("category"), F.concat(F.lit("[Global] "), F.trim(F.min_by("text", first))).alias("content"), F.min("decayed").alias("low"), F.max("decayed").alias("score"), F.min_by("text", high).alias("shown")).drop("low")
        out = out.unionByName(other)
    return out.select("session_id", "category", "content", "score", T.preview("shown", 120).alias("preview")).orderBy(F.desc("score"), "session_id").limit(k)


def lexical_fallback(blocks: DataFrame, query: str, least: int, now: Column) -> DataFrame:
    """Sessions that hold the whole query, or at least so many of its keywords; score 0.5."""
    from quillspark.operators.blocks import keyword_match, topic_match

    hits = keyword_match(blocks, query, least, now).select("session_id").union(topic_match(blocks, query).select("session_id")).distinct()
    return hits.withColumn("score", F.lit(0.5))


def concept_queries(nodes: DataFrame, edges: DataFrame, query: str, hops: int = 2, n: int = 4) -> DataFrame:
    """Names of the first related concepts of those that a query names."""
    from quillspark.operators.graph import neighbours

    named = nodes.where(F.contains(F.lit(query.lower()), F.lower("name"))).select("id")
    related = neighbours(edges, named, hops).join(nodes, "id").groupBy("id", "name").agg(F.min("depth").alias("depth"))
    return related.orderBy("depth", "id").limit(n).select("id", "name", "depth")


def text_search(chunks: DataFrame, query: list[float], text: str, k: int) -> DataFrame:
    """The fused search joined back to its chunks; of a repeated id the last row counts."""
    rows = chunks.groupBy("id").agg(F.max_by(F.struct("session_id", "category", "text"), "ts").alias("c"))
    return hybrid(chunks, query, text, k).join(rows, "id").select("id", "score", "c.session_id", "c.category", "c.text")


def graph_search(chunks: DataFrame, nodes: DataFrame, edges: DataFrame, query: list[float], text: str, now: Column, k: int, threshold: float, vector: Callable[[str], list[float]], hops: int = 2, names: int = 4) -> DataFrame:
    """The tiered search, then searches (two hits each, at a discount) for concepts near those that the question names; each session once, as the first search found it."""
    found = smart_search(chunks, query, text, now, k, threshold).withColumn("arm", F.lit(0))
    related = concept_queries(nodes, edges, text, hops, names).collect()  # ``names`` rows
    for arm, row in enumerate(related, 1):
        hits = smart_search(chunks, vector(row["name"]), row["name"], now, 2, threshold)
        found = found.unionByName(hits.withColumn("score", F.col("score") * GLOBAL_PENALTY).withColumn("arm", F.lit(arm)))
    first = found.groupBy("session_id").agg(F.min_by(F.struct("category", "content", "score", "preview", "arm"), "arm").alias("f"))
    return first.select("session_id", "f.*").orderBy("arm", F.desc("score"), "session_id")


def union_new(a: DataFrame, b: DataFrame, key: str = "session_id") -> DataFrame:
    """a, and what b has that a hasn't."""
    return a.unionByName(b.join(a.select(key).distinct(), key, "left_anti"))


def context(hits: DataFrame, k: int) -> DataFrame:
    """The text handed to an answerer: the first k hits, bounded by k."""
    top = hits.orderBy(F.desc("score"), "session_id").limit(k)
    part = F.concat(F.lit("["), F.col("category"), F.lit(":"), F.col("session_id"), F.lit("]\n"), F.col("content"))
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "session_id", part.alias("part"))))
    return top.agg(F.array_join(F.transform(ordered, lambda x: x["part"]), "\n---\n").alias("context"))
