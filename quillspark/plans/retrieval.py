"""Queries of retrieval."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.operators import retrieval as R
from quillspark.plans.catalog import register
from quillspark.sources.views import NOW, blocks, chunks, graph_edges, graph_nodes, now, oracle, query_vector

QUERY = "the tion and of"
_TERMS = ["the", "tion", "and", "of"]
_Q = "q AS (SELECT CAST(embedding AS DOUBLE[]) AS v FROM embeddings WHERE vec_id = 0)"
_SCORED = f"{_Q}, scored AS (SELECT c.*, CASE WHEN len(embedding) = len(v) THEN list_cosine_similarity(embedding, v) ELSE 0 END AS score FROM chunks c, q)"
_BM25 = f"""terms AS (SELECT unnest({_TERMS}) AS term), words AS (SELECT id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: octet_length(encode(t)) > 1) AS toks FROM chunks),
  figures AS (SELECT count(*) AS docs, avg(len(toks)) AS mean FROM words), tf AS (SELECT id, term, len(toks) AS length, len(list_filter(toks, lambda t: t = term)) AS tf FROM words, terms),
  df AS (SELECT term, count(*) FILTER (WHERE tf > 0) AS df FROM tf GROUP BY 1),
  bm25 AS (SELECT id, sum(ln((docs - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / mean))) AS score FROM tf JOIN df USING (term), figures GROUP BY id HAVING score > 0)"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 6))


@register("dense_topk", oracle(f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM scored ORDER BY scored.score DESC, id LIMIT 10"))
def dense_topk(spark, d):
    return _rounded(R.dense(chunks(spark, d), query_vector(spark, d), 10))


@register("dense_topk_filtered", oracle(f"WITH {_SCORED} SELECT id, round(score, 6) AS score FROM (SELECT * FROM scored WHERE ts >= TIMESTAMP '{NOW}' - INTERVAL 60 DAY AND category = '3' AND (contains(lower(session_id), 's') OR contains(lower(text), 's')) ORDER BY scored.score DESC, id LIMIT 10) WHERE score >= 0.05"))
def dense_topk_filtered(spark, d):
    since = now() - F.make_dt_interval(days=F.lit(60))
    return _rounded(R.dense_filtered(chunks(spark, d), query_vector(spark, d), 10, 0.05, since=since, category="3", hint="s"))


@register("dense_topk_per_project", oracle(f"WITH {_SCORED} SELECT id, project, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY project ORDER BY score DESC, id) AS rank FROM scored) WHERE rank <= 5 AND score >= 0.2 ORDER BY score DESC, id LIMIT 5"))
def dense_topk_per_project(spark, d):
    return _rounded(R.dense_by_project(chunks(spark, d), query_vector(spark, d), 5, 0.2))


@register("bm25_topk", oracle(f"WITH {_BM25} SELECT id, round(score, 6) AS score FROM bm25 ORDER BY bm25.score DESC, id LIMIT 30"))
def bm25_topk(spark, d):
    return _rounded(R.bm25(chunks(spark, d), QUERY, 30))


@register(
    "hybrid_rrf",
    oracle(f"""WITH {_SCORED}, {_BM25}, fused AS (SELECT id, sum(part) AS score FROM (
  SELECT id, 1.0e0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 30)
  UNION ALL SELECT id, 1.0e0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 30)) GROUP BY id)
  SELECT id, round(score, 6) AS score FROM fused ORDER BY fused.score DESC, id LIMIT 10"""),
)
def hybrid_rrf(spark, d):
    return _rounded(R.hybrid(chunks(spark, d), query_vector(spark, d), QUERY, 10))


def _smart(threshold: float, k: int, everywhere: bool = False) -> str:
    day = f"greatest(date_sub('day', ts, TIMESTAMP '{NOW}'), 0)"
    parts = f"""WITH {_SCORED}, {_BM25}, found AS (SELECT id, score, session_id, category, text, score * exp(-0.005e0 * {day}) AS decayed FROM (SELECT * FROM scored WHERE project <> 'p4' ORDER BY score DESC, id LIMIT {3 * k})),
  tiered AS (SELECT *, CASE WHEN decayed >= {threshold} THEN 1 WHEN decayed >= {threshold} * 0.67e0 THEN 2 END AS tier FROM found),
  rows_ AS (SELECT id, score, session_id, category, text, decayed, tier FROM tiered WHERE tier IS NOT NULL UNION ALL
    SELECT b.id, b.score, session_id, category, text, CAST({threshold} AS DOUBLE), 3 FROM (SELECT * FROM bm25p ORDER BY score DESC, id LIMIT {k}) b JOIN chunks USING (id)),
  kept AS (SELECT * FROM rows_ WHERE tier = (SELECT min(tier) FROM rows_)),
  local_ AS (SELECT session_id, arg_min(category, (-score, id)) AS category, arg_min(text, (-score, id)) AS content, CASE WHEN min(tier) = 1 THEN max(decayed) ELSE arg_min(decayed, (-score, id)) END AS score FROM kept GROUP BY 1)"""
    parts = parts.replace("bm25 AS (SELECT id, sum", "bm25p AS (SELECT id, sum").replace("FROM chunks), \n", "FROM chunks), ").replace("AS toks FROM chunks)", "AS toks FROM chunks WHERE project <> 'p4')")
    tail = "SELECT session_id, category, score FROM local_"
    if everywhere:
        tail += f""" UNION ALL SELECT 'global:' || session_id, arg_min(category, (-score, id)), max(score * exp(-0.005e0 * {day}) * 0.85e0) FROM (SELECT * FROM scored WHERE project = 'p4' ORDER BY score DESC, id LIMIT {2 * k}) WHERE score >= {threshold} GROUP BY session_id"""
    return oracle(f"{parts} SELECT session_id, category, round(score, 6) AS score FROM ({tail}) t ORDER BY t.score DESC, session_id LIMIT {k}")


def _run_smart(spark, d, threshold, k, everywhere=False):
    c = chunks(spark, d)
    hits = R.smart_search(c.where("project <> 'p4'"), query_vector(spark, d), QUERY, now(), k, threshold, c.where("project = 'p4'") if everywhere else None)
    return _rounded(hits.select("session_id", "category", "score"))


@register("smart_search_strict", _smart(0.15, 8))
def smart_search_strict(spark, d):
    return _run_smart(spark, d, 0.15, 8)


@register("smart_search_relaxed", _smart(1.2, 8))
def smart_search_relaxed(spark, d):
    return _run_smart(spark, d, 1.2, 8)


@register("smart_search_lexical", _smart(2.5, 8))
def smart_search_lexical(spark, d):
    return _run_smart(spark, d, 2.5, 8)


@register("smart_search_global", _smart(0.1, 8, True))
def smart_search_global(spark, d):
    return _run_smart(spark, d, 0.1, 8, True)


@register("lexical_fallback", oracle(f"SELECT DISTINCT session_id, 0.5e0 AS score FROM blocks WHERE contains(lower(content), 'erth than') OR (NOT COALESCE(TIMESTAMP '{NOW}' > ts + CASE ttl WHEN '7d' THEN INTERVAL 7 DAY WHEN '2w' THEN INTERVAL 14 DAY WHEN '36h' THEN INTERVAL 36 HOUR END, false) AND contains(lower(content), 'erth'))"))
def lexical_fallback(spark, d):
    return R.lexical_fallback(blocks(spark, d), "erth than", 1, now())


@register("concept_expansion", oracle("""WITH RECURSIVE named AS (SELECT id FROM graph_nodes WHERE contains('trade of nation_3 and nation_7', lower(name))), und AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges),
  walk AS (SELECT id AS start, id, 0 AS depth FROM named UNION SELECT start, dst, depth + 1 FROM walk JOIN und ON src = id WHERE depth < 2)
  SELECT id, name, depth FROM (SELECT id, CAST(min(depth) AS INT) AS depth FROM walk WHERE id <> start GROUP BY id) JOIN graph_nodes USING (id) ORDER BY depth, id LIMIT 4"""))
def concept_expansion(spark, d):
    return R.concept_queries(graph_nodes(spark, d), graph_edges(spark, d), "Trade of NATION_3 and NATION_7")


@register("answer_context", oracle(f"WITH {_SCORED} SELECT string_agg('[' || category || ':' || session_id || ']' || chr(10) || text, chr(10) || '---' || chr(10) ORDER BY score DESC, session_id) AS context FROM (SELECT * FROM (SELECT session_id, category, text, score FROM scored ORDER BY score DESC, id LIMIT 40) ORDER BY score DESC, session_id LIMIT 5)"))
def answer_context(spark, d):
    c = chunks(spark, d)
    hits = R.dense(c, query_vector(spark, d), 40).join(c.select("id", "session_id", "category", F.col("text").alias("content")), "id")
    return R.context(hits, 5)


@register("union_new_sessions", oracle("SELECT session_id, 1 AS arm FROM chunks WHERE category = '1' GROUP BY 1 UNION ALL SELECT DISTINCT session_id, 2 FROM chunks WHERE category = '2' AND session_id NOT IN (SELECT session_id FROM chunks WHERE category = '1')"))
def union_new_sessions(spark, d):
    c = chunks(spark, d)
    arm = lambda k: c.where(F.col("category") == str(k)).select("session_id", F.lit(k).alias("arm")).distinct()
    return R.union_new(arm(1), arm(2))
