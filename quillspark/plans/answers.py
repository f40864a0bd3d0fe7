"""Queries of searching, asking, recalling and injecting, with all their fallbacks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.operators import assistant as A
from quillspark.operators import documents as D
from quillspark.operators import providers as P
from quillspark.operators import retrieval as R
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import EXPIRED
from quillspark.plans.retrieval import _BM25, _SCORED, QUERY
from quillspark.sources.views import CATEGORIES, NOW, blocks, chunks, graph_edges, graph_nodes, now, oracle, table

_DAY = f"greatest(date_sub('day', ts, TIMESTAMP '{NOW}'), 0)"


def _embedder(spark, d):
    """A provider for tests: a text that ends in a number has that chunk's vector, any other that of chunk 0."""
    held = {r["vec_id"]: r["embedding"] for r in table(spark, d, "embeddings").where("vec_id < 25").collect()}

    def embed(texts: list[str]) -> np.ndarray:
        numbers = [t.rpartition("_")[2] for t in texts]
        return np.array([held[int(n) if n.isdigit() else 0] for n in numbers], dtype=float)

    return embed


@register("text_search", oracle(f"""WITH {_SCORED}, {_BM25}, fused AS (SELECT id, sum(part) AS score FROM (
  SELECT id, 1.0e0 / (60 + row_number() OVER (ORDER BY score DESC, id)) AS part FROM (SELECT id, score FROM scored ORDER BY score DESC, id LIMIT 30)
  UNION ALL SELECT id, 1.0e0 / (60 + row_number() OVER (ORDER BY score DESC, id)) FROM (SELECT id, score FROM bm25 ORDER BY score DESC, id LIMIT 30)) GROUP BY id)
  SELECT f.id, round(f.score, 6) AS score, session_id, category, text FROM (SELECT * FROM fused ORDER BY score DESC, id LIMIT 10) f JOIN chunks USING (id)"""))
def text_search(spark, d):
    """A question embedded by a provider, searched both ways, fused, joined to its chunks."""
    vector = [float(x) for x in _embedder(spark, d)([QUERY])[0]]
    return R.text_search(chunks(spark, d), vector, QUERY, 10).withColumn("score", F.round("score", 6))


_TIERED = f"""found AS (SELECT {{arm}} AS arm, id, session_id, category, text, s.score, s.score * exp(-0.005e0 * {_DAY}) AS decayed FROM (SELECT c.id, list_cosine_similarity(c.embedding, CAST(e.embedding AS DOUBLE[])) AS score FROM chunks c, embeddings e WHERE e.vec_id = {{vec}} ORDER BY score DESC, c.id LIMIT {{wide}}) s JOIN chunks USING (id)),
  kept AS (SELECT * FROM found WHERE decayed >= 0.15), best AS (SELECT arm, session_id, arg_min(category, (-score, id)) AS category, arg_min(text, (-score, id)) AS content, max(decayed) AS score FROM kept GROUP BY 1, 2)"""
_AUGMENTED = f"""WITH RECURSIVE named AS (SELECT id FROM graph_nodes WHERE contains('trade of nation_3 and nation_7', lower(name))), und AS (SELECT src, dst FROM graph_edges UNION SELECT dst, src FROM graph_edges),
  walk AS (SELECT id AS start, id, 0 AS depth FROM named UNION SELECT start, dst, depth + 1 FROM walk JOIN und ON src = id WHERE depth < 2),
  related AS (SELECT row_number() OVER (ORDER BY depth, id) AS arm, id AS vec FROM (SELECT id, min(depth) AS depth FROM walk WHERE id <> start GROUP BY id) ORDER BY depth, id LIMIT 4),
  arms AS (SELECT 0 AS arm, 7 AS vec, 15 AS wide, 5 AS k, 1.0e0 AS f UNION ALL SELECT arm, vec, 6, 2, 0.85e0 FROM related),
  sims AS (SELECT arm, wide, k, f, c.id, list_cosine_similarity(c.embedding, CAST(e.embedding AS DOUBLE[])) AS score, row_number() OVER (PARTITION BY arm ORDER BY list_cosine_similarity(c.embedding, CAST(e.embedding AS DOUBLE[])) DESC, c.id) AS nth FROM arms JOIN embeddings e ON e.vec_id = vec, chunks c),
  found AS (SELECT arm, k, f, id, session_id, category, text, score, score * exp(-0.005e0 * {_DAY}) AS decayed FROM sims JOIN chunks USING (id) WHERE nth <= wide),
  best AS (SELECT arm, k, f, session_id, arg_min(category, (-score, id)) AS category, arg_min(text, (-score, id)) AS content, max(decayed) AS score FROM found WHERE decayed >= 0.15 GROUP BY 1, 2, 3, 4),
  top AS (SELECT arm, session_id, category, content, score * f AS score FROM (SELECT *, row_number() OVER (PARTITION BY arm ORDER BY score DESC, session_id) AS nth FROM best) WHERE nth <= k),
  one AS (SELECT session_id, min(arm) AS arm, arg_min(category, arm) AS category, arg_min(content, arm) AS content, arg_min(score, arm) AS score FROM top GROUP BY 1)"""


@register("graph_search", oracle(f"{_AUGMENTED} SELECT session_id, category, CAST(arm AS INT) AS arm, round(score, 6) AS score FROM one"))
def graph_search(spark, d):
    """The names of nations near those that the question names are searched for too."""
    embed = _embedder(spark, d)
    text = "Trade of NATION_3 and NATION_7"
    vector = lambda t: [float(x) for x in embed([t])[0]]
    found = R.graph_search(chunks(spark, d), graph_nodes(spark, d), graph_edges(spark, d), vector(text), text, now(), 5, 0.15, vector)
    return found.select("session_id", "category", "arm", F.round("score", 6).alias("score"))


@register("ask_graph", oracle(f"{_AUGMENTED} SELECT 'search' AS source, regexp_replace(regexp_replace(string_agg('[' || category || ':' || session_id || ']' || chr(10) || trim(content, ' '), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY arm, score DESC, session_id), '<private>.*?</private>', '', 'gsi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS context FROM (SELECT * FROM one ORDER BY arm, score DESC, session_id LIMIT 5)"))
def ask_graph(spark, d):
    """A guess at the answer, here the question itself, is searched for; then the graph's concepts."""
    return A.ask_context(chunks(spark, d), blocks(spark, d), "Trade of NATION_3 and NATION_7", now(), 5, 0.15, _embedder(spark, d), None, (graph_nodes(spark, d), graph_edges(spark, d)))


@register("ask_search", oracle("WITH " + _TIERED.format(arm=0, vec=0, wide=15) + " SELECT 'search' AS source, regexp_replace(regexp_replace(string_agg('[' || category || ':' || session_id || ']' || chr(10) || trim(content, ' '), chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY score DESC, session_id), '<private>.*?</private>', '', 'gsi'), '\\n{3,}', chr(10) || chr(10), 'g') AS context FROM (SELECT * FROM best ORDER BY score DESC, session_id LIMIT 5)"))
def ask_search(spark, d):
    """With a guess at the answer, which goes in front of the question."""
    return A.ask_context(chunks(spark, d), blocks(spark, d), QUERY, now(), 5, 0.15, _embedder(spark, d), P.echo_chat)


_PART = "'[' || category || ':' || session_id || ']' || chr(10) || trim(content, ' ')"
_RAW = f"SELECT 'raw' AS source, regexp_replace(regexp_replace(string_agg(text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY cat_ord, pos), '<private>.*?</private>', '', 'gsi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS context FROM (SELECT cat_ord, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY project, category) AND category IN ('bugs', 'insights', 'questions', 'procedures') THEN CASE category WHEN 'bugs' THEN '## Known Bugs' WHEN 'insights' THEN '## Insights' WHEN 'questions' THEN '## Open Questions' ELSE '## Workflows & Procedures' END || chr(10) || chr(10) || content ELSE content END AS text FROM blocks WHERE NOT {EXPIRED} ORDER BY cat_ord, pos LIMIT 200)"


@register("ask_words", oracle(f"SELECT 'words' AS source, regexp_replace(regexp_replace(string_agg({_PART}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY cat_ord, pos), '<private>.*?</private>', '', 'gsi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS context FROM (SELECT * FROM blocks WHERE NOT {EXPIRED} AND contains(lower(content), 'h t') ORDER BY cat_ord, pos LIMIT 5)"))
def ask_words(spark, d):
    """Nothing is near enough and no word of the question is one of a chunk: blocks that hold the phrase."""
    return A.ask_context(chunks(spark, d), blocks(spark, d), "h t", now(), 5, 9.0, _embedder(spark, d))


@register("ask_raw", oracle(_RAW))
def ask_raw(spark, d):
    """Nothing is found at all: the first blocks as they stand."""
    return A.ask_context(chunks(spark, d), blocks(spark, d), "qqxzv", now(), 5, 9.0, _embedder(spark, d))


@register("ask_answer", oracle(f"SELECT 'qqxzv' AS question, source, '[answer] ' || octet_length(encode(context)) AS answer FROM ({_RAW})"))
def ask_answer(spark, d):
    chat = lambda system, user: f"[answer] {len(user.split(chr(10) * 2, 2)[2].encode())}"
    return A.ask(chunks(spark, d), blocks(spark, d), "qqxzv", now(), chat, threshold=9.0, embed=_embedder(spark, d)).select("question", "source", "answer")


@register("recursive_fallback", oracle(_RAW))
def recursive_fallback(spark, d):
    """A provider that picks nothing that is there leaves the question to ask()."""
    return A.recursive_context(blocks(spark, d), chunks(spark, d), "qqxzv", now(), lambda entries: "none", CATEGORIES, threshold=9.0, embed=_embedder(spark, d))


@register("recursive_chosen", oracle(f"SELECT 'chosen' AS source, regexp_replace(regexp_replace(string_agg({_PART}, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY cat_ord, pos), '<private>.*?</private>', '', 'gsi'), '\\n{{3,}}', chr(10) || chr(10), 'g') AS context FROM blocks WHERE NOT {EXPIRED} AND session_id IN ('s4', 's9', 's13', 's19')"))
def recursive_chosen(spark, d):
    return A.recursive_context(blocks(spark, d), chunks(spark, d), "x", now(), lambda entries: "s4, bugs:s9, s13, s19", CATEGORIES)


_GLOBAL = f"g AS (SELECT CASE category WHEN 'decisions' THEN 1 WHEN 'patterns' THEN 2 WHEN 'solutions' THEN 3 WHEN 'insights' THEN 4 WHEN 'bugs' THEN 5 WHEN 'procedures' THEN 6 END AS ord, pos, content FROM blocks WHERE project = 'src0' AND category <> 'questions' AND NOT {EXPIRED})"


@register("global_knowledge", oracle(f"WITH {_GLOBAL} SELECT ord, pos, content AS text FROM g"))
def global_knowledge(spark, d):
    return A.global_knowledge(blocks(spark, d), "src0", now()).withColumnRenamed("at", "ord")


def _contexts(b):
    return b.groupBy("project").agg(F.min_by("content", "pos").alias("context"))


def _packs(b):
    return b.where("project = 'src2' AND category = 'patterns'").select("pos", F.col("content").alias("text"))


@register("raw_context", oracle(f"SELECT project, cat_ord, pos, CASE WHEN pos = min(pos) OVER (PARTITION BY project, category) AND category = 'bugs' THEN '## Known Bugs' || chr(10) || chr(10) || content WHEN pos = min(pos) OVER (PARTITION BY project, category) AND category = 'insights' THEN '## Insights' || chr(10) || chr(10) || content WHEN pos = min(pos) OVER (PARTITION BY project, category) AND category = 'questions' THEN '## Open Questions' || chr(10) || chr(10) || content WHEN pos = min(pos) OVER (PARTITION BY project, category) AND category = 'procedures' THEN '## Workflows & Procedures' || chr(10) || chr(10) || content ELSE content END AS text FROM blocks WHERE NOT {EXPIRED}"))
def raw_context(spark, d):
    return A.raw_context(blocks(spark, d), now())


_FULL = f"""WITH {_GLOBAL}, c AS (SELECT project, arg_min(content, pos) AS context FROM blocks GROUP BY 1), k AS (
  SELECT 1 AS section, 'Global Preferences' AS title, 0 AS ord, pos, content AS text FROM blocks WHERE project = 'src1' AND category = 'procedures' AND NOT {EXPIRED}
  UNION ALL SELECT 2, 'Global Shared Memory', cat_ord, pos, content FROM blocks WHERE project = 'src1' AND category <> 'procedures' AND NOT {EXPIRED}
  UNION ALL SELECT 4, 'Global Knowledge', ord, pos, content FROM g UNION ALL SELECT 5, 'Installed Pack Knowledge', 0, pos, content FROM blocks WHERE project = 'src2' AND category = 'patterns')
  SELECT project, 3 AS section, 'Project: ' || project AS title, 0 AS ord, 0 AS pos, context AS text FROM c UNION ALL SELECT project, section, title, ord, pos, text FROM k, c"""


@register("full_memory", oracle(_FULL))
def full_memory(spark, d):
    b = blocks(spark, d)
    return A.full_memory(_contexts(b), b, _packs(b), "src0", "src1", now()).withColumnRenamed("at", "ord")


@register("recall_with_packs", oracle(f"WITH c AS (SELECT project, CASE WHEN project < 'src2' THEN 'context of ' || project END AS context FROM blocks GROUP BY 1) SELECT project, 0 AS ord, context AS text FROM c WHERE context IS NOT NULL UNION ALL SELECT project, pos, content FROM blocks WHERE NOT {EXPIRED} AND project >= 'src2' UNION ALL SELECT c.project, 1099511627776 + pos, content FROM blocks, c WHERE blocks.project = 'src2' AND category = 'patterns'"))
def recall_with_packs(spark, d):
    b = blocks(spark, d)
    contexts = b.select("project").distinct().select("project", F.when(F.col("project") < "src2", F.concat(F.lit("context of "), "project")).alias("context"))
    return A.recall(contexts, b, now(), _packs(b)).withColumnRenamed("at", "ord")


_TRIM = "CASE WHEN len(string_split({x}, chr(10))) > {n} THEN array_to_string(string_split({x}, chr(10))[1:{m}], chr(10)) || chr(10) || '[trimmed]' ELSE {x} END"
_COMPACT = f"""WITH {_GLOBAL}, c AS (SELECT project, arg_min(content, pos) AS context FROM blocks GROUP BY 1), gt AS (SELECT string_agg(content, chr(10) || chr(10) ORDER BY ord, pos) AS x FROM (SELECT * FROM g ORDER BY ord, pos LIMIT 41)),
  sh AS (SELECT pos, content, (pos % 97) / 100.0e0 AS score, len(string_split(content, chr(10))) + 1 AS n FROM blocks WHERE project = 'src1' AND NOT {EXPIRED}), st AS (SELECT *, sum(n) OVER (ORDER BY score DESC, pos) AS total FROM sh),
  sx AS (SELECT string_agg(content, chr(10) || chr(10) ORDER BY score DESC, pos) AS x FROM st WHERE total <= 40), pk AS (SELECT string_agg('- pack' || i, chr(10) ORDER BY '- pack' || i) AS x FROM range(12) t(i))
  SELECT project, '## Project: ' || project || chr(10) || chr(10) || {_TRIM.format(x='context', n=60, m=58)} || chr(10) || chr(10) || '---' || chr(10) || chr(10) || '## User Preferences' || chr(10) || chr(10) || 'likes ' || project || chr(10) || chr(10) || '---' || chr(10) || chr(10)
    || CASE WHEN COALESCE(sx.x, '') <> '' THEN '## Shared Knowledge' || chr(10) || chr(10) || sx.x || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
    || CASE WHEN COALESCE(gt.x, '') <> '' THEN '## Global Knowledge' || chr(10) || chr(10) || {_TRIM.format(x='gt.x', n=40, m=38)} || chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END
    || '## Installed Packs' || chr(10) || chr(10) || pk.x || chr(10) || chr(10) || '---' || chr(10) || chr(10) AS memory FROM c, gt, sx, pk"""


def _compact(spark, d):
    b = blocks(spark, d)
    prefs = b.select("project").distinct().select("project", F.concat(F.lit("likes "), "project").alias("preferences"))
    shared = A.B.active(b, now()).where("project = 'src1'").select("pos", F.col("content").alias("text"), ((F.col("pos") % 97) / 100.0).alias("score"))
    packs = spark.range(12).select(F.concat(F.lit("- pack"), F.col("id").cast("string")).alias("line"))
    return D.compact_memory(_contexts(b), prefs, None, shared, A.global_knowledge(b, "src0", now()), packs)


@register("compact_sections", oracle(_COMPACT))
def compact_sections(spark, d):
    """The compact memory with all its sections."""
    return _compact(spark, d)


@register("inject_compact", oracle(f"SELECT 'compact' AS kind, memory AS text FROM ({_COMPACT})"))
def inject_compact(spark, d):
    """No hit is near enough for the smart memory."""
    b = blocks(spark, d)
    hits = R.smart_search(chunks(spark, d), [0.0] * 64, "qqxzv", now(), 20, 0.45).select("session_id", "category", "content", "score")
    return A.inject("smart", b, hits, _compact(spark, d), b.select(F.col("content").alias("text")), now(), CATEGORIES, 900)[1]


@register("inject_full", oracle(f"SELECT 'full' AS kind, text FROM ({_FULL})"))
def inject_full(spark, d):
    b = blocks(spark, d)
    full = A.full_memory(_contexts(b), b, _packs(b), "src0", "src1", now())
    return A.inject("full", b, b.limit(0), _compact(spark, d), full, now(), CATEGORIES, 900)[1]


@register("inject_cleaned", oracle(f"SELECT session_id, category FROM blocks WHERE NOT {EXPIRED}"))
def inject_cleaned(spark, d):
    """What injecting leaves of the store."""
    b = blocks(spark, d)
    return A.inject("compact", b, b.limit(0), _compact(spark, d), b.select(F.col("content").alias("text")), now(), CATEGORIES, 900)[0].select("session_id", "category")


@register("reflect_tool", oracle("SELECT session_id, category, content FROM blocks UNION ALL SELECT 'reflect-2024-02-01', c, 'Noted: ' || c FROM (SELECT unnest(['decisions', 'bugs']) AS c)"))
def reflect_tool(spark, d):
    """A free text from which a provider extracts two categories."""
    text = spark.createDataFrame([("src3", "free text")], "project string, text string")
    extract = lambda category, _: f"Noted: {category}" if category in ("decisions", "bugs") else ""
    return A.reflect(text, blocks(spark, d), now(), "2024-02-01", CATEGORIES, extract).select("session_id", "category", "content")


@register("embedded_index", "SELECT 64 AS dims, count(*) AS n, count(*) AS unit FROM (SELECT DISTINCT text FROM documents WHERE trim(text) <> '')")
def embedded_index(spark, d):
    """The default provider's vectors of all texts, equal ones once: their number, length and norm."""
    # What SQL trims are all space separators, not the space alone.
    texts = table(spark, d, "documents").where(F.col("text").rlike(r"[^\p{Zs}]")).select("text").distinct()
    v = texts.select(P.embed("text").alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return v.select(F.size("v").alias("dims"), norm.alias("norm")).groupBy("dims").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("norm") - 1) < 1e-9).alias("unit"))


@register("provider_replies", "SELECT doc_id, text AS reply FROM (SELECT doc_id, CASE WHEN contains(text, chr(10) || chr(10)) THEN list_extract(string_split(text, chr(10) || chr(10)), -1) ELSE text END AS text FROM documents)")
def provider_replies(spark, d):
    """A provider asked for a summary of every text, by batches; this one gives back the last paragraph."""
    return table(spark, d, "documents").select("doc_id", P.chat_column("text", "summary").alias("reply"))
