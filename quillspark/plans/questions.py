"""Queries over a table of questions: every item of benchmark asked in one plan."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import questions as Q
from quillspark.plans.catalog import register
from quillspark.plans.texts import NORM
from quillspark.sources.stores import scratch
from quillspark.sources.views import chunks, oracle, table

_TOKENS = "list_filter(regexp_split_to_array(lower({c}), '[^\\p{{L}}\\p{{N}}_]+'), lambda t: octet_length(encode(t)) > 1)"
_ASKED = "asked AS (SELECT item_id AS qid, b.text, CAST(e.embedding AS DOUBLE[]) AS vector FROM benchmark b LEFT JOIN embeddings e ON vec_id = item_id)"
_WORDS = f"""words AS (SELECT id, {_TOKENS.format(c="text")} AS toks FROM chunks), figures AS (SELECT count(*) AS docs, avg(len(toks)) AS mean FROM words),
  tf AS (SELECT id, term, length, count(*) AS tf FROM (SELECT id, len(toks) AS length, unnest(toks) AS term FROM words) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),
  named AS (SELECT qid, term, count(*) AS times FROM (SELECT qid, unnest({_TOKENS.format(c="text")}) AS term FROM asked) GROUP BY ALL),
  bm25 AS (SELECT qid, id, round(sum(times * ln((docs - df + 0.5e0) / (df + 0.5e0) + 1) * tf * 2.5e0 / (tf + 1.5e0 * (0.25e0 + 0.75e0 * length / mean))), 9) AS score FROM named JOIN tf USING (term) JOIN df USING (term), figures GROUP BY 1, 2)"""
_COSINES = "cosines AS (SELECT qid, id, CASE WHEN len(embedding) = len(vector) THEN round(list_cosine_similarity(embedding, vector), 9) ELSE 0 END AS score FROM asked, chunks WHERE vector IS NOT NULL)"
_RANKED = "SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, id) AS rank FROM {t}"
_FUSED = f"""fused AS (SELECT qid, id, sum(1.0e0 / (60 + rank)) AS score FROM (SELECT * FROM ({_RANKED.format(t='bm25')}) WHERE rank <= 30 UNION ALL SELECT * FROM ({_RANKED.format(t='cosines')}) WHERE rank <= 30) GROUP BY 1, 2)"""


def asked(spark, d) -> DataFrame:
    """qid, text and vector: the items of benchmark, each with the vector of its number."""
    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").cast("array<double>").alias("vector"))
    return table(spark, d, "benchmark").join(vectors, "item_id", "left").select(F.col("item_id").alias("qid"), "text", "vector")


def index(spark, d) -> Q.Words:
    """The words of all chunks, indexed once for all questions."""
    path = f"{scratch(spark)}/index/words-{uuid.uuid4().hex}"
    Q.build(chunks(spark, d).select("id", "text"), path)
    return Q.Words(spark, path)


def _rounded(hits: DataFrame) -> DataFrame:
    return hits.select("qid", "id", F.round("score", 6).alias("score"))


@register("asked_bm25", oracle(f"WITH {_ASKED}, {_WORDS} SELECT qid, id, round(score, 6) AS score FROM ({_RANKED.format(t='bm25')}) WHERE rank <= 10"))
def asked_bm25(spark, d):
    return _rounded(index(spark, d).search(asked(spark, d), 10))


@register("asked_dense", oracle(f"WITH {_ASKED}, {_COSINES} SELECT qid, id, round(score, 6) AS score FROM ({_RANKED.format(t='cosines')}) WHERE rank <= 10"))
def asked_dense(spark, d):
    return _rounded(Q.dense(chunks(spark, d), asked(spark, d), 10))


@register("asked_hybrid", oracle(f"WITH {_ASKED}, {_WORDS}, {_COSINES}, {_FUSED} SELECT qid, id, round(score, 6) AS score FROM ({_RANKED.format(t='fused')}) WHERE rank <= 10"))
def asked_hybrid(spark, d):
    return _rounded(Q.hybrid(chunks(spark, d), index(spark, d), asked(spark, d), 10))


PLAIN = "regexp_replace({c}, '[^ -~\n]', '', 'g')"
_F1 = "CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0e0 ELSE 0 END WHEN len(list_intersect(p, g)) = 0 THEN 0 ELSE 2.0e0 * (len(list_intersect(p, g)) / len(p)) * (len(list_intersect(p, g)) / len(g)) / (len(list_intersect(p, g)) / len(p) + len(list_intersect(p, g)) / len(g)) END"


@register("asked_report", oracle(f"""WITH {_ASKED}, {_WORDS}, top AS (SELECT qid, id FROM ({_RANKED.format(t='bm25')}) WHERE rank = 1),
  ls AS (SELECT qid, category, unnest(string_split(c.text, chr(10))) AS line, a.text AS question FROM top JOIN chunks c USING (id) JOIN asked a USING (qid)),
  f AS (SELECT qid, category, max({_F1}) AS f1 FROM (SELECT qid, category, {NORM.format(c=PLAIN.format(c='line'))} AS p, {NORM.format(c=PLAIN.format(c='question'))} AS g FROM ls) GROUP BY 1, 2),
  told AS (SELECT category, COALESCE(f1, 0) AS f1, CASE WHEN f.qid IS NULL THEN 1.0e0 ELSE 0 END AS missing FROM asked LEFT JOIN f USING (qid))
  SELECT category, count(*) AS n, round(avg(f1), 6) AS f1, round(avg(missing), 6) AS not_found FROM told GROUP BY GROUPING SETS ((category), ())"""))
def asked_report(spark, d):
    """What the indexed search answers to every item, against the item's own text, by the category of what was found; answers are compared by their ASCII."""
    plain = lambda df: df.withColumn("text", F.regexp_replace("text", "[^ -~\n]", ""))
    hits = index(spark, d).search(asked(spark, d), 1)
    questions, c = plain(asked(spark, d)), plain(chunks(spark, d))
    report = Q.evaluated(Q.answers(c, hits, questions), questions.select("qid", F.col("text").alias("expected")))
    return report.select("category", "n", F.round("f1", 6).alias("f1"), F.round("not_found", 6).alias("not_found"))
