"""Queries of text functions: chunking, cleaning, parsing, secrets, answer scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scoring import expired, ttl_seconds
from quillspark.operators.fuzzy import fuzzy_match
from quillspark.plans.catalog import register
from quillspark.plans.knowledge import _PREVIEW, _STOP
from quillspark.sources.views import CATEGORIES, NOW, blocks, now, oracle, table

@register("tokens", oracle("SELECT pos, len(t) AS n, array_to_string(t[1:20], ' ') AS head FROM (SELECT pos, list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}_]+'), lambda t: octet_length(encode(t)) > 1) AS t FROM blocks)"))
def tokens(spark, d):
    t = T.tokens("content")
    return blocks(spark, d).select("pos", F.size(t).cast("long").alias("n"), F.array_join(F.slice(t, 1, 20), " ").alias("head"))


@register("keywords", oracle(f"SELECT pos, array_to_string(list_filter(list_transform(regexp_split_to_array(content, '[^\\p{{L}}\\p{{N}}_-]+'), lambda w: lower(regexp_replace(w, '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g'))), lambda w: octet_length(encode(w)) > 3 AND NOT list_contains({_STOP}, w)), ' ') AS words FROM blocks"))
def keywords(spark, d):
    return blocks(spark, d).select("pos", F.array_join(T.keywords("content"), " ").alias("words"))


@register("word_sets", oracle("SELECT pos, len(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: octet_length(encode(t)) > 4))) AS n FROM blocks"))
def word_sets(spark, d):
    return blocks(spark, d).select("pos", F.size(T.word_set("content")).cast("long").alias("n"))


@register("preview", oracle(f"SELECT pos, {_PREVIEW.format(n=80)} AS preview FROM blocks"))
def preview(spark, d):
    return blocks(spark, d).select("pos", T.preview("content").alias("preview"))


@register("truncate_bytes", oracle("SELECT pos, CASE WHEN strlen(content) <= 300 THEN content ELSE left(content, list_max(list_filter(range(0, 301), lambda k: strlen(left(content, k)) <= 300))) || '...' END AS cut FROM blocks"))
def truncate_bytes(spark, d):
    return blocks(spark, d).select("pos", T.truncate_bytes("content", 300, "...").alias("cut"))


@register("strip_private", oracle("SELECT pos, regexp_replace(regexp_replace(content || '<private>a' || chr(10) || 'b</PRIVATE>' || chr(10) || chr(10) || chr(10) || chr(10) || content, '<private>.*?</private>', '', 'gsi'), '\\n{3,}', chr(10) || chr(10), 'g') AS shown FROM blocks"))
def strip_private(spark, d):
    text = F.concat("content", F.lit("<private>a\nb</PRIVATE>\n\n\n\n"), "content")
    return blocks(spark, d).select("pos", T.strip_private(text).alias("shown"))


@register("confidence", oracle("SELECT pos, 'body ' || pos AS content, CASE pos % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' END AS level FROM blocks"))
def confidence(spark, d):
    word = F.element_at(F.array(F.lit("HIGH"), F.lit("medium"), F.lit("Low."), F.lit("?")), (F.col("pos") % 4).cast("int") + 1)
    text = F.concat(F.lit("body "), F.col("pos").cast("string"), F.lit("\n  Confidence: "), word, F.lit("\n\n"))
    return blocks(spark, d).select("pos", T.confidence(text).alias("c")).select("pos", "c.content", "c.level")


@register("resolver_actions", oracle("SELECT pos, (['ADD','NOOP','UPDATE','DELETE','ADD'])[CAST(pos % 5 AS INT) + 1] AS action, CASE WHEN pos % 5 IN (2, 3) THEN session_id END AS id, CASE WHEN pos % 5 = 2 THEN 'new' || chr(10) || 'text' END AS body FROM blocks"))
def resolver_actions(spark, d):
    k, sid = F.col("pos") % 5, F.col("session_id")
    reply = F.when(k == 0, "add").when(k == 1, " NOOP ").when(k == 2, F.concat(F.lit("UPDATE "), sid, F.lit("\nnew\ntext\n"))).when(k == 3, F.concat(F.lit("delete "), sid)).otherwise("UPDATE only")
    return blocks(spark, d).select("pos", T.resolver_action(reply).alias("r")).select("pos", "r.action", "r.id", "r.body")


@register("selected_ids", oracle("SELECT pos, array_to_string([session_id, 'a', 'b', 'unknown:c', 'd'], '|') AS ids FROM blocks"))
def selected_ids(spark, d):
    text = F.concat(F.lit("bugs:decisions:"), F.col("session_id"), F.lit(", a,, patterns:b , unknown:c,d,e,f"))
    return blocks(spark, d).select("pos", F.array_join(T.selected_ids(text, CATEGORIES), "|").alias("ids"))


@register("sanitize_id", oracle("SELECT pos, regexp_replace(regexp_replace(' ' || session_id || '/é:x y.z! ', '[^\\p{L}\\p{N}:_.-]', '-', 'g'), '^-+|-+$', '', 'g') AS id FROM blocks"))
def sanitize_id(spark, d):
    return blocks(spark, d).select("pos", T.sanitize_id(F.concat(F.lit(" "), F.col("session_id"), F.lit("/é:x y.z! "))).alias("id"))


@register("block_headers", oracle("SELECT pos, '## Session: ' || session_id || ' (' || ts_raw || ')' || COALESCE(' [ttl:' || ttl || ']', '') || COALESCE(' [confidence:' || confidence || ']', '') || COALESCE(' [strength:' || printf('%.2f', strength) || ']', '') || CASE WHEN pos % 2 = 0 THEN ' [access:' || (pos % 5) || ']' ELSE '' END AS header FROM blocks"))
def block_headers(spark, d):
    strength = F.col("strength")
    return blocks(spark, d).select("pos", T.header(F.col("session_id"), F.col("ts_raw"), F.col("ttl"), F.col("confidence"), F.when(strength.isNotNull(), strength), F.when(F.col("pos") % 2 == 0, (F.col("pos") % 5).cast("string"))).alias("header"))


@register("parse_blocks", oracle(f"SELECT 's' || (pos * 2 + k) AS session_id, ts_raw, ttl, confidence, 'Line ' || k || chr(10) || '## not a heading' AS content, 'Line ' || k AS preview FROM blocks, range(2) t(k)"))
def parse_blocks(spark, d):
    """Markdown of two blocks a file behind a preamble, written and parsed again."""
    from quillspark.sources.markdown import parse_blocks as parse

    b = blocks(spark, d)
    block = lambda k: F.concat(T.header(F.concat(F.lit("s"), (F.col("pos") * 2 + k).cast("string")), F.col("ts_raw"), F.col("ttl"), F.col("confidence"), F.lit(None).cast("double"), F.lit(None).cast("string")), F.lit(f"\n\nLine {k}\n## not a heading\n\n"))
    files = b.select("pos", F.concat(F.lit("# Knowledge\nabout\n\n"), block(0), block(1)).alias("value"))
    return parse(files).select("session_id", "ts_raw", "ttl", "confidence", "content", "preview")


@register("chunk_text", oracle("""WITH RECURSIVE p AS (SELECT pos, list_filter(string_split(content, chr(10)), lambda v: trim(v) <> '') AS ps FROM blocks),
  w AS (SELECT pos, ps, 1 AS i, '' AS held, 0 AS size, 0 AS done FROM p UNION ALL
    SELECT pos, ps, i + 1, CASE WHEN full_ OR held = '' THEN ps[i] ELSE held || chr(10) || chr(10) || ps[i] END, CASE WHEN full_ THEN n ELSE size + n END, CASE WHEN full_ THEN done + 1 ELSE done END
    FROM (SELECT *, strlen(ps[i]) AS n, size > 0 AND size + strlen(ps[i]) > 1000 AS full_ FROM w WHERE i <= len(ps)))
  SELECT pos, CAST(done AS INT) AS chunk, arg_max(held, i) AS text FROM w WHERE held <> '' GROUP BY 1, 2"""))
def chunk_text(spark, d):
    text = F.replace(F.col("content"), F.lit("\n"), F.lit("\n\n"))
    return blocks(spark, d).select("pos", F.posexplode(T.chunk_paragraphs(text, 1000)).alias("chunk", "text"))


@register("chunk_ids", oracle("SELECT pos, substr(sha256(content), 1, 16) AS id FROM blocks"))
def chunk_ids(spark, d):
    return blocks(spark, d).select("pos", T.chunk_id("content").alias("id"))


@register("token_estimate", oracle("SELECT pos, greatest(1, strlen(content) // 4) AS tokens FROM blocks"))
def token_estimate(spark, d):
    return blocks(spark, d).select("pos", T.token_estimate("content").alias("tokens"))


_QUOTED = [(n, p.replace("'", "''")) for n, p in T.SECRETS.items()]
_PLANT = "'head' || chr(10) || CASE WHEN pos % 5 = 0 THEN 'Example: ' ELSE '' END || CASE pos % 3 WHEN 0 THEN 'api_key = ' || repeat('Ab1_', 6) WHEN 1 THEN 'id AKIA' || repeat('A1B2', 4) ELSE 'ghp_' || repeat('a1B2c3', 6) END || chr(10) || COALESCE(content, '')"
_FALSE = " OR ".join(f"contains(lower(m), '{w}')" for w in T.FALSE_SECRETS)


@register("secret_scan", oracle(f"""WITH x AS (SELECT pos, string_split({_PLANT}, chr(10)) AS ls FROM blocks), l AS (SELECT pos, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS line_no FROM x),
  k AS (SELECT pos, line, CAST(line_no AS INT) AS line_no, unnest([{", ".join(f"{{'n': '{n}', 'm': regexp_extract(line, '{q}')}}" for n, q in _QUOTED)}]) AS k FROM l), h AS (SELECT pos, line, line_no, k.n AS secret, k.m AS m FROM k WHERE k.m <> '')
  SELECT pos, line_no, secret, CASE WHEN length(m) <= 10 THEN repeat('*', length(m)) ELSE left(m, 3) || '***' || right(m, 3) END AS masked FROM h WHERE NOT (contains(line, 'Example:') OR contains(line, 'example') OR {_FALSE} OR regexp_matches(m, '^[x*]+$'))"""))
def secret_scan(spark, d):
    """Every line of every text, behind a planted line of three kinds of secrets, a fifth of them examples."""
    k = F.col("pos") % 3
    secret = F.when(k == 0, F.concat(F.lit("api_key = "), F.repeat(F.lit("Ab1_"), F.lit(6)))).when(k == 1, F.concat(F.lit("id AKIA"), F.repeat(F.lit("A1B2"), F.lit(4)))).otherwise(F.concat(F.lit("ghp_"), F.repeat(F.lit("a1B2c3"), F.lit(6))))
    text = F.concat(F.lit("head\n"), F.when(F.col("pos") % 5 == 0, "Example: ").otherwise(""), secret, F.lit("\n"), F.coalesce("content", F.lit("")))
    return blocks(spark, d).select("pos", F.explode(T.secret_hits(text)).alias("h")).select("pos", "h.line_no", "h.secret", "h.masked")


_REDACTED = "content || ' api_key = ' || repeat('Ab1_', 6) || ' tail'"
for _n, _q in _QUOTED:
    _REDACTED = f"regexp_replace({_REDACTED}, '{_q}', '[REDACTED:{_n}]', 'g')"


@register("redact", oracle(f"SELECT pos, {_REDACTED} AS shown FROM blocks"))
def redact(spark, d):
    text = F.concat("content", F.lit(" api_key = "), F.repeat(F.lit("Ab1_"), F.lit(6)), F.lit(" tail"))
    return blocks(spark, d).select("pos", T.redact(text).alias("shown"))


NORM = "list_filter(string_split(trim(regexp_replace(regexp_replace(regexp_replace(lower(replace({c}, ',', '')), '\\b(a|an|the|and)\\b', ' ', 'g'), '[^a-z0-9 ]', '', 'g'), ' +', ' ', 'g')), ' '), lambda t: t <> '')"


@register("token_f1", oracle(f"""WITH q AS (SELECT item_id, {NORM.format(c="regexp_replace(b.text, '[^ -~]', '', 'g')")} AS g, {NORM.format(c="regexp_replace(d.text, '[^ -~]', '', 'g')")} AS p FROM benchmark b JOIN documents d ON doc_id = item_id), s AS (SELECT *, len(list_intersect(p, g)) AS sh FROM q)
  SELECT item_id, round(CASE WHEN len(p) = 0 OR len(g) = 0 THEN CASE WHEN len(p) = len(g) THEN 1.0e0 ELSE 0 END WHEN sh = 0 THEN 0 ELSE 2.0e0 * (sh / len(p)) * (sh / len(g)) / (sh / len(p) + sh / len(g)) END, 6) AS f1 FROM s"""))
def token_f1(spark, d):
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("item_id"), F.col("text").alias("prediction"))
    qa = table(spark, d, "benchmark").join(docs, "item_id")
    return qa.select("item_id", F.round(T.token_f1(F.regexp_replace("prediction", "[^ -~]", ""), F.regexp_replace("text", "[^ -~]", "")), 6).alias("f1"))


@register("decode_projects", oracle("SELECT pos, CASE pos % 4 WHEN 0 THEN 'app-x' WHEN 1 THEN 'home' WHEN 2 THEN 'deep-app' ELSE 'one' END AS name FROM blocks"))
def decode_projects(spark, d):
    raw = F.element_at(F.array(F.lit("-Users-me-Projects-app-x"), F.lit("-Users-me"), F.lit("-srv-data-deep-app"), F.lit("one")), (F.col("pos") % 4).cast("int") + 1)
    return blocks(spark, d).select("pos", T.decode_project(raw).alias("name"))


@register("ttl_parse", oracle(f"SELECT session_id, CAST(CASE ttl WHEN '7d' THEN 604800 WHEN '2w' THEN 1209600 WHEN '36h' THEN 129600 END AS BIGINT) AS seconds, COALESCE(TIMESTAMP '{NOW}' > ts + CASE ttl WHEN '7d' THEN INTERVAL 7 DAY WHEN '2w' THEN INTERVAL 14 DAY WHEN '36h' THEN INTERVAL 36 HOUR END, false) AS expired FROM blocks"))
def ttl_parse(spark, d):
    return blocks(spark, d).select("session_id", ttl_seconds(F.col("ttl")).alias("seconds"), expired(F.col("ts"), F.col("ttl"), now()).alias("expired"))


@register("fuzzy_predicate", oracle("SELECT id, name FROM packs WHERE regexp_matches(lower(name), '.*r.*d.*w.*')"))
def fuzzy_predicate(spark, d):
    from quillspark.sources.views import packs

    return fuzzy_match(packs(spark, d), "name", "rdw").select("id", "name")
