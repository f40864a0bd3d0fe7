"""Views of the engine's data model over the driver's tables, for queries and their DuckDB equivalents.

Each view has a Spark form (a function of session and folder) and the same
derivation as DuckDB SQL in ``SQL``; ``oracle`` puts the views that a statement
names in front of it. ``NOW`` is the time that all queries are asked at.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

NOW = "2024-02-01 00:00:00"
CATEGORIES = ["decisions", "solutions", "patterns", "bugs", "insights", "questions", "procedures"]


def now():
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its timestamps as instants of the session's zone (UTC)."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*(F.col(n).cast("timestamp").alias(n) if t == "timestamp_ntz" else F.col(n) for n, t in df.dtypes))


def _pick(column, values):
    chain = None
    for i, v in enumerate(values):
        chain = F.when(column == i, v) if chain is None else chain.when(column == i, v)
    return chain


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    kind = F.create_map(*[F.lit(x) for p in {"view": "Recall", "click": "Search", "purchase": "Lookup", "signup": "Add", "error": "Ingest"}.items() for x in p])
    return e.select(
        "event_id",
        "ts",
        kind[F.col("event_type")].alias("event_type"),
        F.concat(F.lit("proj"), (F.col("user_id") % 10).cast("string")).alias("project"),
        F.concat(F.lit("k"), (k % 20).cast("string")).alias("query"),
        F.when(k % 4 == 0, "patterns").when(k % 4 == 1, "decisions").when(k % 4 == 2, "solutions").alias("category"),
        F.when(F.col("event_type") == "error", F.floor("value")).cast("long").alias("tokens"),
        F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"),
        "value",
    )


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").alias("d").join(table(spark, sf_dir, "labels").alias("l"), "doc_id", "left")
    i = F.col("doc_id")
    ts = F.lit("2023-11-01 06:00:00").cast("timestamp") + F.make_dt_interval(days=((i * 37) % 92).cast("int"))
    return d.select(
        F.col("source").alias("project"),
        F.element_at(F.array(*map(F.lit, CATEGORIES)), (i % 7).cast("int") + 1).alias("category"),
        (i % 7).cast("int").alias("cat_ord"),
        F.concat(F.lit("s"), i.cast("string")).alias("session_id"),
        F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts_raw"),
        ts.alias("ts"),
        _pick(i % 5, ["7d", "2w", "36h", "never"]).alias("ttl"),
        F.when(F.col("quality") == 1, "high").when(F.col("quality") == 0, "low").alias("confidence"),
        F.when(i % 3 == 0, 1 + 0.5 * (i % 5)).cast("double").alias("strength"),
        F.col("text").alias("content"),
        i.alias("pos"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").alias("e")
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    i = F.col("vec_id")
    ts = F.lit("2023-11-01 06:00:00").cast("timestamp") + F.make_dt_interval(days=((i * 37) % 92).cast("int"))
    return e.join(d, "vec_id", "left").select(
        i.alias("id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.col("embedding").cast("array<double>").alias("embedding"),
        F.concat(F.lit("p"), (i % 5).cast("string")).alias("project"),
        F.col("label").cast("string").alias("category"),
        F.concat(F.lit("s"), (i % 100).cast("string")).alias("session_id"),
        ts.alias("ts"),
    )


def query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    """The vector of chunk 0, as a query: one row."""
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return [float(x) for x in row[0]] if row else []


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("dst"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("src"))
    n = li.select("l_orderkey", "l_suppkey").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey").join(c, "o_custkey").join(s, "l_suppkey").groupBy("src", "dst").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return n.withColumn("rank", rank).where("rank <= 2 AND src <> dst").select("src", "dst", F.when(F.col("rank") == 1, "depends_on").otherwise("relates_to").alias("rel_type"), (1.0 / F.col("rank")).alias("strength"), "n")


def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("r"), F.col("n_regionkey").cast("string")).alias("category"), (F.col("n_nationkey") / 25.0).alias("importance"))


def part_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A part's five most frequent next parts in orders, with their rank: a graph of all parts."""
    behind = F.lead("l_partkey").over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey"))
    steps = table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("src"), behind.alias("dst")).where("src <> dst")
    n = steps.groupBy("src", "dst").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("n"), "dst"))
    return n.withColumn("rank", rank).where("rank <= 5").select("src", "dst", "rank")


def boosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = blocks(spark, sf_dir)
    key = F.when(F.col("pos") % 3 == 0, F.col("session_id")).when(F.col("pos") % 3 == 1, F.concat_ws(":", "category", "session_id")).otherwise(F.concat_ws(":", "project", "session_id"))
    return b.where("pos % 4 <> 0").select(key.alias("key"), ((F.col("pos") % 10) / 10.0).alias("boost"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transcript entries: conversations without their system turns."""
    return table(spark, sf_dir, "conversations").where("role <> 'system'").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("pos"), "role", "text")


def tool_uses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Synthetic tool uses in assistant entries: tool by position, ids that repeat."""
    t = turns(spark, sf_dir)
    name = F.element_at(F.array(*map(F.lit, ["Bash", "Read", "Edit", "Grep"])), (F.col("pos") % 4).cast("int") + 1)
    return t.where("pos % 3 = 1").select("session_id", F.concat(F.lit("t"), (F.col("pos") % 4).cast("string")).alias("id"), "pos", name.alias("tool"), F.col("text").alias("input"))


def tool_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = turns(spark, sf_dir)
    return t.where("pos % 2 = 0").select("session_id", F.concat(F.lit("t"), ((F.col("pos") + 3) % 4).cast("string")).alias("id"), "pos", F.col("text").alias("output"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('purchase', 'click')")
    return e.select("event_id", "ts", F.when(F.col("event_type") == "purchase", "Edit").otherwise("Read").alias("tool"), F.concat(F.lit("f"), F.get_json_object("props", "$.k")).alias("file"), F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("session_id"))


def packs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_type").alias("description"), F.split("p_name", " ").alias("keywords"), F.array("p_brand").alias("categories"), (F.col("p_partkey") % 4).alias("registry"))


def commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A commit an order, on top of one of the three orders before; a branch a priority."""
    o = table(spark, sf_dir, "orders")
    n = F.col("o_orderkey")
    parent = n - 1 - F.col("o_custkey") % 3
    message = F.concat(F.when(F.col("o_orderstatus") == "F", "Fix ").otherwise("Add "), F.lower("o_orderpriority"))
    return o.select(F.concat(F.lit("c"), n.cast("string")).alias("id"), F.when(parent >= 0, F.concat(F.lit("c"), parent.cast("string"))).alias("parent"), message.alias("message"), n.alias("seq"), F.lower(F.regexp_extract("o_orderpriority", "^[0-9]-([A-Z]+)", 1)).alias("branch"))


SQL = {
    "commits": """SELECT 'c' || o_orderkey AS id, CASE WHEN o_orderkey - 1 - o_custkey % 3 >= 0 THEN 'c' || (o_orderkey - 1 - o_custkey % 3) END AS parent,
        CASE WHEN o_orderstatus = 'F' THEN 'Fix ' ELSE 'Add ' END || lower(o_orderpriority) AS message, o_orderkey AS seq, lower(regexp_extract(o_orderpriority, '^[0-9]-([A-Z]+)', 1)) AS branch FROM orders""",
    "usage_events": """SELECT event_id, ts, CASE event_type WHEN 'view' THEN 'Recall' WHEN 'click' THEN 'Search' WHEN 'purchase' THEN 'Lookup' WHEN 'signup' THEN 'Add' WHEN 'error' THEN 'Ingest' END AS event_type,
        'proj' || (user_id % 10) AS project, 'k' || (CAST(json_extract(props, '$.k') AS BIGINT) % 20) AS query,
        CASE CAST(json_extract(props, '$.k') AS BIGINT) % 4 WHEN 0 THEN 'patterns' WHEN 1 THEN 'decisions' WHEN 2 THEN 'solutions' END AS category,
        CASE WHEN event_type = 'error' THEN CAST(floor(value) AS BIGINT) END AS tokens, 's' || user_id AS session_id, value FROM events""",
    "blocks": """SELECT source AS project, (['decisions','solutions','patterns','bugs','insights','questions','procedures'])[CAST(doc_id % 7 AS INT) + 1] AS category, CAST(doc_id % 7 AS INT) AS cat_ord,
        's' || doc_id AS session_id, strftime(TIMESTAMP '2023-11-01 06:00:00' + to_days(CAST((doc_id * 37) % 92 AS INT)), '%Y-%m-%dT%H:%M:%SZ') AS ts_raw,
        TIMESTAMP '2023-11-01 06:00:00' + to_days(CAST((doc_id * 37) % 92 AS INT)) AS ts,
        CASE doc_id % 5 WHEN 0 THEN '7d' WHEN 1 THEN '2w' WHEN 2 THEN '36h' WHEN 3 THEN 'never' END AS ttl,
        CASE quality WHEN 1 THEN 'high' WHEN 0 THEN 'low' END AS confidence, CASE WHEN doc_id % 3 = 0 THEN CAST(1 + 0.5e0 * (doc_id % 5) AS DOUBLE) END AS strength,
        text AS content, doc_id AS pos FROM documents LEFT JOIN labels USING (doc_id)""",
    "chunks": """SELECT vec_id AS id, COALESCE(text, '') AS text, CAST(embedding AS DOUBLE[]) AS embedding, 'p' || (vec_id % 5) AS project, CAST(label AS VARCHAR) AS category, 's' || (vec_id % 100) AS session_id,
        TIMESTAMP '2023-11-01 06:00:00' + to_days(CAST((vec_id * 37) % 92 AS INT)) AS ts FROM embeddings LEFT JOIN documents ON doc_id = vec_id""",
    "graph_edges": """SELECT src, dst, CASE WHEN rank = 1 THEN 'depends_on' ELSE 'relates_to' END AS rel_type, 1.0e0 / rank AS strength, n FROM (
        SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM (
        SELECT s_nationkey AS src, c_nationkey AS dst, count(*) AS n FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1, 2)) WHERE rank <= 2 AND src <> dst""",
    "part_edges": """SELECT src, dst, rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY n DESC, dst) AS rank FROM (SELECT src, dst, count(*) AS n FROM (
        SELECT l_partkey AS src, lead(l_partkey) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS dst FROM lineitem) WHERE src <> dst GROUP BY 1, 2)) WHERE rank <= 5""",
    "graph_nodes": "SELECT n_nationkey AS id, n_name AS name, 'r' || n_regionkey AS category, n_nationkey / 25.0e0 AS importance FROM nation",
    "boosts": """SELECT CASE pos % 3 WHEN 0 THEN session_id WHEN 1 THEN category || ':' || session_id ELSE project || ':' || session_id END AS key, (pos % 10) / 10.0e0 AS boost FROM blocks WHERE pos % 4 <> 0""",
    "turns": "SELECT conv_id AS session_id, turn AS pos, role, text FROM conversations WHERE role <> 'system'",
    "tool_uses": """SELECT session_id, 't' || (pos % 4) AS id, pos, (['Bash','Read','Edit','Grep'])[CAST(pos % 4 AS INT) + 1] AS tool, text AS input FROM turns WHERE pos % 3 = 1""",
    "tool_results": "SELECT session_id, 't' || ((pos + 3) % 4) AS id, pos, text AS output FROM turns WHERE pos % 2 = 0",
    "observations": """SELECT event_id, ts, CASE WHEN event_type = 'purchase' THEN 'Edit' ELSE 'Read' END AS tool, 'f' || CAST(json_extract(props, '$.k') AS VARCHAR) AS file, 's' || user_id AS session_id FROM events WHERE event_type IN ('purchase', 'click')""",
    "packs": "SELECT p_partkey AS id, p_name AS name, p_type AS description, string_split(p_name, ' ') AS keywords, [p_brand] AS categories, p_partkey % 4 AS registry FROM part",
}


def oracle(statement: str) -> str:
    """The statement with the views it names, and theirs, as common table expressions."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in SQL:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(SQL[name])
                needed.append(name)

    need(statement)
    if not needed:
        return statement
    head = ", ".join(f"{n} AS ({SQL[n]})" for n in needed)
    body = statement.strip()
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {head}, {body[14:]}"
    if body.upper().startswith("WITH"):
        return f"WITH {head}, {body[4:]}"
    return f"WITH {head} {body}"
