"""Assembled documents: memories within budgets, exports, renderings, summaries.

Exports come as ordered rows, a block each, so that no task gathers a whole
project; what is gathered is bounded by a budget or by one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.blocks import active, trim_lines

# Lines of the sections of a compact memory, and of all of it.
BUDGETS, ALL_LINES = {"project": 60, "preferences": 25, "shared": 40, "global": 40}, 180


def scaled(base: int, lines: int | None) -> int:
    return base if lines is None else max(1, int(base * lines / ALL_LINES + 0.5))


def smart_memory(hits: DataFrame, categories: list[str], budget: int) -> DataFrame:
    """One document of a bounded list of hits: categories in order, each while its tokens fit the budget."""
    order = Window.partitionBy("category").orderBy(F.desc("score"), "session_id").rowsBetween(Window.unboundedPreceding, 0)
    sized = hits.withColumn("tokens", T.token_estimate("content")).withColumn("over", (F.sum("tokens").over(order) > budget).cast("int"))
    kept = sized.withColumn("cut", F.max("over").over(order)).where("cut = 0")
    rank = F.array_position(F.array(*map(F.lit, categories)), F.col("category"))
    part = F.concat(F.format_string("<!-- relevance: %d%% -->\n", F.floor(F.col("score") * 100 + 0.5)), F.trim("content"))
    sections = kept.where(rank > 0).groupBy("category").agg(F.first(rank).alias("rank"), F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "session_id", part.alias("part")))).alias("parts"))
    text = F.concat(F.lit("### "), F.col("category"), F.lit("\n\n"), F.array_join(F.transform("parts", lambda x: x["part"]), "\n\n"))
    return sections.agg(T.strip_private(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]), "\n\n")).alias("memory"))


def first_lines(rows: DataFrame, n: int) -> DataFrame:
    """One row, ``text``: the first n lines, one more to tell that there are more, of ordered rows (at, pos, text); each has a line at least, so only the first n + 1 are gathered."""
    few = rows.orderBy("at", "pos").limit(n + 1)
    return few.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "pos", "text"))), lambda r: r["text"]), "\n\n").alias("text"))


def compact_memory(context: DataFrame, preferences: DataFrame, lines: int | None = None, shared: DataFrame | None = None, everywhere: DataFrame | None = None, packs: DataFrame | None = None) -> DataFrame:
    """One compact document a project, within line budgets: its context, preferences, then what all projects have alike: shared blocks by importance while they fit, global knowledge, a line a pack."""
    joined = context.join(preferences, "project", "left")
    section = lambda title, body: F.when(F.coalesce(body, F.lit("")) != "", F.concat(F.lit(f"## {title}\n\n"), body, F.lit("\n\n---\n\n"))).otherwise("")
    parts = [F.concat(F.lit("## Project: "), "project", F.lit("\n\n"), trim_lines(F.col("context"), scaled(BUDGETS["project"], lines)), F.lit("\n\n---\n\n")), section("User Preferences", trim_lines(F.col("preferences"), scaled(BUDGETS["preferences"], lines)))]
    if shared is not None:
        budget = scaled(BUDGETS["shared"], lines)
        order = Window.orderBy(F.desc("score"), "pos").rowsBetween(Window.unboundedPreceding, 0)
        best = shared.orderBy(F.desc("score"), "pos").limit(budget).withColumn("total", F.sum(F.size(T.lines("text")) + 1).over(order)).where(F.col("total") <= budget)
        one = best.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("s"), "pos", "text"))), lambda r: r["text"]), "\n\n").alias("shared"))
        joined = joined.crossJoin(F.broadcast(one))
        parts.append(section("Shared Knowledge", F.col("shared")))
    if everywhere is not None:
        budget = scaled(BUDGETS["global"], lines)
        joined = joined.crossJoin(F.broadcast(first_lines(everywhere, budget).select(trim_lines(F.col("text"), budget).alias("everywhere"))))
        parts.append(section("Global Knowledge", F.col("everywhere")))
    if packs is not None:
        listed = packs.orderBy("line").limit(ALL_LINES).agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("packs"))
        joined = joined.crossJoin(F.broadcast(listed))
        parts.append(section("Installed Packs", F.col("packs")))
    return joined.select("project", T.strip_private(F.concat(*parts)).alias("memory"))


def export_markdown(blocks: DataFrame, now: Column) -> DataFrame:
    """Active blocks as ordered rows of markdown: project, category, pos, text."""
    head = T.header(F.col("session_id"), F.col("ts_raw"), F.col("ttl"), F.col("confidence"), F.col("strength"), F.lit(None).cast("string"))
    return active(blocks, now).select("project", "category", "pos", F.concat(head, F.lit("\n\n"), F.trim("content"), F.lit("\n")).alias("text"))


def export_json(blocks: DataFrame, now: Column) -> DataFrame:
    return active(blocks, now).select("pos", F.to_json(F.struct("session_id", "category", F.col("ts_raw").alias("timestamp"), "content")).alias("json"))


def export_html(blocks: DataFrame, now: Column) -> DataFrame:
    escape = lambda x: F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return active(blocks, now).select("project", "category", "pos", F.concat(F.lit("<section><h3>"), escape(F.col("session_id")), F.lit("</h3><pre>"), escape(F.col("content")), F.lit("</pre></section>")).alias("html"))


def render_conversation(turns: DataFrame, most: int = 2000) -> DataFrame:
    """A session's turns as markdown, long texts cut and marked."""
    shown = lambda x: F.when(F.octet_length(F.trim(x)) > most, F.concat(T.truncate_bytes(F.trim(x), most), F.lit("\n\n*[truncated]*"))).otherwise(F.trim(x))
    part = F.concat(F.lit("## Turn "), F.col("turn_no").cast("string"), F.lit("\n\n### User\n\n"), shown(F.col("user_text")), F.lit("\n\n### Assistant\n\n"), shown(F.col("assistant_text")))
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", part.alias("part"))))
    return turns.groupBy("session_id").agg(F.concat(F.lit("# Session: "), F.col("session_id").cast("string"), F.lit("\n\n**Turns:** "), F.count("*").cast("string"), F.lit("\n\n---\n\n"), F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n")).alias("markdown"))


def pack_summary(files: DataFrame) -> DataFrame:
    """A line a pack: its categories with the number of blocks in each file."""
    counted = files.withColumn("n", F.regexp_count("content", F.lit("## Session:"))).where("n > 0")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("category", "n"))), lambda x: F.concat(x["category"], F.lit(" ("), x["n"].cast("string"), F.lit(" entries)"))), ", ")
    return counted.groupBy("pack").agg(listed.alias("listed")).select(F.concat(F.lit("- **"), "pack", F.lit("**: "), "listed").alias("line"))


def project_list(blocks: DataFrame) -> DataFrame:
    """Sessions, bytes and newest time of each project."""
    return blocks.groupBy("project").agg(F.countDistinct("session_id").alias("sessions"), F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.max("ts_raw").alias("newest"))


def store_status(files: DataFrame) -> DataFrame:
    """One row: files by kind, bytes, projects."""
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    return files.agg(F.count("*").alias("files"), F.count_if(ext == "md").alias("markdown"), F.count_if(ext == "json").alias("json"), F.sum("size").alias("bytes"), F.countDistinct("project").alias("projects"))


def pack_health(packs: DataFrame, registries: DataFrame) -> DataFrame:
    """Issues of installed packs: no manifest, no knowledge, registry gone."""
    known = packs.join(registries.select("registry", F.lit(True).alias("there")), "registry", "left")
    rule = lambda when, issue: F.when(when, F.lit(issue))
    found = F.array_compact(F.array(rule(F.col("version").isNull() | ~F.col("version").contains("."), "invalid_manifest"), rule(F.col("n_files") == 0, "no_knowledge"), rule(F.col("there").isNull(), "orphaned")))
    return known.select("id", F.explode(found).alias("issue"))


def pack_gate(files: DataFrame, categories: tuple[str, ...] = ("patterns", "solutions")) -> DataFrame:
    """Packs that may be published: the default policy's categories, and no secret in any of their files."""
    kept = files.where(F.col("category").isin(*categories))
    secret = F.lit(False)
    for pattern in T.SECRETS.values():
        secret = secret | F.col("content").rlike(pattern)
    return kept.groupBy("pack").agg(F.count("*").alias("files"), F.count_if(secret).alias("secrets")).withColumn("allowed", F.col("secrets") == 0)


def graph_of_json(replies: DataFrame, relations: list[str], categories: list[str]) -> DataFrame:
    """Edges of concept graphs that replies hold as JSON, fenced or not: unknown relations dropped, strength 0.5 by default."""
    schema = "concepts array<struct<id:string,name:string,category:string,importance:double>>, relationships array<struct<from:string,to:string,type:string,strength:double>>"
    body = F.coalesce(F.nullif(F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit("")), F.col("reply"))
    edges = replies.select("id", F.explode(F.from_json(body, schema)["relationships"]).alias("e"))
    kind = F.lower("e.type")
    return edges.where(kind.isin(*relations)).select("id", F.col("e.from").alias("src"), F.col("e.to").alias("dst"), kind.alias("rel_type"), F.coalesce("e.strength", F.lit(0.5)).alias("strength"))
