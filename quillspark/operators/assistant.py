"""Composite operators: asking, recalling, injecting, resolving updates, reflecting."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import blocks as B
from quillspark.operators import documents as D
from quillspark.operators import retrieval as R
from quillspark.operators.providers import Chat, Embed, extractive_chat, hashing_embedder, prompt

# Headings in front of categories, and the order of global knowledge.
HEADINGS = {"bugs": "## Known Bugs", "insights": "## Insights", "questions": "## Open Questions", "procedures": "## Workflows & Procedures"}
GLOBAL_ORDER = ["decisions", "patterns", "solutions", "insights", "bugs", "procedures"]


def index_chunks(blocks: DataFrame, now: Column, most: int = 1200) -> DataFrame:
    """Chunks of active blocks with ids by content: the rows of an embedding index before embedding."""
    rows = B.active(blocks, now).where(F.trim("content") != "")
    split = rows.select("project", "category", "session_id", "ts", F.posexplode(T.session_chunks("content", most)).alias("part", "text"))
    return split.withColumn("id", T.chunk_id("text"))


def recursive_ask(blocks: DataFrame, now: Column, choose: Callable[[str], str], categories: list[str], n: int = 5, shown: int = 200) -> DataFrame:
    """Blocks that a provider picked by id from the newest entries of the index; the index shown is bounded by ``shown``."""
    index = B.active(blocks, now).orderBy(F.desc("ts_raw"), "session_id").limit(shown)
    entries = "\n".join(r["entry"] for r in B.project_index(index, now).orderBy("session_id").collect())
    picked = blocks.sparkSession.createDataFrame([(choose(entries),)], "reply string").select(F.explode(T.selected_ids("reply", categories, n)).alias("session_id"))
    return B.fetch(blocks, picked, now)


def ask_context(chunks: DataFrame, blocks: DataFrame, question: str, now: Column, k: int = 5, threshold: float = 0.15, embed: Embed = hashing_embedder, hyde: Chat | None = None, graph: tuple[DataFrame, DataFrame] | None = None, raw: int = 200) -> DataFrame:
    """What an answerer is given: source and context, one row.

    A provider's guess at the answer (``hyde``; the question alone without one
    or where it fails) is embedded and searched for, beside the concepts near
    those that the question names where a ``graph`` (nodes, edges) is given.
    Only where that finds nothing do blocks that hold the question's words count,
    and where there are none the first ``raw`` active blocks as they stand.
    Private sections are left out. What is gathered is bounded by k and ``raw``.
    """
    try:
        signal = f"{hyde('hyde', prompt('hyde', question)).strip()}\n\nQuery: {question}" if hyde else question
    except Exception:  # a provider that can't be reached leaves the question
        signal = question
    vector = lambda text: [float(x) for x in embed([text])[0]]
    if graph is None:
        found = R.smart_search(chunks, vector(signal), signal, now, k, threshold).withColumn("arm", F.lit(0))
    else:
        found = R.graph_search(chunks, *graph, vector(signal), question, now, k, threshold, vector)
    part = F.concat(F.lit("["), F.col("category"), F.lit(":"), F.col("session_id"), F.lit("]\n"), F.trim("content"))
    semantic = found.orderBy("arm", F.desc("score"), "session_id").limit(k).select(F.lit(1).alias("tier"), F.col("arm").cast("double").alias("x"), (-F.col("score")).alias("y"), F.col("session_id").alias("z"), part.alias("part"))
    ids = R.lexical_fallback(blocks, question, 3, now).select("session_id")
    lexical = B.fetch(blocks, ids, now).orderBy("cat_ord", "pos").limit(k).select(F.lit(2).alias("tier"), F.col("cat_ord").cast("double").alias("x"), F.col("pos").cast("double").alias("y"), F.col("session_id").alias("z"), part.alias("part"))
    whole = raw_context(blocks, now).orderBy("cat_ord", "pos").limit(raw).select(F.lit(3).alias("tier"), F.col("cat_ord").cast("double").alias("x"), F.col("pos").cast("double").alias("y"), F.lit("").alias("z"), F.col("text").alias("part"))
    rows = semantic.unionByName(lexical).unionByName(whole)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("x", "y", "z", "part"))), lambda r: r["part"])
    tiers = rows.groupBy("tier").agg(T.strip_private(F.array_join(ordered, "\n\n---\n\n")).alias("context")).orderBy("tier").limit(1)
    return tiers.select(F.when(F.col("tier") == 1, "search").when(F.col("tier") == 2, "words").otherwise("raw").alias("source"), "context")


def ask(chunks: DataFrame, blocks: DataFrame, question: str, now: Column, chat: Chat = extractive_chat, concise: bool = False, **how) -> DataFrame:
    """question, source, context and answer: retrieval in Spark, one provider call at the driver."""
    row = ask_context(chunks, blocks, question, now, **how).first()
    source, context = (row["source"], row["context"]) if row else ("none", "")
    answer = chat("Answer from the context.", context if chat is extractive_chat else prompt("concise" if concise else "answer", question, context))
    return chunks.sparkSession.createDataFrame([(question, source, context, answer)], "question string, source string, context string, answer string")


def recursive_context(blocks: DataFrame, chunks: DataFrame, question: str, now: Column, choose: Callable[[str], str], categories: list[str], n: int = 5, shown: int = 200, **how) -> DataFrame:
    """source and context: the blocks that a provider picked from the index, or what ask() would use where it picked none that is there."""
    picked = recursive_ask(blocks, now, choose, categories, n, shown)
    part = F.concat(F.lit("["), F.col("category"), F.lit(":"), F.col("session_id"), F.lit("]\n"), F.trim("content"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("cat_ord", "pos", part.alias("part")))), lambda r: r["part"])
    mine = picked.agg(F.count("*").alias("n"), T.strip_private(F.array_join(ordered, "\n\n---\n\n")).alias("context")).where("n > 0").select(F.lit("chosen").alias("source"), "context")
    if mine.isEmpty():
        return ask_context(chunks, blocks, question, now, **how)
    return mine


def raw_context(blocks: DataFrame, now: Column) -> DataFrame:
    """Active blocks in the order of their categories, with headings in front of some categories' first: project, cat_ord, pos, text."""
    heads = F.create_map(*[F.lit(x) for p in HEADINGS.items() for x in p])
    known = B.active(blocks, now).where("project IS NOT NULL AND category IS NOT NULL")
    # The first of each category by a pre-aggregated join: no category goes through one task.
    rows = B.active(blocks, now).join(known.groupBy("project", "category").agg(F.min("pos").alias("first")), ["project", "category"], "left")
    text = F.when((F.col("pos") == F.col("first")) & heads[F.col("category")].isNotNull(), F.concat(heads[F.col("category")], F.lit("\n\n"), "content")).otherwise(F.col("content"))
    return rows.select("project", "cat_ord", "pos", text.alias("text"))


def global_knowledge(blocks: DataFrame, everywhere: str, now: Column) -> DataFrame:
    """Active blocks of the global project, by category in the order in which they are shown: at, pos, text."""
    at = F.array_position(F.array(*map(F.lit, GLOBAL_ORDER)), F.col("category"))
    return B.active(blocks, now).where((F.col("project") == everywhere) & (at > 0)).select(at.cast("int").alias("at"), "pos", F.col("content").alias("text"))


def full_memory(contexts: DataFrame, blocks: DataFrame, packs: DataFrame, everywhere: str, shared: str, now: Column) -> DataFrame:
    """Every project's whole memory as ordered rows (project, section, at, pos, text), so that none is gathered: preferences and shared memory of the global projects, the project's context, global knowledge, installed packs."""
    rows = B.active(blocks, now)
    each = contexts.select("project")
    part = lambda df, section, title: df.select(F.lit(section).alias("section"), F.lit(title).alias("title"), "at", "pos", "text")
    common = part(rows.where((F.col("project") == shared) & (F.col("category") == "procedures")).select(F.lit(0).alias("at"), "pos", F.col("content").alias("text")), 1, "Global Preferences")
    common = common.unionByName(part(rows.where((F.col("project") == shared) & (F.col("category") != "procedures")).select(F.col("cat_ord").alias("at"), "pos", F.col("content").alias("text")), 2, "Global Shared Memory"))
    common = common.unionByName(part(global_knowledge(blocks, everywhere, now), 4, "Global Knowledge"))
    common = common.unionByName(part(packs.select(F.lit(0).alias("at"), "pos", "text"), 5, "Installed Pack Knowledge"))
    own = contexts.select("project", F.lit(3).alias("section"), F.concat(F.lit("Project: "), "project").alias("title"), F.lit(0).alias("at"), F.lit(0).cast("long").alias("pos"), F.col("context").alias("text"))
    # The common rows belong to every project: the projects, a bounded list of names, go to the rows.
    return own.unionByName(common.crossJoin(F.broadcast(each.distinct())).select("project", "section", "title", "at", "pos", "text")).withColumn("text", T.strip_private("text"))


def recall(contexts: DataFrame, blocks: DataFrame, now: Column, packs: DataFrame | None = None) -> DataFrame:
    """A project's context document, or where there is none its active blocks, then what the installed packs know: rows in order, the context first."""
    have = contexts.where(F.coalesce("context", F.lit("")) != "")
    raw = B.active(blocks, now).join(have.select("project"), "project", "left_anti").select("project", F.col("pos").alias("at"), F.col("content").alias("text"))
    rows = have.select("project", F.lit(0).cast("long").alias("at"), F.col("context").alias("text")).unionByName(raw)
    if packs is not None:
        known = packs.select((F.lit(1 << 40) + F.col("pos")).alias("at"), "text")
        rows = rows.unionByName(known.crossJoin(F.broadcast(contexts.select("project").distinct())).select("project", "at", "text"))
    return rows


def inject(mode: str, blocks: DataFrame, hits: DataFrame, compact: DataFrame, full: DataFrame, now: Column, categories: list[str], budget: int) -> tuple[DataFrame, DataFrame]:
    """The store without expired blocks, and the memory (kind, text): the smart one of bounded hits, the compact one where there are none, or the full one."""
    cleaned = B.active(blocks, now)
    if mode == "full":
        return cleaned, full.select(F.lit("full").alias("kind"), "text")
    short = compact.select(F.lit("compact").alias("kind"), F.col("memory").alias("text"))
    if mode == "compact":
        return cleaned, short
    smart = D.smart_memory(hits, categories, budget).where(F.coalesce("memory", F.lit("")) != "").select(F.lit("smart").alias("kind"), F.col("memory").alias("text"))
    none = smart.agg(F.count("*").alias("n")).where("n = 0")
    return cleaned, smart.unionByName(short.crossJoin(F.broadcast(none)).drop("n"))


def resolve(new: DataFrame, existing: DataFrame, replies: DataFrame) -> DataFrame:
    """Rows after a resolver's replies to new texts: added, replaced, deleted or left alone."""
    acted = new.join(replies, "id", "left").withColumn("a", T.resolver_action(F.coalesce("reply", F.lit("ADD"))))
    gone = acted.where(F.col("a.action").isin("UPDATE", "DELETE")).select(F.col("a.id").alias("session_id")).distinct()
    kept = existing.select("session_id", "content").join(gone, "session_id", "left_anti")
    changed = existing.select("session_id").join(acted.where(F.col("a.action") == "UPDATE").groupBy(F.col("a.id").alias("session_id")).agg(F.max_by("a.body", "id").alias("content")), "session_id")
    added = acted.where(F.col("a.action") == "ADD").select(F.concat(F.lit("n"), F.col("id").cast("string")).alias("session_id"), "content")
    return kept.unionByName(changed).unionByName(added)


def prior_blocks(blocks: DataFrame, now: Column, n: int = 10) -> DataFrame:
    """The first blocks of each category that a reflection is checked against."""
    rank = F.row_number().over(Window.partitionBy("project", "category").orderBy("pos"))
    return B.active(blocks, now).withColumn("nth", rank).where(F.col("nth") <= n)


def evaluation(scored: DataFrame) -> DataFrame:
    """Mean score, mean of the judge where there is one, share of answers that weren't found, by category and over all."""
    return scored.groupingSets([[F.col("category")], []], "category").agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("judge").alias("judge"), F.avg(F.col("missing").cast("double")).alias("not_found"))


def reflect(text: DataFrame, blocks: DataFrame, now: Column, day: str, categories: list[str], extract: Callable[[str, str], str], n: int = 10) -> DataFrame:
    """Blocks after a reflection: what a provider extracts from a free text for each category is appended under one label; ``conflicts`` counts the first n blocks of the category whose words overlap with it."""
    spark = blocks.sparkSession
    row = text.first()
    found = [(i, c, T_.strip()) for i, c in enumerate(categories) if (T_ := extract(c, prompt(c, row["text"])) or "").strip()]
    new = spark.createDataFrame([(row["project"], c, f"reflect-{day}", t, i) for i, c, t in found], "project string, category string, session_id string, content string, id long")
    prior = prior_blocks(blocks, now, n).select("project", "category", F.col("pos").alias("id"), "content")
    met = B.overlaps(new.select("id", "content"), prior.join(F.broadcast(new.select("project", "category")), ["project", "category"], "left_semi").select("id", "content"), 3).where("similarity >= 0.15").groupBy(F.col("new_id").alias("id")).agg(F.count("*").alias("conflicts"))
    added = new.join(met, "id", "left").select("project", "category", "session_id", "content", F.coalesce("conflicts", F.lit(0)).alias("conflicts"))
    return B.upsert(blocks.select("project", "category", "session_id", "content", F.lit(0).cast("long").alias("conflicts")), added)


def tool_observations(uses: DataFrame) -> DataFrame:
    """Uses of tools that change or run something, with what they touch."""
    kept = uses.where(F.col("tool").isin("Edit", "Write", "Task", "Bash", "MultiEdit"))
    return kept.withColumn("target", F.coalesce(F.get_json_object("input", "$.file_path"), F.get_json_object("input", "$.command"), F.lit("")))


def hybrid_ask(chosen: DataFrame, found: DataFrame) -> DataFrame:
    """Blocks picked from the index, then what the vector arm found beside them."""
    return R.union_new(chosen.select("session_id"), found.select("session_id"))
