"""Keeping a store: adding and replacing blocks, catalogs, reports, checks and repairs, packs, commits and branches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scoring import ttl_seconds
from quillspark.operators.blocks import active, upsert

# Categories that a block may be added to; files that a pack may hold, with their categories; what fixes an issue.
ADDABLE = ["decisions", "solutions", "patterns", "bugs", "insights", "questions", "procedures", "preferences"]
PACK_FILES = {"patterns.md": "Patterns", "solutions.md": "Solutions", "workflows.md": "Workflows", "decisions.md": "Decisions", "preferences.md": "Preferences"}
FIXES = {"stale_context": "regenerate", "missing_context": "regenerate", "missing_embeddings": "embed", "missing_graph": "build_graph"}
SNAPSHOT = ["decisions", "solutions", "patterns", "context"]
RELATIONS = {"implements": "implements", "uses": "uses", "relates-to": "relates-to", "relates_to": "relates-to", "related": "relates-to", "causes": "causes", "part-of": "part-of", "part_of": "part-of", "depends-on": "depends-on", "depends_on": "depends-on", "requires": "depends-on", "supersedes": "supersedes", "replaces": "supersedes", "contradicts": "contradicts", "conflicts": "contradicts"}
CONCEPTS = {"technology": "technology", "tech": "technology", "pattern": "pattern", "decision": "decision", "problem": "problem", "solution": "solution", "person": "person", "people": "person", "tool": "tool"}


def _lookup(known: dict[str, str], key: Column) -> Column:
    return F.create_map(*[F.lit(x) for p in known.items() for x in p])[key]


def add(blocks: DataFrame, new: DataFrame, everywhere: str) -> DataFrame:
    """Blocks after manual additions (project, category, label, content, ttl, ts_raw, pos): one of an unknown category or with a broken time to live is refused, preferences go to the global project, an equal label is replaced."""
    fine = F.col("category").isin(ADDABLE) & (F.col("ttl").isNull() | (F.col("ttl") == "never") | ttl_seconds(F.col("ttl")).isNotNull())
    project = F.when(F.col("category") == "preferences", everywhere).otherwise(F.col("project"))
    rows = new.where(fine).select(project.alias("project"), "category", F.col("label").alias("session_id"), "ts_raw", "ttl", "content", "pos")
    last = rows.groupBy("project", "category", "session_id").agg(F.max_by(F.struct("ts_raw", "ttl", "content", "pos"), "pos").alias("r")).select("project", "category", "session_id", "r.*")
    return upsert(blocks.select(*rows.columns), last)


def replace_one(blocks: DataFrame, category: str, session_id: str, content: str, ts_raw: str) -> DataFrame:
    """Blocks with one block's content and time replaced; its category alone is touched."""
    hit = (F.col("category") == category) & (F.col("session_id") == session_id)
    return blocks.withColumn("content", F.when(hit, F.lit(content)).otherwise(F.col("content"))).withColumn("ts_raw", F.when(hit, F.lit(ts_raw)).otherwise(F.col("ts_raw")))


def count_access(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Access counts grown by how often each id is named."""
    times = ids.groupBy("session_id").agg(F.count("*").alias("times"))
    return blocks.join(times, "session_id", "left").withColumn("access_count", F.coalesce("access_count", F.lit(0)) + F.coalesce("times", F.lit(0))).drop("times")


def lookup_packs(found: DataFrame, packs: DataFrame, query: str) -> DataFrame:
    """A lookup's blocks, and those of packs, whatever their age, that hold the query: origin, session_id."""
    q = query.lower()
    return found.select(F.lit("store").alias("origin"), "session_id").unionByName(packs.where(F.lower("content").contains(q)).select(F.concat(F.lit("pack:"), "pack").alias("origin"), "session_id"))


def tool_result(content: Column, most: int = 300) -> Column:
    """A tool result's text blocks joined by line feeds and cut to so many bytes."""
    parts = F.transform(F.filter(content, lambda c: (c["type"] == "text") & c["text"].isNotNull()), lambda c: c["text"])
    return T.truncate_bytes(F.array_join(parts, "\n"), most, "...")


def conversation_meta(turns: DataFrame, tools: DataFrame) -> DataFrame:
    """A session's meta data as JSON: turns and uses of each tool."""
    used = tools.groupBy("session_id", "tool").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tool_usage"))
    counted = turns.groupBy("session_id").agg(F.count("*").alias("turn_count"))
    return counted.join(used, "session_id", "left").select("session_id", F.to_json(F.struct("session_id", "turn_count", F.coalesce("tool_usage", F.create_map().cast("map<string,bigint>")).alias("tool_usage"))).alias("meta"))


def conversation_summary(turns: DataFrame, tools: DataFrame, most: int = 500) -> DataFrame:
    """A session in brief: its number of turns, first request and tools."""
    first = turns.groupBy("session_id").agg(F.count("*").alias("n"), F.min_by("user_text", "turn_no").alias("request"))
    used = tools.groupBy("session_id", "tool").agg(F.count("*").alias("uses")).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("tool", "uses"))), lambda x: F.concat(x["tool"], F.lit("("), x["uses"].cast("string"), F.lit(")"))), ", ").alias("used"))
    tail = F.when(F.col("used").isNotNull(), F.concat(F.lit("**Tools used:** "), "used", F.lit("\n"))).otherwise("")
    return first.join(used, "session_id", "left").select("session_id", F.concat(F.lit("# "), F.col("session_id").cast("string"), F.lit("\n\n**Turns:** "), F.col("n").cast("string"), F.lit("\n\n**Initial request:** "), T.truncate_bytes(F.trim(F.coalesce("request", F.lit(""))), most), F.lit("\n\n"), tail).alias("summary"))


def snapshot(blocks: DataFrame, contexts: DataFrame) -> DataFrame:
    """What may be shared of each project, as ordered rows (project, file, pos, content): three categories and the context, secrets redacted, and how many there were; a row of meta data."""
    rows = blocks.where(F.col("category").isin(SNAPSHOT)).select("project", F.concat("category", F.lit(".md")).alias("file"), "pos", "content")
    rows = rows.unionByName(contexts.select("project", F.lit("context.md").alias("file"), F.lit(0).cast("long").alias("pos"), F.col("context").alias("content"))).where(F.trim("content") != "")
    clean = rows.select("project", "file", "pos", T.redact("content").alias("content"), F.size(T.secret_hits("content")).cast("long").alias("secrets"))
    meta = clean.groupBy("project").agg(F.sum("secrets").alias("secrets")).select("project", F.lit("metadata.json").alias("file"), F.lit(0).cast("long").alias("pos"), F.to_json(F.struct("project")).alias("content"), "secrets")
    return clean.unionByName(meta)


def worst_first(quality: DataFrame, most: int = 3, under: int = 75) -> DataFrame:
    """Projects by score, worst first, with their mean and whether they are among the first to look after."""
    mean = quality.agg(F.floor(F.sum("score") / F.count("*")).alias("mean_score"))
    first = quality.where(F.col("score") < under).orderBy("score", "project").limit(most).select("project", F.lit(True).alias("attend"))
    return quality.crossJoin(F.broadcast(mean)).join(F.broadcast(first), "project", "left").select("project", "score", "mean_score", F.coalesce("attend", F.lit(False)).alias("attend")).orderBy("score", "project")


def pack_sizes(files: DataFrame) -> DataFrame:
    """Blocks and bytes of each category of each pack."""
    return files.groupBy("pack", "category").agg(F.sum(F.regexp_count("content", F.lit("## Session:")).cast("long")).alias("entries"), F.sum(F.octet_length("content").cast("long")).alias("bytes"))


def project_overview(blocks: DataFrame, contexts: DataFrame) -> DataFrame:
    """Sessions, bytes, newest time of each project, and whether it has a context document."""
    have = contexts.where(F.coalesce("context", F.lit("")) != "").select("project", F.lit(True).alias("has_context"))
    rows = blocks.groupBy("project").agg(F.countDistinct("session_id").alias("sessions"), F.sum(F.octet_length("content").cast("long")).alias("bytes"), F.max("ts_raw").alias("newest"))
    return rows.join(have, "project", "left").withColumn("has_context", F.coalesce("has_context", F.lit(False)))


def project_issues(projects: DataFrame) -> DataFrame:
    """Rows of issues, all eight rules, from a row of figures a project: has_dir, context_age (null for none), newest_age, has_embeddings, has_graph, largest, inbox, expired."""
    rule = lambda when, severity, issue, fixable: F.when(when, F.struct(F.lit(severity).alias("severity"), F.lit(issue).alias("issue"), F.lit(fixable).alias("fixable")))
    there = F.col("has_dir")
    rules = F.array(
        rule(~there, "critical", "no_knowledge", True),
        rule(there & F.col("context_age").isNull(), "warning", "missing_context", True),
        rule(there & (F.col("context_age") > F.col("newest_age")), "info", "stale_context", True),
        rule(there & ~F.col("has_embeddings"), "info", "missing_embeddings", True),
        rule(there & ~F.col("has_graph"), "info", "missing_graph", True),
        rule(there & (F.col("largest") > 5 * 1048576), "warning", "large_files", False),
        rule(there & (F.col("inbox") > 10), "info", "inbox_backlog", False),
        rule(there & (F.col("expired") > 0), "info", "expired_entries", True),
    )
    return projects.select("project", F.explode(F.array_compact(rules)).alias("i")).select("project", "i.*")


def repairs(issues: DataFrame) -> DataFrame:
    """What to run for the issues that can be fixed by themselves, once a project and action."""
    return issues.where("fixable").select("project", _lookup(FIXES, F.col("issue")).alias("action")).where("action IS NOT NULL").distinct()


def success_rate(adaptations: DataFrame) -> DataFrame:
    """The share of adaptations after which health rose; 0 of none."""
    return adaptations.agg(F.count("*").alias("n"), F.coalesce(F.avg((F.col("improvement") > 0).cast("double")), F.lit(0.0)).alias("rate"))


def graph_concepts(replies: DataFrame, *by: str) -> DataFrame:
    """Nodes of concept graphs that replies hold as JSON, fenced or not: importance 0.5 by default, categories by their aliases, else other; of a repeated id the first counts. ``by`` names columns that graphs are kept apart by."""
    schema = "concepts array<struct<id:string,name:string,category:string,importance:double>>"
    body = F.coalesce(F.nullif(F.regexp_extract("reply", r"(?s)```(?:json)?\s*(\{.*\})\s*```", 1), F.lit("")), F.col("reply"))
    rows = replies.select(*by, "id", F.posexplode(F.from_json(body, schema)["concepts"]).alias("place", "c")).where("c.id IS NOT NULL")
    first = rows.groupBy(*by, F.col("c.id").alias("concept")).agg(F.min_by("c", F.struct("id", "place")).alias("c"))
    return first.select(*by, "concept", F.coalesce("c.name", "concept").alias("name"), F.coalesce(_lookup(CONCEPTS, F.lower("c.category")), F.lit("other")).alias("category"), F.coalesce("c.importance", F.lit(0.5)).alias("importance"))


def relation(x: Column) -> Column:
    """A relation's name by its aliases; null for an unknown one."""
    return _lookup(RELATIONS, F.lower(x))


def track(versions: DataFrame, category: str, ts: Column, digest: Column, size: Column, counter: int) -> DataFrame:
    """Versions with one more of a category."""
    row = versions.sparkSession.range(1).select(F.concat(F.lit(f"{category}-"), F.unix_timestamp(ts).cast("string"), F.lit(f"-{counter}")).alias("version_id"), F.lit(category).alias("category"), ts.alias("ts"), digest.alias("content_hash"), size.cast("long").alias("size_bytes"))
    return versions.select(*row.columns).unionByName(row)


def versions_of(versions: DataFrame, category: str) -> DataFrame:
    return versions.where(F.col("category") == category).orderBy(F.desc("ts"), F.desc("version_id"))


def outcomes(files: DataFrame) -> DataFrame:
    """Outcome signals by time; one file a second, so of a second the last written counts."""
    return files.groupBy(F.date_trunc("second", "ts").alias("ts")).agg(F.max_by(F.struct("id", "reward"), "written").alias("o")).select("ts", "o.*").orderBy("ts")


def discovered_packs(files: DataFrame) -> DataFrame:
    """Packs by their manifests' paths, one or two folders deep; of a name the first by depth and path."""
    parts = F.split("path", "/")
    depth = F.size(parts) - 3  # folders above <pack>/.pack/manifest.json
    rows = files.where(F.col("path").rlike(r"(^|/)\.pack/manifest\.json$")).select("path", depth.alias("depth"), F.element_at(parts, -3).alias("name")).where(F.col("depth").between(0, 1))
    return rows.groupBy("name").agg(F.min(F.struct("depth", "path")).alias("f"), F.count("*").alias("copies")).select("name", "f.path", "f.depth", "copies")


def valid_packs(packs: DataFrame) -> DataFrame:
    """The first thing that is wrong with each pack's manifest: null for none."""
    empty = lambda c: F.coalesce(F.col(c), F.lit("")) == ""
    wrong = F.when(empty("name"), "name").when(empty("version"), "version").when(~F.col("version").contains("."), "version format").when(empty("repository"), "repository").when(empty("author"), "author")
    return packs.select("id", wrong.alias("wrong"))


def pack_issues(packs: DataFrame, registries: DataFrame) -> DataFrame:
    """Issues of installed packs, all checks: manifest missing or invalid, folder missing or without files, registry gone."""
    known = packs.join(registries.select("registry", F.lit(True).alias("there")), "registry", "left")
    rule = lambda when, issue: F.when(when, F.lit(issue))
    found = F.array_compact(F.array(rule(F.col("version").isNull(), "missing_manifest"), rule(~F.col("version").contains("."), "invalid_manifest"), rule(F.col("n_files").isNull(), "missing_folder"), rule(F.col("n_files") == 0, "no_knowledge"), rule(F.col("there").isNull(), "orphaned")))
    return known.select("id", F.explode(found).alias("issue"))


def pack_structure(files: DataFrame) -> DataFrame:
    """A pack's structure from its files (pack, file): what it lacks, and the categories that it holds."""
    has = lambda name: F.max((F.col("file") == name).cast("int")) == 1
    held = F.array_sort(F.collect_set(_lookup({f"knowledge/{k}": v for k, v in PACK_FILES.items()}, F.col("file"))))
    rows = files.groupBy("pack").agg(has(".pack/manifest.json").alias("manifest"), F.max(F.col("file").startswith("knowledge/").cast("int")).alias("folder"), held.alias("held"), has("README.md").alias("readme"))
    wrong = F.when(~F.col("manifest"), "manifest").when(F.col("folder") == 0, "knowledge folder").when(F.size("held") == 0, "knowledge files")
    return rows.select("pack", wrong.alias("wrong"), "readme", F.array_join("held", ",").alias("categories"))


def create_pack(blocks: DataFrame, now: Column, categories: tuple[str, ...] = ("patterns", "solutions")) -> tuple[DataFrame, DataFrame]:
    """What a pack of each project takes along under a policy, and the projects whose packs hold a secret and aren't made."""
    rows = active(blocks, now).where(F.col("category").isin(*categories)).withColumn("secrets", F.size(T.secret_hits("content")))
    refused = rows.where("secrets > 0").select("project").distinct()
    return rows.join(refused, "project", "left_anti").select("project", "category", "session_id", "content"), refused


def commit(commits: DataFrame, head: str | None, commit_id: str, message: str, ts: str) -> DataFrame:
    """Commits with one more, whose parent is HEAD; the same ones where it would be HEAD again."""
    if commit_id == head:
        return commits
    row = commits.sparkSession.createDataFrame([(commit_id, head, message, ts)], "id string, parent string, message string, ts string")
    return commits.unionByName(row.join(commits.select("id"), "id", "left_anti"))


def committed(working: DataFrame, head: DataFrame | None = None, picked: DataFrame | None = None) -> DataFrame:
    """Sessions of a commit: all of the working set, or HEAD's and those that were picked and exist."""
    if picked is None:
        return working.select("session_id").distinct()
    chosen = working.select("session_id").distinct().join(picked.select("session_id").distinct(), "session_id", "left_semi")
    return chosen.union(head.select("session_id")).distinct() if head is not None else chosen


def create_branch(branches: DataFrame, name: str, commit_id: str) -> DataFrame:
    """Branches with a new one; a name that exists or can't be one is refused."""
    if "/" in name or " " in name or not name:
        raise ValueError(f"no branch name: {name!r}")
    if not branches.where(F.col("branch") == name).isEmpty():
        raise ValueError(f"branch exists: {name}")
    row = branches.sparkSession.createDataFrame([(name, commit_id)], "branch string, commit_id string")
    return branches.select("branch", "commit_id").unionByName(row)


def delete_branch(branches: DataFrame, name: str, current: str | None) -> DataFrame:
    """Branches without one; the current one and one that doesn't exist are refused."""
    if name == current:
        raise ValueError(f"branch is checked out: {name}")
    if branches.where(F.col("branch") == name).isEmpty():
        raise ValueError(f"no such branch: {name}")
    return branches.where(F.col("branch") != name)


def resolve_target(branches: DataFrame, commits: DataFrame, target: str) -> DataFrame:
    """The commit that a branch, an id or the only id with such a begin names; no row for none."""
    named = branches.where(F.col("branch") == target).select(F.lit(1).alias("rank"), "commit_id")
    whole = commits.where(F.col("id") == target).select(F.lit(2).alias("rank"), F.col("id").alias("commit_id"))
    begins = commits.where(F.col("id").startswith(target)).agg(F.count("*").alias("n"), F.min("id").alias("commit_id")).where("n = 1").select(F.lit(3).alias("rank"), "commit_id")
    return named.unionByName(whole).unionByName(begins).orderBy("rank").limit(1).select("commit_id")


def file_tree(files: DataFrame) -> DataFrame:
    """Each project's items, bytes and newest change, from a catalog of files."""
    return files.groupBy("project").agg(F.count("*").alias("items"), F.sum("size").alias("bytes"), F.max("modified").alias("modified")).orderBy("project")


def session_catalog(files: DataFrame) -> DataFrame:
    """Session files one folder below a project's, newest first within projects by name, from a catalog (path, modified) relative to the root; a project without any isn't there."""
    found = files.where(F.col("path").rlike(r"^[^/]+/[^/]+\.jsonl$"))
    rows = found.select(F.substring_index("path", "/", 1).alias("project"), F.regexp_replace(F.substring_index("path", "/", -1), r"\.jsonl$", "").alias("session"), "modified")
    nth = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("modified"), "session"))
    return rows.withColumn("nth", nth).orderBy("project", "nth")
