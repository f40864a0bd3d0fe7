"""The block store: expiry, lookups, indexes, timelines, budgets, similarity, upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.functions.scoring import clamp, confidence_factor, expired, retention
from quillspark.operators import overlaps as overlap
from quillspark.operators import similar


def with_expiry(blocks: DataFrame, now: Column) -> DataFrame:
    return blocks.withColumn("expired", expired(F.col("ts"), F.col("ttl"), now))


def active(blocks: DataFrame, now: Column) -> DataFrame:
    return blocks.where(~expired(F.col("ts"), F.col("ttl"), now))


def topic_match(blocks: DataFrame, query: str) -> DataFrame:
    return blocks.where(F.lower("content").contains(query.lower()))


def keyword_match(blocks: DataFrame, query: str, least: int, now: Column) -> DataFrame:
    """Active blocks that contain at least so many of a query's keywords, with the number of hits."""
    words = T.keywords(F.lit(query))
    hits = F.size(F.filter(words, lambda w: F.contains(F.lower("content"), w)))
    return active(blocks, now).withColumn("hits", hits).where((F.col("hits") >= least) & (F.size(words) > 0))


def lookup(blocks: DataFrame, query: str, now: Column, everything: bool = False, shown: int = 5) -> DataFrame:
    """Blocks whose content or heading holds the query, with the first lines that do."""
    q = query.lower()
    head = T.header(F.col("session_id"), F.col("ts_raw"), F.col("ttl"), F.col("confidence"), F.col("strength"), F.lit(None).cast("string"))
    rows = blocks if everything else active(blocks, now)
    matched = F.slice(F.filter(T.lines("content"), lambda v: F.lower(v).contains(q)), 1, shown)
    return rows.where(F.lower("content").contains(q) | F.lower(head).contains(q)).withColumn("matched", matched)


def regex_lines(texts: DataFrame, pattern: str, context: int = 2) -> DataFrame:
    """Lines within ``context`` of one that matches, each text's by itself; ``hit`` marks the matches."""
    ls = F.transform(T.lines("content"), lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("line"), v.rlike(pattern).alias("hit")))
    # A text's lines stay in its row; each hit names the lines around it, so a text costs its lines and its hits.
    hits = F.transform(F.filter("ls", lambda x: x["hit"]), lambda x: x["line_no"])
    around = F.array_distinct(F.flatten(F.transform(hits, lambda n: F.sequence(F.greatest(n - context, F.lit(1)), F.least(n + context, F.size("ls"))))))
    return texts.where(F.col("content").rlike(f"(?m){pattern}")).withColumn("ls", ls).where(F.exists("ls", lambda x: x["hit"])).withColumn("at", F.explode(around)).withColumn("l", F.element_at("ls", F.col("at"))).select("session_id", "l.line_no", "l.line", "l.hit")


def regex_first(texts: DataFrame, pattern: str) -> DataFrame:
    """The first matching line of each text."""
    numbered = F.transform(T.lines("content"), lambda v, i: F.struct((i + 1).alias("line_no"), v.alias("line")))
    first = F.get(F.filter(numbered, lambda x: x["line"].rlike(pattern)), F.lit(0))
    return texts.withColumn("first", first).where("first IS NOT NULL").select("session_id", "first.line_no", "first.line")


def stale(blocks: DataFrame, now: Column, days: int, categories: tuple[str, ...] = ("decisions", "solutions", "patterns")) -> DataFrame:
    """Blocks older than so many days, the first category of a session."""
    old = blocks.where(F.col("category").isin(*categories) & (F.col("ts") < now - F.make_dt_interval(days=F.lit(days))))
    return old.withColumn("nth", F.row_number().over(Window.partitionBy("project", "session_id").orderBy("cat_ord", "pos"))).where("nth = 1").drop("nth")


def fetch(blocks: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    return active(blocks, now).join(ids, "session_id", "left_semi")


def project_index(blocks: DataFrame, now: Column, n: int = 100) -> DataFrame:
    """One line a block: [category:id] and its begin."""
    return active(blocks, now).select("session_id", F.concat(F.lit("["), F.col("category"), F.lit(":"), F.col("session_id"), F.lit("] "), T.one_line("content", n)).alias("entry"))


def index_view(blocks: DataFrame, n: int = 70) -> DataFrame:
    """Blocks of a category, newest first by the raw time, with its count."""
    shown = blocks.select("category", "session_id", "ts_raw", F.left("ts_raw", F.lit(10)).alias("date"), T.preview("content", n).alias("preview"))
    counts = blocks.groupBy("category").agg(F.count("*").alias("in_category"))
    return shown.join(F.broadcast(counts), "category").orderBy("category", F.desc("ts_raw"), "session_id")


def timeline_window(blocks: DataFrame, session_id: str, now: Column, width: int = 3) -> DataFrame:
    """Active blocks of a project around the first row of a session, by raw time.

    The target's place in the order is found first; what lies before and after
    it are two top-n queries, so no window runs over all blocks.
    """
    order = ["ts_raw", "cat_ord", "pos"]
    rows = active(blocks, now).withColumn("at", F.struct(*order))
    target = rows.where(F.col("session_id") == session_id).agg(F.min("at").alias("target"))
    placed = rows.crossJoin(F.broadcast(target)).where("target IS NOT NULL")
    before = placed.where("at < target").orderBy(*(F.desc(c) for c in order)).limit(width)
    after = placed.where("at >= target").orderBy(*order).limit(width + 1)
    return before.unionByName(after).select("session_id", "category", "ts_raw", (F.col("at") == F.col("target")).alias("is_target"))


def timeline_days(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy(F.left("ts_raw", F.lit(10)).alias("day")).agg(F.count("*").alias("n"), F.max("ts_raw").alias("newest"))


def with_boost(blocks: DataFrame, boosts: DataFrame) -> DataFrame:
    """Learned boost by session, else category:session, else project:session, else 0.

    One join on the exploded keys takes the first that is known.
    """
    keyed = blocks.select("pos", F.posexplode(F.array(F.col("session_id"), F.concat_ws(":", "category", "session_id"), F.concat_ws(":", "project", "session_id"))).alias("nth", "key"))
    found = keyed.join(boosts.groupBy("key").agg(F.max("boost").alias("boost")), "key").groupBy("pos").agg(F.min_by("boost", "nth").alias("boost"))
    return blocks.join(found, "pos", "left").withColumn("boost", F.coalesce("boost", F.lit(0.0)))


def importance(blocks: DataFrame, boosts: DataFrame, now: Column) -> DataFrame:
    """Recency within the project and learned boost, faded by age and strength, weighed by confidence."""
    ranges = blocks.groupBy("project").agg(F.min("ts").alias("oldest"), F.max("ts").alias("newest"))
    rows = with_boost(blocks, boosts).join(ranges, "project")
    span = F.unix_timestamp("newest") - F.unix_timestamp("oldest")
    recency = F.when(span > 0, clamp(1 - (F.unix_timestamp("newest") - F.unix_timestamp("ts")) / span, 0.0, 1.0)).otherwise(0.5)
    age = F.greatest(F.unix_timestamp(now) - F.unix_timestamp("ts"), F.lit(0)) / 86400.0
    return rows.withColumn("importance", (0.4 * recency + 0.6 * F.col("boost")) * retention(F.col("strength"), age) * confidence_factor(F.col("confidence")))


def line_budget(blocks: DataFrame, budget: int) -> DataFrame:
    """Newest blocks of a category while their lines fit a budget; the first always, none after the first that doesn't fit.

    A block has a line and a heading at least, so only the newest budget / 2 + 1
    of a category can be kept: tasks cut down to those before anything is gathered.
    """
    order = Window.partitionBy("project", "category").orderBy(F.desc("ts_raw"), "pos")
    sized = blocks.select("project", "category", "session_id", "pos", "ts_raw", (F.size(T.lines("content")) + 1).cast("long").alias("n_lines"))
    newest = sized.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= budget // 2 + 1)
    summed = newest.withColumn("total", F.sum("n_lines").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    fits = (F.col("total") <= budget) | (F.col("nth") == 1)
    return summed.withColumn("cut", F.max((~fits).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))).where("cut = 0").select("project", "category", "session_id", "n_lines", "total")


def token_budget(hits: DataFrame, budget: int) -> DataFrame:
    """Best hits of a category while their tokens fit a budget, each judged on the running total; a hit has a token at least, so only the best ``budget`` of a category are gathered."""
    order = Window.partitionBy("category").orderBy(F.desc("score"), "session_id")
    best = hits.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= budget).drop("nth")
    return best.withColumn("tokens", T.token_estimate("content")).withColumn("total", F.sum("tokens").over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("total") <= budget)


def trim_lines(x: Column, n: int) -> Column:
    ls = T.lines(x)
    return F.when(F.size(ls) > n, F.concat(F.array_join(F.slice(ls, 1, n - 2), "\n"), F.lit("\n[trimmed]"))).otherwise(x)


def overlaps(new: DataFrame, existing: DataFrame, least_words: int) -> DataFrame:
    """Overlap coefficient of word sets of every new text with every existing one that shares a word: an equi join on words."""
    left = new.select(F.col("id").alias("new_id"), T.word_set("content").alias("words")).where(F.size("words") >= least_words)
    right = existing.where(~F.col("content").contains("<!-- superseded")).select(F.col("id").alias("old_id"), T.word_set("content").alias("words")).where(F.size("words") > 0)
    a = left.select("new_id", F.size("words").alias("new_n"), F.explode("words").alias("word"))
    b = right.select("old_id", F.size("words").alias("old_n"), F.explode("words").alias("word"))
    return a.join(b, "word").groupBy("new_id", "old_id").agg(F.count("*").alias("shared"), F.first("new_n").alias("new_n"), F.first("old_n").alias("old_n")).withColumn("similarity", F.col("shared") / F.least("new_n", "old_n"))


def similar_top(new: DataFrame, existing: DataFrame, n: int = 3, threshold: float = 0.15) -> DataFrame:
    """The n existing texts that overlap most with each new one of three words or more."""
    return overlap.top(new, existing, n, threshold)


def near_duplicate(texts: DataFrame, threshold: float = 0.75, least_words: int = 5) -> DataFrame:
    """Ids of texts of so many words at least to which an earlier text, by id, that isn't superseded has a greater overlap."""
    return overlap.contained(texts, threshold, least_words)


def supersede(blocks: DataFrame, reasons: DataFrame, n: int = 120) -> DataFrame:
    """Content marked once with why it is superseded."""
    marked = F.concat(F.lit("<!-- superseded: "), F.substring("reason", 1, n), F.lit(" -->\n"), F.col("content"))
    fresh = F.col("reason").isNotNull() & ~F.col("content").contains("<!-- superseded")
    return blocks.join(reasons, "session_id", "left").withColumn("content", F.when(fresh, marked).otherwise(F.col("content"))).drop("reason")


def upsert(blocks: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("project", "category", "session_id")) -> DataFrame:
    """New rows replace those with their key."""
    return blocks.join(new.select(*keys).distinct(), [*keys], "left_anti").unionByName(new)


def forget(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    return blocks.join(ids.select("session_id").distinct(), "session_id", "left_anti")


def recall(blocks: DataFrame, ids: DataFrame) -> DataFrame:
    """Recalled blocks grow in strength and access count."""
    hit = blocks.join(ids.select("session_id").distinct().withColumn("hit", F.lit(1)), "session_id", "left")
    return hit.withColumn("access_count", F.coalesce("hit", F.lit(0))).withColumn("strength", F.when(F.col("hit") == 1, F.least(F.coalesce("strength", F.lit(1.0)) + 0.3, F.lit(5.0))).otherwise(F.col("strength"))).drop("hit")


def entity_cards(entities: DataFrame, shown: int = 3) -> DataFrame:
    """name | type | fact lines as one card a name: first type, number of facts, first distinct facts."""
    parts = F.split("line", r"\|", 3)
    rows = entities.select("pos", F.trim(F.get(parts, F.lit(0))).alias("name"), F.trim(F.get(parts, F.lit(1))).alias("type"), F.trim(F.get(parts, F.lit(2))).alias("fact")).where("fact IS NOT NULL AND name <> ''")
    kinds = rows.groupBy("name").agg(F.min_by("type", "pos").alias("type"), F.count("*").alias("facts"))
    unique = rows.groupBy("name", F.lower("fact").alias("folded")).agg(F.min(F.struct("pos", "fact")).alias("first"))
    unique = unique.withColumn("nth", F.row_number().over(Window.partitionBy("name").orderBy("first"))).where(F.col("nth") <= shown)
    listed = unique.groupBy("name").agg(F.array_join(F.transform(F.array_sort(F.collect_list("first")), lambda x: x["fact"]), "; ").alias("shown"))
    return kinds.join(listed, "name")


def preferences(lines: DataFrame, shown: int = 6) -> DataFrame:
    """**Key:** a, b lines by normalised key: distinct values in the first casing, so many and the count of the rest."""
    key = F.lower(F.trim(F.regexp_extract("line", r"\*\*([^*]+?):?\*\*:?", 1)))
    named = F.when(key.rlike("language|lang"), "Languages").when(key.rlike("framework|librar"), "Frameworks").when(key.rlike("tool|editor"), "Tools").when(key.rlike("style|format"), "Style").when(key.rlike("test"), "Testing").when(key.rlike("workflow|process"), "Workflow").otherwise(F.initcap(key))
    values = F.split(F.regexp_replace("line", r"^.*?\*\*[^*]+\*\*:?\s*", ""), ",")
    rows = lines.where(F.col("line").rlike(r"\*\*[^*]+?:?\*\*")).select("pos", named.alias("key"), F.posexplode(values).alias("at", "raw"))
    rows = rows.withColumn("value", F.regexp_replace(F.trim("raw"), r"\.$", "")).where("value <> ''")
    unique = rows.groupBy("key", F.lower("value").alias("folded")).agg(F.min(F.struct("pos", "at", "value")).alias("first"))
    unique = unique.withColumn("nth", F.row_number().over(Window.partitionBy("key").orderBy("first")))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("nth") <= shown, F.col("first")))), lambda x: x["value"]), ", ")
    return unique.groupBy("key").agg(listed.alias("shown"), F.greatest(F.count("*") - shown, F.lit(0)).alias("more"))


def supersedable(chunks: DataFrame, low: float, high: float, by: str | None = "category") -> DataFrame:
    """Pairs of chunks of one category (``by`` None: of all) whose cosine lies in a band, in their order."""
    return similar.pairs(chunks, low, high, by)


def duplicate_groups(chunks: DataFrame, threshold: float, by: str | None = "category") -> DataFrame:
    """Anchors with the later chunks of their category (``by`` None: of the store) that are at least so similar; groups may overlap."""
    return similar.groups(chunks, threshold, by)


def contradiction_prefilter(new: DataFrame, existing: DataFrame, threshold: float = 0.15) -> DataFrame:
    """Pairs worth asking a checker about: three words or more in the new text, and so much overlap."""
    return overlaps(new, existing, 3).where((F.col("similarity") >= threshold) & (F.col("new_id") != F.col("old_id"))).select("new_id", "old_id", "similarity")


def contradiction_figures(new: DataFrame, existing: DataFrame, threshold: float = 0.15) -> DataFrame:
    """How many pairs with each new text a checker would be asked about, and the least and greatest id of the other side."""
    return overlap.figures(new, existing, threshold)


def working_sessions(blocks: DataFrame) -> DataFrame:
    """A row a session: its categories in their order, and time and preview of its first block by category."""
    rows = blocks.select("session_id", "cat_ord", "category", "pos", "ts_raw", T.preview("content").alias("preview"))
    listed = F.array_sort(F.collect_set(F.struct("cat_ord", "category")))
    first = F.struct("cat_ord", "pos")
    return rows.groupBy("session_id").agg(F.array_join(F.transform(listed, lambda x: x["category"]), ",").alias("categories"), F.min_by("ts_raw", first).alias("first"), F.min_by("preview", first).alias("preview"))


def timeline(blocks: DataFrame, everywhere: str) -> DataFrame:
    """Blocks of all projects but the global one, expired ones too, newest first by the raw time."""
    return blocks.where(F.col("project") != everywhere).select("ts_raw", "project", "category", "session_id", T.preview("content").alias("preview")).orderBy(F.desc("ts_raw"), "session_id")
