"""Snapshots, commits, diffs, inboxes and packs over the block store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions.diff import changes


def status(working: DataFrame, head: DataFrame, staged: DataFrame) -> DataFrame:
    """New, removed and staged sessions of a working set against a snapshot."""
    w, h, s = (x.select("session_id").distinct() for x in (working, head, staged))
    tag = lambda df, name: df.withColumn("state", F.lit(name))
    return tag(w.join(h, "session_id", "left_anti"), "new").unionByName(tag(h.join(w, "session_id", "left_anti"), "removed")).unionByName(tag(w.join(s, "session_id", "left_semi"), "staged"))


def content_hashes(blocks: DataFrame) -> DataFrame:
    """16 hex digits of sha256 over a session's category:content lines in category order."""
    ordered = F.array_sort(F.collect_list(F.struct("cat_ord", F.concat_ws(":", "category", "content").alias("line"))))
    return blocks.groupBy("session_id").agg(F.substring(F.sha2(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n"), 256), 1, 16).alias("hash"))


def commit_id(hashes: DataFrame) -> DataFrame:
    """A commit's id by a tree: 8 hex digits of sha256 over the digests of 256 buckets, each over those of 256 smaller ones of sorted id:hash lines.

    A bucket is a range of the id's hash, so a task holds a 65,536th of the
    lines of a snapshot, then 256 digests.
    """
    fold = lambda rows, key, line: F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(key, line))), lambda x: x["line"]), "\n"), 256)
    line = F.concat_ws(":", "session_id", "hash").alias("line")
    place = F.substring(F.sha2("session_id", 256), 1, 4)
    leaves = hashes.select(place.alias("place"), line).groupBy("place").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("line")), "\n"), 256).alias("line"))
    middle = leaves.groupBy(F.substring("place", 1, 2).alias("part")).agg(fold(leaves, F.col("place"), F.col("line")).alias("line"))
    return middle.agg(F.substring(fold(middle, F.col("part"), F.col("line")), 1, 8).alias("commit_id"))


def listed_commit_id(hashes: DataFrame) -> str:
    """A commit's id by the list: 8 hex digits of sha256 over all sorted id:hash lines. Spark sorts; the driver reads the lines one after another and holds none."""
    import hashlib

    digest, first = hashlib.sha256(), True
    for row in hashes.select(F.concat_ws(":", "session_id", "hash").alias("line")).orderBy("line").toLocalIterator():
        digest.update((row["line"] if first else f"\n{row['line']}").encode())
        first = False
    return digest.hexdigest()[:8]


def checkout(working: DataFrame, target: DataFrame, committed: DataFrame) -> DataFrame:
    """Rows after a checkout: the snapshot's, and uncommitted ones that it doesn't have."""
    loose = working.join(committed.select("session_id").distinct(), "session_id", "left_anti").join(target.select("category", "session_id").distinct(), ["category", "session_id"], "left_anti")
    return target.withColumn("origin", F.lit("snapshot")).unionByName(loose.withColumn("origin", F.lit("uncommitted")))


def conflicts(working: DataFrame, target: DataFrame) -> DataFrame:
    """Sessions whose content differs from the snapshot's."""
    t = target.select("category", "session_id", F.col("content").alias("theirs"))
    return working.join(t, ["category", "session_id"]).where("content <> theirs").select("category", "session_id")


def block_diff(a: DataFrame, b: DataFrame) -> DataFrame:
    """Blocks added, removed or changed from a to b."""
    x = a.select("category", "session_id", F.sha2("content", 256).alias("old"))
    y = b.select("category", "session_id", F.sha2("content", 256).alias("new"))
    kind = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "changed")
    return x.join(y, ["category", "session_id"], "full_outer").select("category", "session_id", kind.alias("kind")).where("kind IS NOT NULL")


def line_sets(old: Column, new: Column) -> Column:
    """struct(added, removed): numbers of distinct lines that only one side has."""
    a, b = F.split(old, "\n"), F.split(new, "\n")
    return F.struct(F.size(F.array_except(b, a)).alias("added"), F.size(F.array_except(a, b)).alias("removed"))


def line_diff(rows: DataFrame, texts: bool = True, at_once: int = 128) -> DataFrame:
    """Line by line: id, line_num, diff_type (added, removed, modified), old, new, of a shortest edit script of each row; without ``texts`` old and new stay null. Some rows of a batch at once are unpacked."""
    kinds = {"id": None, "line_num": "int32", "diff_type": "string", "old": "string", "new": "string"}

    def work(batches):
        import pyarrow as pa

        for whole in batches:
            for i in range(0, whole.num_rows, at_once):
                batch = whole.slice(i, at_once)
                keys, olds, news = (batch.column(c).to_pylist() for c in ("id", "old", "new"))
                out = [(key, *change) if texts else (key, *change[:2], None, None) for key, old, new in zip(keys, olds, news, strict=True) for change in changes(old, new)]
                types = [batch.schema.field("id").type, *(pa.type_for_alias(t) for t in list(kinds.values())[1:])]
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate(types)], [*kinds])

    return rows.select("id", "old", "new").mapInArrow(work, f"id {rows.schema['id'].dataType.simpleString()}, line_num int, diff_type string, old string, new string")


def diff_counts(diff: DataFrame) -> DataFrame:
    """id, and how many lines were added, removed and modified, of a line diff."""
    return diff.groupBy("id").agg(*(F.count_if(F.col("diff_type") == kind).alias(kind) for kind in ("added", "removed", "modified")))


def newest_versions(versions: DataFrame, keep: int) -> DataFrame:
    """The versions of each category past the newest ones: what a cleanup removes. Only the newest are gathered, and their oldest tells the others."""
    rank = F.row_number().over(Window.partitionBy("category").orderBy(F.desc("ts"), F.desc("version_id")))
    kept = versions.select("category", "ts", "version_id").withColumn("rank", rank).where(F.col("rank") <= keep)
    oldest = kept.groupBy("category").agg(F.min(F.struct("ts", "version_id")).alias("oldest"))
    return versions.join(oldest, "category").where(F.struct("ts", "version_id") < F.col("oldest")).drop("oldest")


def latest_versions(versions: DataFrame) -> DataFrame:
    return versions.groupBy("category").agg(F.max_by("version_id", F.struct("ts", "version_id")).alias("version_id"), F.max("ts").alias("ts"))


def drain(inbox: DataFrame, categories: list[str]) -> DataFrame:
    """Where inbox rows go: by the id's last part, else a category line; unknown ones stay."""
    suffix = F.substring_index("session_id", ":", -1)
    line = F.lower(F.regexp_extract("content", r"(?im)^\s*-\s*category:\s*(\w+)", 1))
    target = F.when(suffix.isin(categories), suffix).when(line.isin(categories), line)
    return inbox.withColumn("target", target).withColumn("promoted_id", F.when(target.isNotNull(), F.concat_ws(":", "session_id", target))).withColumn("state", F.when(target.isNotNull(), "promoted").otherwise("unknown"))


def pack_search(packs: DataFrame, keyword: str) -> DataFrame:
    k = keyword.lower()
    return packs.where(F.exists("keywords", lambda x: F.lower(x).contains(k)) | F.lower("name").contains(k) | F.lower("description").contains(k))


def pack_status(packs: DataFrame, installed: DataFrame) -> DataFrame:
    return packs.join(installed.select("id", F.lit(True).alias("installed")), "id", "left").withColumn("installed", F.coalesce("installed", F.lit(False)))


def orphans(packs: DataFrame, registries: DataFrame) -> DataFrame:
    """Packs whose registry is gone."""
    return packs.join(registries, "registry", "left_anti")


def first_packs(packs: DataFrame) -> DataFrame:
    """One pack a name, the first found."""
    return packs.groupBy("name").agg(F.min("id").alias("id"), F.count("*").alias("copies"))


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Files that a manifest doesn't hold with the same hash."""
    return files.join(manifest, ["path", "sha256"], "left_anti")


def register_diff(spark) -> None:
    """SQL's table function line_diff(old, new): line_num, diff_type, old, new."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="line_num int, diff_type string, old string, new string")
    class LineDiff:
        def eval(self, old: str, new: str):
            yield from changes(old, new)

    spark.udtf.register("line_diff", LineDiff)


def merged_changes(changes: DataFrame) -> DataFrame:
    """A line diff's deletions and insertions (id, seq, kind, text) in order, a deletion with the insertion right behind it as one modification: id, seq, kind, old, new."""
    order = Window.partitionBy("id").orderBy("seq")
    near = changes.withColumn("before", F.lag("kind").over(order)).withColumn("behind", F.lead("kind").over(order)).withColumn("next", F.lead("text").over(order))
    opens = (F.col("kind") == "removed") & (F.coalesce("behind", F.lit("")) == "added")
    taken = (F.col("kind") == "added") & (F.coalesce("before", F.lit("")) == "removed")
    rows = near.where(~taken)
    return rows.select("id", "seq", F.when(opens, "modified").otherwise(F.col("kind")).alias("kind"), F.when(F.col("kind") == "removed", F.col("text")).alias("old"), F.when(opens, F.col("next")).when(F.col("kind") == "added", F.col("text")).alias("new"))
