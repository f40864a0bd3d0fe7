"""A kept store and what upkeep does with it: repairs that a plan names, and the steps of the maintenance cycle.

A store is a folder: ``blocks`` by project and category; ``contexts``, a
document a project; ``index``, the embedding index by a block's pos; ``graph``,
concepts and relationships by project; ``memory``, the newest lines of each
project. Repairs write by project, so one that runs again replaces its own rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.scoring import days_between, expired
from quillspark.operators import blocks as B
from quillspark.operators import quality as Q
from quillspark.operators import upkeep as U
from quillspark.operators.documents import graph_of_json
from quillspark.operators.embedded import Embedded
from quillspark.operators.providers import Chat, Embed, chat_column, echo_chat, hashing_embedder
from quillspark.sources import stores

#: Lines of a digest, and characters of a line.
LINES, WIDTH = 50, 200


def digest(blocks: DataFrame, now: Column, lines: int = LINES, width: int = WIDTH) -> DataFrame:
    """project and text: begins of the first lines of a project's newest active blocks that have any, newest first, ties by pos; what a provider is shown, whatever a project holds."""
    line = F.substring(F.substring_index(F.ltrim("content"), "\n", 1), 1, width)
    rows = B.active(blocks, now).select("project", "ts", "pos", line.alias("line")).where("line <> ''")
    newest = F.row_number().over(Window.partitionBy("project").orderBy(F.desc("ts"), "pos"))
    shown = F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda r: r["line"])
    return rows.withColumn("nth", newest).where(F.col("nth") <= lines).groupBy("project").agg(F.array_join(shown, "\n").alias("text"))


def word_graph(system: str, user: str) -> str:
    """A provider of graphs for tests and offline use: the first three long words of a text, each related to the next."""
    import json
    import re

    words = re.findall(r"[a-z]{7,}", user.split("\n\n", 1)[1])[:3]
    pairs = zip(words, words[1:], strict=False)
    return json.dumps({"concepts": [{"id": w, "name": w, "category": "tool"} for w in words], "relationships": [{"from": a, "to": b, "type": "relates-to"} for a, b in pairs]})


@dataclass
class Kept:
    """A store at ``path``, the time that it is asked at, and its providers."""

    spark: SparkSession
    path: str
    now: Column
    chat: Chat = echo_chat
    graphs: Chat = word_graph
    embedder: Embed = hashing_embedder

    def blocks(self) -> DataFrame:
        return stores.read_blocks(self.spark, f"{self.path}/blocks")

    @property
    def index(self) -> Embedded:
        return Embedded(self.spark, f"{self.path}/index", self.embedder)

    def kept(self, name: str, schema: str) -> DataFrame:
        """One of the store's tables by project, or no rows where there is none yet."""
        return stores.load_or_create(self.spark, f"{self.path}/{name}", f"{schema}, project string")

    def contexts(self) -> DataFrame:
        return self.kept("contexts", "context string, made timestamp")

    def concepts(self) -> DataFrame:
        return self.kept("graph/concepts", "concept string, name string, category string, importance double")

    def relationships(self) -> DataFrame:
        return self.kept("graph/relationships", "src string, dst string, rel_type string, strength double")

    def _replace(self, rows: DataFrame, name: str) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project").parquet(f"{self.path}/{name}")

    def figures(self) -> DataFrame:
        """What project_issues() judges, a row a project: the context's age, and whether every active block is in the index with its present text and the project in the graph."""
        b = self.blocks().withColumn("gone", expired(F.col("ts"), F.col("ttl"), self.now))
        have = b.join(self.index.ids().select(F.col("id").alias("pos"), F.col("digest").alias("indexed")), "pos", "left")
        missing = ~F.col("gone") & F.col("content").isNotNull() & ~F.sha2("content", 256).eqNullSafe(F.col("indexed"))
        per = have.groupBy("project").agg(
            F.min(days_between(F.col("ts"), self.now)).alias("newest_age"),
            (F.count_if(missing) == 0).alias("has_embeddings"),
            F.sum(F.octet_length("content").cast("long")).alias("bytes"),
            F.count_if(~F.col("gone") & (F.col("category") == "questions")).alias("inbox"),
            F.count_if("gone").alias("expired"),
        )
        sizes = b.groupBy("project", "category").agg(F.sum(F.octet_length("content").cast("long")).alias("n")).groupBy("project").agg(F.max("n").alias("largest"))
        made = self.contexts().select("project", days_between(F.col("made"), self.now).alias("context_age"))
        drawn = self.kept("graph/drawn", "replies long").select("project").withColumn("has_graph", F.lit(True))
        rows = per.join(sizes, "project").join(made, "project", "left").join(drawn, "project", "left")
        return rows.withColumn("has_graph", F.coalesce("has_graph", F.lit(False))).withColumn("has_dir", F.lit(True))

    def _of(self, plan: DataFrame, action: str) -> DataFrame:
        """Active blocks of the projects for which a plan names an action."""
        projects = plan.where(F.col("action") == action).select("project").distinct()
        return B.active(self.blocks(), self.now).join(projects, "project", "left_semi")

    def regenerate(self, rows: DataFrame) -> None:
        """Context documents anew, the provider asked once a project with its digest."""
        self._replace(digest(rows, self.now).select("project", chat_column("text", "context", self.chat).alias("context"), self.now.alias("made")), "contexts")

    def embed(self, rows: DataFrame) -> None:
        """Vectors of texts that the index has none of."""
        self.index.put(rows.select(F.col("pos").alias("id"), F.col("content").alias("text")))

    def build_graph(self, rows: DataFrame) -> None:
        """Concepts and relationships that the provider finds in each block, merged within a project; a project of which no reply is a graph stays without."""
        asked = rows.select("project", F.col("pos").alias("id"), chat_column("content", "graph", self.graphs).alias("reply"))
        # Asked once: both tables come from the same replies.
        replies = stores.kept(asked, "replies")
        self._replace(U.graph_concepts(replies, "project"), "graph/concepts")
        edges = graph_of_json(replies, sorted(set(U.RELATIONS.values())), []).join(replies.select("id", "project"), "id")
        self._replace(edges.groupBy("project", "src", "dst", "rel_type").agg(F.max("strength").alias("strength")), "graph/relationships")
        self._replace(replies.where(F.contains("reply", F.lit('"concepts"'))).groupBy("project").agg(F.count("*").alias("replies")), "graph/drawn")

    def heal(self) -> DataFrame:
        """Run the repairs that the store's figures call for: project, action and fixed, whether the issue is gone by new figures; issues that nothing repairs aren't listed."""
        plan = stores.kept(U.repairs(U.project_issues(self.figures())), "plan")
        for action, repair in (("regenerate", self.regenerate), ("embed", self.embed), ("build_graph", self.build_graph)):
            rows = self._of(plan, action)
            if not rows.isEmpty():
                repair(rows)
        left = U.repairs(U.project_issues(self.figures())).withColumn("left", F.lit(True))
        return plan.join(left, ["project", "action"], "left").select("project", "action", F.col("left").isNull().alias("fixed"))

    # The cycle's steps: each takes a batch of blocks and returns how many rows it handled.

    def ingest(self, batch: DataFrame) -> int:
        """Blocks of the batch, put into the store or replacing those of their project, category and session; of a repeated one that of greatest pos."""
        last = F.row_number().over(Window.partitionBy("project", "category", "session_id").orderBy(F.desc("pos"), F.xxhash64("content")))
        rows = stores.kept(batch.withColumn("nth", last).where("nth = 1").drop("nth"), "batch")
        if stores.exists(self.spark, f"{self.path}/blocks"):
            stores.upsert_blocks(self.spark, f"{self.path}/blocks", rows)
        else:
            stores.write_blocks(rows, f"{self.path}/blocks")
        return rows.count()

    def inject(self, batch: DataFrame) -> int:
        """Memory of the batch's projects anew."""
        rows = stores.kept(digest(self.blocks().join(batch.select("project").distinct(), "project", "left_semi"), self.now), "memory")
        self._replace(rows.select("text", "project"), "memory")
        return rows.count()

    def distill(self, batch: DataFrame) -> int:
        """Expired blocks leave the store; only parts that hold some are written anew, those left empty are deleted."""
        gone = expired(F.col("ts"), F.col("ttl"), self.now)
        rows = self.blocks()
        place = F.regexp_replace("_metadata.file_path", "/[^/]*$", "")
        per = rows.groupBy("project", "category").agg(F.count_if(gone).alias("expired"), F.count_if(~gone).alias("active"), F.min(place).alias("place"))
        touched = stores.kept(per.where("expired > 0"), "touched")
        beside = stores.kept(B.active(rows, self.now).join(touched.select("project", "category"), ["project", "category"], "left_semi"), "active")
        beside.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "category").parquet(f"{self.path}/blocks")
        for r in touched.where("active = 0").select("place").toLocalIterator():  # folders, not rows
            stores.delete(self.spark, r["place"])
        return touched.agg(F.sum("expired")).first()[0] or 0

    def doctor(self, batch: DataFrame) -> int:
        """Repairs run, and how many issues they ended."""
        return self.heal().where("fixed").count()

    def score(self, batch: DataFrame) -> int:
        """The quality of every project, noted."""
        rows = stores.kept(Q.project_quality(self.blocks(), self.now), "quality")
        self._replace(rows, "quality")
        return rows.count()

    def steps(self) -> list[tuple[str, Callable[[DataFrame], int]]]:
        """The maintenance cycle in its order, for streams.cycle()."""
        return [("ingest", self.ingest), ("inject", self.inject), ("distill", self.distill), ("doctor", self.doctor), ("quality", self.score)]
