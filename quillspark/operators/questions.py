"""Tables of questions answered in one plan, over an index of words that is built once and kept.

The index holds, per term and block of documents, the postings (id and the
weight that BM25 gives the term there) and the greatest of the weights. A block
holds so many documents on the average, so a term that all documents hold is
many rows. Whatever goes over the index is dealt by blocks into tasks of so many
words, and tasks are as many as the words (and the questions' blocks) need: a
text's scores are summed within its block's task. For a question, the sum of its terms' idf times the greatest weights
bounds every score in a block from above. The blocks of greatest bounds are
scored first; the k-th score found there is the question's threshold; of the
other blocks only those are read whose bound reaches it. No answer is lost, and
postings of blocks that can't matter are never opened.

Questions are rows: any number of them go through the same joins, and each
keeps its k best by a ranked window, which tasks cut down before they shuffle.
Vectors are compared by matrix products: where the questions are few enough for
it (``HELD``, checked) they go to every task, which keeps k hits a question;
beyond that questions and chunks meet block by block.

Ids are unique in chunks and qids in questions. A null text or vector has no
words and cosine 0 with everything; a question without words or vector has no
hits on that side; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators.retrieval import K1, RRF, B
from quillspark.sources.stores import kept

#: Documents of a block; questions that tasks hold at once.
PER_BLOCK, HELD = 64, 4_096
#: Words that a task indexes or opens; scores (of a question and a document) that it may sum.
WORDS, SCORES = 250_000, 500_000
#: Digits behind the point that tell scores apart.
DIGITS = 9


def build(chunks: DataFrame, path: str, per_block: int = PER_BLOCK) -> None:
    """Write the index of id and text to ``path``: postings by term and block, terms, and one row of figures."""
    words = kept(chunks.select("id", T.tokens(F.coalesce("text", F.lit(""))).alias("tokens")).withColumn("length", F.size("tokens")), "tokens")
    figures = words.agg(F.count("*").alias("docs"), F.avg("length").alias("mean"), F.ceil(F.count("*") / per_block).cast("int").alias("blocks"), F.coalesce(F.ceil(F.sum("length") / WORDS), F.lit(0)).cast("int").alias("tasks"))
    figures.write.mode("overwrite").parquet(f"{path}/figures")
    known = chunks.sparkSession.read.parquet(f"{path}/figures").first()
    # One shuffle, of token lists; a block's terms are counted and gathered where they arrive.
    dealt = words.withColumn("block", F.pmod(F.xxhash64("id"), F.lit(max(1, known["blocks"]))).cast("int")).repartition(max(1, known["tasks"]), "block")
    tf = dealt.select("id", "length", "block", F.explode("tokens").alias("term")).groupBy("block", "term", "id", "length").agg(F.count("*").alias("tf"))
    weight = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("length") / F.lit(known["mean"] or 1.0)))
    posted = tf.groupBy("block", "term").agg(F.sort_array(F.collect_list(F.struct("id", weight.alias("weight")))).alias("postings"), F.max(weight).alias("top"), F.count("*").alias("n"))
    posted.sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{path}/postings")
    chunks.sparkSession.read.parquet(f"{path}/postings").groupBy("term").agg(F.sum("n").alias("df")).write.mode("overwrite").parquet(f"{path}/terms")


class Words:
    """What build() has written."""

    def __init__(self, spark: SparkSession, path: str):
        read = lambda name: spark.read.parquet(f"{path}/{name}")
        self.postings, self.terms = read("postings"), read("terms")
        figures = read("figures").first()
        self.docs, self.blocks, self.tasks = figures["docs"], max(1, figures["blocks"]), max(1, figures["tasks"])

    def weighed(self, questions: DataFrame) -> DataFrame:
        """qid, term and w: how often a question names a term, times the term's idf."""
        asked = questions.select("qid", F.explode(T.tokens("text")).alias("term")).groupBy("qid", "term").agg(F.count("*").alias("times"))
        idf = F.log((self.docs - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
        met = asked.repartition(self.tasks, "term").join(self.terms.repartition(self.tasks, "term"), "term")
        return met.select("qid", "term", (F.col("times") * idf).alias("w"))

    def bounds(self, weighed: DataFrame) -> DataFrame:
        """qid, block, most (no document of the block scores more) and n, the postings a search of it reads."""
        met = weighed.join(self.postings.select("term", "block", "top", "n"), "term")
        return met.groupBy("qid", "block").agg(F.sum(F.col("w") * F.col("top")).alias("most"), F.sum("n").alias("n"))

    def sums(self, weighed: DataFrame, blocks: DataFrame) -> DataFrame:
        """qid, id and score of the documents in the blocks (qid, block) that each question names."""
        tasks = min(self.blocks, max(self.tasks, -(-blocks.count() * -(-self.docs // self.blocks) // SCORES)))
        asked = blocks.select("qid", "block").join(weighed, "qid").select("block", "term", F.struct("qid", "w").alias("named"))
        both = asked.unionByName(self.postings.select("block", "term", "postings"), allowMissingColumns=True).repartition(tasks, "block")
        # Terms meet, and scores are summed, where their block is: a join on both columns would deal them anew.
        met = both.groupBy("block", "term").agg(F.collect_list("named").alias("named"), F.first("postings", ignorenulls=True).alias("postings"))
        parts = met.select("block", "postings", F.explode("named").alias("q")).select("block", "q", F.explode("postings").alias("p"))
        # Rounded, so that documents of equal text stay equal in whatever order their terms are summed.
        return parts.groupBy("block", "q.qid", "p.id").agg(F.round(F.sum(F.col("q.w") * F.col("p.weight")), DIGITS).alias("score")).drop("block")

    def scored(self, weighed: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
        """The k best documents of each question in the blocks that it names."""
        return best(self.sums(weighed, blocks), k)

    def plan(self, questions: DataFrame, k: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """Terms, hits of the blocks of greatest bounds, the other blocks that may hold better ones, and all bounds."""
        weighed = kept(self.weighed(questions), "terms")
        bounds = kept(self.bounds(weighed), "bounds")
        order = Window.partitionBy("qid").orderBy(F.desc("most"), "block")
        ranked = bounds.withColumn("nth", F.row_number().over(order))
        first = kept(self.scored(weighed, ranked.where(F.col("nth") <= 2), k), "hits")
        threshold = first.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(0.0).alias("threshold"))
        # A hair less: sums in another order may differ in their last digits.
        rest = ranked.where("nth > 2").join(threshold, "qid").where(F.col("most") >= F.col("threshold") * (1 - 1e-9))
        return weighed, first, rest, bounds

    def search(self, questions: DataFrame, k: int) -> DataFrame:
        """qid, id and score: the k best documents by BM25 of every question (qid, text)."""
        weighed, first, rest, _ = self.plan(questions, k)
        return best(first.unionByName(self.scored(weighed, rest, k)), k)


def best(hits: DataFrame, k: int) -> DataFrame:
    """The k best hits of every question, ties by id; each task drops what can't be among them before the shuffle."""
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "id", "score")


class _Best:
    """The k best (score, id) of each question so far."""

    def __init__(self, qids: list, vectors: list, k: int):
        self.qids, self.k = qids, k
        self.rows: dict[int, tuple[list[int], np.ndarray]] = {}
        lengths = [len(v) for v in vectors]
        for d in set(lengths):
            at = [i for i, n in enumerate(lengths) if n == d]
            x = np.array([vectors[i] for i in at], np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            self.rows[d] = at, x / np.where(norms > 0, norms, 1)[:, None]
        self.scores = [np.zeros(0) for _ in qids]
        self.ids = [np.zeros(0, np.int64) for _ in qids]

    def take(self, ids: np.ndarray, vectors: list) -> None:
        for d, (at, questions) in self.rows.items():
            x = np.array([v if v is not None and len(v) == d else [0.0] * d for v in vectors], np.float64)
            norms = np.sqrt((x * x).sum(axis=1))
            cosines = np.round(questions @ (x / np.where(norms > 0, norms, 1)[:, None]).T, DIGITS)
            for i, row in zip(at, cosines, strict=True):
                scores, found = np.concatenate([self.scores[i], row]), np.concatenate([self.ids[i], ids])
                if len(scores) > self.k:
                    least = np.partition(scores, len(scores) - self.k)[len(scores) - self.k]
                    may = np.flatnonzero(scores >= least)  # with all ties
                    may = may[np.lexsort((found[may], -scores[may]))[: self.k]]
                    scores, found = scores[may], found[may]
                self.scores[i], self.ids[i] = scores, found

    def told(self) -> pa.RecordBatch:
        n = [len(s) for s in self.scores]
        return pa.RecordBatch.from_arrays([pa.array(np.repeat(self.qids, n), pa.int64()), pa.array(np.concatenate([*self.ids, np.zeros(0, np.int64)])), pa.array(np.concatenate([*self.scores, np.zeros(0)]))], ["qid", "id", "score"])


_HIT = "qid long, id long, score double"


def dense(chunks: DataFrame, questions: DataFrame, k: int, most: int = HELD) -> DataFrame:
    """qid, id and score: the k chunks (id, embedding) of greatest cosine of every question (qid, vector)."""
    asked = questions.where("vector IS NOT NULL AND size(vector) > 0").select(F.col("qid").cast("long").alias("qid"), F.col("vector").cast("array<double>").alias("vector"))
    rows = chunks.select(F.col("id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    first = asked.limit(most + 1).toArrow()
    if first.num_rows <= most:
        qids, vectors = first["qid"].to_pylist(), first["vector"].to_pylist()

        def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            top = _Best(qids, vectors, k)
            for batch in batches:
                top.take(batch.column("id").to_numpy(), batch.column("embedding").to_pylist())
            yield top.told()

        return best(rows.mapInArrow(held, _HIT), k)
    parts = -(-asked.count() // most)
    cells = max(1, -(-rows.count() // (16 * most)))
    some = asked.select(F.pmod(F.xxhash64("qid"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(cells - 1))).alias("cell"), "qid", "vector")
    every = rows.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1)).cast("array<long>")).alias("part"), F.pmod(F.xxhash64("id"), F.lit(cells)).cast("int").alias("cell"), "id", "embedding")

    def meet(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        top = _Best(ours["qid"].to_pylist(), ours["vector"].to_pylist(), k)
        for batch in theirs.to_batches(2_048):
            top.take(batch.column("id").to_numpy(), batch.column("embedding").to_pylist())
        return pa.Table.from_batches([top.told()])

    return best(some.groupBy("part", "cell").cogroup(every.groupBy("part", "cell")).applyInArrow(meet, _HIT), k)


def hybrid(chunks: DataFrame, index: Words, questions: DataFrame, k: int) -> DataFrame:
    """Reciprocal rank fusion of max(3k, 30) hits by words and by vector of every question (qid, text, vector)."""
    wide = max(3 * k, 30)
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "id")
    part = lambda hits: hits.select("qid", "id", (1.0 / (RRF + F.row_number().over(order))).alias("part"))
    both = part(dense(chunks, questions, wide)).unionByName(part(index.search(questions, wide)))
    return best(both.groupBy("qid", "id").agg(F.sum("part").alias("score")), k)


def answers(chunks: DataFrame, hits: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, category and answer: of the best hit's lines the one most like the question (the first of equals), with how alike; no hit, no answer."""
    first = best(hits, 1).join(chunks.select("id", "category", "text"), "id").join(questions.select("qid", F.col("text").alias("question")), "qid")
    lines = first.select("qid", "category", "question", F.posexplode(T.lines("text")).alias("line_no", "line"))
    like = lines.withColumn("like", T.token_f1(F.col("line"), F.col("question")))
    told = like.groupBy("qid", "category").agg(F.min_by("line", F.struct(-F.col("like"), F.col("line_no"))).alias("answer"))
    return questions.select("qid", F.col("text").alias("question")).join(told, "qid", "left")


def evaluated(answered: DataFrame, gold: DataFrame) -> DataFrame:
    """category (null: all), n, mean f1 and the share without an answer, over answers (qid, category, answer) and gold (qid, expected)."""
    rows = answered.join(gold, "qid", "left").select("category", F.coalesce(T.token_f1(F.col("answer"), F.col("expected")), F.lit(0.0)).alias("f1"), F.col("answer").isNull().cast("int").alias("missing"))
    sets = rows.groupingSets([["category"], []], "category")
    return sets.agg(F.count("*").alias("n"), F.avg("f1").alias("f1"), F.avg("missing").alias("not_found"))
