"""The training-corpus pipeline: quality, near duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of documents. A stage's result is written to the
folder that driver and executors share and read again as the next one's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.llm import minhash, packing, quality, substrings
from quillspark.llm.common import delete, fresh, stored, table, written


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on these documents' labels, doesn't reject.

    Rows keep their columns and order of columns. A null text is scored as the
    empty one; repeated rows have one score; without labels every row stays; an
    empty table stays empty.
    """
    return quality.keep(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the least doc_id.

    Of several texts of one doc_id each is judged by itself. Rows that repeat in
    doc_id and text stay once, the one of least hash of all its columns. Rows
    without doc_id stay; null texts are equal to each other and to the empty
    text; an empty table stays empty.
    """
    names = docs.columns
    one, two, nth = (fresh(n, names) for n in ("h1", "h2", "nth"))
    kept = minhash.near_duplicates(docs).where("first").select(F.col("doc_id").alias(fresh("kept", names)), F.col("h1").alias(one), F.col("h2").alias(two)).distinct()
    doc = docs["doc_id"].cast("long")
    h1, h2 = minhash.text_hashes(docs["text"])
    rows = docs.where(doc.isNotNull()).withColumns({one: h1, two: h2})
    rows = rows.join(kept, (doc == kept[kept.columns[0]]) & (rows[one] == kept[one]) & (rows[two] == kept[two]), "left_semi")
    once = Window.partitionBy(rows["doc_id"], rows[one], rows[two]).orderBy(F.xxhash64(*(rows[f"`{n}`"] for n in names)))
    rows = rows.withColumn(nth, F.row_number().over(once)).where(F.col(nth) == 1)
    return rows.select(*(f"`{n}`" for n in names)).unionByName(docs.where(doc.isNull()))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a document of lesser doc_id holds.

    Every row stays, with its columns; n_chars, where it exists, is counted anew.
    Null texts and rows without doc_id stay as they are; rows of one doc_id don't
    count against each other; a document that is a repeat as a whole keeps an
    empty text; an empty table stays empty.
    """
    return substrings.dedup(docs).select(*(f"`{n}`" for n in docs.columns))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 4096 ids.

    A null or empty text is its separator alone; rows without doc_id and repeated
    rows are packed each; other columns are dropped; an empty table gives no pieces.
    """
    return packing.pieces(docs, CACHE)


#: Chunks whose ids a packing worker keeps: fewer than packing alone would, as the workers serve all stages.
CACHE = 100_000

STAGES = [("quality", keep_quality), ("near_duplicates", keep_distinct), ("substrings", cut_repeats), ("packing", pack)]

#: A fitted model and a tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each but the last stored and read again; what a stage wrote on the way goes once it is done."""
    docs = table(spark, sf_dir, "documents")
    before = written()
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
        delete(spark, [p for p in written() if p not in before][:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
