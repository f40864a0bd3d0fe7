"""Stores on files: partitioned appends, upserts that rewrite only touched partitions, markdown, catalogs."""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.sources.markdown import parse_blocks


def scratch(spark: SparkSession) -> str:
    """The folder that driver and executors share, from spark.checkpoint.dir; one of this machine where that is unset and all runs here."""
    place = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not place and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (place or "/tmp/checkpoints/quillspark").rstrip("/")


def kept(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so that its lineage is one read."""
    path = f"{scratch(df.sparkSession)}/rounds/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def append_events(events: DataFrame, path: str) -> None:
    """Append by UTC day."""
    events.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).write.mode("append").partitionBy("date").parquet(path)


def read_events(spark: SparkSession, path: str, since: str | None = None) -> DataFrame:
    """Events of days from ``since`` on; the day prunes partitions."""
    rows = spark.read.parquet(path).withColumn("date", F.col("date").cast("string"))
    return rows if since is None else rows.where(F.col("date") >= since)


def write_blocks(blocks: DataFrame, path: str) -> None:
    blocks.write.mode("overwrite").partitionBy("project", "category").parquet(path)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def delete(spark: SparkSession, path: str) -> None:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def upsert_blocks(spark: SparkSession, path: str, new: DataFrame) -> None:
    """Replace blocks by project, category and session; partitions that ``new`` doesn't name stay as they are.

    The merged rows are written beside the store, under a name of their own,
    before they replace its partitions, so a failed job leaves the old ones and
    two upserts don't share their rows; they are deleted whatever happens.
    """
    old = spark.read.parquet(path)
    touched = new.select("project", "category").distinct()
    merged = old.join(touched, ["project", "category"], "left_semi").join(new.select("project", "category", "session_id"), ["project", "category", "session_id"], "left_anti").unionByName(new.select(*old.columns))
    beside = f"{path.rstrip('/')}.merged-{uuid.uuid4().hex}"
    try:
        merged.write.parquet(beside)
        spark.read.schema(old.schema).parquet(beside).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("project", "category").parquet(path)
    finally:
        delete(spark, beside)


def save(df: DataFrame, path: str) -> None:
    """An index, a graph's nodes or edges, a manifest or a learner's state, replaced as a whole by Spark's commit."""
    df.write.mode("overwrite").parquet(path)


def load_or_create(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """What save() wrote, or no rows where there is nothing yet."""
    return spark.read.schema(schema).parquet(path) if exists(spark, path) else spark.createDataFrame([], schema)


def write_markdown(rows: DataFrame, path: str) -> None:
    """Rows of text in order, as text files by project and category: each category's rows in one range of positions after another."""
    ordered = rows.repartitionByRange("project", "category", "pos").sortWithinPartitions("project", "category", "pos")
    ordered.select("project", "category", F.col("text").alias("value")).write.mode("overwrite").partitionBy("project", "category").text(path)


def read_markdown(spark: SparkSession, path: str) -> DataFrame:
    return parse_blocks(spark.read.option("wholetext", True).text(path))


def catalog(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, size, time, and project and category where the path names them; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    part = lambda name: F.nullif(F.regexp_extract("path", rf"/{name}=([^/]*)/", 1), F.lit(""))
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"), part("project").alias("project"), part("category").alias("category"))
