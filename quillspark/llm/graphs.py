"""Connected components of a table of links, without bringing links to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import delete, hinted, stored, written


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node and label (the least node of its component) for every node that a link names.

    Labels pass along links and are then shortened through the label's own
    label, until nothing changes. Each round is written to the shared folder,
    so its lineage is one read. A node with very many links is one key of a
    join and of a pre-aggregated minimum, which split or combine it. Labels of
    few nodes (``common.FEW``, counted first) go to all tasks instead, so a
    round is one shuffle. The tables of past rounds are deleted.
    """
    spark, before = links.sparkSession, written()
    both = links.select(F.col(a).alias("node"), F.col(b).alias("other")).where(F.col(a) != F.col(b))
    both = stored(both.unionByName(both.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct(), "links")
    labels = stored(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")), "labels")
    small = hinted(labels)
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("offered"))
        offers = both.join(small(seen), "other").groupBy("node").agg(F.min("offered").alias("offered"))
        passed = labels.join(small(offers), "node", "left").select("node", F.col("label").alias("old"), F.least("label", "offered").alias("label"))
        upper = labels.select(F.col("node").alias("label"), F.col("label").alias("upper"))
        shorter = stored(passed.join(small(upper), "label", "left").select("node", "old", F.least("label", "upper").alias("label")), "labels")
        changed = shorter.where(F.col("old") != F.col("label")).limit(1).count()
        labels = shorter.select("node", "label")
        new = [p for p in written() if p not in before]
        if not changed:
            delete(spark, new[:-1])
            return labels
        delete(spark, new[1:-1])
