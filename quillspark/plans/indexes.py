"""Queries over a kept embedding index: two runs of which the second finds a third of the texts changed and a fifth gone."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from quillspark.operators.embedded import Embedded
from quillspark.plans.catalog import register
from quillspark.sources.stores import scratch
from quillspark.sources.views import chunks, oracle

_AFTER = "SELECT id, CASE WHEN id % 3 = 0 THEN text || ' changed' ELSE text END AS text FROM chunks WHERE id % 5 <> 4"


def _twice(spark, d) -> Embedded:
    index = Embedded(spark, f"{scratch(spark)}/stores/embedded-{uuid.uuid4().hex}")
    c = chunks(spark, d).select("id", "text")
    index.sync(c)
    after = F.when(F.col("id") % 3 == 0, F.concat("text", F.lit(" changed"))).otherwise(F.col("text"))
    index.sync(c.where("id % 5 <> 4").select("id", after.alias("text")))
    return index


@register("embedding_index", oracle(f"SELECT id, sha256(text) AS digest, 64 AS dims FROM ({_AFTER})"))
def embedding_index(spark, d):
    """What the index holds after both runs, by way of a compaction."""
    index = _twice(spark, d)
    index.compact()
    return index.read().select("id", "digest", F.size("embedding").alias("dims"))


@register("embedding_runs", oracle(f"""WITH a AS ({_AFTER}) SELECT 1 AS version, count(*) AS put, 0 AS removed, count(DISTINCT text) AS embedded FROM chunks
  UNION ALL SELECT 2, (SELECT count(*) FROM a JOIN chunks USING (id) WHERE a.text <> chunks.text), (SELECT count(*) FROM chunks WHERE id % 5 = 4), (SELECT count(DISTINCT text) FROM a WHERE text NOT IN (SELECT text FROM chunks))"""))
def embedding_runs(spark, d):
    """How many texts each run put, removed and embedded: the second embeds those alone that no run has seen."""
    return _twice(spark, d).history().drop("part")
