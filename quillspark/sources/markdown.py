"""Knowledge files: markdown with one heading a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.functions.text import preview

_HEAD = r"(?s)^## Session: (\S+) \(([^)]*)\)((?:\s*\[[^\]]*\])*)"


def parse_blocks(files: DataFrame) -> DataFrame:
    """Blocks of whole files in ``value``: heading, tags in any order, content up to the next heading; what stands before the first is dropped."""
    parts = F.split("value", r"(?m)(?=^## Session: )")
    rows = files.select(*[c for c in files.columns if c != "value"], F.posexplode(parts).alias("part", "text")).where(F.col("text").rlike(_HEAD))
    tags = F.regexp_extract("text", _HEAD, 3)
    tag = lambda name: F.nullif(F.regexp_extract(tags, rf"\[{name}:([^\]]*)\]", 1), F.lit(""))
    content = F.regexp_replace(F.regexp_replace("text", _HEAD, ""), r"^\s+|\s+$", "")
    return rows.select(
        *[c for c in files.columns if c != "value"],
        "part",
        F.regexp_extract("text", _HEAD, 1).alias("session_id"),
        F.regexp_extract("text", _HEAD, 2).alias("ts_raw"),
        F.try_to_timestamp(F.regexp_extract("text", _HEAD, 2)).alias("ts"),
        tag("ttl").alias("ttl"),
        tag("confidence").alias("confidence"),
        tag("strength").try_cast("double").alias("strength"),
        tag("access").try_cast("int").alias("access_count"),
        content.alias("content"),
        preview(content).alias("preview"),
    )
