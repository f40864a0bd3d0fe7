"""The queries of this subpackage, and DuckDB SQL for those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import ann, bpe, chat, licenses, lloyd, media, minhash, packing, quality, spelling, substrings, toxicity, wrappers

Query = Callable[[SparkSession, str], DataFrame]


def queries() -> dict[str, Query]:
    return {
        "op1_chat": chat.op1_chat,
        "op2_packing": packing.op2_packing,
        "op3_bpe": bpe.op3_bpe,
        "op4_media": media.op4_media,
        "op5_wrappers": wrappers.op5_wrappers,
        "op6_licenses": licenses.op6_licenses,
        "op7_quality": quality.op7_quality,
        "op8_substrings": substrings.op8_substrings,
        "op9_ann": ann.op9_ann,
        "op10_minhash": minhash.op10_minhash,
        "op11_spelling": spelling.op11_spelling,
        "op12_lloyd": lloyd.op12_lloyd,
        "op13_toxicity": toxicity.op13_toxicity,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_chat": chat.OP1_SQL, "op11_spelling": spelling.OP11_SQL, "op12_lloyd": lloyd.OP12_SQL}
