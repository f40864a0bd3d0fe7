"""Transcripts into turns, tool interactions and session figures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

BLOCK = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,is_error:boolean>>"
ENTRY = f"type string, uuid string, sessionId string, timestamp string, message struct<role:string, model:string, content:{BLOCK}, usage:struct<input_tokens:long,output_tokens:long>>"


def parse_journal(lines: DataFrame) -> DataFrame:
    """Journal entries of JSON lines; blank, broken and unknown ones are dropped. Content that is one string becomes one text block."""
    text = F.trim("value")
    plain = F.get_json_object(text, "$.message.content")
    entry = F.from_json(text, ENTRY)
    parsed = lines.where(text != "").withColumn("e", entry).withColumn("plain", plain)
    kinds = ["user", "assistant", "file-history-snapshot", "progress"]
    one = F.array(F.struct(F.lit("text").alias("type"), F.col("plain").alias("text"), *(F.lit(None).cast(t).alias(n) for n, t in (("id", "string"), ("name", "string"), ("input", "string"), ("tool_use_id", "string"), ("is_error", "boolean")))))
    content = F.coalesce(F.col("e.message.content"), F.when(F.col("plain").isNotNull() & ~F.col("plain").startswith("["), one))
    return parsed.where(F.col("e.type").isin(kinds)).select("pos", F.col("e.type").alias("type"), F.col("e.sessionId").alias("session_id"), F.col("e.timestamp").alias("timestamp"), F.col("e.message.model").alias("model"), content.alias("content"), F.col("e.message.usage.input_tokens").alias("input_tokens"), F.col("e.message.usage.output_tokens").alias("output_tokens"))


def content_text(content: Column) -> Column:
    """Text blocks joined by line feeds; others left out."""
    return F.array_join(F.transform(F.filter(content, lambda b: b["type"] == "text"), lambda b: b["text"]), "\n")


def turns(entries: DataFrame) -> DataFrame:
    """User turns with the assistant entries that follow.

    A user entry opens a turn; one without an answer is replaced by the next;
    answers before any user go to the first turn that is closed. An island per
    user entry, by a running count over the session.
    """
    order = Window.partitionBy("session_id").orderBy("pos")
    island = F.sum((F.col("role") == "user").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = entries.withColumn("island", island)
    # Answers before the first user belong to the first island that has a user.
    marked = marked.withColumn("island", F.greatest("island", F.lit(1)))
    user = F.max(F.when(F.col("role") == "user", F.struct("pos", "text")))
    answers = F.array_sort(F.collect_list(F.when(F.col("role") == "assistant", F.struct("pos", "text"))))
    grouped = marked.groupBy("session_id", "island").agg(user.alias("user"), answers.alias("answers")).where("user IS NOT NULL AND size(answers) > 0")
    numbered = grouped.withColumn("turn_no", F.row_number().over(Window.partitionBy("session_id").orderBy("island")))
    return numbered.select("session_id", "turn_no", F.col("user.text").alias("user_text"), F.array_join(F.transform("answers", lambda a: a["text"]), "\n").alias("assistant_text"), F.size("answers").alias("n_answers"))


def pair_tools(uses: DataFrame, results: DataFrame) -> DataFrame:
    """Uses with results by session and id, the k-th use with the k-th result; leftovers of either side stay, results as tool unknown."""
    order = Window.partitionBy("session_id", "id").orderBy("pos")
    u = uses.select("session_id", "id", F.col("pos").alias("use_pos"), "tool", "input", F.row_number().over(order).alias("nth"))
    r = results.select("session_id", "id", F.col("pos").alias("result_pos"), "output", F.row_number().over(order).alias("nth"))
    return u.join(r, ["session_id", "id", "nth"], "full_outer").select("session_id", "id", "use_pos", "result_pos", F.coalesce("tool", F.lit("unknown")).alias("tool"), F.coalesce("input", F.lit("")).alias("input"), F.coalesce("output", F.lit("")).alias("output"))


def session_figures(turns_: DataFrame, uses: DataFrame) -> DataFrame:
    """Turns, tokens and a tool-to-count map of each session."""
    t = turns_.groupBy("session_id").agg(F.count("*").alias("turns"), F.sum(T.token_estimate("user_text") + T.token_estimate("assistant_text")).alias("tokens"))
    c = uses.groupBy("session_id", "tool").agg(F.count("*").alias("n")).groupBy("session_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("tool", "n")))).alias("tools"))
    return t.join(c, "session_id", "left")


def prompt_text(turns_: DataFrame, private: bool = False) -> DataFrame:
    """A conversation as prompt text: users to 1000 bytes, assistants to 1500; private sections stripped unless ``private`` keeps the texts as they are."""
    part = F.concat(F.lit("User: "), T.truncate_bytes("user_text", 1000), F.lit("\n\nAssistant: "), T.truncate_bytes("assistant_text", 1500))
    ordered = F.array_sort(F.collect_list(F.struct("turn_no", part.alias("part"))))
    text = F.array_join(F.transform(ordered, lambda x: x["part"]), "\n\n")
    return turns_.groupBy("session_id").agg((text if private else T.strip_private(text)).alias("prompt"))


def tool_counts(uses: DataFrame) -> DataFrame:
    return uses.groupBy("session_id", "tool").agg(F.count("*").alias("n"))
