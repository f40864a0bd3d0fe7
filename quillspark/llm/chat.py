"""Chat formatting with rotating perspectives.

Every speaker of a conversation but the system takes a turn as the assistant:
the dialogue is rendered with that speaker's turns as the assistant's, all
others as those of named users, system turns as such. The mask covers what the
assistant is to learn: its texts and the marks that end them.

A text that holds the format's marks forges no turn: a backslash goes between
``<`` and ``|im_``, one more where some stand there already, so that taking one
away gives the text back. Names lose their line ends and are treated alike.

A dialogue is one row a perspective. Only one of more than ``LIMIT`` bytes of
text, which no task should gather as a whole, is rendered in parts of ``TURNS``
turn numbers; parts after the first begin with the dialogue's first system
turns again, ``lead`` code points that aren't counted as its turns, and behind
those the texts of all parts are the whole dialogue.

Defined results: exact repeats of a row count once; turns are in order of turn
(nulls as 0), role and text; a null role is the speaker ``unknown``, a null
text is empty; rows without conv_id are left out, as are conversations of
system turns alone; other columns are ignored; spans are in code points; an
empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.llm.common import table

LIMIT, TURNS = 4_000_000, 64
# Marks of the chat format.
BEGIN, END = "<|im_start|>", "<|im_end|>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|im_", r"<$1\\|im_")


def rotate(conversations: DataFrame, limit: int = LIMIT, turns: int = TURNS) -> DataFrame:
    """One row a conversation, perspective and part: text, lead, spans (begin, end) of the mask, and n_turns."""
    rows = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.distinct()
    large = rows.groupBy("conv_id").agg(F.sum(F.octet_length("text")).alias("size"), F.min("turn").alias("opening")).where(F.col("size") > limit).select("conv_id", "opening")
    placed = rows.join(large, "conv_id", "left").withColumn("part", F.when(F.col("opening").isNotNull(), F.floor(F.col("turn") / turns) - F.floor(F.col("opening") / turns)).otherwise(0).cast("long"))
    later = placed.where("part > 0").select("conv_id", "part").distinct()
    leads = placed.where("opening = turn AND role = 'system'").select("conv_id", "turn", "role", "text").join(later, "conv_id")
    told_rows = placed.select("conv_id", "part", F.lit(True).alias("said"), "turn", "role", "text").unionByName(leads.select("conv_id", "part", F.lit(False).alias("said"), "turn", "role", "text"))
    parts = told_rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("said", "turn", "role", "text"))).alias("turns"))
    speakers = rows.where(F.col("role") != "system").select("conv_id", F.col("role").alias("perspective")).distinct()
    own = lambda x: x["role"] == F.col("perspective")
    name = lambda x: escaped(F.regexp_replace(x["role"], r"[\r\n]", " "))
    head = lambda x: F.concat(F.lit(BEGIN), F.when(own(x), "assistant").when(x["role"] == "system", "system").otherwise(F.concat(F.lit("user name="), name(x))), F.lit("\n"))
    told = F.transform("turns", lambda x: F.struct(head(x).alias("head"), F.concat(escaped(x["text"]), F.lit(END)).alias("body"), own(x).alias("own"), x["said"].alias("said")))
    long_ = lambda x: F.char_length(x["head"]) + F.char_length(x["body"]) + 1
    step = lambda state, x: F.struct(
        (state["at"] + long_(x)).cast("long").alias("at"),
        (state["lead"] + F.when(x["said"], 0).otherwise(long_(x))).cast("long").alias("lead"),
        F.when(x["own"], F.array_append(state["spans"], F.struct((state["at"] + F.char_length(x["head"])).cast("long").alias("begin"), (state["at"] + long_(x) - 1).cast("long").alias("end")))).otherwise(state["spans"]).alias("spans"),
    )
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("lead"), F.array().cast("array<struct<begin:long,end:long>>").alias("spans"))
    return (
        parts.join(speakers, "conv_id")
        .withColumn("told", told)
        .withColumn("sum", F.aggregate("told", zero, step))
        .select(
            "conv_id",
            "perspective",
            "part",
            F.array_join(F.transform("told", lambda x: F.concat(x["head"], x["body"], F.lit("\n"))), "").alias("text"),
            F.col("sum.lead").alias("lead"),
            F.col("sum.spans").alias("spans"),
            F.size(F.filter("turns", lambda x: x["said"])).cast("long").alias("n_turns"),
        )
    )


def op1_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation from every speaker's perspective; the mask's spans as text, begin-end."""
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["begin"].cast("string"), s["end"].cast("string"))), ",")
    return rotate(table(spark, sf_dir, "conversations")).select("conv_id", "perspective", "part", "text", "lead", shown.alias("mask"), "n_turns")


OP1_SQL = r"""
WITH rows_ AS (
  SELECT DISTINCT CAST(conv_id AS BIGINT) AS conv_id, CAST(COALESCE(turn, 0) AS BIGINT) AS turn, COALESCE(role, 'unknown') AS role, COALESCE(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
large AS (SELECT conv_id, MIN(turn) AS opening FROM rows_ GROUP BY conv_id HAVING SUM(strlen(text)) > 4000000),
placed AS (
  SELECT rows_.*, opening, CAST(CASE WHEN opening IS NULL THEN 0 ELSE FLOOR(turn / 64.0) - FLOOR(opening / 64.0) END AS BIGINT) AS part
  FROM rows_ LEFT JOIN large USING (conv_id)),
said AS (
  SELECT conv_id, part, TRUE AS said, turn, role, text FROM placed
  UNION ALL
  SELECT p.conv_id, l.part, FALSE, p.turn, p.role, p.text
  FROM placed p JOIN (SELECT DISTINCT conv_id, part FROM placed WHERE part > 0) l USING (conv_id) WHERE p.opening = p.turn AND p.role = 'system'),
speakers AS (SELECT DISTINCT conv_id, role AS perspective FROM rows_ WHERE role <> 'system'),
told AS (
  SELECT conv_id, perspective, part, said, turn, role, text,
         '<|im_start|>' || CASE WHEN role = perspective THEN 'assistant' WHEN role = 'system' THEN 'system'
           ELSE 'user name=' || regexp_replace(regexp_replace(role, '[\r\n]', ' ', 'g'), '<(\\*)\|im_', '<\1\\|im_', 'g') END || chr(10) AS head,
         regexp_replace(text, '<(\\*)\|im_', '<\1\\|im_', 'g') || '<|im_end|>' AS body
  FROM said JOIN speakers USING (conv_id)),
placed_told AS (
  SELECT *, SUM(length(head) + length(body) + 1) OVER (PARTITION BY conv_id, perspective, part ORDER BY said, turn, role, text) - length(body) - 1 AS begins
  FROM told)
SELECT conv_id, perspective, part, string_agg(head || body || chr(10), '' ORDER BY said, turn, role, text) AS text,
       CAST(SUM(CASE WHEN said THEN 0 ELSE length(head) + length(body) + 1 END) AS BIGINT) AS lead,
       COALESCE(string_agg(CASE WHEN role = perspective THEN CAST(CAST(begins AS BIGINT) AS VARCHAR) || '-' || CAST(CAST(begins + length(body) AS BIGINT) AS VARCHAR) END, ',' ORDER BY said, turn, role, text), '') AS mask,
       CAST(SUM(CASE WHEN said THEN 1 ELSE 0 END) AS BIGINT) AS n_turns
FROM placed_told GROUP BY conv_id, perspective, part
"""
