"""Preference formatting: chosen and rejected conversations as a shared prompt and two masked completions.

Turns are put in order; the longest run of turns with the same role and text at the start of both conversations is
rendered once as the prompt. What follows is rendered for each side, with the ranges of characters that a loss should
count: the contents of assistant turns and their end marks. All of it is DataFrame functions over one array per side.

Cases: a null role or text counts as empty; null turn numbers come first and ties go by role and text; a side without
turns gives an empty completion; equal sides have the whole conversation as prompt and ``differ`` false; a pair with
one side only has an empty prompt; other columns are not carried.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import hex_sha256, table

#: Fixed values of the rendering: before a role, after it, and after the text.
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"
_TURN = "array<struct<turn:bigint,role:string,text:string>>"


def _turns(side: str) -> Column:
    own = F.struct(F.col("turn").cast("bigint").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    return F.sort_array(F.collect_list(F.when(F.col("side") == side, own)))


def _render(turn: Column) -> Column:
    return F.concat(F.lit(OPEN), turn["role"], F.lit(CLOSE), turn["text"], F.lit(END))


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, _render), "")


def _mask(turns: Column) -> Column:
    """Character ranges of assistant contents and their ends in the rendering of the turns."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, turn: Column) -> Column:
        head = acc["at"] + len(OPEN) + F.length(turn["role"]) + len(CLOSE)
        end = head + F.length(turn["text"]) + len(END)
        own = F.array(F.struct(head.alias("start"), end.alias("end")))
        return F.struct(end.alias("at"), F.when(turn["role"] == "assistant", F.concat(acc["spans"], own)).otherwise(acc["spans"]).alias("spans"))

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def format_pairs(df: DataFrame, pair_col: str = "pair_id") -> DataFrame:
    """(pair, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, differ) from rows (pair, side, turn,
    role, text), where side is chosen or rejected."""
    both = df.groupBy(F.col(pair_col).alias("pair")).agg(_turns("chosen").alias("c"), _turns("rejected").alias("r"))
    equal = F.zip_with("c", "r", lambda a, b: F.coalesce((a["role"] == b["role"]) & (a["text"] == b["text"]), F.lit(False)))
    apart = F.array_position(equal, F.lit(False)).cast("int")
    both = both.withColumn("n", F.when(apart > 0, apart - 1).otherwise(F.size("c")))
    rest = lambda c: F.slice(c, F.col("n") + 1, F.greatest(F.size(c) - F.col("n"), F.lit(0)))
    both = both.withColumn("c_rest", rest("c")).withColumn("r_rest", rest("r"))
    return both.select(
        F.col("pair").alias(pair_col), F.col("n").cast("long").alias("n_prompt_turns"), _text(F.slice("c", F.lit(1), F.col("n"))).alias("prompt"),
        _text(F.col("c_rest")).alias("chosen"), _text(F.col("r_rest")).alias("rejected"), _mask(F.col("c_rest")).alias("chosen_mask"), _mask(F.col("r_rest")).alias("rejected_mask"),
        ((F.size("c_rest") > 0) | (F.size("r_rest") > 0)).alias("differ"),
    )


def with_cut_replies(df: DataFrame) -> DataFrame:
    """Pairs from conversations (conv_id, turn, role, text): the conversation itself is chosen, the one whose last
    assistant turns have only the first half of their words is rejected."""
    last = df.where("role = 'assistant'").groupBy(F.col("conv_id").alias("_conv")).agg(F.max("turn").alias("_last"))
    rows = df.select("conv_id", "turn", "role", "text").join(last, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    words = F.split("text", " ")
    half = F.array_join(F.slice(words, F.lit(1), F.floor(F.size(words) / 2).cast("int")), " ")
    cut = F.when((F.col("role") == "assistant") & (F.col("turn") == F.col("_last")), half).otherwise(F.col("text"))
    sides = F.explode(F.array(F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text")), F.struct(F.lit("rejected").alias("side"), cut.alias("text"))))
    return rows.select("conv_id", "turn", "role", sides.alias("s")).select("conv_id", "turn", "role", "s.side", "s.text")


def _spans(mask: str) -> Column:
    return F.array_join(F.transform(mask, lambda x: F.concat_ws(":", x["start"], x["end"])), ",")


def op6_preference(spark, sf_dir: str) -> DataFrame:
    out = format_pairs(with_cut_replies(table(spark, sf_dir, "conversations")), "conv_id")
    return out.select("conv_id", "n_prompt_turns", hex_sha256(F.col("prompt")).alias("prompt_sha256"), hex_sha256(F.col("chosen")).alias("chosen_sha256"), hex_sha256(F.col("rejected")).alias("rejected_sha256"), _spans("chosen_mask").alias("chosen_mask"), _spans("rejected_mask").alias("rejected_mask"), "differ")


OP6_SQL = """
WITH turns AS (
  SELECT conv_id, turn, role, text,
         max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_reply
  FROM conversations
), sides AS (
  SELECT conv_id, turn, role, text AS c,
         CASE WHEN role = 'assistant' AND turn = last_reply
              THEN array_to_string(list_slice(string_split(text, ' '), 1, CAST(floor(len(string_split(text, ' ')) / 2) AS BIGINT)), ' ')
              ELSE text END AS r
  FROM turns
), first_apart AS (
  SELECT *, min(CASE WHEN c <> r THEN turn END) OVER (PARTITION BY conv_id) AS apart FROM sides
), placed AS (
  SELECT *, CASE WHEN apart IS NULL OR turn < apart THEN 1 ELSE 0 END AS shared,
         '<|' || role || '|>' || chr(10) || c || '<|end|>' || chr(10) AS ct,
         '<|' || role || '|>' || chr(10) || r || '<|end|>' || chr(10) AS rt
  FROM first_apart
), ends AS (
  SELECT *, sum(CASE WHEN shared = 0 THEN length(ct) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS ce,
            sum(CASE WHEN shared = 0 THEN length(rt) ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS re
  FROM placed
)
SELECT conv_id, CAST(sum(shared) AS BIGINT) AS n_prompt_turns,
       sha256(coalesce(string_agg(ct, '' ORDER BY turn) FILTER (shared = 1), '')) AS prompt_sha256,
       sha256(coalesce(string_agg(ct, '' ORDER BY turn) FILTER (shared = 0), '')) AS chosen_sha256,
       sha256(coalesce(string_agg(rt, '' ORDER BY turn) FILTER (shared = 0), '')) AS rejected_sha256,
       coalesce(string_agg(CAST(ce - length(c) - 8 AS VARCHAR) || ':' || CAST(ce AS VARCHAR), ',' ORDER BY turn) FILTER (shared = 0 AND role = 'assistant'), '') AS chosen_mask,
       coalesce(string_agg(CAST(re - length(r) - 8 AS VARCHAR) || ':' || CAST(re AS VARCHAR), ',' ORDER BY turn) FILTER (shared = 0 AND role = 'assistant'), '') AS rejected_mask,
       min(shared) = 0 AS differ
FROM ends GROUP BY conv_id
"""
