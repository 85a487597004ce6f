"""Chat formatting: multi-party perspective rotation, in DataFrame functions only.

For every participant of a conversation the dialogue is rendered with that
speaker as the assistant and the others as named users. Each turn becomes one
segment a perspective; the segments of a perspective, joined in order, are
the rendered text, and the mask tells which characters are trained on. The
text is never gathered into one row, so a conversation may be of any length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Roles that are no participants: shown in every perspective, never trained on.
SYSTEM_ROLES = ("system",)
#: Turns in a block of the two-level running sum.
BLOCK_TURNS = 256

START, END = "<|im_start|>", "<|im_end|>\n"


def _escaped(text: Column) -> Column:
    """Markers in a text with a backslash more than they have, so that none forges a turn; undone by taking one away."""
    return F.regexp_replace(text, r"<(\\*)\|im_(start|end)\|>", r"<$1\\|im_$2|>")


def rotate(conversations: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """conv_id, perspective, turn, role, name, segment, content_start, content_chars, masked, start.

    A segment is `<|im_start|>assistant\\n…`, `<|im_start|>user name=X\\n…` or
    `<|im_start|>system\\n…`, each ended by `<|im_end|>\\n`. start is the place
    of the segment in the rendered text in code points, content_start that of
    the content; masked: not trained on (all but the perspective's own turns).
    Markers in texts and names are escaped by a backslash (`<\\|im_end|>`; one
    more where there are some), line feeds and carriage returns in shown names
    are blanks, so no text forges a turn; name is the role as it is.
    Null roles count as the participant `unknown`, null texts as empty, null
    turns come first; a null conv_id is a conversation of its own. Turns with
    equal numbers are ordered by role and text; equal rows are segments each.
    A conversation of system turns alone has no perspective and no rows.
    Other columns are ignored.
    """
    speaker = F.coalesce(F.col("role").cast("string"), F.lit("unknown"))
    turns = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), speaker.alias("speaker"), _escaped(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("content")
    )
    is_system = F.col("speaker").isin(*SYSTEM_ROLES)
    people = turns.where(~is_system).groupBy("conv_id", "speaker").agg(F.lit(1).alias("one")).select(F.col("conv_id").alias("c"), F.col("speaker").alias("perspective"))
    both = turns.join(people, F.col("conv_id").eqNullSafe(F.col("c")), "inner").drop("c")
    role = F.when(is_system, F.lit("system")).when(F.col("speaker") == F.col("perspective"), F.lit("assistant")).otherwise(F.lit("user"))
    name = F.when(role == "user", F.col("speaker"))
    head = F.concat(F.lit(START), role, F.when(role == "user", F.concat(F.lit(" name="), F.regexp_replace(_escaped(F.col("speaker")), "[\n\r]", " "))).otherwise(F.lit("")), F.lit("\n"))
    shown = both.select(
        "conv_id", "perspective", "turn", role.alias("role"), name.alias("name"), F.concat(head, F.col("content"), F.lit(END)).alias("segment"), F.length(head).cast("bigint").alias("head_chars"), F.length("content").cast("bigint").alias("content_chars"), "speaker", "content"
    ).withColumn("chars", F.length("segment").cast("bigint"))

    # Running sums at two levels: within blocks of turns, and over one row a block.
    block = F.floor(F.col("turn") / F.lit(block_turns)).cast("bigint")
    key = ["conv_id", "perspective", "block"]
    shown = shown.withColumn("block", block)
    inside = Window.partitionBy(*key).orderBy(F.col("turn").asc_nulls_first(), "speaker", "content").rowsBetween(Window.unboundedPreceding, -1)
    shown = shown.withColumn("inside", F.coalesce(F.sum("chars").over(inside), F.lit(0)))
    sums = both.withColumn("block", block).select("conv_id", "perspective", "block", (F.length(head) + F.length("content") + F.lit(len(END))).cast("bigint").alias("chars"))
    sums = sums.groupBy(*key).agg(F.sum("chars").alias("block_chars"))
    over = Window.partitionBy("conv_id", "perspective").orderBy(F.col("block").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("conv_id").alias("c"), F.col("perspective").alias("p"), F.col("block").alias("b"), F.coalesce(F.sum("block_chars").over(over), F.lit(0)).alias("before"))
    whole = shown.join(sums, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("perspective") == F.col("p")) & F.col("block").eqNullSafe(F.col("b")), "inner")
    start = F.col("before") + F.col("inside")
    return whole.select(
        "conv_id", "perspective", "turn", "role", "name", "segment", (start + F.col("head_chars")).alias("content_start"), "content_chars", (F.col("role") != "assistant").alias("masked"), start.alias("start")
    )


ROTATE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS speaker, regexp_replace(coalesce(text, ''), '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g') AS content FROM conversations
), p AS (
  SELECT DISTINCT conv_id AS c, speaker AS perspective FROM t WHERE speaker <> 'system'
), b AS (
  SELECT conv_id, perspective, turn, speaker, content,
         CASE WHEN speaker = 'system' THEN 'system' WHEN speaker = perspective THEN 'assistant' ELSE 'user' END AS role
  FROM t JOIN p ON conv_id IS NOT DISTINCT FROM c
), s AS (
  SELECT *, '<|im_start|>' || role || CASE WHEN role = 'user' THEN ' name=' || translate(regexp_replace(speaker, '<(\\*)\|im_(start|end)\|>', '<\1\\|im_\2|>', 'g'), chr(10) || chr(13), '  ') ELSE '' END || chr(10) AS head FROM b
), r AS (
  SELECT *, head || content || '<|im_end|>' || chr(10) AS segment FROM s
), o AS (
  SELECT *, coalesce(sum(length(segment)) OVER (PARTITION BY conv_id, perspective ORDER BY turn NULLS FIRST, speaker, content
         ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start FROM r
)
SELECT conv_id, perspective, turn, role, CASE WHEN role = 'user' THEN speaker END AS name, segment,
       start + length(head) AS content_start, length(content) AS content_chars, role <> 'assistant' AS masked, start
FROM o
"""
