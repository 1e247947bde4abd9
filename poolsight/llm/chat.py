"""Multi-party perspective rotation of conversations, on DataFrame functions alone.

For every participant of a conversation the dialogue is rendered once with that speaker as the
assistant and all others as named users. The result has a row for each (conversation, perspective,
turn) with its rendered piece, the piece's place in the whole rendering and the trained span, so
no dialogue is ever gathered into one value or task: places come from sums per block of turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from poolsight.llm.catalog import query, table

#: Turn numbers to a block.
BLOCK = 256
START, END = "<|im_start|>", "<|im_end|>"


def plain(text: Column) -> Column:
    """Text in which no marker of the format can be read."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit("<|im_"), F.lit("<| im_"))


def rotate_perspectives(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """A row for each turn of each conversation seen from each of its participants.

    Columns: conv_id, perspective, turn, speaker, chat_role, rendered, starts_at, ends_at, trained, mask_begin,
    mask_end. Offsets count characters in the whole rendering. The mask covers the words and the
    end marker of turns spoken by the perspective, and is null elsewhere. `system` takes no part:
    its turns stay system turns for all. A null role speaks as the user `unknown` and is no
    perspective either, so a conversation without any other speaker gives no rows. Null text is
    empty; a null conversation is one conversation; turns are ordered by (turn, role, text), null
    first; repeated rows stay repeated turns. Markers inside texts are broken up. Other columns are
    not carried over.
    """
    name = F.col(role).cast("string")
    lines = turns.select(
        F.col(conv).alias("conv_id"),
        F.col(turn).alias("turn"),
        F.when(name.isNull(), "unknown").otherwise(plain(name)).alias("speaker"),
        name.isNull().alias("unnamed"),
        plain(F.col(text)).alias("words"),
    )
    heard = lines.filter(~F.col("unnamed") & (F.col("speaker") != "system"))
    people = heard.select(F.col("conv_id").alias("its_conv"), F.col("speaker").alias("perspective")).distinct()
    seen = lines.join(people, F.col("conv_id").eqNullSafe(F.col("its_conv"))).drop("its_conv")
    own = (F.col("speaker") == F.col("perspective")) & ~F.col("unnamed")
    system = (F.col("speaker") == "system") & ~F.col("unnamed")
    head = (
        F.when(own, F.lit(f"{START}assistant\n"))
        .when(system, F.lit(f"{START}system\n"))
        .otherwise(F.concat(F.lit(f"{START}user name="), F.col("speaker"), F.lit("\n")))
    )
    seen = seen.withColumns(
        {
            "trained": own,
            "chat_role": F.when(own, "assistant").when(system, "system").otherwise("user"),
            "rendered": F.concat(head, F.col("words"), F.lit(f"{END}\n")),
            "head_length": F.length(head).cast("long"),
            "block": F.floor(F.col("turn") / BLOCK),
        }
    ).withColumn("size", F.length("rendered").cast("long"))
    group = ["conv_id", "perspective"]
    blocks = seen.groupBy(*group, "block").agg(F.sum("size").alias("block_size"))
    before = Window.partitionBy(*group).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        F.col("conv_id").alias("b_conv"),
        F.col("perspective").alias("b_perspective"),
        F.col("block").alias("b_block"),
        F.coalesce(F.sum("block_size").over(before), F.lit(0)).alias("carry"),
    )
    inside = Window.partitionBy(*group, "block").orderBy("turn", "unnamed", "speaker", "words")
    placed = seen.withColumn("to", F.sum("size").over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    whole = placed.join(
        blocks,
        F.col("conv_id").eqNullSafe(F.col("b_conv"))
        & (F.col("perspective") == F.col("b_perspective"))
        & F.col("block").eqNullSafe(F.col("b_block")),
    )
    end = F.col("carry") + F.col("to")
    begin = end - F.col("size")
    return whole.select(
        "conv_id",
        "perspective",
        "turn",
        "speaker",
        "chat_role",
        "rendered",
        begin.alias("starts_at"),
        end.alias("ends_at"),
        "trained",
        F.when(F.col("trained"), begin + F.col("head_length")).alias("mask_begin"),
        F.when(F.col("trained"), end - 1).alias("mask_end"),
    )


SQL = """
WITH lines AS (
  SELECT conv_id, turn, coalesce(replace(role, '<|im_', '<| im_'), 'unknown') AS speaker, role IS NULL AS unnamed,
    replace(coalesce(text, ''), '<|im_', '<| im_') AS words FROM conversations),
people AS (SELECT DISTINCT conv_id, speaker AS perspective FROM lines WHERE NOT unnamed AND speaker <> 'system'),
seen AS (
  SELECT l.*, p.perspective, speaker = perspective AND NOT unnamed AS trained,
    CASE WHEN speaker = perspective AND NOT unnamed THEN 'assistant'
         WHEN speaker = 'system' AND NOT unnamed THEN 'system' ELSE 'user' END AS chat_role
  FROM lines l JOIN people p ON l.conv_id IS NOT DISTINCT FROM p.conv_id),
pieces AS (
  SELECT *, '<|im_start|>' || chat_role || CASE chat_role WHEN 'user' THEN ' name=' || speaker ELSE '' END || chr(10) AS head
  FROM seen),
placed AS (
  SELECT *, head || words || '<|im_end|>' || chr(10) AS rendered,
    sum(length(head || words || '<|im_end|>' || chr(10))) OVER (PARTITION BY conv_id, perspective
      ORDER BY turn NULLS FIRST, unnamed, speaker, words ROWS UNBOUNDED PRECEDING)::BIGINT AS upto FROM pieces)
SELECT conv_id, perspective, turn, speaker, chat_role, rendered, upto - length(rendered) AS starts_at, upto AS ends_at, trained,
  CASE WHEN trained THEN upto - length(rendered) + length(head) END AS mask_begin,
  CASE WHEN trained THEN upto - 1 END AS mask_end
FROM placed
"""


@query("op5_perspective_rotation", SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))
