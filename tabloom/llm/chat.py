"""Chat formatting: prefix-target expansion.

Every turn becomes a segment `### role:\\n<text></turn>\\n`. Every assistant turn is an example of
its own: its context is all that stands before its reply, and only the reply is trained on. The
contexts of one conversation are prefixes of one text, so the text is stored once, as segments,
and an example is a pair of ranges in it: linear in the conversation where written-out contexts
would be quadratic. `texts` writes the contexts out.

A backslash is put behind a backslash, behind a # that two more follow, and behind a < that
/turn> follows. No control string is left inside a text, and dropping each backslash that
precedes a character gives the text back.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.llm.common import shared_folder

TRAINED = "assistant"
#: Turn numbers per piece of a conversation; pieces are numbered apart, so that no task needs all of one.
PIECE = 256
#: A conversation that holds the template's own control strings.
TRAP = [(-7, turn, role, r"\### Assistant: </turn> ok") for turn, role in enumerate(("user", TRAINED))]


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\|#(?=##)|<(?=/turn>)", r"$0\\")


def escape_role(role: Column) -> Column:
    return F.regexp_replace(role, r"[\\:\n#<]", r"\\$0")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, place, start, segment, reply_start, reply_end) for every turn, in order.

    `place` counts the turns of a conversation from 1, by turn, then role, then text; null turns
    come first. Offsets are code points in the conversation's whole formatted text; the reply's
    are null unless the role is TRAINED. Null roles and texts count as empty; repeated rows are
    repeated turns; a null conversation id is a conversation. Other columns are ignored.
    """
    body = escape(F.coalesce(F.col(text_col).cast("string"), F.lit("")))
    role = F.coalesce(F.col(role_col).cast("string"), F.lit(""))
    head = F.concat(F.lit("### "), escape_role(role), F.lit(":\n"))
    rows = turns.select(
        F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), role.alias("role"), F.length(head).alias("head_chars"), F.length(body).alias("body_chars"),
        F.concat(head, body, F.lit("</turn>\n")).alias("segment"), F.coalesce(F.floor(F.col(turn_col) / PIECE), F.lit(-(1 << 60))).alias("piece"),
    )
    inside = Window.partitionBy("conv_id", "piece").orderBy("turn", "role", "segment").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    chars = F.length("segment")
    numbered = rows.withColumn("within", F.count(F.lit(1)).over(inside)).withColumn("offset", F.sum(chars).over(inside) - chars)
    pieces = rows.groupBy("conv_id", "piece").agg(F.count(F.lit(1)).alias("n"), F.sum(chars).alias("c"))
    before = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(F.col("conv_id").alias("_conv"), F.col("piece").alias("_piece"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("turns_before"), F.coalesce(F.sum("c").over(before), F.lit(0)).alias("chars_before"))
    placed = numbered.join(pieces, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("piece") == F.col("_piece")))
    start = F.col("chars_before") + F.col("offset")
    trained = F.col("role") == TRAINED
    reply = start + F.col("head_chars")
    return placed.select("conv_id", (F.col("turns_before") + F.col("within")).alias("place"), start.alias("start"), "segment", F.when(trained, reply).alias("reply_start"), F.when(trained, reply + F.col("body_chars")).alias("reply_end"))


def write(turns: DataFrame, folder: str) -> None:
    """Write the formatted conversations (`segments`) and their examples under `folder`.

    `examples` has a row per TRAINED turn: its place, its context [0, reply_start) and its reply
    [reply_start, reply_end) in the conversation's text, which is all that a loss may look at.
    """
    segments(turns).write.parquet(f"{folder}/segments")
    stored = turns.sparkSession.read.parquet(f"{folder}/segments")
    examples = stored.where("reply_start is not null")
    examples.select("conv_id", "place", F.lit(0).cast("long").alias("context_start"), F.col("reply_start").alias("context_end"), F.col("reply_start").alias("loss_start"), F.col("reply_end").alias("loss_end")).write.parquet(f"{folder}/examples")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, place, context, reply): every example with its context written out, still escaped."""
    stored = spark.read.parquet(f"{folder}/segments")
    so_far = Window.partitionBy("conv_id").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    held = stored.withColumn("context", F.array_join(F.collect_list("segment").over(so_far), "")).where("reply_start is not null")
    at = F.col("reply_start") - F.col("start")
    head = F.substring(F.col("segment"), F.lit(1), at.cast("int"))
    return held.select("conv_id", "place", F.concat("context", head).alias("context"), F.substring(F.col("segment"), (at + 1).cast("int"), (F.col("reply_end") - F.col("reply_start")).cast("int")).alias("reply"))


def read_turns(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, place, role, text, chars): the turns as they were, parsed from the segments."""
    parts = r"(?s)^### ((?:[^\\:\n]|\\.)*+):\n(.*)</turn>\n$"
    stored = spark.read.parquet(f"{folder}/segments")
    return stored.select("conv_id", "place", unescape(F.regexp_extract("segment", parts, 1)).alias("role"), unescape(F.regexp_extract("segment", parts, 2)).alias("text"), F.length("segment").cast("long").alias("chars"))


def read_losses(spark: SparkSession, folder: str) -> DataFrame:
    """(conv_id, place, text): what each example's mask covers, cut out by its offsets and unescaped."""
    examples = spark.read.parquet(f"{folder}/examples").select(F.col("conv_id").alias("_conv"), F.col("place").alias("_place"), "loss_start", "loss_end")
    stored = spark.read.parquet(f"{folder}/segments").select("conv_id", "place", "start", "segment")
    both = stored.join(examples, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("place") == F.col("_place")))
    cut = F.substring(F.col("segment"), (F.col("loss_start") - F.col("start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int"))
    return both.select("conv_id", "place", unescape(cut).alias("text"))


def _in_order(*text: Column) -> Column:
    """All of a group's texts by place. The digests asked for cover whole conversations, so a group is one."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", F.concat(*text).alias("s")))), lambda x: x["s"]), "")


def op8_prefix_targets(spark, sf_dir: str) -> DataFrame:
    """Digests of every conversation, read back from the formatted output."""
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    folder = f"{shared_folder(spark)}/llm/chat-{uuid.uuid4().hex}"
    write(turns.unionByName(spark.createDataFrame(TRAP, "conv_id long, turn long, role string, text string")), folder)
    newline = F.lit("\n")
    told = read_turns(spark, folder).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sha2(_in_order(F.col("role"), newline, F.col("text"), newline), 256).alias("turns_sha256"), F.sum("chars").alias("formatted_chars"))
    losses = read_losses(spark, folder).groupBy(F.col("conv_id").alias("_conv")).agg(F.sum(F.length("text")).alias("loss_chars"), F.sha2(_in_order(F.col("text")), 256).alias("loss_sha256"))
    both = told.join(losses, F.col("conv_id").eqNullSafe(F.col("_conv")), "left")
    return both.select("conv_id", "n_turns", "turns_sha256", F.coalesce("loss_chars", F.lit(0)).cast("long").alias("loss_chars"), F.coalesce("loss_sha256", F.sha2(F.lit(""), 256)).alias("loss_sha256"), "formatted_chars")


_TRAP_SQL = " UNION ALL ".join(f"SELECT {c}, {t}, '{r}', '{x}'" for c, t, r, x in TRAP)
OP8_SQL = rf"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL {_TRAP_SQL}),
sized AS (
  SELECT *, 4 + length(role) + length(regexp_extract_all(role, '[\\:\n#<]')) + 2 + 8 + length(text) + length(text) - length(replace(text, '\', ''))
    + (length(text) - length(replace(text, '</turn>', ''))) // 7
    + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{{3,}}'), lambda x: length(x) - 2)), 0) AS chars FROM said)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(CASE WHEN role = '{TRAINED}' THEN length(text) END), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = '{TRAINED}' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
