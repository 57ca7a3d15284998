"""Candidates for a reader, and answers out of token predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.layout import materialize


def expand_candidates(
    hits: DataFrame, golds: DataFrame, max_rank: int, add_gold: bool = True, add_negatives: bool = True
) -> DataFrame:
    """One row per question and candidate table.

    hits (example_id, table_id, rank, score); golds (example_id, table_id). Candidates are
    the first max_rank hits, with the gold tables added on request. class_index is 1
    for gold tables; negatives can be left out afterwards, which keeps the numbering
    by sorted table id. rank and score are those of the full hit list.
    """
    # Written once: candidates and their scores would each search for the hits again.
    hits = materialize(hits.select("example_id", "table_id", "rank", "score"))
    first = hits.where(F.col("rank") <= max_rank).select("example_id", "table_id")
    gold = golds.select("example_id", "table_id").distinct()
    chosen = (first.unionByName(gold) if add_gold else first).distinct()
    place = Window.partitionBy("example_id").orderBy("table_id")
    marked = (
        chosen.withColumn("table_index", F.row_number().over(place) - 1)
        .join(gold.withColumn("_gold", F.lit(1)), ["example_id", "table_id"], "left")
        .join(hits, ["example_id", "table_id"], "left")
        .withColumn("class_index", F.coalesce("_gold", F.lit(0)))
    )
    kept = marked if add_negatives else marked.where("class_index = 1")
    interaction = F.concat_ws("-", F.col("example_id").cast("string"), F.col("table_index").cast("string"))
    return kept.select(
        "example_id",
        interaction.alias("interaction_id"),
        F.concat(interaction, F.lit("_0")).alias("question_id"),
        "table_id",
        "class_index",
        "rank",
        "score",
    )


def reader_examples(candidates: DataFrame, answers: DataFrame, cells: DataFrame) -> DataFrame:
    """Candidates with their answer groups ordered by where the table holds them.

    answers (example_id, alt_index, answer_ix, text). The first group becomes the main
    answer, the rest alternatives; all candidates are valid examples.
    """
    from tabloom.operators.align import order_groups

    pairs = candidates.select(F.col("example_id").alias("question_id"), "table_id")
    asked = answers.withColumnRenamed("example_id", "question_id")
    placed = order_groups(pairs, asked, cells)
    texts = asked.groupBy("question_id", "alt_index").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("answer_ix", "text"))), lambda e: e["text"]).alias("texts")
    )
    ordered = (
        placed.join(texts, ["question_id", "alt_index"])
        .groupBy("question_id", "table_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("place", "texts"))).alias("groups"),
            F.bool_or("all_found").alias("answer_in_table"),
        )
        .withColumnRenamed("question_id", "example_id")
    )
    groups = F.transform("groups", lambda g: g["texts"])
    return candidates.join(ordered, ["example_id", "table_id"], "left").select(
        *candidates.columns,
        F.get(groups, F.lit(0)).alias("answer_texts"),
        F.slice(groups, 2, 1 << 20).alias("alternatives"),
        F.coalesce("answer_in_table", F.lit(False)).alias("answer_in_table"),
    )


def cell_means(tokens: DataFrame) -> DataFrame:
    """Mean token probability per cell; tokens (question_id, ix, row, col, prob)."""
    return tokens.groupBy("question_id", "row", "col").agg(F.avg("prob").alias("prob"))


def cells_over(tokens: DataFrame, threshold: float) -> DataFrame:
    """Cells whose mean token probability exceeds the threshold, column by column."""
    ordered = F.sort_array(F.collect_list(F.struct("col", "row")))
    return (
        cell_means(tokens)
        .where(F.col("prob") > threshold)
        .groupBy("question_id")
        .agg(F.transform(ordered, lambda e: F.struct(e["row"].alias("row"), e["col"].alias("col"))).alias("coords"))
    )


def token_islands(tokens: DataFrame, threshold: float, chunk: int = 4096) -> DataFrame:
    """Runs of consecutive tokens above a threshold, with the geometric mean as score.

    Runs are formed within chunks of positions, so one very long sequence spreads
    over many tasks; then the pieces that touch at chunk borders are joined. Only
    those pieces, at most two per chunk, meet in one group per question.
    Returns (question_id, begin, end, row, col, begin_in_cell, end_in_cell, score);
    the cell is that of the first token and end is exclusive.
    """
    over = tokens.where(F.col("prob") > threshold).withColumn("_chunk", F.floor(F.col("ix") / chunk))
    inside = Window.partitionBy("question_id", "_chunk").orderBy("ix")
    pieces = (
        over.withColumn("_run", F.col("ix") - F.row_number().over(inside))
        .groupBy("question_id", "_chunk", "_run")
        .agg(
            F.min("ix").alias("begin"),
            (F.max("ix") + 1).alias("end"),
            F.sum(F.ln("prob")).alias("logs"),
            F.count("*").alias("n"),
            F.min_by(F.struct("row", "col"), "ix").alias("cell"),
        )
        .drop("_run")
    )
    at_border = (F.col("begin") == F.col("_chunk") * chunk) | (F.col("end") == (F.col("_chunk") + 1) * chunk)
    whole = pieces.where(~at_border).drop("_chunk")
    order = Window.partitionBy("question_id").orderBy("begin")
    joined = (
        pieces.where(at_border)
        .withColumn("_new", F.coalesce((F.lag("end").over(order) != F.col("begin")).cast("int"), F.lit(1)))
        .withColumn("_run", F.sum("_new").over(order))
        .groupBy("question_id", "_run")
        .agg(
            F.min("begin").alias("begin"),
            F.max("end").alias("end"),
            F.sum("logs").alias("logs"),
            F.sum("n").alias("n"),
            F.min_by("cell", "begin").alias("cell"),
        )
        .drop("_run")
    )
    runs = whole.unionByName(joined).select(
        "question_id", "begin", "end", "cell.row", "cell.col", F.exp(F.col("logs") / F.col("n")).alias("score")
    )
    starts = tokens.groupBy("question_id", "row", "col").agg(F.min("ix").alias("_start"))
    return runs.join(starts, ["question_id", "row", "col"]).select(
        "question_id",
        "begin",
        "end",
        "row",
        "col",
        (F.col("begin") - F.col("_start")).alias("begin_in_cell"),
        (F.col("end") - F.col("_start")).alias("end_in_cell"),
        "score",
    )


def best_span(spans: DataFrame) -> DataFrame:
    """Span with the largest logit per question; ties go to the larger span."""
    best = spans.groupBy("question_id").agg(F.max(F.struct("logit", "begin", "end")).alias("b"))
    return best.select("question_id", "b.begin", "b.end", "b.logit")


def best_candidate(candidates: DataFrame, key: str, score: str, tie: str) -> DataFrame:
    """Row with the largest score per key; ties go to the smaller tie column."""
    rest = [c for c in candidates.columns if c != key]
    best = candidates.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), -F.col(tie))).alias("b"))
    return best.select(key, "b.*")


def previous_answers(questions: DataFrame, columns_only: bool = False) -> DataFrame:
    """Gold coordinates of the previous question of the same sequence.

    questions (sequence_id, position, coords array<struct<row,col>>).
    """
    order = Window.partitionBy("sequence_id").orderBy("position")
    value = F.lag("coords").over(order)
    if columns_only:
        value = F.array_sort(F.array_distinct(F.transform(value, lambda c: c["col"])))
    return questions.withColumn("previous", value)


def running_context(questions: DataFrame, text: str = "text") -> DataFrame:
    """The question text preceded by all earlier ones of its sequence."""
    so_far = Window.partitionBy("sequence_id").orderBy("position").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return questions.withColumn("context", F.array_join(F.collect_list(text).over(so_far), " "))


def segment_rollup(tokens: DataFrame) -> DataFrame:
    """Token scores rolled up to cells and columns.

    (question_id, col, row, level, mean, total, low, high); level is 'cell', 'column' or 'all'.
    Column figures are taken over the cell means, as cells are scored before columns.
    """
    cells = tokens.groupBy("question_id", "col", "row").agg(F.avg("prob").alias("m"))
    level = F.when(F.grouping("row") == 0, "cell").when(F.grouping("col") == 0, "column").otherwise("all")
    sets = [["question_id", "col", "row"], ["question_id", "col"], ["question_id"]]
    return cells.groupingSets(sets, "question_id", "col", "row").agg(
        level.alias("level"), F.avg("m").alias("mean"), F.sum("m").alias("total"), F.min("m").alias("low"), F.max("m").alias("high")
    )
