"""Hard negatives: retrieved tables that do not hold the answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.align import answerable
from tabloom.operators.layout import materialize
from tabloom.operators.ranking import first_wins, top_k

FAKE_TABLE = "FAKE"


def neighbours_with_tables(neighbours: DataFrame, tables: DataFrame) -> DataFrame:
    """Neighbours ⋈ tables, first table of an id; a neighbour without a table fails the query."""
    unique = first_wins(tables, ["table_id"], [F.col("position")]) if "position" in tables.columns else tables.dropDuplicates(["table_id"])
    joined = neighbours.join(unique.withColumn("_found", F.lit(True)), "table_id", "left")
    missing = F.raise_error(F.concat(F.lit("table not found: "), F.col("table_id").cast("string"))).cast("boolean")
    return joined.withColumn("_found", F.when(F.col("_found"), F.lit(True)).otherwise(missing)).where("_found").drop("_found")


def mine(questions: DataFrame, neighbours: DataFrame, answers: DataFrame, cells: DataFrame, n: int | None) -> DataFrame:
    """First n retrieved tables by rank that are neither gold nor hold all answers.

    questions (question_id, table_id) with the gold table; neighbours (question_id,
    table_id, rank, score) with negated scores, as neighbour files store them.
    Question ids are compared after '-' becomes '_'. A question left without
    negatives gets one blank table. Returns (question_id, table_id, type, rank, score).
    """

    def same_id(df: DataFrame) -> DataFrame:
        plain = F.translate(F.col("question_id").cast("string"), "-", "_")
        return df.withColumn("question_id", plain)

    questions, neighbours, answers = same_id(questions), same_id(neighbours), same_id(answers)
    listed = neighbours.join(questions.select("question_id"), "question_id", "left_semi")
    distinct = first_wins(listed, ["question_id", "table_id"], [F.col("rank")])
    # Written once: three branches follow, and each would search for the neighbours again.
    wrong = materialize(distinct.join(questions, ["question_id", "table_id"], "left_anti"))
    holding = answerable(wrong, answers, cells)
    negatives = wrong.join(holding, ["question_id", "table_id"], "left_anti")
    if n is not None:
        negatives = top_k(negatives, ["question_id"], [F.col("rank"), F.col("table_id")], n, "_place").drop("_place")
    kept = questions.select("question_id").join(negatives, "question_id", "left")
    none = F.col("table_id").isNull()
    return kept.select(
        "question_id",
        F.when(none, FAKE_TABLE).otherwise(F.col("table_id").cast("string")).alias("table_id"),
        F.lit("BASELINE").alias("type"),
        F.when(none, 0).otherwise(F.col("rank")).cast("int").alias("rank"),
        F.when(none, 0.0).otherwise(-F.col("score")).alias("score"),
    )
