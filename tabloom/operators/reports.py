"""Reports over conversions and answer files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tabloom.functions import text


def conversion_report(records: DataFrame, error: str = "error") -> DataFrame:
    """Records, valid ones and failures by file and reason, with totals per file and overall.

    records (file, error); error is null for a record that was converted.
    """
    level = F.when(F.grouping("file") == 1, "all").when(F.grouping("reason") == 1, "file").otherwise("reason")
    return (
        records.withColumn("reason", F.coalesce(error, F.lit("")))
        .rollup("file", "reason")
        .agg(
            level.alias("level"),
            F.count("*").alias("total"),
            F.count_if(F.col(error).isNull()).alias("valid"),
            F.count_if(F.col(error).isNotNull()).alias("failed"),
        )
    )


def answer_file_accuracy(golds: DataFrame, answers: DataFrame) -> DataFrame:
    """Share of questions whose answer list equals the gold one after normalisation.

    Both sides (question_id, texts array<string>); a question without an answer is wrong.
    """
    left = golds.select("question_id", text.normalize_answers(F.col("texts")).alias("gold"))
    right = answers.select("question_id", text.normalize_answers(F.col("texts")).alias("got"))
    same = F.coalesce(F.col("gold") == F.col("got"), F.lit(False))
    return left.join(right, "question_id", "left").agg(F.avg(same.cast("double")).alias("exact_match"), F.count("*").alias("n"))


def with_counters(df: DataFrame, counters: Observation, **conditions: Column) -> DataFrame:
    """Count rows by condition while they pass; `counters.get` has the counts after the next action."""
    return df.observe(counters, F.count("*").alias("rows"), *[F.count_if(c).alias(k) for k, c in conditions.items()])


def missing_ids(ids: DataFrame, predictions: DataFrame, key: str = "question_id") -> DataFrame:
    """Ids that were asked for but not predicted."""
    return ids.select(key).join(predictions.select(key), key, "left_anti")


def complete_predictions(ids: DataFrame, predictions: DataFrame, key: str, value: str) -> DataFrame:
    """One row per id with its sorted values; ids without a prediction get an empty list."""
    done = predictions.groupBy(key).agg(F.sort_array(F.collect_list(value)).alias("answers"))
    return ids.select(key).join(done, key, "left").withColumn("answers", F.coalesce("answers", F.array().cast("array<string>")))
