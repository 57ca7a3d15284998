"""Writers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators.reports import complete_predictions


def write_splits(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per value of the split column."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def append_metrics(metrics: DataFrame, path: str, step: int) -> None:
    """One JSON line of metrics per evaluated step."""
    metrics.withColumn("step", F.lit(step)).write.mode("append").json(path)


def export_predictions(ids: DataFrame, predictions: DataFrame, path: str, key: str = "question_id", value: str = "text") -> None:
    """Id and sorted answers for every id, blank for ids without a prediction, as TSV."""
    rows = complete_predictions(ids, predictions, key, value)
    rows.select(key, F.to_json("answers").alias("answers")).write.csv(path, sep="\t", header=True, quote="", escape="")
