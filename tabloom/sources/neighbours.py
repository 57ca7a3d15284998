"""Vector and neighbour files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NEIGHBOURS = "query_id string, table_scores array<struct<table_id:string,score:double>>"


def read_vectors(spark: SparkSession, path: str, id_column: str, vector_column: str) -> DataFrame:
    """Tab-separated vectors written as list text."""
    raw = spark.read.csv(path, sep="\t", header=True)
    return raw.withColumn(vector_column, F.from_json(vector_column, "array<double>")).where(F.col(id_column).isNotNull())


def write_neighbours(neighbours: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON line per query with its tables by rank; scores are stored negated."""
    entry = F.struct("rank", F.struct(F.col("table_id").cast("string").alias("table_id"), (-F.col("score")).alias("score")).alias("e"))
    lines = neighbours.groupBy(F.col("query_id").cast("string").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(entry)), lambda x: x["e"]).alias("table_scores")
    )
    lines.write.mode(mode).json(path)


def read_neighbours(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, rank, table_id, score) with scores as stored; a repeated query id fails the query."""
    lines = spark.read.schema(NEIGHBOURS).json(path)
    once = lines.groupBy("query_id").agg(F.count("*").alias("n"), F.first("table_scores").alias("table_scores"))
    twice = F.raise_error(F.concat(F.lit("query listed twice: "), F.col("query_id"))).cast("boolean")
    checked = once.where(F.when(F.col("n") == 1, F.lit(True)).otherwise(twice))
    return checked.select("query_id", F.posexplode("table_scores").alias("ix", "e")).select(
        "query_id", (F.col("ix") + 1).alias("rank"), "e.table_id", "e.score"
    )
