"""Top-k and ranking helpers that stay distributed when one key is very large."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.operators.layout import materialize


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """First k rows per key, ranked from 1. Spark cuts each partition to k rows before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def global_rank(df: DataFrame, order: list[Column], rank: str = "rank") -> DataFrame:
    """Number all rows from 0 in order, without moving them into one partition.

    Rows are range-partitioned, sorted and written with a running number; a partition's first
    number and the sizes of the partitions before it give its ranks, without another shuffle.
    """
    sorted_rows = df.repartitionByRange(*order).sortWithinPartitions(*order)
    parts = materialize(sorted_rows.withColumn("_number", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_number", 33))
    sizes = parts.groupBy("_part").agg(F.min("_number").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # One row per partition, so this window is bounded by the number of partitions.
    offsets = sizes.select("_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return parts.join(F.broadcast(offsets), "_part").withColumn(rank, F.col("_number") + F.col("_shift")).drop("_number", "_part", "_shift")


def group_rank(df: DataFrame, keys: list[str], order: list[Column], rank: str = "rank") -> DataFrame:
    """Number the rows of every group from 0 in order; a group of any size is split.

    Rows are range-partitioned by keys and order together and written with a running number.
    A group's first number in a partition, and how many of its rows lie before, give its ranks.
    """
    sorted_rows = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    parts = materialize(sorted_rows.withColumn("_at", F.monotonically_increasing_id())).withColumn("_part", F.shiftright("_at", 33))
    sizes = parts.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*keys, "_part", (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return parts.join(offsets, [*keys, "_part"]).withColumn(rank, F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")


def first_wins(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key: the first by the given order."""
    return top_k(df, keys, order, 1, "_first").drop("_first")
