"""Places of rows within their group, however large one group is."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tabloom.llm.common import written

#: monotonically_increasing_id holds the partition above this bit.
_PART_BIT = 33


def placed(rows: DataFrame, keys: list[str], order: list[str], name: str, without: tuple[str, ...] = ()) -> DataFrame:
    """`rows` with `place`, counted from 0 in ascending `order` (nulls first) within `keys`, and the group's `total`.

    Keys must not be null; rows equal in all of `order` are numbered in any order. Rows are dealt by
    range over keys and order together, so that a group of any size is split, and written with
    their running number; the few counts per key and partition give the offsets. Columns in
    `without` serve the order only and are left out.
    """
    ranged = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    held = written(ranged.withColumn("_at", F.monotonically_increasing_id()).drop(*without), name)
    held = held.withColumn("_part", F.shiftright("_at", _PART_BIT))
    counts = held.groupBy(*keys, "_part").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    group = Window.partitionBy(*keys)
    before = F.coalesce(F.sum("_n").over(group.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = counts.select(*keys, "_part", (before - F.col("_first")).alias("_shift"), F.sum("_n").over(group).alias("total"))
    joined = held.join(offsets, [*keys, "_part"])
    return joined.withColumn("place", F.col("_at") + F.col("_shift")).drop("_at", "_part", "_shift")
