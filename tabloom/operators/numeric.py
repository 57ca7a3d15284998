"""Typed values of cells: column consolidation, ranks and relations to question values.

All steps work within (table_id, col), so cells that are already distributed by
table_id are not moved again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import numbers, text
from tabloom.model import body

MIN_SHARE = 0.7
# Relation bits of a cell to the values of a question.
EQ, LT, GT = 1, 2, 4

_COLUMN = Window.partitionBy


def with_values(cells: DataFrame, free_text: bool = False) -> DataFrame:
    """Body cells with all their numbers and dates in `values`.

    free_text=True also finds values inside running text, through Python; the
    default reads cells that are one number or one date and stays in the JVM.
    """
    normal = text.normalize_for_match(F.col("text"))
    if free_text:
        return body(cells).withColumn("values", numbers.text_values(normal))
    # One step each: what a later step names several times is then a column, computed once a cell.
    cell, reads = F.col("_normal"), F.col("_reads")
    read = body(cells).withColumn("_normal", normal)
    read = read.withColumns({"_reads": numbers.reads_as_number(cell), "_parts": numbers.date_parts(cell)})
    read = read.withColumns({"_digits": F.when(reads, numbers.numeral(cell)), "_day": numbers.date_from(F.col("_parts"))})
    read = read.withColumn("_number", F.when(reads, numbers.parse_number(cell, F.col("_digits"))))
    values = numbers.held_values(F.col("_number"), F.col("_day"))
    return read.withColumn("values", values).drop("_normal", "_reads", "_parts", "_digits", "_day", "_number")


def consolidate(valued: DataFrame, min_share: float = MIN_SHARE) -> DataFrame:
    """Add `num`: the first value of the column's most frequent type, or null.

    A type counts once per row; it must reach min_share of the rows; dates win ties.
    """
    column = _COLUMN("table_id", "col")

    def rows_with(kind: str) -> Column:
        has = F.exists("values", lambda v: v["type"] == kind)
        return F.count_if(F.coalesce(has, F.lit(False))).over(column)

    typed = valued.withColumns(
        {"_numbers": rows_with(numbers.NUMBER), "_dates": rows_with(numbers.DATE), "_rows": F.count("*").over(column)}
    )
    best = F.greatest("_numbers", "_dates")
    kind = F.when((best == 0) | (best < F.col("_rows") * min_share), None).otherwise(
        F.when(F.col("_dates") == best, numbers.DATE).otherwise(numbers.NUMBER)
    )
    first = F.get(F.filter("values", lambda v: v["type"] == F.col("_kind")), F.lit(0))
    return typed.withColumn("_kind", kind).withColumn("num", first).drop("_numbers", "_dates", "_rows", "_kind", "values")


def _shared_parts() -> dict[str, Column]:
    """Which date parts all values of the column have; numbers have none missing."""
    column = _COLUMN("table_id", "col")
    return {
        f"_has_{p}": F.coalesce(F.bool_and(F.when(F.col("num").isNotNull(), F.col("num")[p].isNotNull())).over(column), F.lit(False))
        for p in ("year", "month", "day")
    }


def _comparable() -> Column:
    return (F.col("num")["type"] == numbers.NUMBER) | F.col("_has_year") | F.col("_has_month") | F.col("_has_day")


def column_ranks(consolidated: DataFrame) -> DataFrame:
    """Dense ranks from 1 of the typed cells of each column, upward and downward."""
    key = F.when(_comparable(), numbers.sort_key(F.col("num"), F.col("_has_year"), F.col("_has_month"), F.col("_has_day")))
    keyed = consolidated.where("num is not null").withColumns(_shared_parts()).withColumn("_key", key).where("_key is not null")
    column = _COLUMN("table_id", "col")
    return keyed.withColumns(
        {
            "rank": F.dense_rank().over(column.orderBy("_key")),
            "inv_rank": F.dense_rank().over(column.orderBy(F.col("_key").desc())),
        }
    ).drop("_key", "_has_year", "_has_month", "_has_day")


def numeric_string_ranks(cells: DataFrame) -> DataFrame:
    """Dense rank from 0 of columns in which every cell reads as a number."""
    column = _COLUMN("table_id", "col")
    number = numbers.convert_to_float(F.col("text"))
    return (
        body(cells)
        .withColumn("number", number)
        .withColumn("_all", F.bool_and(F.col("number").isNotNull()).over(column))
        .where("_all")
        .withColumn("rank", F.dense_rank().over(column.orderBy("number")) - 1)
        .drop("_all")
    )


def relations(question_values: DataFrame, consolidated: DataFrame) -> DataFrame:
    """Relation bits per question and cell, over all values of the question.

    question_values (table_id, question_id, value). Dates are compared on the parts
    that the whole column and the question value have. LT means that the question
    value is below the cell.
    """
    cells = consolidated.where("num is not null").withColumns(_shared_parts())
    pairs = cells.join(question_values, "table_id").where(F.col("value")["type"] == F.col("num")["type"])
    use = {p: F.col(f"_has_{p}") & F.col("value")[p].isNotNull() for p in ("year", "month", "day")}
    usable = (F.col("num")["type"] == numbers.NUMBER) | use["year"] | use["month"] | use["day"]
    mine = numbers.sort_key(F.col("value"), use["year"], use["month"], use["day"])
    other = numbers.sort_key(F.col("num"), use["year"], use["month"], use["day"])
    bit = F.when(mine == other, EQ).when(mine < other, LT).otherwise(GT)
    return (
        pairs.where(usable)
        .groupBy("table_id", "question_id", "row", "col")
        .agg(F.bit_or(bit).alias("relation"))
    )
