"""Data model: tables and cells as flat DataFrames.

tables(table_id, document_title, caption, document_url, alt_urls, alt_ids,
       context_heading, columns, n_rows, n_cols)
cells(table_id, row, col, text), header cells on row -1

Tables are small and there are very many of them, so the cell is the row and the
collection is what is partitioned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabloom.registry import read

HEADER_ROW = -1

QUESTIONS = (
    "question_id string, interaction_id string, table_id string, position int, "
    "original_text string, text string"
)
ANSWERS = (
    "question_id string, alt_index int, coords array<struct<row:int,col:int>>, agg string, "
    "texts array<string>, float_value float, is_valid boolean, class_index int"
)
TABLES = (
    "table_id string, document_title string, caption string, document_url string, alt_urls array<string>, "
    "alt_ids array<string>, context_heading string, columns array<string>, n_rows int, n_cols int"
)
CELLS = "table_id string, row int, col int, text string"

ORDER_COLUMNS = (
    "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


def header(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("row") == HEADER_ROW)


def body(cells: DataFrame) -> DataFrame:
    return cells.where(F.col("row") >= 0)


def shapes(cells: DataFrame) -> DataFrame:
    """(table_id, n_rows, n_cols) measured from the cells."""
    return cells.groupBy("table_id").agg(
        (F.max("row") + 1).cast("int").alias("n_rows"), (F.max("col") + 1).cast("int").alias("n_cols")
    )


def wide_to_cells(rows: DataFrame, table_id: str, row: str, columns: list[str], with_header: bool = False) -> DataFrame:
    """Unpivot one wide row per table row into cells; columns keep their order.

    with_header adds the column names as header cells beside row 0, in the same pass.
    """
    cell = lambda at, i, text: F.struct(at.alias("row"), F.lit(i).alias("col"), text.alias("text"))
    entries = F.array(*[cell(F.col(row), i, F.col(c)) for i, c in enumerate(columns)])
    if with_header:
        names = F.array(*[cell(F.lit(HEADER_ROW), i, F.lit(c)) for i, c in enumerate(columns)])
        entries = F.when(F.col(row) == 0, F.concat(names, entries)).otherwise(entries)
    return rows.select(F.col(table_id).alias("table_id"), F.explode(entries).alias("e")).select("table_id", "e.row", "e.col", "e.text")


def header_cells(ids: DataFrame, columns: list[str]) -> DataFrame:
    entries = F.posexplode(F.array(*[F.lit(c) for c in columns]))
    return ids.select("table_id", entries.alias("col", "text")).select(
        "table_id", F.lit(HEADER_ROW).alias("row"), "col", "text"
    )


def _cell_text(name: str) -> Column:
    if name == "l_shipdate":
        return F.date_format(name, "yyyy-MM-dd")
    if name in ("l_returnflag", "l_linestatus"):
        return F.col(name)
    return F.col(name).cast("decimal(18,2)").cast("string")


def order_rows(spark: SparkSession, folder: str) -> DataFrame:
    """One wide row per line of an order, with its row number within the order."""
    order = ["l_linenumber", "l_partkey", "l_suppkey", *ORDER_COLUMNS]
    w = Window.partitionBy("table_id").orderBy(*order)
    # Numbered by the id that later steps group by, so that they find the rows in place.
    return (
        read(spark, folder, "lineitem")
        .select(F.col("l_orderkey").cast("string").alias("table_id"), *order)
        .withColumn("row", (F.row_number().over(w) - 1).cast("int"))
        .select("table_id", "row", *[_cell_text(c).alias(c) for c in ORDER_COLUMNS])
    )


def order_cells(spark: SparkSession, folder: str, with_header: bool = True) -> DataFrame:
    """Orders seen as tables: cells in long form."""
    return wide_to_cells(order_rows(spark, folder), "table_id", "row", list(ORDER_COLUMNS), with_header)


def order_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Orders seen as tables: one row each; the customer is the title, the date the version."""
    counts = (
        read(spark, folder, "lineitem")
        .groupBy("l_orderkey")
        .agg(F.count("*").cast("int").alias("n_rows"))
    )
    orders = read(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    title = F.col("o_custkey").cast("string")
    version = F.date_format("o_orderdate", "yyyyMMdd")
    return counts.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("l_orderkey").cast("string").alias("table_id"),
        title.alias("document_title"),
        F.concat(F.lit("http://tables.example/w?title="), title, F.lit("&amp;oldid="), version).alias("document_url"),
        F.array(*[F.lit(c) for c in ORDER_COLUMNS]).alias("columns"),
        "n_rows",
        F.lit(len(ORDER_COLUMNS)).alias("n_cols"),
    )
