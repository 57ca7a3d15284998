"""Questions, programs and expressions derived from the orders corpus, in Spark and in SQL.

The given tables hold no questions about tables, so each order (as a table) gets
one of each kind, determined by its key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.model import order_cells, order_tables

KEY = "CAST(table_id AS BIGINT)"


def selections(spark, folder) -> tuple[DataFrame, DataFrame]:
    """One cell selection per table: (questions, coords)."""
    key = F.col("table_id").cast("bigint")
    questions = order_tables(spark, folder).select(
        F.concat(F.lit("q"), "table_id").alias("question_id"),
        "table_id",
        F.element_at(F.array(*[F.lit(a) for a in ("NONE", "SUM", "AVERAGE", "COUNT")]), (F.pmod(key, F.lit(4)) + 1).cast("int")).alias("agg"),
    )
    coords = (
        order_cells(spark, folder, with_header=False)
        .where((F.col("col") == F.pmod(key, F.lit(7))) & ((F.col("row") + key) % 3 != 0))
        .select(F.concat(F.lit("q"), "table_id").alias("question_id"), "table_id", "row", "col")
    )
    return questions, coords


SELECTIONS = f"""
sel_q AS (SELECT 'q' || table_id AS question_id, table_id,
  ['NONE','SUM','AVERAGE','COUNT'][{KEY} % 4 + 1] AS agg FROM ot_tables),
sel_c AS (SELECT 'q' || table_id AS question_id, table_id, row, col, text FROM ot_body
  WHERE col = {KEY} % 7 AND (row + {KEY}) % 3 <> 0)
"""

# Numeric reading of an orders cell: columns 0 to 3 are plain decimals, the rest are not numbers.
IS_NUM = "regexp_matches(text, '^[0-9.]+$')"


def programs(spark, folder) -> DataFrame:
    """One typed program per table."""
    key = F.col("table_id").cast("bigint")

    def pick(options, k):
        return F.element_at(F.array(*[F.lit(o) for o in options]), (F.pmod(key, F.lit(k)) + 1).cast("int"))

    def cond(col, op, value):
        return F.struct(F.lit(col), F.lit(op), value).cast("struct<col:int,op:string,value:string>")

    at_least = cond(0, ">", F.pmod(key * 7, F.lit(40)).cast("string"))
    flag = cond(4, "=", pick(("a", "N", "R"), 3))
    before = cond(6, "<", F.lit("1999-01-01"))
    return order_tables(spark, folder).select(
        F.concat(F.lit("q"), "table_id").alias("question_id"),
        "table_id",
        pick(("NONE", "MAX", "MIN", "COUNT", "SUM", "AVERAGE"), 6).alias("agg"),
        F.pmod(key, F.lit(7)).cast("int").alias("sel"),
        F.when(key % 5 == 0, F.array(at_least, flag))
        .when(key % 5 == 1, F.array(at_least, before))
        .when(key % 5 == 2, F.array(flag))
        .otherwise(F.array(at_least))
        .alias("conds"),
    )


def typed_cells(spark, folder) -> DataFrame:
    return order_cells(spark, folder, with_header=False).withColumn("is_real", F.col("col") < 4)


PROGRAMS = f"""
prog AS (SELECT 'q' || table_id AS question_id, table_id, {KEY} AS k,
  ['NONE','MAX','MIN','COUNT','SUM','AVERAGE'][{KEY} % 6 + 1] AS agg, CAST({KEY} % 7 AS INTEGER) AS sel FROM ot_tables),
prog_rows AS (SELECT p.*, r.row, CAST(c0 AS DOUBLE) AS qty, [c0,c1,c2,c3,c4,c5,c6][sel + 1] AS text
  FROM prog p JOIN ot_rows r USING (table_id)
  WHERE (k % 5 = 2 OR CAST(c0 AS DOUBLE) > (k * 7) % 40)
    AND (k % 5 NOT IN (0, 2) OR lower(c4) = lower(['a','N','R'][k % 3 + 1]))
    AND (k % 5 <> 1 OR c6 < '1999-01-01')),
prog_num AS (SELECT *, CASE WHEN sel < 4 THEN CAST(text AS DOUBLE) END AS num FROM prog_rows),
prog_best AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY
    CASE WHEN agg = 'MAX' THEN num END DESC, CASE WHEN agg = 'MAX' THEN text END DESC, CASE WHEN agg = 'MAX' THEN row END DESC,
    CASE WHEN agg = 'MIN' THEN num END, CASE WHEN agg = 'MIN' THEN text END, row) AS best FROM prog_num),
prog_hits AS (SELECT * FROM prog_best WHERE agg NOT IN ('MAX','MIN') OR best = 1)
"""


EXPRESSION_AGGS = ("NONE", "LOWEST", "GREATEST", "FIRST", "LAST", "SUM", "RANGE", "AVERAGE", "COUNT")


def expressions(spark, folder) -> DataFrame:
    """Nine expressions per table, one per aggregate."""
    key = F.col("table_id").cast("bigint")

    def where(col, cmp, value):
        return F.struct(F.lit(col), F.lit(cmp), value).cast("struct<col:int,cmp:string,value:string>")

    over = where(0, ">", F.pmod(key * 3, F.lit(30)).cast("string"))
    open_only = where(5, "=", F.lit("O"))
    text_compare = where(4, "<", F.lit("5"))
    wheres = (
        F.when(key % 4 == 0, F.array(over))
        .when(key % 4 == 1, F.array(open_only, over))
        .when(key % 4 == 2, F.array(over, text_compare))
        .otherwise(F.array().cast("array<struct<col:int,cmp:string,value:string>>"))
    )
    ix = F.col("ix")
    return (
        order_tables(spark, folder)
        .select("table_id", wheres.alias("wheres"), F.posexplode(F.array(*[F.lit(a) for a in EXPRESSION_AGGS])).alias("ix", "agg"))
        .select(
            F.concat("table_id", F.lit(":"), ix.cast("string")).alias("expr_id"),
            "table_id",
            "wheres",
            F.pmod(key + ix, F.lit(7)).cast("int").alias("sel"),
            "agg",
        )
    )


EXPRESSIONS = f"""
ex AS (SELECT table_id || ':' || ix AS expr_id, table_id, ix, {KEY} AS k, agg, CAST(({KEY} + ix) % 7 AS INTEGER) AS sel FROM (
  SELECT table_id, unnest(['NONE','LOWEST','GREATEST','FIRST','LAST','SUM','RANGE','AVERAGE','COUNT']) AS agg, unnest(range(9)) AS ix FROM ot_tables)),
ex_all AS (SELECT e.*, r.row, [c0,c1,c2,c3,c4,c5,c6][sel + 1] AS text,
    CASE WHEN sel < 4 THEN CAST([c0,c1,c2,c3,c4,c5,c6][sel + 1] AS DOUBLE) END AS num,
    CASE WHEN k % 4 = 0 THEN CAST(c0 AS DOUBLE) > (k * 3) % 30
         WHEN k % 4 = 1 THEN c5 = 'O' AND CAST(c0 AS DOUBLE) > (k * 3) % 30
         WHEN k % 4 = 2 THEN FALSE ELSE TRUE END AS kept,
    k % 4 = 2 AND CAST(c0 AS DOUBLE) > (k * 3) % 30 AS failed
  FROM ex e JOIN ot_rows r USING (table_id)),
ex_agg AS (SELECT expr_id, table_id, any_value(agg) AS agg, bool_or(failed) AS failed, any_value(sel) < 4 AS ranked,
    count_if(kept) AS n, list_sort(list_distinct(list(text) FILTER (kept))) AS vals,
    arg_min(text, row) FILTER (kept) AS first_text, arg_max(text, row) FILTER (kept) AS last_text,
    (list(text ORDER BY num, row) FILTER (kept))[1] AS lowest, (list(text ORDER BY num DESC, row) FILTER (kept))[1] AS greatest,
    list_reduce(list_prepend(0.0::DOUBLE, list(num ORDER BY row) FILTER (kept)), lambda a, b: a + b) AS total, max(num) FILTER (kept) - min(num) FILTER (kept) AS span
  FROM ex_all GROUP BY expr_id, table_id),
ex_val AS (SELECT expr_id, table_id, CASE WHEN failed OR n = 0 THEN NULL
    WHEN agg = 'COUNT' THEN [CAST(n AS VARCHAR)] WHEN agg = 'NONE' THEN vals WHEN n < 2 THEN NULL
    WHEN agg = 'FIRST' THEN [first_text] WHEN agg = 'LAST' THEN [last_text] WHEN NOT ranked THEN NULL
    WHEN agg = 'LOWEST' THEN [lowest] WHEN agg = 'GREATEST' THEN [greatest]
    WHEN agg = 'SUM' THEN [CASE WHEN total = floor(total) THEN CAST(CAST(total AS BIGINT) AS VARCHAR) ELSE printf('%.2f', total) END]
    WHEN agg = 'RANGE' THEN [CASE WHEN span = floor(span) THEN CAST(CAST(span AS BIGINT) AS VARCHAR) ELSE printf('%.2f', span) END]
    WHEN agg = 'AVERAGE' THEN [CASE WHEN total / n = floor(total / n) THEN CAST(CAST(total / n AS BIGINT) AS VARCHAR) ELSE printf('%.2f', total / n) END]
    END AS vals FROM ex_agg)
"""
