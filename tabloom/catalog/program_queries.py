"""Programs, denotations and typed columns over the orders corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import derived as D
from tabloom.catalog import sqlparts as S
from tabloom.functions import numbers
from tabloom.model import order_cells, order_tables
from tabloom.operators import numeric, programs
from tabloom.registry import query


def shown(denotation):
    """Denotation as text: numbers with two decimals, sorted."""
    parts = F.transform(
        denotation, lambda v: F.coalesce(v["text"], v["number"].cast("decimal(18,2)").cast("string"))
    )
    return F.array_join(F.sort_array(parts), "|")


@query(
    "d01_denotation",
    f"""{S.WITH_OT}, {D.SELECTIONS}, a AS (SELECT question_id, count(*) AS n, bool_and({D.IS_NUM}) AS nums,
        sum(TRY_CAST(text AS DOUBLE)) AS total, list(text) AS texts FROM sel_c GROUP BY question_id),
      v AS (SELECT q.question_id, agg, coalesce(n, 0) AS n, nums, total, coalesce(texts, []) AS texts FROM sel_q q LEFT JOIN a USING (question_id))
    SELECT question_id, agg, CASE WHEN agg = 'COUNT' THEN CAST(CAST(n AS DECIMAL(18,2)) AS VARCHAR)
      WHEN agg = 'NONE' OR n = 0 OR NOT nums THEN array_to_string(list_sort(list_transform(texts, lambda t:
        CASE WHEN regexp_matches(t, '^[0-9.]+$') THEN CAST(CAST(CAST(CAST(t AS DOUBLE) AS FLOAT) AS DECIMAL(18,2)) AS VARCHAR) ELSE lower(t) END)), '|')
      WHEN agg = 'SUM' THEN CAST(CAST(CAST(total AS FLOAT) AS DECIMAL(18,2)) AS VARCHAR)
      ELSE CAST(CAST(CAST(total / n AS FLOAT) AS DECIMAL(18,2)) AS VARCHAR) END AS denotation FROM v""",
)
def d01(spark, folder):
    questions, coords = D.selections(spark, folder)
    found = programs.denotations(questions, coords, order_cells(spark, folder))
    return found.select("question_id", "agg", shown(F.col("denotation")).alias("denotation"))


@query(
    "d02_run_programs",
    f"""{S.WITH_OT}, {D.PROGRAMS} SELECT p.question_id, CASE WHEN p.agg IN ('MAX','MIN') THEN 'NONE' ELSE p.agg END AS agg,
      coalesce(string_agg(h.row || ',' || h.sel || '=' || h.text, '|' ORDER BY h.row), '') AS answer
    FROM prog p LEFT JOIN prog_hits h USING (question_id) GROUP BY ALL""",
)
def d02(spark, folder):
    result = programs.run_programs(D.programs(spark, folder), D.typed_cells(spark, folder))
    col = F.col("coords")[0]["col"].cast("string")
    parts = F.transform("entries", lambda e: F.concat(e["row"].cast("string"), F.lit(","), col, F.lit("="), e["text"]))
    return result.select("question_id", "agg", F.array_join(parts, "|").alias("answer"))


@query(
    "d03_float_answers",
    f"""{S.WITH_OT}, {D.PROGRAMS}, a AS (SELECT p.question_id, CASE WHEN p.agg IN ('MAX','MIN') THEN 'NONE' ELSE p.agg END AS agg, p.sel,
      count(h.row) AS n, sum(h.num) AS total, any_value(h.text) AS one FROM prog p LEFT JOIN prog_hits h USING (question_id) GROUP BY ALL)
    SELECT question_id, round(CASE WHEN agg = 'COUNT' THEN CAST(n AS DOUBLE) WHEN n = 0 THEN 'NaN'::DOUBLE
      WHEN n = 1 AND sel < 4 THEN CAST(one AS DOUBLE) WHEN agg = 'NONE' OR sel >= 4 THEN NULL
      WHEN agg = 'SUM' THEN total ELSE total / n END, 6) AS float_answer FROM a""",
)
def d03(spark, folder):
    result = programs.run_programs(D.programs(spark, folder), D.typed_cells(spark, folder))
    return programs.float_answers(result).select("question_id", F.round("float_answer", 6).alias("float_answer"))


@query(
    "d04_expressions",
    f"{S.WITH_OT}, {D.EXPRESSIONS} SELECT expr_id, array_to_string(vals, '|') AS answer FROM ex_val",
)
def d04(spark, folder):
    result = programs.evaluate_expressions(D.expressions(spark, folder), order_cells(spark, folder))
    return result.select("expr_id", F.array_join("values", "|").alias("answer"))


_TRUTH_SQL = """
truth AS (SELECT l.table_id, CASE WHEN l.vals IS NULL OR r.vals IS NULL THEN 'ERROR' ELSE
    CASE WHEN cmp = '=' THEN CASE WHEN l.vals = r.vals THEN 'TRUE' ELSE 'FALSE' END
      WHEN len(list_filter(list_concat(l.vals, r.vals), lambda v: TRY_CAST(v AS DOUBLE) IS NULL)) > 0 THEN 'ERROR'
      WHEN cmp = '<' THEN CASE WHEN list_max(list_transform(l.vals, lambda v: CAST(v AS DOUBLE))) < list_min(list_transform(r.vals, lambda v: CAST(v AS DOUBLE))) THEN 'TRUE' ELSE 'FALSE' END
      ELSE CASE WHEN list_min(list_transform(l.vals, lambda v: CAST(v AS DOUBLE))) > list_max(list_transform(r.vals, lambda v: CAST(v AS DOUBLE))) THEN 'TRUE' ELSE 'FALSE' END END END AS result, cmp
  FROM ex_val l JOIN ex_val r ON l.table_id = r.table_id AND CAST(split_part(l.expr_id, ':', 2) AS INTEGER) + 1 = CAST(split_part(r.expr_id, ':', 2) AS INTEGER),
    (SELECT unnest(['=', '<', '>']) AS cmp))
"""


def condition_results(spark, folder):
    """Each expression compared with the next one of its table, with every comparator."""
    values = programs.evaluate_expressions(D.expressions(spark, folder), order_cells(spark, folder))
    ix = F.split("expr_id", ":")[1].cast("int")
    # All values of a table meet as one list, so they are evaluated once and stay where the table lies.
    read = values.select("table_id", ix.alias("ix"), "values", programs.floats(F.col("values")).alias("floats"))
    listed = read.groupBy("table_id").agg(F.collect_list(F.struct("ix", "values", "floats")).alias("all"))
    left = listed.select("table_id", "all", F.explode("all").alias("l")).select("table_id", F.filter("all", lambda e: e["ix"] == F.col("l")["ix"] + 1).alias("next"), "l")
    paired = left.select("table_id", "l", F.explode("next").alias("r")).select(
        "table_id", "l.ix", F.col("l.values").alias("left_values"), F.col("r.values").alias("right_values"), F.col("l.floats").alias("lo"), F.col("r.floats").alias("hi")
    )
    return paired.withColumn("cmp", F.explode(F.array(F.lit("="), F.lit("<"), F.lit(">")))).select(
        "table_id",
        "ix",
        "cmp",
        programs.condition_truth(F.col("left_values"), F.col("right_values"), F.col("cmp"), F.col("lo"), F.col("hi")).alias("result"),
    )


@query(
    "d05_condition_truth",
    f"{S.WITH_OT}, {D.EXPRESSIONS}, {_TRUTH_SQL} SELECT cmp, result, count(*) AS n, count(DISTINCT table_id) AS n_tables FROM truth GROUP BY ALL",
)
def d05(spark, folder):
    per_table = condition_results(spark, folder).groupBy("table_id", "cmp", "result").agg(F.count("*").alias("n"))
    return per_table.groupBy("cmp", "result").agg(F.sum("n").alias("n"), F.count("table_id").alias("n_tables"))


@query(
    "d05_statement_truth",
    f"""{S.WITH_OT}, {D.EXPRESSIONS}, {_TRUTH_SQL} SELECT table_id, cmp, CASE WHEN bool_or(result = 'ERROR') THEN 'ERROR'
      WHEN bool_or(result = 'FALSE') THEN 'FALSE' ELSE 'TRUE' END AS result FROM truth GROUP BY ALL""",
)
def d05_statement(spark, folder):
    return condition_results(spark, folder).groupBy("table_id", "cmp").agg(
        programs.statement_truth(F.col("result")).alias("result")
    )


_VALUES_SQL = """
vals AS (SELECT table_id, row, col, text, regexp_matches(text, '^[0-9]+(\\.[0-9]*)?$') AS is_num,
  regexp_matches(text, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') AND coalesce(TRY_CAST(substr(text, 1, 4) AS INTEGER), 0) BETWEEN 1700 AND 2016 AS is_date FROM mixed),
cons AS (SELECT *, count_if(is_num) OVER w AS nn, count_if(is_date) OVER w AS nd, count(*) OVER w AS n FROM vals WINDOW w AS (PARTITION BY table_id, col)),
typed AS (SELECT *, CASE WHEN greatest(nn, nd) = 0 OR greatest(nn, nd) < 0.7 * n THEN NULL WHEN nd >= nn THEN 'date' ELSE 'number' END AS kind FROM cons),
num AS (SELECT table_id, row, col, text, kind, CASE WHEN kind = 'number' AND is_num THEN CAST(text AS DOUBLE) END AS f,
  CASE WHEN kind = 'date' AND is_date THEN text END AS d FROM typed)
"""

# Every fifth cell of the mixed corpus is taken from the next column, so that columns hold several types.
_MIXED_SQL = """
mixed AS (SELECT table_id, row, CAST(CASE WHEN (row + CAST(table_id AS BIGINT)) % 5 = 0 THEN (col + 1) % 7 ELSE col END AS INTEGER) AS col, text FROM ot_body)
"""


def mixed_cells(spark, folder):
    key = F.col("table_id").cast("bigint")
    moved = F.when((F.col("row") + key) % 5 == 0, (F.col("col") + 1) % 7).otherwise(F.col("col")).cast("int")
    return order_cells(spark, folder, with_header=False).withColumn("col", moved)


@query(
    "d22_consolidate",
    f"{S.WITH_OT}, {_MIXED_SQL}, {_VALUES_SQL} SELECT table_id, row, col, f, CASE WHEN d IS NOT NULL THEN CAST(substr(d, 1, 4) AS INTEGER) END AS year FROM num WHERE f IS NOT NULL OR d IS NOT NULL",
)
def d22(spark, folder):
    typed = numeric.consolidate(numeric.with_values(mixed_cells(spark, folder)))
    return typed.where("num is not null").select("table_id", "row", "col", F.col("num")["f"].alias("f"), F.col("num")["year"].alias("year"))


@query(
    "e01_column_ranks",
    f"""{S.WITH_OT}, {_MIXED_SQL}, {_VALUES_SQL} SELECT table_id, row, col,
      CAST(dense_rank() OVER (PARTITION BY table_id, col ORDER BY f, d) AS INTEGER) AS rank,
      CAST(dense_rank() OVER (PARTITION BY table_id, col ORDER BY f DESC, d DESC) AS INTEGER) AS inv_rank
    FROM num WHERE f IS NOT NULL OR d IS NOT NULL""",
)
def e01(spark, folder):
    typed = numeric.consolidate(numeric.with_values(mixed_cells(spark, folder)))
    return numeric.column_ranks(typed).select("table_id", "row", "col", "rank", "inv_rank")


@query(
    "e02_numeric_string_ranks",
    f"""{S.WITH_OT}, {_MIXED_SQL}, n AS (SELECT *, TRY_CAST(text AS DOUBLE) AS num, bool_and(TRY_CAST(text AS DOUBLE) IS NOT NULL) OVER (PARTITION BY table_id, col) AS ok FROM mixed)
    SELECT table_id, row, col, CAST(dense_rank() OVER (PARTITION BY table_id, col ORDER BY num) - 1 AS INTEGER) AS rank FROM n WHERE ok""",
)
def e02(spark, folder):
    return numeric.numeric_string_ranks(mixed_cells(spark, folder)).select("table_id", "row", "col", "rank")


@query(
    "c17_relations",
    f"""{S.WITH_OT}, {_MIXED_SQL}, {_VALUES_SQL},
    qv AS (SELECT table_id, 'n' AS kind, CAST(n_rows AS DOUBLE) * 5 AS f, NULL AS d FROM ot_tables
      UNION ALL SELECT table_id, 'n', 25.0, NULL FROM ot_tables
      UNION ALL SELECT table_id, 'd', NULL, CAST(version // 10000 AS VARCHAR) FROM ot_tables WHERE version // 10000 <= 2016)
    SELECT table_id, row, col, CAST(bit_or(CASE WHEN coalesce(q.f = n.f, FALSE) OR coalesce(q.d = substr(n.d, 1, 4), FALSE) THEN 1
      WHEN coalesce(q.f < n.f, FALSE) OR coalesce(q.d < substr(n.d, 1, 4), FALSE) THEN 2 ELSE 4 END) AS INTEGER) AS relation
    FROM num n JOIN qv q USING (table_id) WHERE (n.f IS NOT NULL AND q.kind = 'n') OR (n.d IS NOT NULL AND q.kind = 'd') GROUP BY ALL""",
)
def c17(spark, folder):
    typed = numeric.consolidate(numeric.with_values(mixed_cells(spark, folder)))
    year = F.substring(F.regexp_extract("document_url", r"oldid=(\d+)", 1), 1, 4).cast("int")
    none = F.lit(None).cast("int")
    year_value = numbers.date_value(F.struct(year.alias("year"), none.alias("month"), none.alias("day")))
    values = F.array(
        numbers.number_value(F.col("n_rows") * 5.0),
        numbers.number_value(F.lit(25.0)),
        F.when(year <= numbers.MAX_YEAR, year_value),
    )
    asked = (
        order_tables(spark, folder)
        .select("table_id", F.col("table_id").alias("question_id"), F.explode(values).alias("value"))
        .where("value is not null")
    )
    return numeric.relations(asked, typed).select("table_id", "row", "col", "relation")
