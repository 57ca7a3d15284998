"""Selection, linearisation and generation over the orders corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import derived as D
from tabloom.catalog import sqlparts as S
from tabloom.catalog.align_queries import ANSWERS, answers
from tabloom.catalog.dense_queries import KNN, golds, neighbours
from tabloom.catalog.lexical_queries import BM25, POSTINGS, index
from tabloom.catalog.lexical_queries import questions as lexical_questions
from tabloom.functions import numbers, text
from tabloom.model import order_cells, order_tables
from tabloom.operators import generate, lexical, linearize, programs, reader, selection, statements
from tabloom.operators.layout import materialize
from tabloom.registry import query, read

TOK = r"regexp_extract_all(lower({t}), '([\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]+)', 1)"

QUESTIONS = """
qs AS (SELECT 'q' || table_id AS question_id, table_id, 'Which l_tax has ' || c4 || ' and ' || c6 || ' or ' || c0 || '?' AS text FROM ot_rows WHERE row = 0)
"""


def table_questions(spark, folder):
    first = order_cells(spark, folder, with_header=False).where("row = 0").groupBy("table_id").pivot("col", [0, 4, 6]).agg(F.first("text"))
    worded = F.concat(F.lit("Which l_tax has "), F.col("4"), F.lit(" and "), F.col("6"), F.lit(" or "), F.col("0"), F.lit("?"))
    return first.select(F.concat(F.lit("q"), "table_id").alias("question_id"), "table_id", worded.alias("text"))


SCORES = f"""
{QUESTIONS}, qt AS (SELECT question_id, table_id, list_distinct({S.tokens('text')}) AS q FROM qs),
ct AS (SELECT table_id, row, col, unnest({S.tokens('text')}) AS token FROM ot_cells),
colt AS (SELECT table_id, col, list_distinct(list(token)) AS t FROM ct GROUP BY ALL), rowt AS (SELECT table_id, row, list_distinct(list(token)) AS t FROM ct GROUP BY ALL),
cellt AS (SELECT table_id, row, col, list_distinct(list(token)) AS t FROM ct GROUP BY ALL),
cols AS (SELECT question_id, table_id, col, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE AS score FROM colt JOIN qt USING (table_id)),
rows_ AS (SELECT question_id, table_id, row, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE AS score FROM rowt JOIN qt USING (table_id)),
cells_ AS (SELECT question_id, table_id, row, col, len(list_intersect(t, q)) / len(list_distinct(list_concat(t, q)))::DOUBLE AS score FROM cellt JOIN qt USING (table_id))
"""


@query("i08_column_similarity", f"{S.WITH_OT}, {SCORES} SELECT question_id, col, round(score, 6) AS score FROM cols")
def i08(spark, folder):
    scores = selection.similarity_scores(table_questions(spark, folder), order_cells(spark, folder), "column")
    return scores.select("question_id", "col", F.round("score", 6).alias("score"))


@query("i08_row_similarity", f"{S.WITH_OT}, {SCORES} SELECT question_id, row, round(score, 6) AS score FROM rows_")
def i08_row(spark, folder):
    scores = selection.similarity_scores(table_questions(spark, folder), order_cells(spark, folder), "row")
    return scores.select("question_id", "row", F.round("score", 6).alias("score"))


@query(
    "i09_pack_columns",
    f"""WITH RECURSIVE {S.OT}, {SCORES}, cost AS (SELECT table_id, col, sum(len({TOK.format(t='text')})) AS cost FROM ot_cells GROUP BY ALL),
    o AS (SELECT question_id, col, cost, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, col) AS k FROM cols JOIN cost USING (table_id, col)),
    f AS (SELECT question_id, CAST(0 AS BIGINT) AS k, CAST(len({TOK.format(t='text')}) + 2 AS BIGINT) AS used, CAST(NULL AS INTEGER) AS col, FALSE AS picked FROM qs
      UNION ALL SELECT o.question_id, o.k, CAST(CASE WHEN f.used + o.cost <= 60 THEN f.used + o.cost ELSE f.used END AS BIGINT), o.col, f.used + o.cost <= 60 FROM f JOIN o ON o.question_id = f.question_id AND o.k = f.k + 1)
    SELECT question_id, col FROM f WHERE picked""",
)
def i09(spark, folder):
    cells, questions = order_cells(spark, folder), table_questions(spark, folder)
    scores = selection.similarity_scores(questions, cells, "column")
    return selection.pack_columns(questions, scores, cells, 60).select("question_id", "col")


@query(
    "i10_pack_tokens",
    f"""{S.WITH_OT}, {SCORES}, s AS (SELECT c.question_id, c.table_id, c.row, c.col, round(c.score + r.score + k.score, 9) AS score FROM cells_ c JOIN rows_ r USING (question_id, row) JOIN cols k ON k.question_id = c.question_id AND k.col = c.col),
    t AS (SELECT table_id, row, col, unnest(range(len({TOK.format(t='text')}))) AS token FROM ot_cells),
    o AS (SELECT s.question_id, t.row, t.col, token, row_number() OVER (PARTITION BY s.question_id ORDER BY score DESC, t.col, t.row, token) AS k FROM s JOIN t USING (table_id, row, col))
    SELECT question_id, CAST(row + 1 AS INTEGER) AS row, col, CAST(token AS INTEGER) AS token FROM o JOIN qs USING (question_id) WHERE k <= 40 - (len({TOK.format(t='qs.text')}) + 2)""",
)
def i10(spark, folder):
    return selection.pack_tokens(table_questions(spark, folder), order_cells(spark, folder), 40).select("question_id", "row", "col", "token")


@query("i11_all_tokens", f"{S.WITH_OT} SELECT 'q' || table_id AS question_id, count(*) AS n_tokens FROM (SELECT table_id, unnest({TOK.format(t='text')}) FROM ot_cells) GROUP BY 1")
def i11(spark, folder):
    tokens = selection.all_tokens(table_questions(spark, folder), order_cells(spark, folder))
    return tokens.groupBy("question_id").agg(F.count("*").alias("n_tokens"))


SERIAL = rf"""
{QUESTIONS}, cl AS (SELECT table_id, row, col, {TOK.format(t='text')} AS toks FROM ot_cells),
of AS (SELECT *, coalesce(sum(len(toks)) OVER (PARTITION BY table_id ORDER BY row, col ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM cl),
qk AS (SELECT question_id, table_id, list_concat(['[CLS]'], list_concat({TOK.format(t='text')}, ['[SEP]'])) AS toks FROM qs),
ser AS (SELECT question_id, CAST(unnest(range(len(toks))) AS INTEGER) AS position, unnest(toks) AS token, 0 AS segment_id, 0 AS row_id, 0 AS column_id FROM qk
  UNION ALL SELECT question_id, CAST(len(qk.toks) + off + unnest(range(len(of.toks))) AS INTEGER), unnest(of.toks), 1, CAST(row + 1 AS INTEGER), CAST(col + 1 AS INTEGER) FROM of JOIN qk USING (table_id))
"""


def serialized(spark, folder):
    return linearize.serialize(table_questions(spark, folder), order_cells(spark, folder))


@query(
    "j01_linearize",
    f"""{S.WITH_OT}, {SERIAL} SELECT question_id, count(*) AS n_tokens, md5(string_agg(token || ' ' || segment_id || ' ' || row_id || ' ' || column_id, '|' ORDER BY position)) AS digest, max(position) AS last FROM ser GROUP BY question_id""",
)
def j01(spark, folder):
    entry = F.struct("position", F.concat_ws(" ", "token", F.col("segment_id").cast("string"), F.col("row_id").cast("string"), F.col("column_id").cast("string")).alias("t"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(entry)), lambda e: e["t"]), "|")
    return serialized(spark, folder).groupBy("table_id", "question_id").agg(F.count("*").alias("n_tokens"), F.md5(joined).alias("digest"), F.max("position").alias("last")).drop("table_id")


@query(
    "j01_padded_arrays",
    f"""{S.WITH_OT}, {SERIAL} SELECT question_id, CAST(64 AS INTEGER) AS width, md5(array_to_string(list_resize(list(token ORDER BY position)[1:64], 64, ''), '|')) AS digest FROM ser GROUP BY question_id""",
)
def j01_arrays(spark, folder):
    arrays = linearize.to_arrays(serialized(spark, folder), 64)
    return arrays.select("question_id", F.size("token").alias("width"), F.md5(F.array_join("token", "|")).alias("digest"))


FIT = f"""
{QUESTIONS}, ln AS (SELECT table_id, row + 1 AS row, col, len({TOK.format(t='text')}) AS n FROM ot_cells),
bd AS (SELECT question_id, table_id, 80 - (len({TOK.format(t='text')}) + 2) AS budget FROM qs)
"""


def budgets(spark, folder, total=80):
    q = table_questions(spark, folder)
    return q.select("question_id", "table_id", (F.lit(total) - selection.question_cost(F.col("text"))).alias("budget"))


@query(
    "j02_fit_to_budget",
    f"""{S.WITH_OT}, {FIT}, c AS (SELECT table_id, r, t, sum(least(n, t)) FILTER (row <= r) AS cost FROM ln, (SELECT unnest(range(0, 20)) AS r), (SELECT unnest(range(1, 8)) AS t) GROUP BY ALL),
    mx AS (SELECT table_id, max(row) AS n_rows, max(n) AS max_len FROM ln GROUP BY table_id),
    k AS (SELECT question_id, b.table_id, budget, max(r) AS kept FROM bd b JOIN mx USING (table_id) JOIN c USING (table_id) WHERE t = 1 AND r <= n_rows AND cost <= budget GROUP BY ALL)
    SELECT b.question_id, CAST(kept AS INTEGER) AS n_rows, CAST(max(t) AS INTEGER) AS n_tokens FROM bd b JOIN mx USING (table_id) LEFT JOIN k ON k.question_id = b.question_id LEFT JOIN c ON c.table_id = b.table_id AND c.r = kept AND t <= max_len AND cost <= b.budget GROUP BY b.question_id, kept""",
)
def j02(spark, folder):
    found = linearize.fit_to_budget(budgets(spark, folder), order_cells(spark, folder), drop_rows=True)
    return found.select("question_id", F.col("n_rows").cast("int").alias("n_rows"), "n_tokens")


@query(
    "j03_retrieval_shrink",
    f"""WITH RECURSIVE {S.OT}, {FIT}, mx AS (SELECT table_id, max(row) AS n_rows, max(n) AS max_len FROM ln GROUP BY table_id),
    c1 AS (SELECT table_id, r, k, count(*) FILTER (row <= r AND col < k AND n > 0) AS cost FROM ln, (SELECT unnest(range(0, 20)) AS r), (SELECT unnest(range(0, 8)) AS k) GROUP BY ALL),
    ld AS (SELECT question_id, b.table_id, budget, CAST(n_rows AS BIGINT) AS r, CAST(7 AS BIGINT) AS k FROM bd b JOIN mx USING (table_id)
      UNION ALL SELECT question_id, ld.table_id, budget, CASE WHEN ld.k >= ld.r THEN ld.r ELSE ld.r - 1 END, CASE WHEN ld.k >= ld.r THEN ld.k - 1 ELSE ld.k END FROM ld JOIN c1 ON c1.table_id = ld.table_id AND c1.r = ld.r AND c1.k = ld.k WHERE cost > budget - 45 AND ld.r > 0 AND ld.k > 0),
    fin AS (SELECT question_id, arg_min(r, r + k) AS r, arg_min(k, r + k) AS k FROM ld GROUP BY question_id)
    SELECT question_id, CASE WHEN r > 0 AND k > 0 THEN CAST(r AS INTEGER) END AS n_rows, CASE WHEN r > 0 AND k > 0 THEN CAST(k AS INTEGER) END AS n_cols FROM fin""",
)
def j03(spark, folder):
    found = linearize.shrink_to_budget(budgets(spark, folder, 35), order_cells(spark, folder))
    return found.select("question_id", F.col("n_rows").cast("int").alias("n_rows"), F.col("n_cols").cast("int").alias("n_cols"))


@query(
    "j04_numeric_values",
    f"""{S.WITH_OT}, c AS (SELECT table_id, text, len({TOK.format(t='text')}) AS n FROM ot_cells)
    SELECT 'q' || table_id AS question_id, round(sum(TRY_CAST(text AS DOUBLE) * n), 4) AS total, CAST(max(n) AS BIGINT) AS widest FROM c GROUP BY table_id""",
)
def j04(spark, folder):
    cells = order_cells(spark, folder)
    valued = cells.withColumn("number", numbers.convert_to_float(F.col("text")))
    tokens = linearize.numeric_values(serialized(spark, folder), valued)
    finite = F.when(~F.isnan("numeric_value"), F.col("numeric_value"))
    return tokens.groupBy("table_id", "question_id").agg(F.round(F.sum(finite), 4).alias("total"), F.max("scale").alias("widest")).drop("table_id")


@query(
    "j05_label_by_coordinates",
    f"{S.WITH_OT}, {D.SELECTIONS} SELECT question_id, CAST(sum(len({TOK.format(t='text')})) AS BIGINT) AS n_labelled FROM sel_c GROUP BY question_id",
)
def j05(spark, folder):
    _, coords = D.selections(spark, folder)
    return linearize.label_by_coordinates(serialized(spark, folder), coords).where("label = 1").groupBy("question_id").agg(F.count("*").alias("n_labelled"))


@query(
    "j05_answer_cells",
    f"""{S.WITH_OT}, {ANSWERS}, f AS (SELECT a.question_id, a.table_id, answer_ix, min((c.row, c.col)) AS cell FROM ans a JOIN ot_body c ON c.table_id = a.table_id
      AND contains(chr(1) || array_to_string({TOK.format(t='c.text')}, chr(1)) || chr(1), chr(1) || array_to_string({TOK.format(t='a.text')}, chr(1)) || chr(1)) WHERE alt_index = 0 GROUP BY ALL)
    SELECT question_id, answer_ix, CAST(cell[1] AS INTEGER) AS row, CAST(cell[2] AS INTEGER) AS col FROM f""",
)
def j05_cells(spark, folder):
    asked = answers(spark, folder).where("alt_index = 0")
    return linearize.answer_cells(table_questions(spark, folder), asked, order_cells(spark, folder)).select("question_id", "answer_ix", "row", "col")


@query("j06_mask_tokens")
def j06(spark, folder):
    masked = linearize.mask_tokens(serialized(spark, folder), seed=7, key="table_id")
    return masked.groupBy("table_id", "question_id").agg(F.count("label").alias("n_drawn"), F.count_if(F.col("masked") == linearize.MASK).alias("n_masked")).drop("table_id")


@query("j07_random_crop")
def j07(spark, folder):
    return linearize.random_crop(budgets(spark, folder), order_cells(spark, folder), seed=7)


@query(
    "j08_synthetic_statements",
    f"""{S.WITH_OT} SELECT table_id, 'pos' AS label, 'TRUE' AS truth, NULL AS failure FROM ot_tables UNION ALL SELECT table_id, 'neg', 'FALSE', NULL FROM ot_tables""",
)
def j08(spark, folder):
    """Two statements per table, the truth of each evaluated anew.

    The SQL knows what the draws must lead to, not the draws: a true and a false statement for
    every table. Opposite tables are left to j09; a test draws statements together with them.
    """
    cells = materialize(order_cells(spark, folder))
    made = materialize(statements.synthesize_statements(cells, seed=11, attempts=1000, opposite=False, most_wheres=3, width=2))
    asked = made.where("failure is null").select("condition_id", "table_id", "left", "right", "comparator")
    here = statements.condition_results(asked, cells).select("condition_id", "truth")
    return made.drop("truth").join(here, "condition_id", "left").select("table_id", "label", "truth", "failure")


_SHUFFLED = f"""
drawn AS (SELECT table_id, col AS moved, attempt, row, text, row_number() OVER (PARTITION BY table_id, col, attempt ORDER BY row) AS k,
    row_number() OVER (PARTITION BY table_id, col, attempt ORDER BY sha256('5|' || table_id || '|' || col || '|' || attempt || '|' || row)) AS d
  FROM ot_body, (SELECT unnest(range(4)) AS attempt)),
sh AS (SELECT a.table_id, a.moved, a.attempt, a.row, b.text FROM drawn a JOIN drawn b ON a.table_id = b.table_id AND a.moved = b.moved AND a.attempt = b.attempt AND a.k = b.d),
rows2 AS (SELECT sh.table_id, moved, attempt, sh.row, {", ".join(f"CASE WHEN moved = {k} THEN sh.text ELSE c{k} END AS c{k}" for k in range(7))} FROM sh JOIN ot_rows r ON r.table_id = sh.table_id AND r.row = sh.row),
ex2 AS (SELECT * EXCLUDE (expr_id), expr_id || '#' || attempt AS expr_id FROM ex, (SELECT unnest(range(4)) AS attempt)),
""" + D.EXPRESSIONS[D.EXPRESSIONS.index("ex_all AS") :].replace("FROM ex e JOIN ot_rows r USING (table_id)", "FROM ex2 e JOIN rows2 r ON r.table_id = e.table_id AND r.moved = e.sel AND r.attempt = e.attempt").replace(
    "ex_all", "ex_all2"
).replace("ex_agg", "ex_agg2").replace("ex_val", "ex_val2")


@query(
    "j09_opposite_tables",
    f"""{S.WITH_OT}, {D.EXPRESSIONS}, {_SHUFFLED},
    now AS (SELECT split_part(expr_id, '#', 1) AS expr_id, CAST(split_part(expr_id, '#', 2) AS INTEGER) AS attempt, vals FROM ex_val2 WHERE vals IS NOT NULL)
    SELECT ex.expr_id, ex.sel AS col, ex_val.vals IS NOT NULL AS defined, min(now.attempt) FILTER (now.vals <> ex_val.vals AND (ex.k % 4 <> 3 OR ex.agg IN ('FIRST', 'LAST'))) AS attempt
    FROM ex JOIN ex_val USING (expr_id) LEFT JOIN now USING (expr_id) GROUP BY ALL""",
)
def j09(spark, folder):
    """Every expression set equal to its own value: the first of four shuffles of its column in which that is false.

    Without a clause only FIRST and LAST can change; the SQL says so, since its sums in another order may differ in a last digit.
    """
    cells = materialize(programs.listed_cells(order_cells(spark, folder)))
    asked = D.expressions(spark, folder)
    values = programs.evaluate_expressions(asked, cells).select("expr_id", "values")
    side = lambda constant: F.struct("sel", "agg", "wheres", constant.alias("constant")).cast(statements.SIDE)
    conditions = materialize(
        asked.join(values.hint("merge"), "expr_id").select(
            F.col("expr_id").alias("condition_id"), "table_id", F.col("sel").alias("col"), side(F.lit(None).cast("array<string>")).alias("left"), side(F.col("values")).alias("right"),
            F.lit("=").alias("comparator"), F.when(F.col("values").isNotNull(), "TRUE").alias("truth"),
        )
    )
    found = statements.opposite_tables(cells, conditions.where("truth is not null"), attempts=4, seed=5).select("condition_id", "attempt")
    joined = conditions.join(found.hint("merge"), "condition_id", "left")
    return joined.select(F.col("condition_id").alias("expr_id"), "col", F.col("truth").isNotNull().alias("defined"), "attempt")


@query(
    "j10_verbalize",
    f"""{S.WITH_OT}, {D.EXPRESSIONS}, n AS (SELECT *, ['l_quantity','l_extendedprice','l_discount','l_tax','l_returnflag','l_linestatus','l_shipdate'][sel + 1] AS name FROM ex)
    SELECT expr_id, CASE agg WHEN 'NONE' THEN name WHEN 'COUNT' THEN 'the count' WHEN 'SUM' THEN 'the total ' || name WHEN 'RANGE' THEN 'the range of ' || name ELSE 'the ' || lower(agg) || ' ' || name END
      || CASE k % 4 WHEN 0 THEN ' when l_quantity is greater than ' || (k * 3) % 30 WHEN 1 THEN ' when l_linestatus is O and l_quantity is greater than ' || (k * 3) % 30
        WHEN 2 THEN ' when l_quantity is greater than ' || (k * 3) % 30 || ' and l_returnflag is less than 5' ELSE '' END AS words FROM n""",
)
def j10(spark, folder):
    names = F.array(*[F.lit(c) for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")])
    named = F.transform("wheres", lambda w: F.struct(F.get(names, w["col"]).alias("name"), w["cmp"].alias("cmp"), w["value"].alias("value")))
    return D.expressions(spark, folder).select("expr_id", generate.verbalize_expression(F.col("agg"), F.get(names, F.col("sel")), named).alias("words"))


_BOUND = "'\\b' || replace({t}, '.', '\\.') || '\\b'"
CONTRASTS = f"""{S.WITH_OT}, {QUESTIONS}, b AS (SELECT table_id, row, col, lower(text) AS cell FROM ot_body),
    m AS (SELECT q.question_id, q.table_id, q.text AS question, row, col, cell FROM (SELECT question_id, table_id, lower(text) AS text FROM qs) q JOIN b USING (table_id) WHERE regexp_matches(text, {_BOUND.format(t='cell')})),
    r AS (SELECT question_id, row, count(DISTINCT cell) AS n FROM m GROUP BY ALL),
    p AS (SELECT question_id, table_id, question, cell, min(col) AS col, max(n) > 1 AS has_support FROM m JOIN r USING (question_id, row) GROUP BY ALL HAVING count(DISTINCT col) = 1),
    contrasts AS (SELECT DISTINCT question_id, question, p.col, p.cell AS mention, v.cell AS replacement, has_support FROM p JOIN b v ON v.table_id = p.table_id AND v.col = p.col
      WHERE NOT regexp_matches(question, {_BOUND.format(t='v.cell')}) AND NOT contains(v.cell, p.cell) AND NOT contains(p.cell, v.cell))"""


@query("c18_contrastive_candidates", f"{CONTRASTS} SELECT question_id, col, mention, replacement, has_support FROM contrasts")
def c18(spark, folder):
    found = generate.contrastive_candidates(table_questions(spark, folder), order_cells(spark, folder))
    return found.select("question_id", "col", "mention", "replacement", "has_support")


@query(
    "j11_contrastive_statements",
    f"""{CONTRASTS}, one AS (SELECT *, regexp_replace(question, {_BOUND.format(t='mention')}, replacement, 'g') AS negative FROM contrasts
      QUALIFY row_number() OVER (PARTITION BY question_id, mention ORDER BY sha256('3|' || question_id || '|' || mention || '|' || replacement), replacement) = 1)
    SELECT question_id, max(has_support) AS has_support, question AS positive, negative FROM one
    WHERE len(string_split(question, ' ')) - len(string_split(mention, ' ')) >= 4 AND (has_support OR {S.uniform("'3|' || question_id || '|' || mention")} < 0.5) GROUP BY question_id, question, negative""",
)
def j11(spark, folder):
    return generate.contrastive_statements(table_questions(spark, folder), order_cells(spark, folder), seed=3)


@query(
    "g02_union_of_generators",
    f"{S.WITH_OT}, {QUESTIONS} SELECT 'question' AS kind, count(*) AS n FROM qs UNION ALL SELECT 'expression', count(*) * 9 FROM ot_tables",
)
def g02(spark, folder):
    asked = table_questions(spark, folder).select(F.lit("question").alias("kind"), F.col("question_id").alias("id"))
    made = D.expressions(spark, folder).select(F.lit("expression").alias("kind"), F.col("expr_id").alias("id"))
    return asked.unionByName(made).groupBy("kind").agg(F.count("*").alias("n"))


@query(
    "j12_interpretations",
    f"""{S.WITH_OT}, v AS (SELECT table_id, col, row, CAST(text AS DOUBLE) AS v, CAST(row_number() OVER (PARTITION BY table_id, col ORDER BY row) - 1 AS INTEGER) AS i, count(*) OVER (PARTITION BY table_id, col) AS n FROM ot_body WHERE col < 4),
    m AS (SELECT table_id, col, mask, list(row ORDER BY row) AS rows, sum(v) AS total, count(*) AS k FROM v JOIN (SELECT DISTINCT n, unnest(range(1, 1 << n)) AS mask FROM (SELECT DISTINCT n FROM v)) USING (n) WHERE (mask >> i) & 1 = 1 GROUP BY ALL),
    a AS (SELECT 'q' || table_id AS question_id, table_id, sum(v) / 2 AS f FROM v WHERE col = 0 GROUP BY ALL
      UNION ALL SELECT 'p' || table_id, table_id, sum(v) + 0.004 FROM v WHERE col = 1 AND row > 0 GROUP BY ALL),
    h AS (SELECT question_id, 'SUM' AS agg, col, rows FROM m JOIN a USING (table_id) WHERE abs(total - f) < 0.01 UNION ALL SELECT question_id, 'AVERAGE', col, rows FROM m JOIN a USING (table_id) WHERE abs(total / k - f) < 0.01
      UNION ALL SELECT question_id, 'NONE', 0, [0] FROM a WHERE question_id[1] = 'q')
    SELECT question_id, agg, col, array_to_string(rows, ',') AS rows FROM h""",
)
def j12(spark, folder):
    """Two answers per table: half the quantities, and all prices but the first line's; all rows and numeric columns are searched."""
    cells = materialize(order_cells(spark, folder, with_header=False))
    number = F.col("text").cast("double")
    half = cells.where("col = 0").groupBy("table_id").agg((F.sum(number) / 2).alias("float_answer")).select(F.concat(F.lit("q"), "table_id").alias("question_id"), "table_id", "float_answer")
    rest = cells.where("col = 1 AND row > 0").groupBy("table_id").agg((F.sum(number) + 0.004).alias("float_answer")).select(F.concat(F.lit("p"), "table_id").alias("question_id"), "table_id", "float_answer")
    asked = materialize(half.unionByName(rest))
    given = half.select("question_id", F.lit(0).alias("row"), F.lit(0).alias("col"))
    found = generate.interpretations(asked, cells, given, most=None)
    return found.select("question_id", "agg", "col", F.array_join(F.col("rows").cast("array<string>"), ",").alias("rows"))


@query(
    "j13_noisy_coordinates",
    f"""{S.WITH_OT}, {D.SELECTIONS}, gold AS (SELECT question_id, table_id, count(*) AS wanted, list(row) AS rows, list(col) AS cols FROM sel_c GROUP BY ALL),
    pool AS (SELECT g.question_id, g.table_id, b.row, b.col, row_number() OVER (PARTITION BY question_id ORDER BY sha256('9|' || question_id || '|' || b.row || '|' || b.col), b.row, b.col) - 1 AS k, count(*) OVER (PARTITION BY question_id) AS n
      FROM ot_body b JOIN gold g USING (table_id) ANTI JOIN sel_c c ON c.question_id = g.question_id AND c.row = b.row AND c.col = b.col WHERE list_contains(rows, b.row) OR list_contains(cols, b.col)),
    wanted AS (SELECT question_id, CAST(unnest(range(wanted)) AS INTEGER) AS ix FROM gold)
    SELECT question_id, table_id, ix, row, col FROM wanted JOIN pool USING (question_id) WHERE k = ix % n""",
)
def j13(spark, folder):
    _, coords = D.selections(spark, folder)
    return generate.noisy_coordinates(coords, order_cells(spark, folder), "row_or_column", seed=9)


@query(
    "j17_expand_cells",
    """SELECT p_partkey AS table_id, col, CASE WHEN col = 1 THEN p_brand || ' ( ' || p_type || ' : ' || p_type || ' parts are common. )' ELSE p_name END AS text
    FROM part, (SELECT unnest([0, 1]) AS col)""",
)
def j17(spark, folder):
    part = read(spark, folder, "part")
    key = F.col("p_partkey").alias("table_id")
    cells = part.select(key, F.lit(0).alias("row"), F.posexplode(F.array("p_name", "p_brand")).alias("col", "text"))
    links = part.select(key, F.lit(0).alias("row"), F.lit(1).alias("col"), F.col("p_type").alias("identifier"))
    about = part.select("p_type").distinct().select(
        F.col("p_type").alias("identifier"),
        F.concat("p_type", F.lit(" parts are common. Nothing else matters here.")).alias("description"),
    )
    # The best sentence of each description for the question "which type is common".
    sentences = about.select(F.col("identifier").alias("corpus_id"), F.posexplode(text.sentences(F.col("description"))).alias("text_id", "text"))
    asked = about.select(F.col("identifier").alias("corpus_id"), F.lit("which parts are common").alias("query"))
    best = lexical.sentence_search(sentences, asked, n=1).join(sentences, ["corpus_id", "text_id"])
    picked = best.select(F.col("corpus_id").alias("identifier"), F.col("corpus_id").alias("title"), F.array("text").alias("picked"))
    return generate.expand_cells(cells, links, picked).select("table_id", "col", "text")


@query(
    "j18_answer_tables",
    f"""{S.WITH_OT}, {D.SELECTIONS}, x AS (SELECT question_id, table_id, text, row_number() OVER (PARTITION BY question_id ORDER BY row, col) - 1 AS ix FROM sel_c)
    SELECT question_id AS table_id, CAST(-1 AS INTEGER) AS row, CAST(ix AS INTEGER) AS col, '' AS text FROM x UNION ALL
    SELECT question_id, 0, ix, text || ' : title ' || document_title FROM x JOIN ot_tables USING (table_id)""",
)
def j18(spark, folder):
    _, coords = D.selections(spark, folder)
    listed = coords.groupBy("question_id", "table_id").agg(F.sort_array(F.collect_list(F.struct("row", "col"))).alias("c"))
    numbered = listed.select("question_id", "table_id", F.posexplode("c").alias("ix", "e")).select("question_id", "table_id", "ix", "e.row", "e.col")
    titles = order_tables(spark, folder).select("table_id", "document_title")
    links = coords.join(titles, "table_id").select("table_id", "row", "col", F.col("document_title").alias("identifier"))
    descriptions = titles.select(F.col("document_title").alias("identifier"), F.concat(F.lit("title "), "document_title").alias("description")).distinct()
    used = generate.referenced_descriptions(descriptions, links)
    return generate.answer_tables(numbered, order_cells(spark, folder, with_header=False), links, used)


@query(
    "j19_reader_examples",
    f"""WITH {KNN}, ch AS (SELECT query_id, table_id FROM knn WHERE rank <= 3 UNION SELECT query_id, table_id FROM gold),
    w AS (SELECT c.query_id, c.table_id, d.text AS cell, regexp_extract(a.text, '\\p{{L}}{{5,}}') AS a0, a.lang AS a1 FROM ch c JOIN documents d ON d.doc_id = c.table_id JOIN documents a ON a.doc_id = c.query_id)
    SELECT query_id AS example_id, w.table_id, CAST(g.table_id IS NOT NULL AS INTEGER) AS class_index, contains(cell, a0) OR contains(cell, a1) AS answer_in_table,
      CASE WHEN contains(cell, a0) OR NOT contains(cell, a1) THEN a0 ELSE a1 END AS main_answer FROM w LEFT JOIN gold g USING (query_id, table_id)""",
)
def j19(spark, folder):
    hits = neighbours(spark, folder).withColumnRenamed("query_id", "example_id")
    gold = golds(spark, folder).withColumnRenamed("query_id", "example_id")
    docs = read(spark, folder, "documents")
    cells = docs.select(F.col("doc_id").alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), "text")
    texts = F.posexplode(F.array(F.regexp_extract("text", r"\p{L}{5,}", 0), "lang")).alias("alt_index", "answer")
    asked = docs.select(F.col("doc_id").alias("example_id"), texts).select("example_id", "alt_index", F.lit(0).alias("answer_ix"), F.col("answer").alias("text"))
    made = reader.reader_examples(reader.expand_candidates(hits, gold, 3), asked, cells)
    return made.select("example_id", "table_id", "class_index", "answer_in_table", F.col("answer_texts")[0].alias("main_answer"))


@query(
    "j20_lexical_neighbours",
    f"WITH {POSTINGS}, {BM25} SELECT CAST(question_id AS VARCHAR) AS query_id, rank, CAST(table_id AS VARCHAR) AS table_id, round(-score, 6) AS score FROM ranked WHERE rank <= 20",
)
def j20(spark, folder):
    import uuid

    from tabloom.operators.layout import shared_folder
    from tabloom.sources import neighbours as files

    scores = lexical.bm25_scores(lexical_questions(spark, folder), index(spark, folder))
    hits = lexical.retrieve(scores, 20).withColumnRenamed("question_id", "query_id")
    path = f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}"
    files.write_neighbours(hits, path)
    return files.read_neighbours(spark, path).withColumn("score", F.round("score", 6))
