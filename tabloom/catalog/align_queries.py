"""Joins of questions, answers and tables over the orders corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabloom.catalog import derived as D
from tabloom.catalog import sqlparts as S
from tabloom.model import order_cells, order_tables
from tabloom.operators import align
from tabloom.registry import query, read

# Two answer groups per table: the texts of a cell pair of its own, and a pair with one foreign text.
ANSWERS = """
ans AS (SELECT 'q' || table_id AS question_id, table_id, CAST(0 AS INTEGER) AS alt_index, CAST(0 AS INTEGER) AS answer_ix, c6 AS text FROM ot_rows WHERE row = 0
  UNION ALL SELECT 'q' || table_id, table_id, 0, 1, CASE WHEN CAST(table_id AS BIGINT) % 3 = 0 THEN '-' ELSE c4 END FROM ot_rows WHERE row = 0
  UNION ALL SELECT 'q' || table_id, table_id, 1, 0, c1 FROM ot_rows WHERE row = 0
  UNION ALL SELECT 'q' || table_id, table_id, 2, 0, CASE WHEN CAST(table_id AS BIGINT) % 2 = 0 THEN 'nowhere' ELSE 'tax' END FROM ot_rows WHERE row = 0)
"""


def answers(spark, folder):
    rows = order_cells(spark, folder, with_header=False).where("row = 0").groupBy("table_id").pivot("col", [1, 4, 6]).agg(F.first("text"))
    key = F.col("table_id").cast("bigint")

    def entry(alt, ix, text):
        return F.struct(F.lit(alt), F.lit(ix), text).cast("struct<alt_index:int,answer_ix:int,text:string>")

    entries = F.explode(
        F.array(
            entry(0, 0, F.col("6")),
            entry(0, 1, F.when(key % 3 == 0, "-").otherwise(F.col("4"))),
            entry(1, 0, F.col("1")),
            entry(2, 0, F.when(key % 2 == 0, "nowhere").otherwise("tax")),
        )
    )
    return rows.select(F.concat(F.lit("q"), "table_id").alias("question_id"), entries.alias("e")).select("question_id", "e.*")


# Each question is asked of its own table and of the next order's table.
PAIRS = """
pairs AS (SELECT 'q' || table_id AS question_id, table_id FROM ot_tables
  UNION ALL SELECT 'q' || (CAST(table_id AS BIGINT) - 1), table_id FROM ot_tables)
"""


def pairs(spark, folder):
    tables = order_tables(spark, folder).select("table_id")
    before = (F.col("table_id").cast("bigint") - 1).cast("string")
    asked = F.explode(F.array("table_id", before))
    return tables.select(asked.alias("k"), "table_id").select(F.concat(F.lit("q"), "k").alias("question_id"), "table_id")


HITS = f"""
{ANSWERS}, {PAIRS},
hits AS (SELECT p.question_id, c.table_id, a.alt_index, a.answer_ix, a.text, c.row, c.col FROM pairs p JOIN ans a USING (question_id)
  JOIN ot_cells c ON c.table_id = p.table_id AND contains(c.text, a.text)),
groups AS (SELECT p.question_id, p.table_id, a.alt_index, bool_and(h.f IS NOT NULL) AS all_found, min(h.f) AS f
  FROM pairs p JOIN ans a USING (question_id) LEFT JOIN (SELECT question_id, table_id, alt_index, answer_ix, min((row, col)) AS f FROM hits GROUP BY ALL) h
    ON h.question_id = p.question_id AND h.table_id = p.table_id AND h.alt_index = a.alt_index AND h.answer_ix = a.answer_ix GROUP BY ALL)
"""


@query(
    "c01_question_tables",
    f"{S.WITH_OT}, {D.SELECTIONS} SELECT question_id, q.table_id, agg, document_title, n_rows FROM sel_q q JOIN ot_tables USING (table_id)",
)
def c01(spark, folder):
    questions, _ = D.selections(spark, folder)
    return align.with_tables(questions, order_tables(spark, folder)).select("question_id", "table_id", "agg", "document_title", "n_rows")


@query("c02_find_answers", f"{S.WITH_OT}, {HITS} SELECT question_id, table_id, alt_index, answer_ix, row, col FROM hits")
def c02(spark, folder):
    return align.find_answers(pairs(spark, folder), answers(spark, folder), order_cells(spark, folder)).drop("text")


def _places(literal: str) -> str:
    """SQL for (page_id, ix, at): every place of a literal in the pages."""
    parts = f"string_split(html, '{literal}')"
    return f"(SELECT page_id, i - 1 AS ix, list_sum(list_transform({parts}[:i], lambda x: length(x))) + (i - 1) * {len(literal)} AS at FROM (SELECT page_id, html, unnest(range(1, len({parts}))) AS i FROM pages))"


@query(
    "c03_contained_annotations",
    f"""WITH lists AS (SELECT b.page_id, b.ix, b.at AS lo, e.at + 5 AS hi FROM {_places("<ul>")} b JOIN {_places("</ul>")} e USING (page_id, ix)),
    links AS (SELECT b.page_id, b.ix, b.at AS lo, e.at + 4 AS hi FROM {_places("<a href")} b JOIN {_places("</a>")} e USING (page_id, ix))
    SELECT page_id, CAST(links.ix AS INTEGER) AS annotation_ix, CAST(lists.ix AS INTEGER) AS table_ix FROM links JOIN lists USING (page_id) WHERE lists.lo <= links.lo AND links.hi <= lists.hi""",
)
def c03(spark, folder):
    """Every link of a page against every list of it: a link belongs to the lists that hold both its tags."""
    pages = read(spark, folder, "pages").select("page_id", "html")

    def at(tag):
        return align.occurrences(pages, "page_id", "html", tag)

    def tags(first, last):
        ends = at(last).select("page_id", "ix", (F.col("at") + len(last)).alias("end"))
        return at(first).withColumnRenamed("at", "begin").join(ends, ["page_id", "ix"])

    spans = tags("<ul>", "</ul>").withColumnRenamed("ix", "table_ix")
    links = tags("<a href", "</a>").withColumnRenamed("ix", "annotation_ix")
    return align.contained_annotations(spans, links)


@query("c04_answerable", f"{S.WITH_OT}, {HITS} SELECT question_id, table_id FROM groups GROUP BY ALL HAVING bool_or(all_found)")
def c04(spark, folder):
    return align.answerable(pairs(spark, folder), answers(spark, folder), order_cells(spark, folder))


@query(
    "c05_group_answers",
    f"""{S.WITH_OT}, {HITS}, bad AS (SELECT DISTINCT question_id, alt_index FROM ans WHERE text IN ('', '-'))
    SELECT question_id, table_id, alt_index, CAST(row_number() OVER (PARTITION BY question_id, table_id ORDER BY alt_index) - 1 AS INTEGER) AS new_index
    FROM groups ANTI JOIN bad USING (question_id, alt_index) WHERE all_found""",
)
def c05(spark, folder):
    return align.group_answers(pairs(spark, folder), answers(spark, folder), order_cells(spark, folder))


MERGED = """
merged AS (SELECT table_id, last_id AS new_id FROM (SELECT table_id, first_value(table_id) OVER (PARTITION BY document_title ORDER BY version DESC, CAST(table_id AS BIGINT) DESC) AS last_id FROM ot_tables))
"""


def merged_tables(spark, folder):
    """Tables of one title merged into the newest, with the others as alternative ids."""
    tables = order_tables(spark, folder)
    version = F.regexp_extract("document_url", r"oldid=(\d+)", 1).cast("bigint")
    newest = F.max_by("table_id", F.struct(version, F.col("table_id").cast("bigint")))
    return tables.groupBy("document_title").agg(newest.alias("table_id"), F.collect_set("table_id").alias("ids")).select(
        "table_id", F.array_except("ids", F.array("table_id")).alias("alt_ids")
    )


@query(
    "c06_redirect_and_check",
    f"""{S.WITH_OT}, {ANSWERS}, {MERGED}, moved AS (SELECT 'q' || table_id AS question_id, new_id AS table_id FROM merged),
    found AS (SELECT m.question_id, m.table_id, a.alt_index, bool_and(h IS NOT NULL) AS ok FROM moved m JOIN ans a USING (question_id)
      LEFT JOIN (SELECT DISTINCT m.question_id, a.alt_index, a.answer_ix, TRUE AS h FROM moved m JOIN ans a USING (question_id) JOIN ot_cells c ON c.table_id = m.table_id AND contains(c.text, a.text)) h
      ON h.question_id = m.question_id AND h.alt_index = a.alt_index AND h.answer_ix = a.answer_ix GROUP BY ALL)
    SELECT question_id, table_id FROM found GROUP BY ALL HAVING bool_or(ok)""",
)
def c06(spark, folder):
    own = order_tables(spark, folder).select(F.concat(F.lit("q"), "table_id").alias("question_id"), "table_id")
    moved = align.redirect(own, merged_tables(spark, folder))
    return align.answerable(moved, answers(spark, folder), order_cells(spark, folder))


ALIGN_Q = """
aq AS (SELECT 'q' || table_id AS question_id, table_id, CAST(0 AS INTEGER) AS answer_ix, upper(c6) AS text FROM ot_rows WHERE row = 0
  UNION ALL SELECT 'q' || table_id, table_id, 1, lower(c4) || CASE WHEN CAST(table_id AS BIGINT) % 2 = 0 THEN '' ELSE '.' END FROM ot_rows WHERE row = 0)
"""


@query(
    "c15_align_answers",
    f"""{S.WITH_OT}, {ALIGN_Q},
    lv AS (SELECT question_id, table_id, answer_ix, unnest([0,1,2,3]) AS level, unnest([text, lower(text), array_to_string(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+)', 1), chr(1)), lower(regexp_replace(text, '\\.$', ''))]) AS norm FROM aq),
    cl AS (SELECT table_id, row, col, unnest([0,1,2,3]) AS level, unnest([text, lower(text), array_to_string(regexp_extract_all(lower(text), '([\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_\\s]+)', 1), chr(1)), lower(text)]) AS norm FROM ot_body),
    h AS (SELECT l.question_id, l.table_id, l.level, l.answer_ix, c.row, c.col FROM lv l LEFT JOIN cl c USING (table_id, level, norm)),
    claims AS (SELECT question_id, level, row, col, count(*) AS k FROM h WHERE row IS NOT NULL GROUP BY ALL),
    t AS (SELECT h.question_id, h.table_id, h.level, answer_ix, count(h.row) AS n, max(coalesce(k, 0)) AS k, min((h.row, h.col)) FILTER (h.row IS NOT NULL) AS cell FROM h LEFT JOIN claims c
      ON c.question_id = h.question_id AND c.level = h.level AND c.row = h.row AND c.col = h.col GROUP BY ALL),
    ok AS (SELECT question_id, min(level) AS level FROM (SELECT question_id, level FROM t GROUP BY ALL HAVING min(n) > 0 AND max(k) = 1) GROUP BY question_id)
    SELECT question_id, t.table_id, answer_ix, CAST(level AS INTEGER) AS level, CAST(cell[1] AS INTEGER) AS row, CAST(cell[2] AS INTEGER) AS col FROM t JOIN ok USING (question_id, level)""",
)
def c15(spark, folder):
    first = order_cells(spark, folder, with_header=False).where("row = 0").groupBy("table_id").pivot("col", [4, 6]).agg(F.first("text"))
    tail = F.when(F.col("table_id").cast("bigint") % 2 == 0, "").otherwise(".")
    texts = F.posexplode(F.array(F.upper("6"), F.concat(F.lower("4"), tail))).alias("answer_ix", "text")
    wanted = first.select(F.concat(F.lit("q"), "table_id").alias("question_id"), texts)
    questions = first.select(F.concat(F.lit("q"), "table_id").alias("question_id"), "table_id")
    return align.align_answers(questions, wanted, order_cells(spark, folder))


@query(
    "c16_linked_answers",
    """WITH cells AS (SELECT p_partkey AS table_id, CAST(0 AS INTEGER) AS row, CAST(0 AS INTEGER) AS col, p_name AS text FROM part UNION ALL SELECT p_partkey, 0, 1, p_brand FROM part),
    links AS (SELECT p_partkey AS table_id, CAST(0 AS INTEGER) AS row, CAST(1 AS INTEGER) AS col, p_type AS identifier FROM part),
    descr AS (SELECT DISTINCT p_type AS identifier, 'Parts of type ' || p_type || ' are common.' AS description FROM part),
    asked AS (SELECT p_partkey AS table_id, unnest(['red', p_type]) AS text FROM part),
    own AS (SELECT DISTINCT a.table_id, row, col, 'cell' AS source FROM asked a JOIN cells c ON a.table_id = c.table_id AND list_contains(regexp_split_to_array(c.text, '[^\\w]+'), a.text)),
    lk AS (SELECT DISTINCT a.table_id, row, col, 'description' AS source FROM asked a JOIN links USING (table_id) JOIN descr USING (identifier)
      WHERE list_contains(regexp_split_to_array(description, '[^\\w]+'), a.text) AND a.table_id NOT IN (SELECT table_id FROM own))
    SELECT table_id AS question_id, * FROM own UNION ALL SELECT table_id AS question_id, * FROM lk""",
)
def c16(spark, folder):
    part = read(spark, folder, "part")
    key = F.col("p_partkey")
    texts = F.posexplode(F.array("p_name", "p_brand")).alias("col", "text")
    cells = part.select(key.alias("table_id"), F.lit(0).alias("row"), texts)
    links = part.select(key.alias("table_id"), F.lit(0).alias("row"), F.lit(1).alias("col"), F.col("p_type").alias("identifier"))
    descriptions = part.select(F.col("p_type").alias("identifier")).distinct().withColumn(
        "description", F.concat(F.lit("Parts of type "), "identifier", F.lit(" are common."))
    )
    asked = part.select(key.alias("question_id"), F.explode(F.array(F.lit("red"), "p_type")).alias("text"))
    own = part.select(key.alias("question_id"), key.alias("table_id"))
    return align.linked_answers(own, asked, cells, links, descriptions)


@query(
    "c19_order_groups",
    f"""{S.WITH_OT}, {ANSWERS}, {PAIRS},
    hits AS (SELECT p.question_id, c.table_id, a.alt_index, a.answer_ix, min((c.row, c.col)) AS f FROM pairs p JOIN ans a USING (question_id)
      JOIN ot_body c ON c.table_id = p.table_id AND contains(c.text, a.text) GROUP BY ALL),
    g AS (SELECT p.question_id, p.table_id, a.alt_index, bool_and(h.f IS NOT NULL) AS all_found, min(h.f) AS f FROM pairs p JOIN ans a USING (question_id)
      LEFT JOIN hits h ON h.question_id = p.question_id AND h.table_id = p.table_id AND h.alt_index = a.alt_index AND h.answer_ix = a.answer_ix GROUP BY ALL)
    SELECT question_id, table_id, alt_index, all_found, CAST(row_number() OVER (PARTITION BY question_id, table_id
      ORDER BY all_found DESC, CASE WHEN all_found THEN f END, alt_index) - 1 AS INTEGER) AS place FROM g""",
)
def c19(spark, folder):
    return align.order_groups(pairs(spark, folder), answers(spark, folder), order_cells(spark, folder))


@query(
    "d28_repair_supervision",
    """WITH q AS (SELECT event_id AS question_id, CASE event_id % 4 WHEN 0 THEN [CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR)] WHEN 1 THEN [event_type] WHEN 2 THEN [event_type, props] ELSE [] END AS texts,
        CASE WHEN event_id % 3 > 0 THEN CAST(value AS FLOAT) END AS f, CAST(event_id % 5 = 0 AS INTEGER) AS n_coords FROM events),
    r AS (SELECT *, CASE WHEN f IS NOT NULL AND NOT coalesce(len(texts) = 1 AND CAST(TRY_CAST(texts[1] AS DOUBLE) AS FLOAT) = f, FALSE) THEN NULL ELSE texts END AS kept FROM q)
    SELECT question_id, coalesce(len(kept), 1) AS n_texts, round(CASE WHEN kept IS NULL THEN CAST(f AS DOUBLE) WHEN len(kept) = 1 THEN CAST(TRY_CAST(kept[1] AS DOUBLE) AS FLOAT)::DOUBLE END, 3) AS float_value,
      coalesce(len(kept), 1) > 0 AND (n_coords > 0 OR CASE WHEN kept IS NULL THEN TRUE WHEN len(kept) = 1 THEN TRY_CAST(kept[1] AS DOUBLE) IS NOT NULL ELSE FALSE END) AS valid FROM r""",
)
def d28(spark, folder):
    kind = F.col("event_id") % 4
    texts = (
        F.when(kind == 0, F.array(F.col("value").cast("decimal(18,2)").cast("string")))
        .when(kind == 1, F.array("event_type"))
        .when(kind == 2, F.array("event_type", "props"))
        .otherwise(F.array().cast("array<string>"))
    )
    questions = read(spark, folder, "events").select(
        F.col("event_id").alias("question_id"),
        texts.alias("texts"),
        F.when(F.col("event_id") % 3 > 0, F.col("value").cast("float")).alias("float_value"),
        (F.col("event_id") % 5 == 0).cast("int").alias("n_coords"),
    )
    fixed = align.repair_supervision(questions)
    return fixed.select(
        "question_id", F.size("texts").cast("bigint").alias("n_texts"), F.round(F.col("float_value").cast("double"), 3).alias("float_value"), "valid"
    )
