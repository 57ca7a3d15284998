"""Scores of predictions, structures, classes, slices and token sequences."""

from __future__ import annotations

from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabloom.catalog import derived as D
from tabloom.catalog import sqlparts as S
from tabloom.catalog.dense_queries import KNN, golds, neighbours
from tabloom.functions import hashing, text
from tabloom.model import order_cells, order_tables
from tabloom.operators import metrics, programs, qa, reader, reports
from tabloom.operators.ranking import top_k
from tabloom.registry import query, read


def _round(df, digits=6):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- predicted structures over the orders corpus: the prediction drops rows and changes aggregates by key.

STRUCTURES = f"""
{D.SELECTIONS},
pred_q AS (SELECT question_id, table_id, CASE WHEN {D.KEY} % 5 = 0 THEN 'COUNT' ELSE agg END AS agg FROM sel_q),
pred_c AS (SELECT * FROM sel_c WHERE {D.KEY} % 3 > 0 OR row > 0)
"""


def structures(spark, folder):
    questions, coords = D.selections(spark, folder)
    key = F.col("table_id").cast("bigint")
    predicted = questions.withColumn("agg", F.when(key % 5 == 0, "COUNT").otherwise(F.col("agg")))
    kept = coords.where((key % 3 > 0) | (F.col("row") > 0))
    return questions, coords, predicted, kept


_DENOTE = """
{n}_a AS (SELECT question_id, count(*) AS n, bool_and(regexp_matches(text, '^[0-9.]+$')) AS nums, sum(TRY_CAST(text AS DOUBLE)) AS total, list(text) AS texts FROM {c} GROUP BY question_id),
{n}_d AS (SELECT q.question_id, table_id, CASE WHEN agg = 'COUNT' THEN [CAST(CAST(coalesce(n, 0) AS DECIMAL(18,2)) AS VARCHAR)]
  WHEN agg = 'NONE' OR n IS NULL OR NOT nums THEN list_sort(coalesce(texts, [])) WHEN agg = 'SUM' THEN [CAST(CAST(total AS DECIMAL(18,2)) AS VARCHAR)]
  ELSE [CAST(CAST(total / n AS DECIMAL(18,4)) AS VARCHAR)] END AS d FROM {q} q LEFT JOIN {n}_a USING (question_id))
"""


@query(
    "d13_denotation_accuracy",
    f"""{S.WITH_OT}, {STRUCTURES}, {_DENOTE.format(n='g', c='sel_c', q='sel_q')}, {_DENOTE.format(n='p', c='pred_c', q='pred_q')},
    j AS (SELECT g.question_id, g.d = p.d AS ok, CAST({D.KEY.replace('table_id', 'g.table_id')} % 4 AS DOUBLE) / 4 AS weight FROM g_d g JOIN p_d p USING (question_id))
    SELECT round(avg(CAST(ok AS INTEGER)), 6) AS denotation_accuracy, round(avg(CASE WHEN ok THEN weight ELSE 0 END), 6) AS weighted_denotation_accuracy, count(*) AS n FROM j""",
)
def d13(spark, folder):
    questions, coords, predicted, kept = structures(spark, folder)
    cells = order_cells(spark, folder)
    gold = programs.denotations(questions, coords, cells).select("question_id", "table_id", F.col("denotation").alias("gold"))
    pred = programs.denotations(predicted, kept, cells).select("question_id", F.col("denotation").alias("pred"))
    ok = F.col("gold") == F.col("pred")
    weight = F.pmod(F.col("table_id").cast("bigint"), F.lit(4)) / 4
    return _round(
        gold.join(pred, "question_id").agg(
            metrics.accuracy(ok).alias("denotation_accuracy"),
            F.avg(F.when(ok, weight).otherwise(0.0)).alias("weighted_denotation_accuracy"),
            F.count("*").alias("n"),
        )
    )


_STRUCT_SQL = f"""{S.WITH_OT}, {STRUCTURES}, ex AS (SELECT g.question_id, g.agg AS gold_agg, p.agg AS pred_agg,
  coalesce(gc.c, []) AS gold_coords, coalesce(pc.c, []) AS pred_coords FROM sel_q g JOIN pred_q p USING (question_id)
  LEFT JOIN (SELECT question_id, list_sort(list((row, col))) AS c FROM sel_c GROUP BY 1) gc USING (question_id)
  LEFT JOIN (SELECT question_id, list_sort(list((row, col))) AS c FROM pred_c GROUP BY 1) pc USING (question_id))
"""


def structure_examples(spark, folder):
    questions, coords, predicted, kept = structures(spark, folder)

    def sets(c, name):
        return c.groupBy("question_id").agg(F.sort_array(F.collect_list(F.struct("row", "col"))).alias(name))

    none = F.array().cast("array<struct<row:int,col:int>>")
    return (
        questions.select("question_id", F.col("agg").alias("gold_agg"))
        .join(predicted.select("question_id", F.col("agg").alias("pred_agg")), "question_id")
        .join(sets(coords, "gold_coords"), "question_id", "left")
        .join(sets(kept, "pred_coords"), "question_id", "left")
        .withColumns({c: F.coalesce(c, none) for c in ("gold_coords", "pred_coords")})
    )


@query(
    "d14_structure_accuracy",
    f"""{_STRUCT_SQL} SELECT round(avg(CAST(gold_agg = pred_agg AS INTEGER)), 6) AS aggregation_acc, round(avg(CAST(gold_coords = pred_coords AS INTEGER)), 6) AS cell_acc,
      round(avg(CAST(gold_agg = pred_agg AND gold_coords = pred_coords AS INTEGER)), 6) AS joint_acc FROM ex""",
)
def d14(spark, folder):
    return _round(metrics.structure_metrics(structure_examples(spark, folder)))


LABELS = ["NONE", "SUM", "AVERAGE", "COUNT"]


@query(
    "d14_confusion",
    f"""{_STRUCT_SQL} SELECT gold_agg, {', '.join(f"count_if(pred_agg = '{a}') AS pred_{a.lower()}" for a in LABELS)} FROM ex GROUP BY gold_agg""",
)
def d14_confusion(spark, folder):
    table = metrics.confusion(structure_examples(spark, folder), "gold_agg", "pred_agg", LABELS)
    return table.select("gold_agg", *[F.col(a).alias(f"pred_{a.lower()}") for a in LABELS])


@query(
    "d14_class_f1",
    f"""{_STRUCT_SQL} SELECT label, round(2.0::DOUBLE * count_if(gold_agg = label AND pred_agg = label) / (count_if(gold_agg = label) + count_if(pred_agg = label)), 6) AS f1
    FROM ex, (SELECT unnest(['NONE','SUM','AVERAGE','COUNT']) AS label) GROUP BY label""",
)
def d14_f1(spark, folder):
    return _round(metrics.class_f1(structure_examples(spark, folder), "gold_agg", "pred_agg"))


@query(
    "d15_classification_accuracy",
    "SELECT round(avg(CAST(quality = CAST(n_chars > 1000 AS INTEGER) AS INTEGER)), 6) AS accuracy, count(*) AS n FROM labels JOIN documents USING (doc_id)",
)
def d15(spark, folder):
    guess = (F.col("n_chars") > 1000).cast("int")
    joined = read(spark, folder, "labels").join(read(spark, folder, "documents").select("doc_id", "n_chars"), "doc_id")
    return _round(joined.agg(metrics.accuracy(F.col("quality") == guess).alias("accuracy"), F.count("*").alias("n")))


# ---- end-to-end answers: four documents are the candidate tables of an example.

E2E = f"""
cand AS (SELECT doc_id // 4 AS example_id, doc_id AS candidate_id, CASE WHEN doc_id % 7 > 0 THEN source || ' the ' || lang END AS answer,
  CAST(n_chars % 97 AS DOUBLE) AS score, doc_id % 4 = 1 AND doc_id % 5 > 0 AS is_correct FROM documents),
ref AS (SELECT DISTINCT doc_id // 4 AS example_id, lang || ' ' || source AS reference FROM documents WHERE doc_id % 4 = 1 AND doc_id % 11 > 0),
kinds AS (SELECT DISTINCT doc_id // 4 AS example_id, CASE WHEN (doc_id // 4) % 2 = 0 THEN 'table' ELSE 'passage' END AS kind FROM documents),
pt AS (SELECT candidate_id, c.example_id, list_filter(string_split({S.qa_answer('answer')}, ' '), lambda t: t <> '') AS p, list_filter(string_split({S.qa_answer('reference')}, ' '), lambda t: t <> '') AS g,
   {S.qa_answer('answer')} = {S.qa_answer('reference')} AS em FROM cand c JOIN ref USING (example_id) WHERE answer IS NOT NULL),
sc AS (SELECT candidate_id, example_id, CAST(em AS INTEGER)::DOUBLE AS exact, CAST(len(list_filter(p, lambda t: list_contains(g, t))) AS DOUBLE) AS same, len(p) AS np, len(g) AS ng FROM pt),
s AS (SELECT candidate_id, example_id, exact, same / np AS precision, same / ng AS recall, CASE WHEN same = 0 THEN 0 ELSE 2 * (same / np) * (same / ng) / (same / np + same / ng) END AS f1 FROM sc),
best AS (SELECT c.example_id, c.answer, c.is_correct, s.exact, s.precision, s.recall, s.f1 FROM s JOIN cand c USING (candidate_id)
  QUALIFY row_number() OVER (PARTITION BY c.example_id ORDER BY score DESC, candidate_id) = 1),
ora AS (SELECT example_id, max(exact) AS oe, max(f1) AS of FROM s GROUP BY 1),
x AS (SELECT e.example_id, kind, r.example_id IS NOT NULL AS referenced, e.has_correct, b.example_id IS NOT NULL AS predicted, coalesce(b.answer, '') <> '' AS answered,
  coalesce(b.is_correct, FALSE) AS table_ok, coalesce(exact, 0) AS exact, coalesce(precision, 0) AS p, coalesce(recall, 0) AS r, coalesce(f1, 0) AS f1,
  CASE WHEN r.example_id IS NOT NULL THEN coalesce(oe, 0) END AS oe, CASE WHEN r.example_id IS NOT NULL THEN coalesce(of, 0) END AS of
  FROM (SELECT example_id, bool_or(is_correct) AS has_correct FROM cand GROUP BY 1) e LEFT JOIN (SELECT DISTINCT example_id FROM ref) r USING (example_id)
  LEFT JOIN best b USING (example_id) LEFT JOIN ora USING (example_id) LEFT JOIN kinds USING (example_id))
"""


def e2e_inputs(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", "lang", "source", "n_chars")
    example = F.floor(F.col("doc_id") / 4).alias("example_id")
    candidates = docs.select(
        example,
        F.col("doc_id").alias("candidate_id"),
        F.when(F.col("doc_id") % 7 > 0, F.concat_ws(" the ", "source", "lang")).alias("answer"),
        (F.col("n_chars") % 97).cast("double").alias("score"),
        ((F.col("doc_id") % 4 == 1) & (F.col("doc_id") % 5 > 0)).alias("is_correct"),
    )
    references = (
        docs.where("doc_id % 4 = 1 AND doc_id % 11 > 0")
        .select(example, qa.joined_answer(F.array("source", "lang", F.lit(""))).alias("reference"))
        .distinct()
    )
    kinds = docs.select(example).distinct().withColumn("kind", F.when(F.col("example_id") % 2 == 0, "table").otherwise("passage"))
    return candidates, references, kinds


@query(
    "d16_end_to_end",
    f"""WITH {E2E} SELECT round(count_if(table_ok) / count(*)::DOUBLE, 6) AS table_accuracy, round(count_if(table_ok) / count_if(predicted)::DOUBLE, 6) AS table_precision,
      round(count_if(table_ok) / count_if(referenced AND has_correct)::DOUBLE, 6) AS table_recall, round(avg(exact), 6) AS answer_accuracy,
      round(avg(exact) FILTER (predicted AND referenced AND kind = 'table'), 6) AS answer_accuracy_table, round(avg(exact) FILTER (predicted AND referenced AND kind = 'passage'), 6) AS answer_accuracy_passage,
      round(sum(exact) / count_if(answered), 6) AS answer_precision, round(avg(p), 6) AS answer_token_precision, round(avg(r), 6) AS answer_token_recall, round(avg(f1), 6) AS answer_token_f1,
      round(avg(f1) FILTER (predicted AND referenced AND kind = 'table'), 6) AS answer_token_f1_table, round(avg(f1) FILTER (predicted AND referenced AND kind = 'passage'), 6) AS answer_token_f1_passage,
      round(avg(of), 6) AS oracle_answer_token_f1, round(avg(oe), 6) AS oracle_answer_accuracy FROM x""",
)
def d16(spark, folder):
    return _round(qa.end_to_end_metrics(*e2e_inputs(spark, folder)))


@query(
    "d17_token_scores",
    f"""WITH b AS (SELECT doc_id, d.text, q.text AS ref FROM documents d JOIN benchmark q ON q.item_id = doc_id % 40),
    t AS (SELECT doc_id, {S.qa_answer('text')} AS p, {S.qa_answer('ref')} AS g FROM (SELECT doc_id, text, ref FROM b)),
    k AS (SELECT doc_id, token, sum(1 - side) AS g, sum(side) AS p FROM (SELECT doc_id, unnest(list_filter(string_split(p, ' '), lambda w: w <> '')) AS token, 1 AS side FROM t
      UNION ALL SELECT doc_id, unnest(list_filter(string_split(g, ' '), lambda w: w <> '')), 0 FROM t) GROUP BY ALL),
    s AS (SELECT doc_id, sum(least(g, p))::DOUBLE AS same, sum(g) AS ng, sum(p) AS np FROM k GROUP BY doc_id)
    SELECT t.doc_id, CAST(CAST(p = g AS INTEGER) AS DOUBLE) AS exact, round(CASE WHEN same = 0 THEN 0 ELSE same / np END, 6) AS precision, round(CASE WHEN same = 0 THEN 0 ELSE same / ng END, 6) AS recall,
      round(CASE WHEN same = 0 THEN 0 ELSE 2 * (same / np) * (same / ng) / (same / np + same / ng) END, 6) AS f1 FROM t JOIN s USING (doc_id)""",
)
def d17(spark, folder):
    docs = read(spark, folder, "documents").select("doc_id", F.col("text").alias("pred"), (F.col("doc_id") % 40).alias("item_id"))
    asked = read(spark, folder, "benchmark").select("item_id", F.col("text").alias("gold"))
    scored = qa.token_scores(docs.join(asked, "item_id").withColumnRenamed("doc_id", "pair_id"))
    return _round(scored.withColumnRenamed("pair_id", "doc_id"))


@query(
    "d18_oracle_scores",
    f"WITH {E2E} SELECT example_id, round(max(exact), 6) AS exact, round(max(f1), 6) AS f1 FROM s GROUP BY example_id",
)
def d18(spark, folder):
    candidates, references, _ = e2e_inputs(spark, folder)
    return _round(qa.score_candidates(candidates, references).groupBy("example_id").agg(F.max("exact").alias("exact"), F.max("f1").alias("f1")))


@query("e07_best_candidate", f"WITH {E2E} SELECT example_id, arg_max(candidate_id, (score, -candidate_id)) AS candidate_id, max(score) AS score FROM cand GROUP BY example_id")
def e07(spark, folder):
    candidates, _, _ = e2e_inputs(spark, folder)
    return reader.best_candidate(candidates, "example_id", "score", "candidate_id").select("example_id", "candidate_id", "score")


# ---- cell selection over the orders corpus.

CELLSEL = f"""
{STRUCTURES},
gold AS (SELECT q.question_id, coalesce(list((row, col)) FILTER (row IS NOT NULL), []) AS gold, coalesce(count_if(row % 2 = 0), 0) AS nt, coalesce(count_if(row % 2 = 1), 0) AS nx FROM sel_q q LEFT JOIN sel_c c USING (question_id) GROUP BY ALL),
kind AS (SELECT *, CASE WHEN nt > 0 AND nx > 0 THEN 'TABLE_AND_TEXT' WHEN nt = 0 AND nx = 0 THEN 'NO_ANSWER' WHEN nt = 1 THEN 'ONE_IN_TABLE' WHEN nx = 1 THEN 'ONE_IN_TEXT' WHEN nt > 0 THEN 'MANY_IN_TABLE' ELSE 'MANY_IN_TEXT' END AS kind FROM gold),
probs AS (SELECT 'q' || table_id AS question_id, table_id, row, col, ((row * 7 + col * 3 + {D.KEY}) % 10) / 10.0::DOUBLE AS prob FROM ot_body),
best AS (SELECT question_id, list((row, col) ORDER BY prob DESC, row, col) AS best, any_value({D.KEY}) % 6 > 0 AS seen FROM probs GROUP BY question_id),
chosen AS (SELECT question_id, list((row, col)) AS coords FROM probs WHERE prob > 0.75 GROUP BY question_id)
"""


def cell_selection_inputs(spark, folder):
    questions, coords = D.selections(spark, folder)
    none = F.array().cast("array<struct<row:int,col:int>>")
    gold = coords.groupBy("question_id").agg(
        F.collect_list(F.struct("row", "col")).alias("gold"),
        F.count_if(F.col("row") % 2 == 0).alias("nt"),
        F.count_if(F.col("row") % 2 == 1).alias("nx"),
    )
    zero = F.lit(0)
    asked = questions.select("question_id").join(gold, "question_id", "left").select(
        "question_id",
        qa.answer_kind(F.coalesce("nt", zero), F.coalesce("nx", zero)).alias("kind"),
        F.coalesce("gold", none).alias("gold"),
    )
    key = F.col("table_id").cast("bigint")
    probs = order_cells(spark, folder, with_header=False).select(
        F.concat(F.lit("q"), "table_id").alias("question_id"),
        "row",
        "col",
        (F.pmod(F.col("row") * 7 + F.col("col") * 3 + key, F.lit(10)) / 10.0).alias("prob"),
        (F.pmod(key, F.lit(6)) > 0).alias("seen"),
    )
    return asked, probs


@query(
    "d19_cell_selection",
    f"""{S.WITH_OT}, {CELLSEL}, j AS (SELECT kind, gold, CASE WHEN seen THEN coalesce(coords, []) ELSE [] END AS coords, CASE WHEN seen THEN best ELSE [] END AS best, seen FROM kind JOIN best USING (question_id) LEFT JOIN chosen USING (question_id)),
    m AS (SELECT kind, len(list_intersect(coords, gold)) AS hits, len(coords) AS n, seen, len(list_intersect(best[1:1], gold)) > 0 AS r1, len(list_intersect(best[1:3], gold)) > 0 AS r3, len(list_intersect(best[1:5], gold)) > 0 AS r5 FROM j)
    SELECT coalesce(kind, 'ALL') AS answer_kind, round(avg(CAST(hits > 0 AS INTEGER)), 6) AS recall, round(avg(CASE WHEN n > 0 THEN hits / n END), 6) AS precision, round(avg(CAST(n > 0 AS INTEGER)), 6) AS non_empty,
      round(avg(CAST(n AS DOUBLE)), 6) AS answer_len, round(avg(CAST(seen AS INTEGER)), 6) AS coverage, round(avg(CAST(r1 AS INTEGER)), 6) AS recall_at_1, round(avg(CAST(r3 AS INTEGER)), 6) AS recall_at_3, round(avg(CAST(r5 AS INTEGER)), 6) AS recall_at_5
    FROM m GROUP BY GROUPING SETS ((kind), ())""",
)
def d19(spark, folder):
    asked, probs = cell_selection_inputs(spark, folder)
    seen = probs.where("seen").drop("seen")
    best = qa.best_cells(seen)
    chosen = reader.cells_over(seen.withColumn("ix", F.lit(0)), 0.75)
    predictions = best.join(chosen, "question_id", "left")
    return _round(qa.cell_selection_metrics(asked, predictions))


@query(
    "f06_best_cells",
    f"{S.WITH_OT}, {CELLSEL} SELECT question_id, array_to_string(list_transform(best[1:5], lambda c: c[1] || ',' || c[2]), '|') AS cells FROM best",
)
def f06(spark, folder):
    _, probs = cell_selection_inputs(spark, folder)
    show = F.transform("best_cells", lambda c: F.concat_ws(",", c["row"].cast("string"), c["col"].cast("string")))
    return qa.best_cells(probs, 5).select("question_id", F.array_join(show, "|").alias("cells"))


@query(
    "g05_set_relation",
    f"""{S.WITH_OT}, {CELLSEL}, j AS (SELECT coalesce(coords, []) AS a, gold AS b FROM kind LEFT JOIN chosen USING (question_id))
    SELECT CASE WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 AND len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'same' WHEN len(list_filter(b, lambda x: NOT list_contains(a, x))) = 0 THEN 'superset'
      WHEN len(list_filter(a, lambda x: NOT list_contains(b, x))) = 0 THEN 'subset' ELSE 'disjoint' END AS relation, count(*) AS n FROM j GROUP BY 1""",
)
def g05(spark, folder):
    asked, probs = cell_selection_inputs(spark, folder)
    chosen = reader.cells_over(probs.withColumn("ix", F.lit(0)), 0.75)
    none = F.array().cast("array<struct<row:int,col:int>>")
    joined = asked.join(chosen, "question_id", "left").withColumn("coords", F.coalesce("coords", none))
    return joined.groupBy(qa.set_relation(F.col("coords"), F.col("gold")).alias("relation")).agg(F.count("*").alias("n"))


# ---- votes, slices, steps.


@query(
    "d20_majority_vote",
    """WITH v AS (SELECT user_id, list_position([value % 3, (value * 7) % 3, (value * 13) % 3], list_max([value % 3, (value * 7) % 3, (value * 13) % 3])) - 1 AS label FROM (SELECT user_id, CAST(floor(value) AS BIGINT) AS value FROM events)),
    c AS (SELECT user_id, label, count(*) AS n FROM v GROUP BY ALL) SELECT user_id, CAST(arg_max(label, (n, -label)) AS BIGINT) AS label FROM c GROUP BY user_id""",
)
def d20(spark, folder):
    v = F.floor("value")
    scores = F.array(v % 3, (v * 7) % 3, (v * 13) % 3)
    votes = read(spark, folder, "events").select("user_id", metrics.arg_max(scores).cast("bigint").alias("label"))
    return metrics.majority_label(votes, "user_id", "label")


@query(
    "d21_slice_analysis",
    f"""WITH ex AS (SELECT doc_id, quality = CAST(n_chars > 1000 AS INTEGER) AS ok, list_distinct(list_append({S.tokens('text')}, 'lang=' || lang)) AS f FROM labels JOIN documents USING (doc_id)),
    o AS (SELECT count(*) AS n, avg(CAST(ok AS INTEGER)) AS a FROM ex),
    p AS (SELECT feature, count(*) AS k, avg(CAST(ok AS INTEGER)) AS acc FROM (SELECT unnest(f) AS feature, ok FROM ex) GROUP BY feature),
    g AS (SELECT feature, k AS n, acc AS accuracy, round(k * (1 - acc) / o.n * (o.a - acc), 9) AS gain FROM p, o)
    SELECT feature, n, round(accuracy, 6) AS accuracy, gain FROM g""",
)
def d21(spark, folder):
    docs = read(spark, folder, "documents")
    features = F.array_append(text.format_and_tokenize(F.col("text")), F.concat(F.lit("lang="), "lang"))
    examples = read(spark, folder, "labels").join(docs, "doc_id").select(
        "doc_id", features.alias("features"), (F.col("quality") == (F.col("n_chars") > 1000).cast("int")).alias("ok")
    )
    ranked = metrics.slice_accuracy(examples, "features", "ok").withColumn("gain", F.round("gain", 9))
    return ranked.select("feature", "n", F.round("accuracy", 6).alias("accuracy"), "gain")


@query(
    "d23_conversion_report",
    """WITH r AS (SELECT source AS file, CASE WHEN n_chars < 300 THEN 'too short' WHEN lang = 'de' THEN 'language' END AS error FROM documents)
    SELECT file, CASE WHEN grouping(reason) = 0 THEN reason END AS reason, CASE WHEN grouping(file) = 1 THEN 'all' WHEN grouping(reason) = 1 THEN 'file' ELSE 'reason' END AS level,
      count(*) AS total, count_if(error IS NULL) AS valid, count_if(error IS NOT NULL) AS failed FROM (SELECT *, coalesce(error, '') AS reason FROM r) GROUP BY ROLLUP (file, reason)""",
)
def d23(spark, folder):
    error = F.when(F.col("n_chars") < 300, "too short").when(F.col("lang") == "de", "language")
    records = read(spark, folder, "documents").select(F.col("source").alias("file"), error.alias("error"))
    return reports.conversion_report(records)


@query(
    "d24_best_step",
    "WITH m AS (SELECT event_type, event_id AS step, floor(value / 10) AS v FROM events) SELECT event_type, arg_max(step, (v, step)) AS step FROM m GROUP BY event_type",
)
def d24(spark, folder):
    steps = read(spark, folder, "events").select("event_type", F.col("event_id").alias("step"), F.floor(F.col("value") / 10).alias("v"))
    return steps.groupBy("event_type").agg(F.max_by("step", F.struct("v", "step")).alias("step"))


@query("d24_best_step_overall", "WITH m AS (SELECT event_id AS step, floor(value / 10) AS v FROM events) SELECT arg_max(step, (v, step)) AS step FROM m")
def d24_overall(spark, folder):
    steps = read(spark, folder, "events").select(F.col("event_id").alias("step"), F.floor(F.col("value") / 10).alias("value"))
    return metrics.best_step(steps)


@query(
    "d26_answer_file_accuracy",
    f"""{S.WITH_OT}, {STRUCTURES}, g AS (SELECT q.question_id, list_sort(list(lower(text)) FILTER (text IS NOT NULL)) AS t FROM sel_q q LEFT JOIN sel_c USING (question_id) GROUP BY ALL),
    p AS (SELECT question_id, list_sort(list(lower(text))) AS t FROM pred_c GROUP BY ALL)
    SELECT round(avg(CAST(coalesce(g.t = p.t, FALSE) AS INTEGER)), 6) AS exact_match, count(*) AS n FROM g LEFT JOIN p USING (question_id) WHERE g.t IS NOT NULL""",
)
def d26(spark, folder):
    _, coords, _, kept = structures(spark, folder)
    cells = order_cells(spark, folder, with_header=False)

    def lists(c, f):
        return c.join(cells, ["table_id", "row", "col"]).groupBy("question_id").agg(F.collect_list(f("text")).alias("texts"))

    return _round(reports.answer_file_accuracy(lists(coords, F.upper), lists(kept, F.col)))


# ---- token sequences: 500 events in a row are the tokens of one question.

TOKENS = """
tok AS (SELECT event_id // 500 AS question_id, CAST(event_id % 500 AS BIGINT) AS ix, CAST((event_id % 500) // 50 AS INTEGER) AS row, CAST(((event_id % 500) // 5) % 10 AS INTEGER) AS col, value / (value + 50) AS prob FROM events)
"""


def tokens(spark, folder):
    at = F.pmod(F.col("event_id"), F.lit(500))
    return read(spark, folder, "events").select(
        F.floor(F.col("event_id") / 500).alias("question_id"),
        at.alias("ix"),
        F.floor(at / 50).cast("int").alias("row"),
        F.floor(F.pmod(at, F.lit(50)) / 5).cast("int").alias("col"),
        (F.col("value") / (F.col("value") + 50)).alias("prob"),
    )


@query(
    "e05_token_islands",
    f"""WITH {TOKENS}, o AS (SELECT *, ix - row_number() OVER (PARTITION BY question_id ORDER BY ix) AS run FROM tok WHERE prob > 0.4),
    r AS (SELECT question_id, min(ix) AS begin_ix, max(ix) + 1 AS end_ix, arg_min(row, ix) AS row, arg_min(col, ix) AS col, exp(avg(ln(prob))) AS score FROM o GROUP BY question_id, run),
    s AS (SELECT question_id, row, col, min(ix) AS start FROM tok GROUP BY ALL)
    SELECT question_id, begin_ix, end_ix, row, col, begin_ix - start AS begin_in_cell, end_ix - start AS end_in_cell, round(score, 6) AS score FROM r JOIN s USING (question_id, row, col)""",
)
def e05(spark, folder):
    runs = reader.token_islands(tokens(spark, folder), 0.4, chunk=64)
    return _round(runs.withColumnRenamed("begin", "begin_ix").withColumnRenamed("end", "end_ix"))


@query(
    "e06_cells_over_threshold",
    f"""WITH {TOKENS}, c AS (SELECT question_id, row, col FROM tok GROUP BY ALL HAVING avg(prob) > 0.4)
    SELECT question_id, string_agg(row || ',' || col, '|' ORDER BY col, row) AS cells FROM c GROUP BY question_id""",
)
def e06(spark, folder):
    show = F.transform("coords", lambda c: F.concat_ws(",", c["row"].cast("string"), c["col"].cast("string")))
    return reader.cells_over(tokens(spark, folder), 0.4).select("question_id", F.array_join(show, "|").alias("cells"))


@query(
    "e10_best_span",
    f"WITH {TOKENS} SELECT question_id, max((round(prob, 1), ix))[2] AS begin_ix, max((round(prob, 1), ix))[2] + 2 AS end_ix, max(round(prob, 1)) AS logit FROM tok GROUP BY question_id",
)
def e10(spark, folder):
    spans = tokens(spark, folder).select("question_id", F.round("prob", 1).alias("logit"), F.col("ix").alias("begin"), (F.col("ix") + 2).alias("end"))
    return reader.best_span(spans).withColumnRenamed("begin", "begin_ix").withColumnRenamed("end", "end_ix")


@query(
    "d25_segment_rollup",
    f"""WITH {TOKENS}, c AS (SELECT question_id, col, row, avg(prob) AS m FROM tok GROUP BY ALL)
    SELECT question_id, col, row, CASE WHEN grouping(row) = 0 THEN 'cell' WHEN grouping(col) = 0 THEN 'column' ELSE 'all' END AS level, round(avg(m), 6) AS mean, round(sum(m), 6) AS total, round(min(m), 6) AS low, round(max(m), 6) AS high
    FROM c GROUP BY GROUPING SETS ((question_id, col, row), (question_id, col), (question_id))""",
)
def d25(spark, folder):
    return _round(reader.segment_rollup(tokens(spark, folder)))


@query(
    "e08_previous_answer",
    """SELECT conv_id AS sequence_id, turn AS position, lag(CAST(length(text) % 5 AS VARCHAR) || ',' || CAST(turn % 3 AS VARCHAR)) OVER (PARTITION BY conv_id ORDER BY turn) AS previous FROM conversations""",
)
def e08(spark, folder):
    coord = F.struct((F.length("text") % 5).alias("row"), (F.col("turn") % 3).cast("int").alias("col"))
    questions = read(spark, folder, "conversations").select(
        F.col("conv_id").alias("sequence_id"), F.col("turn").alias("position"), F.array(coord).alias("coords")
    )
    first = F.col("previous")[0]
    return reader.previous_answers(questions).select(
        "sequence_id", "position", F.when(F.col("previous").isNotNull(), F.concat(first["row"].cast("string"), F.lit(","), first["col"].cast("string"))).alias("previous")
    )


@query(
    "b14_running_context",
    """SELECT conv_id AS sequence_id, turn AS position, md5(string_agg(text, ' ') OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING)) AS digest FROM conversations""",
)
def b14(spark, folder):
    questions = read(spark, folder, "conversations").select(F.col("conv_id").alias("sequence_id"), F.col("turn").alias("position"), "text")
    return reader.running_context(questions).select("sequence_id", "position", F.md5("context").alias("digest"))


# ---- reader candidates from dense neighbours.


@query(
    "c13_expand_candidates",
    f"""WITH {KNN}, ch AS (SELECT query_id, table_id FROM knn WHERE rank <= 5 UNION SELECT query_id, table_id FROM gold),
    n AS (SELECT query_id, table_id, row_number() OVER (PARTITION BY query_id ORDER BY table_id) - 1 AS ix FROM ch)
    SELECT query_id AS example_id, query_id || '-' || ix AS interaction_id, query_id || '-' || ix || '_0' AS question_id, table_id, CAST(g.table_id IS NOT NULL AS INTEGER) AS class_index, k.rank, k.score
    FROM n LEFT JOIN gold g USING (query_id, table_id) LEFT JOIN knn k USING (query_id, table_id)""",
)
def c13(spark, folder):
    hits = neighbours(spark, folder).withColumnRenamed("query_id", "example_id")
    gold = golds(spark, folder).withColumnRenamed("query_id", "example_id")
    return reader.expand_candidates(hits, gold, 5)


@query(
    "g04_gold_retrieved",
    f"""WITH {KNN}, t AS (SELECT query_id, list(table_id) AS ids FROM knn WHERE rank <= 10 GROUP BY 1), g AS (SELECT query_id, list(table_id) AS ids FROM gold GROUP BY 1)
    SELECT query_id, len(list_intersect(t.ids, g.ids)) > 0 AS any_gold, len(list_distinct(list_concat(t.ids, g.ids))) AS n_union FROM t JOIN g USING (query_id)""",
)
def g04(spark, folder):
    found = neighbours(spark, folder).where("rank <= 10").groupBy("query_id").agg(F.collect_set("table_id").alias("ids"))
    gold = golds(spark, folder).groupBy("query_id").agg(F.collect_set("table_id").alias("gold_ids"))
    return found.join(gold, "query_id").select(
        "query_id",
        (F.size(F.array_intersect("ids", "gold_ids")) > 0).alias("any_gold"),
        F.size(F.array_union("ids", "gold_ids")).alias("n_union"),
    )


@query("c12_predictions_examples", f"{S.WITH_OT}, {STRUCTURES} SELECT table_id || '-0_0' AS question_id, p.agg AS pred_agg, g.agg AS gold_agg FROM pred_q p JOIN sel_q g USING (table_id)")
def c12(spark, folder):
    questions, _, predicted, _ = structures(spark, folder)
    from tabloom.functions import ids

    key = ids.question_id(ids.sequence_id(F.col("id"), F.col("annotator")), F.col("position"))
    rows = predicted.select(F.col("table_id").alias("id"), F.lit("0").alias("annotator"), F.lit(0).alias("position"), F.col("agg").alias("pred_agg"))
    examples = questions.select(F.concat("table_id", F.lit("-0_0")).alias("question_id"), F.col("agg").alias("gold_agg"))
    return rows.withColumn("question_id", key).join(examples, "question_id").select("question_id", "pred_agg", "gold_agg")


# ---- sets and limits.


@query(
    "g01_union_of_splits",
    "SELECT CASE lang WHEN 'en' THEN 'train' WHEN 'fr' THEN 'dev' ELSE 'test' END AS split, doc_id FROM documents",
)
def g01(spark, folder):
    """Three inputs, by language, become one with a tag; together they are all documents."""
    docs = read(spark, folder, "documents").select("doc_id", "lang")
    inputs = {"train": F.col("lang") == "en", "dev": F.col("lang") == "fr", "test": F.coalesce(~F.col("lang").isin("en", "fr"), F.lit(True))}
    tagged = [docs.where(which).select(F.lit(split).alias("split"), "doc_id") for split, which in inputs.items()]
    return tagged[0].unionByName(tagged[1]).unionByName(tagged[2])


@query("g03_missing_predictions", f"{S.WITH_OT}, {STRUCTURES} SELECT question_id FROM sel_q WHERE question_id NOT IN (SELECT question_id FROM pred_c)")
def g03(spark, folder):
    questions, _, _, kept = structures(spark, folder)
    return reports.missing_ids(questions, kept)


@query(
    "g06_distinct_sets",
    f"""{S.WITH_OT} SELECT col, count(DISTINCT text) AS n_texts, (SELECT count(*) FROM (SELECT DISTINCT list_sort(list(text)) FROM ot_body b WHERE b.col = 4 GROUP BY table_id)) AS n_flag_sets FROM ot_body GROUP BY col""",
)
def g06(spark, folder):
    cells = order_cells(spark, folder, with_header=False)
    flags = cells.where("col = 4").groupBy("table_id").agg(F.sort_array(F.collect_list("text")).alias("flags")).select("flags").distinct()
    n_sets = flags.agg(F.count("*").alias("n")).scalar()
    return cells.select("col", "text").distinct().groupBy("col").agg(F.count("*").alias("n_texts")).withColumn("n_flag_sets", n_sets)


@query(
    "f04_seeded_sample",
    f"SELECT lang, doc_id FROM (SELECT lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY {S.fp64('lang || doc_id')}, doc_id) AS k FROM documents) WHERE k <= 50",
)
def f04(spark, folder):
    """Up to 50 documents per language in hash order."""
    docs = read(spark, folder, "documents").select("lang", "doc_id")
    order = [hashing.fingerprint64(F.concat("lang", F.col("doc_id").cast("string"))), F.col("doc_id")]
    return top_k(docs, ["lang"], order, 50).select("lang", "doc_id")


@query(
    "d27_counters",
    f"{S.WITH_OT} SELECT count(*) AS tables_seen, count_if(n_rows < 2) AS too_small, count_if(n_rows > 5) AS large FROM ot_tables",
)
def d27(spark, folder):
    seen = Observation("tables")
    counted = reports.with_counters(order_tables(spark, folder), seen, too_small=F.col("n_rows") < 2, large=F.col("n_rows") > 5)
    counted.write.format("noop").mode("overwrite").save()
    counts = seen.get
    return spark.createDataFrame([(counts["rows"], counts["too_small"], counts["large"])], "tables_seen long, too_small long, large long")
