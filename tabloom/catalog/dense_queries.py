"""Dense retrieval over the embeddings, with their labels as relevance."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from tabloom.operators import dense, metrics, negatives
from tabloom.operators.layout import shared_folder
from tabloom.registry import query, read
from tabloom.sources import neighbours as files

K = 100


def vectors(spark, folder):
    v = read(spark, folder, "embeddings")
    queries = v.select(F.col("vec_id").alias("query_id"), "embedding")
    corpus = v.select(F.col("vec_id").alias("table_id"), "embedding")
    return queries, corpus


def neighbours(spark, folder, k=K):
    return dense.nearest(*vectors(spark, folder), k)


def golds(spark, folder):
    """Two gold tables per query: the first and the last vector of its label."""
    v = read(spark, folder, "embeddings").select("vec_id", "label")
    ends = v.groupBy("label").agg(F.min("vec_id").alias("lo"), F.max("vec_id").alias("hi"))
    return v.join(ends, "label").select(F.col("vec_id").alias("query_id"), F.explode(F.array("lo", "hi")).alias("table_id"))


KNN = """
pairs AS (SELECT a.vec_id AS query_id, b.vec_id AS table_id,
  round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 9) AS score FROM embeddings a, embeddings b),
knn AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, table_id) AS INTEGER) AS rank FROM pairs QUALIFY rank <= 100),
gold AS (SELECT DISTINCT e.vec_id AS query_id, unnest([lo, hi]) AS table_id FROM embeddings e
  JOIN (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label) USING (label)),
judged AS (SELECT k.*, g.table_id IS NOT NULL AS gold FROM knn k LEFT JOIN gold g USING (query_id, table_id))
"""


@query("c09_nearest", f"WITH {KNN} SELECT query_id, table_id, score, rank FROM knn")
def c09(spark, folder):
    return neighbours(spark, folder)


@query("c09_nearest_blocks", f"WITH {KNN} SELECT query_id, table_id, score, rank FROM knn WHERE rank <= 20")
def c09_blocks(spark, folder):
    """The path for a query side too large to broadcast."""
    return dense.nearest(*vectors(spark, folder), 20, max_broadcast=0)


@query("f01_dense_top_per_query", f"WITH {KNN} SELECT query_id, count(*) AS n, round(min(score), 6) AS lowest FROM knn GROUP BY query_id")
def f01(spark, folder):
    return neighbours(spark, folder).groupBy("query_id").agg(F.count("*").alias("n"), F.round(F.min("score"), 6).alias("lowest"))


@query(
    "c10_queries_with_gold",
    """SELECT vec_id AS query_id, lo IN (SELECT vec_id FROM embeddings WHERE label < 7) AND hi IN (SELECT vec_id FROM embeddings WHERE label < 7) AS all_present
    FROM embeddings JOIN (SELECT label, min(vec_id) AS lo, max(vec_id) AS hi FROM embeddings GROUP BY label) USING (label) WHERE label < 7""",
)
def c10(spark, folder):
    corpus = read(spark, folder, "embeddings").where("label < 7").select(F.col("vec_id").alias("table_id"))
    some = metrics.queries_with_gold(golds(spark, folder), corpus, require_all=False)
    every = metrics.queries_with_gold(golds(spark, folder), corpus, require_all=True).withColumn("all_present", F.lit(True))
    return some.join(every, "query_id", "left").select("query_id", F.coalesce("all_present", F.lit(False)).alias("all_present"))


@query(
    "d07_merge_queries",
    """WITH d AS (SELECT vec_id // 3 AS query_id, unnest(range(64)) AS i, unnest(embedding) AS x FROM embeddings),
    m AS (SELECT query_id, i, avg(CAST(x AS DOUBLE)) AS x FROM d GROUP BY ALL)
    SELECT query_id, string_agg(DISTINCT CAST(vec_id AS VARCHAR), ',' ORDER BY CAST(vec_id AS VARCHAR)) AS golds,
      any_value(s) AS total, any_value(f) AS first_value FROM (SELECT vec_id // 3 AS query_id, vec_id FROM embeddings)
      JOIN (SELECT query_id, round(sum(x), 6) AS s, round(max(CASE WHEN i = 0 THEN x END), 6) AS f FROM m GROUP BY query_id) USING (query_id) GROUP BY query_id""",
)
def d07(spark, folder):
    queries = read(spark, folder, "embeddings").select(
        F.floor(F.col("vec_id") / 3).alias("query_id"), F.col("vec_id").cast("string").alias("table_id"), "embedding"
    )
    merged = dense.merge_queries(queries)
    total = F.aggregate("embedding", F.lit(0.0), lambda acc, x: acc + x)
    return merged.select(
        "query_id",
        F.array_join("table_ids", ",").alias("golds"),
        F.round(total, 6).alias("total"),
        F.round(F.col("embedding")[0], 6).alias("first_value"),
    )


def _metrics(spark, folder, prefix):
    judged = metrics.judge(neighbours(spark, folder), golds(spark, folder))
    found = metrics.ranking_metrics(judged)
    return found.select(*[F.round(c, 6).alias(c) for c in found.columns if c.startswith(prefix)])


def _per_cutoff(template):
    return ", ".join(template.format(k=k) for k in metrics.CUTOFFS)


@query(
    "d08_hit_rate",
    f"""WITH {KNN}, q AS (SELECT query_id, {_per_cutoff('count_if(gold AND rank <= {k}) AS h{k}')} FROM judged GROUP BY query_id)
    SELECT {_per_cutoff('round(avg(CASE WHEN h{k} > 0 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_{k}')} FROM q""",
)
def d08(spark, folder):
    return _metrics(spark, folder, "hit_at")


@query(
    "d09_precision",
    f"""WITH {KNN}, q AS (SELECT query_id, {_per_cutoff('count_if(gold AND rank <= {k}) / {k}.0::DOUBLE AS h{k}')} FROM judged GROUP BY query_id)
    SELECT {_per_cutoff('round(avg(h{k}), 6) AS precision_at_{k}')} FROM q""",
)
def d09(spark, folder):
    return _metrics(spark, folder, "precision_at")


@query(
    "d10_ndcg",
    f"""WITH {KNN}, q AS (SELECT query_id, count_if(gold) AS hits, {_per_cutoff('sum(CASE WHEN gold AND rank <= {k} THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS d{k}')} FROM judged GROUP BY query_id),
    r AS (SELECT *, {_per_cutoff('list_sum(list_transform(range(1, CAST(least({k}, hits) + 1 AS BIGINT)), lambda i: 1 / log2(i + 1.0::DOUBLE))) AS i{k}')} FROM q)
    SELECT {_per_cutoff('round(avg(CASE WHEN hits > 0 THEN d{k} / i{k} ELSE 0 END), 6) AS ndcg_at_{k}')} FROM r""",
)
def d10(spark, folder):
    return _metrics(spark, folder, "ndcg_at")


@query(
    "d11_map",
    f"""WITH {KNN}, p AS (SELECT *, sum(CASE WHEN gold THEN 1 ELSE 0 END) OVER (PARTITION BY query_id ORDER BY rank) / rank::DOUBLE AS p FROM judged),
    q AS (SELECT query_id, {_per_cutoff('coalesce(avg(CASE WHEN gold AND rank <= {k} THEN p END), 0) AS a{k}')} FROM p GROUP BY query_id)
    SELECT {_per_cutoff('round(avg(a{k}), 6) AS map_at_{k}')} FROM q""",
)
def d11(spark, folder):
    return _metrics(spark, folder, "map_at")


@query(
    "a13_neighbour_file",
    f"WITH {KNN} SELECT CAST(query_id AS VARCHAR) AS query_id, rank, CAST(table_id AS VARCHAR) AS table_id, -score AS score FROM knn",
)
def a13(spark, folder):
    path = f"{shared_folder(spark)}/neighbours-{uuid.uuid4().hex}"
    files.write_neighbours(neighbours(spark, folder), path)
    return files.read_neighbours(spark, path)


@query(
    "a11_vector_file",
    "SELECT CAST(vec_id AS VARCHAR) AS vec_id, round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE))), 6) AS total FROM embeddings",
)
def a11(spark, folder):
    path = f"{shared_folder(spark)}/vectors-{uuid.uuid4().hex}"
    as_text = F.to_json(F.col("embedding").cast("array<double>"))
    read(spark, folder, "embeddings").select("vec_id", as_text.alias("embedding")).write.csv(path, sep="\t", header=True, quote="", escape="")
    got = files.read_vectors(spark, path, "vec_id", "embedding")
    return got.select("vec_id", F.round(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x), 6).alias("total"))


def _answer_word(column):
    return F.regexp_extract(column, r"\p{L}{5,}", 0)


MINE = f"""
{KNN},
ans AS (SELECT doc_id AS query_id, regexp_extract(text, '\\p{{L}}{{5,}}') AS word FROM documents),
cand AS (SELECT k.query_id, k.table_id, k.rank, -k.score AS score, word <> '' AND contains(d.text, word) AS holds
  FROM knn k JOIN ans a USING (query_id) JOIN documents d ON d.doc_id = k.table_id),
neg AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS place FROM cand WHERE query_id <> table_id AND NOT holds)
"""


@query(
    "c08_hard_negatives",
    f"""WITH {MINE} SELECT CAST(vec_id AS VARCHAR) AS question_id, coalesce(CAST(table_id AS VARCHAR), 'FAKE') AS table_id, 'BASELINE' AS type,
      coalesce(rank, 0) AS rank, round(coalesce(-score, 0.0), 6) AS score
    FROM embeddings LEFT JOIN (SELECT * FROM neg WHERE place <= 5) n ON n.query_id = vec_id""",
)
def c08(spark, folder):
    found = neighbours(spark, folder).select(
        F.col("query_id").alias("question_id"), "table_id", "rank", (-F.col("score")).alias("score")
    )
    docs = read(spark, folder, "documents")
    cells = docs.select(F.col("doc_id").alias("table_id"), F.lit(0).alias("row"), F.lit(0).alias("col"), "text")
    answers = docs.select(
        F.col("doc_id").alias("question_id"), F.lit(0).alias("alt_index"), F.lit(0).alias("answer_ix"), _answer_word("text").alias("text")
    ).where("text <> ''")
    questions = read(spark, folder, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("vec_id").alias("table_id"))
    return negatives.mine(questions, found, answers, cells, 5).withColumn("score", F.round("score", 6))


@query(
    "c07_neighbour_tables",
    f"WITH {KNN} SELECT query_id, table_id, rank, n_chars FROM knn JOIN documents ON doc_id = table_id",
)
def c07(spark, folder):
    tables = read(spark, folder, "documents").select(F.col("doc_id").alias("table_id"), "n_chars")
    return negatives.neighbours_with_tables(neighbours(spark, folder), tables).select("query_id", "table_id", "rank", "n_chars")


@query(
    "i12_vector_column_selection",
    """WITH c AS (SELECT label AS table_id, vec_id % 5 AS col, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
    cm AS (SELECT table_id, col, i, avg(CAST(x AS DOUBLE)) AS x FROM c GROUP BY ALL),
    q AS (SELECT vec_id % 20 AS question_id, label AS table_id, generate_subscripts(embedding, 1) AS i, unnest(embedding) AS x FROM embeddings),
    qm AS (SELECT question_id, table_id, i, avg(CAST(x AS DOUBLE)) AS x FROM q GROUP BY ALL)
    SELECT question_id, table_id, CAST(col AS INTEGER) AS col, round(sum(qm.x * cm.x) / sqrt(sum(qm.x * qm.x) * sum(cm.x * cm.x)), 6) AS score
    FROM qm JOIN cm USING (table_id, i) GROUP BY ALL""",
)
def i12(spark, folder):
    v = read(spark, folder, "embeddings")
    asked = v.select((F.col("vec_id") % 20).alias("question_id"), F.col("label").alias("table_id"), "embedding")
    columns = v.select(F.col("label").alias("table_id"), (F.col("vec_id") % 5).cast("int").alias("col"), "embedding")
    return dense.column_similarity(asked, columns).withColumn("score", F.round("score", 6))
