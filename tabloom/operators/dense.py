"""Dense retrieval: exact inner-product neighbours and vector aggregates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.operators.ranking import top_k

# Copies of a vector must tie exactly, whatever the order of a floating sum.
SCORE_DIGITS = 9
MAX_BROADCAST_BYTES = 64 << 20
QUERY_BLOCK, CORPUS_BLOCK = 4096, 32768
# Scores that a task holds at once.
MAX_SCORES = 1 << 21
# Queries whose running results are merged at once.
RUNNING = 256


def dot(left: Column, right: Column) -> Column:
    """Inner product of two numeric arrays, in double precision."""
    products = F.zip_with(left, right, lambda a, b: a.cast("double") * b.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def mean_vectors(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """Element-wise mean of array vectors per key, combined before the shuffle."""
    from pyspark.ml.functions import array_to_vector, vector_to_array
    from pyspark.ml.stat import Summarizer

    as_vector = array_to_vector(F.col(vector).cast("array<double>"))
    return df.groupBy(*keys).agg(vector_to_array(Summarizer.mean(as_vector)).alias(vector))


def merge_queries(queries: DataFrame) -> DataFrame:
    """One row per query_id: mean embedding and the sorted union of its gold tables.

    queries (query_id, table_id, embedding), one row per gold table.
    """
    means = mean_vectors(queries, ["query_id"], "embedding")
    golds = queries.groupBy("query_id").agg(F.sort_array(F.collect_set("table_id")).alias("table_ids"))
    return means.join(golds, "query_id")


def _matrix(vectors: pd.Series) -> np.ndarray:
    return np.stack(vectors.to_numpy()).astype(np.float64)


def _best(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """Candidates of one block as flat arrays (query row, id, score): all ties of the k-th score included."""
    scores = queries @ vectors.T
    np.round(scores, SCORE_DIGITS, out=scores)
    if scores.shape[1] > k:
        border = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]
        rows, cols = np.nonzero(scores >= border[:, None])
    else:
        rows, cols = np.divmod(np.arange(scores.size), scores.shape[1])
    return rows, ids[cols], scores[rows, cols]


def _keep(rows: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int):
    """First k of each query row by falling score, then id."""
    order = np.lexsort((ids, -scores, rows))
    rows, ids, scores = rows[order], ids[order], scores[order]
    starts = np.searchsorted(rows, rows)
    kept = np.arange(len(rows)) - starts < k
    return rows[kept], ids[kept], scores[kept]


def _strips(n_queries: int, n_vectors: int) -> list[slice]:
    """Cuts of the query rows whose scores against n_vectors stay within MAX_SCORES."""
    step = max(1, MAX_SCORES // max(1, n_vectors))
    return [slice(start, start + step) for start in range(0, n_queries, step)]


def _search(queries: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int):
    """First k of each query row, a strip of queries at a time: (query row, id, score)."""
    parts = []
    for strip in _strips(len(queries), len(vectors)):
        rows, found, scores = _keep(*_best(queries[strip], ids, vectors, k), k)
        parts.append((rows + strip.start, found, scores))
    return tuple(np.concatenate(column) for column in zip(*parts))


def _id_array(series: pd.Series) -> np.ndarray:
    return np.array(series.tolist())


def nearest(queries: DataFrame, corpus: DataFrame, k: int = 100, max_broadcast: int = MAX_BROADCAST_BYTES) -> DataFrame:
    """(query_id, table_id, score, rank): the k largest inner products of each query; ties by table id.

    queries (query_id, embedding), corpus (table_id, embedding). The size of the
    query side is measured first: if it and k results a query take up to
    max_broadcast bytes, it is sent to all tasks, which keep a running top k over
    their part of the corpus. Beyond that both sides are cut into blocks and each
    pair of blocks is one group, so that no task holds more than two blocks. Either
    way scores are made for MAX_SCORES pairs at a time, and at most k rows per query
    leave a task or group.
    """
    query_type, table_type = queries.schema["query_id"].dataType, corpus.schema["table_id"].dataType
    schema = f"query_id {query_type.simpleString()}, table_id {table_type.simpleString()}, score double"
    n, dim = queries.agg(F.count("*"), F.max(F.size("embedding"))).first()
    if not n:
        partial = queries.sparkSession.createDataFrame([], schema)
    elif n * (dim + 3 * k) * 8 <= max_broadcast:
        partial = _by_broadcast(queries, corpus, k, schema)
    else:
        partial = _by_blocks(queries, corpus, k, schema, n)
    return top_k(partial, ["query_id"], [F.col("score").desc(), F.col("table_id")], k)


def _by_broadcast(queries: DataFrame, corpus: DataFrame, k: int, schema: str) -> DataFrame:
    small = queries.select("query_id", "embedding").toPandas()
    shared = queries.sparkSession.sparkContext.broadcast((small["query_id"].tolist(), _matrix(small["embedding"])))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        query_ids, matrix = shared.value
        kept = {}
        for batch in batches:
            if not len(batch):
                continue
            ids, vectors = _id_array(batch["table_id"]), _matrix(batch["embedding"])
            for start in range(0, len(matrix), RUNNING):
                found = _search(matrix[start : start + RUNNING], ids, vectors, k)
                if start in kept:
                    found = _keep(*(np.concatenate(pair) for pair in zip(kept[start], found)), k)
                kept[start] = found
        for start, (rows, ids, scores) in kept.items():
            yield pd.DataFrame({"query_id": [query_ids[start + r] for r in rows], "table_id": ids, "score": scores})

    return corpus.select("table_id", "embedding").mapInPandas(scan, schema)


def _by_blocks(queries: DataFrame, corpus: DataFrame, k: int, schema: str, n_queries: int) -> DataFrame:
    n_corpus = corpus.count()
    query_blocks = -(-n_queries // QUERY_BLOCK)
    corpus_blocks = max(1, -(-n_corpus // CORPUS_BLOCK))
    left = queries.select(
        "query_id",
        "embedding",
        F.pmod(F.xxhash64("query_id"), F.lit(query_blocks)).alias("qb"),
        F.explode(F.sequence(F.lit(0), F.lit(corpus_blocks - 1))).alias("cb"),
    )
    right = corpus.select(
        "table_id",
        "embedding",
        F.pmod(F.xxhash64("table_id"), F.lit(corpus_blocks)).cast("int").alias("cb"),
        F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(query_blocks - 1).cast("bigint"))).alias("qb"),
    )

    def cell(some_queries: pd.DataFrame, some_tables: pd.DataFrame) -> pd.DataFrame:
        if not len(some_queries) or not len(some_tables):
            return pd.DataFrame({"query_id": [], "table_id": [], "score": []})
        rows, ids, scores = _search(
            _matrix(some_queries["embedding"]), _id_array(some_tables["table_id"]), _matrix(some_tables["embedding"]), k
        )
        return pd.DataFrame({"query_id": some_queries["query_id"].to_numpy()[rows], "table_id": ids, "score": scores})

    return left.groupBy("qb", "cb").cogroup(right.groupBy("qb", "cb")).applyInPandas(cell, schema)


def column_similarity(question_vectors: DataFrame, column_vectors: DataFrame) -> DataFrame:
    """Cosine of the mean question vector and the mean vector of each column.

    question_vectors (question_id, table_id, embedding), one row per token;
    column_vectors (table_id, col, embedding), one row per token.
    """
    asked = mean_vectors(question_vectors, ["question_id", "table_id"], "embedding").withColumnRenamed("embedding", "q")
    columns = mean_vectors(column_vectors, ["table_id", "col"], "embedding").withColumnRenamed("embedding", "c")
    q, c = F.col("q"), F.col("c")
    norm = F.sqrt(dot(q, q) * dot(c, c))
    return asked.join(columns, "table_id").select(
        "question_id", "table_id", "col", F.when(norm > 0, dot(q, c) / norm).otherwise(F.lit(0.0)).alias("score")
    )
