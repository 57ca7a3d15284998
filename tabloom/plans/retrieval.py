"""Dense retrieval from raw vectors to scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabloom.operators import dense, metrics
from tabloom.operators.layout import materialize
from tabloom.operators.ranking import first_wins


def evaluate_dense(queries: DataFrame, tables: DataFrame, k: int = 100, cutoffs=metrics.CUTOFFS) -> tuple[DataFrame, DataFrame]:
    """(neighbours, metrics) of query and table vectors.

    queries (query_id, table_id, embedding) with one row per gold table are merged by
    query; of repeated tables (table_id, embedding, position) the last one counts. Queries
    with all gold tables in the corpus are scored.
    """
    merged = dense.merge_queries(queries)
    corpus = first_wins(tables, ["table_id"], [F.col("position").desc()]).select("table_id", "embedding")
    found = materialize(dense.nearest(merged.select("query_id", "embedding"), corpus, k))
    golds = merged.select("query_id", F.explode("table_ids").alias("table_id"))
    valid = metrics.queries_with_gold(golds, corpus, require_all=True)
    scored = metrics.judge(found.join(valid, "query_id", "left_semi"), golds)
    return found, metrics.ranking_metrics(scored, cutoffs)
