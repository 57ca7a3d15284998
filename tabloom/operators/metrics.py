"""Scores of rankings, structures, classes and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

CUTOFFS = (1, 5, 10, 15, 50, 100)


def queries_with_gold(golds: DataFrame, corpus: DataFrame, require_all: bool) -> DataFrame:
    """query_ids whose gold tables are in the corpus: at least one of them, or all."""
    present = corpus.select("table_id").distinct().withColumn("_in", F.lit(True))
    seen = golds.join(present, "table_id", "left").groupBy("query_id").agg(
        F.bool_and(F.col("_in").isNotNull()).alias("all_in"), F.bool_or(F.col("_in").isNotNull()).alias("any_in")
    )
    return seen.where("all_in" if require_all else "any_in").select("query_id")


def judge(neighbours: DataFrame, golds: DataFrame) -> DataFrame:
    """Neighbours (query_id, table_id, rank) with a boolean `gold`."""
    marks = golds.select("query_id", "table_id").distinct().withColumn("gold", F.lit(True))
    return neighbours.join(marks, ["query_id", "table_id"], "left").withColumn("gold", F.coalesce("gold", F.lit(False)))


def ranking_metrics(judged: DataFrame, cutoffs=CUTOFFS) -> DataFrame:
    """One row: hit rate, precision, NDCG and MAP at each cutoff, averaged over queries.

    NDCG compares with the best order of what was retrieved, over the whole list;
    MAP averages precision over the hits that were retrieved. One shuffle by query.
    """
    running = Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    hit = F.col("gold").cast("int")
    seen = judged.withColumn("_prefix", F.sum(hit).over(running))
    per_query = [F.sum(hit).alias("hits"), F.count("*").alias("n")]
    for k in cutoffs:
        inside = F.col("gold") & (F.col("rank") <= k)
        per_query += [
            F.sum(F.when(inside, 1).otherwise(0)).alias(f"in_{k}"),
            F.sum(F.when(inside, 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias(f"dcg_{k}"),
            F.avg(F.when(inside, F.col("_prefix") / F.col("rank"))).alias(f"ap_{k}"),
        ]
    scored = seen.groupBy("query_id").agg(*per_query)
    out = []
    for k in cutoffs:
        ranks = F.sequence(F.lit(1), F.least(F.lit(k), F.col("hits")).cast("int"))
        ideal = F.when(
            F.col("hits") > 0, F.aggregate(ranks, F.lit(0.0), lambda acc, i: acc + 1.0 / F.log2(i + 1.0))
        )
        out += [
            F.avg((F.col(f"in_{k}") > 0).cast("double")).alias(f"hit_at_{k}"),
            F.avg(F.col(f"in_{k}") / F.least(F.lit(k), F.col("n"))).alias(f"precision_at_{k}"),
            F.avg(F.coalesce(F.col(f"dcg_{k}") / ideal, F.lit(0.0))).alias(f"ndcg_at_{k}"),
            F.avg(F.coalesce(f"ap_{k}", F.lit(0.0))).alias(f"map_at_{k}"),
        ]
    return scored.agg(*out)


def accuracy(correct: Column) -> Column:
    """Aggregate: share of true rows; null counts as wrong."""
    return F.avg(F.coalesce(correct, F.lit(False)).cast("double"))


def structure_metrics(examples: DataFrame) -> DataFrame:
    """One row: aggregate, cell-set and joint accuracy of predicted structures.

    examples (gold_agg, pred_agg, gold_coords, pred_coords); coordinate sets are arrays.
    """
    same_agg = F.col("gold_agg") == F.col("pred_agg")
    same_cells = F.sort_array(F.array_distinct("gold_coords")) == F.sort_array(F.array_distinct("pred_coords"))
    return examples.agg(
        accuracy(same_agg).alias("aggregation_acc"),
        accuracy(same_cells).alias("cell_acc"),
        accuracy(same_agg & same_cells).alias("joint_acc"),
    )


def confusion(examples: DataFrame, gold: str, pred: str, labels: list[str]) -> DataFrame:
    """Counts per gold label with one column per predicted label."""
    return examples.groupBy(gold).pivot(pred, labels).agg(F.count(F.lit(1))).na.fill(0)


def class_f1(examples: DataFrame, gold: str, pred: str) -> DataFrame:
    """(label, f1): 2 TP / (2 TP + FP + FN), from one pass over the examples."""
    sides = F.explode(
        F.array(
            F.struct(F.col(gold).alias("label"), F.lit(1).alias("g"), F.lit(0).alias("p")),
            F.struct(F.col(pred).alias("label"), F.lit(0).alias("g"), F.lit(1).alias("p")),
        )
    )
    same = (F.col(gold) == F.col(pred)).cast("int")
    return (
        examples.select(same.alias("same"), sides.alias("s"))
        .groupBy("s.label")
        .agg(F.sum(F.col("same") * F.col("s.g")).alias("tp"), F.sum("s.g").alias("g"), F.sum("s.p").alias("p"))
        .select("label", (2.0 * F.col("tp") / (F.col("g") + F.col("p"))).alias("f1"))
    )


def majority_label(votes: DataFrame, key: str, label: str) -> DataFrame:
    """Most frequent label per key; ties go to the smaller label."""
    counts = votes.groupBy(key, label).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.max_by(label, F.struct(F.col("n"), -F.col(label))).alias(label))


def arg_max(scores: Column) -> Column:
    """Index from 0 of the largest element; the first one wins."""
    return F.array_position(scores, F.array_max(scores)) - 1


def best_step(metrics: DataFrame, metric: str = "value") -> DataFrame:
    """Step with the largest metric; ties go to the highest step."""
    return metrics.agg(F.max_by("step", F.struct(F.col(metric), F.col("step"))).alias("step"))


def slice_accuracy(examples: DataFrame, features: str, correct: str) -> DataFrame:
    """Accuracy per feature against the rest, ranked by what fixing the slice would gain.

    examples (example_id, features array<string>, correct boolean). headroom is the
    share of all examples that are wrong inside the slice; gap is how far the slice
    lies below the overall accuracy.
    """
    overall = examples.agg(F.count("*").alias("n"), F.avg(F.col(correct).cast("double")).alias("a"))
    n_all, acc_all = overall.select("n").scalar(), overall.select("a").scalar()
    per = (
        examples.select(F.explode(F.array_distinct(features)).alias("feature"), F.col(correct).cast("double").alias("ok"))
        .groupBy("feature")
        .agg(F.count("*").alias("n"), F.avg("ok").alias("accuracy"))
    )
    headroom = F.col("n") * (1.0 - F.col("accuracy")) / n_all
    gap = acc_all - F.col("accuracy")
    return per.withColumns({"headroom": headroom, "gap": gap}).withColumn("gain", F.col("headroom") * F.col("gap"))
