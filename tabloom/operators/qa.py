"""End-to-end question answering scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions import text


def joined_answer(texts: Column) -> Column:
    """One text from answer texts: sorted, blanks dropped, joined by spaces."""
    return F.array_join(F.sort_array(F.filter(texts, lambda t: t != "")), " ")


def token_scores(pairs: DataFrame) -> DataFrame:
    """(pair_id, exact, precision, recall, f1) of pairs (pair_id, gold, pred).

    Tokens are counted per pair and token, so that the work grows with the number
    of tokens and long texts are not compared token by token.
    """
    gold, pred = text.normalize_qa_answer(F.col("gold")), text.normalize_qa_answer(F.col("pred"))
    prepared = pairs.select("pair_id", gold.alias("gold"), pred.alias("pred"))
    sides = F.array(
        F.struct(text.words(F.col("gold")).alias("tokens"), F.lit(1).alias("g"), F.lit(0).alias("p")),
        F.struct(text.words(F.col("pred")).alias("tokens"), F.lit(0).alias("g"), F.lit(1).alias("p")),
    )
    tokens = (
        prepared.select("pair_id", F.explode(sides).alias("s"))
        .select("pair_id", F.explode("s.tokens").alias("token"), "s.g", "s.p")
        .groupBy("pair_id", "token")
        .agg(F.sum("g").alias("g"), F.sum("p").alias("p"))
        .groupBy("pair_id")
        .agg(F.sum(F.least("g", "p")).alias("same"), F.sum("g").alias("n_gold"), F.sum("p").alias("n_pred"))
    )
    exact = prepared.select("pair_id", (F.col("gold") == F.col("pred")).cast("double").alias("exact"))
    same, n_gold, n_pred = (F.coalesce(c, F.lit(0)) for c in ("same", "n_gold", "n_pred"))
    precision = F.when(n_pred > 0, same / n_pred).otherwise(F.lit(1.0))
    recall = F.when(n_gold > 0, same / n_gold).otherwise(F.lit(1.0))
    scored = exact.join(tokens, "pair_id", "left").select("pair_id", "exact", precision.alias("p"), recall.alias("r"))
    nothing = F.col("p") + F.col("r") < 1e-5
    return scored.select(
        "pair_id",
        "exact",
        F.when(nothing, 0.0).otherwise(F.col("p")).alias("precision"),
        F.when(nothing, 0.0).otherwise(F.col("r")).alias("recall"),
        F.when(nothing, 0.0).otherwise(2.0 * F.col("p") * F.col("r") / (F.col("p") + F.col("r"))).alias("f1"),
    )


def best_reference(scores: DataFrame, keys: list[str]) -> DataFrame:
    """Scores against the reference with the largest F1; equal F1 prefers an exact match."""
    order = F.struct("f1", "exact", "precision")
    best = scores.groupBy(*keys).agg(F.max_by(F.struct("exact", "precision", "recall", "f1"), order).alias("s"))
    return best.select(*keys, "s.*")


def score_candidates(candidates: DataFrame, references: DataFrame) -> DataFrame:
    """Every answered candidate against its example's references.

    candidates (example_id, candidate_id, answer, score, is_correct), references
    (example_id, reference).
    """
    answered = candidates.where("answer is not null")
    pairs = answered.join(references, "example_id").withColumn("pair_id", F.struct("example_id", "candidate_id", "reference"))
    scored = token_scores(pairs.select("pair_id", F.col("reference").alias("gold"), F.col("answer").alias("pred")))
    flat = scored.select("pair_id.example_id", "pair_id.candidate_id", "exact", "precision", "recall", "f1")
    return answered.join(best_reference(flat, ["example_id", "candidate_id"]), ["example_id", "candidate_id"])


def end_to_end_metrics(candidates: DataFrame, references: DataFrame, kinds: DataFrame | None = None) -> DataFrame:
    """One row with the fourteen retrieval-and-reading scores.

    candidates (example_id, candidate_id, answer, score, is_correct): all tables offered
    for an example, answer null when nothing was predicted. references (example_id,
    reference). kinds (example_id, kind) with 'table' or 'passage' fills the subset
    scores, which leave out examples without a prediction. Examples without references count as zero; averages over nothing are 1.
    """
    scored = score_candidates(candidates, references)
    # The best score; among equals the smaller candidate.
    pick = F.struct((-F.col("score")).alias("score"), F.col("candidate_id"))
    best = scored.groupBy("example_id").agg(
        F.min_by(F.struct("answer", "is_correct", "exact", "precision", "recall", "f1"), pick).alias("b"),
        F.max("exact").alias("oracle_exact"),
        F.max("f1").alias("oracle_f1"),
    )
    has_reference = references.select("example_id").distinct().withColumn("referenced", F.lit(True))
    # An example with references but no prediction is scored as an empty answer.
    blank = best_reference(
        token_scores(
            references.join(best, "example_id", "left_anti").select(
                F.struct("example_id", "reference").alias("pair_id"), F.col("reference").alias("gold"), F.lit("").alias("pred")
            )
        ).withColumn("example_id", F.col("pair_id.example_id")),
        ["example_id"],
    ).select("example_id", F.struct("exact", "precision", "recall", "f1").alias("blank"))
    examples = candidates.groupBy("example_id").agg(F.bool_or("is_correct").alias("has_correct"))
    wide = examples.join(has_reference, "example_id", "left").join(best, "example_id", "left").join(blank, "example_id", "left")
    if kinds is not None:
        wide = wide.join(kinds, "example_id", "left")
    else:
        wide = wide.withColumn("kind", F.lit(None).cast("string"))
    referenced = F.coalesce("referenced", F.lit(False))

    def score(name: str) -> Column:
        return F.when(referenced, F.coalesce(F.col("b")[name], F.col("blank")[name])).otherwise(0.0)

    wide = wide.select(
        "kind",
        referenced.alias("referenced"),
        "has_correct",
        F.col("b").isNotNull().alias("predicted"),
        (F.col("b").isNotNull() & (F.col("b")["answer"] != "")).alias("answered"),
        F.coalesce(F.col("b")["is_correct"], F.lit(False)).alias("table_ok"),
        *[score(n).alias(n) for n in ("exact", "precision", "recall", "f1")],
        F.when(referenced, F.coalesce("oracle_exact", F.lit(0.0))).alias("oracle_exact"),
        F.when(referenced, F.coalesce("oracle_f1", F.lit(0.0))).alias("oracle_f1"),
    )

    def mean(value: Column) -> Column:
        return F.coalesce(F.avg(value), F.lit(1.0))

    def ratio(top: Column, below: Column) -> Column:
        return F.when(below > 0, top / below).otherwise(F.lit(1.0))

    def subset(name: str, kind: str) -> Column:
        value = mean(F.when(F.col("predicted") & F.col("referenced") & (F.col("kind") == kind), F.col(name)))
        return value if kinds is not None else F.lit(None).cast("double")

    correct = F.count_if("table_ok")
    return wide.agg(
        ratio(correct, F.count("*")).alias("table_accuracy"),
        ratio(correct, F.count_if("predicted")).alias("table_precision"),
        ratio(correct, F.count_if(F.col("referenced") & F.col("has_correct"))).alias("table_recall"),
        mean(F.col("exact")).alias("answer_accuracy"),
        subset("exact", "table").alias("answer_accuracy_table"),
        subset("exact", "passage").alias("answer_accuracy_passage"),
        ratio(F.sum("exact"), F.count_if("answered")).alias("answer_precision"),
        mean(F.col("precision")).alias("answer_token_precision"),
        mean(F.col("recall")).alias("answer_token_recall"),
        mean(F.col("f1")).alias("answer_token_f1"),
        subset("f1", "table").alias("answer_token_f1_table"),
        subset("f1", "passage").alias("answer_token_f1_passage"),
        mean(F.col("oracle_f1")).alias("oracle_answer_token_f1"),
        mean(F.col("oracle_exact")).alias("oracle_answer_accuracy"),
    )


def answer_kind(n_table: Column, n_text: Column) -> Column:
    """Kind of a question by how many gold cells hold the answer themselves or through a link."""
    return (
        F.when((n_table > 0) & (n_text > 0), "TABLE_AND_TEXT")
        .when((n_table == 0) & (n_text == 0), "NO_ANSWER")
        .when(n_table == 1, "ONE_IN_TABLE")
        .when(n_text == 1, "ONE_IN_TEXT")
        .when(n_table > 0, "MANY_IN_TABLE")
        .otherwise("MANY_IN_TEXT")
    )


def cell_selection_metrics(questions: DataFrame, predictions: DataFrame) -> DataFrame:
    """Cell selection scores per answer kind and for ALL together.

    questions (question_id, kind, gold array<struct<row,col>>), predictions
    (question_id, coords, best_cells) with best_cells sorted by falling probability.
    """
    joined = questions.join(predictions.withColumn("seen", F.lit(1.0)), "question_id", "left")
    none = F.array().cast("array<struct<row:int,col:int>>")
    coords, best = F.coalesce("coords", none), F.coalesce("best_cells", none)
    hits = F.size(F.array_intersect(coords, F.col("gold")))
    n = F.size(coords)

    def hit_at(k: int) -> Column:
        return F.arrays_overlap(F.slice(best, 1, k), F.col("gold")).cast("double")

    flat = joined.select(
        "kind",
        (hits > 0).cast("double").alias("recall"),
        F.when(n > 0, hits / n).alias("precision"),
        (n > 0).cast("double").alias("non_empty"),
        n.cast("double").alias("answer_len"),
        F.coalesce("seen", F.lit(0.0)).alias("coverage"),
        *[hit_at(k).alias(f"recall_at_{k}") for k in (1, 3, 5)],
    )
    names = [c for c in flat.columns if c != "kind"]
    return flat.groupingSets([["kind"], []], "kind").agg(
        F.when(F.grouping("kind") == 1, "ALL").otherwise(F.first("kind")).alias("answer_kind"), *[F.avg(c).alias(c) for c in names]
    ).drop("kind")


def best_cells(probabilities: DataFrame, limit: int | None = None) -> DataFrame:
    """Cells of each question by falling mean token probability; ties by row, then column."""
    means = probabilities.groupBy("question_id", "row", "col").agg(F.avg("prob").alias("p"))
    ordered = F.sort_array(F.collect_list(F.struct((-F.col("p")).alias("np"), F.col("row"), F.col("col"))))
    cells = F.transform(ordered, lambda e: F.struct(e["row"].alias("row"), e["col"].alias("col")))
    return means.groupBy("question_id").agg((cells if limit is None else F.slice(cells, 1, limit)).alias("best_cells"))


def set_relation(found: Column, given: Column) -> Column:
    """How two coordinate sets lie to each other."""
    extra, lacking = F.size(F.array_except(found, given)), F.size(F.array_except(given, found))
    return (
        F.when((extra == 0) & (lacking == 0), "same")
        .when(lacking == 0, "superset")
        .when(extra == 0, "subset")
        .otherwise("disjoint")
    )
