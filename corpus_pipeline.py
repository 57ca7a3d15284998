"""The corpus pipeline: five stages from raw documents to token ids."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.llm import bpe, decontam, pii, quality, simhash
from tabloom.llm.common import free_name, row_keys, shared_folder, text_or_empty


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject, with all their columns.

    Null and empty texts are scored as one chunk of zeros; repeated rows and null ids are judged
    each by its text. An empty table stays empty; without labels every document stays.
    """
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = free_name(docs, "score")
    return quality.score(docs, network, into=score).where(F.col(score) >= quality.CUT).drop(score)


def one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of every component: the smallest id's, null ids last; of several texts with that id, the smallest hash's.

    Rows are told apart by id and text, so a repeated or null id neither drops nor keeps another
    component's row. Of rows equal in both, one stays.
    """
    keys = ["_row1", "_row2"]
    hashes = [k.alias(n) for k, n in zip(row_keys("doc_id", text_or_empty("text")), keys, strict=True)]
    keyed = docs.select(F.struct("*").alias("_doc"), *hashes)
    plain = docs.select("doc_id", "text", *hashes)
    classes = simhash.near_duplicates(plain.select("_row1", "text"), "_row1").select("_row1", "component_id").distinct()
    rows = plain.select("doc_id", *keys).distinct().join(classes, "_row1")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_row2", "_row1")).alias("first")
    kept = rows.groupBy("component_id").agg(first).select("first._row1", "first._row2")
    return keyed.join(kept, keys, "left_semi").dropDuplicates(keys).select("_doc.*")


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item, with all their columns.

    Null and empty texts hold none; repeated rows and null ids stay or go by their text. Without
    benchmark rows every document stays; an empty table stays empty.
    """
    hits = free_name(docs, "hits")
    marked = decontam.mark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), into=hits)
    return marked.where(F.size(hits) == 0).drop(hits)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced; n_chars follows the text, and is null where it is.

    Repeated rows and null ids stay, other columns pass unchanged; an empty table stays empty.
    """
    return pii.sanitise(docs).withColumn("n_chars", F.length("text").cast("long"))


def to_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document, one row for each given row.

    A null text counts as empty and has no ids; null ids stay null, other columns are left out;
    an empty table gives an empty result.
    """
    import public_tokenizers

    return bpe.digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("SimHash near-dedup", one_of_near_duplicates),
    ("benchmark decontamination", without_benchmarks),
    ("PII", without_personal_data),
    ("byte-level BPE", to_token_ids),
]

#: SQL cannot express the learned classifier or XXH64 with a seed; tests compare with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/llm/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for place, (_, stage) in enumerate(STAGES[:-1]):
        path = f"{folder}/{place}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
