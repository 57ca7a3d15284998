"""Question, statement and prediction files.

All readers take explicit schemas and return flat DataFrames. List literals inside
cells are read with regular expressions; no text is ever evaluated as code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import ids

_QUOTED = r"'((?:[^'\\]|\\.)*)'|\"((?:[^\"\\]|\\.)*)\""
COORD = "struct<row:int,col:int>"


def text_list(c: Column) -> Column:
    """Strings of a list literal such as ['a', u"b"]."""
    single = F.regexp_extract_all(c, F.lit(_QUOTED), 1)
    double = F.regexp_extract_all(c, F.lit(_QUOTED), 2)
    both = F.zip_with(single, double, lambda a, b: F.concat(a, b))
    return F.transform(both, lambda t: F.regexp_replace(t, r"\\(.)", "$1"))


def coordinate_list(c: Column) -> Column:
    """Sorted coordinates of a list literal of pair texts such as ['(0, 3)', '(1, 3)']."""
    pair = r"\(\s*(-?\d+)\s*,\s*(-?\d+)\s*\)"
    rows, cols = F.regexp_extract_all(c, F.lit(pair), 1), F.regexp_extract_all(c, F.lit(pair), 2)
    return F.sort_array(F.zip_with(rows, cols, lambda r, k: F.struct(r.cast("int").alias("row"), k.cast("int").alias("col"))))


def read_questions(spark: SparkSession, path: str) -> DataFrame:
    """Question TSV: (sequence_id, question_id, position, table_id, question, coords, texts, agg, float_value, class_index).

    Aggregates are upper-cased and blank ones are null; columns the file lacks are null.
    """
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"', inferSchema=False)

    def optional(name: str) -> Column:
        return F.nullif(F.trim(F.col(name)), F.lit("")) if name in raw.columns else F.lit(None).cast("string")

    sequence = ids.sequence_id(F.col("id"), F.col("annotator"))
    position = F.col("position").cast("int")
    return raw.select(
        sequence.alias("sequence_id"),
        ids.question_id(sequence, position).alias("question_id"),
        position.alias("position"),
        F.col("table_file").alias("table_id"),
        "question",
        coordinate_list(F.col("answer_coordinates")).alias("coords"),
        text_list(F.col("answer_text")).alias("texts"),
        F.upper(optional("aggregation")).alias("agg"),
        optional("float_answer").cast("float").alias("float_value"),
        optional("class_index").cast("int").alias("class_index"),
    )


def group_sequences(questions: DataFrame) -> DataFrame:
    """One row per sequence and table with its questions in order of position."""
    entry = F.struct("position", "question_id", "question", "coords", "texts", "agg", "float_value")
    return questions.groupBy("sequence_id", "table_id").agg(F.sort_array(F.collect_list(entry), asc=True).alias("questions"))


def read_answer_tail(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated questions whose answers fill the rest of the line."""
    f = F.split(F.rtrim("value"), "\t")
    return spark.read.text(path).select(
        f[0].alias("id"), f[1].alias("question"), f[2].alias("table_id"), F.slice(f, 4, 1 << 20).alias("texts")
    )


def read_answer_bars(spark: SparkSession, path: str) -> DataFrame:
    """Headered questions with answers separated by bars."""
    raw = spark.read.csv(path, sep="\t", header=True, quote="")
    return raw.select("id", F.col("utterance").alias("question"), F.col("context").alias("table_id"), F.split("targetValue", r"\|").alias("texts"))


def read_statements(spark: SparkSession, path: str) -> DataFrame:
    """JSON object of table file → [statements, labels, caption], as one row per statement.

    The keys are data, so the object is read as a map.
    """
    raw = spark.read.text(path, wholetext=True)
    parsed = raw.select(F.explode(F.from_json("value", "map<string,array<string>>")).alias("table_id", "parts"))
    statements = F.from_json(F.get(F.col("parts"), F.lit(0)), "array<string>")
    labels = F.from_json(F.get(F.col("parts"), F.lit(1)), "array<int>")
    pairs = F.posexplode(F.arrays_zip(statements.alias("statement"), labels.alias("label"))).alias("ix", "e")
    return parsed.select("table_id", F.get(F.col("parts"), F.lit(2)).alias("caption"), pairs).select(
        F.concat("table_id", F.lit("_"), F.col("ix").cast("string"), F.lit("-0_0")).alias("question_id"),
        "table_id", F.col("e.statement").alias("statement"), F.col("e.label").alias("class_index"), "caption",
    )


PROGRAM = "phase int, question string, table_id string, sql struct<sel:int,agg:int,conds:array<array<string>>>"


def read_programs(spark: SparkSession, path: str) -> DataFrame:
    """Program JSON lines as (question, table_id, agg, sel, conds array<struct<col,op,value>>)."""
    from tabloom.operators.programs import PROGRAM_AGGREGATES

    aggregates = F.array(*[F.lit(a) for a in PROGRAM_AGGREGATES])
    operators = F.array(F.lit("="), F.lit(">"), F.lit("<"))
    conds = F.transform(
        "sql.conds",
        lambda c: F.struct(c[0].cast("int").alias("col"), F.get(operators, c[1].cast("int")).alias("op"), c[2].alias("value")),
    )
    return spark.read.schema(PROGRAM).json(path).select(
        "question", "table_id", F.get(aggregates, F.col("sql.agg")).alias("agg"), F.col("sql.sel").alias("sel"), conds.alias("conds")
    )


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Prediction TSV; class logits may be one number or a list, and become an array."""
    raw = spark.read.csv(path, sep="\t", header=True, quote='"', escape='"')
    out = raw
    if "answer_coordinates" in raw.columns:
        out = out.withColumn("coords", coordinate_list(F.col("answer_coordinates")))
    if "logits_cls" in raw.columns:
        many = F.from_json("logits_cls", "array<double>")
        one = F.array(F.col("logits_cls").try_cast("double"))
        out = out.withColumn("logits", F.when(F.startswith(F.trim("logits_cls"), F.lit("[")), many).otherwise(one))
    return out
