"""Identifier grammar.

sequence id   example-annotator
question id   sequence_position
interaction   question id without its position
candidate     example/table-suffix
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabloom.functions.text import EMPTY_TEXT


def sequence_id(example_id: Column, annotator: Column) -> Column:
    """Joined id; an annotator holding a dash would make it ambiguous and is an error."""
    return F.when(
        F.contains(annotator.cast("string"), F.lit("-")),
        F.raise_error(F.lit("'-' not allowed in annotator")).cast("string"),
    ).otherwise(F.concat_ws("-", example_id.cast("string"), annotator.cast("string")))


def question_id(sequence: Column, position: Column) -> Column:
    return F.concat_ws("_", sequence, position.cast("string"))


def parse_question_id(c: Column) -> Column:
    """struct<example_id, annotator, position>; the last '_' and the last '-' before it split."""
    pattern = r"^(.*)-([^-]*)_([^_]*)$"
    return F.struct(
        F.regexp_extract(c, pattern, 1).alias("example_id"),
        F.regexp_extract(c, pattern, 2).alias("annotator"),
        F.regexp_extract(c, pattern, 3).try_cast("int").alias("position"),
    )


def padding_question_id() -> Column:
    return F.lit(f"{EMPTY_TEXT}-0_0")


def example_id(c: Column) -> Column:
    """Text before the last '/', or before the last '-' when there is no '/'."""
    return (
        F.when(F.contains(c, F.lit("/")), F.regexp_extract(c, r"^(.*)/[^/]*$", 1))
        .when(F.contains(c, F.lit("-")), F.regexp_extract(c, r"^(.*)-[^-]*$", 1))
        .otherwise(c)
    )


def interaction_of_question(c: Column) -> Column:
    """Question id without the part after its last '_'."""
    return F.when(F.contains(c, F.lit("_")), F.regexp_extract(c, r"^(.*)_[^_]*$", 1)).otherwise(c)


def candidate_id(example: Column, ith_table: Column | None = None, suffix: int = 0) -> Column:
    if ith_table is None:
        return F.concat(example, F.lit(f"-{suffix}"))
    return F.concat(example, F.lit("/"), ith_table.cast("string"), F.lit(f"-{suffix}"))


def answer_interaction_id(example: Column, answer_index: Column) -> Column:
    return F.concat_ws("_", example, answer_index.cast("string"))


def entity_title(link_id: Column) -> Column:
    """Readable title of a link: last path part, '_' to space, URL-decoded."""
    return F.url_decode(F.replace(F.substring_index(link_id, "/", -1), F.lit("_"), F.lit(" ")))


def url_version(url: Column, parameter: str = "oldid") -> Column:
    """Numeric query parameter of an HTML-escaped URL; 0 when absent."""
    query = F.regexp_extract(F.replace(url, F.lit("&amp;"), F.lit("&")), r"\?([^#]*)", 1)
    value = F.regexp_extract(query, rf"(?:^|&){parameter}=(\d+)", 1)
    return F.coalesce(value.try_cast("bigint"), F.lit(0).cast("bigint"))
