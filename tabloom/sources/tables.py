"""Table files: CSV, separated text, nested JSON, linked JSON and XML, all as long cells."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators.layout import materialize, spread


def read_csv_tables(spark: SparkSession, path: str, sep: str = ",", depth: int = 1) -> DataFrame:
    """One table per file, the first line is the header; cells named by the last `depth` parts of the file's path.

    Files are small and many, so each is read whole; quoted line breaks stay in their cell.
    """
    files = spark.read.text(path, wholetext=True).select(F.substring_index("_metadata.file_path", "/", -depth).alias("table_id"), "value")

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = [
                (table_id, r - 1, c, cell)
                for table_id, value in zip(batch["table_id"], batch["value"])
                for r, line in enumerate(csv.reader(io.StringIO(value), delimiter=sep))
                for c, cell in enumerate(line)
            ]
            yield pd.DataFrame(out, columns=["table_id", "row", "col", "text"])

    return files.mapInPandas(parse, "table_id string, row int, col int, text string")


TEXT = "struct<text:string>"
TABLE = (
    f"struct<tableId:string,documentTitle:string,documentUrl:string,columns:array<{TEXT}>,"
    f"rows:array<struct<cells:array<{TEXT}>>>,alternativeDocumentUrls:array<string>>"
)
NESTED = (
    f"id string, table {TABLE}, questions array<struct<id:string,originalText:string,answer:struct<answerTexts:string>>>"
)


def read_nested(spark: SparkSession, path: str) -> DataFrame:
    """Nested records (id, table, questions); answer texts stay as written, a list or its literal."""
    return spark.read.schema(NESTED).json(path)


def nested_tables(records: DataFrame) -> DataFrame:
    """(record_id, table_id, document_title, document_url, alt_urls, n_rows, n_cols); a null URL is blank."""
    t = F.col("table")
    return records.select(
        F.col("id").alias("record_id"),
        t["tableId"].alias("table_id"),
        t["documentTitle"].alias("document_title"),
        F.coalesce(t["documentUrl"], F.lit("")).alias("document_url"),
        F.coalesce(t["alternativeDocumentUrls"], F.array().cast("array<string>")).alias("alt_urls"),
        F.size(t["rows"]).alias("n_rows"),
        F.size(t["columns"]).alias("n_cols"),
    )


def nested_cells(records: DataFrame) -> DataFrame:
    """Cells of nested tables, header on row -1."""
    t = F.col("table")
    lines = F.concat(F.array(t["columns"]), F.transform(t["rows"], lambda r: r["cells"]))
    return (
        records.select(t["tableId"].alias("table_id"), F.posexplode(lines).alias("line", "cells"))
        .select("table_id", (F.col("line") - 1).alias("row"), F.posexplode("cells").alias("col", "c"))
        .select("table_id", "row", "col", "c.text")
    )


def nested_questions(records: DataFrame, split: str) -> DataFrame:
    """Questions of nested records with split-prefixed ids."""
    from tabloom.sources.questions import text_list

    interaction = F.concat_ws("_", F.lit(split), F.col("id"))
    raw = F.col("q.answer.answerTexts")
    as_json = F.from_json(raw, "array<string>")
    texts = F.when(as_json.isNotNull() & ~F.exists(as_json, lambda x: x.isNull()), as_json).otherwise(text_list(raw))
    return records.select(interaction.alias("interaction_id"), F.col("table.tableId").alias("table_id"), F.explode("questions").alias("q")).select(
        "interaction_id",
        F.concat_ws("_", "interaction_id", F.substring_index("q.id", "_", -1)).alias("question_id"),
        "table_id",
        F.col("q.originalText").alias("original_text"),
        texts.alias("texts"),
    )


def to_nested(questions: DataFrame, cells: DataFrame) -> DataFrame:
    """Questions and their tables as nested records; questions without a table drop out.

    questions (id, annotator, position, question, table_id, answer_text).
    """
    row = F.struct("col", F.struct("text").alias("c"))
    lines = cells.groupBy("table_id", "row").agg(F.transform(F.sort_array(F.collect_list(row)), lambda e: e["c"]).alias("cells"))
    tables = lines.groupBy("table_id").agg(F.sort_array(F.collect_list(F.struct("row", "cells"))).alias("lines"))
    table = F.struct(
        F.transform(F.element_at(F.filter("lines", lambda x: x["row"] == -1), 1)["cells"], lambda c: c).alias("columns"),
        F.transform(F.filter("lines", lambda x: x["row"] >= 0), lambda x: F.struct(x["cells"].alias("cells"))).alias("rows"),
        F.col("id").alias("tableId"),
        F.col("table_id").alias("documentTitle"),
        F.lit(None).cast("string").alias("documentUrl"),
        F.array().cast("array<string>").alias("alternativeDocumentUrls"),
    )
    key = F.concat_ws("_", "id", F.col("annotator").cast("string"), F.col("position").cast("string"))
    question = F.struct(key.alias("id"), F.col("question").alias("originalText"), F.struct(F.col("answer_text").alias("answerTexts")).alias("answer"))
    return questions.join(tables, "table_id").select("id", table.alias("table"), F.array(question).alias("questions"))


PAGES = (
    "example_id string, question_text string, document_title string, document_url string, document_html string, "
    "annotations array<struct<short_answers:array<struct<start_byte:int,end_byte:int>>>>"
)


def read_annotated_pages(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Annotated pages of several splits with a split column.

    Compressed lines cannot be split, so few files are spread over all cores after reading.
    """
    out = None
    for split, path in paths.items():
        part = spark.read.schema(PAGES).json(path).withColumn("split", F.lit(split))
        out = part if out is None else out.unionByName(part)
    return spread(out)


TYPED_TABLE = "id string, header array<string>, types array<string>, rows array<array<string>>"


def read_typed_tables(spark: SparkSession, path: str) -> DataFrame:
    """Typed table lines as cells (table_id, row, col, text, is_real, number)."""
    from tabloom.functions import numbers

    raw = spark.read.schema(TYPED_TABLE).json(path)
    lines = F.concat(F.array("header"), F.col("rows"))
    cells = raw.select(F.col("id").alias("table_id"), "types", F.posexplode(lines).alias("line", "cells")).select(
        "table_id", "types", (F.col("line") - 1).alias("row"), F.posexplode("cells").alias("col", "text")
    )
    is_real = F.coalesce(F.get(F.col("types"), F.col("col")) == "real", F.lit(False))
    number = F.when(is_real & (F.col("row") >= 0), numbers.convert_to_float(F.col("text")))
    return cells.select("table_id", "row", "col", "text", is_real.alias("is_real"), number.alias("number"))


LINKED = "uid string, title string, url string, header array<array<string>>, data array<array<array<string>>>"


def read_linked_tables(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Linked JSON tables, one per file, as (cells, links); link ids are URL-decoded and distinct."""
    # A file is one record up to a separator that JSON cannot hold: read as lines, a cell's inner list is cut out of
    # the record, while a multi-line file is opened at its place again for every one of them.
    raw = spark.read.schema(LINKED).json(path, lineSep="\0tabloom\0")
    lines = F.concat(F.array("header"), F.col("data"))
    each = raw.select(F.col("uid").alias("table_id"), F.posexplode(lines).alias("line", "cells")).select(
        "table_id", (F.col("line") - 1).alias("row"), F.posexplode("cells").alias("col", "cell")
    )
    cells = materialize(each)  # read for cells and for links, so that files are parsed once
    links = cells.select("table_id", "row", "col", F.explode(F.from_json(F.col("cell")[1], "array<string>")).alias("link"))
    decoded = links.select("table_id", "row", "col", F.url_decode("link").alias("identifier")).distinct()
    return cells.select("table_id", "row", "col", F.col("cell")[0].alias("text")), decoded


def unknown_links(links: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Links without a description; must be empty for a well-formed corpus."""
    return links.join(descriptions.select("identifier"), "identifier", "left_anti")


XML_CELL = (
    "struct<_text:string,`_row-start`:int,`_row-end`:int,`_col-start`:int,`_col-end`:int,"
    "evidence:array<struct<_statement_id:int,_version:int,_type:string>>>"
)
XML_TABLE = (
    f"_id string, caption array<struct<_text:string>>, row array<struct<cell:array<{XML_CELL}>>>, "
    "statements struct<statement:array<struct<_id:int,_text:string,_type:string>>>"
)


def read_xml_tables(spark: SparkSession, path: str) -> DataFrame:
    """One row per table of XML documents, with the document's file name."""
    raw = spark.read.format("xml").options(rowTag="table", nullValue="").schema(XML_TABLE).load(path)
    name = F.regexp_replace(F.element_at(F.split("_metadata.file_path", "/"), -1), r"\.xml$", "")
    return raw.withColumn("table_id", F.concat_ws("-", name, "_id"))


def xml_cells(tables: DataFrame, first_row_is_header: bool = True) -> DataFrame:
    """Unit cells of spanning cells: the text goes to the upper left one, the rest are blank.

    Two cells that cover one place, or rows of different width, fail the query.
    """
    each = tables.select("table_id", F.explode("row").alias("r")).select("table_id", F.explode("r.cell").alias("c"))

    def at(edge: str) -> Column:
        return F.col("c")[edge]

    units = each.select("table_id", "c", F.explode(F.sequence(at("_row-start"), at("_row-end"))).alias("row")).select(
        "table_id", "c", "row", F.explode(F.sequence(at("_col-start"), at("_col-end"))).alias("col")
    )
    corner = (F.col("row") == at("_row-start")) & (F.col("col") == at("_col-start"))
    content = F.when(corner, text.squeeze(F.coalesce(at("_text"), F.lit("")))).otherwise("")
    placed = units.groupBy("table_id", "row", "col").agg(F.count("*").alias("n"), F.max(content).alias("text"))
    widths = placed.groupBy("table_id", "row").agg(F.count("*").alias("w")).groupBy("table_id").agg(F.min("w").alias("lo"), F.max("w").alias("hi"))
    overlap = F.raise_error(F.concat(F.lit("overlapping cells in "), "table_id")).cast("boolean")
    ragged = F.raise_error(F.concat(F.lit("ragged table "), "table_id")).cast("boolean")
    checked = placed.join(widths, "table_id").where(
        F.when(F.col("n") > 1, overlap).when(F.col("lo") != F.col("hi"), ragged).otherwise(F.lit(True))
    )
    shift = 1 if first_row_is_header else 0
    return checked.select("table_id", (F.col("row") - shift).cast("int").alias("row"), F.col("col").cast("int").alias("col"), "text")


def xml_statements(tables: DataFrame) -> DataFrame:
    """(table_id, statement_id, text, type)."""
    return tables.select("table_id", F.explode("statements.statement").alias("s")).select(
        "table_id", F.col("s._id").alias("statement_id"), text.squeeze(F.col("s._text")).alias("text"), F.col("s._type").alias("type")
    )


def xml_evidence(tables: DataFrame) -> DataFrame:
    """Relevant cells of version 0: (table_id, statement_id, row, col)."""
    each = tables.select("table_id", F.explode("row").alias("r")).select("table_id", F.explode("r.cell").alias("c"))
    return (
        each.select("table_id", F.col("c")["_row-start"].alias("row"), F.col("c")["_col-start"].alias("col"), F.explode("c.evidence").alias("e"))
        .where("e._version = 0 AND e._type = 'relevant'")
        .select("table_id", F.col("e._statement_id").alias("statement_id"), "row", "col")
    )
