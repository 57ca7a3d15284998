"""Where answers lie in tables.

answers (question_id, alt_index, answer_ix, text): one row per answer text, with
alt_index 0 for the main answer. pairs (question_id, table_id): what to search.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.model import body
from tabloom.operators.layout import materialize


def with_tables(questions: DataFrame, tables: DataFrame) -> DataFrame:
    """Questions with their table; Spark broadcasts the tables when they are small."""
    return questions.join(tables, "table_id")


def find_answers(pairs: DataFrame, answers: DataFrame, cells: DataFrame, in_header: bool = True) -> DataFrame:
    """Cells that contain an answer text as a case-sensitive substring.

    (question_id, table_id, alt_index, answer_ix, text, row, col); header cells have row -1.
    """
    searched = cells if in_header else body(cells)
    asked = pairs.select("question_id", "table_id").join(answers, "question_id")
    return asked.join(
        searched.select("table_id", "row", "col", F.col("text").alias("cell")), "table_id"
    ).where(F.contains("cell", "text")).drop("cell")


def found_groups(pairs: DataFrame, answers: DataFrame, cells: DataFrame, in_header: bool = True) -> DataFrame:
    """(question_id, table_id, alt_index, all_found, first): per answer group of each pair.

    `first` is the smallest coordinate of any of its texts. The cells of a table are
    reduced to at most one row per answer text before groups are formed.
    """
    hits = (
        find_answers(pairs, answers, cells, in_header)
        .groupBy("table_id", "question_id", "alt_index", "answer_ix")
        .agg(F.min(F.struct("row", "col")).alias("first"))
    )
    wanted = pairs.select("question_id", "table_id").join(answers.drop("text"), "question_id")
    return (
        wanted.join(hits, ["table_id", "question_id", "alt_index", "answer_ix"], "left")
        .groupBy("table_id", "question_id", "alt_index")
        .agg(F.bool_and(F.col("first").isNotNull()).alias("all_found"), F.min("first").alias("first"))
    )


def answerable(pairs: DataFrame, answers: DataFrame, cells: DataFrame) -> DataFrame:
    """Pairs in which all texts of the main answer, or of one alternative, are found.

    Groups marked is_valid = false do not count; questions without texts never match.
    """
    valid = answers.where(F.coalesce("is_valid", F.lit(True))) if "is_valid" in answers.columns else answers
    return (
        found_groups(pairs, valid.select("question_id", "alt_index", "answer_ix", "text"), cells)
        .groupBy("table_id", "question_id")
        .agg(F.bool_or("all_found").alias("ok"))
        .where("ok")
        .select("question_id", "table_id")
    )


def group_answers(pairs: DataFrame, answers: DataFrame, cells: DataFrame) -> DataFrame:
    """Fully found answer groups in order: the first is the main answer, the rest are alternatives.

    A text that is blank or a dash makes its group invalid.
    """
    bad = answers.groupBy("question_id", "alt_index").agg(
        F.bool_or(F.col("text").isin("", "-")).alias("bad")
    ).where("bad")
    good = answers.join(bad, ["question_id", "alt_index"], "left_anti")
    groups = found_groups(pairs, good, cells).where("all_found")
    order = Window.partitionBy("question_id", "table_id").orderBy("alt_index")
    return groups.withColumn("new_index", F.row_number().over(order) - 1).select(
        "question_id", "table_id", "alt_index", "new_index"
    )


def order_groups(pairs: DataFrame, answers: DataFrame, cells: DataFrame) -> DataFrame:
    """Answer groups per candidate table: found ones by their first cell, then the missing ones."""
    groups = found_groups(pairs, answers, cells, in_header=False)
    where = F.when(F.col("all_found"), F.col("first"))
    order = Window.partitionBy("question_id", "table_id").orderBy((~F.col("all_found")).cast("int"), where, "alt_index")
    return groups.withColumn("place", F.row_number().over(order) - 1).select(
        "question_id", "table_id", "alt_index", "all_found", "place"
    )


NORMALISERS = ("as is", "lower", "tokens", "folded")


def _levels(c: Column) -> Column:
    """The four spellings under which an answer and a cell are compared, simplest first."""
    return F.array(c, F.lower(c), F.array_join(text.tokenize(c), "\u0001"), text.fold_answer(c))


def align_answers(questions: DataFrame, answers: DataFrame, cells: DataFrame, strict: bool = False) -> DataFrame:
    """Cell of every answer text, at the first normalisation under which all texts fit.

    questions (question_id, table_id). A level fits when each text equals some cell
    and no cell is wanted by two texts; strict also asks that each text has one
    cell only. Because no cell serves two answers, each text takes its first cell.
    Returns (question_id, table_id, answer_ix, level, row, col); questions without
    a fitting level have no rows.
    """
    asked = questions.select("question_id", "table_id").join(answers, "question_id")
    wanted = asked.select("table_id", "question_id", "answer_ix", F.posexplode(_levels(F.col("text"))).alias("level", "norm"))
    # A question's texts meet the cells of its table as one list, so that cells stay where they lie and only hits are moved.
    lists = wanted.groupBy("table_id", "question_id").agg(F.collect_list(F.struct("answer_ix", "level", "norm")).alias("wanted"))
    met = body(cells).select("table_id", "row", "col", "text").join(lists, "table_id")
    read = met.select("table_id", "question_id", "row", "col", "wanted", _levels(F.col("text")).alias("norms"))
    equal = F.filter("wanted", lambda w: F.get(F.col("norms"), w["level"]) == w["norm"])
    found = read.select("table_id", "question_id", "row", "col", F.explode(equal).alias("w")).select("table_id", "question_id", "w.level", "w.answer_ix", "row", "col")
    # Every wanted text stands once without a cell, which tells those that have none.
    none = F.lit(None).cast("int")
    hits = found.unionByName(wanted.select("table_id", "question_id", "level", "answer_ix", none.alias("row"), none.alias("col"))).repartition("table_id")
    per_cell = hits.groupBy("table_id", "question_id", "level", "row", "col").agg(F.count("*").alias("claims"), F.collect_list("answer_ix").alias("ixs"))
    per_text = (
        per_cell.select("table_id", "question_id", "level", "row", "col", "claims", F.explode("ixs").alias("answer_ix"))
        .groupBy("table_id", "question_id", "level", "answer_ix")
        .agg(
            F.count("row").alias("n_cells"),
            F.max(F.when(F.col("row").isNotNull(), F.col("claims")).otherwise(0)).alias("claims"),
            F.min(F.when(F.col("row").isNotNull(), F.struct("row", "col"))).alias("cell"),
        )
    )
    fits = (F.min("n_cells") > 0) & (F.max("claims") == 1)
    if strict:
        fits = fits & (F.max("n_cells") == 1)
    levels = per_text.groupBy("table_id", "question_id", "level").agg(
        fits.alias("ok"), F.collect_list(F.struct("answer_ix", "cell")).alias("cells")
    )
    return (
        levels.where("ok")
        .groupBy("table_id", "question_id")
        .agg(F.min(F.struct("level", "cells")).alias("best"))
        .select("question_id", "table_id", "best.level", F.explode("best.cells").alias("e"))
        .select("question_id", "table_id", "e.answer_ix", "level", "e.cell.row", "e.cell.col")
    )


def repair_supervision(questions: DataFrame) -> DataFrame:
    """Make answer texts and float value agree.

    questions (…, texts array<string>, float_value float, n_coords int). A float
    value that the texts do not express replaces them; a single text is then read
    as the float. `valid` is false when neither coordinates nor a float are left.
    """
    from tabloom.functions import numbers

    single = F.when(F.size("texts") == 1, numbers.convert_to_float(F.get(F.col("texts"), F.lit(0))))
    agrees = F.coalesce(single.cast("float") == F.col("float_value"), F.lit(False))
    wide = F.col("float_value").cast("double")
    shown = F.when(wide == F.floor(wide), wide.cast("decimal(38,0)").cast("string")).otherwise(wide.cast("string"))
    repaired = F.when(F.col("float_value").isNotNull() & ~agrees, F.array(shown)).otherwise(F.col("texts"))
    with_texts = questions.withColumn("texts", repaired)
    value = F.when(F.size("texts") == 1, numbers.convert_to_float(F.get(F.col("texts"), F.lit(0))))
    return with_texts.withColumn("float_value", value.cast("float")).withColumn(
        "valid", (F.size("texts") > 0) & ((F.coalesce("n_coords", F.lit(0)) > 0) | F.col("float_value").isNotNull())
    )


def occurrences(texts: DataFrame, id_col: str, text_col: str, literal: str) -> DataFrame:
    """(id, ix, at): every place of a literal in each text, numbered from 0 in order.

    The pieces between the places are counted, so no offset is searched for twice.
    """
    pieces = texts.select(id_col, F.posexplode(F.transform(F.split(text_col, text.quote_regex(F.lit(literal)), -1), lambda p: F.length(p))).alias("ix", "size"), F.size(F.split(text_col, text.quote_regex(F.lit(literal)), -1)).alias("n"))
    before = F.sum("size").over(Window.partitionBy(id_col).orderBy("ix")) + F.col("ix") * len(literal)
    return pieces.withColumn("at", before.cast("int")).where(F.col("ix") < F.col("n") - 1).select(id_col, "ix", "at")


def contained_annotations(spans: DataFrame, annotations: DataFrame, stretch: int = 4096) -> DataFrame:
    """Annotations that lie in a table span with all of their parts.

    spans (page_id, table_ix, begin, end); annotations (page_id, annotation_ix, begin, end),
    one row per part. Returns (page_id, annotation_ix, table_ix). Spans are cut into stretches of
    a page, and an annotation meets only those that run through the stretch where it begins; so
    a large page is spread and its spans and annotations are not all compared.
    """
    parts = annotations.groupBy("page_id", "annotation_ix").agg(F.min("begin").alias("lo"), F.max("end").alias("hi"))
    cut = lambda c: F.floor(F.col(c) / stretch)
    held = spans.withColumn("stretch", F.explode(F.sequence(cut("begin"), cut("end"))))
    met = parts.withColumn("stretch", cut("lo")).join(held, ["page_id", "stretch"])
    return met.where((F.col("begin") <= F.col("lo")) & (F.col("hi") <= F.col("end"))).select("page_id", "annotation_ix", "table_ix")


def redirect(questions: DataFrame, merged: DataFrame) -> DataFrame:
    """Point questions at the table their own was merged into, by its alternative ids."""
    moves = merged.select(F.explode("alt_ids").alias("table_id"), F.col("table_id").alias("new_id"))
    return questions.join(moves, "table_id", "left").withColumn("table_id", F.coalesce("new_id", "table_id")).drop("new_id")


def _grams(runs: Column) -> Column:
    """Distinct single runs and pairs of neighbours."""
    pairs = F.transform(F.slice(runs, 2, F.size(runs)), lambda w, i: F.concat_ws("\x00", F.get(runs, i), w))
    return F.array_distinct(F.concat(runs, pairs))


def _blank(c: Column) -> Column:
    return c.rlike(r"(?U)\A\s\z")


def _stands_at(i: Column) -> Column:
    """Whether needle runs w with pieces p stand in text runs tw with pieces tp from run i on."""
    n, before, after = F.size("w"), F.get(F.col("tp"), i), F.get(F.col("tp"), i + F.size("w"))
    head, tail = F.get(F.col("p"), F.lit(0)), F.get(F.col("p"), n)
    spare, rest = F.length(before) - F.length(head), F.length(after) - F.length(tail)
    opens = (head == "") | (F.endswith(before, head) & F.when(spare == 0, i > 0).otherwise(_blank(F.substr(before, spare, F.lit(1)))))
    closes = (tail == "") | (F.startswith(after, tail) & F.when(rest == 0, i + n < F.size("tw")).otherwise(_blank(F.substr(after, F.length(tail) + 1, F.lit(1)))))
    return (F.slice("tw", i + 1, n) == F.col("w")) & (F.slice("tp", i + 2, n - 1) == F.slice("p", F.lit(2), n - 1)) & opens & closes


def _sign_stands_in(needle: Column, piece: Column, k: Column) -> Column:
    """Whether a needle without word characters stands in the k-th piece between runs, bounded by runs or blanks."""
    size, room = F.length(needle), F.length(piece) - F.length(needle)

    def at(start: Column) -> Column:
        opens = F.when(start == 0, k > 0).otherwise(_blank(F.substr(piece, start, F.lit(1))))
        closes = F.when(start == room, k < F.size("tw")).otherwise(_blank(F.substr(piece, start + size + 1, F.lit(1))))
        return (F.substr(piece, start + 1, size) == needle) & opens & closes

    return F.contains(piece, needle) & F.exists(F.sequence(F.lit(0), F.greatest(room, F.lit(0))), at)


def mentions(texts: DataFrame, text_col: str, needles: DataFrame, needle_col: str, on: list[str], how: str = "merge") -> DataFrame:
    """Rows of needles joined to the distinct rows of texts with equal `on` that hold the needle on token boundaries.

    Same pairs as an `on` join with `text.contains_tokens`, but met by hash: a needle is looked up
    by its first two runs of word characters (or its only one) among the neighbouring runs of the
    texts, and only pairs that agree there are compared, run by run, without a pattern per pair.
    Needles of signs alone meet the pieces between the runs. Null needles and texts meet nothing,
    nor do empty needles. No other column may stand on both sides. `how` the texts are joined is
    said here, since a size guessed from compressed files may be far too small to send them.
    """
    held = texts.where(F.col(text_col).isNotNull()).distinct()
    sides = sorted(held.columns)
    keyed = held.select("*", text.word_runs(F.col(text_col)).alias("tw"), text.between_runs(F.col(text_col)).alias("tp"), F.struct(F.xxhash64(*sides), F.xxhash64(F.lit("row"), *sides)).alias("tk"))
    asked = needles.where(F.col(needle_col) != "").select("*", text.word_runs(F.col(needle_col)).alias("w"), text.between_runs(F.col(needle_col)).alias("p"))
    worded = asked.where(F.size("w") > 0).withColumn("gram", F.concat_ws("\x00", F.slice("w", 1, 2)))
    near = worded.join(keyed.select(*on, "tk", F.explode(_grams(F.col("tw"))).alias("gram")).hint(how), [*on, "gram"])
    places = F.sequence(F.lit(0), F.greatest(F.size("tw") - F.size("w"), F.lit(0)))
    found = near.join(keyed.hint(how), [*on, "tk"]).where(F.exists(places, _stands_at))
    signs = asked.where(F.size("w") == 0).join(keyed.hint(how), on).where(F.exists(F.transform("tp", lambda g, k: _sign_stands_in(F.col(needle_col), g, k)), lambda x: x))
    columns = [*needles.columns, *[c for c in texts.columns if c not in on]]
    return found.select(*columns).unionByName(signs.select(*columns))


#: Characters of descriptions, with some for each row, that are sent to all tasks.
MAX_SENT_CHARACTERS = 1_000_000


def linked_answers(pairs: DataFrame, answers: DataFrame, cells: DataFrame, links: DataFrame, descriptions: DataFrame) -> DataFrame:
    """Cells whose text, or else a linked description, holds the answer on token boundaries.

    links (table_id, row, col, identifier), descriptions (identifier, description).
    A question that is answered by cell text is not searched in descriptions.
    """
    asked = pairs.select("question_id", "table_id").join(answers.select("question_id", "text").hint("merge"), "question_id")
    place = ["question_id", "table_id", "row", "col"]
    searched = body(cells).select("table_id", "row", "col", F.col("text").alias("cell")).join(asked.select("table_id").hint("merge"), "table_id", "left_semi")
    own = mentions(searched, "cell", asked, "text", ["table_id"]).select(*place, F.lit("cell").alias("source"))
    rest = asked.join(own.select("question_id", "table_id").distinct().hint("merge"), ["question_id", "table_id"], "left_anti")
    # Few descriptions, to which very many cells may link, are sent to all tasks once their size is known.
    described = materialize(descriptions.select("identifier", "description").distinct())
    size = described.agg(F.sum(F.length(F.concat_ws("", "identifier", "description")) + 64)).first()[0] or 0
    linking = rest.join(links.select("table_id", "row", "col", "identifier").hint("merge"), "table_id")
    linked = mentions(described, "description", linking, "text", ["identifier"], "broadcast" if size <= MAX_SENT_CHARACTERS else "merge")
    return own.unionByName(linked.select(*place, F.lit("description").alias("source"))).distinct()
