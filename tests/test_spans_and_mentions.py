"""Spans of elements and mentions of cells, against plain Python and against one pattern per pair."""

import random

from pyspark.sql import functions as F

from tabloom.functions import text
from tabloom.operators import align, extract, generate


def test_element_spans_equal_a_stack(spark):
    random.seed(5)
    parts = ["<table>", "<TABLE class=x>", "</table>", "</Table>", "é", "x <b>y</b>", "<tabl", "日本"]
    pages = [(k, "".join(random.choices(parts, k=random.randrange(30)))) for k in range(120)]
    pages += [(200, None), (201, ""), (202, "</table>"), (203, "<table></table>"), (204, "<table>" * 3000 + "</table>" * 2999)]
    got = extract.element_spans(spark.createDataFrame(pages, "page_id long, html string"))
    want = {(k, ix, *span) for k, html in pages for ix, span in enumerate(extract.table_spans_of((html or "").encode()))}
    assert {tuple(r) for r in got.collect()} == want and (203, 0, 0, 15) in want
    assert extract.element_spans(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_mentions_equal_a_pattern_per_pair(spark):
    random.seed(6)
    atoms = ["red", "re", "d", "5", "-5", "(5)", "$", "%", " ", "  ", "é", "Ünï", "a_b", ".", "5.0", "red car", "\t", "-", "日本", "x-y"]
    make = lambda n: "".join(random.choices(atoms, k=random.randrange(n)))
    texts = [(k % 4, k, make(14)) for k in range(160)] + [(0, 900, None), (0, 901, ""), (0, 1, texts_copy := make(9)), (0, 1, texts_copy)]
    needles = [(k % 4, k, make(4)) for k in range(300)] + [(0, 900, None), (0, 901, "re" * 50_000), (0, 902, "$")]
    t = spark.createDataFrame(texts, "g int, id int, body string")
    n = spark.createDataFrame(needles, "g int, nid int, needle string").where("needle IS NULL OR needle <> ''")
    got = align.mentions(t, "body", n, "needle", ["g"]).select("g", "id", "nid")
    want = n.join(t.distinct(), "g").where(text.contains_tokens(F.col("body"), F.col("needle"))).select("g", "id", "nid")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) != []
    assert align.mentions(t.limit(0), "body", n, "needle", ["g"]).count() == 0
    assert align.mentions(t, "body", n.limit(0), "needle", ["g"]).count() == 0


def test_replacements_are_not_in_the_question(spark):
    asked = spark.createDataFrame([("q", "t", "Did Ann Lee beat Bob in 1999?"), ("r", "t", "nobody here"), ("s", "none", "Bob")], "question_id string, table_id string, text string")
    grid = [["Ann Lee", "1999"], ["Bob", "2001"], ["Cy (jr.)", "1999"], ["Anne", ""]]
    cells = spark.createDataFrame([("t", r, c, x) for r, row in enumerate(grid) for c, x in enumerate(row)], "table_id string, row int, col int, text string")
    got = {(r.question_id, r.mention, r.replacement, r.has_support) for r in generate.contrastive_candidates(asked, cells).collect()}
    assert got == {("q", "ann lee", "cy (jr.)", True), ("q", "ann lee", "anne", True), ("q", "bob", "cy (jr.)", False), ("q", "bob", "anne", False), ("q", "1999", "2001", True)}
