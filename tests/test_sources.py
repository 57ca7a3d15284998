"""Readers on generated files."""

import gzip
import json

import pytest

from tabloom.sources import neighbours, questions, tables


def test_question_tsv(spark, tmp_path):
    path = tmp_path / "q.tsv"
    path.write_text(
        "id\tannotator\tposition\tquestion\ttable_file\tanswer_coordinates\tanswer_text\taggregation\tfloat_answer\n"
        "nt-1\t0\t1\twho?\tt.csv\t['(1, 3)', '(0, 3)']\t[u'a', u\"b's\"]\tsum\t2.5\n"
        "nt-1\t0\t0\twhat?\tt.csv\t[]\t[]\t \t\n"
    )
    rows = questions.read_questions(spark, str(path)).orderBy("position").collect()
    assert [r.question_id for r in rows] == ["nt-1-0_0", "nt-1-0_1"]
    assert [tuple(c) for c in rows[1].coords] == [(0, 3), (1, 3)]
    assert rows[1].texts == ["a", "b's"] and rows[1].agg == "SUM" and rows[1].float_value == 2.5
    assert rows[0].agg is None and rows[0].float_value is None
    grouped = questions.group_sequences(questions.read_questions(spark, str(path))).first()
    assert [q.position for q in grouped.questions] == [0, 1]


def test_csv_and_separated_tables(spark, tmp_path):
    (tmp_path / "t.csv").write_text('a,b\n"x\ny",2\n')
    (tmp_path / "s.txt").write_text("a#b\n1#2\n")
    cells = {(r.row, r.col): r.text for r in tables.read_csv_tables(spark, str(tmp_path / "t.csv")).collect()}
    assert cells == {(-1, 0): "a", (-1, 1): "b", (0, 0): "x\ny", (0, 1): "2"}
    assert tables.read_csv_tables(spark, str(tmp_path / "s.txt"), sep="#").where("row = 0").count() == 2
    for folder in ("1-csv", "2-csv"):
        (tmp_path / "dirs" / folder).mkdir(parents=True)
        (tmp_path / "dirs" / folder / "7.csv").write_text(f"a\n{folder}\n")
    named = tables.read_csv_tables(spark, str(tmp_path / "dirs" / "*"), depth=2).where("row = 0")
    assert {(r.table_id, r.text) for r in named.collect()} == {("1-csv/7.csv", "1-csv"), ("2-csv/7.csv", "2-csv")}


def test_statements(spark, tmp_path):
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"2-1.csv": [["x is 1", "y is 2"], [1, 0], "cap"]}))
    rows = questions.read_statements(spark, str(path)).orderBy("question_id").collect()
    assert [(r.question_id, r.class_index, r.caption) for r in rows] == [("2-1.csv_0-0_0", 1, "cap"), ("2-1.csv_1-0_0", 0, "cap")]


def test_programs_and_answer_dialects(spark, tmp_path):
    (tmp_path / "p.jsonl").write_text(json.dumps({"phase": 1, "question": "q", "table_id": "1-1", "sql": {"sel": 2, "agg": 3, "conds": [[0, 1, 5.5], [1, 0, "x"]]}}))
    row = questions.read_programs(spark, str(tmp_path / "p.jsonl")).first()
    assert (row.agg, row.sel, [tuple(c) for c in row.conds]) == ("COUNT", 2, [(0, ">", "5.5"), (1, "=", "x")])
    (tmp_path / "w.tsv").write_text("id\tutterance\tcontext\ttargetValue\nn0\twho?\tcsv/1.csv\ta|b\n")
    assert questions.read_answer_bars(spark, str(tmp_path / "w.tsv")).first().texts == ["a", "b"]


def test_linked_tables(spark, tmp_path):
    record = {"uid": "u0", "title": "T", "url": "http://x", "header": [["Name", []]], "data": [[["Foo", ["/wiki/Foo%20bar", "/wiki/Foo%20bar"]]]]}
    (tmp_path / "u0.json").write_text(json.dumps(record))
    cells, links = tables.read_linked_tables(spark, str(tmp_path / "u0.json"))
    assert sorted((r.row, r.text) for r in cells.collect()) == [(-1, "Name"), (0, "Foo")]
    assert [r.identifier for r in links.collect()] == ["/wiki/Foo bar"]
    known = spark.createDataFrame([("/wiki/Other",)], "identifier string")
    assert tables.unknown_links(links, known).count() == 1


def test_linked_tables_are_parsed_once_as_records(spark, tmp_path):
    """F3 (round 4): a file was opened again for every inner list of its cells, in each of three scans."""
    names = [f"/wiki/A%20{k}" for k in range(3)]
    for t in range(2):
        data = [[[f"x\n{k}", [names[k], names[k]]], [f"{k}", []]] for k in range(3)]
        record = {"uid": f"u{t}", "title": "T", "url": "", "header": [["a", []], ["b", []]], "data": data}
        (tmp_path / f"file{t}.json").write_text(json.dumps(record, indent=t))
    cells, links = tables.read_linked_tables(spark, str(tmp_path))
    assert "json" not in cells._jdf.queryExecution().executedPlan().toString().lower()
    got = sorted((r.table_id, r.row, r.col, r.text) for r in cells.collect())
    assert got == sorted((f"u{t}", *x) for t in range(2) for x in [(-1, 0, "a"), (-1, 1, "b"), *[(k, 0, f"x\n{k}") for k in range(3)], *[(k, 1, f"{k}") for k in range(3)]])
    assert sorted((r.table_id, r.row, r.col, r.identifier) for r in links.collect()) == [(f"u{t}", k, 0, f"/wiki/A {k}") for t in range(2) for k in range(3)]


XML = """<document id="d"><table id="1"><caption text="Cap"/>
<row><cell text="A" row-start="0" row-end="0" col-start="0" col-end="0"/><cell text="B" row-start="0" row-end="0" col-start="1" col-end="2"/></row>
<row><cell text="a" row-start="1" row-end="1" col-start="0" col-end="0"><evidence statement_id="0" version="0" type="relevant"/></cell>
<cell text="b" row-start="1" row-end="1" col-start="1" col-end="%d"/><cell text="c" row-start="1" row-end="1" col-start="2" col-end="2"/></row>
<statements><statement id="0" text="A is a." type="entailed"/></statements></table></document>"""


def test_xml_tables(spark, tmp_path):
    path = tmp_path / "9.xml"
    path.write_text(XML % 1)
    read = tables.read_xml_tables(spark, str(path))
    cells = {(r.row, r.col): r.text for r in tables.xml_cells(read).collect()}
    assert cells == {(-1, 0): "A", (-1, 1): "B", (-1, 2): "", (0, 0): "a", (0, 1): "b", (0, 2): "c"}
    assert tables.xml_statements(read).first().text == "A is a."
    assert [(r.row, r.col) for r in tables.xml_evidence(read).collect()] == [(1, 0)]
    (tmp_path / "bad.xml").write_text(XML % 2)
    with pytest.raises(Exception, match="overlapping"):
        tables.xml_cells(tables.read_xml_tables(spark, str(tmp_path / "bad.xml"))).collect()


def test_annotated_pages_gzip(spark, tmp_path):
    for split in ("train", "dev"):
        (tmp_path / split).mkdir()
        line = {"example_id": split, "question_text": "q", "document_html": "<table></table>", "annotations": [{"short_answers": [{"start_byte": 1, "end_byte": 2}]}]}
        with gzip.open(tmp_path / split / "part-00.jsonl.gz", "wt") as f:
            f.write(json.dumps(line) + "\n")
    pages = tables.read_annotated_pages(spark, {s: str(tmp_path / s) for s in ("train", "dev")})
    assert sorted((r.example_id, r.split) for r in pages.collect()) == [("dev", "dev"), ("train", "train")]


def test_neighbour_files_are_negated_and_unique(spark, tmp_path):
    rows = spark.createDataFrame([("q", "a", 1.0, 1), ("q", "b", 0.5, 2)], "query_id string, table_id string, score double, rank int")
    neighbours.write_neighbours(rows, str(tmp_path / "n"))
    back = neighbours.read_neighbours(spark, str(tmp_path / "n")).orderBy("rank").collect()
    assert [(r.table_id, r.score) for r in back] == [("a", -1.0), ("b", -0.5)]
    neighbours.write_neighbours(rows, str(tmp_path / "n"), mode="append")
    with pytest.raises(Exception, match="listed twice"):
        neighbours.read_neighbours(spark, str(tmp_path / "n")).collect()
