"""Operators on small inputs with known results."""

import math

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from tabloom.functions import ids, numbers, text
from tabloom.operators import align, dedup, dense, extract, generate, lexical, linearize, metrics, programs, reader, reports
from tabloom.operators.numeric import column_ranks, consolidate, with_values


def titles(spark, *values):
    return spark.createDataFrame([(f"table_{i}", v, 1) for i, v in enumerate(values)], "table_id string, text string, weight int")


def ask(spark, question):
    return spark.createDataFrame([("q", question)], "question_id string, text string")


def hits(df):
    return [(r.table_id, round(r.score, 9)) for r in df.orderBy("rank").collect()]


def test_tfidf_values(spark):
    post = lexical.postings(titles(spark, "a a c", "b c"))
    kept = lexical.retrieve(lexical.tfidf_scores(ask(spark, "A C"), post, drop_term_frequency=False))
    assert hits(kept) == [("table_0", 0.75), ("table_1", 0.25)]
    assert hits(lexical.retrieve(lexical.tfidf_scores(ask(spark, "B"), post))) == [("table_1", 1.0)]
    assert hits(lexical.retrieve(lexical.tfidf_scores(ask(spark, "A"), post))) == [("table_0", 0.5)]


def test_tfidf_min_rank(spark):
    post = lexical.postings(titles(spark, "Table A", "Table B"))
    assert hits(lexical.retrieve(lexical.tfidf_scores(ask(spark, "A"), post, min_rank=1))) == [("table_0", 1.0)]


@pytest.mark.parametrize(
    "question, expected",
    [
        ("AA", [("table_0", 1.5475852968796064)]),
        ("BB", [("table_1", 1.2426585328757855)]),
        ("AA CC", [("table_0", 2.0749815245480145), ("table_1", 0.668184203698534)]),
    ],
)
def test_bm25_values(spark, question, expected):
    post = lexical.postings(titles(spark, "aa aa cc", "bb cc", "dd", "ee", "ff", "gg", "hh"))
    got = hits(lexical.retrieve(lexical.bm25_scores(ask(spark, question), post), 10))
    assert got == [(t, round(s, 9)) for t, s in expected]


def test_nearest_both_paths_and_metrics(spark):
    unit = [[float(i == j) for j in range(4)] for i in range(4)]
    tables = [("a", unit[0]), ("b", unit[1]), ("c", [0.0, 0.0, 0.5, 0.0]), ("d", [0.0, 0.0, 0.0, 0.25]), ("e", unit[2]), ("f", unit[3]), ("g", unit[3])]
    queries = spark.createDataFrame(list(zip("abcd", unit)), "query_id string, embedding array<float>")
    corpus = spark.createDataFrame(tables, "table_id string, embedding array<float>")
    small = sorted(map(tuple, dense.nearest(queries, corpus, 2).collect()))
    blocks = sorted(map(tuple, dense.nearest(queries, corpus, 2, max_broadcast=0).collect()))
    assert small == blocks
    assert [(t, s) for q, t, s, _ in small if q == "d"] == [("f", 1.0), ("g", 1.0)]
    golds = spark.createDataFrame([(x, x) for x in "abcd"], "query_id string, table_id string")
    found = metrics.ranking_metrics(metrics.judge(dense.nearest(queries, corpus, 6), golds)).first()
    assert found.hit_at_1 == 0.5 and found.hit_at_5 == 1.0


def test_nearest_holds_few_scores_at_once():
    """20,000 queries against a block of 10,000 vectors, as all scores at once 1.6 GB; ties and results of many strips."""
    import tracemalloc

    import numpy as np

    draw = np.random.default_rng(1)
    asked, held = draw.integers(-2, 3, (20000, 2)).astype(float), draw.integers(-2, 3, (10000, 2)).astype(float)
    ids = draw.permutation(10000)
    tracemalloc.start()
    rows, found, scores = dense._search(asked, ids, held, 3)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 300 << 20
    assert len(rows) == 60000
    for q in range(0, 20000, 1999):
        all_scores = held @ asked[q]
        best = np.lexsort((ids, -all_scores))[:3]
        assert found[rows == q].tolist() == ids[best].tolist() and scores[rows == q].tolist() == all_scores[best].tolist()


def test_nearest_sends_queries_only_with_room_for_their_results(spark, monkeypatch):
    """Vectors of two numbers with 1,000 results each: the results count, not just the vectors."""
    rows = spark.range(3000).selectExpr("id query_id", "id table_id", "array(double(id % 7), double(id % 11)) embedding")
    ways = []
    monkeypatch.setattr(dense, "_by_broadcast", lambda *a: ways.append("broadcast") or spark.createDataFrame([], a[3]))
    monkeypatch.setattr(dense, "_by_blocks", lambda *a: ways.append("blocks") or spark.createDataFrame([], a[3]))
    dense.nearest(rows, rows, 1000, max_broadcast=1 << 20)
    dense.nearest(rows, rows, 2, max_broadcast=1 << 20)
    assert ways == ["blocks", "broadcast"]


def test_order_cells_are_moved_once(spark, tmp_path):
    """Header and body cells of orders, with a null key and a repeated row; one shuffle serves numbering and grouping."""
    from tabloom import model

    line = "timestamp'1995-01-02' l_shipdate, 1L l_suppkey, 1.5D l_extendedprice, 0.0D l_discount, 0.0D l_tax, 'A' l_returnflag, 'O' l_linestatus"
    keys = "values (7L, 1, 3.0D), (7L, 1, 3.0D), (7L, 2, 4.0D), (9L, 1, 5.0D), (null, 1, 6.0D)"
    spark.sql(f"select k l_orderkey, n l_linenumber, 2L l_partkey, q l_quantity, {line} from {keys} t(k, n, q)").write.parquet(f"{tmp_path}/lineitem.parquet")
    cells = model.order_cells(spark, str(tmp_path))
    assert cells.dtypes == [("table_id", "string"), ("row", "int"), ("col", "int"), ("text", "string")]
    got = sorted(((r.table_id or "", r.row, r.text) for r in cells.where("col = 0").collect()))
    head = [(t, -1, "l_quantity") for t in ("", "7", "9")]
    assert got == sorted([*head, ("", 0, "6.00"), ("7", 0, "3.00"), ("7", 1, "3.00"), ("7", 2, "4.00"), ("9", 0, "5.00")])
    assert cells.where("row < 0").count() == 3 * 7
    counted = cells.groupBy("table_id").agg(F.collect_list("text"))
    assert counted._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1


def test_masking_moves_sequences_in_place(spark):
    """Sequences that lie by table are masked there: the same draws by either key, and no further shuffle."""
    rows = [(f"q{t}", f"{t}", p, f"w{t}_{p}", int(p > 3), int(p > 3), int(p > 3) * (p // 3)) for t in range(5) for p in range(30)]
    tokens = spark.createDataFrame(rows, "question_id string, table_id string, position int, token string, segment_id int, row_id int, column_id int")
    by_question = sorted(map(tuple, linearize.mask_tokens(tokens, seed=3).collect()))
    placed = tokens.repartition(3, "table_id")
    by_table = linearize.mask_tokens(placed, seed=3, key="table_id")
    assert sorted(map(tuple, by_table.collect()), key=str) == sorted(by_question, key=str)
    assert by_table._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1


def test_numbers_meet_tokens_in_place(spark):
    """Null keys meet nothing, a cell stated twice gives its tokens twice; tokens that lie by table are not moved."""
    rows = [("q1", "1", 0, "a", 0, 0, 0), ("q1", "1", 1, "5", 1, 1, 1), ("q1", "1", 2, "6", 1, 1, 1), ("q1", "1", 3, "x", 1, 2, 1), ("q", None, 1, "7", 1, 1, 1)]
    tokens = spark.createDataFrame(rows, "question_id string, table_id string, position int, token string, segment_id int, row_id int, column_id int").repartition(3, "table_id")
    cells = spark.createDataFrame([("1", 0, 0, 5.0), ("1", 1, 0, float("inf")), ("1", 1, 0, 8.0), (None, 0, 0, 7.0), ("2", 0, 0, 1.0)], "table_id string, row int, col int, number double")
    got = linearize.numeric_values(tokens, cells.repartition(3, "table_id"))
    assert got.columns[:3] == ["table_id", "row_id", "column_id"]
    found = sorted((r.question_id, r.position, str(r.numeric_value), r.scale) for r in got.collect())
    assert found == [("q", 1, "nan", 1), ("q1", 0, "nan", 1), ("q1", 1, "5.0", 2), ("q1", 2, "5.0", 2), ("q1", 3, "8.0", 2), ("q1", 3, "nan", 2)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_noise_is_drawn_in_place(spark):
    """All cells of a row or column with a gold cell but the gold ones; null ids and repeated coordinates; cells join once."""
    cells = spark.createDataFrame([(t, r, c, "x") for t in ("1", "2", None) for r in range(3) for c in range(3)], "table_id string, row int, col int, text string")
    coords = spark.createDataFrame([("a", "1", 0, 0), ("a", "1", 0, 0), ("a", "1", 1, 0), (None, "2", 2, 2), ("c", None, 0, 0)], "question_id string, table_id string, row int, col int")
    drawn = generate.noisy_coordinates(coords, cells.repartition(3, "table_id"), "row_or_column", seed=1)
    got = {q: sorted({(r.row, r.col) for r in drawn.collect() if r.question_id == q}) for q in ("a", None, "c")}
    assert len(got["a"]) == 3 and set(got["a"]) <= {(0, 1), (0, 2), (1, 1), (1, 2), (2, 0)}
    # Without an id nothing is known to be gold.
    assert len(got[None]) == 1 and got["c"] == []
    anti = [line for line in drawn._jdf.queryExecution().optimizedPlan().toString().splitlines() if "LeftAnti" in line]
    assert not anti


def test_text_functions(spark):
    row = spark.sql(
        "select 'N/A' a, ' Foo_bar,  BAZ! ' b, 'The cat, a dog' c, '“Été” [3] (x)' d, 'a1 b-c' e"
    ).select(
        text.format_text(F.col("a")).alias("a"),
        text.format_text(F.col("b")).alias("b"),
        text.normalize_qa_answer(F.col("c")).alias("c"),
        text.fold_answer(F.col("d")).alias("d"),
        text.all_spans(F.col("e"), 2).alias("e"),
    ).first()
    assert (row.a, row.b, row.c) == ("EMPTY", "foo bar baz", "cat dog")
    assert row.d == "ete"
    assert [tuple(s) for s in row.e] == [(0, 2), (0, 4), (3, 4), (3, 6), (5, 6)]


@pytest.mark.parametrize(
    "value, expected",
    [("1,000.7", 1000.7), ("1,000", 1000.0), ("5,5556", 5.5556), ("0.0.0.1", 1.0), ("0,0,0,1", 1.0), ("12", 12.0), ("1d", None), ("x", None)],
)
def test_convert_to_float(spark, value, expected):
    assert spark.range(1).select(numbers.convert_to_float(F.lit(value)).alias("v")).first().v == expected


@pytest.mark.parametrize(
    "value, expected",
    [
        ("october 2007", (2007, 10, None)),
        ("5 may 2010", (2010, 5, 5)),
        ("may", (None, 5, None)),
        ("monday, january 3", (None, 1, 3)),
        ("1990s", (1990, None, None)),
        ("2020", None),
        ("february 30, 2001", None),
    ],
)
def test_dates_in_sql_and_text(spark, value, expected):
    row = spark.range(1).select(numbers.parse_date(F.lit(value)).alias("d"), numbers.text_values(F.lit(value)).alias("v")).first()
    assert (tuple(row.d) if row.d else None) == expected
    dates = [(v.year, v.month, v.day) for v in row.v if v.type == "date"]
    # Running text still finds the parts of a date that does not exist as a whole.
    assert dates == ([expected] if expected else dates) and (value != "2020" or not dates)


def test_ids(spark):
    row = spark.range(1).select(
        ids.parse_question_id(F.lit("a-b-2_0")).alias("p"), ids.example_id(F.lit("abcd-123/10-1_0")).alias("e"), ids.example_id(F.lit("1234-2_0")).alias("f")
    ).first()
    assert tuple(row.p) == ("a-b", "2", 0) and (row.e, row.f) == ("abcd-123", "1234")


def cells_of(spark, table_id, lines):
    rows = [(table_id, r - 1, c, t) for r, line in enumerate(lines) for c, t in enumerate(line)]
    return spark.createDataFrame(rows, "table_id string, row int, col int, text string")


def test_partial_dates_compare_on_shared_parts(spark):
    cells = cells_of(spark, "t", [["when"], ["may 5, 2010"], ["august 2007"], ["2006"]])
    ranks = column_ranks(consolidate(with_values(cells, free_text=True))).orderBy("row").collect()
    assert [r["rank"] for r in ranks] == [3, 2, 1]


def test_ngrams_with_header_weight(spark):
    cells = cells_of(spark, "t", [["Number", "Name"], ["100,000", "15"], ["Zurich", "Bern"]])
    counts = dedup.bucket_counts(cells, header_weight=2, ngram=2)
    # number, number name, name twice; 100, 100 000, 000, 000 15, 15; zurich, zurich bern, bern
    assert counts.agg(F.sum("n")).first()[0] == 6 + 5 + 3


def sequential_groups(tables, edges):
    """The merge rule, one pair at a time."""
    members = {t: [t] for t in tables}
    home = {t: t for t in tables}
    for a, b, _ in sorted(edges, key=lambda e: (-e[2], e[0], e[1])):
        ca, cb = home[a], home[b]
        if ca == cb:
            continue
        if any(tables[x][0] == tables[y][0] or abs(tables[x][1] - tables[y][1]) > 2 for x in members[ca] for y in members[cb]):
            continue
        for m in members.pop(cb):
            home[m] = ca
            members[ca].append(m)
    return {frozenset(m) for m in members.values()}


@pytest.mark.parametrize("block_rows", [100_000, 0])
def test_group_similar_matches_sequential_merge(spark, monkeypatch, block_rows):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", block_rows)
    monkeypatch.setattr(dedup, "BLOCK_NODES", block_rows // 1000)
    base = [["city", "people", "area", "mayor"], ["zurich", "400", "88", "mauch"], ["bern", "130", "51", "von graffenried"], ["basel", "170", "24", "cramer"]]
    rows, facts = [], []
    for i in range(24):
        lines = [list(r) for r in base] + [["geneva", "200", "16", "gomez"]] * (i % 4)
        if i % 3:
            lines[1 + i % 2][i % 4] = f"v{i % 5}"
        rows += [(f"t{i:02d}", r - 1, c, x) for r, line in enumerate(lines) for c, x in enumerate(line)]
        facts.append((f"t{i:02d}", "title", len(lines) - 1, 4, [f"url{i % 7}"]))
    cells = spark.createDataFrame(rows, "table_id string, row int, col int, text string")
    tables = spark.createDataFrame(facts, "table_id string, document_title string, n_rows int, n_cols int, urls array<string>")
    options = {"threshold": 0.6}
    vectors = dedup.unit_vectors(dedup.bucket_counts(cells)).collect()
    dense_vectors = {r.table_id: dict(zip(r.buckets, r.weights)) for r in vectors}
    edges = []
    for a, _, na, _, ua in facts:
        for b, _, nb, _, ub in facts:
            sim = round(sum(w * dense_vectors[b].get(k, 0.0) for k, w in dense_vectors[a].items()), 9)
            if a < b and ua != ub and abs(na - nb) <= 2 and sim >= 0.6:
                edges.append((a, b, sim))
    found = {(r.a, r.b): r.sim for r in dedup.similarity_edges(tables, cells, **options).collect()}
    assert set(found) == {(a, b) for a, b, _ in edges}
    got = {}
    for r in dedup.group_similar(tables, cells, **options).collect():
        got.setdefault(r.cluster, set()).add(r.table_id)
    by_table = {f[0]: (f[4][0], f[2]) for f in facts}
    clusters = {frozenset(m) for m in got.values()}
    assert clusters == sequential_groups(by_table, edges)
    for m in clusters:
        assert len({by_table[t][0] for t in m}) == len(m)
        assert max(by_table[t][1] for t in m) - min(by_table[t][1] for t in m) <= 2
    assert any(e[2] == 1.0 for e in edges) and any(e[2] < 1.0 for e in edges) and len(clusters) < len(facts)


def test_page_tables(spark):
    html = (
        "<p>x</p></table><TABLE><tr><th>Year</th><th>Award</th><th>Award</th></tr>"
        '<tr><td rowspan="3">2014</td><td><span style="display:none">key</span>Best<br />Film</td><td>Won</td></tr>'
        "<tr><td>Other</td><td colspan='2'>Lost</td></tr></TABLE>"
        '<table class="infobox v"><tr><th colspan="2">Show &amp; Tell</th></tr><tr><th>Country</th><td>US</td></tr><tr><td colspan="2">Note</td></tr></table>'
    )
    pages = spark.createDataFrame([(1, html)], "page_id int, html string")
    cells = extract.page_cells(pages)
    first = {(r.row, r.col): r.text for r in cells.where("table_ix = 0").collect()}
    assert [first[-1, c] for c in range(3)] == ["Year", "Award", "Award.1"]
    assert [first[0, c] for c in range(3)] == ["2014", "Best Film", "Won"]
    assert [first[1, c] for c in range(3)] == ["Other", "Lost", "Lost"]
    wide = {(r.row, r.col): r.text for r in extract.transpose_infoboxes(cells.where("infobox"), ["page_id", "table_ix"]).collect()}
    assert [(wide[-1, c], wide[0, c]) for c in range(3)] == [("", "Show & Tell"), ("Country", "US"), ("", "Note")]


def test_islands_join_across_chunks(spark):
    probs = [0.9, 0.8, 0.1, 0.7, 0.6, 0.9, 0.9, 0.2, 0.9, 0.9]
    tokens = spark.createDataFrame([(1, i, 0, i // 5, p) for i, p in enumerate(probs)], "question_id int, ix int, row int, col int, prob double")
    for chunk in (2, 3, 4096):
        got = sorted((r.begin, r.end, round(r.score, 9)) for r in reader.token_islands(tokens, 0.5, chunk).collect())
        mean = lambda ps: round(math.exp(sum(map(math.log, ps)) / len(ps)), 9)
        assert got == [(0, 2, mean(probs[0:2])), (3, 7, mean(probs[3:7])), (8, 10, mean(probs[8:10]))]


def test_alignment_levels_and_ambiguity(spark):
    cells = cells_of(spark, "t", [["h", "i"], ["Café", "x"], ["x", "y"]])
    asked = spark.createDataFrame([("q1", "t"), ("q2", "t"), ("q3", "t")], "question_id string, table_id string")
    answers = spark.createDataFrame([("q1", 0, "cafe"), ("q2", 0, "x"), ("q3", 0, "zzz")], "question_id string, answer_ix int, text string")
    loose = {r.question_id: (r.level, r.row, r.col) for r in align.align_answers(asked, answers, cells).collect()}
    assert loose == {"q1": (3, 0, 0), "q2": (0, 0, 1)}
    assert [r.question_id for r in align.align_answers(asked, answers, cells, strict=True).collect()] == ["q1"]


def test_three_valued_truth(spark):
    rows = [(["1"], ["2"], "<", "TRUE"), (["a"], ["2"], "<", "ERROR"), (["a"], ["a"], "=", "TRUE"), (None, ["a"], "=", "ERROR"), (["3", "5"], ["4"], ">", "FALSE")]
    df = spark.createDataFrame(rows, "l array<string>, r array<string>, c string, want string")
    got = df.select(programs.condition_truth(F.col("l"), F.col("r"), F.col("c")).alias("got"), "want").collect()
    assert all(r.got == r.want for r in got)
    assert df.agg(programs.statement_truth(F.lit("FALSE")).alias("s")).first().s == "FALSE"


def test_max_and_min_ties(spark):
    cells = cells_of(spark, "t", [["n"], ["5"], ["5"], ["1"], ["1"]]).withColumn("is_real", F.lit(True))
    made = [("a", "t", "MAX", 0, []), ("b", "t", "MIN", 0, [])]
    schema = "question_id string, table_id string, agg string, sel int, conds array<struct<col:int,op:string,value:string>>"
    rows = {r.question_id: r.coords[0].row for r in programs.run_programs(spark.createDataFrame(made, schema), cells).collect()}
    assert rows == {"a": 1, "b": 2}


def test_synthetic_statements_are_true_as_labelled(spark):
    cells = cells_of(spark, "t", [["name", "n"], ["a", "1"], ["b", "2"], ["c", "4"]])
    made = generate.synthesize_statements(cells, seed=3).collect()
    assert {r.truth for r in made} <= {"TRUE", "FALSE"} and len(made) == 2
    again = generate.synthesize_statements(cells, seed=3).collect()
    assert sorted(made) == sorted(again)


def test_noisy_coordinates_avoid_gold_and_repeat(spark):
    cells = cells_of(spark, "t", [["a", "b"], ["1", "2"], ["3", "4"]])
    coords = spark.createDataFrame([("q", "t", 0, 0), ("q", "t", 0, 1), ("q", "t", 1, 0)], "question_id string, table_id string, row int, col int")
    got = generate.noisy_coordinates(coords, cells, "full").collect()
    assert [(r.row, r.col) for r in got] == [(1, 1)] * 3


def test_masking_keeps_cap_and_markers(spark):
    cells = cells_of(spark, "t", [["h"] * 3] + [["word"] * 3] * 60)
    questions = spark.createDataFrame([("q", "t", "what is it?")], "question_id string, table_id string, text string")
    masked = linearize.mask_tokens(linearize.serialize(questions, cells), seed=1, rate=0.5, most=20)
    rows = masked.collect()
    assert sum(r.label is not None for r in rows) == 20
    assert all(r.masked == r.token for r in rows if r.token in ("[CLS]", "[SEP]"))


def test_masking_takes_whole_cells_and_at_least_one_token(spark):
    cells = cells_of(spark, "t", [["h", "i"]] + [["three word cell", "one"]] * 20)
    questions = spark.createDataFrame([("q", "t", "what is it?"), ("r", "t", "who?")], "question_id string, table_id string, text string")
    tokens = linearize.serialize(questions, cells)
    length = {r.question_id: r["count"] for r in tokens.groupBy("question_id").count().collect()}
    for rate, most in ((0.0, 20), (0.15, 20), (0.9, 7)):
        rows = linearize.mask_tokens(tokens, seed=2, rate=rate, most=most).collect()
        assert len(rows) == sum(length.values())
        for question, n in length.items():
            mine = [r for r in rows if r.question_id == question]
            assert sum(r.label is not None for r in mine) == min(most, max(1, round(n * rate)))
            of_cell = {}
            for r in mine:
                if r.segment_id == 1:
                    of_cell.setdefault((r.row_id, r.column_id), set()).add(r.label is not None)
            assert all(len(drawn) == 1 for drawn in of_cell.values())


def test_random_crop_grows_until_a_step_does_not_fit(spark):
    cells = cells_of(spark, "t", [["h", "i", "j"]] + [["a b", "c", "d"]] * 200)
    budgets = spark.createDataFrame([("all", "t", 100_000), *((f"q{k}", "t", 12) for k in range(20))], "question_id string, table_id string, budget int")
    got = {r.question_id: r for r in linearize.random_crop(budgets, cells, seed=3).collect()}
    whole = got.pop("all")
    assert (whole.n_cols, whole.n_rows, whole.n_tokens, whole.cost) == (3, 200, 2, 201 * 4 - 1)
    assert all(r.cost <= 12 for r in got.values())
    assert len({(r.n_cols, r.n_rows, r.n_tokens) for r in got.values()}) > 1


def test_counters_count_the_rows_that_pass(spark):
    seen = Observation("numbers")
    passed = reports.with_counters(spark.range(10), seen, even=F.col("id") % 2 == 0)
    assert len(passed.collect()) == 10
    assert seen.get == {"rows": 10, "even": 5}


def test_random_pairs_keep_splits_apart(spark):
    records = spark.range(200).select(F.col("id").cast("string").alias("key"), (F.col("id") % 50).cast("string").alias("table_id"))
    pairs = extract.random_pairs(records, n_bins=4, n_shards=5)
    split = {r.table_id: r.split for r in pairs.collect()}
    for r in pairs.collect():
        assert r.random_table_id != r.table_id
        if r.random_table_id is not None:
            assert split[r.random_table_id] == r.split


def test_count_interpretations(spark):
    cells = cells_of(spark, "t", [["n"], ["1"], ["2"], ["3"]])
    asked = spark.createDataFrame([("q", "t", 2.0)], "question_id string, table_id string, float_answer double")
    rows = generate.count_interpretations(asked, cells).collect()
    assert rows and all(len(r.rows) == 2 and r.agg == "COUNT" for r in rows)


def test_infobox_without_header_keeps_its_first_column(spark):
    cells = spark.createDataFrame(
        [("a", -1, 0, "Name"), ("a", 0, 0, "k"), ("a", 0, 1, "v"), ("b", 0, 0, "k"), ("b", 0, 1, "w")],
        "table_id string, row int, col int, text string",
    )
    got = extract.transpose_infoboxes(cells).where("row = 0").orderBy("table_id", "col").collect()
    assert [(r.table_id, r.col, r.text) for r in got] == [("a", 0, "Name"), ("a", 1, "v"), ("b", 0, "0"), ("b", 1, "w")]


def test_noisy_coordinates_of_mode_none_are_empty(spark):
    coords = spark.createDataFrame([("q", "a", 0, 0)], "question_id string, table_id string, row int, col int")
    cells = spark.createDataFrame([("a", 0, 0, "x"), ("a", 0, 1, "y")], "table_id string, row int, col int, text string")
    assert generate.noisy_coordinates(coords, cells, "none").count() == 0
    assert [(r.row, r.col) for r in generate.noisy_coordinates(coords, cells, "full").collect()] == [(0, 1)]
