"""Every stage on a small folder: clean documents stay, each stage's own cases go."""

import corpus_pipeline
from pyspark.sql import functions as F

WORDS = "river stone mill old bridge water light morning road field house garden winter letter north market".split()


def _prose(seed, n=60):
    return " ".join(WORDS[(seed * 7 + k * k + k * seed) % len(WORDS)] + ("," if (k + seed) % 9 == 0 else "") for k in range(n))


def test_pipeline(spark, tmp_path):
    clean = [(k, _prose(k) + f" number{k}") for k in range(80)]
    junk = [(200 + k, " | ".join(["SALE"] * (20 + k))) for k in range(60)]
    item = "a benchmark question about seventeen purple elephants crossing the frozen lake at dawn"
    extra = [(300, clean[0][1]), (301, _prose(301) + " " + item), (302, _prose(302) + " write to someone@mail.example.com"), (303, None), (304, "")]
    rows = [(i, t, "en", "s", len(t or "")) for i, t in clean + junk + extra]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i, _ in clean] + [(i, 0, 0) for i, _ in junk], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/in/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/in/documents.parquet")
    seen = []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, f"{tmp_path}/in").write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        seen.append({r.doc_id for r in docs.select("doc_id").collect()})
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert not seen[0] & {i for i, _ in junk} and {i for i, _ in clean} <= seen[0]
    assert 300 in seen[0] and 300 not in seen[1]
    assert 301 in seen[1] and 301 not in seen[2]
    cleaned = {r.doc_id: r.text for r in spark.read.parquet(f"{tmp_path}/stage3").collect()}
    assert cleaned[302].endswith("[EMAIL]") and cleaned[1] == clean[1][1]
    assert seen[4] == seen[3] == seen[2]
    whole = corpus_pipeline.run(spark, f"{tmp_path}/in")
    assert whole.select(F.min("n_tokens")).first()[0] is not None and whole.count() == len(seen[4])


def test_near_duplicates_with_null_and_repeated_ids(spark):
    text = {k: " ".join(f"{k}{n}" for n in range(40)) for k in "abcdefg"}
    rows = [(None, "a"), (1, "b"), (1, "c"), (None, "d"), (5, "d"), (None, "d"), (2, "e"), (3, "e"), (3, "f"), (4, "g"), (4, "g")]
    docs = spark.createDataFrame([(i, text[k], k, "s", 1) for i, k in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.one_of_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted(((r.doc_id, r.lang) for r in kept.collect()), key=lambda x: x[1])
    assert got == [(None, "a"), (1, "b"), (1, "c"), (5, "d"), (2, "e"), (3, "f"), (4, "g")]


def test_stages_with_clashing_names_long_texts_and_empty_tables(spark, tmp_path):
    names = ["score", "hits", "_score", "_hits", "_row1", "_row2", "_k1", "_k2", "_spans", "_doc", "k1", "fp", "t", "kind"]
    schema = "doc_id long, text string, n_chars long, " + ", ".join(f"{n} string" for n in names)
    texts = [(1, _prose(1)), (1, _prose(1)), (None, _prose(2)), (2, "write to someone@mail.example.com " + _prose(3)), (3, _prose(4, 150_000)), (4, None), (5, "")]
    docs = spark.createDataFrame([(i, t, len(t or ""), *names) for i, t in texts], schema)
    folder = f"{tmp_path}/in"
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    empty = docs.limit(0)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for table, kind in ((docs, "docs"), (empty, "empty")):
            stage(spark, table, folder).write.parquet(f"{tmp_path}/{kind}{k}")
        docs, empty = (spark.read.parquet(f"{tmp_path}/{kind}{k}") for kind in ("docs", "empty"))
        assert empty.count() == 0
        if k < 4:
            assert docs.columns == empty.columns == ["doc_id", "text", "n_chars", *names]
            assert {tuple(r[n] for n in names) for r in docs.collect()} == {tuple(names)}
        assert docs.count() == (7 if k == 0 else 5)
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "3", "4", "None"]
