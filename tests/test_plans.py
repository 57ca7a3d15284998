from tabloom.plans.retrieval import evaluate_dense


def test_evaluate_dense(spark):
    unit = [[float(i == j) for j in range(4)] for i in range(4)]
    queries = spark.createDataFrame([(q, t, unit[i]) for i, (q, t) in enumerate(zip("wxyz", ["a", "b", "c", "gone"]))], "query_id string, table_id string, embedding array<double>")
    rows = [("a", unit[1], 0), ("a", unit[0], 1), ("b", unit[1], 2), ("c", unit[3], 3), ("d", unit[2], 4)]
    tables = spark.createDataFrame(rows, "table_id string, embedding array<double>, position int")
    found, scores = evaluate_dense(queries, tables, k=3, cutoffs=(1, 3))
    assert found.where("query_id = 'w' AND rank = 1").first().table_id == "a"
    row = scores.first()
    # The query whose gold table is missing is not scored; c is the last of three equal scores or cut.
    assert round(row.hit_at_1, 6) == round(2 / 3, 6)
