import json

from lexiloom.sources import packed


def test_one_object_is_read_alone(spark, tmp_path):
    path = str(tmp_path / "objects")
    rows = [(i, f"title {i}", "x" * (i % 50), None if i % 3 else i) for i in range(3000)]
    packed.write_packed_objects(spark.createDataFrame(rows, "page_id long, title string, body string, n long"), path)
    assert json.loads(packed.packed_object(spark, path, 1234)) == {"title": "title 1234", "body": "x" * 34} and packed.packed_object(spark, path, -1) is None
    some = {r.page_id: json.loads(r.object) for r in packed.packed_objects(spark, path, [3, 2999]).collect()}
    assert some == {3: {"title": "title 3", "body": "xxx", "n": 3}, 2999: {"title": "title 2999", "body": "x" * 49}}
    plan = packed.packed_objects(spark, path).where("page_id = 7")._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,7)]" in plan
    assert packed.packed_objects(spark, path).count() == 3000


def test_model_tables_join_without_a_shuffle(spark, tmp_path):
    idf = spark.createDataFrame([(f"w{i}", i / 7) for i in range(500)], "word string, idf double")
    near = spark.createDataFrame([(f"w{i}", f"w{i * 3 % 500}", 0.5) for i in range(500)], "word string, other string, score double")
    values = spark.createDataFrame([(f"w{i}", "s", float(i)) for i in range(500)], "word string, state string, value double")
    packed.write_model_tables({"idf": idf, "neighbours": near, "policy_values": values}, "model_test", str(tmp_path), buckets=4)
    try:
        a, b, c = (packed.model_table(spark, "model_test", n) for n in ("idf", "neighbours", "policy_values"))
        joined = a.join(b.hint("merge"), "word").join(c.hint("merge"), "word")
        plan = joined._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        assert "SortMergeJoin" in plan and "Exchange" not in plan
        assert joined.count() == 500 and {(r.word, r.idf) for r in a.collect()} == {(r.word, r.idf) for r in idf.collect()}
    finally:
        spark.sql("DROP DATABASE model_test CASCADE")
