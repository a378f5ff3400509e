"""op1 takes the whole path of its method."""

from test_llm_operators import DOC

from quillon.llm import exact_dedup


def test_the_first_batch_meets_the_index_too(spark, monkeypatch):
    plans, write = [], exact_dedup.materialize

    def noted(df, path):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return write(df, path)

    monkeypatch.setattr(exact_dedup, "materialize", noted)
    docs = spark.createDataFrame([(1, "a", "en", "s", 1), (2, "A", "en", "s", 1), (3, "b", "en", "s", 1)], DOC)
    index = exact_dedup.DigestIndex.temporary(spark, 4)
    rows, groups = exact_dedup.deduplicate(docs, index)
    assert any("SortMergeJoin" in p and "LeftAnti" in p and index.name in p for p in plans)
    assert {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.decide(rows, groups).collect()} == {(1, 2, False), (2, 2, True), (3, 3, True)}
    assert index.read().count() == 2
    rows, groups = exact_dedup.deduplicate(docs.filter("doc_id = 1"), index)
    assert [(r["keep_id"], r["kept"]) for r in exact_dedup.decide(rows, groups).collect()] == [(2, False)]
