"""Tables that share a digest index, and rows that repeat the kept doc_id."""

from quillon.llm import exact_dedup

DOC = "doc_id bigint, text string, note string"


def table(spark, *rows):
    return spark.createDataFrame([(i, t, n) for i, t, n in rows], DOC)


def test_a_second_table_is_not_a_replay_of_the_first(spark):
    index = exact_dedup.DigestIndex.temporary(spark, 10)
    exact_dedup.deduplicate_table(table(spark, (1, "aa", ""), (2, "bb", "")), index)
    second = table(spark, (1, "aa", ""), (3, "bb", ""), (4, "cc", ""))
    assert [r["doc_id"] for r in exact_dedup.keep_unique(second, index).collect()] == [4]
    # the same table without a name is a table of its own: nothing of it is new
    assert exact_dedup.keep_unique(second, index).count() == 0


def test_only_a_given_name_is_a_replay(spark):
    index = exact_dedup.DigestIndex.temporary(spark, 10)
    first = table(spark, (1, "aa", ""), (2, "bb", ""), (5, "AA", ""))
    for _ in range(2):
        assert sorted(r["doc_id"] for r in exact_dedup.keep_unique(first, index, "monday").collect()) == [2, 5]
    assert index.read().count() == 2
    assert exact_dedup.keep_unique(first, index, "tuesday").count() == 0


def test_of_rows_with_one_doc_id_and_text_the_same_one_stays(spark):
    rows = [(7, "aa", str(n)) for n in range(40)]
    kept = {exact_dedup.keep_unique(table(spark, *rows).repartition(n)).first()["note"] for n in (1, 3, 7)}
    assert len(kept) == 1


def test_maps_nulls_and_odd_names_survive(spark):
    docs = spark.createDataFrame([(1, "a", {"k": 1}, "x"), (1, "a", {"k": 2}, "x"), (None, None, None, None)], "doc_id bigint, text string, `m.x` map<string,int>, __row string")
    kept = exact_dedup.keep_unique(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0, r["__row"] or "") for r in kept.collect()) == [(0, ""), (1, "x")]
