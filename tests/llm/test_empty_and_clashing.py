"""Empty tables for encode, and names that clash for keep_good."""

import os

import pytest

from quillon.llm import pieces, quality


@pytest.mark.skipif(not os.path.exists(pieces.MODEL), reason="needs the model file")
def test_encode_of_nothing_and_of_a_long_text(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string, n_tokens string")
    assert pieces.encode(none, decode=True).count() == 0
    long = "ab cd " * 170_000  # a megabyte
    got = pieces.encode(spark.createDataFrame([(1, long), (1, long)], "doc_id bigint, text string"), decode=True).collect()
    assert len(got) == 2 and got[0] == got[1] and got[0]["decoded"] == long


def test_keep_good_keeps_columns_of_any_name(spark):
    rows = [(i, "plain words in a row here" if i % 2 else "$$ ## 1!", "s", float(i)) for i in range(20)]
    d = spark.createDataFrame(rows, "doc_id bigint, text string, stats string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(20)], "doc_id bigint, quality int")
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {tuple(r) for r in kept.collect()} == {r for r in rows if r[0] % 2}
    assert quality.keep_good(d.limit(0), labels).count() == 0
