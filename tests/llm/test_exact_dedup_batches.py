"""The digest index over several batches: replay, whole tables, repeated rows, clashing names."""

import hashlib
from collections import defaultdict

from test_llm_operators import DOC, corpus, docs, lower

from quillon.llm import common, exact_dedup


def marks(rows, groups):
    return {(r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(rows, groups).collect()}


def test_a_batch_may_be_registered_again(spark):
    index = exact_dedup.DigestIndex.temporary(spark)
    exact_dedup.deduplicate(docs(spark, ["a"]), index, "first")
    d = docs(spark, ["A", "b", "B", "c"], 10)
    once = marks(*exact_dedup.deduplicate(d, index, "second"))
    assert once == {(10, 0, 1, False), (11, 12, 2, False), (12, 12, 2, True), (13, 13, 1, True)}
    held = sorted(map(tuple, index.read().collect()))
    assert marks(*exact_dedup.deduplicate(d, index, "second")) == once
    assert sorted(map(tuple, index.read().collect())) == held
    assert not any(m[3] for m in marks(*exact_dedup.deduplicate(d, index, "third")))


def test_a_broken_append_is_completed(spark):
    index = exact_dedup.DigestIndex.temporary(spark)
    d = docs(spark, ["a", "b", "b"])
    some = exact_dedup.group_digests(exact_dedup.digests(d.filter("doc_id = 0")))
    index.append(some, "one")
    assert {m[0] for m in marks(*exact_dedup.deduplicate(d, index, "one")) if m[3]} == {0, 2}
    assert index.read().count() == 2


def test_a_whole_table_meets_the_index_in_parts(spark):
    texts = corpus(40) + ["hot"] * 300
    d = docs(spark, texts)
    for parts in (1, 2, 5):
        index = exact_dedup.DigestIndex.temporary(spark)
        rows, groups = exact_dedup.deduplicate_table(d, index, batches=parts)
        want = defaultdict(list)
        for i, t in enumerate(texts):
            want[lower(t)].append(i)
        assert marks(rows, groups) == {(i, max(v), len(v), i == max(v)) for v in want.values() for i in v}
        assert index.read().count() == len(want)
        assert len({r[0] for r in index.read().select("batch").collect()}) <= parts
        digests = {bytes(r[0]).hex() for r in index.read().select("digest").collect()}
        assert digests == {hashlib.sha256(t.encode()).hexdigest() for t in want}


def test_repeated_rows_null_ids_and_clashing_names(spark):
    rows = [(3, "a"), (3, "A"), (1, "a"), (None, "a"), (None, "n"), (None, "n"), (7, None), (6, ""), (2, "x" * 200_000), (2, "x" * 200_000)]
    d = spark.createDataFrame([(i, t, "e", "s", 1, "1", "2", "3", "4") for i, t in rows], DOC + ", __digest string, __KEEP string, `__own` string, `a.b` string")
    kept = exact_dedup.keep_unique(d)
    assert kept.columns == d.columns
    assert sorted((r["doc_id"] or 0, lower(r["text"])[:1]) for r in kept.collect()) == [(0, "n"), (2, "x"), (3, "a"), (7, "")]
    assert sum(m[3] for m in map(tuple, exact_dedup.decide(*exact_dedup.deduplicate_table(d)).select("doc_id", "keep_id", "group_size", "kept").collect())) == 4
    assert exact_dedup.keep_unique(d.limit(0)).count() == 0


def test_release_drops_the_index_and_leaves_other_work(spark):
    outside = common.materialize(spark.range(3), common.workspace(spark, "outside"))
    with common.scratch(spark):
        index = exact_dedup.DigestIndex.temporary(spark)
        exact_dedup.deduplicate(docs(spark, ["a"]), index)
        assert index.exists()
    assert not index.exists() and outside.count() == 3
