"""What keepers keep, shared doc_ids, groups of batches, and the work on long lists."""

import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_llm_operators import DOC, brute_components, brute_removed, corpus, docs

from quillon.llm import common, exchange, mixing, ngram_join, substring

CLASH = DOC + ", __own string, __place string, __doc_id string, __RANK string, __times string, `a.b` string"


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "en", "src0", 1, "1", "2", "3", "4", "5", "6") for i, t in rows], CLASH)


def test_keep_mixed_takes_exactly_what_was_selected(spark):
    rows = [(5, "word " * 4)] * 5 + [(i, "word " * 4) for i in range(10, 30)] + [(None, "word " * 4)] * 3
    d = clashing(spark, rows)
    for percent, epochs in ((40, 1), (100, 1), (250, 3), (0, 1)):
        mix = mixing.Mix(budget_percent=percent, max_epochs=epochs)
        chosen = Counter(r["doc_id"] for r in mixing.select(d, mix).collect())
        kept = mixing.keep_mixed(d, mix)
        assert kept.columns == d.columns
        assert Counter(r["doc_id"] for r in kept.collect()) == chosen
    assert mixing.keep_mixed(d.limit(0), mixing.Mix()).count() == 0


LONG = " ".join(f"w{i}" for i in range(300))


def test_keep_one_leaves_one_row_of_a_component(spark):
    rows = [(3, LONG), (3, LONG), (7, LONG), (7, LONG + " more"), (9, "own text"), (9, "own text"), (None, LONG), (None, None), (11, None), (12, "")]
    d = clashing(spark, rows)
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == {3: 1, 9: 1, None: 2, 11: 1, 12: 1}
    assert ngram_join.keep_one(d.limit(0)).count() == 0


def test_rows_that_share_a_doc_id_are_one_document(spark):
    other = " ".join(f"v{i}" for i in range(300))
    d = docs(spark, []).union(spark.createDataFrame([(i, t, "", "", 0) for i, t in [(3, LONG), (7, LONG), (7, other), (9, other), (12, "alone"), (9, "alone too")]], DOC))
    got = {(r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()}
    assert got == {(3, 3), (7, 3), (9, 3), (12, 12)}


def test_groups_of_batches_give_the_same_counts(spark, monkeypatch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 400)
    rng = random.Random(2)
    texts = [" ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) + (" hot" if i % 3 else "") for i in range(300)]
    keys_of = lambda b: np.concatenate([np.unique(np.array([hash_(w) for w in t.split()], np.uint64)) for t in b["text"].to_pylist()])
    hash_ = lambda w: int.from_bytes(w.encode(), "big")
    want = Counter(hash_(w) for t in texts for w in set(t.split()))
    packed = exchange.pack(docs(spark, texts), common.workspace(spark, "packed"))
    assert packed.count() > 5
    found = []
    for limit in (4096, 3):
        monkeypatch.setattr(exchange, "GROUP_BATCHES", limit)
        assert (exchange.deal(packed).groups > 1) == (limit == 3)
        rows = exchange.with_answers(packed, exchange.repeated(packed, keys_of)).collect()
        for r in rows:
            keys, counts = exchange.merged([a.asDict() for a in r["answers"] or []])
            mine = {hash_(w) for t in exchange.undump(r["body"])["text"].to_pylist() for w in t.split()}
            assert dict(zip(keys.tolist(), counts.tolist(), strict=True)) == {k: want[k] for k in mine if want[k] > 1}
        found.append(len(rows))
    assert found[0] == found[1]


@pytest.mark.parametrize("hot", [substring.HOT, 2])
def test_substring_dedup_in_groups_of_batches(spark, monkeypatch, hot):
    monkeypatch.setattr(exchange, "BATCH_BYTES", 900)
    monkeypatch.setattr(exchange, "GROUP_BATCHES", 3)
    rng = random.Random(4)
    line = " ".join(f"l{i}" for i in range(14))
    texts = corpus(24) + [f"{rng.random()} {line} {rng.random()} {line[:40]}" for _ in range(40)]
    got = {r["doc_id"]: (r["n_removed"], r["kept_text"]) for r in substring.remove_repeated(docs(spark, texts), 12, hot=hot).collect()}
    assert got == {i: (gone, kept) for i, (_, gone, kept) in enumerate(brute_removed(texts, 12))}


def test_one_list_of_near_copies_is_not_expanded_into_pairs(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:50], *(f"{rng.random():.6f}" for _ in range(rng.randint(0, 3)))]) for _ in range(3000)]
    texts += [" ".join([*base[:25], *(f"o{j}-{i}" for j in range(30))]) for i in range(60)]
    join, at = ngram_join.Join(), common.workspace(spark, "near")
    rows = ngram_join.shingle_table(docs(spark, texts), join, at)
    reps = rows.filter("set_key IS NOT NULL").groupBy("set_key").agg(F.min("doc_id").alias("doc_id"), F.min_by("shingles", "doc_id").alias("shingles"))
    kept = ngram_join.prefix_table(reps.select("doc_id", "shingles"), join, at)
    comps = None
    n = kept.select(F.sum(F.size("prefix"))).first()[0]
    longest = kept.select(F.explode("prefix").alias("p")).groupBy("p").count().agg(F.max("count")).first()[0]
    assert longest >= 2000
    for turn in range(ngram_join.HEAD_TURNS):
        each = ngram_join.postings(kept, comps)
        comps = ngram_join._joined(ngram_join.head_candidates(each, join, turn), kept, comps, join, f"{at}/{turn}")
    left = ngram_join._pairs_left(ngram_join.open_lists(ngram_join.postings(kept, comps)))
    assert left < 50 * n
    got = ngram_join.near_duplicates(docs(spark, texts)).groupBy("component_id").count().collect()
    assert Counter(r["count"] for r in got) == Counter([3000] + [1] * 60)


@pytest.mark.parametrize("block", [4, 7])
def test_large_components_have_blocks_to_themselves(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "PAIRS_A_POSTING", 0)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(40)]
    texts = [" ".join([*base[: rng.choice([20, 22, 30, 38])], *(rng.choice("xyz") for _ in range(rng.randint(0, 3)))]) for _ in range(90)]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == {i: c for i, (_, c) in enumerate(brute_components(texts))}


def test_meetings():
    rng = np.random.default_rng(3)
    group = np.sort(rng.integers(0, 6, 60))
    side = np.where(group % 2, 2, rng.integers(0, 2, 60))
    comp = np.where(side == 2, rng.integers(0, 4, 60), 10 + side)
    order = np.lexsort((comp, side, group))
    group, side, comp = group[order], side[order], comp[order]
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if group[i] == group[j] and ((side[i], side[j]) == (0, 1) or (side[i] == side[j] == 2 and comp[i] != comp[j]))}
    for chunk in (1, 7, 1 << 20):
        ngram_join.CHUNK, before = chunk, ngram_join.CHUNK
        got = [(int(i), int(j)) for a, b in ngram_join.meetings(group, side, comp) for i, j in zip(a, b, strict=True)]
        ngram_join.CHUNK = before
        assert len(got) == len(set(got)) and set(got) == want
