"""The fitted models of op5 and op6 against plain fits and walks."""

import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from quillon.llm import quality, urls


def plain_isotonic(counts, ones):
    """The largest of the smallest means of runs around a bin, ends included."""
    full = [i for i, c in enumerate(counts) if c]
    mean = lambda a, b: sum(ones[i] for i in full[a : b + 1]) / sum(counts[i] for i in full[a : b + 1])
    levels = [max(min(mean(a, b) for b in range(i, len(full))) for a in range(i + 1)) for i in range(len(full))]
    return np.interp(np.arange(len(counts)), full, levels)


def test_isotonic_is_the_plain_one():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(0, 9, 40).astype(float)
        ones = np.array([rng.integers(0, int(c) + 1) for c in counts], float)
        np.testing.assert_allclose(quality.isotonic(counts, ones), plain_isotonic(counts, ones), atol=1e-12)


def test_ridge_over_fourier_features_is_the_plain_one(spark):
    rng = np.random.default_rng(9)
    n = 400
    x = rng.normal(0, 2, (n, quality.N_STATS)).round(3)
    x[:, 4] = 1.5  # a statistic that doesn't vary
    y = (x[:, 0] + rng.normal(0, 1, n) > 0).astype(int)
    rows = spark.createDataFrame([(r.tolist(), int(t)) for r, t in zip(x, y, strict=True)], "stats array<double>, y int").repartition(5)
    model = quality.fit(rows)
    mean, scale = x.mean(0), x.std(0)
    scale[4] = 1.0
    np.testing.assert_allclose(model.mean, mean, atol=1e-6)
    np.testing.assert_allclose(model.scale, scale, rtol=1e-3)
    draws = np.random.default_rng(20240301)
    directions = draws.normal(0, 1 / quality.WIDTH, (quality.N_STATS, quality.N_FEATURES))
    phases = draws.uniform(0, 2 * math.pi, quality.N_FEATURES)
    z = np.array([[math.cos(sum(min(8, max(-8, (v - m) / s)) * w for v, m, s, w in zip(r, model.mean, model.scale, directions[:, k], strict=True)) + phases[k]) for k in range(quality.N_FEATURES)] + [1.0] for r in x])
    # the same minimum by least squares over rows that stand for the penalty
    penalty = math.sqrt(quality.RIDGE * n / z.shape[1])
    want = np.linalg.lstsq(np.vstack([z, penalty * np.eye(z.shape[1])]), np.concatenate([y, np.zeros(z.shape[1])]), rcond=None)[0]
    np.testing.assert_allclose(model.raw(x), z @ want, atol=2e-2)
    assert np.corrcoef(model.weights, want)[0, 1] > 0.999
    score = model.score(x)
    order = np.argsort(model.raw(x))
    assert (np.diff(score[order]) >= 0).all() and 0 <= score.min() and score.max() <= 1
    shuffled = quality.fit(rows.repartition(3))
    assert (shuffled.weights == model.weights).all() and (shuffled.levels == model.levels).all()  # sums are exact


def test_ties_of_statistics_score_alike(spark):
    texts = ["good words in a row, quite a few of them."] * 6 + ["x1!! $$ ##"] * 6
    d = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, int(i < 6)) for i in range(12)], "doc_id bigint, quality int")
    got = {r["doc_id"]: r["score"] for r in quality.classify(d, labels).collect()}
    assert len({got[i] for i in range(6)}) == 1 and len({got[i] for i in range(6, 12)}) == 1 and got[0] > got[6]


def walk(node, x):
    while node.getClass().getSimpleName() == "InternalNode":
        split = node.split()
        node = node.leftChild() if x[split.featureIndex()] <= split.threshold() else node.rightChild()
    return node.prediction()


@pytest.mark.parametrize("threshold", [0.5])
def test_verdicts_are_those_of_a_walk_through_the_trees(spark, threshold):
    rng = np.random.default_rng(5)
    hosts = ["a.com", "b.com", "example.com", "x.net", "y.net", "other.org", "z.io"]
    paths = ["/en/a", "/es/b", "/fr/c", "/q?x=1&y=22", "/long-path/with-dashes/9", "", "/#top"]
    rows = [(i, f"https://{rng.choice(hosts)}{rng.choice(paths)}{rng.integers(0, 99)}") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string")
    lex = urls.lexical(pages)
    full = urls.with_suffixes(lex, urls.suffix_statistics(lex))
    model = urls.fit(full)
    vectors = VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(full)
    shown = model.transform(vectors).select("page_id", F.col("ruled.verdict").alias("ruled"), vector_to_array("features").alias("x"), vector_to_array("probability")[1].alias("p")).collect()
    trees = [(t._java_obj.rootNode() if hasattr(t, "_java_obj") else t._call_java("rootNode"), w) for t, w in zip(model.trees, model.treeWeights, strict=True)]
    judged = {r["page_id"]: r for r in urls.judge(pages, threshold).collect()}
    for r in shown[:120]:
        margin = sum(w * walk(root, r["x"]) for root, w in trees)
        chance = 1 / (1 + math.exp(-2 * margin))
        assert r["p"] == pytest.approx(chance, abs=1e-9) and judged[r["page_id"]]["block_score"] == pytest.approx(chance, abs=1e-9)
        assert judged[r["page_id"]]["verdict"] == (r["ruled"] or ("block" if chance >= threshold else "allow"))
