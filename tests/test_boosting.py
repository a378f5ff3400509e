"""Leaf-wise trees against a plain greedy version, whole and in several tasks."""

import math

import numpy as np
import pytest

from quillon.operators import boosting, meta
from quillon.params import MetaParams


def data(n=400, seed=1):
    rng = np.random.default_rng(seed)
    x = np.column_stack([rng.normal(size=n), rng.integers(0, 6, n).astype(float), rng.normal(size=n)])
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 3) | (rng.random(n) < 0.1)).astype(float)
    return x, y


def plain_boost(x, y, p):
    """Every distinct value is a threshold; the leaf with the largest gain is split next."""
    n, (rows, cols) = len(y), x.shape
    w = np.where(y == 1, n / (2 * y.sum()), n / (2 * (n - y.sum())))
    margin, trees = np.zeros(rows), []
    for t in range(p.n_estimators):
        chance = 1 / (1 + np.exp(-margin))
        g, h = w * (chance - y), w * chance * (1 - chance)
        used = sorted(np.random.default_rng([p.seed, t]).permutation(cols)[: max(1, round(cols * p.colsample_bytree))])

        def best(at):
            found, parent = None, g[at].sum() ** 2 / h[at].sum()
            for f in used:
                for v in sorted(set(x[at, f]))[:-1]:
                    a, b = at[x[at, f] <= v], at[x[at, f] > v]
                    if min(len(a), len(b)) < p.min_child_samples or min(h[a].sum(), h[b].sum()) < boosting.LEAST_HESSIAN:
                        continue
                    gain = g[a].sum() ** 2 / h[a].sum() + g[b].sum() ** 2 / h[b].sum() - parent
                    if gain > 1e-12 and (found is None or gain > found[0] + 1e-9):
                        found = (gain, f, v, a, b)
            return found

        leaves = [(np.arange(rows), best(np.arange(rows)))]
        while len(leaves) < p.num_leaves and any(s for _, s in leaves):
            i = max((i for i, (_, s) in enumerate(leaves) if s), key=lambda i: leaves[i][1][0])
            _, (_, _, _, a, b) = leaves.pop(i)
            leaves += [(a, best(a)), (b, best(b))]
        for at, _ in leaves:
            margin[at] += -p.learning_rate * g[at].sum() / h[at].sum()
        trees.append(len(leaves))
    return 1 / (1 + np.exp(-margin)), trees


@pytest.mark.parametrize("task_rows", [100_000, 150])
def test_trees_are_the_plain_ones(spark, monkeypatch, task_rows):
    monkeypatch.setattr(boosting, "TASK_ROWS", task_rows)  # one task, or three that exchange sums
    x, y = data()
    x = x.round(1)  # fewer values than bins, so that every value is an edge
    p = MetaParams(n_estimators=12, num_leaves=7, min_child_samples=10, colsample_bytree=0.7)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, `c.d` double, y int")
    model = meta.fit(df, ["a", "b", "c.d"], p)
    want, leaves = plain_boost(x, y, p)
    got = model.probabilities(df).orderBy("i").toPandas()["prob"].to_numpy()
    np.testing.assert_allclose(got, want, rtol=1e-9)
    assert model.trees[model.trees["feature"].isna()].groupby("tree").size().tolist() == leaves


def test_a_task_keeps_few_bytes_a_row_and_adds_up_in_chunks(monkeypatch):
    import tracemalloc

    rng = np.random.default_rng(3)
    n, p = 600_000, MetaParams(n_estimators=2, num_leaves=6, colsample_bytree=1.0)
    codes, w = rng.integers(0, 50, (n, 4), np.uint8), rng.random(n) + 0.5
    y = (codes[:, 1] + rng.integers(0, 60, n) > 55).astype(float)
    tracemalloc.start()
    grower = boosting._Grower(codes, y, w, 50, p, lambda own: own)
    trees = [grower.tree(t) for t in range(2)]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40 * n
    monkeypatch.setattr(boosting, "CHUNK", 1 << 30)  # all at once
    whole = boosting._Grower(codes, y, w, 50, p, lambda own: own)
    for a, b in zip(trees, [whole.tree(t) for t in range(2)], strict=True):
        assert [x[:5] + x[7:] for x in a] == [x[:5] + x[7:] for x in b]
    np.testing.assert_allclose(grower.margin, whole.margin, rtol=1e-9)


def test_depth_limit_and_regularisation(spark):
    x, y = data()
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    shallow = meta.fit(df, ["a", "b", "c"], MetaParams(n_estimators=3, max_depth=2)).trees
    assert (shallow.groupby("tree").size() <= 7).all()
    small, large = (meta.fit(df, ["a", "b", "c"], MetaParams(n_estimators=1, reg_lambda=v)).trees["value"].abs().max() for v in (0.0, 1000.0))
    assert large < small / 2
    none = meta.fit(df, ["a", "b", "c"], MetaParams(n_estimators=1, reg_alpha=1e9)).trees
    assert len(none) == 1 and none["value"].iloc[0] == 0


def test_rows_with_gaps_and_a_saved_model(spark, tmp_path):
    x, y = data(120)
    df = spark.createDataFrame([(*map(float, r), int(t)) for r, t in zip(x, y, strict=True)], "a double, b double, c double, y int")
    model = meta.fit(df, ["a", "b", "c"], MetaParams(n_estimators=5, min_child_samples=5))
    model.save(str(tmp_path / "m"))
    again = meta.MetaModel.load(str(tmp_path / "m"))
    assert again.params == model.params
    gap = spark.createDataFrame([(1.0, None, 2.0), (1.0, 2.0, 2.0)], "a double, b double, c double")
    got = [m.probabilities(gap).orderBy("b").collect() for m in (model, again)]
    assert got[0] == got[1] and got[0][0]["prob"] is None and 0 < got[0][1]["prob"] < 1
    assert again.probabilities(gap.limit(0)).count() == 0


def test_default_trees_learn(spark):
    x, y = data(3000, 7)
    df = spark.createDataFrame([(i, *map(float, r), int(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "i int, a double, b double, c double, y int")
    model = meta.fit(df.filter("i % 3 > 0"), ["a", "b", "c"])
    assert model.trees["tree"].nunique() == 400
    held = model.probabilities(df.filter("i % 3 = 0")).toPandas()
    assert ((held["prob"] > 0.5) == (held["y"] == 1)).mean() > 0.85
    loss = -np.where(held["y"] == 1, np.log(held["prob"]), np.log1p(-held["prob"])).mean()
    assert math.isfinite(loss)
