"""Leaf-wise boosted trees on binned features, for two classes.

Rows stay where they are: the tasks of one barrier stage each hold a part of them, binned to a byte a feature, add
up their part's gradients by leaf, feature and bin, and exchange these sums, whose size depends on the
number of features alone. From equal sums every task grows the same trees: always the leaf with the largest gain next. Sums
are exchanged for all open leaves at once, so that a tree takes as many exchanges as it is deep. A lost executor
repeats the stage.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import BarrierTaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.params import MetaParams

#: Bins of a feature, and rows and binned values of a training task: few tasks, as an exchange between them takes about a second.
BINS = 255
TASK_ROWS = 3_000_000
TASK_VALUES = 30_000_000
#: Binned values that are added up at once.
CHUNK = 1 << 18
#: Least sum of second derivatives in a leaf (a fixed value).
LEAST_HESSIAN = 1e-3
TREES = "tree int, node int, feature int, threshold double, left int, right int, value double, gain double, rows bigint"


@dataclass(frozen=True)
class Split:
    gain: float
    feature: int
    bin: int
    left: np.ndarray
    right: np.ndarray


def bin_edges(rows: DataFrame, features: Sequence[str], bins: int = BINS) -> list[np.ndarray]:
    """For each feature the values up to which its bins go, the last bin excluded: quantiles, each value once."""
    shares = [i / bins for i in range(1, bins)]
    quoted = [F.col(f"`{c}`").cast("double") for c in features]
    found = rows.agg(*(F.percentile_approx(c, shares, 10 * bins * bins).alias(f"e{i}") for i, c in enumerate(quoted)), *(F.max(c).alias(f"m{i}") for i, c in enumerate(quoted))).first()
    edges = [np.unique(np.array(found[f"e{i}"], float)) for i in range(len(features))]
    return [e[e < found[f"m{i}"]] for i, e in enumerate(edges)]


def best_split(sums: np.ndarray, used: np.ndarray, p: MetaParams) -> Split | None:
    """The best split of a leaf with ``sums`` (feature, bin, [gradient, hessian, rows]); of equal ones the first feature
    and bin. None if no split gains anything."""
    left = np.cumsum(sums, axis=1)
    total = left[:, -1:, :]
    right = total - left
    # the shrunken square of a gradient sum over its hessian
    score = lambda s: np.maximum(np.abs(s[..., 0]) - p.reg_alpha, 0) ** 2 / np.maximum(s[..., 1] + p.reg_lambda, 1e-300)
    fits = [(s[..., 2] >= p.min_child_samples) & (s[..., 2] > 0) & (s[..., 1] >= LEAST_HESSIAN) for s in (left, right)]
    gain = np.where(fits[0] & fits[1] & used[:, None], score(left) + score(right) - score(total), -np.inf)
    at = int(np.argmax(gain))
    f, b = divmod(at, gain.shape[1])
    return Split(float(gain[f, b]), f, b, left[f, b], right[f, b]) if gain[f, b] > 1e-12 else None


def leaf_value(total: np.ndarray, p: MetaParams) -> float:
    g = np.sign(total[0]) * max(abs(total[0]) - p.reg_alpha, 0)
    return float(-p.learning_rate * g / (total[1] + p.reg_lambda))


class _Grower:
    """A task's part of the rows and the trees so far. A row is kept as its codes (a byte a feature), label, weight, margin and place in
    a leaf's list, some 30 bytes besides the codes; all else is made for CHUNK values at a time."""

    def __init__(self, codes: np.ndarray, y: np.ndarray, w: np.ndarray, width: int, p: MetaParams, together):
        self.codes, self.y, self.w, self.p, self.together = codes, y, w, p, together
        self.n_features, self.width = codes.shape[1], width
        self.margin = np.zeros(len(y))
        self.first = np.arange(self.n_features) * width
        self.step = max(1, CHUNK // max(1, self.n_features))

    def sums(self, parts: list[np.ndarray]) -> list[np.ndarray]:
        """The sums over all tasks, for each of the row lists ``parts``."""
        size = self.n_features * self.width
        out = np.zeros((len(parts), size, 3))
        for total, rows in zip(out, parts, strict=True):
            for i in range(0, len(rows), self.step):
                own = rows[i : i + self.step]
                at = (self.codes[own] + self.first).ravel()
                chance, w = 1 / (1 + np.exp(-self.margin[own])), self.w[own]
                for k, v in enumerate((w * (chance - self.y[own]), w * chance * (1 - chance))):
                    total[:, k] += np.bincount(at, np.repeat(v, self.n_features), size)
                total[:, 2] += np.bincount(at, minlength=size)
        return list(self.together(out).reshape(len(parts), self.n_features, self.width, 3))

    def halves(self, rows: np.ndarray, s: Split) -> tuple[np.ndarray, np.ndarray]:
        goes = np.concatenate([np.zeros(0, bool), *(self.codes[rows[i : i + CHUNK], s.feature] <= s.bin for i in range(0, len(rows), CHUNK))])
        return rows[goes], rows[~goes]

    def tree(self, number: int) -> list[tuple]:
        """Nodes (node, feature, bin, left, right, value, gain, rows) of the next tree, which is added to the margins."""
        p = self.p
        used = np.zeros(self.n_features, bool)
        rng = np.random.default_rng([p.seed, number])
        used[rng.permutation(self.n_features)[: max(1, round(self.n_features * p.colsample_bytree))]] = True
        rows, depth, total, nodes = {0: np.arange(len(self.y), dtype=np.uint32)}, {0: 0}, {}, {}
        split: dict[int, Split | None] = {}
        halves: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        sums = {0: self.sums([rows[0]])[0]}
        total[0], split[0] = sums[0][0].sum(axis=0), best_split(sums[0], used, p) if p.max_depth else None
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        queue = [(-split[0].gain, 0)] if split[0] else []
        leaves, made = 1, 1
        while queue and leaves < p.num_leaves:
            _, node = queue[0]
            if node not in known:
                ask = [n for _, n in queue if n not in known]
                for n in ask:
                    halves[n] = self.halves(rows.pop(n), split[n])
                # the smaller half is summed, the other is what is left
                small = [0 if split[n].left[2] <= split[n].right[2] else 1 for n in ask]
                for n, k, found in zip(ask, small, self.sums([halves[n][k] for n, k in zip(ask, small, strict=True)]), strict=True):
                    rest = sums[n] - found
                    known[n] = (found, rest) if k == 0 else (rest, found)
            heapq.heappop(queue)
            s, (left, right) = split[node], (made, made + 1)
            made, leaves = made + 2, leaves + 1
            nodes[node] = (s.feature, s.bin, left, right, s.gain)
            for child, own, part, end in zip((left, right), known.pop(node), halves.pop(node), (s.left, s.right), strict=True):
                rows[child], sums[child], total[child], depth[child] = part, own, end, depth[node] + 1
                deep = p.max_depth >= 0 and depth[child] >= p.max_depth
                split[child] = None if deep else best_split(own, used, p)
                if split[child]:
                    heapq.heappush(queue, (-split[child].gain, child))
            del sums[node]
        # leaves that were halved for nothing
        rows |= {n: np.concatenate(both) for n, both in halves.items()}
        out = []
        for n in range(made):
            if n in nodes:
                f, b, left, right, gain = nodes[n]
                out.append((n, f, b, left, right, None, gain, int(round(total[n][2]))))
            else:
                value = leaf_value(total[n], p)
                self.margin[rows[n]] += value
                out.append((n, None, None, None, None, value, None, int(round(total[n][2]))))
        return out


def _typed(trees: pd.DataFrame) -> pd.DataFrame:
    """NULLs of whole-numbered columns as such."""
    return trees.astype({c: "Int32" for c in ("feature", "left", "right")})


def train(rows: DataFrame, features: Sequence[str], label: str, weight: str, p: MetaParams, n_rows: int, edges: list[np.ndarray] | None = None) -> pd.DataFrame:
    """The trees (TREES) for ``rows``, whose features, ``label`` (0 or 1) and ``weight`` aren't NULL. At most
    ``n_estimators * (2 * num_leaves - 1)`` rows."""
    spark = rows.sparkSession
    edges = bin_edges(rows, features) if edges is None else edges
    width = max((len(e) for e in edges), default=0) + 1
    wanted = max(-(-n_rows // TASK_ROWS), -(-n_rows * len(edges) // TASK_VALUES))
    parts = max(1, min(wanted, spark.sparkContext.defaultParallelism))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = BarrierTaskContext.get()
        held = bytearray(), bytearray(), bytearray()
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            held[0].extend(np.column_stack([np.searchsorted(e, c).astype(np.uint8) for e, c in zip(edges, columns, strict=False)]).tobytes())
            held[1].extend(columns[-2].astype(np.uint8).tobytes())
            held[2].extend(columns[-1].astype(float).tobytes())
        codes, y, w = (np.frombuffer(x, kind) for x, kind in zip(held, (np.uint8, np.uint8, float), strict=True))

        def together(own: np.ndarray) -> np.ndarray:
            if parts == 1:
                return own
            every = context.allGather(base64.b64encode(own.tobytes()).decode())
            return sum(np.frombuffer(base64.b64decode(x)).reshape(own.shape) for x in every)

        grower = _Grower(codes.reshape(len(y), len(edges)), y, w, width, p, together)
        for t in range(p.n_estimators):
            tree = grower.tree(t)
            if context.partitionId() == 0:
                columns = list(zip(*((t, n, f, None if f is None else float(edges[f][b]), left, right, value, gain, count) for n, f, b, left, right, value, gain, count in tree), strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), kind) for c, kind in zip(columns, _KINDS, strict=True)], [n.split()[0] for n in TREES.split(", ")])

    own = rows.select(*(F.col(f"`{c}`").cast("double") for c in features), F.col(label).cast("double"), F.col(weight).cast("double"))
    # whole rows are the key, so that a repeated stage deals them alike
    spread = own.repartition(parts, *own.columns)
    return _typed(spread.mapInArrow(run, TREES, barrier=True).toPandas())


_KINDS = (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.int64())


def margins(trees: pd.DataFrame):
    """A function of an array of features: the sum of the trees' values, NULL where a feature is NULL."""
    ordered = trees.sort_values(["tree", "node"], ignore_index=True)
    first = ordered.groupby("tree")["node"].transform("size").groupby(ordered["tree"]).first().cumsum().shift(fill_value=0)
    base = ordered["tree"].map(first).to_numpy()
    leaf = ordered["feature"].isna().to_numpy()
    feature = ordered["feature"].fillna(0).astype(int).to_numpy()
    threshold = np.where(leaf, np.inf, ordered["threshold"].to_numpy(float))
    here = np.arange(len(ordered))
    left = np.where(leaf, here, ordered["left"].fillna(0).astype(int).to_numpy() + base)
    right = np.where(leaf, here, ordered["right"].fillna(0).astype(int).to_numpy() + base)
    value, roots = ordered["value"].fillna(0.0).to_numpy(float), first.to_numpy(int)

    @F.pandas_udf("double")
    def of(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=float)
        m = np.array([np.array(v, float) for v in x])
        total, row = np.zeros(len(m)), np.arange(len(m))
        for root in roots:
            at = np.full(len(m), root)
            while not leaf[at].all():
                at = np.where(m[row, feature[at]] <= threshold[at], left[at], right[at])
            total += value[at]
        return pd.Series(np.where(np.isnan(m).any(axis=1), np.nan, total))

    return of
