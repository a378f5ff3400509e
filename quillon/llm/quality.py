"""Quality classifier: random Fourier features of document statistics approximate a Gaussian kernel;
normal equations summed over partitions fit ridge scores; isotonic regression calibrates them.

Sums are exact and so don't depend on the order of partitions: features are rounded to multiples of
1/QUANTUM, so that products are whole numbers far below 2^53.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import materialize, workspace
from quillon.llm.wordhash import words

N_STATS = 20
#: Random features, the kernel's width (in standard deviations of a statistic) and the ridge penalty.
N_FEATURES = 192
WIDTH = 4.0
RIDGE = 1e-3
QUANTUM = 1024
#: Raw scores are counted in so many bins before the isotonic fit.
SCORE_BINS = 2048
THRESHOLD = 0.3
_STEP = 1 << 20

_CLASS = np.zeros(256, np.uint8)  # 0: other control bytes
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10] = 4, 5
_CLASS[[ord(c) for c in ".!?"]], _CLASS[[ord(c) for c in ",;:'\"()-"]] = 6, 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{|}~"]] = 8
_CLASS[128:] = 9


def statistics(texts: pa.Array) -> np.ndarray:
    """N_STATS statistics of each whole text; an empty or null text has zeros."""
    w = words(texts)
    n = len(w.offsets) - 1
    sizes, counts = np.diff(w.offsets), np.diff(w.bounds)
    kinds = _CLASS[w.data]
    text_of = np.repeat(np.arange(n), sizes)
    classes = np.bincount(text_of * 10 + kinds, minlength=n * 10).reshape(n, 10).astype(float)
    word_of = np.repeat(np.arange(n), counts)
    lengths = (w.ends - w.starts).astype(float)
    per_word = lambda v: np.bincount(word_of, v, minlength=n)
    mean = lambda total, over: total / np.maximum(over, 1)
    mean_length = mean(per_word(lengths), counts)
    spread = np.sqrt(np.maximum(mean(per_word(lengths**2), counts) - mean_length**2, 0))
    ends = kinds[w.ends - 1] if len(w.ends) else np.zeros(0, np.uint8)
    # how often the commonest word and repeated words and word pairs occur
    distinct, top = np.zeros(n), np.zeros(n)
    pair_share, line_share = np.zeros(n), np.zeros(n)
    pairs = w.grams(2)
    bounds = w.bounds
    raw = w.data.tobytes()
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if a == b:
            continue
        seen = np.sort(w.hashes[a:b])
        runs = np.flatnonzero(np.concatenate([[True], seen[1:] != seen[:-1], [True]]))
        distinct[i], top[i] = (len(runs) - 1) / (b - a), np.diff(runs).max() / (b - a)
        if b - a > 1:
            two = np.sort(pairs[a : b - 1])
            pair_share[i] = ((two[1:] != two[:-1]).sum() + 1) / len(two)
        lines = raw[w.offsets[i] : w.offsets[i + 1]].split(b"\n")
        line_share[i] = len(set(lines)) / len(lines)
    out = np.column_stack(
        [
            np.log1p(sizes),
            np.log1p(counts),
            mean_length,
            spread,
            distinct,
            top,
            pair_share,
            line_share,
            mean(per_word((ends == 6).astype(float)), counts),
            mean(per_word((ends == 7).astype(float)), counts),
            mean(per_word((ends == 8).astype(float)), counts),
            *(mean(classes[:, k], sizes) for k in (1, 2, 3, 4, 5, 6, 7, 8, 9)),
        ]
    )
    out[sizes == 0] = 0.0
    return out


def measure(docs: DataFrame) -> DataFrame:
    """doc_id and its statistics as an array<double>, over whole texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                stats = pa.array(statistics(part["text"]).ravel())
                offsets = pa.array(np.arange(part.num_rows + 1) * N_STATS, pa.int32())
                yield pa.RecordBatch.from_arrays([part["doc_id"], pa.ListArray.from_arrays(offsets, stats)], ["doc_id", "stats"])

    narrow = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id bigint, stats array<double>")


def held_out(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0


@dataclass(frozen=True)
class Model:
    """Scores an array of statistics: standardise, random features, ridge weights, isotonic steps."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    edges: np.ndarray
    levels: np.ndarray

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return fourier(stats, self.mean, self.scale) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        return self.levels[np.searchsorted(self.edges, self.raw(stats), side="right")]


def fourier(stats: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Rounded cosines of fixed random directions, and a constant as the last column."""
    rng = np.random.default_rng(20240301)
    directions = rng.normal(0, 1 / WIDTH, (N_STATS, N_FEATURES))
    phases = rng.uniform(0, 2 * np.pi, N_FEATURES)
    z = np.cos(np.clip((stats - mean) / scale, -8, 8) @ directions + phases)
    return np.column_stack([np.round(z * QUANTUM), np.full(len(z), float(QUANTUM))]) / QUANTUM


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch["stats"].flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, N_STATS)


def _summed(df: DataFrame, partial, shape: tuple[int, int]) -> np.ndarray:
    """The sum over all batches of ``partial(batch)``, an array of ``shape``: one such array per
    partition is shuffled, row by row."""
    rows, cols = shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            total += partial(batch)
        offsets = pa.array(np.arange(rows + 1) * cols, pa.int32())
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(rows), pa.int32()), pa.ListArray.from_arrays(offsets, pa.array(total.ravel()))], ["i", "v"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"i": pdf["i"].iloc[:1], "v": [np.sum(np.stack(pdf["v"].to_list()), axis=0)]})

    got = df.mapInArrow(run, "i int, v array<double>").groupBy("i").applyInPandas(add, "i int, v array<double>").toPandas()
    out = np.zeros(shape)
    for i, v in zip(got["i"], got["v"], strict=True):
        out[i] = v
    return out


def fit(rows: DataFrame) -> Model | None:
    """Fit on rows (stats, y in 0/1). None if there are no rows of both kinds."""

    def moments(batch: pa.RecordBatch) -> np.ndarray:
        x = np.round(_matrix(batch) * _STEP) / _STEP  # exact sums
        y = batch["y"].to_numpy(zero_copy_only=False).astype(float)
        return np.vstack([np.full(N_STATS, float(len(x))), x.sum(0), np.square(np.round(x * 1024) / 1024).sum(0), np.full(N_STATS, y.sum())])

    n, total, squares, positives = _summed(rows, moments, (4, N_STATS))
    if not 0 < positives[0] < n[0]:
        return None
    mean = total / n
    scale = np.sqrt(np.maximum(squares / n - mean**2, 0))
    scale = np.where(scale > 1e-6, scale, 1.0)

    def normal(batch: pa.RecordBatch) -> np.ndarray:
        z = fourier(_matrix(batch), mean, scale) * QUANTUM
        y = batch["y"].to_numpy(zero_copy_only=False).astype(float)
        return np.column_stack([z.T @ z, z.T @ y])

    d = N_FEATURES + 1
    sums = _summed(rows, normal, (d, d + 1))
    gram, right = sums[:, :d] / QUANTUM**2, sums[:, d] / QUANTUM
    weights = np.linalg.solve(gram + RIDGE * n[0] * np.eye(d) / d, right)

    low, high = -0.5, 1.5
    inner = np.linspace(low, high, SCORE_BINS - 1)
    plain = Model(mean, scale, weights, inner, np.arange(SCORE_BINS, dtype=float))

    def histogram(batch: pa.RecordBatch) -> np.ndarray:
        bins = plain.score(_matrix(batch)).astype(int)
        y = batch["y"].to_numpy(zero_copy_only=False).astype(float)
        return np.vstack([np.bincount(bins, minlength=SCORE_BINS), np.bincount(bins, y, minlength=SCORE_BINS)])

    counts, ones = _summed(rows, histogram, (2, SCORE_BINS))
    return Model(mean, scale, weights, inner, isotonic(counts, ones))


def isotonic(counts: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Non-decreasing shares of ones by bin (pool adjacent violators); empty bins are interpolated."""
    full = np.flatnonzero(counts)
    blocks: list[list[float]] = []  # ones, count, full bins
    for o, c in zip(ones[full], counts[full], strict=True):
        blocks.append([o, c, 1])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            o2, c2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0] + o2, blocks[-1][1] + c2, blocks[-1][2] + n2]
    levels = np.concatenate([np.full(n, o / c) for o, c, n in blocks])
    return np.interp(np.arange(len(counts)), full, levels)


@dataclass(frozen=True)
class Constant:
    """The score where nothing can be learned."""

    level: float

    def score(self, stats: np.ndarray) -> np.ndarray:
        return np.full(len(stats), self.level)


def train(stats: DataFrame, labels: DataFrame) -> Model | Constant:
    """Learns from labelled rows that aren't held out; null labels and labels of unknown documents are
    ignored, and of repeated labels of a document the largest counts. With labels of one kind only,
    or none, every score is that kind's share (0.5 without labels).
    """
    y = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max("quality").alias("y"))
    rows = stats.join(y, "doc_id").filter(~held_out(F.col("doc_id"))).select("stats", F.col("y").cast("int").alias("y"))
    rows = materialize(rows, workspace(stats.sparkSession, "train"))
    model = fit(rows)
    if model is not None:
        return model
    share = rows.agg(F.avg("y")).first()[0]
    return Constant(0.5 if share is None else float(share))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document, by its whole text.

    Null and empty texts have zero statistics and are scored like others; repeated rows are scored
    alike; an empty table gives no rows.
    """
    stats = materialize(measure(docs), workspace(docs.sparkSession, "stats"))
    model = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(model.score(_matrix(batch)), pa.float64())], ["doc_id", "score"])

    return stats.mapInArrow(run, "doc_id bigint, score double").select(
        "doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted")
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score at least THRESHOLD; no shuffle of texts.

    Null and empty texts are scored like others, rows without a doc_id too, and repeated rows alike; all columns and no others come
    back, whatever their names, and an empty table stays empty.
    """
    stats = materialize(measure(docs), workspace(docs.sparkSession, "stats"))
    model = train(stats, labels)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                yield part.filter(pa.array(model.score(statistics(part["text"])) >= THRESHOLD))

    return docs.mapInArrow(run, docs.schema)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return classify(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
