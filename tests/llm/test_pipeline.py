"""The pipeline against a plain version of every stage on a small fixture."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from test_llm_operators import DOC, brute_components, lower, waterfill

import corpus_pipeline
from quillon.llm import pieces, quality


def plain_quality(rows, labels):
    """Ids that a single-process fit of the same model keeps."""
    stats = quality.statistics(pa.array([r[1] for r in rows], pa.string()))
    use = [i for i, r in enumerate(rows) if r[0] in labels and zlib.crc32(str(r[0]).encode()) % 5]
    x, y = stats[use], np.array([labels[rows[i][0]] for i in use], float)
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-3, scale, 1.0)
    z = quality.fourier(x, mean, scale)
    d = z.shape[1]
    weights = np.linalg.solve(z.T @ z + quality.RIDGE * len(y) * np.eye(d) / d, z.T @ y)
    edges = np.linspace(-0.5, 1.5, quality.SCORE_BINS - 1)
    bins = np.searchsorted(edges, z @ weights, side="right")
    n = quality.SCORE_BINS
    levels = quality.isotonic(np.bincount(bins, minlength=n).astype(float), np.bincount(bins, y, minlength=n))
    scores = levels[np.searchsorted(edges, quality.fourier(stats, mean, scale) @ weights, side="right")]
    return [r for r, s in zip(rows, scores, strict=True) if s >= quality.THRESHOLD]


def plain_mix(rows, mix):
    leaves = defaultdict(list)
    for r in rows:
        leaves["crawl" if r[3] == "src0" else "curated", r[2], r[3]].append((r[0], len((r[1] or "").encode()) // 4 + 1))
    cap = {k: sum(n for _, n in v) for k, v in leaves.items()}
    kept = set()
    top = waterfill(sum(cap.values()) * mix.budget_percent // 100, {d: (sum(c for k, c in cap.items() if k[0] == d), mix.domains[d]) for d in {k[0] for k in cap}})
    for d, budget in top.items():
        mid = waterfill(budget, {x: (sum(c for k, c in cap.items() if k[:2] == (d, x)), mix.languages.get(x, 1)) for x in {k[1] for k in cap if k[0] == d}})
        for x, b in mid.items():
            for src, share in waterfill(b, {k[2]: (c, 1) for k, c in cap.items() if k[:2] == (d, x)}).items():
                whole, rest = divmod(share, cap[d, x, src])
                used = 0
                for i, n in sorted(leaves[d, x, src], key=lambda m: hashlib.md5(f"{mix.seed}-{whole}-{m[0]}".encode()).hexdigest()):
                    used += n
                    if whole or used <= rest:
                        kept.add(i)
    return [r for r in rows if r[0] in kept]


def test_pipeline(spark, tmp_path):
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8)))
    texts, good = [], []
    for i in range(240):
        fine = i % 4 > 0
        words = [word() + ("" if fine else rng.choice(["$$$", "###"])) for _ in range(rng.randint(30, 90))]
        texts.append(" ".join(words))
        good.append(int(fine))
    for i in range(1, 60, 6):
        texts += [texts[i].upper(), texts[i], " ".join([*texts[i].split()[:-1], word()])]
    rows = [(i, t, rng.choice(["en", "de"]), rng.choice(["src0", "src1", "src2"]), len(t)) for i, t in enumerate(texts)]
    labels = {i: g for i, g in enumerate(good) if i % 3}
    spark.createDataFrame(rows, DOC).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, g, 0) for i, g in labels.items()], "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    want = plain_quality(rows, labels)
    assert 0 < len(want) < len(rows)
    last = {lower(r[1]): r[0] for r in sorted(want)}
    want = [r for r in want if last[lower(r[1])] == r[0]]
    found = brute_components([r[1] for r in want])
    first = {}
    for r, (_, c) in zip(want, found, strict=True):
        first[c] = min(r[0], first.get(c, r[0]))
    want = [r for r, (_, c) in zip(want, found, strict=True) if first[c] == r[0]]
    mixed = plain_mix(want, corpus_pipeline.PIPELINE_MIX)
    assert 0 < len(mixed) < len(want)

    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(got) == sorted(r[0] for r in mixed)
    p = pieces.load(pieces.MODEL)
    for i, r in got.items():
        assert r["text"] == texts[i] and p.decode(np.frombuffer(r["token_ids"], "<u2")) == texts[i]


def test_stages_keep_the_columns(spark):
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5
