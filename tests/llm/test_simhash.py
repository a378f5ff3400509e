"""SimHash near-duplicates against all pairs of plain fingerprints."""

import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from test_llm_operators import EDGE, corpus

from quillon.llm import simhash

FP = "doc_id bigint, fp bigint, n bigint"


def plain_fingerprint(text, k=3):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    if not words:
        return 0
    hashes = [xxhash.xxh64(b" ".join(words[i : i + k]), seed=42).intdigest() for i in range(max(1, len(words) - k + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(links, nodes):
    root = {i: i for i in nodes}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in nodes}


def test_whole_operator_is_the_plain_one(spark):
    rng = random.Random(7)
    texts = [*corpus(50), *EDGE, "UPPER lower Ü", "y " * 500_000]
    long = " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(3000)).split()
    for _ in range(25):
        other = list(long)
        for _ in range(rng.randint(0, 12)):
            other[rng.randrange(len(other))] = "edit"
        texts.append(" ".join(other))
    rows = list(enumerate(texts)) + [(None, texts[0]), (None, None), (3, texts[3]), (4, texts[60]), (900, texts[10]), (900, texts[11])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("fp", F.lit("mine")))
    assert got.columns == ["doc_id", "fingerprint", "component_id"]
    fps = [plain_fingerprint(t) for _, t in rows]
    known = [(i, f) for (i, _), f in zip(rows, fps, strict=True) if i is not None]
    links = [(a, b) for x, (a, f) in enumerate(known) for b, g in known[:x] if (f ^ g).bit_count() <= 3]
    root = plain_components(links, {i for i, _ in known})
    want = sorted((i if i is not None else -1, f"{f:016x}", root.get(i, -1)) for (i, _), f in zip(rows, fps, strict=True))
    assert sorted((-1 if r[0] is None else r[0], r[1], -1 if r[2] is None else r[2]) for r in got.collect()) == want
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


@pytest.mark.parametrize(("long", "turned"), [(512, 16), (8, 16), (8, 0)])
def test_no_link_is_lost_in_crowded_lists(spark, monkeypatch, long, turned):
    """Around a few centres, so that lists are long: with and without the second segment, and with turns."""
    monkeypatch.setattr(simhash, "LONG", long)
    monkeypatch.setattr(simhash, "PAIRS_A_POSTING", turned)
    rng = random.Random(3)
    fps = set()
    for _ in range(4):
        centre = rng.getrandbits(64)
        for _ in range(120):
            fps.add(centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))))
    nodes = [(i, f - (1 << 64) if f >> 63 else f, rng.randint(1, 9)) for i, f in enumerate(sorted(fps, key=lambda _: rng.random()))]
    links = [(a, b) for x, (a, f, _) in enumerate(nodes) for b, g, _ in nodes[:x] if ((f ^ g) & (2**64 - 1)).bit_count() <= 3]
    root = plain_components(links, [i for i, _, _ in nodes])
    for near in (simhash.Near(), simhash.Near(segments=8)):
        comps = dict(map(tuple, simhash.components(spark.createDataFrame(nodes, FP), near).collect()))
        assert {i: comps.get(i, i) for i, _, _ in nodes} == root


def test_every_linked_pair_has_a_viable_chain():
    near, rng = simhash.Near(), np.random.default_rng(1)
    x = rng.integers(0, 2**63, 4000, dtype=np.uint64)
    y = x.copy()
    for _ in range(4):
        y ^= np.uint64(1) << rng.integers(0, 64, len(y)).astype(np.uint64)
    apart = np.bitwise_count(x ^ y)
    found = np.zeros(len(x), bool)
    for i in range(near.segments):
        turned = [simhash._turned(v, np.full(len(x), i), near) for v in (x, y)]
        found[simhash.viable(*turned, near)] = True
    assert (found == (apart <= 3)).all() and 0 < found.sum() < len(x)


def test_parameters():
    for wrong in ({"bits": 4}, {"segments": 5}, {"bits": -1}):
        with pytest.raises(ValueError):
            simhash.Near(**wrong)
