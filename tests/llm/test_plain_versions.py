"""Statistics, lexical features and media columns against plain Python."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from test_llm_operators import EDGE, corpus, docs

from quillon.llm import media, quality, substring, urls


def plain_statistics(text):
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 20
    w = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    n, words = len(raw), max(len(w), 1)
    share = lambda chars: sum(raw.count(c) for c in set(chars)) / n
    lengths = [len(x) for x in w]
    mean = sum(lengths) / words
    var = sum(x * x for x in lengths) / words - mean**2
    pairs = list(zip(w, w[1:], strict=False))
    lines = raw.split(b"\n")
    ends = lambda chars: sum(x[-1] in chars for x in w) / words
    stop, comma, other = b".!?", b",;:'\"()-", b"#$%&*+/<=>@[\\]^_`{|}~"
    return [
        math.log1p(n), math.log1p(len(w)), mean, math.sqrt(max(var, 0)), len(set(w)) / words, max(Counter(w).values(), default=0) / words,
        len(set(pairs)) / len(pairs) if pairs else 0.0, len(set(lines)) / len(lines) if w else 0.0, ends(stop), ends(comma), ends(other),
        share(range(97, 123)), share(range(65, 91)), share(range(48, 58)), share(b" \t\x0b\x0c\r"), share(b"\n"), share(stop), share(comma), share(other), share(range(128, 256)),
    ]


def test_statistics_are_the_plain_ones():
    rng = random.Random(3)
    odd = ["".join(rng.choice("aB3 \t\n.,;#é▁\x00~") for _ in range(rng.randint(1, 300))) for _ in range(60)]
    texts = [t for t in corpus(20) + odd + EDGE]
    got = quality.statistics(pa.array(texts, pa.string()))
    for t, row in zip(texts, got, strict=True):
        # in the order of ``statistics``: classes 1 to 9 come last
        assert row.tolist() == pytest.approx(plain_statistics(t), abs=1e-9), repr(t)


def plain_features(url, rows):
    """The features of one url that need no other row."""
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
    query = re.search(r"\?([^#]*)", url)
    counts = Counter(url)
    suffix = host.rsplit(".", 1)[-1]
    return {
        "url_length": len(url), "host_length": len(host), "host_labels": host.count("."), "path_depth": path.count("/"),
        "digit_ratio": len(re.findall("[0-9]", url)) / len(url) if url else 0, "entropy": -sum(c / len(url) * math.log2(c / len(url)) for c in counts.values()),
        "parameters": len([p for p in (query[1] if query else "").split("&") if p]), "hyphens": url.count("-"), "has_fragment": float("#" in url),
        "is_https": float(url.startswith("https:")), "suffix_length": len(suffix),
    }


URLS = [None, "", "no scheme", "http://", "https://Example.com/en/a?x=1&&y=2#f", "ftp://a.b.net/es/", "http://net/fr/x?q#a?b", "https://x.org/a/b/c-1-2", "http://x.org", "https://y.net/fr/é?#"]


def test_lexical_features_are_the_plain_ones(spark):
    rng = random.Random(5)
    made = [f"http{rng.choice(['', 's'])}://{rng.choice(['www.', ''])}h{i}.{rng.choice(['com', 'net', 'org', 'de'])}/{rng.choice(['en', 'es', 'fr', 'x'])}/p{i}-{i}?k={i}" for i in range(60)]
    all_urls = [*URLS, *made, made[0]]
    d = spark.createDataFrame([(None if i == 12 else i, u, "extra") for i, u in enumerate(all_urls)], "page_id bigint, url string, bucket string")
    rows = urls.lexical(d).withColumn("i", F.coalesce("page_id", F.lit(12)))
    got = {r["i"]: r for r in urls.with_suffixes(rows, urls.suffix_statistics(rows)).collect()}
    verdict = {i: r["ruled"]["verdict"] if r["ruled"] else None for i, r in got.items()}
    for i, u in enumerate(all_urls):
        want = plain_features(u, all_urls)
        assert {k: got[i][k] for k in want} == pytest.approx(want), u
        same = [j for j in got if got[j]["bucket"] == got[i]["bucket"]]
        assert got[i]["suffix_log_count"] == pytest.approx(math.log1p(len(same)))
        others = [verdict[j] for j in same if j != i and verdict[j]]
        assert got[i]["suffix_block_rate"] == pytest.approx((others.count("block") + 1) / (len(others) + 2))
    out = urls.judge(d).collect()
    assert len(out) == len(all_urls) and sum(r["page_id"] is None for r in out) == 1
    twice = [(r["verdict"], r["block_score"]) for r in out if r["page_id"] in (len(URLS), len(all_urls) - 1)]
    assert len(set(twice)) == 1


def test_trees_learn_what_rules_say(spark):
    """Held-out accuracy on rule-labelled urls whose verdict the path decides."""
    rng = random.Random(7)
    rows = []
    for i in range(3000):
        bad = rng.random() < 0.5
        host = f"h{rng.randrange(50)}" + ("-x" * rng.randint(2, 5) if bad else "") + ".net"
        rows.append((i, f"http://{host}/{rng.choice(['es', 'fr']) if bad else 'en'}/{'?a=1&b=2' if bad else ''}"))
        if not bad:
            rows[-1] = (i, rows[-1][1].replace(".net", ".com"))
    d = spark.createDataFrame(rows, "page_id bigint, url string")
    lex = urls.lexical(d)
    lex = urls.with_suffixes(lex, urls.suffix_statistics(lex))
    held = F.crc32(F.col("page_id").cast("string").cast("binary")) % 5 == 0
    model = urls.fit(lex.filter(~held))
    from pyspark.ml.feature import VectorAssembler

    test = VectorAssembler(inputCols=list(urls.FEATURES), outputCol="features").transform(lex.filter(held))
    right = model.transform(test).select(F.avg(((F.col("prediction") == 1) == (F.col("ruled.verdict") == "block")).cast("int"))).first()[0]
    assert right > 0.97


def plain_png_samples(image):
    """The samples of an 8-bit grey image with filter type 0 in every line."""
    assert image[:8] == bytes([137, 80, 78, 71, 13, 10, 26, 10])
    at, parts = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        kind, body = image[at + 4 : at + 8], image[at + 8 : at + 8 + n]
        parts.append((kind, body))
        assert struct.unpack(">I", image[at + 8 + n : at + 12 + n])[0] == zlib.crc32(kind + body)
        at += 12 + n
    width, height = struct.unpack(">II", parts[0][1][:8])
    lines = zlib.decompress(b"".join(b for k, b in parts if k == b"IDAT"))
    return b"".join(lines[y * (width + 1) + 1 : (y + 1) * (width + 1)] for y in range(height))


def plain_feature(samples):
    n = len(samples)
    mean = sum(samples) / n
    std = math.sqrt(sum((x - mean) ** 2 for x in samples) / n)
    entropy = -sum(c / n * math.log2(c / n) for c in Counter(samples).values())
    step = sum(abs(a - b) for a, b in zip(samples, samples[1:], strict=False)) / (n - 1)
    return [mean, std, entropy, step]


def test_media_columns_are_the_plain_ones(spark, tmp_path, monkeypatch):
    texts = [*corpus(10), "z" * 300_000, "z" * 300_000]
    refs = media.store(docs(spark, texts), f"file://{tmp_path}", shard_bytes=4000)
    monkeypatch.setattr(media, "PIECE_BYTES", 500)
    placed = media.by_place(refs)
    assert placed.rdd.getNumPartitions() > 4
    got = {r["doc_id"]: r for r in media.read_back(media.metadata(placed)).collect()}
    where = {r["doc_id"]: r for r in refs.collect()}
    assert sorted(got) == sorted(where) == list(range(len(texts)))
    for i, r in got.items():
        with open(where[i]["shard"].removeprefix("file://"), "rb") as f:
            f.seek(where[i]["offset"])
            image = f.read(where[i]["length"])
        assert (r["media_bytes"], r["media_sha256"]) == (len(image), hashlib.sha256(image).hexdigest())
        samples = plain_png_samples(image)
        raw = (texts[i] or "").encode()
        assert samples[: len(raw)] == raw and set(samples[len(raw) :]) <= {255}
        shown = [float(x) for x in re.findall(r"=([\d.]+)", r["feature"])]
        assert shown == pytest.approx(plain_feature(samples), abs=2e-6)
    none = media.store(docs(spark, []), f"file://{tmp_path}/none")
    assert media.read_back(media.metadata(media.by_place(none))).count() == 0


def test_a_large_reference_goes_in_groups(spark, monkeypatch):
    monkeypatch.setattr(substring, "REFERENCE_WORDS", 30)
    monkeypatch.setattr(substring, "SHARD_WORDS", 20)
    rng = random.Random(1)
    ref = [" ".join(f"r{i}x{j}" for j in range(rng.randint(3, 12))) for i in range(20)] + ["long " * 50, "long " * 50, None]
    texts = [" ".join([f"a{i}", *ref[i].split()[:6], "b", *ref[i + 1].split()[2:9]]) for i in range(19)] + ["long " * 5, None, ""]
    grams = {tuple(t.split()[i : i + 4]) for t in ref if t for i in range(len(t.split()) - 3)}
    got = substring.remove_reference(docs(spark, texts), docs(spark, ref), 4).orderBy("doc_id").collect()
    for t, r in zip(texts, got, strict=True):
        w = (t or "").split()
        gone = {j for i in range(len(w) - 3) if tuple(w[i : i + 4]) in grams for j in range(i, i + 4)}
        assert (r["n_words"], r["n_removed"], r["kept_text"]) == (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    assert substring.remove_reference(docs(spark, texts), docs(spark, []), 4).agg(F.sum("n_removed")).first()[0] == 0
