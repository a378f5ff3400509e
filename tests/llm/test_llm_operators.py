"""Training-data operators against brute force, round trips and edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillon.llm import chat, components, exact_dedup, exchange, media, mixing, ngram_join, pieces, quality, sharding, substring, urls, wordhash

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"
EDGE = [None, "", " \t\n", "a", "a", "A", "ünï ▁ \x00 \\ ### end", "x " * 4000, "word"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(first + i, t, "en", "src0", len(t or "")) for i, t in enumerate(texts)], DOC)


def corpus(n=60, seed=1):
    """Random texts, copies, near copies and shared passages."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["an", "to", "re", "ing", "ly"]) for _ in range(rng.randint(1, 4)))
    texts = [" ".join(word() for _ in range(rng.choice([3, 40, 90, 160]))) for _ in range(n)]
    passage = " ".join(word() for _ in range(60))
    for i in range(0, n, 6):
        texts.append(texts[i])
        some = texts[i].split()
        if len(some) > 30:
            for cut in (1, 2, 3):
                near = list(some)
                for _ in range(cut):
                    near[rng.randrange(len(near))] = word()
                texts.append(" ".join(near))
        texts.append(texts[i] + "\n" + passage + " tail" + str(i))
    return texts + EDGE


# --- 1 -------------------------------------------------------------------------------------------


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def test_exact_dedup(spark):
    texts = corpus()
    d = docs(spark, texts)
    got = {r["doc_id"]: r for r in exact_dedup.decide(*exact_dedup.deduplicate(d, exact_dedup.DigestIndex.temporary(spark, 4))).collect()}
    groups = defaultdict(list)
    for i, t in enumerate(texts):
        groups[lower(t)].append(i)
    for t, ids in groups.items():
        for i in ids:
            r = got[i]
            assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(ids), len(ids), i == max(ids), hashlib.sha256(t.encode()).hexdigest())
    kept = exact_dedup.keep_unique(d)
    assert kept.columns == d.columns and sorted(r[0] for r in kept.collect()) == sorted(max(v) for v in groups.values())


def test_digest_index_is_bucketed_and_persists(spark):
    index = exact_dedup.DigestIndex.temporary(spark, 4)
    exact_dedup.deduplicate(docs(spark, ["a", "b"]), index)
    rows, groups = exact_dedup.deduplicate(docs(spark, ["B", "c", "c"], 10), index)
    got = {(r["doc_id"], r["keep_id"], r["kept"]) for r in exact_dedup.decide(rows, groups).collect()}
    assert got == {(10, 1, False), (11, 12, False), (12, 12, True)}
    assert index.read().count() == 3
    plan = groups.hint("merge").join(index.read().select("digest"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    assert exact_dedup.decide(*exact_dedup.deduplicate(docs(spark, []), index)).count() == 0


# --- 2 -------------------------------------------------------------------------------------------


def test_media_round_trip(spark, tmp_path):
    texts = corpus(12)
    refs = media.store(docs(spark, texts), f"file://{tmp_path}", shard_bytes=3000)
    got = {r["doc_id"]: r for r in media.read_back(media.metadata(refs)).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        raw = (t or "").encode()
        padded = raw + b"\xff" * ((-len(raw)) % 576 if raw else 576)
        r = got[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(raw), len(padded)) and len(padded) % 576 == 0
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        assert (r["width"], r["height"], r["bit_depth"]) == (576, len(padded) // 576, 8)
    import tarfile

    shards = {r["shard"].removeprefix("file://") for r in refs.collect()}
    assert len(shards) > 1
    for s in shards:
        with tarfile.open(s) as tar:
            for m in tar:
                assert hashlib.sha256(tar.extractfile(m).read()).hexdigest() + ".png" == m.name


def test_media_notices_damage():
    image = bytearray(media.encode_png(media.pad(b"hello")))
    assert media.decode_png(bytes(image)) == media.pad(b"hello")
    image[45] ^= 1
    with pytest.raises((ValueError, zlib.error)):
        media.decode_png(bytes(image))


# --- 3 -------------------------------------------------------------------------------------------


def plain_packing(items, n_bins):
    """Bin by bin and item by item; ``items``: (bytes, tokens, rows) in the order to be packed."""
    total = [max(1, sum(v[k] for v in items)) for k in range(3)]
    rest = [[1 / n_bins] * 3 for _ in range(n_bins)]
    out = {}
    for i in sorted(range(len(items)), key=lambda i: (-max(items[i][k] / total[k] for k in range(3)), i)):
        want = [w * items[i][k] / total[k] for k, w in enumerate(sharding.WEIGHTS)]
        out[i] = max(range(n_bins), key=lambda b: (sum(r * w for r, w in zip(rest[b], want, strict=True)), -b))
        rest[out[i]] = [r - items[i][k] / total[k] for k, r in enumerate(rest[out[i]])]
    return out


@pytest.mark.parametrize("blocks", [20_000, 256, 256 + 64])
def test_sharding(spark, monkeypatch, blocks):
    monkeypatch.setattr(sharding, "BLOCK_ITEMS", blocks)
    texts = corpus(150) + ["hot text"] * 100 + [f"t{i % 90} " * 20 for i in range(180)]
    got = sharding.assign(docs(spark, texts), 4).collect()
    assert sorted(r["doc_id"] for r in got) == list(range(len(texts)))
    sizes, slots, where = Counter(), defaultdict(list), defaultdict(set)
    for r in got:
        raw = (texts[r["doc_id"]] or "").encode()
        assert r["size"] == len(raw) + 1 and r["text_crc32"] == zlib.crc32(raw)
        sizes[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        where[texts[r["doc_id"]] or ""].add(r["shard"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert max(sizes.values()) - min(sizes.values()) < 8100  # the largest text
    assert all(len(v) == 1 for v in where.values())
    assert sharding.assign(docs(spark, []), 4).count() == 0
    if blocks == 20_000:
        groups = defaultdict(list)
        for i, t in enumerate(texts):
            groups[t or ""].append(i)
        weigh = lambda t: (len(groups[t]) * (len(t.encode()) + 1), len(groups[t]) * (t.count(" ") + 1), len(groups[t]))
        order = sorted(groups, key=lambda t: (-weigh(t)[0], hashlib.md5(t.encode()).digest()))
        want = plain_packing([weigh(t) for t in order], 4)
        shard = {r["doc_id"]: r["shard"] for r in got}
        assert sum(shard[groups[t][0]] != want[i] for i, t in enumerate(order)) == 0


def test_sharding_splits_only_what_exceeds_a_share(spark):
    texts = ["nine char"] * 1100 + [f"text {i} " * 10 for i in range(3000)]
    got = sharding.assign(docs(spark, texts), 8).collect()
    assert len({r["shard"] for r in got if r["doc_id"] < 1100}) == 1
    texts = ["nine char"] * 1100 + [f"text {i}" for i in range(300)]
    got = sharding.assign(docs(spark, texts), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len({r["shard"] for r in got if r["doc_id"] < 1100}) == 8
    assert max(sizes.values()) < 1.1 * min(sizes.values())


def test_pack_balances_every_dimension():
    v = np.random.default_rng(1).lognormal(0, 1, (3000, 3))
    loads = np.array([v[sharding.pack(v, 8) == b].sum(0) for b in range(8)])
    assert (loads.max(0) / loads.min(0) < 1.02).all()


# --- 4 -------------------------------------------------------------------------------------------


def waterfill(budget, nodes):
    """Shares by repeated passes: full nodes leave, the rest shares again."""
    share, live = {}, {k: v for k, v in nodes.items() if v[1] > 0}
    left = budget
    while live:
        weight = sum(w for _, w in live.values())
        full = {k: c for k, (c, w) in live.items() if c * weight <= left * w}
        if not full:
            return share | {k: left * w // weight for k, (_, w) in live.items()} | {k: 0 for k in nodes if k not in share and k not in live}
        k = min(full, key=lambda k: (live[k][0] / live[k][1], k))
        share[k] = full[k]
        left -= full[k]
        del live[k]
    return share | {k: 0 for k in nodes if k not in share}


def test_mixing_matches_brute_force(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.randint(0, 60), rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src2"]), 0) for i in range(300)] + [(300, None, "en", "src1", 0)]
    mix = mixing.Mix(budget_percent=90, max_epochs=2, languages={"en": 2, "de": 1})
    got = Counter((r["doc_id"], r["epoch"]) for r in mixing.select(spark.createDataFrame(rows, DOC), mix).collect())
    leaves = defaultdict(list)
    for i, t, lang, src, _ in rows:
        leaves["crawl" if src == "src0" else "curated", lang or "", src].append((i, len(t or "") // 4 + 1))
    total = sum(n for v in leaves.values() for _, n in v)
    cap = {k: 2 * sum(n for _, n in v) for k, v in leaves.items()}
    top = waterfill(total * 90 // 100, {d: (sum(c for k, c in cap.items() if k[0] == d), w) for d, w in (("crawl", 3), ("curated", 7))})
    want = Counter()
    for d, budget in top.items():
        langs = {k[1] for k in cap if k[0] == d}
        mid = waterfill(budget, {x: (sum(c for k, c in cap.items() if k[:2] == (d, x)), {"en": 2, "de": 1}.get(x, 1)) for x in langs})
        for x, b in mid.items():
            low = waterfill(b, {k[2]: (c, 1) for k, c in cap.items() if k[:2] == (d, x)})
            for src, share in low.items():
                members = leaves[d, x, src]
                whole, rest = divmod(share, sum(n for _, n in members))
                used = 0
                for i, n in sorted(members, key=lambda m: hashlib.md5(f"mix-1-{whole}-{m[0]}".encode()).hexdigest()):
                    used += n
                    for e in range(whole + (used <= rest)):
                        want[i, e] += 1
    assert got == want
    assert mixing.select(docs(spark, []), mix).count() == 0


# --- 5 -------------------------------------------------------------------------------------------


def test_quality_learns_and_holds_out(spark):
    rng = random.Random(5)
    texts, y = [], []
    for i in range(400):
        good = i % 3 > 0
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) + ("" if good else rng.choice(["$$$", "###"])) for _ in range(rng.randint(20, 80))]
        texts.append(" ".join(words))
        y.append(int(good))
    d = docs(spark, texts + EDGE)
    labels = spark.createDataFrame([(i, q, 0) for i, q in enumerate(y)] + [(10**6, 1, 0), (3, None, 0)], "doc_id bigint, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.classify(d, labels).collect()}
    assert len(got) == len(texts) + len(EDGE) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got.values())
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    held = [i for i in range(400) if got[i]["held_out"]]
    assert sum(got[i]["predicted"] == y[i] for i in held) >= 0.97 * len(held)
    # labels of held-out documents don't matter
    turned = labels.withColumn("quality", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert {r["doc_id"]: r["score"] for r in quality.classify(d, turned).collect()} == {i: r["score"] for i, r in got.items()}
    kept = quality.keep_good(d, labels)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} == {i for i, r in got.items() if r["predicted"]}
    none = quality.classify(d, labels.limit(0)).select("score").distinct().collect()
    assert [r[0] for r in none] == [0.5] and quality.classify(docs(spark, []), labels).count() == 0


def test_isotonic_is_monotone():
    rng = np.random.default_rng(1)
    counts = rng.integers(0, 5, 200)
    ones = rng.binomial(counts, np.linspace(0, 1, 200))
    got = quality.isotonic(counts.astype(float), ones.astype(float))
    assert (np.diff(got) >= -1e-12).all() and got[counts > 0] @ counts[counts > 0] == pytest.approx(ones.sum())


# --- 6 -------------------------------------------------------------------------------------------


def split(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    return lower(host), re.match(r"[^?#]*", rest[len(host) :])[0]


def test_url_rules(spark):
    urls_ = [None, "", "no scheme", "http://A.COM", "http://a.com/", "https://www.example.com/en/1", "https://Example.com/en/2?x=/y", "http://xexample.com/en/", "http://a.net/es/#q", "http://a.net/esx/", "http://net/fr/z", "http://a.net:80/fr/z", "ftp://u?x://b.com/en/", "http://a.com/://b.net/es/", "http://é.com/ü"]
    urls_ += [f"http://h{i}.net/{'fr' if i % 2 else 'en'}/{i}" for i in range(60)] + [f"http://h{i}.com/{i}" for i in range(60)]
    d = spark.createDataFrame(list(enumerate(urls_)), "page_id bigint, url string")
    got = {r["page_id"]: r for r in urls.judge(d).collect()}
    assert len(got) == len(urls_)
    for i, u in enumerate(urls_):
        host, path = split(u)
        fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: len(r.name), default=None)
        assert (got[i]["host"], got[i]["path"], got[i]["rule"]) == (host, path, best.name if best else None), u
        assert got[i]["verdict"] == (best.verdict if best else got[i]["verdict"]) and got[i]["verdict"] in ("allow", "block")
    assert all(r["verdict"] == "allow" and r["block_score"] is None for r in urls.judge(d.filter("page_id < 3")).collect())
    assert urls.judge(d.limit(0)).count() == 0


# --- 7 -------------------------------------------------------------------------------------------


def brute_removed(texts, size):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + size]) for w in words for i in range(len(w) - size + 1))
    out = []
    for w in words:
        gone = {j for i in range(len(w) - size + 1) if seen[tuple(w[i : i + size])] > 1 for j in range(i, i + size)}
        out.append((len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone)))
    return out


@pytest.mark.parametrize(("size", "hot", "batch"), [(35, 16384, 512 << 10), (12, 2, 3000)])
def test_substring_dedup(spark, monkeypatch, size, hot, batch):
    monkeypatch.setattr(exchange, "BATCH_BYTES", batch)
    texts = corpus(50)
    got = {r["doc_id"]: r for r in substring.remove_repeated(docs(spark, texts), size, hot=hot).collect()}
    for i, want in enumerate(brute_removed(texts, size)):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_text"]) == want
    digest = {r["doc_id"]: r["kept_sha256"] for r in substring.remove_repeated(docs(spark, texts), size, digest=True).collect()}
    assert all(digest[i] == hashlib.sha256(r["kept_text"].encode()).hexdigest() for i, r in got.items())
    assert substring.remove_repeated(docs(spark, [])).count() == 0


def test_suffix_automaton():
    rng = random.Random(2)
    for _ in range(30):
        texts = [[rng.randrange(3) for _ in range(rng.randrange(12))] for _ in range(4)]
        s = substring.SuffixAutomaton()
        for t in texts:
            s.add(t)
        s.finish(2)
        counts = Counter(tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, len(t) + 1))
        query = [rng.randrange(3) for _ in range(15)]
        want = [max([n for n in range(i + 2) if n and counts[tuple(query[i + 1 - n : i + 1])] >= 2], default=0) for i in range(15)]
        assert s.statistics(query) == want


def test_remove_reference(spark):
    ref = docs(spark, ["one two three four five six seven", None])
    got = substring.remove_reference(docs(spark, ["x two three four five y", "two three x", None]), ref, 4).orderBy("doc_id").collect()
    assert [(r["n_words"], r["n_removed"], r["kept_text"]) for r in got] == [(6, 4, "x y"), (3, 0, "two three x"), (0, 0, "")]


# --- 8 -------------------------------------------------------------------------------------------


def best_score(p, text):
    best = [0.0] + [-1e18] * len(text)
    known = {v: p.score_of[k] for k, v in p.text_of.items()}
    for end in range(1, len(text) + 1):
        best[end] = best[end - 1] + p._byte_cost(text[end - 1])
        for size in range(1, min(end, 64) + 1):
            if (s := known.get(text[end - size : end])) is not None:
                best[end] = max(best[end], best[end - size] + s)
    return best[-1]


def test_pieces_are_the_best_segmentation():
    p = pieces.load(pieces.MODEL)
    for text in [*corpus(4)[:8], "  two  blanks ", "naïve ▁ 漢字 \x00 \U0001f600", "a\nb\tc", "<s> </s> <unk> <0x41>"]:
        ids = p.encode(text)
        assert p.decode(ids) == text
        if "\0" not in text:
            score = sum(p.score_of[i] if i in p.score_of else p.byte_score for i in ids.tolist())
            assert score == pytest.approx(best_score(p, pieces.BLANK + pieces._escape(text)))
    assert p.by_word and len(p.encode("")) == 0


def test_encode_table(spark):
    texts = corpus(10)
    d = docs(spark, texts).withColumn("n_tokens", F.lit("clash"))
    got = pieces.encode(d, decode=True).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == {i: t or "" for i, t in enumerate(texts)}
    assert all(len(r["token_ids"]) == 2 * r["n_tokens"] for r in got)


# --- 9 -------------------------------------------------------------------------------------------


def test_chat_escapes_are_reversible(spark):
    rng = random.Random(1)
    bits = ["\\", "#", "##", "###", "</turn>", "\n", ":", "h", "e", "c", "\\h", "### a:\n", "é", "</", ""]
    rows = [(i // 3, i % 3, rng.choice(["user", "assistant", "a:b\n", "", None]), "".join(rng.choice(bits) for _ in range(rng.randrange(9)))) for i in range(300)]
    rows += [(1000, 0, "assistant", None), (1000, 0, "assistant", None), (None, 1, "user", "x")]
    d = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    shown = chat.render(chat.canonical_turns(d))
    got = {r["conv_id"]: r for r in shown.select("conv_id", chat.parse(F.col("formatted")).alias("t"), chat.masked_text(F.col("formatted"), F.col("loss")).alias("m")).collect()}
    want = defaultdict(list)
    for c, t, role, text in rows:
        want[c].append((t, role or "", text or ""))
    for c, turns in want.items():
        turns.sort()
        assert [(x["role"], x["text"]) for x in got[c]["t"]] == [t[1:] for t in turns]
        assert got[c]["m"] == "".join(t[2] for t in turns if t[1] == "assistant")
    assert chat.render(chat.canonical_turns(d.limit(0))).count() == 0


def test_layouts_of_tables_and_records(spark):
    table = spark.sql("SELECT 1L AS conv_id, 'i' AS instruction, '' AS input, 'o' AS output, 5 AS extra")
    assert [tuple(r) for r in chat.canonical_turns(table).orderBy("turn").collect()] == [(1, 0, "user", "i"), (1, 1, "assistant", "o")]
    records = [
        (1, '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}'),
        (2, '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":"b"}]}'),
        (3, '{"prompt":"a","response":"b"}'),
        (4, '{"instruction":"a","input":"c","output":"b"}'),
        (5, "not json"),
        (6, '{"other":1}'),
    ]
    got = defaultdict(list)
    for r in chat.canonical_json(spark.createDataFrame(records, "conv_id bigint, record string")).orderBy("conv_id", "turn").collect():
        got[r["conv_id"]].append((r["role"], r["text"]))
    assert got == {1: [("user", "a"), ("assistant", "b")], 2: [("user", "a"), ("assistant", "b")], 3: [("user", "a"), ("assistant", "b")], 4: [("user", "a\n\nc"), ("assistant", "b")]}
    with pytest.raises(ValueError, match="no mapping"):
        chat.mapping_of(spark.range(1).schema)


# --- 10 ------------------------------------------------------------------------------------------


def shingles(t, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", lower(t))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} - {()}


def brute_components(texts):
    sets = [shingles(t) for t in texts]
    label = list(range(len(texts)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                x, y = sorted((find(i), find(j)))
                label[y] = x
    return [(len(s), find(i)) for i, s in enumerate(sets)]


@pytest.mark.parametrize(("batch", "block", "turns"), [(512 << 10, 512, 2), (3000, 2, 0), (3000, 3, 1)])
def test_ngram_join(spark, monkeypatch, batch, block, turns):
    monkeypatch.setattr(exchange, "BATCH_BYTES", batch)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    monkeypatch.setattr(ngram_join, "HEAD_TURNS", turns)
    rng = random.Random(9)
    texts = corpus(40)
    base = [f"w{rng.randrange(500)}" for _ in range(80)]
    for _ in range(40):  # a group whose members are linked to some of each other only
        near = list(base)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(80)] = f"z{rng.randrange(10**6)}"
        texts.append(" ".join(near))
    d = docs(spark, texts)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()}
    want = brute_components(texts)
    assert [got[i] for i in range(len(texts))] == want
    kept = ngram_join.keep_one(d)
    assert kept.columns == d.columns and {r[0] for r in kept.collect()} == {c for _, c in want}


def test_ngram_join_of_odd_tables(spark):
    assert ngram_join.near_duplicates(docs(spark, [])).count() == 0
    d = docs(spark, ["a b c d e f", "A B C D E F", None]).withColumn("doc_id", F.when(F.col("doc_id") != 1, F.col("doc_id")))
    got = sorted(((r["doc_id"], r["component_id"]) for r in ngram_join.near_duplicates(d).collect()), key=str)
    assert got == [(0, 0), (2, 2), (None, None)]


def test_adaptive_prefix_guarantee():
    """Any two linked sets share at least min(m) shingles of their prefixes, whatever m each chose."""
    rng = np.random.default_rng(4)
    join = ngram_join.Join()
    for _ in range(200):
        base = rng.integers(0, 2**63, rng.integers(5, 120), dtype=np.uint64)
        a, b = (np.unique(np.where(rng.random(len(base)) < 0.06, rng.integers(0, 2**63, len(base), dtype=np.uint64), base)) for _ in range(2))
        both = len(np.intersect1d(a, b))
        counts = lambda s: (s % np.uint64(50)).astype(np.int64) + 1
        (ma, pa_), (mb, pb) = (ngram_join.adaptive_prefix(s, counts(s), join) for s in (a, b))
        if 100 * both >= 80 * (len(a) + len(b) - both):
            assert len(np.intersect1d(a[pa_], b[pb])) >= min(ma, mb)
            sk = [np.frombuffer(ngram_join.sketch(s).tobytes(), np.uint64).reshape(1, -1) for s in (a, b)]
            assert ngram_join.fits(np.array([len(a)]), np.array([len(b)]), *sk, 80)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 7), (200, 201), (201, 200), (5, 5)]
    got = {r["node"]: r["label"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in [*range(41), 100]} | {200: 200, 201: 200}


# --- words ---------------------------------------------------------------------------------------


def test_words_match_the_pattern():
    texts = corpus(5) + ["\u00a0nbsp\u2003em", "\x1cfs\x1d", "tail "]
    w = wordhash.words(pa.array(texts, pa.string()), lower=True)
    raw, seen = w.data.tobytes(), {}
    for i, t in enumerate(texts):
        want = re.findall(rb"[^\x20\x09-\x0D]+", lower(t).encode())
        a, b = w.bounds[i], w.bounds[i + 1]
        assert [raw[s:e] for s, e in zip(w.starts[a:b], w.ends[a:b], strict=True)] == want
        for word, h in zip(want, w.hashes[a:b], strict=True):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)
