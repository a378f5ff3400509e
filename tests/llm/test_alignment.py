"""Token alignment against plain overlaps of byte ranges."""

import hashlib
import os
from bisect import bisect_left
from collections import Counter, defaultdict

import pytest
import sentencepiece
from pyspark.sql import functions as F
from test_llm_operators import EDGE, corpus
from tokenizers import Tokenizer

from quillon.llm import alignment

pytestmark = pytest.mark.skipif(not os.path.exists(alignment.A.file), reason="needs the tokenizer files")
ODD = [
    " ", "  two  blanks", "a▁b", "<s> </s> <unk> <|endoftext|> <0x41> x", "日本語のテキスト 漢字 👩‍👩‍👧", "\x00\x01 é è\x1c b", "tab\tnew\nline\r\n\n  end  ", "x" * 3000,
    "it's 'll  don't\n\n  ok ", "ＡＢＣ ﬁ", "é combining", "no break   em 　 wide", " lead", "a  b", "it 's 've", "1 234 5678 ,. !?",
]


class Plain:
    def __init__(self):
        self.a = Tokenizer.from_file(alignment.A.file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=alignment.B.file)
        self.entry = {i: e for e, i in self.a.get_vocab().items()}
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}

    def pieces(self, text):
        a = [(i, bytes(self.byte[c] for c in self.entry[i])) for i in self.a.encode(" " + text, add_special_tokens=False).ids]
        name = self.b.id_to_piece
        b = [(i, bytes([int(name(i)[3:5], 16)]) if self.b.is_byte(i) else name(i).replace("▁", " ").encode()) for i in self.b.encode(text)]
        return a, b

    def align(self, text):
        if not text:
            return None
        raw, sides = b" " + text.encode(), self.pieces(text)
        if any(b"".join(t for _, t in side) != raw for side in sides):
            return None
        spans = []
        for side in sides:
            at, own = 0, []
            for i, t in side:
                own.append((at, at + len(t), i))
                at += len(t)
            spans.append(own)
        links, j = [], 0
        for s, e, i in spans[0]:
            while spans[1][j][1] <= s:
                j += 1
            k = j
            while k < len(spans[1]) and spans[1][k][0] < e:
                links.append((i, spans[1][k][2]))
                k += 1
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = [([], []) for _ in cuts]
        for side in (0, 1):
            for _, e, i in spans[side]:
                groups[bisect_left(cuts, e)][side].append(i)
        return [len(s) for s in spans], cuts, groups, links


def test_align_is_the_plain_one(spark, monkeypatch):
    monkeypatch.setattr(alignment, "RUN", 500)  # texts of several runs
    texts = [*corpus(30), *EDGE, *ODD, "long words " * 90_000]
    rows = list(enumerate(texts)) + [(5000, "the same row")] * 3 + [(None, "no id")] * 2 + [(7, "another text of 7"), (None, None)]
    plain, seen = Plain(), {}
    for _, t in rows:
        if t not in seen:
            seen[t] = plain.align(t)
    counts, most = Counter(), defaultdict(int)
    for _, t in rows:
        counts.update(set(seen[t][3]) if seen[t] else ())
    for (a, _), n in counts.items():
        most[a] = max(most[a], n)
    want = Counter()
    for i, t in rows:
        if seen[t] is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        (n_a, n_b), cuts, groups, links = seen[t]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in groups)
        best = sum(counts[x] == most[x[0]] for x in links)
        want[i, n_a, n_b, len(cuts), len(links), best, sum(counts[x] for x in links), hashlib.sha256(text.encode()).hexdigest()] += 1
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("batch", F.lit("mine")).repartition(3)
    monkeypatch.setattr(alignment, "BATCH_LINKS", 3000)
    found = alignment.align(docs)
    assert found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, found.collect())) == want
    assert alignment.align(docs.limit(0)).count() == 0


def test_batches_follow_from_the_links_not_from_the_tasks(spark, monkeypatch):
    rows = [(i, f"{i % 7} the same words and {t or ''}") for i, t in enumerate([*corpus(60), *ODD])]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    asked, own = [], alignment.pair_counts
    monkeypatch.setattr(alignment, "pair_counts", lambda swept: asked.append((swept.count(), swept.agg(F.sum(F.size("keys"))).first()[0])) or own(swept))
    few = Counter(map(tuple, alignment.align(docs).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    try:
        many = Counter(map(tuple, alignment.align(docs).collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert many == few and sum(few.values()) == len(rows)
    assert asked[0] == asked[1] and asked[0][0] == 1


def test_groups_are_the_plain_ones(spark):
    texts = ["Some words, aligned", None, "日本語 x", "  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    plain, got = Plain(), defaultdict(list)
    for r in alignment.groups(docs).orderBy("doc_id", "first").collect():
        got[r["doc_id"]].append((r["last"], (r["a_ids"], r["b_ids"])))
        assert {(r["a_ids"][x["a"]], r["b_ids"][x["b"]]) for x in r["links"]} <= set(plain.align(texts[r["doc_id"]])[3])
    want = {i: list(zip(x[1], x[2], strict=True)) for i, t in enumerate(texts) if (x := plain.align(t))}
    assert got == want


def test_merges_by_ids_are_those_of_the_file():
    """On odd texts and around every 29th character there is; unpaired surrogates aren't text."""
    made, own = alignment.load(alignment.A, alignment.A.file), Plain().a
    assert made.lossless and made.encode(["x"]) == [own.encode(" x").ids]
    texts = [t for t in (*ODD, *corpus(20)) if t]
    texts += [f"a{chr(c)}b {chr(c)} 1{chr(c)}{chr(c)}'s" for c in range(0, 0x110000, 29) if not 0xD800 <= c < 0xE000]
    assert made.encode(texts) == [e.ids for e in own.encode_batch([" " + t for t in texts], add_special_tokens=False)]


def test_other_vocabularies_are_encoded_by_their_own_rules(tmp_path):
    tokenizer = Plain().a
    import json

    rules = json.loads(tokenizer.to_str())
    rules["model"]["merges"] = rules["model"]["merges"][:-1]  # the last entry can't be made any more
    (tmp_path / "other.json").write_text(json.dumps(rules))
    made = alignment.byte_merges(str(tmp_path / "other.json"))
    other = Tokenizer.from_file(str(tmp_path / "other.json"))
    assert not made.lossless and made.encode(["some words"]) == [other.encode(" some words").ids]
