"""The filter audit against plain Python over every order."""

import random
import re
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from test_llm_operators import EDGE, corpus

from quillon.llm import audit

LABELS = "doc_id bigint, quality int, toxic int"


def plain_masks(rows):
    first = {}
    for i, t, _ in rows:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, t, lang in rows:
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = "A" * (len(words) < 100) + "B" * (100 * len(set(words)) < 80 * len(words))
        fails += "C" * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + "D" * bool(re.search(r"[#$%&*|]", t))
        yield i, lang or "", fails + "E" * (i is not None and i > first[t])


def plain_audit(rows, good, toxic):
    out, shapley = {}, {}
    masks = list(plain_masks(rows))
    for part in {p for _, p, _ in masks}:
        own = [(i, m) for i, p, m in masks if p == part]
        for order in map("".join, permutations("ABCDE")):
            left = own
            for step, f in enumerate(order, 1):
                gone = [(i, m) for i, m in left if f in m]
                left = [(i, m) for i, m in left if f not in m]
                redundant = sum(f in m for _, m in own) - len(gone)
                out[part, order, step] = [len(left), len(gone), redundant, sum(m == f for _, m in own), sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
                shapley[part, f] = shapley.get((part, f), 0) + len(gone)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_audit_is_the_plain_one(spark):
    rng = random.Random(4)
    texts = [*corpus(40), *EDGE, "Some CAPITALS # here", " ".join(map(str, range(120))), "word " * 150, "x" * 1_000_000]
    texts += [rng.choice(texts) for _ in range(30)]
    rows = [(i, t, rng.choice(["en", "de", None, ""])) for i, t in enumerate(texts)]
    rows += [(None, "a", "en"), (None, None, None), rows[3], rows[3], (5, "another text of 5", "en")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 80, 2)] + [(None, 1, 1), (2, 1, 0), (2, 0, 1)]
    good, toxic = ({r[0] for r in labels if r[k] == 1} - {None} for k in (1, 2))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").withColumn("mask", F.lit("mine")).withColumn("part", F.lit(1))
    found = audit.audit(docs, spark.createDataFrame(labels, LABELS)).collect()
    got = {(r["part"], r["filter_order"], r["step"]): tuple(r)[4:] for r in found}
    assert len(got) == len(found) and got == plain_audit(rows, good, toxic)
    assert {r["filter"] for r in found} == set("ABCDE") and all(r["filter"] == r["filter_order"][r["step"] - 1] for r in found)


def test_own_filters_and_edges(spark):
    docs = spark.createDataFrame([(1, "a", "en", 5), (2, "bb", "en", None), (3, "a", "de", 9)], "doc_id bigint, text string, lang string, size int")
    labels = spark.createDataFrame([], LABELS)
    found = audit.audit(docs, labels, {"big": F.col("size") > 4, "long": F.length("text") > 1}, copies=None).collect()
    assert len(found) == 2 * 2 * 2 and {r["filter_order"] for r in found} == {"biglong", "longbig"}
    assert {(r["part"], r["step"]): r["kept"] for r in found if r["filter_order"] == "biglong"} == {("de", 1): 0, ("de", 2): 0, ("en", 1): 1, ("en", 2): 0}
    assert audit.audit(docs.limit(0), labels).count() == 0
    with pytest.raises(ValueError):
        audit.interactions(audit.cells(audit.failures(docs, labels)), list("ABCDEFG"))
