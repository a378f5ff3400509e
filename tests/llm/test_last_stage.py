"""The pipeline's last stage encodes and decodes."""

import hashlib

from test_llm_operators import DOC

import corpus_pipeline
from quillon.llm import pieces


def test_the_last_stage_reads_its_tokens_back(spark, tmp_path, monkeypatch):
    texts = ["Ein Text  mit Blanks", "", None, "日本 ▁ \x00 x"]
    docs = spark.createDataFrame([(i, t, "de", "s", 1) for i, t in enumerate(texts)], DOC)
    name, stage = corpus_pipeline.STAGES[-1]
    got = {r["doc_id"]: r for r in stage(spark, docs, str(tmp_path)).collect()}
    assert "decoding" in name and all(r["round_trip"] for r in got.values())
    assert [got[i]["decoded_sha256"] for i in range(4)] == [hashlib.sha256((t or "").encode()).hexdigest() for t in texts]
    assert set(docs.columns) < set(got[0].asDict()) and "decoded" not in got[0].asDict()
    assert pieces.load(pieces.MODEL).decode(pieces.load(pieces.MODEL).encode(texts[3])) == texts[3]
