"""Records with further or missing fields keep their turns; what fits no layout is returned."""

from quillon.llm import chat

RECORDS = [
    '{"id":1,"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"b"}]}',
    '{"messages":[{"role":"user","name":"N","content":"a"}]}',
    '{"instruction":"a","output":"b"}',
    '{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":7}]}',
    '{"prompt":"a","response":null,"meta":{"x":[1]}}',
    '{"conversations":[{"from":"human","value":"a"},{"from":"gpt","value":null}]}',
    '{"messages":[{"role":"user"}]}',
    '{"prompt":"a","response":"b","instruction":"c","output":"d"}',
    '{"prompt":{"x":1},"response":"b"}',
    "not JSON",
    None,
]


def test_json_layouts(spark):
    df = spark.createDataFrame(list(enumerate(RECORDS)), "conv_id bigint, record string")
    got = {(r["conv_id"], r["turn"]): (r["role"], r["text"]) for r in chat.canonical_json(df).collect()}
    user, reply = ("user", "a"), lambda x: ("assistant", x)
    assert got == {
        (0, 0): user, (0, 1): reply("b"), (1, 0): user, (2, 0): user, (2, 1): reply("b"), (3, 0): user, (3, 1): reply("7"),
        (4, 0): user, (4, 1): reply(None), (5, 0): user, (5, 1): reply(None),
    }
    assert {r["conv_id"] for r in chat.rejected_json(df).collect()} == {6, 7, 8, 9, 10}


def test_names_of_the_table_do_not_clash(spark):
    names = ("__v", "__found", "__layout", "__r0", "row", "a.b")
    rows = [(i, r, *(f"{n}{i}" for n in names)) for i, r in enumerate(RECORDS)]
    df = spark.createDataFrame(rows, "conv_id bigint, `rec.ord` string, " + ", ".join(f"`{n}` string" for n in names))
    rejected = chat.rejected_json(df, "rec.ord")
    assert rejected.columns == df.columns
    assert {tuple(r) for r in rejected.collect()} == {rows[i] for i in (6, 7, 8, 9, 10)}
    assert chat.canonical_json(df, "rec.ord").count() == 11
    assert chat.canonical_json(df.limit(0), "rec.ord").count() == chat.rejected_json(df.limit(0), "rec.ord").count() == 0
