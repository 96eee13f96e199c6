"""Conversations beyond the limits of the variant reader."""

import pytest
from pyspark.sql import functions as F

from arrearview.llm import chat_format


def test_long_turns_are_kept(spark):
    n = 20_000_001
    made = lambda i, roles: [(i, t, role, n if t == 1 else 3) for t, role in enumerate(roles)]
    rows = made(1, ["user", "assistant"]) + made(2, ["system", "user", "assistant"]) + made(3, ["user", "assistant"] * 2)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, n int")
    df = df.select("conv_id", "turn", "role", F.repeat(F.lit('"'), F.col("n")).alias("text"))
    out = chat_format.formatted(chat_format.conversation_records(df))
    plain = chat_format.formatted(chat_format.conversation_records(df.withColumn("text", F.lit("x"))))
    layouts = {r["conv_id"]: r["layout"] for r in plain.select("conv_id", "layout").collect()}
    got = out.select("conv_id", "layout", F.transform("turns", lambda t: F.struct(
        t["role"].alias("role"), F.char_length(t["text"]).alias("n"))).alias("turns"),
        F.char_length("formatted").alias("size")).collect()
    assert {r["conv_id"]: r["layout"] for r in got} == layouts
    for r in got:
        want = [(role, k) for i, _, role, k in rows if i == r["conv_id"]]
        assert [(t["role"], t["n"]) for t in r["turns"]] == want
        assert r["size"] == sum(k + len(role) + 20 for role, k in want)


def test_long_record_without_a_mapping_is_an_error(spark):
    df = spark.range(1).select(F.concat(F.lit('{"other":"'), F.expr("repeat('x', 20000001)"), F.lit('"}')).alias("record"))
    with pytest.raises(Exception, match="no mapping reads"):
        chat_format.formatted(df).select(F.size("turns")).collect()
