"""Token counts on partitions without words, and the bound of the frequent table."""

import public_tokenizers
import pytest
from fixtures import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arrearview.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string"


@pytest.mark.parametrize("texts, parts", [
    (["a word"], 2), (["", "", ""], 2), ([None, None], 3), ([None, "", "x y", " ", "\n", None, "z", ""], 8),
    ([prose(i, 30) if i % 4 == 0 else None for i in range(9)], 5)])
def test_partitions_without_words(spark, texts, parts):
    df = spark.createDataFrame(list(enumerate(texts)), SCHEMA).repartition(parts)
    whole = Tokenizer.from_file(PATH)
    want = {i: (len((t or "").encode()), len(whole.encode(t or "", add_special_tokens=False).ids))
            for i, t in enumerate(texts)}
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"]) for r in token_counts.token_counts(df, PATH).collect()} == want


def test_table_is_bounded_and_frequent(spark):
    rows = [(i, "the of " * 20 + prose(i, 50)) for i in range(40)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    table = token_counts.frequent_lengths(df, PATH, table_size=50)
    assert {" the", " of"} <= set(table) and len(table) <= 50
    assert token_counts.frequent_lengths(df.withColumn("text", F.lit(None).cast("string")), PATH) == {}


def test_query(spark, tmp_path):
    from arrearview.llm.queries import QUERIES

    rows = [(None, "null id"), (1, "<|endoftext|> special"), (2, None), (3, prose(3, 2000)), (3, prose(3, 2000)), (4, "é\x00 ")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    whole = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        n = len(whole.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 1024))
    got = [tuple(r) for r in QUERIES["op9_token_counts"](spark, str(tmp_path)).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want)) and any(x[3] for x in got)
