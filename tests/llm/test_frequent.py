"""The table of frequent pre-tokens covers all documents."""

from arrearview.llm import token_counts
from arrearview.llm.queries import TOKENIZER


def test_late_documents_are_in_the_table(spark):
    rows = [(i, "early words") for i in range(2500)] + [(5000 + i, "later tokens " * 9) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {" later", " tokens"} <= set(token_counts.frequent_lengths(docs, TOKENIZER, table_size=4))
