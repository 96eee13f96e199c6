"""The corpus pipeline: quality rules, near-duplicates, repeated passages, benchmark leaks, packing.

Each stage takes all documents its predecessor kept, with all their columns; the last one gives the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearview.llm import decontaminate, jaccard, line_rules, packing, seed_extend
from arrearview.llm.common import read, written
from arrearview.llm.queries import TOKENIZER


def _with_text(docs: DataFrame, text, columns: list[str]) -> DataFrame:
    """The columns of documents with another text, and its length where the table has one."""
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return docs.select(*[new[c].alias(c) if c in new else F.col(f"`{c}`") for c in columns])


def _as_row(docs: DataFrame) -> DataFrame:
    """The input row as one struct, so that none of its columns meets a name used here; and its id."""
    return docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("id"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, without the boilerplate lines of their host."""
    return _with_text(line_rules.with_rules(docs).filter("rules.kept"), F.col("rules.left"), docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of a shingle similarity of 0.8: the one with the least id; of rows that are alike one.

    Candidates are the links of operator 4 (SimHash, pigeonring), and of MinHash beyond its radius; all are compared.
    """
    groups = written(jaccard.near_duplicates(docs.select("doc_id", "text")))
    keep = written(groups.filter("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct())
    rows = _as_row(docs)
    stays = rows.join(keep, "id", "left_semi").unionByName(rows.filter("id is null"))  # rows without an id name no group
    again = written(groups.groupBy(F.col("doc_id").alias("id")).agg(F.count("*").alias("n")).filter("n > 1").select("id"))
    same = stays["id"].eqNullSafe(again["id"])
    out = stays.join(again, same, "left_anti").unionByName(
        stays.join(again, same, "left_semi").withColumn("text", F.col("row.text")).dropDuplicates(["id", "text"])
        .drop("text"))
    return out.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that an earlier document has; documents with no word left go."""
    left = seed_extend.without_repeats(docs).filter(
        "repeats.n_removed = 0 or repeats.n_removed < repeats.n_words")
    return _with_text(left, F.col("text"), docs.columns)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, read(spark, sf_dir, "benchmark"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place."""
    return packing.pack(packing.pieces_of(docs, TOKENIZER))


STAGES = [
    ("quality rules", quality_rules),
    ("near-duplicates", near_duplicates),
    ("repeated passages", repeated_passages),
    ("benchmark leaks", benchmark_leaks),
    ("packing", packed),
]

#: No SQL for XXH64 fingerprints and token ids; the tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir))
    return docs
