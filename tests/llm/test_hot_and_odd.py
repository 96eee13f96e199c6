"""Hot groups, clashing columns, caps that are gone, and windows that are not skipped."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from fixtures import odd_rows, prose
from pyspark.sql import functions as F

from arrearview.llm import (
    chat_format, common, cotraining, decontaminate, jaccard, language_id, line_rules, packing, seed_extend, simhash,
)
from arrearview.llm.components import components

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_a_star_of_many_links(spark):
    links = spark.range(1, 100_001).select(F.lit(0).cast("long").alias("a"), F.col("id").alias("b")).repartition(4)
    out = components(links)
    assert out.count() == 100_001 and out.select("component").distinct().collect() == [(0,)]
    assert components(links.limit(0)).count() == 0


def test_identical_rows_are_packed_in_many_groups(spark):
    pieces = spark.range(100_000).selectExpr("cast(null as long) doc_id", "0 piece", "0L start", "1 length", "7L ids_crc32")
    out = common.written(packing.pack(pieces, partition_rows=5_000))
    bins, bound = packing.bins_and_bound(out)
    assert out.count() == 100_000 and bound == 49 <= bins <= 60
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).agg(F.max("n")).first()[0] <= 2048


def test_rounds_go_on_while_they_help(spark):
    r = np.random.default_rng(2)
    rows = [(i, 0, 0, int(n), 0) for i, n in enumerate(r.integers(300, 1900, 6000))]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length int, ids_crc32 long")
    out = common.written(packing.pack(pieces, partition_rows=300))
    bins, bound = packing.bins_and_bound(out)
    assert out.count() == 6000 and bound <= bins <= 1.03 * bound


NAMES = ("row", "host", "text_", "common", "met", "gone", "base", "lines", "cut", "left", "id", "k1", "k2", "tag", "ats",
         "node", "component", "component_id", "_deal", "_part", "words", "pos", "h", "n", "q", "start", "print", "v", "wide",
         "parts", "layout_", "rules_", "_host", "_lines", "_keep", "_again", "_doc", "_ats", "_k1", "_k2", "_print", "_v")


def test_no_internal_name_meets_a_column(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([(0, prose(7, 60))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.createDataFrame([(i, prose(i, 60), "en", "s", 0) for i in range(4)] + odd_rows()[4:9], DOCS)
    docs = docs.withColumns({n: F.lit(n) for n in NAMES})
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != "packing":
            assert out.columns == docs.columns, name
            assert {tuple(r) for r in out.select(*NAMES).distinct().collect()} == {NAMES}, name
        assert out.count() > 0
    for out in (line_rules.with_rules(docs), seed_extend.without_repeats(docs)):
        assert {tuple(r) for r in out.select(*NAMES).distinct().collect()} == {NAMES}
    record = '{"prompt": "a", "response": "b"}'
    chats = spark.createDataFrame([(1, record)], "conv_id long, record string").withColumns({n: F.lit(n) for n in NAMES})
    made = chat_format.formatted(chats)
    assert {tuple(r) for r in made.select(*NAMES).collect()} == {NAMES} and made.first()["turns"][1]["text"] == "b"


@pytest.mark.parametrize("stage", range(5))
def test_empty_tables_through_the_pipeline(spark, none, tmp_path, stage):
    import corpus_pipeline

    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.STAGES[stage][1](spark, none, str(tmp_path)).count() == 0
    if stage == 1:
        assert jaccard.near_duplicates(none.select("doc_id", "text")).count() == 0
        assert chat_format.formatted(spark.createDataFrame([], "conv_id long, record string")).count() == 0


def weighed(words):
    out = Counter()
    for i in range(len(words) - 4):
        out[tuple(words[i:i + 5])] += len("".join(words[i:i + 5]))
    return out


def alike(a, b):
    x, y = weighed(a), weighed(b)
    both = sum((x & y).values())
    return both / (sum(x.values()) + sum(y.values()) - both)


def test_no_window_is_skipped(spark):
    """Items with one to three edits, against every window of every document."""
    r = random.Random(3)
    items = [(i, prose(900 + i, 50 + 6 * i)) for i in range(12)]
    docs = []
    for d in range(90):
        words = items[d % 12][1].split()
        for _ in range(1 + d % 3):
            at, kind = r.randrange(len(words)), r.randrange(3)
            words[at:at + (kind != 1)] = [] if kind == 0 else [prose(5000 + r.randrange(10 ** 6), 1)]
        docs.append((d, prose(2000 + d, r.randrange(60)) + " " + " ".join(words) + " " + prose(3000 + d, r.randrange(60))))
    want = {}
    for d, text in docs:
        words = text.lower().split()
        for i, item in items:
            n = len(item.split())
            best = max((alike(words[s:s + n], item.split()) for s in range(max(1, len(words) - n + 1))), default=0)
            if best >= 0.8:
                want[d, i] = round(best, 9)
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                spark.createDataFrame(items, "item_id long, text string"))
    got = {(x["doc_id"], x["item_id"]): round(x["similarity"], 9) for x in found.collect()}
    assert got == want and len(want) >= 20


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(f"l{i:03}", prose(i, 5)) for i in range(300)], "lang string, text string")
    languages, counts = language_id.learned(docs)
    assert len(languages) == 300 and (counts.sum(axis=1) > 0).all()


def test_long_texts_are_scored_in_stretches():
    r = np.random.default_rng(0)
    labeller = language_id.Labeller(["a", "b"], r.integers(0, 9, (2, language_id.SLOTS)).astype(float), 12.0)
    _, bucket, new = language_id.read_letters(prose(1, 3000))
    first = np.flatnonzero(new)
    whole = np.add.reduceat(labeller.log[bucket], first)
    for letters in (1, 50, 1000, 1 << 20):
        assert np.allclose(labeller.words(bucket, first, letters), whole)


def test_copies_count_once_or_each(spark):
    line = "one line that stands on every page here"
    rows = [(i, prose(1, 30) + "\n" + line, "en", "h", 0) for i in range(8)] + [(8, prose(2, 30), "en", "h", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    cut = lambda **o: {r["rules"]["n_lines_removed"] for r in line_rules.with_rules(docs, **o).collect()}
    assert cut() == {0} and cut(copies=True) == {0, 2}


def test_labels_of_many_rows_are_bounded(spark):
    """Ten thousand rows of one labelled document start and calibrate as one."""
    docs = spark.createDataFrame([(i, prose(i, 20), "en", "s", 0) for i in range(40)], DOCS)
    docs = docs.unionByName(docs.filter("doc_id = 3").withColumn("doc_id", F.explode(F.array_repeat("doc_id", 10_000))))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    assert cotraining.label_sample(labels, 10).count() == 10
    assert cotraining.scored(docs, labels, rounds=1).count() == 10_040


def test_simhash_and_scratch(spark, none):
    assert simhash.near_duplicates(none.select("doc_id", "text")).count() == 0
    df = common.written(spark.range(3))
    assert df.count() == 3 and df.scratch_folder in common._LEFT
    common.discard(df)
    assert df.scratch_folder not in common._LEFT


@pytest.mark.parametrize("broadcast", ["10m", "-1"])
def test_quality_rules_read_each_text_once(spark, tmp_path, broadcast):
    """One Python worker a task: base numbers are not made again for the filter on them."""
    import corpus_pipeline

    rows = [(i, f"{prose(i, 40)}\nfooter of s{i % 2}", "en", f"s{i % 2}", 0) for i in range(30)] + odd_rows()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    docs, before = spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", broadcast)
    try:
        out = corpus_pipeline.quality_rules(spark, docs, "")
        plan = out._jdf.queryExecution().executedPlan().toString()
        got = {tuple(r) for r in out.select("doc_id", "text").collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert len(re.findall(r"ArrowEvalPython \[", plan)) == 1
    kept = {(r["doc_id"], r["rules"]["left"]) for r in line_rules.with_rules(docs).collect() if r["rules"]["kept"]}
    assert got == kept and {(i, prose(i, 40)) for i in range(30)} <= got
