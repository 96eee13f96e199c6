"""Benchmark decontamination with SimHash windows, multi-index Hamming blocks and exact verification.

Texts are compared as lower-case words of letters and digits. A window of a document is as long as a benchmark item.
Windows are laid where a document shares a five-word shingle with an item: aligned with that item, and at every place up
to a fifth of the item away from that. A window that shares no shingle with any item has similarity zero; in one of 0.8
or more, a shared shingle is out of line by at most the words put in or left out before it, which are about a ninth of the
item at most (each leaves a shingle unmatched on either side), so all such windows are laid. Each distinct window gets a 64-bit SimHash over its shingles, weighted by
their characters times their number. The fingerprints are cut into radius + 1 blocks: two within the radius agree in at
least one block whole, so joining on (item size, block, value) finds all of them. The pairs are then checked by their
Hamming distance, and last by the exact weighted similarity: the sum over shingles of the smaller weight over the sum
of the larger one.

Windows with equal words are fingerprinted and compared once, however many documents hold them. Only DataFrame
functions are used. The item tables are read back from files, so Spark broadcasts them only if their size allows.

Items and documents of fewer than five words have no shingle and match nothing. Null texts are empty. A null doc_id
comes out as null; rows that share a doc_id are reported together, the best window of each item. Repeated rows do not
repeat the result. Empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import text_keys, written


def words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingle_hashes(found: Column, size: int) -> Column:
    count = F.size(found) - size + 1
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.xxhash64(
        *[F.get(found, i + k) for k in range(size)]))).otherwise(F.array().cast("array<long>"))


def weights(found: Column, size: int) -> Column:
    """Map of each shingle's hash to characters times occurrences, as an array of (hash, weight) by hash."""
    pairs = F.transform(F.sequence(F.lit(0), F.size(found) - size), lambda i: F.struct(
        F.xxhash64(*[F.get(found, i + k) for k in range(size)]).alias("h"),
        F.char_length(F.array_join(F.slice(found, i + 1, size), "")).alias("w")))
    return F.when(F.size(found) >= size, F.array_sort(pairs)).otherwise(
        F.array().cast("array<struct<h:bigint,w:int>>"))


def simhash(weighted: Column) -> Column:
    """Weighted SimHash of (hash, weight) pairs."""
    def bit(b: Column) -> Column:
        total = F.aggregate(weighted, F.lit(0).cast("long"), lambda t, x: t + F.when(
            F.getbit(x["h"], b) == 1, x["w"]).otherwise(-x["w"]))
        return F.when(total > 0, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(
            F.lit(0).cast("long"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda t, b: t.bitwiseOR(bit(b)))


def block_keys(fp: Column, radius: int) -> Column:
    """(block, value) for radius + 1 blocks of the 64 bits."""
    cuts = [i * 64 // (radius + 1) for i in range(radius + 2)]
    return F.array(*[F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND((1 << (b - a)) - 1)
                              .alias("value")) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))])


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two arrays of (hash, weight); a hash may occur several times."""
    sum_of = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda t, x: t + x["w"])
    share = F.aggregate(F.array_distinct(F.transform(a, lambda x: x["h"])), F.lit(0).cast("long"), lambda t, h: (
        t + F.least(sum_of(F.filter(a, lambda x: x["h"] == h)), sum_of(F.filter(b, lambda x: x["h"] == h)))))
    return F.when(F.size(a) > 0, share / (sum_of(a) + sum_of(b) - share)).otherwise(0.0)


def windows(docs: DataFrame, seeds: DataFrame, size: int) -> DataFrame:
    """doc_id, k1, k2, start, n (the item's words) and the words of each window laid along a shared shingle."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *text_keys(F.col("text")),
                       words(F.col("text")).alias("words"))
    rows = rows.select("*", F.posexplode(shingle_hashes(F.col("words"), size)).alias("pos", "h"))
    hits = rows.join(seeds, "h")
    last = F.greatest(F.lit(0), F.size("words") - F.col("n"))
    inside = lambda at: F.greatest(F.lit(0), F.least(at, last))
    line, away = F.col("pos") - F.col("q"), F.ceil(F.col("n") / 5).cast("int")
    around = F.explode(F.sequence(inside(line - away), inside(line + away)))
    return hits.select("doc_id", "k1", "k2", "n", "words", around.alias("start")).select(
        "doc_id", "k1", "k2", "start", "n", F.slice("words", F.col("start") + 1, F.col("n")).alias("window")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, size: int = 5, radius: int = 19,
          least: float = 0.8) -> DataFrame:
    """doc_id, k1, k2 (of its text), item_id, start (word), hamming, similarity: the best window of each pair."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), words(F.col("text")).alias("words"))
    items = written(items.filter(F.size("words") >= size).select(
        "item_id", F.size("words").alias("n"), weights(F.col("words"), size).alias("item"),
        shingle_hashes(F.col("words"), size).alias("hashes")).withColumn("item_fp", simhash(F.col("item"))))
    seeds = written(items.select("n", F.posexplode("hashes").alias("q", "h")))
    blocks = written(items.select("item_id", "n", "item_fp", F.explode(block_keys(F.col("item_fp"), radius))
                                  .alias("key")).select("item_id", "n", "item_fp", "key.*"))

    laid = written(windows(docs, seeds, size))
    distinct = laid.select("n", "window").distinct()
    printed = written(distinct.select("n", "window", weights(F.col("window"), size).alias("weighed"))
                      .withColumn("fp", simhash(F.col("weighed"))))
    keyed = printed.select("n", "window", "weighed", "fp", F.explode(block_keys(F.col("fp"), radius)).alias("key"))
    near = (keyed.select("n", "window", "weighed", "fp", "key.*").join(blocks, ["n", "block", "value"])
            .withColumn("hamming", F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))))
            .filter(F.col("hamming") <= radius).select("n", "window", "weighed", "item_id", "hamming").distinct())
    sure = (near.join(items.select("item_id", "item"), "item_id")
            .withColumn("similarity", similarity(F.col("weighed"), F.col("item")))
            .filter(F.col("similarity") >= least).select("n", "window", "item_id", "hamming", "similarity"))
    found = laid.join(sure, ["n", "window"])
    best = F.max(F.struct("similarity", (-F.col("start")).alias("before"), "hamming"))
    return (found.groupBy("doc_id", "k1", "k2", "item_id").agg(best.alias("best"))
            .select("doc_id", "k1", "k2", "item_id", (-F.col("best.before")).alias("start"),
                    F.col("best.hamming").alias("hamming"), F.col("best.similarity").alias("similarity")))


def clean(docs: DataFrame, benchmark: DataFrame, **limits) -> DataFrame:
    """The rows, with all their columns, that hold no benchmark item."""
    dirty = written(leaks(docs, benchmark, **limits).select("k1", "k2").distinct())
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *text_keys(F.col("text")))
    return rows.join(dirty, ["k1", "k2"], "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
