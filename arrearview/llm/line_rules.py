"""Quality rules: base rules on a document's words, and cross-document line frequency per host.

Lines are split at newlines and normalised (lower case, white space runs to one space, trimmed); empty ones do not
count. For each host the distinct documents that hold a line are counted, by 128 bits of the line's hash. Copies of one
text are one document here, so a text does not condemn its own lines by being mirrored; `copies` counts them each. A line is boilerplate of its host if
more than `min_docs` texts and more than `max_share` of the host's texts hold it. Boilerplate lines are removed. A
document is depleted, and rejected, if fewer than `min_words` words are left or more than `max_removed` of its words
went.

Counting is by pre-aggregated sums keyed by host and line, so a host with a third of all rows is many keys. A host has
at most (mean lines of its texts) / max_share boilerplate lines; they are written as one row per host, and Spark
broadcasts that table only if its size on disk allows, else it joins by host with skewed hosts split.

Nulls: a null text is empty, fails the base rules and is not kept; a null host is the empty host; null ids pass through.
Repeated rows come out repeated. An empty table gives no rows. Columns made on the way have names of their own in each call.
"""

from __future__ import annotations

import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import SPACE, Words, grams, text_keys, written

SYMBOLS = "#*$%&|<>"
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_words(numbers: np.ndarray, size: int) -> int:
    """Words inside windows of `size` (a power of two) words that occur twice or more in the text."""
    rank, width = numbers, 1
    while width < size:  # ranks of pairs of ranks: exact, without comparing windows
        pair = rank[:-width] * (rank.max() + 1) + rank[width:]
        rank, width = np.unique(pair, return_inverse=True)[1], width * 2
    twice = np.bincount(rank)[rank] > 1
    edge = np.zeros(len(numbers) + 1, np.int64)
    np.add.at(edge, np.flatnonzero(twice), 1)
    np.add.at(edge, np.flatnonzero(twice) + size, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def base_numbers(text: str, words: Words, window: int = 8) -> tuple[int, int, int, int, int]:
    found = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(" \t\n\v\f\r")]
    repeats = 0
    if len(found) > window:
        hashes = words.of(found)
        h = np.sort(grams(hashes, window))
        if (h[1:] == h[:-1]).any():  # else all windows differ
            repeats = repeated_words(np.unique(hashes, return_inverse=True)[1], window)
    return (len(found), len(b"".join(found).decode()), sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)),
            repeats)


def base(texts: pd.Series) -> pd.DataFrame:
    words = Words()
    return pd.DataFrame([base_numbers(t, words) for t in texts], columns=[x.split()[0] for x in BASE.split(", ")])


def normal(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), SPACE, " "))


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2"))


def boilerplate(docs: DataFrame, min_docs: int, max_share: float, copies: bool = False) -> DataFrame:
    """host, lines: keys of the boilerplate lines of each host that has any. Reads the columns host and text.

    A text counts once per host, or, with `copies`, as often as it stands there.
    """
    keys = F.array_distinct(F.transform(F.filter(F.transform(F.split("text", "\n"), normal), lambda x: x != ""),
                                        line_key))
    texts = docs.select("host", *text_keys(F.col("text")), keys.alias("lines"))
    held, every = texts.select("host", "k1", "k2", F.explode("lines").alias("line")), texts.select("host", "k1", "k2")
    if not copies:
        held, every = held.distinct(), every.distinct()
    times = held.groupBy("host", "line").agg(F.count("*").alias("n")).filter(F.col("n") > min_docs)
    sizes = every.groupBy("host").agg(F.count("*").alias("texts"))
    common = times.join(sizes, "host").filter(F.col("n") > max_share * F.col("texts"))
    return common.groupBy("host").agg(F.collect_list("line").alias("lines"))


def with_rules(docs: DataFrame, host: str = "source", min_docs: int = 5, max_share: float = 0.05, min_words: int = 20,
               max_removed: float = 0.5, copies: bool = False) -> DataFrame:
    """All rows and columns, and the struct `rules`: the base numbers, base_failed, n_lines_removed,
    n_words_removed, left (the text without boilerplate lines) and kept. An input column of that name is replaced."""
    own = uuid.uuid4().hex[:12]
    host_, text_, lines_, gone_, base_, cut_, left_ = (f"{n}_{own}" for n in (
        "host", "text", "lines", "gone", "base", "cut", "left"))
    rows = docs.drop("rules").withColumns({
        host_: F.coalesce(F.col(host).cast("string"), F.lit("")), text_: F.coalesce("text", F.lit(""))})
    # Else a filter on the rules is split and pushed down with the function, which then runs twice, in two workers a task.
    once = F.pandas_udf(base, BASE).asNondeterministic()
    found = boilerplate(rows.select(F.col(host_).alias("host"), F.col(text_).alias("text")), min_docs, max_share, copies)
    rows = rows.withColumn(base_, once(text_)).join(written(found).toDF(host_, lines_), host_, "left")
    is_common = lambda x: F.array_contains(lines_, line_key(normal(x)))
    split = F.split(text_, "\n")
    rows = rows.withColumn(gone_, F.when(F.col(lines_).isNotNull(), F.filter(split, is_common)))
    hit = F.size(gone_) > 0
    gone = F.array_join(gone_, "\n")
    rows = rows.withColumns({
        cut_: F.when(hit, F.size(F.filter(F.split(gone, SPACE), lambda w: w != ""))).otherwise(0).cast("long"),
        left_: F.when(hit, F.array_join(F.filter(split, lambda x: ~is_common(x)), "\n")).otherwise(F.col(text_))})
    n, cut = F.col(f"{base_}.n_words"), F.col(cut_)
    failed = (n < min_words) | (100 * F.col(f"{base_}.n_repeat_words") > 30 * n)
    depleted = (n - cut < min_words) | (cut > max_removed * n)
    rules = F.struct(f"{base_}.*", failed.alias("base_failed"),
                     F.when(hit, F.size(gone_)).otherwise(0).alias("n_lines_removed"),
                     cut.alias("n_words_removed"), F.col(left_).alias("left"),
                     (~failed & ~depleted).alias("kept"))
    return rows.select(*[F.col(f"`{c}`") for c in docs.columns if c != "rules"], rules.alias("rules"))
