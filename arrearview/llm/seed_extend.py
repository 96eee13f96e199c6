"""Substring dedup by seed and extend, over words.

A repeat is a run of at least `window` words that also occurs in a document with a smaller doc_id. Seeds: winnowing
keeps, of any `window - gram + 1` consecutive grams, the one with the least hash, so every run of `window` words holds
a seed and equal runs hold the same one. Seeds found in one document only are dropped. Around each shared seed the
match is extended both ways to every window of `window` words that holds the seed; windows are compared by 128 bits of
hash, and each is paired with the smallest document that has it. Neighbouring paired windows join into maximal repeats.

All steps are joins and pre-aggregated minima: a passage that a third of all documents share is one row per map task
in the aggregates, and its rows in the joins are split by the skew join. No pairs of documents are made.

Copies of a whole text take no part but for the first, as all their words repeat. A text is known by its doc_id and 64
bits of its hash, `tag`, so texts that share a doc_id are told apart however many they are. Nulls: a null text has no
words; a row without doc_id has no order, so it removes nothing, loses nothing, and comes out with its own words. Repeated
rows (one doc_id and text) are one document and come out repeated; if several texts share a doc_id, each is judged by
itself, and texts of the same doc_id do not remove from each other. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import SPACE, Words, discard, grams, mixed, pieces, runs, text_keys, written

#: A position that stands for all words of a text.
WHOLE = -1


def seeds(hashes: np.ndarray, window: int, gram: int) -> np.ndarray:
    """Positions of the winnowed grams of one text, as words."""
    if len(hashes) < window:
        return np.empty(0, np.int64)
    low = np.uint64(0xFFFFFFFF)  # positions below the upper half of the hash: the first of equal grams is the least
    found = (grams(hashes, gram) & ~low) | np.arange(len(hashes) - gram + 1, dtype=np.uint64)
    width = window - gram + 1
    least = found[:len(found) - width + 1]
    for i in range(1, width):
        least = np.minimum(least, found[i:len(found) - width + 1 + i])
    return (least[np.r_[True, least[1:] != least[:-1]]] & low).astype(np.int64)


def around(positions: np.ndarray, n_words: int, window: int, gram: int) -> np.ndarray:
    """Starts of all windows that hold a seed at one of the positions."""
    starts = (positions[:, None] - np.arange(window - gram + 1)[None, :]).ravel()
    return np.unique(starts[(starts >= 0) & (starts <= n_words - window)])


def _seed_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    def made(frames):
        words = Words()
        for frame in pieces(frames):
            at, out = [], []
            for text in frame["text"]:
                h = words.of(text.encode().split())
                found = seeds(h, window, gram)
                out.append(grams(h, gram)[found])
                at.append(found)
            many = [len(x) for x in at]
            yield pd.DataFrame({"seed": np.concatenate(out).view(np.int64),
                                "doc_id": np.repeat(frame["doc_id"].to_numpy(), many),
                                "tag": np.repeat(frame["tag"].to_numpy(), many), "at": np.concatenate(at).astype(np.int32)})

    return docs.mapInPandas(made, "seed long, doc_id long, tag long, at int")


def _window_rows(docs: DataFrame, window: int, gram: int) -> DataFrame:
    """From doc_id, tag, text and the seed positions `ats`: hash and start of each window around a seed."""
    def made(frames):
        words = Words()
        for frame in pieces(frames, 256):
            at, low, high = [], [], []
            for text, ats in zip(frame["text"], frame["ats"]):
                h = words.of(text.encode().split())
                starts = around(np.asarray(ats, np.int64), len(h), window, gram)
                low.append(grams(h, window)[starts])
                high.append(grams(mixed(h), window, 0xC2B2AE3D27D4EB4F)[starts])
                at.append(starts)
            many = [len(x) for x in at]
            yield pd.DataFrame({"h1": np.concatenate(low).view(np.int64), "h2": np.concatenate(high).view(np.int64),
                                "doc_id": np.repeat(frame["doc_id"].to_numpy(), many),
                                "tag": np.repeat(frame["tag"].to_numpy(), many), "at": np.concatenate(at).astype(np.int32)})

    return docs.mapInPandas(made, "h1 long, h2 long, doc_id long, tag long, at int")


def later_copies(docs: DataFrame) -> DataFrame:
    """doc_id, tag of the texts that occur as a whole under a smaller doc_id too."""
    keys = docs.select("doc_id", "tag", *text_keys(F.col("text")))
    first = keys.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    # A counted key is written before it is joined: only a join of two plain exchanges has its hot keys split.
    many = written(first.filter("first < last").select("k1", "k2", "first"))
    return keys.join(many, ["k1", "k2"]).filter("doc_id > first").select("doc_id", "tag").distinct()


def repeated(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """doc_id, tag, ats: the starts of the repeated windows of each text that has any.

    Each step is written, so that the shuffle files and tables of the one before are gone when the next one runs.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").filter(
        "doc_id is not null and text is not null")
    copies = written(later_copies(docs))
    rows = written(_seed_rows(docs, window, gram))
    shared = written(rows.groupBy("seed").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                     .filter("first < last").select("seed"))
    placed = written(rows.join(shared, "seed").groupBy("doc_id", "tag").agg(F.collect_set("at").alias("ats"))
                     .join(copies, ["doc_id", "tag"], "left_anti"))
    discard(rows)
    windows = written(_window_rows(docs.join(placed, ["doc_id", "tag"]), window, gram))
    first = written(windows.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                    .filter("first < last").select("h1", "h2", "first"))
    paired = windows.join(first, ["h1", "h2"]).filter("doc_id > first").groupBy("doc_id", "tag").agg(
        F.collect_set("at").alias("ats"))
    found = written(paired.union(copies.select("doc_id", "tag", F.array(F.lit(WHOLE)))))
    for done in (placed, windows, copies, shared, first):
        discard(done)
    return found


CUT = "text string, n_words long, n_removed long, spans array<struct<first:int,last:int>>"


def without_repeats(docs: DataFrame, window: int = 13, gram: int = 5) -> DataFrame:
    """All rows and columns; `text` loses its repeated words, and the struct `repeats` says which.

    A text that loses words becomes its other words joined by one space; any other stays as it is. `repeats` holds
    n_words and n_removed and the maximal repeats as first and last word; an input column of that name is replaced.
    """
    marks = repeated(docs, window, gram)

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, marked: pd.Series) -> pd.DataFrame:
        out = []
        for text, ats in zip(texts, marked):
            if text is None or ats is None:
                out.append((None, None, None, None))
                continue
            words, starts = text.encode().split(), np.sort(np.asarray(ats, np.int64))
            if len(starts) and starts[0] == WHOLE:
                spans = np.array([[0, len(words)]]) if len(words) >= window else np.empty((0, 2), np.int64)
            else:
                spans = runs(starts, window)
            if not len(spans):
                out.append((None, None, None, None))
                continue
            stays = np.ones(len(words), bool)
            for a, b in spans:
                stays[a:b] = False
            left = b" ".join([w for w, s in zip(words, stays.tolist()) if s]).decode()
            out.append((left, len(words), len(words) - int(stays.sum()),
                        [{"first": int(a), "last": int(b) - 1} for a, b in spans]))
        return pd.DataFrame(out, columns=["text", "n_words", "n_removed", "spans"])

    none = F.array().cast("array<struct<first:int,last:int>>")
    # The input row is one struct on the way, so that none of its columns meets a name used here.
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"),
                       F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"))
    text = F.col("row.text")
    joined = rows.join(marks, ["doc_id", "tag"], "left").select(
        "row", cut(F.when(F.col("ats").isNotNull(), text), F.col("ats")).alias("cut"))
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPACE), lambda w: w != "")).cast("long")
    repeats = F.struct(F.coalesce("cut.n_words", words).alias("n_words"),
                       F.coalesce("cut.n_removed", F.lit(0).cast("long")).alias("n_removed"),
                       F.coalesce("cut.spans", none).alias("spans"))
    columns = [(F.coalesce("cut.text", text) if c == "text" else F.col(f"row.`{c}`")).alias(c)
               for c in docs.columns if c != "repeats"]
    return joined.select(*columns, repeats.alias("repeats"))


def word_digest(texts: pd.Series) -> pd.DataFrame:
    """The number of words of each text, and the SHA-256 of the words joined by one space."""
    found = [(t or "").encode().split() for t in texts]
    return pd.DataFrame({"n": [len(w) for w in found],
                         "sha256": [hashlib.sha256(b" ".join(w)).hexdigest() for w in found]})
