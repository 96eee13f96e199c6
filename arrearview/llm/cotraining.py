"""Quality classifier by co-training of a text view and a page-metadata view.

Text view: hashed words, a mark for words with symbols and one for repeated lines. Metadata view: source, language,
length class and their pairs, lines and their mean length, and the shares of kinds of characters, which say what a page
looks like and not what it says. Each view is a naive Bayes model; its training is a sum of count vectors, so every round
is one map over all documents that scores with both models and adds up the counts of the next ones. A document that one
view is sure about is given, with that view's label, to the training set of the other view; all pseudo-labels of a class
together count at most `weight` (a fifth) of what its labels do, so that the many cases that one view finds easy do not drown the few that
only the other can see. After each round both views are calibrated by logistic regression on labelled rows kept out of training; the last step combines the calibrated
views in the same way and scores all documents.

A document is good if it is labelled of quality and not toxic; a toxic one is bad whether or not its quality is known,
and any other label without a quality says nothing. At most `max_labels` labelled documents are used, those
with the least hash of their id; a fifth of them calibrates. These rows (their ids and labels) and the count vectors are
all that is collected; both are bounded. With labels of one kind only, or none, every score is the share of good labels
(one half without any).

Nulls: a null text is empty, null metadata is a value of its own, a null id is scored but never labelled. Conflicting
labels of one document count as bad. Repeated rows come out repeated; of the rows of a labelled document the first by
text, source and language is learned from or calibrates. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearview.llm.common import written

TEXT, META = 1 << 14, 1 << 12
SYMBOLS = set(b"#*$%&|<>")
#: Kinds of characters whose share of a text is metadata: symbols, capitals, digits, stops, link parts.
KINDS = (("y", b"#*$%&|<>"), ("u", bytes(range(65, 91))), ("d", b"0123456789"), ("p", b".,;:!?"), ("k", b"/=@_"))
RESULT = "doc_id long, score double, text_score double, meta_score double, good boolean"


class Buckets(dict):
    """Word to its bucket; words with symbols share one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 17:
            self.clear()
        plain = word.lower().strip(b".,;:!?\"'()")
        out = 0 if SYMBOLS & set(word) else 2 + xxhash.xxh64_intdigest(plain) % (TEXT - 2)
        self[word] = out
        return out


def text_features(text: str, buckets: Buckets) -> np.ndarray:
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x]
    again = len(lines) - len(set(lines))
    return np.r_[np.fromiter(map(buckets.__getitem__, words), np.int64, len(words)), np.ones(again, np.int64)]


def meta_features(source: str, lang: str, text: str) -> np.ndarray:
    raw, lines = text.encode(), text.count("\n") + 1
    size = max(1, len(raw))
    kinds = [f"{name}{(1000 * (len(raw) - len(raw.translate(None, chars))) // size).bit_length()}" for name, chars in KINDS]
    n, per_line = len(text).bit_length(), (len(text) // lines).bit_length()
    own = (f"s{source}", f"l{lang}", f"n{n}", f"s{source} l{lang}", f"l{lang} n{n}", f"b{lines.bit_length()}",
           f"w{per_line}", *kinds, " ".join(kinds))
    return np.array([xxhash.xxh64_intdigest(x.encode()) % META for x in own], np.int64)


class Model:
    """Log odds by bucket, and the calibration of what they add up to."""

    def __init__(self, counts: np.ndarray) -> None:
        share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
        self.odds = np.log(share[1] / share[0])
        self.curve = np.zeros(4)

    def raw(self, features: np.ndarray) -> list[float]:
        """Mean log odds, and what the strongest signs of either kind say: a few words can spoil a document."""
        if not len(features):
            return [0.0, 0.0, 0.0]
        odds = self.odds[features]
        return [float(odds.mean()), float(np.minimum(odds + 1.5, 0).sum()) / 10, float(odds.min())]

    def logit(self, raw: np.ndarray) -> np.ndarray:
        return np.clip(raw @ self.curve[1:] + self.curve[0], -30, 30)


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Weights, the intercept first, by Newton steps."""
    x, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (y - p) - ridge * w)
        w = w + step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _views(frame: pd.DataFrame, buckets: Buckets):
    for text, source, lang in zip(frame["text"], frame["source"], frame["lang"]):
        yield text_features(text, buckets), meta_features(source, lang, text)


def _summed(rows: DataFrame, work) -> tuple[np.ndarray, np.ndarray]:
    """Count vectors (class by bucket) of both views, from per-task vectors of `work`."""
    cells = (rows.mapInPandas(work, "view int, good int, counts array<long>")
             .select("view", "good", F.posexplode("counts").alias("at", "n")).filter("n > 0")
             .groupBy("view", "good", "at").agg(F.sum("n").alias("n")).toPandas())
    out = np.zeros((2, TEXT)), np.zeros((2, META))
    for view in (0, 1):
        own = cells[cells["view"] == view]
        if len(own):
            out[view][own["good"], own["at"]] = own["n"]
    return out


def _vectors(sums: tuple[np.ndarray, np.ndarray]) -> pd.DataFrame:
    return pd.DataFrame([(v, g, sums[v][g]) for v in (0, 1) for g in (0, 1)], columns=["view", "good", "counts"])


def _weight(base: np.ndarray, given: np.ndarray, share: float) -> np.ndarray:
    """How much pseudo-labels of each class count: together at most a share of what the class's labelled rows do."""
    return np.minimum(1, share * base.sum(axis=1, keepdims=True) / np.maximum(1, given.sum(axis=1, keepdims=True)))


def label_sample(labels: DataFrame, max_labels: int) -> DataFrame:
    """_id, _good, _fold of at most `max_labels` labelled documents; fold 0 calibrates."""
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    each = labels.filter(F.col("doc_id").isNotNull() & good.isNotNull()).groupBy(F.col("doc_id").cast("long").alias("_id"))
    order = F.xxhash64(F.lit(5), F.col("_id"))
    every = written(each.agg(F.min(good.cast("int")).alias("_good")))
    share = max_labels / max(1, every.count())
    if share < 0.5:  # the least hashes, and some to spare, come from the lowest part of their range
        every = every.filter(order < F.lit(int(min(1.5 * share * 2.0 ** 64 - 2.0 ** 63, 2.0 ** 63 - 1024))))
    return every.orderBy(order, "_id").limit(max_labels).withColumn("_fold", F.pmod(order, F.lit(5)).cast("int"))


def scored(docs: DataFrame, labels: DataFrame, rounds: int = 2, sure: float = 0.95,
           weight: float = 0.2, max_labels: int = 20_000) -> DataFrame:
    """doc_id, score (calibrated probability of a good document), the views' scores, good (score of one half or more)."""
    spark: SparkSession = docs.sparkSession
    text_or = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or("text").alias("text"),
                       text_or("source").alias("source"), text_or("lang").alias("lang"))
    sample = written(label_sample(labels, max_labels))
    # At most max_labels rows, one for each labelled document: small whatever the tables hold.
    one = F.min(F.struct("text", "source", "lang")).alias("one")
    known = written(rows.join(F.broadcast(sample), rows["doc_id"] == sample["_id"]).groupBy("_id", "_good", "_fold")
                    .agg(one).select("_good", "_fold", "one.*"))
    rows = rows.join(F.broadcast(sample), rows["doc_id"] == sample["_id"], "left").drop("_id")
    kinds = [r[0] for r in sample.select("_good").distinct().collect()]
    if len(kinds) < 2:
        share = F.lit(float(kinds[0]) if kinds else 0.5)
        return rows.select("doc_id", share.alias("score"), share.alias("text_score"), share.alias("meta_score"),
                           (share >= 0.5).alias("good"))

    def by_label(frames):
        buckets, sums = Buckets(), (np.zeros((2, TEXT), np.int64), np.zeros((2, META), np.int64))
        for frame in frames:
            for good, views in zip(frame["_good"], _views(frame, buckets)):
                for view, features in enumerate(views):
                    np.add.at(sums[view][good], features, 1)
        yield _vectors(sums)

    def calibrated(counts) -> tuple[list[Model], np.ndarray]:
        models = [Model(c) for c in counts]

        def raw(frames):
            buckets = Buckets()
            for frame in frames:
                yield pd.DataFrame({"good": frame["_good"], "raw": [
                    models[0].raw(a) + models[1].raw(b) for a, b in _views(frame, buckets)]})

        seen = known.filter("_fold = 0").mapInPandas(raw, "good int, raw array<double>").toPandas()
        if seen["good"].nunique() < 2:  # too few to keep apart
            seen = known.mapInPandas(raw, "good int, raw array<double>").toPandas()
        x, y = np.array(seen["raw"].tolist(), float).reshape(-1, 6), seen["good"].to_numpy(float)
        for view, m in enumerate(models):
            m.curve = logistic(x[:, 3 * view:3 * view + 3], y)
        return models, logistic(np.c_[models[0].logit(x[:, :3]), models[1].logit(x[:, 3:])], y)

    base = _summed(known.filter("_fold > 0"), by_label)
    models, both = calibrated(base)
    for _ in range(rounds):
        edge = np.log(sure / (1 - sure))

        def exchange(frames, models=models, edge=edge):
            buckets, sums = Buckets(), (np.zeros((2, TEXT), np.int64), np.zeros((2, META), np.int64))
            for frame in frames:
                for views in _views(frame, buckets):
                    said = [float(m.logit(np.array(m.raw(v)))) for m, v in zip(models, views)]
                    for view, s in enumerate(reversed(said)):  # each view learns from the other
                        if abs(s) >= edge:
                            sums[view][int(s > 0)] += np.bincount(views[view], minlength=sums[view].shape[1])
            yield _vectors(sums)

        given = _summed(rows.filter("_good is null"), exchange)
        models, both = calibrated([b + g * _weight(b, g, weight) for b, g in zip(base, given)])

    def score(frames):
        buckets = Buckets()
        for frame in frames:
            raw = np.array([models[0].raw(a) + models[1].raw(b) for a, b in _views(frame, buckets)]).reshape(-1, 6)
            text, meta = models[0].logit(raw[:, :3]), models[1].logit(raw[:, 3:])
            p = [1 / (1 + np.exp(-np.clip(z, -30, 30))) for z in (both[0] + both[1] * text + both[2] * meta, text, meta)]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                                "score": p[0], "text_score": p[1], "meta_score": p[2], "good": p[0] >= 0.5})

    return rows.select("doc_id", "text", "source", "lang").mapInPandas(score, RESULT)
