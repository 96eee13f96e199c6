"""Language identification of words, spans and documents.

Model: for each language the frequencies of letter trigrams (hashed to 2^15 buckets, word edges included) and of
scripts, summed over all learning documents by map-side vectors. It holds every language that these name; what is
collected and broadcast is 128 KB a language, however many documents there are.

Prediction: the script of a word, by code point ranges, narrows its languages to those that wrote it in at least one of
a thousand letters. A word's score in a language is the sum of its trigrams' log probabilities. Viterbi over the words
of a text, with a penalty for each switch, gives the best sequence of languages; it runs over all texts of a batch in
step, and long texts are scored in stretches. Equal neighbours form spans. The document's language is the one with most letters, the score its share of them.

Nulls and texts without a letter are `und`, score 0, no spans; so is everything if nothing could be learned. A null id
comes out as it is. Repeated rows come out repeated.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 15
#: First and last code point of scripts, by Unicode block.
SCRIPTS = {
    "latin": [(0x41, 0x24F), (0x1E00, 0x1EFF)], "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)], "armenian": [(0x530, 0x58F)], "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)], "devanagari": [(0x900, 0x97F)], "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)], "telugu": [(0xC00, 0xC7F)], "thai": [(0xE00, 0xE7F)], "georgian": [(0x10A0, 0x10FF)],
    "ethiopic": [(0x1200, 0x137F)], "khmer": [(0x1780, 0x17FF)], "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x9FFF), (0x20000, 0x323AF)], "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7A3)],
}
SLOTS = BUCKETS + len(SCRIPTS) + 1
SPANS = "array<struct<lang:string,start:int,end:int>>"
RESULT = f"doc_id long, held_out boolean, lang_pred string, score double, spans {SPANS}"


@cache
def tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: its lower case if it is a letter, else 0; and its script."""
    lower = np.zeros(0x110000, np.uint32)
    for c in range(0x110000):
        s = chr(c)
        if s.isalpha():
            small = s.lower()
            lower[c] = ord(small) if len(small) == 1 else c
    script = np.full(0x110000, len(SCRIPTS), np.uint8)
    for i, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            script[a:b + 1] = i
    return lower, script


def read_letters(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the letters, the trigram bucket of each, and which letters begin a word."""
    lower, _ = tables()
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    small = np.zeros(len(points) + 2, np.uint64)
    small[1:-1] = lower[points]
    at = np.flatnonzero(small)  # one past the place in the text
    mixed = (small[at - 1] * np.uint64(0x9E3779B97F4A7C15) + small[at] * np.uint64(0xC2B2AE3D27D4EB4F)
             + small[at + 1] * np.uint64(0x165667B19E3779F9))
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return at - 1, (mixed >> np.uint64(49)).astype(np.int64), small[at - 1] == 0


def learned(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """All languages that the rows name, and their counts by slot. Reads text and lang."""
    def count(frames):
        _, script = tables()
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"]):
                at, bucket, _ = read_letters(text)
                own = sums.setdefault(lang, np.zeros(SLOTS, np.int64))
                own[:BUCKETS] += np.bincount(bucket, minlength=BUCKETS)
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)[at]
                own[BUCKETS:] += np.bincount(script[points], minlength=len(SCRIPTS) + 1)
        if sums:
            yield pd.DataFrame({"lang": list(sums), "counts": list(sums.values())})

    per_task = docs.select("text", "lang").mapInPandas(count, "lang string, counts array<long>")
    cells = (per_task.select("lang", F.posexplode("counts").alias("slot", "n")).filter("n > 0")
             .groupBy("lang", "slot").agg(F.sum("n").alias("n")))
    found = cells.toPandas()
    languages = sorted(found["lang"].unique())
    counts = np.zeros((len(languages), SLOTS))
    counts[np.searchsorted(languages, found["lang"]), found["slot"]] = found["n"]
    return languages, counts


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The best language of each word; scores has the words of all texts one after the other."""
    order = np.argsort(-sizes, kind="stable")
    begin = (np.cumsum(sizes) - sizes)[order]
    longest_first = sizes[order]
    live = np.searchsorted(-longest_first, -np.arange(longest_first[0] if len(sizes) else 0), side="left")
    best = np.zeros((len(sizes), scores.shape[1]))
    switched, came_from = np.zeros(scores.shape, bool), np.zeros(len(scores), np.int16)
    for t, k in enumerate(live):
        rows, have = begin[:k] + t, best[:k]
        if t:
            top = have.argmax(axis=1)
            over = have[np.arange(k), top] - penalty
            turn = have < over[:, None]
            switched[rows], came_from[rows] = turn, top
            have = np.where(turn, over[:, None], have)
        best[:k] = have + scores[rows]
    labels, now = np.zeros(len(scores), np.int16), best.argmax(axis=1).astype(np.int16)
    for t in range(len(live) - 1, -1, -1):
        k = live[t]
        rows = begin[:k] + t
        labels[rows] = now[:k]
        if t:
            now[:k] = np.where(switched[rows, now[:k]], came_from[rows], now[:k])
    return labels


class Labeller:
    def __init__(self, languages: list[str], counts: np.ndarray, penalty: float) -> None:
        self.languages, self.penalty = languages, penalty
        trigrams, scripts = counts[:, :BUCKETS], counts[:, BUCKETS:]
        self.log = np.log((trigrams + 0.1) / (trigrams.sum(axis=1, keepdims=True) + 0.1 * BUCKETS)).T.astype(np.float32)
        allowed = scripts >= 0.001 * scripts.sum(axis=1, keepdims=True)
        allowed[:, ~allowed.any(axis=0)] = True  # a script that nothing was learned in narrows nothing
        self.outside = np.where(allowed.T, 0, -1e6).astype(np.float32)

    def words(self, bucket: np.ndarray, first: np.ndarray, letters: int = 1 << 20) -> np.ndarray:
        """Scores of the words that begin at `first`, about a million letters at once."""
        ends = np.r_[first[1:], len(bucket)]
        out, a = np.empty((len(first), self.log.shape[1]), np.float32), 0
        while a < len(first):
            b = max(a + 1, int(np.searchsorted(ends, first[a] + letters, "right")))
            part = self.log[bucket[first[a]:ends[b - 1]]]
            out[a:b] = np.add.reduceat(part, first[a:b] - first[a])
            a = b
        return out

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[dict]]]:
        _, script = tables()
        scores, sizes, firsts, lasts = [], [], [], []
        for text in texts:
            at, bucket, new = read_letters(text or "")
            first = np.flatnonzero(new)
            sizes.append(len(first))
            if len(first):
                points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
                scores.append(self.words(bucket, first) + self.outside[script[points[at[first]]]])
                firsts.append(at[first])
                lasts.append(at[np.r_[first[1:], len(at)] - 1] + 1)
        sizes = np.array(sizes, np.int64)
        if not self.languages or not sizes.sum():
            return [("und", 0.0, [])] * len(texts)
        labels = viterbi(np.concatenate(scores), sizes, self.penalty)
        first, last = np.concatenate(firsts), np.concatenate(lasts)
        owner = np.repeat(np.arange(len(texts)), sizes)
        share = np.bincount(owner * len(self.languages) + labels, last - first,
                            len(texts) * len(self.languages)).reshape(len(texts), -1)
        new = np.flatnonzero(np.r_[True, (np.diff(owner) != 0) | (np.diff(labels) != 0)])
        end = np.r_[new[1:], len(owner)] - 1
        spans: list[list[dict]] = [[] for _ in texts]
        for i, lang, a, b in zip(owner[new].tolist(), labels[new].tolist(), first[new].tolist(), last[end].tolist()):
            spans[i].append({"lang": self.languages[lang], "start": a, "end": b})
        top, total = share.argmax(axis=1), share.sum(axis=1)
        return [(self.languages[t], float(s[t] / n), own) if n else ("und", 0.0, [])
                for t, s, n, own in zip(top.tolist(), share, total, spans)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def language_of(docs: DataFrame, penalty: float = 12.0) -> DataFrame:
    """doc_id, held_out, lang_pred, score, spans (lang, start and end in code points) of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    known = rows.filter(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()
                        & F.col("lang").isNotNull() & F.col("text").isNotNull())
    model = docs.sparkSession.sparkContext.broadcast(learned(known))

    def predict(frames):
        labeller = Labeller(*model.value, penalty)
        for frame in frames:
            texts, at = frame["text"].tolist(), 0
            size = np.cumsum([len(t or "") for t in texts])
            while at < len(texts):  # about eight million characters at once
                end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + (1 << 23))))
                lang, score, spans = zip(*labeller.label(texts[at:end]))
                part = frame.iloc[at:end]
                yield pd.DataFrame({"doc_id": part["doc_id"].astype("Int64").to_numpy(dtype=object, na_value=None),
                                    "held_out": part["held"].to_numpy(), "lang_pred": lang, "score": score,
                                    "spans": list(spans)})
                at = end

    return rows.select("doc_id", "text", held_out(F.col("doc_id")).alias("held")).mapInPandas(predict, RESULT)
