"""Periodic runs against a brute-force scan of all lags."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearview.llm import periodic_runs


def all_runs(words):
    n, out = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            part = words[start:i + q]
            if len(part) >= max(24, 3 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                out.append((start, len(part), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def left(words, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repeating(seed):
    r = random.Random(seed)
    n, names = r.randint(0, 400), r.choice([1, 2, 3, 6, 30, 500])
    words = [str(r.randrange(names)) for _ in range(n)]
    for _ in range(r.randint(0, 4) if n > 3 else 0):
        i, p, m = r.randrange(n), r.randint(1, 100), r.randint(1, 400)
        for j in range(i + p, min(n, i + p + m)):
            words[j] = words[j - p]
        if r.random() < 0.4:
            words[r.randrange(n)] = "x"
    return words


@pytest.mark.parametrize("seed", range(0, 600, 100))
def test_runs(seed):
    for s in range(seed, seed + 100):
        words = repeating(s)
        assert periodic_runs.runs_of(periodic_runs.numbered(words)) == all_runs(words)


def test_long_lags_by_blocks():
    r = random.Random(1)
    unit = [str(r.randrange(10 ** 6)) for _ in range(700)]
    words = ["a"] + unit * 4 + ["b"] * 30
    assert periodic_runs.runs_of(periodic_runs.numbered(words)) == [(1, 2800, 700), (2801, 30, 1)]


def test_segments_are_split_until_stable():
    ids = np.array([1, 2, 3] * 10 + [9] + [4, 5] * 11 + [8, 7] * 2)  # the 22 words between rare ones are too few
    assert list(periodic_runs.segments(ids)) == [(0, 30)]
    assert list(periodic_runs.segments(np.zeros(23, np.int64))) == []


def test_rows_with_every_oddity(spark, odd, none):
    docs = odd.withColumns({"periodic": F.lit(1), "n_words": F.lit(2), "runs": F.lit(3)})
    extra = docs.filter("doc_id = 3").withColumn("text", F.lit(" ".join(["p"] + ["q r"] * 20 + ["s"])))
    docs = docs.unionByName(extra)
    out = periodic_runs.with_runs(docs)
    assert out.columns == [c for c in docs.columns if c != "periodic"] + ["periodic"]
    want = Counter()
    for r in docs.select("doc_id", "text", "n_words", "runs").collect():
        words = [w.decode() for w in (r["text"] or "").encode().split()]
        runs = all_runs(words) if len(words) < 2000 else []
        want[(r["doc_id"], 2, 3, len(words), tuple(runs), left(words, runs))] += 1
    got = Counter((r["doc_id"], r["n_words"], r["runs"], r["periodic"]["n_words"],
                   tuple(map(tuple, r["periodic"]["runs"])), r["periodic"]["text"]) for r in out.collect())
    assert got == want and sum(len(k[4]) > 0 for k in want) >= 2
    assert periodic_runs.with_runs(none).count() == 0


def test_query(spark, tmp_path):
    from arrearview.llm.queries import QUERIES

    rows = [(i, " ".join(repeating(i))) for i in range(-5, 300)] + [(None, "a " * 40), (7, None), (8, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = Counter()
    for d, t in rows:
        words = (t or "").split()
        h = zlib.crc32(str(d).encode()) if d is not None else 1
        if h % 10 == 0 and words:
            g, n = h // 10, len(words)
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        runs = all_runs(words)
        best = min(runs, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=(None, None, None))
        text = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        want[(d, len(runs), *best, runs and 1000 * best[1] // best[2] or None, hashlib.sha256(text.encode()).hexdigest(),
              hashlib.sha256(left(words, runs).encode()).hexdigest())] += 1
    out = QUERIES["op13_periodic_runs"](spark, str(tmp_path))
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256",
                           "collapsed_sha256"]
    assert Counter(map(tuple, out.collect())) == want
