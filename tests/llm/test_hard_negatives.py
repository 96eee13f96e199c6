"""Hard negatives against a plain search over all pairs."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from arrearview.llm import hard_negatives

SCHEMA = "vec_id long, label int, embedding array<float>"


def plain(rows, step=100, k=5, m=10):
    good = {(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, lab, v in rows
            if None not in (i, lab, v) and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for a, la, va in good:
        if a % step:
            continue
        all_scores = sorted((-sum(x * y for x, y in zip(va, v)), i, lab) for i, lab, v in good if i != a)
        for p, pid, lab in [x for x in all_scores if x[2] == la][:k]:
            fits = [(-s, i) for s, i, lab in all_scores if lab != la and 30 * -p <= 100 * -s <= 90 * -p]
            for rank, (s, i) in enumerate(fits[:m], 1):
                out[(a, pid, rank, i, -p, s)] += 1
    return out


def vectors(seed, n, dim=8, spread=1.0):
    r = np.random.default_rng(seed)
    centre = r.normal(size=(6, dim))
    v = (centre[r.integers(0, 6, n)] + spread * r.normal(size=(n, dim))).astype(np.float32)
    return [(i, int(r.integers(0, 4)), x.tolist()) for i, x in enumerate(v * r.choice([0.2, 1, 3], (n, 1)))]


@pytest.mark.parametrize("seed, spread, block", [(1, 1.0, 8192), (2, 0.05, 8192), (3, 0.3, 7)])
def test_mined(spark, seed, spread, block):
    rows = vectors(seed, 700, spread=spread)
    got = hard_negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0, block=block).collect()
    assert Counter(map(tuple, got)) == plain(rows, step=10)


def odd_vectors():
    rows = vectors(4, 400)
    same = [0.5] * 8
    rows += [(i, 1, same) for i in range(1000, 1300)] + [(i, 2, same) for i in range(1300, 1320)]  # copies, ties
    rows += [(5000, None, same), (5100, 1, None), (5200, 1, [1.0, None] + same[2:]), (5300, 1, [math.nan] + same[1:]),
             (5400, 1, [math.inf] + same[1:]), (None, 1, same), (5500, 1, [0.0] * 8), (5600, 2, [-0.5] * 8),
             (5700, 3, [1.5, 2.5]), (5800, 3, []), (1100, 1, same), (100, 3, same)]  # short, empty, repeated rows and ids
    return rows + rows[:30]


def test_odd_rows(spark):
    rows = odd_vectors()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("id", "v", "length", "anchor", "part", "goals", "split", "copy")})
    got = hard_negatives.mined(df, F.col("id") % 100 == 0)
    want = plain([(i, lab, list(v) + [0.0] * (8 - len(v)) if v is not None else v) for i, lab, v in rows])
    assert Counter(map(tuple, got.collect())) == want and len(want) > 100
    assert hard_negatives.mined(df.filter("vec_id is null"), F.col("id") % 100 == 0).count() == 0
    assert hard_negatives.mined(df, F.col("id") < 0).columns == got.columns


def test_large_components(spark):
    rows = [(i, i % 2, [float(np.float32(x)) for x in v]) for i, v in enumerate(
        np.random.default_rng(0).normal(size=(60, 3)) * 2e5)]
    got = hard_negatives.mined(spark.createDataFrame(rows, SCHEMA), F.col("id") % 10 == 0).collect()
    assert Counter(map(tuple, got)) == plain(rows, step=10)


def test_ranges_prune_and_lose_nothing():
    r = np.random.default_rng(5)
    q, p = np.round(r.normal(size=(20, 16)) * 100), np.round(r.normal(size=(4000, 16)) * 100)
    q[:10] = p[:10]
    anchors = hard_negatives.Anchors(np.arange(20), np.arange(20), np.zeros(20), q, 3)
    bucket = hard_negatives.Bucket(np.arange(4000), np.zeros(4000), p)
    s = hard_negatives.scores(q, p)
    need = np.sort(s, axis=1)[:, -3].astype(float)
    found = list(anchors.search(np.arange(20), need, bucket))
    pairs = {(a, x) for of, rows, _ in found for a, x in zip(of.tolist(), rows.tolist())}
    assert pairs == set(zip(*(x.tolist() for x in np.nonzero(s >= need[:, None])))) and bucket.lists
    assert not list(anchors.search(np.arange(20), np.full(20, 1e9), bucket))


def test_query(spark, tmp_path):
    from arrearview.llm.queries import QUERIES

    rows = vectors(9, 900)
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = QUERIES["op12_hard_negatives"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == plain([(i, (lab + 1) % 10 if i % 7 == 0 else lab, v) for i, lab, v in rows])
