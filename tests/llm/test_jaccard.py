"""The near-duplicate stage of the pipeline against a brute-force comparison of all pairs."""

import random

import pytest
from fixtures import prose
from test_operators import bag, rows_of

from arrearview.llm import jaccard


def sets(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def groups(rows, least=0.8):
    """The least doc_id reachable from each text, by comparing all pairs."""
    own = sorted({s for _, s in rows}, key=sorted)
    near = {s: [t for t in own if s == t or (s and t and len(s & t) >= least * len(s | t))] for s in own}
    ids, name = {s: min((d for d, t in rows if t == s and d is not None), default=None) for s in own}, {}
    for s in own:
        reach, todo = {s}, [s]
        while todo:
            more = [t for t in near[todo.pop()] if t not in reach]
            reach.update(more)
            todo += more
        name[s] = min((ids[t] for t in reach if ids[t] is not None), default=None)
    return [(d, name[s]) for d, s in rows]


def changed(text, n, r):
    w = text.split()
    for i in r.sample(range(len(w)), n):
        w[i] = f"x{r.randrange(10 ** 6)}"
    return " ".join(w)


@pytest.mark.parametrize("hot", [32, 3])
def test_near_duplicates(spark, odd, hot):
    """Copies on both sides of the threshold; with a small `hot`, families go through leaders."""
    r, rows = random.Random(3), rows_of(odd)
    for k in range(8):
        base = prose(100 + k, 150)
        rows += [(1000 + 50 * k + i, changed(base, i % 9, r)) for i in range(14)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(x["doc_id"], x["component_id"]) for x in jaccard.near_duplicates(docs, hot=hot).collect()]
    assert bag(got) == bag(groups([(d, sets(t)) for d, t in rows]))


def test_simhash_gives_candidates(spark):
    """Near copies that share no MinHash band are found by their fingerprints, and compared before they link."""
    base, r = prose(7, 400), random.Random(5)
    texts = [base, changed(base, 3, r), prose(8, 400)]
    rows = [(i, jaccard.simhash.fingerprint(base, 5) ^ (1 << i), [3 * i, 3 * i + 1], t) for i, t in enumerate(texts)]
    nodes = spark.createDataFrame(rows, "node long, fp long, bands array<long>, text string")
    found = jaccard.links(nodes, lambda wanted: nodes.join(wanted, "node").select("node", "text"))
    assert len(sets(texts[0]) & sets(texts[1])) >= 0.8 * len(sets(texts[0]) | sets(texts[1]))
    assert [tuple(x) for x in found.collect()] == [(0, 1)]


def test_rows_carry_the_simhash_of_their_shingles(spark):
    text = prose(9, 300)
    docs = spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")
    got = {x["doc_id"]: x["fp"] for x in jaccard._rows(docs, 5).collect()}
    assert got == {1: jaccard.simhash.majority(jaccard.shingles(text)), 2: 0}


def test_stage_takes_near_copies(spark):
    """One word in fifty: a similarity of about 0.82."""
    import corpus_pipeline

    r = random.Random(4)
    rows = [(i, prose(i, 100)) for i in range(20)]
    rows += [(100 + i, changed(t, 2, r)) for i, t in rows]
    rows = [(i, t) for i, t in rows if i < 100 or len(sets(t) & sets(rows[i - 100][1])) >= 0.8 * len(
        sets(t) | sets(rows[i - 100][1]))]
    assert len(rows) > 30
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, "").collect()} == set(range(20))
