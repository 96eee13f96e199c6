"""Many texts under one id are told apart."""

from fixtures import prose

from arrearview.llm import bwt_repeats, seed_extend

SCHEMA = "doc_id long, text string"


def rows_under_one_id():
    """1,000 texts of one id, of which those of even number also stand under a smaller id."""
    texts = [prose(500 + i, 40) for i in range(1000)]
    return [(1, t) for t in texts[::2]] + [(5, t) for t in texts] + [(5, texts[1])]


def test_seed_extend(spark):
    rows = rows_under_one_id()
    got = {}
    for r in seed_extend.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect():
        got.setdefault((r["doc_id"], r["repeats"]["n_removed"]), []).append(r["text"])
    assert sorted(got) == [(1, 0), (5, 0), (5, 40)] and len(got[5, 40]) == 500
    assert sorted(got[5, 0]) == sorted([t for i, t in rows[500:1500] if t not in {x for _, x in rows[:500]}] + [rows[-1][1]])


def test_byte_repeats(spark):
    rows = rows_under_one_id()
    twice = {t for _, t in rows[:500]} | {rows[-1][1]}
    sizes = {len(t): t for _, t in rows}
    gone = 0
    for r in bwt_repeats.without_repeats(spark.createDataFrame(rows, SCHEMA).repartition(6), length=150).collect():
        whole = r["n_removed"] == r["n_bytes"]
        assert whole or r["n_removed"] == 0 and bytes(r["bytes"]).decode() not in twice
        gone += whole
    assert gone == sum(t in twice and len(t) >= 150 for _, t in rows) > 900 and sizes
