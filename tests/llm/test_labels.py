"""Which labels of the co-training say something."""

from arrearview.llm import cotraining


def test_toxic_labels_without_a_quality_are_bad(spark):
    rows = [(1, None, 1), (2, None, 0), (3, None, None), (4, 1, 0), (5, 1, None), (6, 0, None), (7, 1, 1), (8, 1, 0),
            (8, None, 1), (None, None, 1)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
    got = {r["_id"]: r["_good"] for r in cotraining.label_sample(labels, 100).collect()}
    assert got == {1: 0, 4: 1, 5: 1, 6: 0, 7: 0, 8: 0}
