import os
import sys

import pytest
from pyspark.sql import types as T

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(autouse=True)
def reachable(spark):
    spark.sparkContext.environment["PYTHONPATH"] = ROOT


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows with columns more than documents has, named like those the operators make."""
    from pyspark.sql import functions as F

    from fixtures import odd_rows

    df = spark.createDataFrame(odd_rows(), DOCS).repartition(3)
    return df.withColumns({"fp": F.lit(1), "repeats": F.lit("x"), "rules": F.lit("y"), "k1": F.lit(0), "h1": F.lit(2),
                           "words": F.lit("w"), "n": F.lit(3), "length": F.lit("l"), "start": F.lit(4)})


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)
