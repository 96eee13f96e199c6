"""Files that leave the loan book: mart CSV, findings JSON, and the typed way back in."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str) -> None:
    """Rows in total order over all columns, header in every part file.

    The sort is a range partitioning: parts follow each other in order, and a small mart ends up
    in one file because adaptive execution joins small partitions.
    """
    (df.orderBy(*[F.asc_nulls_last(c) for c in df.columns])
     .write.mode("overwrite").option("header", True).option("encoding", "UTF-8").csv(path))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("encoding", "UTF-8")
            .option("enforceSchema", False).csv(path))


def write_findings(findings: DataFrame, path: str) -> None:
    """One JSON object per line, in a fixed order; NULL fields are kept."""
    keys = [F.col("section"), F.col("mob").asc_nulls_first(), F.to_json(F.col("dims")), F.col("measure")]
    findings.orderBy(*keys).write.mode("overwrite").option("ignoreNullFields", False).json(path)


FINDINGS_SCHEMA = "section STRING, mob INT, dims MAP<STRING, STRING>, measure STRING, value DOUBLE, text STRING"


def read_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FINDINGS_SCHEMA).json(path)
