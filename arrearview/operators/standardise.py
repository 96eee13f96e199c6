"""Indirect standardisation: what a unit would show at the rates of its strata."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions.stats import observed_over_expected, proportion
from arrearview.params import Definitions


def with_expected(cells: DataFrame, strata: list[str], observed: str = "k", base: str = "n") -> DataFrame:
    """Expected events of each cell at the pooled rate of its stratum, over all given units."""
    pool = Window.partitionBy(*strata)
    rate = F.sum(observed).over(pool).cast("double") / F.nullif(F.sum(base).over(pool).cast("double"), F.lit(0.0))
    return cells.withColumn("expected", F.coalesce(F.col(base) * rate, F.lit(0.0)))


def standardise(cells: DataFrame, unit: list[str], strata: list[str], d: Definitions,
                observed: str = "k", base: str = "n") -> DataFrame:
    """Observed, expected, their ratio with Byar's interval, and the crude rate, per unit."""
    return (
        with_expected(cells, strata, observed, base)
        .groupBy(*unit)
        .agg(F.sum(base).alias("n"), F.sum(observed).alias("observed"), F.sum("expected").alias("expected"))
        .withColumn("oe", observed_over_expected("observed", "expected", d))
        .withColumn("crude", proportion("observed", "n", d))
    )
