"""Comparisons between grouped cells.

All inputs are roll-ups with one row per label combination: a pair here is a pair of labels, never
of contracts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions.stats import mantel_haenszel, risk_ratio
from arrearview.params import Definitions


def _side(cells: DataFrame, keys: list[str], unit: str, name: str, mark: str) -> DataFrame:
    return cells.select(*keys, F.col(unit).alias(name), F.col("k").alias(f"k{mark}"), F.col("n").alias(f"n{mark}"))


def with_ratio(pairs: DataFrame, d: Definitions) -> DataFrame:
    return pairs.withColumn("rr", risk_ratio("k1", "n1", "k0", "n0", d))


def unordered_pairs(cells: DataFrame, keys: list[str], unit: str) -> DataFrame:
    """Cells of the same keys, two by two, first label before second."""
    a, b = _side(cells, keys, unit, "unit_a", "1"), _side(cells, keys, unit, "unit_b", "0")
    return a.join(b, keys).where(F.col("unit_a") < F.col("unit_b"))


def directed_pairs(cells: DataFrame, keys: list[str], unit: str, first: str, others: tuple[str, ...]) -> DataFrame:
    """One label against each of several others, within the keys."""
    a = _side(cells.where(F.col(unit) == first), keys, unit, "unit_a", "1")
    b = _side(cells.where(F.col(unit).isin(*others)), keys, unit, "unit_b", "0")
    return a.join(b, keys)


def against_base(cells: DataFrame, keys: list[str], unit: str, base: str) -> DataFrame:
    """Every label against one base label of the same keys."""
    b = _side(cells.where(F.col(unit) == base), keys, unit, "_base", "0").drop("_base")
    return _side(cells.where(F.col(unit) != base), keys, unit, unit, "1").join(b, keys)


def against_rest(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Every cell against all other cells of the same keys: the rest is the total less the cell."""
    group = Window.partitionBy(*keys)
    return (
        cells.withColumnRenamed("k", "k1").withColumnRenamed("n", "n1")
        .withColumn("k0", F.sum("k1").over(group) - F.col("k1"))
        .withColumn("n0", F.sum("n1").over(group) - F.col("n1"))
    )


def two_groups(cells: DataFrame, keys: list[str], flag: Column) -> DataFrame:
    """Cells with a true flag (suffix 1) beside those without (suffix 0); a NULL flag counts as false."""
    yes = F.coalesce(flag, F.lit(False))
    return cells.groupBy(*keys).agg(
        F.sum(F.when(yes, F.col("k"))).alias("k1"), F.sum(F.when(yes, F.col("n"))).alias("n1"),
        F.sum(F.when(~yes, F.col("k"))).alias("k0"), F.sum(F.when(~yes, F.col("n"))).alias("n0"),
    )


def pooled(pairs: DataFrame, keys: list[str], d: Definitions, comparable_only: bool = False) -> DataFrame:
    """Mantel-Haenszel ratio of the pairs over everything that is not a key."""
    rows = pairs
    if comparable_only:
        rows = pairs.where((F.col("n1") >= d.min_n) & (F.col("n0") >= d.min_n))
    return mantel_haenszel(rows, keys, d)
