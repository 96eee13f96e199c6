"""Aggregates shared by the plans."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Ten decimals and 28 digits before them. Amounts are cut below 1e-10, and totals of 1e28 or more stop the query: both
# are far from any sum of money.
MONEY = "decimal(38,10)"


def money_sum(amount: Column) -> Column:
    """Sum of money as a decimal: does not depend on the order of the rows, and can be summed on without loss."""
    return F.sum(amount.cast(MONEY))


def exact_sum(amount: Column) -> Column:
    """`money_sum` for the last level of a result."""
    return money_sum(amount).cast("double")


def value_at_last(value: Column, order: Column) -> Column:
    """The last non-NULL value along `order`."""
    return F.max_by(value, F.when(value.isNotNull(), order))


def value_at_first(value: Column, order: Column) -> Column:
    """The first non-NULL value along `order`."""
    return F.min_by(value, F.when(value.isNotNull(), order))


#: Parts that a bin is split into when it holds too many values for one task.
SPLIT = 1024


def _middle_bins(rows: DataFrame, keys: list[str], first: Column, n: Column) -> DataFrame:
    """The one or two bins of each group that hold its middle ranks, with the rank before them and their values.

    `first` is the rank before the group's first bin, `n` the group's number of rows, both of them per group.
    """
    upto = Window.partitionBy(*keys).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    return (
        rows.groupBy(*keys, "_bin").agg(F.sum("_c").alias("_binc"), F.count("*").alias("_values"),
                                        first.alias("_first"), n.alias("_given"))
        .withColumn("_n", F.coalesce("_given", F.sum("_binc").over(Window.partitionBy(*keys))))
        .withColumn("_before", F.col("_first") + F.coalesce(F.sum("_binc").over(upto), F.lit(0)))
        .withColumn("_low", F.floor((F.col("_n") - 1) / 2))
        .withColumn("_high", F.floor(F.col("_n") / 2))
        .where((F.col("_before") <= F.col("_high")) & (F.col("_before") + F.col("_binc") > F.col("_low")))
        .select(*keys, "_bin", "_values", "_n", "_before", "_low", "_high")
    )


def _split_bins(rows: DataFrame, middle: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of the middle bins alone, each bin split into equal parts between its least and its largest value."""
    of_group = Window.partitionBy(*keys)
    sides = middle.select(
        *keys, "_bin", "_n", F.min("_before").over(of_group).alias("_first"),
        (F.row_number().over(of_group.orderBy("_bin")) - 1).alias("_side"))
    inside = rows.select(*keys, "_bin", "_v", "_c").join(sides, [*keys, "_bin"])
    ends = inside.groupBy(*keys, "_bin").agg(F.min("_v").alias("_min"), F.max("_v").alias("_max"))
    part = F.floor((F.col("_v") - F.col("_min")) / F.nullif(F.col("_max") - F.col("_min"), F.lit(0.0)) * (SPLIT - 1))
    return inside.join(ends, [*keys, "_bin"]).select(
        *keys, "_v", "_c", "_n", "_first", (F.col("_side") * SPLIT + F.coalesce(part, F.lit(0))).cast("int").alias("_bin"))


def grouped_median(df: DataFrame, keys: list[str], value: str, name: str, weight: Column | None = None,
                   keep: Callable[[DataFrame, str], DataFrame] | None = None, fits: int = 1_000_000) -> DataFrame:
    """Exact interpolated median per group, without gathering a group in one task.

    Rows are first folded into a histogram (combined on the map side). Bins of equal relative width
    (1024 to each power of two, over the whole range of a double) locate the one or two bins that
    hold the middle ranks; only those bins are ordered value by value. NULL and NaN are no values
    and are left out; infinities count. `keys` must not be NULL. A row counts `weight` times, if given.

    With `keep`, which writes a table under a name and reads it back, a middle bin of more than `fits`
    distinct values is split again and again until none is left, so what one task orders is bounded,
    however close the values lie. Without it the plan stays lazy, and a bin is ordered as it is.
    """
    v = F.col(value).cast("double")
    size = F.abs(F.col("_v"))
    exponent = F.least(F.log2(F.nullif(size, F.lit(0.0))), F.lit(1025.0))  # above -1075 for any double
    rows = (
        df.where(v.isNotNull() & ~F.isnan(v))
        .groupBy(*keys, v.alias("_v"))
        .agg((F.count("*") if weight is None else F.sum(weight)).alias("_c"))
        .withColumn("_bin", (F.signum("_v") * F.coalesce(F.floor((exponent + 1076) * 1024), F.lit(0))).cast("int"))
    )
    middle = _middle_bins(rows, keys, F.lit(0), F.lit(None).cast("long"))
    if keep is not None:
        middle, step = keep(middle, f"{name}_bins"), 0
        while (middle.agg(F.max("_values")).first()[0] or 0) > fits:
            step += 1
            rows = keep(_split_bins(rows, middle, keys), f"{name}_rows_{step}")
            middle = keep(_middle_bins(rows, keys, F.min("_first"), F.min("_n")), f"{name}_bins_{step}")
        rows = rows.select(*keys, "_bin", "_v", "_c")
    inside = Window.partitionBy(*keys, "_bin").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(middle, [*keys, "_bin"]).withColumn("_end", F.col("_before") + F.sum("_c").over(inside))
    low = F.min(F.when(F.col("_end") > F.col("_low"), F.col("_v")))
    high = F.min(F.when(F.col("_end") > F.col("_high"), F.col("_v")))
    return placed.groupBy(*keys).agg((low + (high - low) * 0.5).alias(name))
