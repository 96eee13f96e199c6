"""Roll-ups of additive marts: sums first, ratios afterwards, for any dimensions and filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

VINTAGE_SUMS = {"n": "n_loans", "n_full": "n_observed_full", "k": "n_ever_30_plus",
                "k_nt": "n_ever_30_plus_no_threshold", "k_due": "n_ever_30_plus_due_only"}
DEFINITIONS = {"primary": "k", "no_threshold": "k_nt"}


def _sums(sums: dict[str, str]) -> list[Column]:
    return [F.sum(source).alias(name) for name, source in sums.items()]


def rollup(df: DataFrame, dims: list[str], sums: dict[str, str], where: Column | None = None) -> DataFrame:
    rows = df if where is None else df.where(where)
    return rows.groupBy(*dims).agg(*_sums(sums))


def rollup_levels(df: DataFrame, sets: list[list[str]], sums: dict[str, str]) -> DataFrame:
    """Several roll-ups in one job. Labels are never NULL, so a NULL dimension means "all"."""
    dims = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *dims).agg(*_sums(sums))


def vintage_cells(vintage: DataFrame, dims: list[str], mobs: tuple[int, ...] | None = None,
                  where: Column | None = None) -> DataFrame:
    rows = vintage if mobs is None else vintage.where(F.col("mob").isin(*mobs))
    return rollup(rows, ["mob", *dims], VINTAGE_SUMS, where)


def by_definition(cells: DataFrame, definitions: dict[str, str] = DEFINITIONS) -> DataFrame:
    """One row per definition of the event: column `k` becomes (definition, k)."""
    dims = [c for c in cells.columns if c not in ("k", "k_nt", "k_due", "k_due_raw")]
    pairs = ", ".join(f"'{name}', {column}" for name, column in definitions.items())
    return cells.select(*dims, F.expr(f"stack({len(definitions)}, {pairs}) as (definition, k)"))


def share_within(part: str, keys: list[str]) -> Column:
    """Share of a cell in the total of its group, over already grouped cells."""
    return F.col(part).cast("double") / F.nullif(
        F.sum(part).over(Window.partitionBy(*keys)).cast("double"), F.lit(0.0))


def densify(cells: DataFrame, axes: dict[str, tuple[str, ...]], counts: list[str]) -> DataFrame:
    """The full grid of labels on the given axes; absent cells get zero counts and observed = false."""
    grid = cells.sparkSession.range(1)
    for name, values in axes.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    # The grid has a fixed handful of rows, the cells are grouped by the same labels.
    joined = grid.drop("id").join(cells.withColumn("_seen", F.lit(True)), list(axes), "left")
    return joined.select(
        *axes, *[F.coalesce(F.col(c), F.lit(0)).alias(c) for c in counts],
        F.coalesce("_seen", F.lit(False)).alias("observed"))
