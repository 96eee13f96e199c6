"""Feeds of the report pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.stats import sample_flags, share
from arrearview.operators.rollup import rollup, vintage_cells
from arrearview.params import Definitions
from arrearview.plans.cohorts import cohort_curve, smr_schemes
from arrearview.plans.portfolio import one_row


def footer_counts(dim: DataFrame, fact: DataFrame) -> DataFrame:
    return one_row(n_loans_total=dim.agg(F.count("*")), n_loan_months=fact.agg(F.count("*")))


def open_totals(snapshot: DataFrame) -> DataFrame:
    sums = rollup(snapshot, [], {
        "n_open": "n_loans", "n_30plus": "n_30_plus", "n_exp_known": "n_loans_exposure_known",
        "n_30plus_exp_known": "n_30_plus_exposure_known", "exposure_total": "exposure",
        "exposure_30plus": "exposure_30_plus"})
    return sums.withColumns({
        "rate_30plus_same_set": share(F.col("n_30plus_exp_known"), F.col("n_exp_known")),
        "exposure_rate_30plus": share(F.col("exposure_30plus"), F.col("exposure_total"))})


def bucket_totals(snapshot: DataFrame) -> DataFrame:
    return rollup(snapshot, ["dpd_bucket", "dpd_bucket_order"],
                  {"n_loans": "n_loans", "exposure": "exposure"}).orderBy("dpd_bucket_order")


def excluding(df: DataFrame, column: str, *values: str) -> DataFrame:
    """Rows whose value is not among the given ones; NULL stays."""
    return df.where(F.coalesce(~F.col(column).isin(*values), F.lit(True)))


def ranked_rates(snapshot: DataFrame, dim: str) -> DataFrame:
    """Past-due rate by one dimension, highest first, names breaking ties."""
    sums = rollup(snapshot, [dim], {"n_open": "n_loans", "n_30plus": "n_30_plus"})
    return sums.withColumn("rate_30plus", share(F.col("n_30plus"), F.col("n_open"))).orderBy(
        F.desc("rate_30plus"), dim)


def channel_product_at(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    rows = excluding(excluding(vintage, "contract_type", d.no_application), "channel_type", d.no_application)
    cells = vintage_cells(rows, ["channel_type", "contract_type"], (mob,))
    return cells.select("channel_type", "contract_type", F.col("n").alias("n_mob12"), F.col("k").alias("n_ever30"),
                        share(F.col("k"), F.col("n")).alias("rate"))


def applications_by_channel(funnel: DataFrame, d: Definitions) -> DataFrame:
    return rollup(excluding(funnel, "channel_type", d.no_application), ["channel_type"],
                  {"n_applications": "n_applications"})


def curves(vintage: DataFrame, dim: str, d: Definitions) -> DataFrame:
    """Curve by age for every value of one dimension."""
    cells = vintage_cells(excluding(vintage, dim, d.no_application), [dim])
    return cells.select(dim, "mob", F.col("n").alias("n_loans"), F.col("n_full").alias("n_observed_full"),
                        F.col("k").alias("n_ever30"), share(F.col("k"), F.col("n")).alias("rate")).orderBy(dim, "mob")


def ranked_smr(cells: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """Channels by ratio within product and cohort, those with few cases last."""
    rows = smr_schemes(cells, d).where(
        (F.col("mob") == mob) & (F.col("scheme") == "cut12") & (F.col("definition") == "primary"))
    return excluding(rows, "channel_type", d.no_application).select(
        "channel_type", "n", "observed", "expected", "oe", sample_flags("observed", "n", d).alias("flags"),
    ).orderBy("flags.few_cases", F.desc("oe.smr"))


def late_buckets(snapshot: DataFrame, d: Definitions) -> DataFrame:
    """The past-due tail only."""
    return bucket_totals(excluding(snapshot, "dpd_bucket", d.bucket_labels[0]))


def settled_curves(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Cohort curves without the youngest cohort, which has hardly any ages to show."""
    youngest = labels.cohort_label(labels.cohort_start(F.lit(d.last_month), d), d)
    return cohort_curve(vintage, d).where(F.col("origination_cohort") != youngest)


def comparable_cells(vintage: DataFrame, d: Definitions) -> DataFrame:
    return excluding(channel_product_at(vintage, d), "channel_type", d.small_channel_group)


def conformed_dimension(marts: list[DataFrame], column: str, name: str) -> DataFrame:
    """All values of a key over the marts, once each, sorted."""
    keys = [m.select(F.col(column).alias(name)).distinct() for m in marts]
    return reduce(DataFrame.union, keys).distinct().orderBy(name)


def selected(mart: DataFrame, channels: DataFrame | None = None, products: DataFrame | None = None) -> DataFrame:
    """A mart restricted to chosen rows of the conformed dimensions.

    The chosen rows come from a dimension with one row per label, the mart is the large side.
    """
    out = mart
    if channels is not None:
        out = out.join(channels.withColumnRenamed("channel", "channel_type"), "channel_type", "left_semi")
    if products is not None:
        out = out.join(products.withColumnRenamed("product", "contract_type"), "contract_type", "left_semi")
    return out


def selection_sizes(marts: dict[str, DataFrame], channels: DataFrame, products: DataFrame) -> DataFrame:
    """What chosen rows of the conformed dimensions leave of every mart."""
    def one(name: str, mart: DataFrame) -> DataFrame:
        size = next(c for c in ("n_loans", "n_applications") if c in mart.columns)
        return selected(mart, channels, products).agg(
            F.lit(name).alias("mart"), F.count("*").alias("n_rows"), F.sum(size).alias("n"))

    return reduce(DataFrame.union, [one(n, m) for n, m in marts.items()])
