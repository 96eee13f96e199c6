"""Totals and mixes of the whole book, and the open portfolio at one month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.aggregates import exact_sum
from arrearview.functions.stats import proportion, share
from arrearview.operators.rollup import rollup, rollup_levels
from arrearview.params import Definitions
from arrearview.plans.marts import at_month, deduplicated

SNAPSHOT_SUMS = {c: c for c in (
    "n_loans", "exposure", "n_30_plus", "exposure_30_plus", "n_loans_exposure_known", "n_30_plus_exposure_known",
    "n_30_plus_no_threshold", "exposure_30_plus_no_threshold")}


def one_row(**parts: DataFrame) -> DataFrame:
    """One row out of one-row aggregates, each a scalar subquery named by its keyword."""
    spark = next(iter(parts.values())).sparkSession
    return spark.range(1).select(*[df.scalar().alias(name) for name, df in parts.items()])


def totals(dim: DataFrame, fact: DataFrame, application: DataFrame, d: Definitions) -> DataFrame:
    """Nine totals from one aggregate per table."""
    loans = dim.agg(F.struct(
        F.count("*").alias("n_loans"),
        F.count_if(F.col("source") == d.instalment_source).alias("n_loans_installment"),
        F.count_if(F.col("source") == d.card_source).alias("n_loans_card"),
        F.count_if(~F.col("has_application")).alias("n_loans_no_application")).alias("t"))
    months = fact.agg(F.struct(
        F.count("*").alias("n_loan_months"),
        F.min("months_balance").alias("first_month"),
        F.max("months_balance").alias("last_month")).alias("t"))
    apps = deduplicated(application).agg(F.struct(
        F.count("*").alias("n_applications_dedup"),
        F.count_if(F.col("application_status") == "Approved").alias("n_approved_dedup")).alias("t"))
    return one_row(l=loans, m=months, a=apps).select(
        "l.n_loans", "l.n_loans_installment", "l.n_loans_card", "l.n_loans_no_application", "m.n_loan_months",
        "a.n_applications_dedup", "a.n_approved_dedup", "m.first_month", "m.last_month")


def end_state_mix(dim: DataFrame) -> DataFrame:
    return dim.groupBy("end_state").agg(
        F.count("*").alias("n_loans"), F.count_if(~F.col("is_partial_history")).alias("n_not_partial"))


def product_mix(dim: DataFrame, d: Definitions) -> DataFrame:
    product = labels.segment_columns(d, F.col("has_application"), ("contract_type",))
    return dim.select(*product).groupBy("contract_type").agg(F.count("*").alias("n_loans"))


def vintage_base_counts(dim: DataFrame) -> DataFrame:
    never = F.col("end_state") == "never_open"
    return dim.agg(
        F.count("*").alias("n_eligible"),
        F.count_if("is_partial_history").alias("n_partial_history"),
        F.count_if(never).alias("n_never_open"),
        F.count_if(~never & ~F.col("is_partial_history")).alias("n_vintage_base"))


def snapshot_buckets(snapshot: DataFrame, open_months: DataFrame, d: Definitions) -> DataFrame:
    """Bucket mix of the open portfolio by both delay definitions, as shares of one open total."""
    primary = rollup(snapshot, ["dpd_bucket", "dpd_bucket_order"], {"n_loans": "n_loans", "exposure": "exposure"})
    bare = (
        at_month(open_months, d)
        .groupBy(F.col("dpd_bucket_no_threshold").alias("dpd_bucket"),
                 F.col("dpd_bucket_order_no_threshold").alias("dpd_bucket_order"))
        .agg(F.count("*").alias("n_loans"), exact_sum(F.col("exposure_proxy")).alias("exposure"))
    )
    both = (primary.withColumn("definition", F.lit("primary"))
            .unionByName(bare.withColumn("definition", F.lit("no_threshold"))))
    n_open = snapshot.agg(F.sum("n_loans")).scalar()
    return both.withColumn("n_open", n_open).withColumn("share", proportion("n_loans", "n_open", d))


def kpi_same_set(snapshot: DataFrame, d: Definitions) -> DataFrame:
    """Past-due rate by contracts and by exposure on one common set, with and without unknown contracts."""
    named = F.col("channel_type") != d.no_application
    scopes = F.array(F.lit("exposure_known_set"), F.when(named, F.lit("excluding_unknown")))
    sums = (
        snapshot.withColumn("scope", F.explode(scopes)).where(F.col("scope").isNotNull())
        .groupBy("scope").agg(*[F.sum(c).alias(c) for c in SNAPSHOT_SUMS])
    )
    bad, bad_nt = F.coalesce("exposure_30_plus", F.lit(0.0)), F.coalesce("exposure_30_plus_no_threshold", F.lit(0.0))
    return sums.select(
        "scope", "n_loans", "n_30_plus", "n_loans_exposure_known", "n_30_plus_exposure_known",
        "n_30_plus_no_threshold",
        proportion("n_30_plus", "n_loans", d).alias("all_open"),
        proportion("n_30_plus_exposure_known", "n_loans_exposure_known", d).alias("exposure_known"),
        share(bad, F.col("exposure")).alias("exposure_share"),
        F.col("exposure").alias("exposure_total"), "exposure_30_plus",
        (F.col("n_loans") - F.col("n_loans_exposure_known")).alias("n_loans_exposure_unknown"),
        proportion("n_30_plus_no_threshold", "n_loans", d).alias("no_threshold"),
        share(bad_nt, F.col("exposure")).alias("exposure_share_no_threshold"))


def unknown_share(snapshot: DataFrame, d: Definitions) -> DataFrame:
    """Share of contracts without application in the open book and among its past-due part."""
    unknown = F.col("channel_type") == d.no_application

    def of(column: str):
        return F.coalesce(F.sum(F.when(unknown, F.col(column))), F.lit(0)), F.sum(column)

    def named(column: str, name: str):
        k, n = of(column)
        return [k.alias(f"k_{name}"), n.alias(f"n_{name}")]

    sums = snapshot.agg(
        *named("n_loans", "open"), *named("n_30_plus", "30_plus"),
        *named("n_30_plus_no_threshold", "30_plus_no_threshold"),
        of("n_loans_exposure_known")[0].alias("n_with_exposure"))
    names = ("open", "30_plus", "30_plus_no_threshold")
    return sums.select(*sums.columns, *[proportion(f"k_{x}", f"n_{x}", d).alias(x) for x in names])


def snapshot_levels(snapshot: DataFrame, d: Definitions) -> DataFrame:
    """Past-due rates by product, by channel and by both, in one job."""
    sums = {"n": "n_loans", "k": "n_30_plus", "k_nt": "n_30_plus_no_threshold"}
    sets = [["contract_type"], ["channel_type"], ["contract_type", "channel_type"]]
    n = "n"
    return rollup_levels(snapshot, sets, sums).select(
        "contract_type", "channel_type", "n", "k", "k_nt",
        proportion("k", n, d).alias("primary"), proportion("k_nt", n, d).alias("no_threshold"))


def snapshot_by_source(open_months: DataFrame, d: Definitions, month: int) -> DataFrame:
    """Past-due share by count and by exposure for each source, at any month."""
    bad, amount = F.col("is_30_plus"), F.col("exposure_proxy")
    return at_month(open_months, d, month).groupBy("source").agg(
        F.count("*").alias("n_open"), F.count_if(bad).alias("n_30_plus"),
        exact_sum(amount).alias("exposure"), exact_sum(F.when(bad, amount)).alias("exposure_30_plus"),
    ).select(
        "source", "n_open", "n_30_plus", share(F.col("n_30_plus"), F.col("n_open")).alias("rate"),
        "exposure", "exposure_30_plus",
        share(F.coalesce("exposure_30_plus", F.lit(0.0)), F.col("exposure")).alias("exposure_rate"))


def exposure_missing(open_months: DataFrame, d: Definitions) -> DataFrame:
    """Open contracts whose exposure is not known."""
    bad, unknown = F.col("is_30_plus"), ~F.col("has_application")
    return at_month(open_months, d).where(F.col("exposure_proxy").isNull()).agg(
        F.count("*").alias("n_contracts"), F.count_if(bad).alias("n_30_plus"),
        F.count_if(unknown).alias("n_contracts_unknown_group"),
        F.count_if(bad & unknown).alias("n_30_plus_unknown_group"))
