"""Profiling queries on the core tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from arrearview.params import Definitions


def status_distribution(panel: DataFrame) -> DataFrame:
    return panel.groupBy("source", "contract_status").agg(F.count("*").alias("n_rows")).orderBy(
        "source", F.desc("n_rows"))


def dpd_compare(panel: DataFrame, d: Definitions) -> DataFrame:
    raw, tolerant, limit = F.col("dpd_raw"), F.col("dpd_def"), d.past_due_days
    return panel.groupBy("source").agg(
        F.count("*").alias("n_rows"),
        F.count_if(raw > 0).alias("n_dpd_raw_positive"),
        F.count_if(tolerant > 0).alias("n_dpd_def_positive"),
        F.count_if(raw > limit).alias("n_dpd_raw_30_plus"),
        F.count_if(tolerant > limit).alias("n_dpd_def_30_plus"),
        F.count_if((raw > limit) & (tolerant <= limit)).alias("n_30_plus_only_in_raw"))


def bucket_share(fact: DataFrame) -> DataFrame:
    source = Window.partitionBy("source")
    return (
        fact.where("is_open").groupBy("source", "dpd_bucket").agg(F.count("*").alias("n_rows"))
        .withColumn("pct", F.round(F.lit(100.0).cast("double") * F.col("n_rows") / F.sum("n_rows").over(source), 2))
        .orderBy("source", "dpd_bucket"))


def end_state_profile(dim: DataFrame) -> DataFrame:
    """The median is exact: ages on book take at most as many values as the window has months."""
    return dim.groupBy("source", "end_state").agg(
        F.count("*").alias("n_loans"),
        F.count_if("is_left_truncated").alias("n_left_truncated"),
        F.min("first_open_month").alias("min_first_open_month"),
        F.percentile("max_mob", F.lit(0.5)).alias("median_max_mob"),
    ).orderBy("source", "end_state")


def stop_months(dim: DataFrame, top: int = 15) -> DataFrame:
    return (
        dim.where(F.col("end_state").isin("censored", "unknown"))
        .groupBy("last_observed_month", "end_state").agg(F.count("*").alias("n_loans"))
        .orderBy(F.desc("last_observed_month"), "end_state").limit(top))


def paid_at_first_month(fact: DataFrame, d: Definitions, top: int = 10) -> DataFrame:
    paid = (F.col("installments_total") - F.col("installments_remaining")).alias("installments_paid_at_mob0")
    return (
        fact.where((F.col("source") == d.instalment_source) & (F.col("mob") == 0))
        .groupBy(paid).agg(F.count("*").alias("n_loans"))
        .orderBy(F.desc("n_loans"), F.asc_nulls_last("installments_paid_at_mob0")).limit(top))


def payment_profile(payments: DataFrame) -> DataFrame:
    return payments.agg(
        F.count("*").alias("n_rows"),
        F.count_if(F.col("days_paid").isNull()).alias("n_null_days_paid"),
        F.count_if(F.col("payment_amount").isNull()).alias("n_null_payment"),
        F.count_if(F.col("payment_amount") == 0).alias("n_zero_payment"),
        F.countDistinct("installment_version").alias("n_versions"))
