"""Approval and first-payment analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.functions.stats import proportion, share
from arrearview.operators.rollup import rollup, rollup_levels
from arrearview.operators.standardise import standardise
from arrearview.params import Definitions

FUNNEL_SUMS = {"n_app": "n_applications", "n_dec": "n_decided", "n_off": "n_offered", "n_appr": "n_approved",
               "n_unused": "n_unused_offer", "n_ref": "n_refused"}


def approval_levels(funnel: DataFrame, d: Definitions) -> DataFrame:
    """Approval and take-up by product, and by product and channel."""
    cells = rollup_levels(funnel, [["contract_type"], ["contract_type", "channel_type"]], FUNNEL_SUMS)
    return cells.select(
        "contract_type", "channel_type", "n_app", "n_dec", "n_off", "n_appr", "n_unused",
        proportion("n_off", "n_dec", d).alias("approval"),
        proportion("n_appr", "n_off", d).alias("take_up"))


def approval_standardised(funnel: DataFrame, d: Definitions) -> DataFrame:
    """Offers of a channel over those expected at the approval rates of its products."""
    cells = rollup(funnel, ["contract_type", "channel_type"], FUNNEL_SUMS)
    out = standardise(cells, ["channel_type"], ["contract_type"], d, observed="n_off", base="n_dec")
    return out.select(
        "channel_type", F.col("n").alias("n_decided"), "observed", "expected", "crude",
        F.col("oe.smr").alias("standardised_ratio"),
        share(F.col("expected"), F.col("n")).alias("expected_rate"))


def take_up(funnel: DataFrame, d: Definitions, product: str = "Consumer loans") -> DataFrame:
    cells = rollup(funnel, ["channel_type"], FUNNEL_SUMS, F.col("contract_type") == product)
    return cells.select("channel_type", "n_appr", "n_off",
                        proportion("n_appr", "n_off", d).alias("take_up"))


def fpd_levels(fpd: DataFrame, d: Definitions) -> DataFrame:
    """First-payment default in total, by product, and by product and channel with a base."""
    sums = {"n": "n_loans", "k": "n_fpd30", "k_late": "n_fpd30_late_rule", "n_idle": "n_approved_not_activated",
            "n_scheduled": "n_approved_scheduled_no_installment"}
    cells = rollup_levels(fpd, [[], ["contract_type"], ["contract_type", "channel_type"]], sums)
    kept = cells.where(F.col("channel_type").isNull() | (F.col("n") > 0))
    n = "n"
    return kept.select("contract_type", "channel_type", *sums,
                       proportion("k", n, d).alias("amount_rule"),
                       proportion("k_late", n, d).alias("late_rule"))
