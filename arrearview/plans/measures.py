"""Measures: ratios of sums over whatever rows remain, for any dimensions and filter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.stats import share
from arrearview.operators import pairs
from arrearview.operators.rollup import VINTAGE_SUMS, by_definition, rollup, vintage_cells
from arrearview.operators.standardise import standardise
from arrearview.params import Definitions


def vintage_measures(vintage: DataFrame, dims: list[str], where: Column | None = None, mob: int = 12) -> DataFrame:
    """Loans and cases over the kept ages, and pinned at one age for three definitions."""
    rows = vintage if where is None else vintage.where(where)
    pinned = F.col("mob") == mob

    def at(column: str) -> Column:
        return F.sum(F.when(pinned, F.col(column)))

    sums = rows.groupBy(*dims).agg(
        F.sum("n_loans").alias("vintage_loans"), F.sum("n_ever_30_plus").alias("ever_30_plus_loans"),
        at("n_loans").alias("loans_mob12"), at("n_ever_30_plus").alias("cases_mob12"),
        at("n_ever_30_plus_no_threshold").alias("_nt"), at("n_ever_30_plus_due_only").alias("_due"))
    n12 = F.col("loans_mob12")
    return sums.select(
        *dims, "vintage_loans", "ever_30_plus_loans",
        share(F.col("ever_30_plus_loans"), F.col("vintage_loans")).alias("ever_30_plus_rate"),
        "cases_mob12", "loans_mob12", share(F.col("cases_mob12"), n12).alias("rate_mob12"),
        share(F.col("_nt"), n12).alias("rate_mob12_no_threshold"), share(F.col("_due"), n12).alias("rate_mob12_due_only"))


def smr_measures(vintage: DataFrame, d: Definitions, by_cohort: bool, mob: int = 12) -> DataFrame:
    """Observed, expected and ratio per channel; reference rates ignore the channel."""
    strata = ["contract_type"] + (["origination_cohort_start"] if by_cohort else [])
    cells = vintage_cells(vintage, ["channel_type", *strata], (mob,), labels.is_labelled_product(d))
    return standardise(cells, ["channel_type"], strata, d).select(
        "channel_type", "observed", "expected", "oe",
        F.when(F.col("observed") < d.few_cases, "too few cases").alias("note"))


def ratio_vs_base(vintage: DataFrame, d: Definitions, mob: int = 12) -> DataFrame:
    """Products against the base product: crude by three definitions, and pooled over cohorts."""
    labelled = labels.is_labelled_product(d)
    keys = ["mob", "definition"]
    crude = pairs.against_base(
        by_definition(vintage_cells(vintage, ["contract_type"], (mob,), labelled),
                      {"crude": "k", "due_only": "k_due", "no_threshold": "k_nt"}),
        keys, "contract_type", d.base_product)
    one = share(F.col("k1"), F.col("n1")) / F.nullif(share(F.col("k0"), F.col("n0")), F.lit(0.0))
    wide = crude.withColumn("r", one).groupBy("contract_type").pivot(
        "definition", ["crude", "due_only", "no_threshold"]).agg(F.max("r"))
    cells = by_definition(
        vintage_cells(vintage, ["contract_type", "origination_cohort_start"], (mob,), labelled), {"primary": "k"})
    sides = pairs.against_base(cells, ["definition", "origination_cohort_start"], "contract_type", d.base_product)
    pooled = pairs.pooled(sides, ["contract_type"], d).select("contract_type", F.col("ratio").alias("mh_cohort"))
    return wide.join(pooled, "contract_type")


def cohort_rate(vintage: DataFrame, d: Definitions) -> DataFrame:
    """Rate by cohort and age, empty where the cohort is not old enough."""
    start = F.col("origination_cohort_start")
    cells = rollup(vintage, ["origination_cohort", "origination_cohort_start", "mob"], VINTAGE_SUMS)
    old_enough = start + (d.cohort_width - 1) <= d.last_month - F.col("mob")
    return cells.select("origination_cohort", start, "mob", "n", "k",
                        F.when(old_enough, share(F.col("k"), F.col("n"))).alias("rate"))


def funnel_measures(funnel: DataFrame, d: Definitions, consumer: str = "Consumer loans") -> DataFrame:
    """Approval and take-up per channel, with the standardised ratio and consumer-only take-up."""
    is_consumer = F.col("contract_type") == consumer
    sums = funnel.groupBy("channel_type").agg(
        F.sum("n_applications").alias("applications"), F.sum("n_decided").alias("decided"),
        F.sum("n_offered").alias("offered"), F.sum("n_approved").alias("_approved"),
        F.sum(F.when(is_consumer, F.col("n_approved"))).alias("_ca"),
        F.sum(F.when(is_consumer, F.col("n_offered"))).alias("_co"),
        F.sum("credit_amount_approved_total").alias("credit_approved"))
    cells = rollup(funnel, ["channel_type", "contract_type"], {"n": "n_decided", "k": "n_offered"})
    expected = standardise(cells, ["channel_type"], ["contract_type"], d).select("channel_type", "expected")
    return sums.join(expected, "channel_type").select(
        "channel_type", "applications", "decided", "offered",
        share(F.col("offered"), F.col("decided")).alias("approval_rate"),
        F.col("expected").alias("approval_expected"),
        share(F.col("offered"), F.col("expected")).alias("approval_standardised_ratio"),
        share(F.col("_approved"), F.col("offered")).alias("take_up_rate"),
        share(F.col("_ca"), F.col("_co")).alias("take_up_rate_consumer"), "credit_approved")


def fpd_measures(fpd: DataFrame, dims: list[str]) -> DataFrame:
    sums = rollup(fpd, dims, {"base_loans": "n_loans", "fpd30_loans": "n_fpd30",
                              "approved_not_activated": "n_approved_not_activated"})
    return sums.withColumn("fpd30_rate", share(F.col("fpd30_loans"), F.col("base_loans")))


def roll_measures(roll: DataFrame, d: Definitions, dims: list[str]) -> DataFrame:
    """Counts, base (any target state), rate and exposure per origin and target; cure on past-due origins."""
    current = d.bucket_labels[0]
    cells = rollup(roll.where("definition = 'primary'"), [*dims, "from_state", "to_state"],
                   {"roll_loans": "n_loans", "exposure_from": "exposure_from"})
    origin = Window.partitionBy(*dims, "from_state")
    base = F.sum("roll_loans").over(origin)
    cured = F.coalesce(F.sum(F.when(F.col("to_state") == current, F.col("roll_loans"))).over(origin), F.lit(0))
    return cells.select(
        *dims, "from_state", "to_state", "roll_loans", base.alias("roll_base_loans"),
        share(F.col("roll_loans"), base).alias("roll_rate"),
        F.when(F.col("from_state") != current, share(cured, base)).alias("cure_rate"), "exposure_from")


def snapshot_measures(snapshot: DataFrame, dims: list[str]) -> DataFrame:
    sums = rollup(snapshot, dims, {
        "open_loans": "n_loans", "loans_30": "n_30_plus", "loans_exposure_known": "n_loans_exposure_known",
        "loans_30_exposure_known": "n_30_plus_exposure_known", "open_exposure": "exposure",
        "exposure_30": "exposure_30_plus", "_nt": "n_30_plus_no_threshold", "_ent": "exposure_30_plus_no_threshold"})
    rate = {"rate_30": ("loans_30", "open_loans"),
            "rate_30_exposure_known": ("loans_30_exposure_known", "loans_exposure_known"),
            "exposure_rate_30": ("exposure_30", "open_exposure"), "rate_30_no_threshold": ("_nt", "open_loans"),
            "exposure_rate_30_no_threshold": ("_ent", "open_exposure")}
    return sums.withColumns({k: share(F.col(a), F.col(b)) for k, (a, b) in rate.items()}).drop("_nt", "_ent")
