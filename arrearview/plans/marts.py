"""Additive marts: counts first, rates from the counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.aggregates import exact_sum, grouped_median, money_sum
from arrearview.functions.stats import share
from arrearview.params import Definitions
from arrearview.plans import core

SEGMENTS = ["contract_type", "channel_type", "client_type", "yield_group"]
FUNNEL_KEYS = ["channel_type", "contract_type", "client_type", "yield_group"]


def deduplicated(application: DataFrame) -> DataFrame:
    return application.where(F.col("is_last_appl_per_contract") & F.col("is_last_appl_in_day"))


def application_amounts(application: DataFrame, d: Definitions) -> DataFrame:
    """The deduplicated applications as a histogram: segment, status and amount, with how many there are.

    `credit_total` is the decimal sum of the approved amounts, the same as amount times number.
    """
    approved = F.col("status") == "Approved"
    return deduplicated(application).select(
        *labels.segment_columns(d, names=FUNNEL_KEYS), F.col("application_status").alias("status"), "credit_amount"
    ).groupBy(*FUNNEL_KEYS, "status", "credit_amount").agg(
        F.count("*").alias("n"), money_sum(F.when(approved, F.col("credit_amount"))).alias("credit_total"))


def funnel_by_channel(amounts: DataFrame, keep: Callable[[DataFrame, str], DataFrame] | None = None) -> DataFrame:
    """Counts, sums and medians, all from the histogram of `application_amounts`; `keep` as for `grouped_median`."""
    def having(status: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("status") == status, F.col("n"))), F.lit(0).cast("long"))

    counts = amounts.groupBy(*FUNNEL_KEYS).agg(
        F.sum("n").alias("n_applications"),
        having("Approved").alias("n_approved"),
        having("Unused offer").alias("n_unused_offer"),
        having("Refused").alias("n_refused"),
        having("Canceled").alias("n_canceled"),
        exact_sum(F.col("credit_total")).alias("credit_amount_approved_total"),
    )
    medians = grouped_median(amounts.where("status = 'Approved'"), FUNNEL_KEYS, "credit_amount",
                             "credit_amount_approved_median", F.col("n"), keep)
    offered = F.col("n_approved") + F.col("n_unused_offer")
    decided = offered + F.col("n_refused")
    return counts.join(medians, FUNNEL_KEYS, "left").select(
        *counts.columns, "credit_amount_approved_median",
        offered.alias("n_offered"),
        decided.alias("n_decided"),
        share(offered, decided).alias("approval_rate"),
        share(F.col("n_approved"), offered).alias("take_up_rate"),
    )


def started(payments: DataFrame, d: Definitions) -> DataFrame:
    """Contracts with a first instalment; `first` is that of the original schedule, NULL where there is none.

    Payments fold to one row per contract and schedule version on the map side before anything is
    shuffled; the lowest version above zero is then picked among these.
    """
    per_version = (
        payments.where(F.col("installment_number") == 1)
        .groupBy("sk_id_prev", "installment_version")
        .agg(
            F.min("days_due").alias("days_due"),
            F.max("installment_amount").alias("installment_amount"),
            F.coalesce(exact_sum(F.when(F.col("days_late") <= d.grace_days, F.col("payment_amount"))),
                       F.lit(0.0)).alias("paid_in_grace"),
            F.max("days_late").alias("max_days_late"),
        )
    )
    version = F.col("installment_version")
    fields = F.struct("days_due", "installment_amount", "paid_in_grace", "max_days_late")
    return per_version.groupBy("sk_id_prev").agg(F.min_by(fields, F.when(version > 0, version)).alias("first"))


def first_instalment(payments: DataFrame, d: Definitions) -> DataFrame:
    """First instalment of the original schedule, one row per contract."""
    return started(payments, d).where("first is not null").select("sk_id_prev", "first.*")


def approved_without_instalment(payments: DataFrame, application: DataFrame) -> DataFrame:
    seen = payments.where(F.col("installment_number") == 1).select("sk_id_prev").distinct()
    approved = deduplicated(application).where(F.col("application_status") == "Approved")
    return approved.join(seen, "sk_id_prev", "left_anti")


def fpd_by_segment(payments: DataFrame, application: DataFrame, d: Definitions) -> DataFrame:
    """First-payment default and idle approvals: payments folded once, joined once with the applications.

    A row of the join is due (its first instalment has been due long enough), or idle (approved, and
    without any first instalment), or neither.
    """
    contracts = application.select(
        "sk_id_prev", *SEGMENTS, F.lit(True).alias("_found"), F.col("days_first_due").isNotNull().alias("_scheduled"),
        (F.col("is_last_appl_per_contract") & F.col("is_last_appl_in_day")
         & (F.col("application_status") == "Approved")).alias("_approved"))
    rows = started(payments, d).withColumn("_started", F.lit(True)).join(contracts, "sk_id_prev", "full")
    due = F.coalesce((F.col("first.days_due") <= -d.grace_days) & (F.col("first.installment_amount") > 0), F.lit(False))
    idle = F.col("_started").isNull() & F.coalesce("_approved", F.lit(False))
    unpaid = F.col("first.paid_in_grace") < F.col("first.installment_amount") * d.paid_tolerance
    labelled = rows.select(
        *labels.segment_columns(d, F.col("_found").isNotNull()), due.alias("due"), idle.alias("idle"), "_scheduled",
        unpaid.alias("unpaid"), (F.col("first.max_days_late") > d.grace_days).alias("late"))
    cells = labelled.where("due or idle").groupBy(*SEGMENTS).agg(
        F.count_if("due").alias("n_loans"),
        F.count_if(F.col("due") & F.col("unpaid")).alias("n_fpd30"),
        F.count_if(F.col("due") & F.col("late")).alias("n_fpd30_late_rule"),
        F.count_if(F.col("idle") & ~F.col("_scheduled")).alias("n_approved_not_activated"),
        F.count_if(F.col("idle") & F.col("_scheduled")).alias("n_approved_scheduled_no_installment"),
    )
    return cells.select(
        *SEGMENTS, "n_loans", "n_fpd30",
        share(F.col("n_fpd30"), F.col("n_loans")).alias("fpd30_rate"),
        "n_fpd30_late_rule",
        share(F.col("n_fpd30_late_rule"), F.col("n_loans")).alias("fpd30_late_rule_rate"),
        "n_approved_not_activated", "n_approved_scheduled_no_installment",
    )


def vintage(outcome: DataFrame, d: Definitions) -> DataFrame:
    """Ever past due by age on book, for every segment and origination cohort.

    Contracts are first folded into groups that share the segment, the last known age and the ages
    of first delay. Only these groups are spread over the ages 0 to 36, each with its weight, so
    the wide step does not grow with the number of contracts.
    """
    top = d.max_mob
    keys = ["source", *SEGMENTS, "tenor_group", "origination_cohort_start"]
    firsts = ["first_30_plus_mob", "first_30_plus_no_threshold_mob", "first_30_plus_due_only_mob"]
    seen = F.least(F.lit(top), F.col("max_mob"))
    last = F.when(F.col("end_state").isin(*d.closed_end_states), top).otherwise(seen)
    groups = (
        core.vintage_base(outcome)
        .select(
            "source", *labels.segment_columns(d, F.col("has_application")),
            labels.tenor_group(d).alias("tenor_group"),
            labels.cohort_start(F.col("first_open_month"), d).alias("origination_cohort_start"),
            seen.alias("seen"), last.alias("last"),
            *[F.when(F.col(c) <= top, F.col(c)).alias(c) for c in firsts],
        )
        .groupBy(*keys, "seen", "last", *firsts)
        .agg(F.count("*").alias("w"))
    )
    by_age = groups.withColumn("mob", F.explode(F.sequence(F.lit(0), F.col("last"))))

    def weight(flag: Column) -> Column:
        return F.sum(F.when(flag, F.col("w")).otherwise(0))

    def ever(first: str) -> Column:
        return weight(F.col(first) <= F.col("mob"))

    cells = by_age.groupBy(*keys, "mob").agg(
        F.sum("w").alias("n_loans"),
        weight(F.col("seen") >= F.col("mob")).alias("n_observed_full"),
        ever("first_30_plus_mob").alias("n_ever_30_plus"),
        ever("first_30_plus_no_threshold_mob").alias("n_ever_30_plus_no_threshold"),
        ever("first_30_plus_due_only_mob").alias("n_ever_30_plus_due_only"),
    )
    start = F.col("origination_cohort_start")
    return cells.select(
        "source", *SEGMENTS, "tenor_group",
        labels.cohort_label(start, d).alias("origination_cohort"), start, "mob",
        "n_loans", "n_observed_full",
        (F.col("n_loans") - F.col("n_observed_full")).alias("n_closed_early"),
        "n_ever_30_plus", "n_ever_30_plus_no_threshold", "n_ever_30_plus_due_only",
        share(F.col("n_ever_30_plus"), F.col("n_loans")).alias("ever_30_plus_rate"),
        share(F.col("n_ever_30_plus_no_threshold"), F.col("n_loans")).alias("ever_30_plus_rate_no_threshold"),
    )


def next_is_adjacent() -> Column:
    return F.col("next.months_balance") == F.col("months_balance") + 1


def transition_base(fact: DataFrame, dim: DataFrame, d: Definitions) -> DataFrame:
    """Everything that is counted over pairs of a contract's successive months, in one sorted pass over the fact.

    Origins are open months that could have a successor; they are filtered after the window, so "next" stays true. Cells
    hold the states of both delay definitions, the cohort, whether the very next month is open and without delay
    (`cured`), and whether the origin is the contract's first one in the first past-due bucket (`first_b1`). All counts
    and sums add up, so the transition matrices, the cures by cohort and the first cures are sums over these cells.
    """
    closed, other, missing = d.exit_states
    in_order = Window.partitionBy("sk_id_prev").orderBy("months_balance")
    nxt = F.lead(F.struct(
        "months_balance", "is_open", "is_closed", "dpd_bucket", "dpd_bucket_order", "dpd_bucket_no_threshold",
        "exposure_proxy")).over(in_order)
    origin = F.col("is_open") & (F.col("months_balance") < d.last_month)
    b1 = origin & (F.col("dpd_bucket_order") == 1)
    b1_so_far = F.count_if(b1).over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    adjacent = F.coalesce(next_is_adjacent(), F.lit(False))

    def target(bucket: str) -> Column:
        return (
            F.when(~adjacent, missing)
            .when(F.col("next.is_open"), F.col(f"next.{bucket}"))
            .when(F.col("next.is_closed"), closed)
            .otherwise(other)
        )

    contract = dim.select(
        "sk_id_prev", labels.cohort_start(F.col("first_open_month"), d).alias("cohort_start"),
        *labels.segment_columns(d, F.col("has_application"), ("contract_type", "channel_type")))
    months = fact.select(
        "sk_id_prev", "source", "months_balance", "dpd_bucket", "dpd_bucket_order", "dpd_bucket_no_threshold",
        "dpd_bucket_order_no_threshold", "exposure_proxy", origin.alias("is_origin"),
        F.coalesce(b1, F.lit(False)).alias("is_b1"), b1_so_far.alias("b1_so_far"), nxt.alias("next"))
    rows = months.where("is_origin").join(contract, "sk_id_prev").select(
        "source", "contract_type", "channel_type", "cohort_start",
        F.col("dpd_bucket").alias("b"), F.col("dpd_bucket_order").alias("o"), target("dpd_bucket").alias("t"),
        F.col("dpd_bucket_no_threshold").alias("b_nt"), F.col("dpd_bucket_order_no_threshold").alias("o_nt"),
        target("dpd_bucket_no_threshold").alias("t_nt"),
        F.coalesce(adjacent & F.col("next.is_open") & (F.col("next.dpd_bucket_order") == 0), F.lit(False)).alias("cured"),
        (F.col("is_b1") & (F.col("b1_so_far") == 1)).alias("first_b1"),
        F.coalesce(F.col("next.months_balance") > F.col("months_balance") + 1, F.lit(False)).alias("gap"),
        "exposure_proxy", F.when(adjacent, F.col("next.exposure_proxy")).alias("next_exposure"))
    keys = rows.columns[:rows.columns.index("gap")]
    return rows.groupBy(*keys).agg(
        F.count("*").alias("n"),
        F.count_if("gap").alias("n_gap"),
        F.count_if(F.col("exposure_proxy").isNull()).alias("n_null"),
        money_sum(F.col("exposure_proxy")).alias("e_from"),
        money_sum(F.col("next_exposure")).alias("e_to"),
    )


def transition_cells(base: DataFrame) -> DataFrame:
    """Transition counts of both delay definitions: the cells split by definition and summed again."""
    keys = ["source", "contract_type", "channel_type"]
    split = base.select(
        *keys, "n", "n_gap", "n_null", "e_from", "e_to",
        F.expr("stack(2, 'primary', b, o, t, 'no_threshold', b_nt, o_nt, t_nt) "
               "as (definition, from_state, from_order, to_state)"),
    )
    return split.groupBy("definition", *keys, "from_state", "from_order", "to_state").agg(
        F.sum("n").alias("n_loans"),
        F.sum("n_gap").alias("n_month_gap"),
        F.sum("n_null").alias("n_exposure_null"),
        F.coalesce(exact_sum(F.col("e_from")), F.lit(0.0)).alias("exposure_from"),
        F.coalesce(exact_sum(F.col("e_to")), F.lit(0.0)).alias("exposure_to"),
    )


def roll_matrix(base: DataFrame, d: Definitions) -> DataFrame:
    """Monthly transition matrix with row totals and shares; column `definition` tells the two apart."""
    row = Window.partitionBy("definition", "source", "contract_type", "channel_type", "from_state")
    n_from, e_from = F.sum("n_loans").over(row), F.sum("exposure_from").over(row)
    return transition_cells(base).select(
        "definition", "source", "contract_type", "channel_type", "from_state", "from_order", "to_state",
        labels.state_order(F.col("to_state"), d).alias("to_order"),
        "n_loans",
        n_from.alias("n_from"),
        share(F.col("n_loans"), n_from).alias("roll_rate"),
        "n_month_gap", "n_exposure_null",
        F.sum("n_exposure_null").over(row).alias("n_exposure_null_from"),
        "exposure_from",
        e_from.alias("exposure_from_total"),
        F.when(e_from > 0, F.col("exposure_from") / F.nullif(e_from, F.lit(0.0))).alias("exposure_roll_rate"),
        "exposure_to",
    )


def of_definition(roll: DataFrame, definition: str) -> DataFrame:
    return roll.where(F.col("definition") == definition).drop("definition")


def at_month(open_months: DataFrame, d: Definitions, month: int | None = None) -> DataFrame:
    """The open portfolio of one relative month; of the kept table, one partition."""
    return open_months.where(F.col("months_balance") == (d.last_month if month is None else month))


def portfolio_snapshot(open_months: DataFrame, d: Definitions, month: int | None = None) -> DataFrame:
    bad, bad_nt, amount = F.col("is_30_plus"), F.col("is_30_plus_no_threshold"), F.col("exposure_proxy")
    return at_month(open_months, d, month).groupBy(
        "contract_type", "channel_type", "dpd_bucket", "dpd_bucket_order"
    ).agg(
        F.count("*").alias("n_loans"),
        exact_sum(amount).alias("exposure"),
        F.count_if(bad).alias("n_30_plus"),
        exact_sum(F.when(bad, amount)).alias("exposure_30_plus"),
        F.count(amount).alias("n_loans_exposure_known"),
        F.count(F.when(bad, amount)).alias("n_30_plus_exposure_known"),
        F.count_if(bad_nt).alias("n_30_plus_no_threshold"),
        exact_sum(F.when(bad_nt, amount)).alias("exposure_30_plus_no_threshold"),
    )
