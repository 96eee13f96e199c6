"""Core tables: contract-month panel, contract dimension, monthly fact, contract outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.functions import labels
from arrearview.functions.aggregates import value_at_first, value_at_last
from arrearview.params import Definitions

PANEL_COLUMNS = (
    "sk_id_prev", "sk_id_curr", "source", "months_balance", "contract_status", "dpd_raw", "dpd_def",
    "installments_total", "installments_remaining", "balance_amount", "credit_limit",
)

# A contract with more rows than this is crowded: its copies are reduced before they move. One with fewer is a small part
# of a bucket, whatever its rows are.
CROWDED_ROWS = 10_000


def crowded_contracts(card: DataFrame, pos: DataFrame) -> DataFrame:
    """Contracts with so many rows that these should not meet in one task; at most one per CROWDED_ROWS rows."""
    keys = card.select("sk_id_prev").unionByName(pos.select("sk_id_prev"))
    return keys.groupBy("sk_id_prev").agg(F.count("*").alias("_n")).where(F.col("_n") > CROWDED_ROWS).select(
        F.col("sk_id_prev").alias("_crowded"))


def int_loan_month(card: DataFrame, pos: DataFrame, d: Definitions, buckets: int | None = None,
                   crowded: DataFrame | None = None) -> DataFrame:
    """One row per contract and month from both sources.

    The worst row of a month is kept (tolerant DPD, then raw DPD; the other columns only make ties
    reproducible). A contract with card rows uses these alone.

    Ranking comes first: Catalyst keeps the top row of each contract-month inside every map task
    before it shuffles, so copies of one contract, however many, never meet in one task. After it a
    contract has at most one row per month, and source precedence is a plain window over the
    contract. Card rows rank first within a month, hence precedence may follow the ranking.

    Where the crowded contracts are known (`crowded_contracts`), only theirs are ranked before they
    move. All rows then move once, to the bucket of their contract, where one window does both.
    """
    def shaped(df: DataFrame, source: str) -> DataFrame:
        given = {"source": F.lit(source)}
        for c in PANEL_COLUMNS:
            if c in df.columns:
                given[c] = F.col(c)
        return df.select(*[given.get(c, F.lit(None).cast("double")).alias(c) for c in PANEL_COLUMNS])

    rows = shaped(card, d.card_source).unionByName(shaped(pos, d.instalment_source))
    is_card = F.col("source") == d.card_source
    worst_first = [is_card.desc()] + [
        F.col(c).desc_nulls_last()
        for c in ("dpd_def", "dpd_raw", "contract_status", "installments_remaining", "installments_total",
                  "balance_amount", "credit_limit", "sk_id_curr")
    ]

    def worst(df: DataFrame) -> DataFrame:
        rank = F.row_number().over(Window.partitionBy("sk_id_prev", "months_balance").orderBy(*worst_first))
        return df.withColumn("_rank", rank).where("_rank = 1").drop("_rank")

    if buckets and crowded is not None:
        is_crowded = F.col("sk_id_prev").eqNullSafe(F.col("_crowded"))
        reduced = worst(rows.join(F.broadcast(crowded), is_crowded, "left_semi"))
        others = rows.join(F.broadcast(crowded), is_crowded, "left_anti")
        return _first_of_months(others.unionByName(reduced).repartition(buckets, "sk_id_prev"), is_card, worst_first)
    single = worst(rows)
    if buckets:
        single = single.repartition(buckets, "sk_id_prev")
    # In the order that the panel is kept in, so the write finds its rows sorted.
    whole = Window.partitionBy("sk_id_prev").orderBy("months_balance").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    has_card = F.max(is_card).over(whole)
    return single.withColumn("_has_card", has_card).where(is_card | ~F.col("_has_card")).drop("_has_card")


def _first_of_months(rows: DataFrame, is_card: Column, worst_first: list[Column]) -> DataFrame:
    """The first row of each month in the given order, of cards alone where the contract has any: a single pass over the
    rows of a contract, which are as many as those of its months unless it is crowded."""
    month = F.col("months_balance")
    in_order = Window.partitionBy("sk_id_prev").orderBy(month, *worst_first)
    whole = in_order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # The month before is held in a struct: NULL stands before the first row, not for a month that is NULL.
    marked = rows.withColumns({"_before": F.lag(F.struct(month)).over(in_order), "_has_card": F.max(is_card).over(whole)})
    first = ~F.col("_before").eqNullSafe(F.struct(month))
    return marked.where(first & (is_card | ~F.col("_has_card"))).drop("_before", "_has_card")


def source_months(card: DataFrame, pos: DataFrame, buckets: int | None = None) -> DataFrame:
    """Rows of each source per contract and month: both raw panels folded once, on the map side before they move, or with
    `buckets` in the bucket of their contract, for panels without crowded contracts."""
    def keys(df: DataFrame, is_card: bool) -> DataFrame:
        return df.select("sk_id_prev", "months_balance", F.lit(is_card).alias("is_card"))

    rows = keys(card, True).unionByName(keys(pos, False))
    if buckets:
        rows = rows.repartition(buckets, "sk_id_prev")
    return rows.groupBy("sk_id_prev", "months_balance").agg(
        F.count_if("is_card").alias("n_card"), F.count_if(~F.col("is_card")).alias("n_pos"))


def source_contracts(months: DataFrame) -> DataFrame:
    """Months of each source per contract."""
    return months.groupBy("sk_id_prev").agg(
        F.count_if(F.col("n_card") > 0).alias("card_months"), F.count_if(F.col("n_pos") > 0).alias("pos_months"))


def earliest_month(panel: DataFrame) -> Column:
    """First month of the data window, as a scalar subquery over one column."""
    return panel.agg(F.min("months_balance")).scalar()


def unique(df: DataFrame, key: str, what: str, buckets: int | None = None) -> DataFrame:
    """The rows by their key; a key with several rows stops the query that reads them.

    The count rides on the exchange that a join by the key needs anyway, so the constraint costs no shuffle of its own.
    `buckets` is the number of partitions that the other side of that join lies in. Rows without a key are not held
    together by it and are left out, as no join finds them.
    """
    keyed = df.where(F.col(key).isNotNull())
    if buckets:
        keyed = keyed.repartition(buckets, key)
    one = keyed.groupBy(key).agg(F.count("*").alias("_n"), F.any_value(
        F.struct(*[c for c in df.columns if c != key])).alias("_row"))
    message = F.concat(F.lit(f"{what}: several rows of {key} "), F.col(key).cast("string"))
    alone = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(message).cast("boolean"))
    return one.where(alone).select(key, "_row.*")


def dim_loan(panel: DataFrame, application: DataFrame, d: Definitions, buckets: int | None = None) -> DataFrame:
    """One row per contract of the panel, with its application, of which there must not be several."""
    month = F.col("months_balance")
    open_month = F.when(labels.is_open(F.col("contract_status"), d), month)
    paid = F.col("installments_total") - F.col("installments_remaining")
    life = panel.groupBy("sk_id_prev").agg(
        F.max("sk_id_curr").alias("sk_id_curr"),
        F.max("source").alias("source"),
        F.min(month).alias("first_observed_month"),
        F.min(open_month).alias("first_open_month"),
        F.max(month).alias("last_observed_month"),
        value_at_last(F.col("contract_status"), month).alias("last_status"),
        value_at_last(F.col("installments_remaining"), month).alias("installments_remaining_at_last"),
        F.count("*").alias("n_months_observed"),
        value_at_first(paid, open_month).alias("installments_paid_at_open"),
    )
    attributes = unique(application.select(
        "sk_id_prev", "contract_type", "portfolio", "product_type", "channel_type", "client_type", "yield_group",
        "product_combination", "goods_category", "seller_industry", "credit_amount", "annuity_amount",
        "down_payment_amount", "tenor_months", "days_decision", "days_termination",
        F.lit(True).alias("_found"),
    ), "sk_id_prev", "applications", buckets)
    cut_left = F.col("is_left_truncated")
    end_state = (
        F.when(F.col("first_open_month").isNull(), "never_open")
        .when(F.col("last_status") == d.closed_status, "closed")
        .when(F.col("last_observed_month") == d.last_month, "censored")
        .when(F.col("days_termination").isNotNull(), "closed_inferred")
        .otherwise("unknown")
    )
    started = F.coalesce(F.col("installments_paid_at_open"), F.lit(0.0)) > 0
    life = life.withColumn("is_left_truncated", F.col("first_observed_month") == earliest_month(panel))
    return life.join(attributes, "sk_id_prev", "left").select(
        "sk_id_prev", "sk_id_curr", "source", "contract_type", "portfolio", "product_type", "channel_type",
        "client_type", "yield_group", "product_combination", "goods_category", "seller_industry", "credit_amount",
        "annuity_amount", "down_payment_amount", "tenor_months", "days_decision", "first_observed_month",
        "first_open_month", "last_observed_month",
        (F.col("last_observed_month") - F.col("first_open_month")).alias("max_mob"),
        "last_status", "installments_remaining_at_last", "n_months_observed", "days_termination",
        end_state.alias("end_state"),
        cut_left,
        "installments_paid_at_open",
        (cut_left | started).alias("is_partial_history"),
        F.col("_found").isNotNull().alias("has_application"),
    )


def exposure(d: Definitions) -> Column:
    """Outstanding amount: instalments left times annuity, or the card balance floored at zero."""
    balance = F.col("balance_amount")
    return (
        F.when(F.col("source") == d.instalment_source, F.col("installments_remaining") * F.col("annuity_amount"))
        .when(balance < 0, 0.0)
        .otherwise(balance)
    )


def _delay_columns(dpd: str, suffix: str, d: Definitions) -> list[Column]:
    days = F.col(dpd)
    order = labels.bucket_order(days, d)
    return [
        days.alias(f"dpd{suffix}"),
        order.alias(f"dpd_bucket_order{suffix}"),
        labels.bucket_label(order, d).alias(f"dpd_bucket{suffix}"),
        (days > d.past_due_days).alias(f"is_30_plus{suffix}"),
        (days > d.severe_days).alias(f"is_90_plus{suffix}"),
    ]


def fct_loan_month(panel: DataFrame, dim: DataFrame, d: Definitions) -> DataFrame:
    """Every month from the first open one on, also after closing; never-open contracts drop out."""
    terms = dim.where(F.col("first_open_month").isNotNull()).select("sk_id_prev", "first_open_month", "annuity_amount")
    status = F.col("contract_status")
    return (
        panel.join(terms, "sk_id_prev")
        .where(F.col("months_balance") >= F.col("first_open_month"))
        .select(
            "sk_id_prev", "sk_id_curr", "source", "months_balance",
            (F.col("months_balance") - F.col("first_open_month")).alias("mob"),
            "contract_status",
            labels.is_open(status, d).alias("is_open"),
            (status == d.closed_status).alias("is_closed"),
            *_delay_columns("dpd_def", "", d),
            *_delay_columns("dpd_raw", "_no_threshold", d),
            labels.debt_group(F.col("dpd_def"), d).alias("debt_group_vn"),
            exposure(d).alias("exposure_proxy"),
            "credit_limit", "installments_total", "installments_remaining",
        )
    )


def loan_outcome(fact: DataFrame, dim: DataFrame, d: Definitions) -> DataFrame:
    """The dimension with the age of each contract at its first delay, by five definitions.

    Everything about "ever past due by age n" follows from these few numbers, so the fact is read
    once, and the vintage, cohort and experiment plans work on one row per contract.
    """
    mob, raw_30 = F.col("mob"), F.col("is_30_plus_no_threshold")
    card = F.col("source") == d.card_source
    due = F.col("installments_remaining") > 0

    def first(flag: Column) -> Column:
        return F.min(F.when(flag, mob))

    firsts = fact.groupBy("sk_id_prev").agg(
        first(F.col("dpd") > 0).alias("first_1_plus_mob"),
        first(F.col("is_30_plus")).alias("first_30_plus_mob"),
        first(raw_30).alias("first_30_plus_no_threshold_mob"),
        first((card & F.col("is_30_plus")) | ((F.col("source") == d.instalment_source) & raw_30 & due))
        .alias("first_30_plus_due_only_mob"),
        first(raw_30 & (card | due)).alias("first_30_plus_due_only_card_raw_mob"),
        value_at_last(F.col("is_30_plus"), F.col("months_balance")).alias("is_30_plus_at_last"),
    )
    return dim.join(firsts, "sk_id_prev", "left")


def open_months(fact: DataFrame, outcome: DataFrame, d: Definitions) -> DataFrame:
    """Open contract-months with the labels of their contract: what the portfolio at a month is made of.

    Kept by month, so that a month's portfolio is one partition, however long the book. Both tables lie by contract and
    are joined where they are.
    """
    contract = outcome.select(
        "sk_id_prev", "has_application", "is_partial_history", "first_30_plus_mob",
        *labels.segment_columns(d, F.col("has_application"), ("contract_type", "channel_type")))
    delays = [f"{c}{s}" for s in ("", "_no_threshold") for c in ("dpd_bucket", "dpd_bucket_order", "is_30_plus")]
    return fact.where("is_open").select(
        "sk_id_prev", "source", "months_balance", "mob", *delays, "exposure_proxy").join(contract, "sk_id_prev")


def vintage_base(outcome: DataFrame) -> DataFrame:
    """Contracts whose age on book can be trusted."""
    return outcome.where((F.col("end_state") != "never_open") & ~F.col("is_partial_history"))
