"""Data-quality checks of a built loan book.

A check yields violating rows; none means it passes. `error` checks stop a build, `warn` checks
report known facts of the data. Row-level checks of one table are predicates, and all predicates of
a table are counted in a single scan of it. Checks that read the same large table are counted
together (`TOGETHER`); their violating rows, for samples, still come from each check alone.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from types import MappingProxyType

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.book import LoanBook
from arrearview.functions import labels
from arrearview.functions.aggregates import exact_sum
from arrearview.params import Definitions
from arrearview.plans.core import source_contracts
from arrearview.plans.marts import approved_without_instalment, at_month, deduplicated

ERROR, WARN = "error", "warn"


class QualityError(RuntimeError):
    """An error-level check found violating rows."""


@dataclass(frozen=True)
class RowCheck:
    """Rows of one table that satisfy a predicate are violations."""

    name: str
    severity: str
    table: str
    predicate: Callable[[Definitions], Column]

    def rows(self, book: LoanBook) -> DataFrame:
        return table_of(book, self.table).where(self.predicate(book.d))


@dataclass(frozen=True)
class QueryCheck:
    """Violations come from a query over several tables or groups."""

    name: str
    severity: str
    query: Callable[[LoanBook], DataFrame]

    def rows(self, book: LoanBook) -> DataFrame:
        return self.query(book)


@dataclass(frozen=True)
class GrainCheck:
    """Keys that a table holds more than once."""

    name: str
    severity: str
    table: str
    keys: tuple[str, ...]

    def rows(self, book: LoanBook) -> DataFrame:
        return _duplicates(self.table, *self.keys)(book)


def table_of(book: LoanBook, name: str) -> DataFrame:
    return book.stg(name[4:]) if name.startswith("stg_") else getattr(book, name)


def _any(*conditions: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in conditions])


def _differ(a: Column, b: Column) -> Column:
    return ~a.eqNullSafe(b)


# ---- invariants: each gives the condition under which a row breaks it ------------------------

def _money(name: str) -> Column:
    """An amount that is NULL where nothing was summed counts as zero."""
    return F.coalesce(F.col(name), F.lit(0.0))


def rising(*names: str) -> Column:
    """Counts where each is part of the next one."""
    return _any(*[F.col(a) > F.col(b) for a, b in zip(names, names[1:])])


def shares(*names: str) -> Column:
    return _any(*[~F.col(n).between(0, 1) for n in names])


def no_less_than(bound: int, *names: str) -> Column:
    return _any(*[F.col(n) < bound for n in names])


def within_total(total: str, *parts: str) -> Column:
    """Amounts that do not exceed the total, up to a cent."""
    return _any(*[_money(p) - _money(total) > 0.01 for p in parts])


def equal_where(condition: Column, left: Column, right: Column) -> Column:
    return condition & _differ(left, right)


# ---- predicates ------------------------------------------------------------------------------

def _end_state(d: Definitions) -> Column:
    state, last, first = F.col("end_state"), F.col("last_status"), F.col("first_open_month")
    ended, stop = F.col("days_termination"), F.col("last_observed_month")
    stopped_early = (last != d.closed_status) & (stop < d.last_month) & first.isNotNull()
    valid = (
        F.when(state == "never_open", first.isNull())
        .when(state == "closed", last == d.closed_status)
        .when(state == "censored", stop == d.last_month)
        .when(state == "closed_inferred", stopped_early & ended.isNotNull())
        .when(state == "unknown", stopped_early & ended.isNull())
        .otherwise(False)
    )
    return ~F.coalesce(valid, F.lit(True))


def _partial_flag(d: Definitions) -> Column:
    paid = F.coalesce("installments_paid_at_open", F.lit(0.0)) > 0
    return _differ(F.col("is_partial_history"), F.col("is_left_truncated") | paid)


def _delay_invalid(d: Definitions) -> Column:
    def one(s: str) -> Column:
        days = F.col(f"dpd{s}")
        return days.isNull() | (days < 0) | F.col(f"dpd_bucket{s}").isNull()

    return _any(one(""), one("_no_threshold"))


def _flags_off(d: Definitions) -> Column:
    def of(s: str) -> list[Column]:
        days, order = F.col(f"dpd{s}"), F.col(f"dpd_bucket_order{s}")
        late, severe = F.col(f"is_30_plus{s}"), F.col(f"is_90_plus{s}")
        return [_differ(late, days > d.past_due_days), _differ(severe, days > d.severe_days),
                _differ(late, order >= 2), _differ(severe, order == 4), _differ(order == 0, days == 0)]

    return _any(*of(""), *of("_no_threshold"))


def _first_payment(d: Definitions) -> Column:
    return _any(rising("n_fpd30", "n_loans"), rising("n_fpd30_late_rule", "n_loans"),
                shares("fpd30_rate", "fpd30_late_rule_rate"))


def _funnel(d: Definitions) -> Column:
    return _any(rising("n_approved", "n_offered"), shares("approval_rate", "take_up_rate"),
                F.col("n_unused_offer") > F.col("n_decided") - F.col("n_approved"))


def _snapshot(d: Definitions) -> Column:
    """Past due by count follows from the bucket; strict counts are part of those without a threshold."""
    by_bucket = F.when(F.col("dpd_bucket_order") >= 2, F.col("n_loans")).otherwise(0)
    return _any(rising("n_30_plus", "n_30_plus_no_threshold", "n_loans"),
                rising("n_30_plus_exposure_known", "n_loans_exposure_known", "n_loans"),
                rising("n_30_plus_exposure_known", "n_30_plus"), _differ(F.col("n_30_plus"), by_bucket),
                no_less_than(1, "n_loans"), no_less_than(0, "n_30_plus", "exposure", "exposure_30_plus"),
                within_total("exposure", "exposure_30_plus", "exposure_30_plus_no_threshold"))


def _transition(d: Definitions) -> Column:
    gaps_elsewhere = F.when(F.col("to_state") != d.exit_states[2], F.col("n_month_gap"))
    return _any(rising("n_month_gap", "n_loans", "n_from"), rising("n_exposure_null", "n_loans"), gaps_elsewhere > 0,
                shares("roll_rate", "exposure_roll_rate"), no_less_than(0, "exposure_from"))


def _vintage(d: Definitions) -> Column:
    late, late_nt, due = "n_ever_30_plus", "n_ever_30_plus_no_threshold", "n_ever_30_plus_due_only"
    source = F.col("source")
    return _any(rising(late, late_nt, "n_loans"), rising(due, "n_loans"), no_less_than(1, "n_loans"),
                _differ(F.col("n_loans") - F.col("n_observed_full"), F.col("n_closed_early")),
                no_less_than(0, "n_closed_early"),
                shares("ever_30_plus_rate", "ever_30_plus_rate_no_threshold"),
                equal_where(source == d.card_source, F.col(due), F.col(late)),
                equal_where(source == d.instalment_source, F.greatest(due, late_nt), F.col(late_nt)))


# ---- queries ---------------------------------------------------------------------------------

def _duplicates(table: str, *keys: str) -> Callable[[LoanBook], DataFrame]:
    return lambda book: table_of(book, table).groupBy(*keys).agg(F.count("*").alias("n_rows")).where("n_rows > 1")


def compared(left: DataFrame, right: DataFrame) -> DataFrame:
    """Two one-row aggregates with equal columns: their row side by side when anything differs."""
    both = left.withColumn("_side", F.lit("l")).unionByName(right.withColumn("_side", F.lit("r")))
    names = left.columns
    wide = both.groupBy().agg(
        *[F.max(F.when(F.col("_side") == s, F.col(c))).alias(f"{c}_{t}") for c in names
          for s, t in (("l", "mart"), ("r", "source"))])
    return wide.where(_any(*[_differ(F.col(f"{c}_mart"), F.col(f"{c}_source")) for c in names]))


def _month_gaps(book: LoanBook) -> DataFrame:
    before = F.lag("months_balance").over(Window.partitionBy("sk_id_prev").orderBy("months_balance"))
    return (
        book.fct_loan_month.select("sk_id_prev", before.alias("prev_month"), "months_balance")
        .withColumn("missing_months", F.col("months_balance") - F.col("prev_month") - 1)
        .where("missing_months > 0"))


def _approved_reconcile(book: LoanBook) -> DataFrame:
    source = approved_without_instalment(
        book.stg("installments_payments"), book.stg("previous_application")).agg(F.count("*").alias("n"))
    return compared(_idle_total(book), source)


def _idle_total(book: LoanBook) -> DataFrame:
    idle = F.sum("n_approved_not_activated") + F.sum("n_approved_scheduled_no_installment")
    return book.fpd_by_segment.agg(F.coalesce(idle, F.lit(0)).alias("n"))


def _fpd_totals(book: LoanBook) -> DataFrame:
    return book.fpd_by_segment.agg(F.coalesce(F.sum("n_loans"), F.lit(0)).alias("n_loans"),
                                   F.coalesce(F.sum("n_fpd30"), F.lit(0)).alias("n_fpd30"))


def _fpd_reconcile(book: LoanBook) -> DataFrame:
    """First instalment by another route: the lowest version joined back to the folded versions."""
    d = book.d
    folded = (
        book.stg("installments_payments")
        .where((F.col("installment_number") == 1) & (F.col("installment_version") > 0))
        .groupBy("sk_id_prev", "installment_version")
        .agg(F.min("days_due").alias("due"), F.max("installment_amount").alias("amount"),
             F.coalesce(exact_sum(F.when(F.col("days_late") <= d.grace_days, F.col("payment_amount"))),
                        F.lit(0.0)).alias("paid")))
    lowest = folded.groupBy("sk_id_prev").agg(F.min("installment_version").alias("installment_version"))
    eligible = folded.join(lowest, ["sk_id_prev", "installment_version"]).where(
        (F.col("due") <= -d.grace_days) & (F.col("amount") > 0))
    source = eligible.agg(F.count("*").alias("n_loans"),
                          F.count_if(F.col("paid") < F.col("amount") * d.paid_tolerance).alias("n_fpd30"))
    return compared(_fpd_totals(book), source)


def _funnel_reconcile(book: LoanBook) -> DataFrame:
    return compared(book.funnel_by_channel.agg(F.coalesce(F.sum("n_applications"), F.lit(0)).alias("n")),
                    deduplicated(book.stg("previous_application")).agg(F.count("*").alias("n")))


def _panel_reconcile(book: LoanBook) -> DataFrame:
    """Months of the panel against the sources: of a contract with cards, the card months alone."""
    of_contract = F.when(F.col("card_months") > 0, F.col("card_months")).otherwise(F.col("pos_months"))
    return compared(book.int_loan_month.agg(F.count("*").alias("n")),
                    source_contracts(book.source_months).agg(F.coalesce(F.sum(of_contract), F.lit(0)).alias("n")))


def _unknown_status(book: LoanBook) -> DataFrame:
    known = F.coalesce(F.col("contract_status").isin(*book.d.known_statuses), F.lit(False))
    return book.int_loan_month.where(~known).groupBy("source", "contract_status").agg(F.count("*").alias("n_rows"))


def _snapshot_reconcile(book: LoanBook) -> DataFrame:
    def sums(df: DataFrame, *columns: str) -> DataFrame:
        return df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in columns])

    open_now = at_month(book.open_months, book.d).agg(
        F.count("*").alias("n_loans"), F.count_if("is_30_plus").alias("n_30_plus"),
        F.count_if("is_30_plus_no_threshold").alias("n_30_plus_no_threshold"),
        F.count("exposure_proxy").alias("n_loans_exposure_known"))
    return compared(sums(book.portfolio_snapshot, *open_now.columns), open_now)


def _same_months(book: LoanBook) -> DataFrame:
    keys = ["source", "contract_type", "channel_type"]
    left = F.col("to_state").isin(*book.d.exit_states)

    def side(definition: str, suffix: str) -> DataFrame:
        return book.roll.where(F.col("definition") == definition).groupBy(*keys).agg(
            F.sum("n_loans").alias(f"n_all_{suffix}"),
            F.sum(F.when(left, F.col("n_loans"))).alias(f"n_exit_{suffix}"))

    both = side("primary", "primary").join(side("no_threshold", "no_threshold"), keys, "full")
    return both.where(_any(*[_differ(F.col(f"{c}_primary"), F.col(f"{c}_no_threshold")) for c in ("n_all", "n_exit")]))


def _row_sums(book: LoanBook) -> DataFrame:
    rows = book.roll.groupBy("definition", "source", "contract_type", "channel_type", "from_state").agg(
        F.sum("roll_rate").alias("total_rate"), F.sum("n_loans").alias("n_loans_sum"), F.max("n_from").alias("n_from"))
    return rows.where((F.abs(F.col("total_rate") - 1) > 1e-9) | (F.col("n_loans_sum") != F.col("n_from")))


def _duplicate_months(book: LoanBook) -> DataFrame:
    of_source = F.array(*[F.struct(F.lit(name).alias("source"), F.col(n).alias("n_rows")) for name, n in (
        (book.d.instalment_source, "n_pos"), (book.d.card_source, "n_card"))])
    rows = book.source_months.where("n_pos > 1 or n_card > 1").select(
        "sk_id_prev", "months_balance", F.explode(of_source).alias("of"))
    return rows.select("sk_id_prev", "months_balance", "of.n_rows", "of.source").where("n_rows > 1")


def _in_both(book: LoanBook) -> DataFrame:
    return source_contracts(book.source_months).where("card_months > 0 and pos_months > 0").select("sk_id_prev")


def _eligible(book: LoanBook) -> DataFrame:
    return book.dim_loan.where((F.col("end_state") != "never_open") & ~F.col("is_partial_history"))


def _cohorts_match(book: LoanBook) -> DataFrame:
    d = book.d
    mart = book.vintage.where("mob = 0").groupBy(
        F.col("origination_cohort_start").alias("start"), F.col("origination_cohort").alias("label")
    ).agg(F.sum("n_loans").alias("n_mart"))
    core = _eligible(book).groupBy(
        labels.cohort_start(F.col("first_open_month"), d).alias("start")).agg(F.count("*").alias("n_core"))
    starts = range(d.window_start, d.last_month + 1, d.cohort_width)
    return mart.join(core, "start", "full").where(_any(
        _differ(F.col("n_mart"), F.col("n_core")),
        _differ(F.col("label"), labels.cohort_label(F.col("start"), d)),
        ~F.col("start").isin(*starts)))


def _base_matches(book: LoanBook) -> DataFrame:
    return compared(book.vintage.where("mob = 0").agg(F.coalesce(F.sum("n_loans"), F.lit(0)).alias("n")),
                    _eligible(book).agg(F.count("*").alias("n")))


_ROLL_KEYS = ("definition", "source", "contract_type", "channel_type", "from_state", "to_state")
_SEGMENTS = ("contract_type", "channel_type", "client_type", "yield_group")

def _grain(name: str, table: str, *keys: str) -> GrainCheck:
    return GrainCheck(f"grain_{name}", ERROR, table, keys)


def _range(name: str, table: str, broken: Callable[[Definitions], Column]) -> RowCheck:
    return RowCheck(f"range_{name}", ERROR, table, broken)


def _flag(name: str, table: str, broken: Callable[[Definitions], Column]) -> RowCheck:
    return RowCheck(f"flag_{name}", ERROR, table, broken)


def _balance(name: str, rows: Callable[[LoanBook], DataFrame]) -> QueryCheck:
    return QueryCheck(f"balance_{name}", ERROR, rows)


#: By kind. grain: no key twice; range: values that a row may hold; flag: labels follow from what they are made of;
#: balance: a table agrees with its sources; known: facts of the data that are reported and stop nothing.
CHECKS: tuple[RowCheck | GrainCheck | QueryCheck, ...] = (
    _grain("contract", "dim_loan", "sk_id_prev"),
    _grain("contract_month", "fct_loan_month", "sk_id_prev", "months_balance"),
    _grain("vintage", "vintage", "source", *_SEGMENTS, "tenor_group", "origination_cohort", "mob"),
    _grain("transition", "roll", *_ROLL_KEYS),
    _grain("snapshot", "portfolio_snapshot", "contract_type", "channel_type", "dpd_bucket"),
    _grain("funnel", "funnel_by_channel", *_SEGMENTS),
    _grain("first_payment", "fpd_by_segment", *_SEGMENTS),
    _range("age", "fct_loan_month", lambda d: F.coalesce(F.col("mob"), F.lit(-1)) < 0),
    _range("delay", "fct_loan_month", _delay_invalid),
    _range("vintage", "vintage", _vintage),
    _range("transition", "roll", _transition),
    _range("snapshot", "portfolio_snapshot", _snapshot),
    _range("funnel", "funnel_by_channel", _funnel),
    _range("first_payment", "fpd_by_segment", _first_payment),
    _flag("delay_class", "fct_loan_month", _flags_off),
    _flag("partial_history", "dim_loan", _partial_flag),
    _flag("end_state", "dim_loan", _end_state),
    _balance("panel", _panel_reconcile),
    _balance("vintage_base", _base_matches),
    _balance("vintage_cohorts", _cohorts_match),
    _balance("transition_rows", _row_sums),
    _balance("transition_definitions", _same_months),
    _balance("snapshot", _snapshot_reconcile),
    _balance("funnel", _funnel_reconcile),
    _balance("first_payment", _fpd_reconcile),
    _balance("idle_approvals", _approved_reconcile),
    QueryCheck("known_month_gaps", WARN, _month_gaps),
    QueryCheck("known_repeated_months", WARN, _duplicate_months),
    QueryCheck("known_two_sources", WARN, _in_both),
    QueryCheck("known_unlisted_status", WARN, _unknown_status),
    RowCheck("known_no_application", WARN, "dim_loan", lambda d: ~F.col("has_application")),
    RowCheck("known_tolerant_above_raw", WARN, "fct_loan_month", lambda d: F.col("dpd") > F.col("dpd_no_threshold")),
)


def _differs(counts: Column, mart: DataFrame) -> Column:
    """1 where a struct of counts is not what a one-row aggregate of a mart says."""
    return F.when(counts.eqNullSafe(mart.select(F.struct(*mart.columns)).scalar()), 0).otherwise(1)


def _fact_pass(book: LoanBook) -> dict[str, Column | DataFrame]:
    """Predicates of the fact, its repeated months and its gaps: one scan, in the order that its files are in."""
    in_order = Window.partitionBy("sk_id_prev").orderBy("months_balance")
    month, before, earlier = F.col("months_balance"), F.lag("months_balance").over(in_order), F.lag(
        "months_balance", 2).over(in_order)
    rows = book.fct_loan_month.withColumns({"_before": before, "_earlier": earlier})
    again = (F.col("_before") == month) & ~F.col("_earlier").eqNullSafe(month)  # the second row of a month
    counts = {c.name: F.count_if(c.predicate(book.d)) for c in CHECKS
              if isinstance(c, RowCheck) and c.table == "fct_loan_month"}
    return {"_rows": rows, **counts, "grain_contract_month": F.count_if(again),
            "known_month_gaps": F.count_if(month - F.col("_before") > 1)}


def _source_pass(book: LoanBook) -> dict[str, Column | DataFrame]:
    """The months of the panel, and contracts in both sources: one fold of the source counts to contracts."""
    cards, pos = F.col("card_months"), F.col("pos_months")
    panel = book.int_loan_month.agg(F.count("*").alias("n"))
    months = F.coalesce(F.sum(F.when(cards > 0, cards).otherwise(pos)), F.lit(0))
    return {"_rows": source_contracts(book.source_months), "balance_panel": _differs(F.struct(months.alias("n")), panel),
            "known_two_sources": F.count_if((cards > 0) & (pos > 0))}


def payment_pass(book: LoanBook, marts: Mapping[str, LoanBook] = MappingProxyType({})) -> dict[str, Column | DataFrame]:
    """First instalments and idle approvals recounted in one fold of the payments and one join.

    `marts` names, by check, another book whose mart is held against the counts.
    """
    d = book.d
    due_mart, idle_mart = (marts.get(name, book) for name in OF_PAYMENTS)
    version = F.col("installment_version")
    folded = (
        book.stg("installments_payments").where(F.col("installment_number") == 1)
        .groupBy("sk_id_prev", "installment_version")
        .agg(F.min("days_due").alias("due"), F.max("installment_amount").alias("amount"),
             F.coalesce(exact_sum(F.when(F.col("days_late") <= d.grace_days, F.col("payment_amount"))),
                        F.lit(0.0)).alias("paid"))
        .groupBy("sk_id_prev").agg(F.min(F.when(version > 0, F.struct(version, "due", "amount", "paid"))).alias("lowest")))
    approved = deduplicated(book.stg("previous_application")).where(F.col("application_status") == "Approved").select(
        "sk_id_prev", F.lit(True).alias("approved"))
    rows = folded.withColumn("seen", F.lit(True)).join(approved, "sk_id_prev", "full").select(
        "seen", "approved", "lowest.due", "lowest.amount", "lowest.paid")
    eligible = (F.col("due") <= -d.grace_days) & (F.col("amount") > 0)
    counts = F.struct(F.count_if(eligible).alias("n_loans"),
                      F.count_if(eligible & (F.col("paid") < F.col("amount") * d.paid_tolerance)).alias("n_fpd30"))
    idle = F.struct(F.count_if(F.col("approved") & F.col("seen").isNull()).alias("n"))
    found = _differs(counts, _fpd_totals(due_mart)), _differs(idle, _idle_total(idle_mart))
    return {"_rows": rows, **dict(zip(OF_PAYMENTS, found))}


#: Checks that `payment_pass` counts.
OF_PAYMENTS = ("balance_first_payment", "balance_idle_approvals")

#: Passes that count several checks at once, by the checks that they count.
TOGETHER: tuple[Callable[[LoanBook], dict[str, Column | DataFrame]], ...] = (_fact_pass, _source_pass, payment_pass)


def counted(rows: DataFrame, counts: dict[str, Column]) -> DataFrame:
    """check_name, n_violations from one aggregate of the rows."""
    names = list(counts)
    one = rows.agg(*[counts[n].cast("long").alias(f"c{i}") for i, n in enumerate(names)])
    stacked = ", ".join(f"'{n}', c{i}" for i, n in enumerate(names))
    return one.select(F.expr(f"stack({len(names)}, {stacked}) as (check_name, n_violations)"))


def _table_pass(book: LoanBook, table: str, checks: list[RowCheck | GrainCheck]) -> DataFrame:
    """All predicates of a table, and its repeated keys, from one scan: counted by key first where a key is checked."""
    rows = table_of(book, table)
    broken = {c.name: F.count_if(c.predicate(book.d)) for c in checks if isinstance(c, RowCheck)}
    grain = next((c for c in checks if isinstance(c, GrainCheck)), None)
    if grain is None:
        return counted(rows, broken)
    parts = rows.groupBy(*grain.keys).agg(F.count("*").alias("_n"), *[
        n.alias(f"_p{i}") for i, n in enumerate(broken.values())])
    sums = {name: F.coalesce(F.sum(f"_p{i}"), F.lit(0)) for i, name in enumerate(broken)}
    return counted(parts, {**sums, grain.name: F.count_if(F.col("_n") > 1)})


def summary(book: LoanBook, checks: tuple = CHECKS, parallel: int = 8) -> DataFrame:
    """One row per check: violations, and pass, warn or fail.

    The checks are independent aggregates. They run several at a time and only their counts, one
    row per check, come to the driver.
    """
    book.build()
    _ = book.source_months
    wanted, jobs = {c.name: c for c in checks}, []
    for shared in TOGETHER:
        counts = shared(book)
        rows = counts.pop("_rows")
        if counts.keys() <= wanted.keys():
            jobs.append(lambda r=rows, n=counts: counted(r, n))
            wanted = {name: c for name, c in wanted.items() if name not in counts}
    by_table: dict[str, list[RowCheck | GrainCheck]] = {}
    for c in wanted.values():
        if not isinstance(c, QueryCheck):
            by_table.setdefault(c.table, []).append(c)
    jobs += [lambda t=t, cs=cs: _table_pass(book, t, cs) for t, cs in by_table.items()]
    jobs += [lambda c=c: counted(c.rows(book), {c.name: F.count("*")}) for c in wanted.values()
             if isinstance(c, QueryCheck)]
    with ThreadPoolExecutor(parallel) as pool:
        found = {r["check_name"]: r["n_violations"] for part in pool.map(lambda job: job().collect(), jobs) for r in part}
    rows = [(c.name, c.severity, found[c.name]) for c in checks]
    counts = book.spark.createDataFrame(rows, "check_name string, severity string, n_violations long")
    status = (F.when(F.col("n_violations") == 0, "pass").when(F.col("severity") == WARN, "warn").otherwise("fail"))
    return counts.withColumn("status", status)


def samples(book: LoanBook, name: str, n: int = 5) -> DataFrame:
    """A few violating rows of one check, for the report."""
    return next(c for c in CHECKS if c.name == name).rows(book).limit(n)


def enforce(book: LoanBook) -> DataFrame:
    """Run all checks; raise when an error-level one fails, naming it with sample rows."""
    result = summary(book)
    failed = [r["check_name"] for r in result.where("status = 'fail'").collect()]
    if failed:
        shown = "; ".join(f"{n}: {[r.asDict() for r in samples(book, n).collect()]}" for n in failed)
        raise QualityError(f"{len(failed)} check(s) failed: {shown}")
    return result
