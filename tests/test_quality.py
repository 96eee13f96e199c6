"""Checks pass on a sound book and notice a broken one."""

import pytest
from pyspark.sql import functions as F

from arrearview.plans import faults, quality
from arrearview.plans.faults import Edited as Broken


def failing(book, *names):
    checks = tuple(c for c in quality.CHECKS if c.name in names)
    return {r["check_name"] for r in quality.summary(book, checks).where("n_violations > 0").collect()}


def test_thirty_two_checks():
    assert len(quality.CHECKS) == len({c.name for c in quality.CHECKS}) == 32
    assert sum(c.severity == "warn" for c in quality.CHECKS) == 6


def test_sound_book(book):
    rows = quality.enforce(book).collect()
    assert len(rows) == 32 and not [r for r in rows if r["status"] == "fail"]


@pytest.mark.parametrize("table,change,check", [
    ("dim_loan", lambda t: t.withColumn("end_state", F.lit("closed")), "flag_end_state"),
    ("dim_loan", lambda t: t.withColumn("end_state", F.lit(None).cast("string")), "flag_end_state"),
    ("dim_loan", lambda t: t.withColumn("is_partial_history", ~F.col("is_partial_history")),
     "flag_partial_history"),
    ("dim_loan", lambda t: t.union(t.limit(1)), "grain_contract"),
    ("fct_loan_month", lambda t: t.withColumn("dpd", F.lit(None).cast("long")), "range_delay"),
    ("fct_loan_month", lambda t: t.withColumn("is_30_plus", F.lit(None).cast("boolean")),
     "flag_delay_class"),
    ("fct_loan_month", lambda t: t.withColumn("mob", F.lit(-1)), "range_age"),
    ("fct_loan_month", lambda t: t.union(t.limit(1)), "grain_contract_month"),
    ("fpd_by_segment", lambda t: t.withColumn("n_fpd30", F.col("n_loans") + 1), "range_first_payment"),
    ("fpd_by_segment", lambda t: t.withColumn("n_loans", F.col("n_loans") + 1),
     "balance_first_payment"),
    ("funnel_by_channel", lambda t: t.withColumn("n_applications", F.col("n_applications") + 1),
     "balance_funnel"),
    ("int_loan_month", lambda t: t.union(t.limit(1)), "balance_panel"),
    ("int_loan_month", lambda t: t.withColumn("contract_status", F.lit(None).cast("string")),
     "known_unlisted_status"),
    ("portfolio_snapshot", lambda t: t.withColumn("n_30_plus", F.col("n_loans") + 1),
     "range_snapshot"),
    ("portfolio_snapshot", lambda t: t.where("dpd_bucket_order > 0"), "balance_snapshot"),
    ("roll", lambda t: t.withColumn("n_month_gap", F.col("n_loans") + 1), "range_transition"),
    ("roll", lambda t: t.where("not (definition = 'primary' and from_order = 0)"),
     "balance_transition_definitions"),
    ("roll", lambda t: t.withColumn("roll_rate", F.col("roll_rate") * 1.01), "balance_transition_rows"),
    ("vintage", lambda t: t.where("origination_cohort_start <> -96"), "balance_vintage_cohorts"),
    ("vintage", lambda t: t.withColumn("n_ever_30_plus", F.col("n_loans") + 1), "range_vintage"),
    ("vintage", lambda t: t.where("mob <> 0 or source <> 'pos_cash'"), "balance_vintage_base"),
    ("vintage", lambda t: t.union(t.limit(1)), "grain_vintage"),
    ("fpd_by_segment", lambda t: t.withColumn("n_approved_not_activated", F.col("n_approved_not_activated") + 1),
     "balance_idle_approvals"),
    ("fpd_by_segment", lambda t: t.union(t.limit(1)), "grain_first_payment"),
    ("funnel_by_channel", lambda t: t.withColumn("n_unused_offer", F.col("n_decided") + 1), "range_funnel"),
    ("funnel_by_channel", lambda t: t.union(t.limit(1)), "grain_funnel"),
    ("portfolio_snapshot", lambda t: t.union(t.limit(1)), "grain_snapshot"),
    ("roll", lambda t: t.union(t.limit(1)), "grain_transition"),
])
def test_broken_tables_are_noticed(book, table, change, check):
    assert failing(Broken(book, **{table: change(getattr(book, table))}), check) == {check}


def test_enforce_raises_with_samples(book):
    with pytest.raises(quality.QualityError, match="grain_contract"):
        quality.enforce(Broken(book, dim_loan=book.dim_loan.union(book.dim_loan.limit(1))))


def test_every_stopping_check_has_a_fault(book):
    assert {f.check for f in faults.FAULTS} == {c.name for c in quality.CHECKS if c.severity == quality.ERROR}
    found = {r["check_name"]: r["n_violations"] for r in faults.noticed(book).collect()}
    assert len(found) == 26 and all(found.values()), found


def test_passes_count_what_each_check_counts(book):
    """On a book with faults in the tables of all shared passes, together and alone."""
    some = [f for f in faults.FAULTS if f.check in (
        "grain_contract_month", "balance_panel", "balance_idle_approvals", "grain_vintage", "range_funnel")]
    edited = Broken(book, **{f.table: f.edit(getattr(book, f.table)) for f in some})
    alone = {c.name: c.rows(edited).count() for c in quality.CHECKS}
    assert {r["check_name"]: r["n_violations"] for r in quality.summary(edited).collect()} == alone
    assert all(alone[f.check] for f in some)


def test_the_sources_move_once(book):
    """Three checks read one table of source counts, which folds both raw panels in one exchange."""
    from arrearview.plans import core

    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    text = plan(core.source_months(book.stg("credit_card_balance"), book.stg("pos_cash_balance")))
    assert text.count("Exchange hashpartitioning(sk_id_prev") == 1
    for rows in (quality._panel_reconcile(book), quality._duplicate_months(book), quality._in_both(book)):
        assert "source_months" in plan(rows) and "orders" not in plan(rows)


def test_repeated_rows_stay_in_their_buckets(book):
    """A fault that repeats months of the fact reads it once and moves nothing; the rows are those of a union."""
    fault = next(f for f in faults.FAULTS if f.check == "grain_contract_month")
    check = next(c for c in quality.CHECKS if c.name == fault.check)
    edited, fact = fault.plant(book), book.fct_loan_month
    text = check.rows(edited)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in text and text.count("FileScan") == 1
    want = fact.unionByName(fact.where("sk_id_prev % 7 = 0 and mob = 3"))
    assert edited.fct_loan_month.exceptAll(want).count() == want.exceptAll(edited.fct_loan_month).count() == 0
    assert check.rows(edited).count() == want.count() - fact.count() > 0


def test_a_row_whose_condition_is_null_is_not_repeated(spark):
    rows = spark.createDataFrame([(1, "a"), (None, "b"), (2, "c"), (2, "c")], "k int, v string")
    edited = faults.repeated("k = 2")(rows)
    assert edited.columns == rows.columns
    assert sorted(map(repr, edited.collect())) == sorted(map(repr, rows.unionByName(rows.where("k = 2")).collect()))


def test_faults_of_one_table_are_counted_in_one_scan(book):
    """Three faults of the fact and two of the dimension: each counted as if it were planted alone."""
    checks = {c.name: c for c in quality.CHECKS}
    for table, n in (("fct_loan_month", 3), ("dim_loan", 2)):
        some = [f for f in faults.FAULTS if f.table == table and isinstance(f.edit, faults.Changed)]
        assert len(some) == n
        counted = faults._of_rows(book, some)
        assert counted._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1
        got = {r["check_name"]: r["n_violations"] for r in counted.collect()}
        assert got == {f.check: checks[f.check].rows(f.plant(book)).count() for f in some} and all(got.values())


def test_the_payments_are_read_once_for_two_faults(book):
    some = [f for f in faults.FAULTS if f.check in quality.OF_PAYMENTS]
    both = faults._of_payments(book, some)
    once = quality._fpd_reconcile(book)._jdf.queryExecution().executedPlan().toString()
    text = both._jdf.queryExecution().executedPlan().toString()
    assert len(some) == 2 and text.count("orders.parquet") < 2 * once.count("orders.parquet")
    assert {r["check_name"]: r["n_violations"] for r in both.collect()} == dict.fromkeys(quality.OF_PAYMENTS, 1)
    one_sound = faults._of_payments(book, [some[0], faults.Fault(some[1].check, some[1].table, faults.without("false"))])
    assert {r["check_name"]: r["n_violations"] for r in one_sound.collect()} == {some[0].check: 1, some[1].check: 0}


def test_several_faults_of_one_check_are_counted_one_by_one(book):
    """The same check twice, by a changed column and by rows left out, and changes that meet NULL conditions."""
    kinds = (faults.Fault("range_age", "fct_loan_month", faults.changed("mob", "-1", "mob = 2")),
             faults.Fault("range_age", "fct_loan_month", faults.changed("mob", "null", "nullif(mob, 3) = 2 or mob = 4")),
             faults.Fault("range_age", "fct_loan_month", faults.without("mob = 2")),
             faults.Fault("range_delay", "fct_loan_month", faults.changed("dpd", "null", "mob = 2")))
    months = {r["mob"]: r["count"] for r in book.fct_loan_month.groupBy("mob").count().collect()}
    got = [r["n_violations"] for r in faults.noticed(book, kinds).collect()]
    assert got == [months[2], months[2] + months[4], 0, months[2]]
