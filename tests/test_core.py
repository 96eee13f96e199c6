"""Core tables on hand-written rows: everything the derived data never shows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from arrearview.book import LoanBook
from arrearview.functions.aggregates import exact_sum, grouped_median
from arrearview.params import Definitions
from arrearview.plans import core, marts
from arrearview.sources.raw import RAW_TABLES, schema

D = Definitions()
POS = ("sk_id_prev", "sk_id_curr", "months_balance", "cnt_instalment", "cnt_instalment_future",
       "name_contract_status", "sk_dpd", "sk_dpd_def")


def raw_book(spark, pos=(), card=(), apps=()):
    def frame(table, rows, **defaults):
        s = schema(table)
        full = [tuple(dict(zip(s.names, [None] * len(s))) | defaults | r for r in [row])[0] for row in rows]
        return spark.createDataFrame([tuple(r[n] for n in s.names) for r in full], s)

    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["pos_cash_balance"] = frame("pos_cash_balance", [dict(zip(POS, r)) for r in pos])
    raw["credit_card_balance"] = frame("credit_card_balance", card)
    raw["previous_application"] = frame("previous_application", apps)
    return LoanBook(spark, raw)


def test_worst_row_of_a_month_is_kept(spark):
    b = raw_book(spark, pos=[
        (1, 1, -5, 12.0, 6.0, "Active", 0, 0), (1, 1, -5, 12.0, 6.0, "Active", 40, 5),
        (1, 1, -5, 12.0, 6.0, "Active", 10, 9), (1, 1, -4, 12.0, 5.0, "Active", None, None),
        (1, 1, -4, 12.0, 5.0, "Active", 3, None)])
    got = {r["months_balance"]: (r["dpd_def"], r["dpd_raw"]) for r in b.int_loan_month.collect()}
    assert got == {-5: (9, 10), -4: (None, 3)}


def test_card_rows_take_precedence_for_the_whole_contract(spark):
    card = [dict(sk_id_prev=7, sk_id_curr=1, months_balance=-3, amt_balance=10.0, name_contract_status="Active",
                 sk_dpd=0, sk_dpd_def=0)]
    b = raw_book(spark, pos=[(7, 1, -3, 6.0, 3.0, "Active", 90, 90), (7, 1, -2, 6.0, 2.0, "Active", 90, 90),
                             (8, 1, -2, 6.0, 2.0, "Active", 0, 0)], card=card)
    got = sorted((r["sk_id_prev"], r["source"], r["months_balance"]) for r in b.int_loan_month.collect())
    assert got == [(7, "credit_card", -3), (8, "pos_cash", -2)]


def test_last_values_skip_nulls(spark):
    b = raw_book(spark, pos=[(1, 1, -9, 6.0, None, "Active", 0, 0), (1, 1, -8, 6.0, 4.0, "Active", 0, 0),
                             (1, 1, -7, 6.0, None, None, 0, 0)])
    r = b.dim_loan.first()
    assert (r["last_status"], r["installments_remaining_at_last"], r["installments_paid_at_open"]) == ("Active", 4.0, 2.0)
    assert r["end_state"] == "unknown" and not r["has_application"] and r["is_left_truncated"]


@pytest.mark.parametrize("rows,termination,state", [
    ([(-5, "Signed")], 10, "never_open"),
    ([(-5, "Approved"), (-4, "Sent proposal")], None, "never_open"),
    ([(-5, "Active"), (-4, "Completed")], None, "closed"),
    ([(-5, "Active"), (-1, "Completed")], None, "closed"),
    ([(-5, "Active"), (-1, "Active")], 10, "censored"),
    ([(-5, "Active"), (-3, "Demand")], -20, "closed_inferred"),
    ([(-5, "Active"), (-3, "Demand")], 365243, "unknown"),
])
def test_end_states(spark, rows, termination, state):
    b = raw_book(spark, pos=[(1, 1, m, 6.0, 6.0, s, 0, 0) for m, s in rows],
                 apps=[dict(sk_id_prev=1, sk_id_curr=1, days_termination=termination)])
    assert b.dim_loan.first()["end_state"] == state


def test_fact_keeps_months_after_closing_and_drops_months_before_opening(spark):
    b = raw_book(spark, pos=[(1, 1, -6, 6.0, 6.0, "Signed", 0, 0), (1, 1, -5, 6.0, 6.0, "Active", 0, 0),
                             (1, 1, -4, 6.0, 0.0, "Completed", 0, 0), (1, 1, -3, 6.0, 0.0, "Completed", 0, 0)])
    assert sorted(r["mob"] for r in b.fct_loan_month.collect()) == [0, 1, 2]


def test_delay_columns(spark):
    days = [None, 0, 1, 9, 10, 30, 31, 60, 61, 90, 91, 180, 181, 360, 361]
    b = raw_book(spark, pos=[(1, 1, -50 + i, 6.0, 6.0, "Active", x, x) for i, x in enumerate(days)])
    rows = b.fct_loan_month.orderBy("mob").collect()
    assert [r["dpd_bucket_order"] for r in rows] == [None, 0, 1, 1, 1, 1, 2, 2, 3, 3, 4, 4, 4, 4, 4]
    assert [r["debt_group_vn"] for r in rows] == [None, 1, 1, 1, 2, 2, 2, 2, 2, 2, 3, 3, 4, 4, 5]
    assert rows[0]["dpd_bucket"] is None and rows[0]["is_30_plus"] is None and rows[6]["is_30_plus"]


def test_exposure(spark):
    card = [dict(sk_id_prev=2, sk_id_curr=1, months_balance=-m, amt_balance=x, name_contract_status="Active", sk_dpd=0,
                 sk_dpd_def=0) for m, x in ((4, -5.0), (3, 8.0), (2, None))]
    b = raw_book(spark, card=card, pos=[(1, 1, -4, 6.0, 3.0, "Active", 0, 0), (3, 1, -4, 6.0, 3.0, "Active", 0, 0)],
                 apps=[dict(sk_id_prev=1, sk_id_curr=1, amt_annuity=100.0)])
    got = {(r["sk_id_prev"], r["months_balance"]): r["exposure_proxy"] for r in b.fct_loan_month.collect()}
    assert got == {(1, -4): 300.0, (3, -4): None, (2, -4): 0.0, (2, -3): 8.0, (2, -2): None}


def test_transition_states(spark):
    b = raw_book(spark, pos=[
        (1, 1, -6, 6.0, 6.0, "Active", 0, 0), (1, 1, -5, 6.0, 5.0, "Active", 35, 35),
        (1, 1, -4, 6.0, 0.0, "Completed", 0, 0),
        (2, 1, -6, 6.0, 6.0, "Active", 0, 0), (2, 1, -4, 6.0, 6.0, "Active", 0, 0),
        (2, 1, -3, 6.0, 6.0, "Canceled", 0, 0),
        (3, 1, -2, 6.0, 6.0, "Active", 0, 0), (3, 1, -1, 6.0, 6.0, "Active", 0, 0)])
    cells = defaultdict(int)
    for r in b.roll_rate.collect():
        cells[r["from_state"], r["to_state"], r["n_month_gap"]] += r["n_loans"]
    assert cells == {("B0 Current", "B2 31-60", 0): 1, ("B2 31-60", "Closed", 0): 1, ("B0 Current", "Missing", 1): 1,
                     ("B0 Current", "Other", 0): 1, ("B0 Current", "B0 Current", 0): 1}


def test_vintage_matches_a_plain_count(spark, book):
    """Mart against a loop over contracts and ages."""
    want = defaultdict(lambda: [0, 0, 0, 0])
    for r in core.vintage_base(book.loan_outcome).collect():
        for mob in range(37):
            if mob <= r["max_mob"] or r["end_state"] in ("closed", "closed_inferred"):
                w = want[mob]
                w[0] += 1
                w[1] += r["max_mob"] >= mob
                for i, c in ((2, "first_30_plus_mob"), (3, "first_30_plus_no_threshold_mob")):
                    w[i] += r[c] is not None and r[c] <= mob
    got = {r["mob"]: [r["n"], r["f"], r["k"], r["t"]] for r in book.vintage.groupBy("mob").agg(
        F.sum("n_loans").alias("n"), F.sum("n_observed_full").alias("f"), F.sum("n_ever_30_plus").alias("k"),
        F.sum("n_ever_30_plus_no_threshold").alias("t")).collect()}
    assert got == dict(want)


def test_median_matches_a_plain_one(spark):
    rng = random.Random(11)
    rows = [(g, v) for g in "abcdef" for v in
            [rng.choice([rng.uniform(-1e6, 1e6), float(rng.randint(-3, 3)), rng.lognormvariate(9, 4)])
             for _ in range(rng.randint(1, 400))]] + [("n", None), ("a", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(7)
    got = {r["g"]: r["m"] for r in grouped_median(df, ["g"], "v", "m").collect()}
    values = defaultdict(list)
    for g, v in rows:
        if v is not None:
            values[g].append(v)
    for g, vs in values.items():
        vs.sort()
        lo, hi = vs[(len(vs) - 1) // 2], vs[len(vs) // 2]
        assert got[g] == lo + (hi - lo) * 0.5
    assert set(got) == set(values)


def test_lazy_and_written_books_agree(spark, book):
    lazy = LoanBook(spark, book.raw, book.d)
    for name in ("dim_loan", "vintage", "portfolio_snapshot", "funnel_by_channel", "fpd_by_segment", "roll_rate"):
        a, b = getattr(lazy, name), getattr(book, name)
        assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0, name


def test_definitions_are_parameters(spark, book):
    """Labels follow the definitions object, down to the cohort labels."""
    d = Definitions(no_application="(không rõ)", small_channel_group="Khác", cohort_separator=" đến ")
    cells = LoanBook(spark, book.raw, d).vintage
    got = cells.select("channel_type").distinct().toPandas()["channel_type"]
    assert {"(không rõ)", "Khác"} <= set(got)
    assert cells.where("origination_cohort = '-96 đến -85'").count() > 0


def test_shares_of_the_matrix(book):
    rows = book.roll.groupBy("definition", "source", "contract_type", "channel_type", "from_state").agg(
        F.sum("roll_rate").alias("s")).where(F.abs(F.col("s") - 1) > 1e-9)
    assert rows.count() == 0
    assert marts.of_definition(book.roll, "primary").agg(F.sum("n_loans")).first()[0] == \
        marts.of_definition(book.roll, "no_threshold").agg(F.sum("n_loans")).first()[0]


def test_money_sums_neither_cut_nor_overflow(spark):
    small = spark.createDataFrame([(0.00004,), (0.00004,)], "a double")
    assert small.select(exact_sum(F.col("a"))).first()[0] == 0.00008
    large = spark.createDataFrame([(6e16,), (6e16,), (1e20,)], "a double")
    assert large.select(exact_sum(F.col("a"))).first()[0] == 1e20 + 1.2e17


def test_median_of_tiny_values_uses_many_bins(spark):
    rows = [("a", i * 1e-7) for i in range(1, 1001)] + [("b", float("nan")), ("b", 5.0), ("c", -2.0), ("c", 0.0),
                                                       ("c", float("inf")), ("d", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r["m"] for r in grouped_median(df, ["k"], "v", "m").collect()}
    assert got["a"] == pytest.approx(500.5e-7) and got["b"] == 5.0 and got["c"] == 0.0 and "d" not in got
