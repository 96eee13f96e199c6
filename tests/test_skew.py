"""A third of all rows on one key: same results as a plain count."""

import uuid
from collections import defaultdict

from pyspark.sql import functions as F

from arrearview.book import LoanBook
from arrearview.functions.aggregates import grouped_median
from arrearview.params import Definitions
from arrearview.plans import marts
from arrearview.sources.raw import RAW_TABLES, schema

D = Definitions()


def hot(spark, table, rows):
    return spark.createDataFrame(rows, schema(table)).repartition(16)


def test_hot_contract_in_the_panel(spark):
    """20,000 copies of one contract-month among 40,000 other rows."""
    copies = [(1, 1, -5, 12.0, 6.0, "Active", i % 97, i % 89) for i in range(20000)]
    others = [(k, k, -m, 12.0, 6.0, "Active", 0, 0) for k in range(2, 2002) for m in range(1, 21)]
    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["pos_cash_balance"] = hot(spark, "pos_cash_balance", copies + others)
    b = LoanBook(spark, raw)
    assert b.int_loan_month.count() == 1 + 40000
    r = b.int_loan_month.where("sk_id_prev = 1").first()
    assert r["dpd_def"] == 88 and r["dpd_raw"] == max(i % 97 for i in range(20000) if i % 89 == 88)


def test_hot_contract_in_the_payments(spark):
    rows, want = [], defaultdict(float)
    for i in range(20000):
        late = i % 60
        rows.append((1, 1, 1 + i % 3, 1, -900, -900 + late, 1e9, 1.25))
        if i % 3 == 0 and late <= 30:
            want["paid"] += 1.25
    rows += [(k, k, 1, 1, -900, -890, 100.0, 100.0) for k in range(2, 20002)]
    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["installments_payments"] = hot(spark, "installments_payments", rows)
    b = LoanBook(spark, raw)
    first = marts.first_instalment(b.stg("installments_payments"), D)
    assert first.count() == 20001
    r = first.where("sk_id_prev = 1").first()
    assert r["paid_in_grace"] == want["paid"] and r["max_days_late"] == 57
    mart = b.fpd_by_segment.agg(F.sum("n_loans"), F.sum("n_fpd30"), F.sum("n_fpd30_late_rule")).first()
    assert tuple(mart) == (20001, 1, 1)


def test_hot_segment_in_the_funnel(spark):
    """Half of the applications in one segment, with many distinct amounts."""
    s = schema("previous_application").names
    rows, amounts = [], []
    for i in range(20000):
        r = dict.fromkeys(s)
        r |= dict(sk_id_prev=i, sk_id_curr=i, name_contract_type="Cash loans", channel_type="Stone" if i % 2 else f"c{i % 40}",
                  name_client_type="New", name_yield_group="high", name_contract_status="Approved",
                  amt_credit=float((i * 7919) % 100003) / 4, flag_last_appl_per_contract="Y", nflag_last_appl_in_day=1)
        rows.append(tuple(r[n] for n in s))
        if i % 2:
            amounts.append(r["amt_credit"])
    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["previous_application"] = hot(spark, "previous_application", rows)
    cell = LoanBook(spark, raw).funnel_by_channel.where("channel_type = 'Stone'").first()
    amounts.sort()
    assert cell["n_applications"] == 10000
    assert cell["credit_amount_approved_median"] == (amounts[4999] + amounts[5000]) / 2
    assert cell["credit_amount_approved_total"] == sum(amounts)


def test_median_of_values_that_lie_close(spark):
    """Two million values in one bin, split until what a task orders is small."""
    n, seen = 2_000_000, []

    def keep(df, name):
        path = f"{spark.conf.get('spark.sql.warehouse.dir')}/median-{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = spark.read.parquet(path)
        seen.append((name, out))
        return out

    rows = spark.range(n).select(F.lit("g").alias("k"), (1 + F.col("id") * 2.0 ** -40).alias("x"))
    rows = rows.unionByName(spark.createDataFrame([("h", 1.0), ("h", 4.0), ("i", -2.0)], "k string, x double"))
    found = grouped_median(rows, ["k"], "x", "m", keep=keep, fits=5_000).collect()
    assert {r["k"]: r["m"] for r in found} == {"g": 1 + (n - 1) / 2 * 2.0 ** -40, "h": 2.5, "i": -2.0}
    bins = [df for name, df in seen if "bins" in name]
    assert bins[0].agg(F.max("_values")).first()[0] == n and bins[-1].agg(F.max("_values")).first()[0] <= 5_000
    assert len(bins) == 2 + (n // 1023 > 5_000)


def test_only_crowded_contracts_are_reduced_before_they_move(spark, tmp_path, monkeypatch):
    """A panel without them moves once; with them, or with rows that have no contract, it is the panel ranked as a whole."""
    from arrearview.plans import core
    from arrearview.sources.store import TableStore

    monkeypatch.setattr(core, "CROWDED_ROWS", 40)
    few = [(k, k, -m, 12.0, 6.0, "Active", (k * m + i) % 7, k % 3) for k in range(2, 60) for m in range(1, 9) for i in (0, 3)]
    many = [(k, 1, m, 12.0, 6.0, "Active", i % 97, i % 9) for k in (1, None) for m in (-5, -4, None) for i in range(200)]
    cards = [(k, k, -m, 1.0 * i, 9.0, None, None, None, None, None, None, "Active", i, 0)
             for k in (1, 5, None) for m in (2, 5) for i in range(30)]
    moved = "Exchange hashpartitioning(sk_id_prev"
    for pos, crowded in ((few, set()), (few + many, {1, 5, None})):
        raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
        raw["pos_cash_balance"] = hot(spark, "pos_cash_balance", pos)
        if crowded:
            raw["credit_card_balance"] = hot(spark, "credit_card_balance", cards)
        store = TableStore(spark, str(tmp_path / f"crowd{len(crowded)}"), f"crowd{uuid.uuid4().hex[:6]}_", 3)
        b, ranked = LoanBook(spark, raw, D, store), LoanBook(spark, raw, D)
        try:
            assert {r[0] for r in b._crowded.collect()} == crowded
            once = core.int_loan_month(*b._panels, D, 3, b._crowded)._jdf.queryExecution().executedPlan().toString()
            assert crowded or once.count(moved) == once.count("Sort [") == 1
            for name in ("int_loan_month", "source_months"):
                kept, whole = getattr(b, name), getattr(ranked, name)
                assert kept.exceptAll(whole).count() == whole.exceptAll(kept).count() == 0 < kept.count(), name
            folded = core.source_contracts(b.source_months)._jdf.queryExecution().executedPlan().toString()
            assert "Exchange" not in folded
        finally:
            store.drop()


def test_one_window_ranks_and_chooses_the_source(spark):
    """Rows in the bucket of their contract pass one window; months and contracts may be NULL, and cards go first."""
    from arrearview.plans import core

    pos = [(k, i, m, 12.0, 6.0, s, i * 7 % 5, i % 3) for k in (1, 2, 3, None) for m in (-3, -2, None)
           for i, s in enumerate(("Active", None, "Completed", "Active"))]
    cards = [(k, i, m, 1.0 * i, 9.0, None, None, None, None, None, None, "Active", i, 0)
             for k, m in ((2, -2), (2, -1), (3, None), (4, -5)) for i in range(3)]
    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["pos_cash_balance"], raw["credit_card_balance"] = hot(spark, "pos_cash_balance", pos), hot(
        spark, "credit_card_balance", cards)
    whole = LoanBook(spark, raw, D)
    nobody = core.crowded_contracts(*whole._panels).limit(0)
    panel = core.int_loan_month(*whole._panels, D, 3, nobody)
    text = panel._jdf.queryExecution().executedPlan().toString()
    assert text.count("Window [") == 1 and "WindowGroupLimit" not in text
    want = whole.int_loan_month
    assert panel.exceptAll(want).count() == want.exceptAll(panel).count() == 0
    months = {(r[0], r[1]): r[2] for r in panel.select("sk_id_prev", "months_balance", "source").collect()}
    assert len(months) == panel.count() == 10 and (2, -3) not in months
    assert {s for (k, _), s in months.items() if k in (2, 3, 4)} == {D.card_source}
