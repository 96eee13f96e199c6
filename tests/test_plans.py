"""Physical plans: where the data moves, and where it must not."""

import re
import uuid

import pytest

from arrearview.book import LoanBook
from arrearview.plans import core, marts
from arrearview.sources.raw import RAW_TABLES, schema
from arrearview.sources.store import TableStore, settings
from arrearview.workload import QUERIES


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(autouse=True)
def no_automatic_broadcast(spark):
    """Small test tables must not hide a shuffle behind a broadcast."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.maxMetadataStringLength": "5000"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def shuffles(df):
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan(df))


def test_copies_are_reduced_before_they_move(book):
    text = plan(core.int_loan_month(book.stg("credit_card_balance"), book.stg("pos_cash_balance"), book.d, 8))
    assert text.count("WindowGroupLimit") == 2
    first, second = (m.start() for m in re.finditer("WindowGroupLimit", text))
    assert first < text.index("Exchange hashpartitioning", first) < second
    assert len(re.findall("Exchange hashpartitioning", text)) == 2


def test_fact_and_outcome_do_not_shuffle_the_panel(book):
    assert shuffles(core.fct_loan_month(book.int_loan_month, book.dim_loan, book.d)) == []
    assert shuffles(core.loan_outcome(book.fct_loan_month, book.dim_loan, book.d)) == []


def test_dimension_shuffles_applications_only(book):
    text = plan(core.dim_loan(book.int_loan_month, book.stg("previous_application"), book.d))
    assert len(re.findall("Exchange hashpartitioning", text)) == 1 and "Bucketed: true" in text


def test_matrix_shuffles_grouped_cells_only(book):
    moved = shuffles(marts.transition_base(book.fct_loan_month, book.dim_loan, book.d))
    assert moved and all("sk_id_prev" not in m for m in moved)


def test_a_month_is_one_partition(book):
    """Whatever reads the open portfolio of a month reads that month's files only."""
    from arrearview.plans import experiments, portfolio, quality

    month = re.compile(r"PartitionFilters: \[[^\]]*months_balance#\d+ = -1\)")
    for df in (marts.portfolio_snapshot(book.open_months, book.d), portfolio.exposure_missing(book.open_months, book.d),
               portfolio.snapshot_by_source(book.open_months, book.d, -1), experiments.late_timing(book.open_months, book.d),
               portfolio.snapshot_buckets(book.portfolio_snapshot, book.open_months, book.d),
               quality._snapshot_reconcile(book)):
        text = plan(df)
        assert month.search(text) and "fct_loan_month" not in text and "dim_loan" not in text
        assert "Exchange hashpartitioning(sk_id_prev" not in text
    one = marts.at_month(book.open_months, book.d)
    assert {f.rsplit("/", 2)[1] for f in one.inputFiles()} >= {"months_balance=-1"}
    scanned = one._jdf.queryExecution().executedPlan().toString()
    assert "months_balance" in scanned.split("PartitionFilters")[1][:80]


def test_open_months_are_the_open_rows_of_the_fact(book):
    keys = ["sk_id_prev", "months_balance", "mob", "dpd_bucket", "exposure_proxy"]
    kept, fact = book.open_months.select(*keys), book.fct_loan_month.where("is_open").select(*keys)
    assert kept.exceptAll(fact).count() == fact.exceptAll(kept).count() == 0


def test_successive_months_are_sorted_once(book):
    """One window over the fact per book: matrices and cures are sums over the kept cells."""
    from arrearview.plans import transitions

    text = plan(marts.transition_base(book.fct_loan_month, book.dim_loan, book.d))
    assert len(re.findall(r"\bWindow \[", text)) == 1
    for df in (marts.transition_cells(book.transition_base), transitions.cure_by_cohort(book.transition_base, book.d),
               transitions.cure_by_cohort_pooled(book.transition_base, book.d),
               transitions.first_b1_sample(book.transition_base, book.d)):
        assert "fct_loan_month" not in plan(df) and "dim_loan" not in plan(df)


def test_first_instalment_filter_reaches_the_scan(spark, tmp_path):
    raw = {t: spark.createDataFrame([], schema(t)) for t in RAW_TABLES}
    raw["installments_payments"].write.parquet(str(tmp_path / "i"))
    raw["installments_payments"] = spark.read.parquet(str(tmp_path / "i"))
    text = plan(marts.first_instalment(LoanBook(spark, raw).stg("installments_payments"), LoanBook(spark, raw).d))
    assert "EqualTo(num_instalment_number,1)" in text and "sk_id_curr" not in text


def test_vintage_spreads_groups_not_contracts(book):
    text = plan(marts.vintage(book.loan_outcome, book.d))
    assert text.index("Generate explode") < text.index("Exchange hashpartitioning", text.index("Generate explode"))


def test_no_query_pairs_rows_by_brute_force(spark, star_dir):
    for name, q in QUERIES.items():
        text = plan(q(spark, star_dir)) if name not in ("load_audit", "findings") else ""
        assert not re.search("CartesianProduct|BroadcastNestedLoopJoin|BatchEvalPython", text), name


def test_open_months_move_once(book):
    text = plan(core.open_months(book.fct_loan_month, book.loan_outcome, book.d))
    assert "Exchange" not in text and "Bucketed: false" not in text


def scans(df, table):
    return len(re.findall(rf"FileScan parquet [^\n]*{table}", plan(df)))


def test_funnel_and_first_payments_read_their_sources_once(spark, tmp_path):
    raw = {}
    for t in RAW_TABLES:
        spark.createDataFrame([], schema(t)).write.parquet(str(tmp_path / f"raw_{t}"))
        raw[t] = spark.read.parquet(str(tmp_path / f"raw_{t}"))
    b = LoanBook(spark, raw)
    assert scans(b.application_amounts, "raw_previous_application") == 1
    payments, applications = b.stg("installments_payments"), b.stg("previous_application")
    fpd = marts.fpd_by_segment(payments, applications, b.d)
    assert scans(fpd, "raw_installments_payments") == scans(fpd, "raw_previous_application") == 1
    assert sum("sk_id_prev" in m for m in shuffles(fpd)) == 3  # payments by version, by contract; applications


def test_open_months_are_written_where_they_lie(spark, tmp_path):
    """Rows kept by a column are sorted in the task that made them: no exchange before the write."""
    store = TableStore(spark, str(tmp_path / "kept"), f"kept{uuid.uuid4().hex[:6]}_", 2)
    rows = spark.range(0, 1000, 1, 4).selectExpr("id as sk_id_prev", "cast(-(id % 5) as int) as months_balance")
    try:
        kept = store.keep("core", "kept", rows, by="months_balance")
        seen = sorted(f.rsplit("/", 2)[1] for f in kept.inputFiles())
        assert seen == sorted(f"months_balance={-m}" for m in range(5) for _ in range(4))
        assert kept.exceptAll(rows).count() == rows.exceptAll(kept).count() == 0
    finally:
        store.drop()


def test_marts_do_not_write_the_fact_on_the_way(spark, star_dir, book, tmp_path):
    """What a mart reads once is planned over the panel; a build writes it, and then it is read."""
    store = TableStore(spark, str(tmp_path / "alone"), f"alone{uuid.uuid4().hex[:6]}_", 2)
    alone = LoanBook(spark, book.raw, book.d, store)
    try:
        got = {n: sorted(map(repr, getattr(alone, n).collect())) for n in ("roll", "vintage", "open_months")}
        assert {t["name"] for t in store.made.values()} == {
            "int_loan_month", "dim_loan", "transition_base", "roll", "vintage", "open_months"}
        _ = alone.fct_loan_month, alone.loan_outcome
        read = plan(marts.transition_base(alone._fact(), alone.dim_loan, alone.d))
        assert "fct_loan_month" in read and "loan_outcome" in plan(alone._outcome())
        for name, rows in got.items():
            want = {"roll": lambda: marts.roll_matrix(marts.transition_base(
                        alone.fct_loan_month, alone.dim_loan, alone.d), alone.d),
                    "vintage": lambda: marts.vintage(alone.loan_outcome, alone.d),
                    "open_months": lambda: core.open_months(alone.fct_loan_month, alone.loan_outcome, alone.d)}[name]()
            assert sorted(map(repr, want.select(getattr(alone, name).columns).collect())) == rows
    finally:
        store.drop()


def test_kept_tables_are_read_in_their_order(spark, tmp_path):
    """A bucket is one file in order: the plan of a kept table does not sort it again, and the session keeps its settings."""
    names = ("spark.sql.shuffle.partitions", "spark.sql.legacy.bucketedTableScan.outputOrdering")
    before = [spark.conf.get(n, None) for n in names]
    store = TableStore(spark, str(tmp_path / "order"), f"order{uuid.uuid4().hex[:6]}_", 11)
    rows = spark.range(0, 600, 1, 4).selectExpr("id % 50 as sk_id_prev", "cast(-(id div 50) as int) as months_balance")
    seen = []
    try:
        panel = store.keep("core", "panel", rows, by_contract=True)
        later = panel.selectExpr("*", "lead(months_balance) over (partition by sk_id_prev order by months_balance) as later")
        with settings(spark, **store._planned()):
            text = plan(later)
            seen.append(plan(rows.groupBy("sk_id_prev").count()))
        assert "Sort [" not in text and "Exchange" not in text
        assert "hashpartitioning(sk_id_prev" in seen[0] and ", 11)" in seen[0]
        kept = store.keep("core", "later", later, by_contract=True)
        assert kept.exceptAll(later).count() == later.exceptAll(kept).count() == 0
        assert [spark.conf.get(n, None) for n in names] == before
        with pytest.raises(RuntimeError), settings(spark, **store._planned()):
            raise RuntimeError
        assert [spark.conf.get(n, None) for n in names] == before
    finally:
        store.drop()


def test_panel_is_sorted_in_the_order_it_is_kept_in(book):
    text = plan(core.int_loan_month(book.stg("credit_card_balance"), book.stg("pos_cash_balance"), book.d, 8))
    last = next(line for line in text.splitlines() if "Sort [" in line)
    assert re.search(r"Sort \[sk_id_prev#\d+L? ASC NULLS FIRST, months_balance#\d+ ASC NULLS FIRST\]", last)


def test_orders_are_dealt_by_their_number(spark):
    from arrearview.sources import star

    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert star.spread(spark.range(10)).rdd.getNumPartitions() == least
    many = star.spread(spark.range(star.ORDERS_PER_TASK * (least + 3) + 1))
    assert many.rdd.getNumPartitions() == least + 4
