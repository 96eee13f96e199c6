"""Readers, writers and the store."""

import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearview import jobs
from arrearview.book import LoanBook
from arrearview.plans.findings import findings
from arrearview.sources import exports, raw
from arrearview.sources.raw import whole
from arrearview.sources.store import ForeignDatabase, TableStore, shared_folder


def test_missing_inputs_are_all_named(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x\n1\n")
    with pytest.raises(raw.MissingInput) as e:
        raw.read_csv(spark, {"pos_cash_balance": f"{tmp_path}/p.csv", "credit_card_balance": f"{tmp_path}/c.csv"})
    assert "pos_cash_balance" in str(e.value) and "credit_card_balance" in str(e.value)


def test_csv_header_in_any_case_and_order(spark, tmp_path):
    path = tmp_path / "pos.csv"
    path.write_text("MONTHS_BALANCE,SK_ID_PREV,EXTRA,SK_ID_CURR,CNT_INSTALMENT,CNT_INSTALMENT_FUTURE,"
                    "NAME_CONTRACT_STATUS,SK_DPD,SK_DPD_DEF\n-3.0,7,zz,9,12.0,,Active,5.0,0\n")
    df = raw.read_csv(spark, {"pos_cash_balance": str(path)})["pos_cash_balance"]
    assert df.schema == raw.schema("pos_cash_balance")
    assert tuple(df.first()) == (7, 9, -3, 12.0, None, "Active", 5, 0)


def test_csv_that_does_not_parse_stops(spark, tmp_path):
    path = tmp_path / "pos.csv"
    head = ",".join(raw.schema("pos_cash_balance").names)
    for bad in ("1,1,x,12,3,Active,0,0", "1,1,-3,twelve,3,Active,0,0"):
        path.write_text(f"{head}\n{bad}\n")
        with pytest.raises(Exception):
            raw.read_csv(spark, {"pos_cash_balance": str(path)})["pos_cash_balance"].collect()


def test_job_from_csv_to_exports(spark, book, tmp_path):
    """The command line job, end to end."""
    for table, name in raw.CSV_FILES.items():
        df = book.raw[table]
        df.toDF(*[c.upper() for c in df.columns]).write.option("header", True).csv(f"{tmp_path}/raw/{name}")
    lines = []
    jobs.run(spark, jobs.parse(["--csv", f"{tmp_path}/raw", "--out", f"{tmp_path}/out", "--prefix", "job_"]), lines.append)
    assert sum(x.startswith("raw.") and x.endswith(" rows") for x in lines) == 5
    status = {x.split()[1]: x.split()[0] for x in lines if x.split()[0] in ("pass", "warn")}
    assert len(status) == 32
    shown = [x.split()[0].rstrip(":") for x in lines if x.startswith("  known_")]
    assert set(shown) == {c for c, s in status.items() if s == "warn"} and all(shown.count(c) <= 5 for c in shown)
    for mart in jobs.EXPORTED:
        assert os.path.exists(f"{tmp_path}/out/mart_{mart}/_SUCCESS")
    assert exports.read_findings(spark, f"{tmp_path}/out/findings").count() > 1000
    vintage = exports.read_csv(spark, f"{tmp_path}/out/mart_vintage", book.vintage.schema)
    assert vintage.exceptAll(book.vintage).count() == 0 and vintage.count() == book.vintage.count()


def test_csv_without_a_needed_column(spark, tmp_path):
    path = tmp_path / "pos.csv"
    path.write_text("SK_ID_PREV\n1\n")
    with pytest.raises(raw.MissingInput, match="months_balance"):
        raw.read_csv(spark, {"pos_cash_balance": str(path)})


def test_export_is_sorted_and_typed(spark, book, tmp_path):
    path = str(tmp_path / "snap")
    exports.write_csv(book.portfolio_snapshot, path)
    parts = sorted(f for f in os.listdir(path) if f.endswith(".csv"))
    lines = [x for f in parts for x in open(f"{path}/{f}", encoding="utf-8").read().splitlines()[1:]]
    keys = [x.split(",")[:3] for x in lines]
    assert keys == sorted(keys) and len(keys) == book.portfolio_snapshot.count()
    back = exports.read_csv(spark, path, book.portfolio_snapshot.schema)
    assert back.exceptAll(book.portfolio_snapshot).count() == 0


def test_findings_round_trip(spark, book, tmp_path):
    doc = findings(book)
    exports.write_findings(doc, str(tmp_path / "f"))
    back = exports.read_findings(spark, str(tmp_path / "f"))
    assert back.count() == doc.count() > 1000
    row = back.where("section = 'portfolio_totals' and measure = 'n_loans'").collect()
    assert len(row) == 1 and row[0]["value"] == book.dim_loan.count() and row[0]["dims"] == {}
    assert back.where("section = 'channel_smr' and mob = 12 and dims['channel_type'] = 'Stone' "
                      "and dims['definition'] = 'primary' and measure = 'oe.smr'").count() == 1


def test_shared_folder_follows_the_session(spark):
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    assert shared_folder(spark) == (folder or shared_folder(spark))


def test_buckets_follow_the_rows(spark):
    store = TableStore(spark, prefix="sized_")
    store.fit_rows(10)
    assert store.buckets == min(8, spark.sparkContext.defaultParallelism)
    store.buckets = None
    store.fit_rows(2_000_000 * 500 + 1)
    assert store.buckets == 501
    store.drop()


def test_store_layers_and_buckets(spark, book):
    store = TableStore(spark, prefix="unit_", buckets=4)
    b = LoanBook(spark, book.raw, book.d, store)
    assert b.dim_loan.count() == book.dim_loan.count()
    assert {"unit_raw", "unit_stg", "unit_core", "unit_mart"} <= {d.name for d in spark.catalog.listDatabases()}
    files = [f for f in os.listdir(f"{store.folder.removeprefix('file:')}/core/{store.named('dim_loan')}") if f.endswith(".parquet")]
    assert len(files) == 4
    b.store.keep("core", "dim_loan", book.dim_loan.limit(3))
    assert spark.table(store.table("core", "dim_loan")).count() == 3
    store.drop()
    assert not os.path.exists(f"{store.folder.removeprefix('file:')}/core/{store.named('dim_loan')}")
    assert "unit_core" not in {d.name for d in spark.catalog.listDatabases()}


def test_buckets_stay_within_the_session_limit(spark):
    store = TableStore(spark, prefix="huge_")
    store.fit_rows(300_000_000_000)
    assert store.buckets == int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    store.drop()


def test_a_foreign_database_is_left_alone(spark):
    spark.sql("create database other_core")
    spark.range(3).write.saveAsTable("other_core.own")
    try:
        with pytest.raises(ForeignDatabase):
            TableStore(spark, prefix="other_")
        assert spark.table("other_core.own").count() == 3 and not spark.catalog.databaseExists("other_raw")
    finally:
        spark.sql("drop table other_core.own")
        spark.sql("drop database other_core")


def test_drop_keeps_tables_the_store_did_not_write(spark):
    store = TableStore(spark, prefix="mixed_", buckets=2)
    store.keep("core", "t", spark.range(3))
    spark.range(2).write.saveAsTable("mixed_core.own")
    store.drop()
    assert [t.name for t in spark.catalog.listTables("mixed_core")] == ["own"]
    assert not spark.catalog.databaseExists("mixed_mart")
    spark.sql("drop table mixed_core.own")
    spark.sql("drop database mixed_core")


@pytest.mark.parametrize("text,value", [("12", 12), ("12.0", 12), (" -3.00", -3), ("1e2", 100), ("", None), (None, None),
                                        ("9007199254740993", 9007199254740993)])
def test_whole_numbers_in_text(spark, text, value):
    df = spark.createDataFrame([(text,)], "n string").select(F.nullif("n", F.lit("")).alias("n"))
    assert df.select(whole("n", T.LongType())).first()[0] == value


@pytest.mark.parametrize("text", ["12.7", "1e-3", "9007199254740993.5", "x"])
def test_a_fraction_stops_the_load(spark, text):
    with pytest.raises(Exception):
        spark.createDataFrame([(text,)], "n string").select(whole("n", T.LongType())).collect()
