"""Builds and their publication."""

import os

import pytest
from pyspark.sql import functions as F

from arrearview import jobs
from arrearview.book import LoanBook
from arrearview.params import Definitions
from arrearview.plans import quality
from arrearview.sources import raw
from arrearview.sources.store import POINTER, NotInBuild, NothingPublished, SmallFiles, TableStore


def job(spark, tmp_path, *more, prefix="pub_"):
    lines = []
    args = ["--parquet", f"{tmp_path}/raw", "--warehouse", f"{tmp_path}/house", "--prefix", prefix, "--min-n", "30", *more]
    return jobs.run(spark, jobs.parse(args), lines.append), lines


@pytest.fixture(scope="module")
def house(spark, book, tmp_path_factory):
    """Raw tables as parquet, and a published build of them."""
    path = tmp_path_factory.mktemp("house")
    for table in raw.RAW_TABLES:
        book.raw[table].write.parquet(f"{path}/raw/{table}.parquet")
    first, lines = job(spark, path)
    yield path, first, lines
    for version in list({t.store.version: t.store for t in [first]}.values()):
        version.drop()


def contents(book):
    return {n: sorted(map(repr, getattr(book, n).collect())) for n in ("dim_loan", "vintage", "portfolio_snapshot")}


def files_of(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/house") for f in fs}


def opened(spark, path):
    store = TableStore.open(spark, f"{path}/house", "pub_")
    tables = raw.read_parquet(spark, {t: f"{path}/raw/{t}.parquet" for t in raw.RAW_TABLES})
    return LoanBook(spark, tables, store.definitions, store)


def test_small_files(spark, tmp_path):
    files = SmallFiles(spark, str(tmp_path))
    assert files.read("a/b") is None
    for text in ("one", "two é\n" * 3):
        files.write("a/b", text)
        assert files.read("a/b") == text
    assert [f for f in os.listdir(tmp_path / "a") if not f.startswith(".")] == ["b"]


def test_nothing_published(spark, tmp_path):
    with pytest.raises(NothingPublished):
        TableStore.open(spark, str(tmp_path), "none_")


def test_manifest_and_views(spark, house):
    path, first, lines = house
    assert lines[-1] == f"published {first.store.version}" == "published " + open(f"{path}/house/{POINTER}").read()
    book = opened(spark, path)
    assert book.d == Definitions(min_n=30) and contents(book) == contents(first)
    counted = {(t["layer"], t["name"]): t["rows"] for t in book.store.published["tables"]}
    assert counted[("core", "dim_loan")] == first.dim_loan.count() == spark.table("pub_core.dim_loan").count()
    assert {i["table_name"] for i in book.store.published["inputs"]} == set(raw.RAW_TABLES)
    with pytest.raises(NotInBuild):
        book.store.keep("mart", "of_another_build", spark.range(1))


def test_a_session_without_the_tables_declares_them(spark, house):
    """What a new application sees: the files and the manifest, but no tables in its catalog."""
    path, first, _ = house
    entries = TableStore.open(spark, f"{path}/house", "pub_").published["tables"]
    store = TableStore.open(spark, f"{path}/house", "pub_")
    store.prefix = "fresh_"
    for layer in ("raw", "stg", "core", "mart"):
        spark.sql(f"create database fresh_{layer}")
    try:
        for entry in entries:
            store._declare(entry)
            target = store.table(entry["layer"], entry["name"])
            assert spark.table(target).count() == entry["rows"], entry["name"]
        by_contract = spark.table(store.table("core", "fct_loan_month")).groupBy("sk_id_prev").count()
        assert "Exchange" not in by_contract._jdf.queryExecution().executedPlan().toString()
        assert by_contract.count() == first.fct_loan_month.select("sk_id_prev").distinct().count()
    finally:
        for layer in ("raw", "stg", "core", "mart"):
            spark.sql(f"drop database fresh_{layer} cascade")


def test_checks_only_writes_nothing(spark, house):
    path, first, _ = house
    before = files_of(path)
    book, lines = job(spark, path, "--checks-only")
    assert files_of(path) == before and book.store.version == first.store.version
    assert sum(x.split()[0] in ("pass", "warn") for x in lines) == 32
    assert f"core.dim_loan {first.dim_loan.count()} rows" in lines
    with pytest.raises(SystemExit):
        jobs.parse(["--parquet", "x", "--checks-only"])


def test_a_failing_rebuild_leaves_the_old_book_whole(spark, house, monkeypatch):
    path, first, _ = house
    old, before = contents(first), files_of(path)

    def broken(self, by_name=None):
        raise RuntimeError("in the middle")

    monkeypatch.setattr(LoanBook, "roll_rate", property(broken))
    with pytest.raises(RuntimeError, match="in the middle"):
        job(spark, path)
    monkeypatch.undo()
    assert contents(opened(spark, path)) == old and {k: v for k, v in files_of(path).items() if k in before} == before
    assert spark.table("pub_core.dim_loan").count() == first.dim_loan.count()
    left = {t.name for t in spark.catalog.listTables("pub_core")}
    assert all(n.endswith(first.store.version) or "__" not in n for n in left)

    def failing(b):
        raise quality.QualityError("a check")

    monkeypatch.setattr(quality, "enforce", failing)
    with pytest.raises(quality.QualityError):
        job(spark, path)
    assert contents(opened(spark, path)) == old


def test_a_rebuild_moves_all_names_and_drops_what_is_older(spark, house, tmp_path):
    path, first, _ = house
    second, _ = job(spark, path)
    assert opened(spark, path).store.version == second.store.version != first.store.version
    assert contents(first) == contents(second)  # a reader of the build before still has it
    third, _ = job(spark, path)
    names = {t.name for t in spark.catalog.listTables("pub_core")}
    assert not any(n.endswith(first.store.version) for n in names)
    assert {n.rsplit("__", 1)[1] for n in names if "__" in n} == {second.store.version, third.store.version}
    assert spark.table("pub_core.dim_loan").count() == third.dim_loan.count()
    for b in (second, third):
        b.store.drop()
    with pytest.raises(NothingPublished):
        opened(spark, path)


def test_two_applications_of_a_contract_stop_the_book(spark, book):
    """The constraint is in the plan of the dimension, lazily or kept."""
    twice = dict(book.raw)
    some = book.raw["previous_application"].where(F.col("sk_id_prev") == book.dim_loan.where("has_application").agg(
        F.min("sk_id_prev")).first()[0])
    twice["previous_application"] = book.raw["previous_application"].unionByName(some)
    store = TableStore(spark, prefix="twice_")
    for kept in (None, store):
        with pytest.raises(Exception, match="several rows of sk_id_prev"):
            LoanBook(spark, twice, book.d, kept).dim_loan.agg(F.count("contract_type")).collect()
    store.drop()
