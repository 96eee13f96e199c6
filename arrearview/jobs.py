"""The batch job: load, build, check, publish, export. `python -m arrearview.jobs --csv DIR --out DIR`.

`--checks-only` runs the checks on the published build of `--warehouse` and writes nothing.
"""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Callable

from pyspark.sql import SparkSession

from arrearview.book import LoanBook
from arrearview.params import Definitions
from arrearview.plans.cohorts import reconcile
from arrearview.plans import quality
from arrearview.plans.findings import findings
from arrearview.sources import exports, raw
from arrearview.sources.star import lending_tables
from arrearview.sources.store import TableStore

EXPORTED = ("funnel_by_channel", "fpd_by_segment", "vintage", "roll_rate", "portfolio_snapshot")


def parse(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser(prog="arrearview", description=__doc__)
    source = p.add_mutually_exclusive_group(required=True)
    source.add_argument("--csv", help="folder of the five raw CSV files")
    source.add_argument("--parquet", help="folder of the five raw tables as parquet")
    source.add_argument("--star", help="folder of star tables to derive the raw tables from")
    p.add_argument("--out", help="folder of the exported marts and findings; nothing is exported without it")
    p.add_argument("--warehouse", help="folder of the written tables (default: in spark.checkpoint.dir)")
    p.add_argument("--prefix", default="arrearview_", help="prefix of the databases raw, stg, core and mart")
    p.add_argument("--buckets", type=int, help="contract buckets of the large tables (default: by rows)")
    p.add_argument("--min-n", type=int, default=Definitions.min_n, help="smallest group to interpret")
    p.add_argument("--checks-only", action="store_true", help="check the published build of --warehouse, without writes")
    args = p.parse_args(argv)
    if args.checks_only and (args.out or not args.warehouse):
        p.error("--checks-only needs --warehouse and exports nothing")
    return args


def load(spark: SparkSession, args: argparse.Namespace):
    if args.csv:
        return raw.read_csv(spark, raw.csv_folder(args.csv))
    if args.parquet:
        return raw.read_parquet(spark, {t: f"{args.parquet.rstrip('/')}/{t}.parquet" for t in raw.RAW_TABLES})
    return lending_tables(spark, args.star)


class ReconciliationFailed(ValueError):
    """Two ways to the same numbers disagree."""


def check(book: LoanBook, say: Callable[[str], None]) -> None:
    """All checks, with sample rows of the warnings; raises where an error-level one fails or a recount differs."""
    for row in quality.enforce(book).orderBy("check_name").collect():
        say(f"{row['status']} {row['check_name']} {row['n_violations']}")
        if row["status"] == "warn":
            for sample in quality.samples(book, row["check_name"]).collect():
                say(f"  {row['check_name']}: {sample.asDict()}")
    recount = reconcile(book.cohort_cells, book.vintage, book.d).first()
    if recount["n_mismatch"]:
        raise ReconciliationFailed(f"{recount['n_mismatch']} of {recount['n_cells_mart']} vintage cells differ from "
                                   "the recount by first open month")


def run(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None] = print) -> LoanBook:
    """Load, build and check, with sample rows of what was found; publish and export only a book that passed.

    A build that fails leaves the published one as it was, and its own tables are removed.
    """
    if args.checks_only:
        return checked(spark, args, say)
    store = TableStore(spark, args.warehouse, args.prefix, args.buckets)
    try:
        tables = load(spark, args)
        if args.csv:  # text is parsed once, everything later reads columns
            tables = {t: store.keep("raw", t, df) for t, df in tables.items()}
        audit = [row.asDict() for row in raw.load_audit(tables).collect()]
        for row in audit:
            say(f"raw.{row['table_name']} {row['n_rows']} rows")
        book = LoanBook(spark, tables, Definitions(min_n=args.min_n), store)
        clock = time.perf_counter()
        book.build(lambda name: say(f"built {name} at {time.perf_counter() - clock:.1f}s"))
        check(book, say)
        document = findings(book) if args.out else None
    except Exception:
        store.drop()
        raise
    say(f"published {store.publish(book.d, audit)['version']}")
    if args.out:
        for name in EXPORTED:
            exports.write_csv(getattr(book, name), f"{args.out}/mart_{name}")
        exports.write_findings(document, f"{args.out}/findings")
    return book


def checked(spark: SparkSession, args: argparse.Namespace, say: Callable[[str], None]) -> LoanBook:
    """The checks on the published build, as it is; raw tables that were parsed from text come from the build, too."""
    store = TableStore.open(spark, args.warehouse, args.prefix)
    for layer, name, n in store.rows():
        say(f"{layer}.{name} {n} rows")
    tables = {t: store.keep("raw", t, None) for t in raw.RAW_TABLES} if args.csv else load(spark, args)
    book = LoanBook(spark, tables, store.definitions, store)
    check(book, say)
    return book


if __name__ == "__main__":
    options = parse(sys.argv[1:])
    run(SparkSession.builder.appName("arrearview").getOrCreate(), options)
