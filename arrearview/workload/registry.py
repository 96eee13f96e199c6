"""Registered queries: a Spark callable over the loan book and the DuckDB check of its result."""

from __future__ import annotations

import atexit
import hashlib
import os
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearview.book import LoanBook
from arrearview.params import Definitions
from arrearview.sources.star import lending_tables
from arrearview.sources.store import TableStore
from arrearview.workload.oracle_base import rounding, with_ctes

# The reference sample of 1,000 would blank nearly every ratio at the small scale factors.
WORKLOAD = Definitions(min_n=30)
DIGITS = 6
# Mean months of a derived contract, to size the buckets from the number of orders.
MONTHS_PER_CONTRACT = 20

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}
BODIES: dict[str, str] = {}
_BOOKS: dict[tuple, LoanBook] = {}


def _stamp(star_dir: str) -> tuple:
    """Identity of the input files, so that replaced files are never served from an older book."""
    try:
        files = sorted(e.path for e in os.scandir(star_dir) if e.name.split(".")[0] in ("orders", "customer"))
        return tuple((p, os.stat(p).st_mtime_ns, os.stat(p).st_size) for p in files)
    except OSError:
        return ()


def drop_books() -> None:
    """Remove the tables of all books, where their session still runs."""
    while _BOOKS:
        _, b = _BOOKS.popitem()
        if b.spark.sparkContext._jsc is not None:
            b.store.drop()


atexit.register(drop_books)


def book(spark: SparkSession, star_dir: str) -> LoanBook:
    """The loan book of one directory; its tables are written once per application."""
    star_dir = star_dir.rstrip("/")
    key = (spark.sparkContext.applicationId, star_dir, _stamp(star_dir))
    if key not in _BOOKS:
        prefix = "book_" + hashlib.sha1(repr(key).encode()).hexdigest()[:10] + "_"
        store = TableStore(spark, prefix=prefix)
        store.fit_rows(spark.read.parquet(f"{star_dir}/orders.parquet").count() * MONTHS_PER_CONTRACT)
        _BOOKS[key] = LoanBook(spark, lending_tables(spark, star_dir), WORKLOAD, store)
    return _BOOKS[key]


def _rounded(c: Column) -> Column:
    """Six digits; a first step to twelve settles values that differ from a tie by the last bit only."""
    return F.when(F.abs(c) < 1000, F.round(F.round(c, 12), DIGITS)).otherwise(F.round(c, DIGITS))


def flat(df: DataFrame) -> DataFrame:
    """Struct columns spread to `column_field`, doubles rounded, everything else left as it is."""
    out = []
    for f in df.schema.fields:
        if isinstance(f.dataType, T.StructType):
            out += [(F.col(f"`{f.name}`.`{g.name}`"), f"{f.name}_{g.name}", g.dataType) for g in f.dataType.fields]
        else:
            out.append((F.col(f"`{f.name}`"), f.name, f.dataType))
    return df.select(*[(_rounded(c) if isinstance(t, T.DoubleType) else c).alias(n) for c, n, t in out])


def query(name: str, sql: str | None = None, *rounded: str):
    """Register `fn(book)` under a name, with its check."""
    def register(fn: Callable[[LoanBook], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query registered twice: {name}")
        QUERIES[name] = lambda spark, star_dir: flat(fn(book(spark, star_dir)))
        if sql is not None:
            BODIES[name] = sql
            CHECKS[name] = with_ctes(rounding(sql, *rounded))
        return fn

    return register
