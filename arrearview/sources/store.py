"""Where built tables are kept, and how a build is published.

A kept table is written once to the cluster's shared folder and read back from there: a lost
executor then costs only the running tasks, never a rebuild of the layers below. Contract-grained
tables are bucketed by contract, so the joins and windows that follow need no shuffle; tables that
are read by month are partitioned by it.

A build has a version of its own, and its tables carry it in their names and folders: rebuilding
touches nothing that an earlier build wrote. `publish` writes the build's manifest and then renames
one small file over the pointer CURRENT, which moves all names at once; a build that fails before
that leaves the old one whole. `TableStore.open` follows the pointer.
"""

from __future__ import annotations

import json
import re
import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearview.params import Definitions

CONTRACT = "sk_id_prev"
LAYERS = ("raw", "stg", "core", "mart")
MARK = "written by a TableStore"
POINTER = "CURRENT"


class ForeignDatabase(ValueError):
    """A database of that name exists, and no TableStore made it there."""


class NothingPublished(ValueError):
    """The folder holds no published build."""


class NotInBuild(ValueError):
    """A published build is read as it is: it lacks this table, and nothing is written to it."""


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else one in the session's warehouse. Both are shared by all executors
    on a cluster; the session's settings stay as they are."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/arrearview"


# A bucket of the panel is one task's work in every later join and window: about 200 MB in memory, a sort of it some 360.
ROWS_PER_BUCKET = 2_000_000


_SETTINGS = threading.RLock()


@contextmanager
def settings(spark: SparkSession, **wanted: str) -> Iterator[None]:
    """Session settings for the time of one write; whatever the session had is put back."""
    with _SETTINGS:
        before = {k: spark.conf.get(k, None) for k in wanted}
        try:
            for k, v in wanted.items():
                spark.conf.set(k, v)
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class SmallFiles:
    """Text files of a folder in whatever file system Spark reads it from."""

    def __init__(self, spark: SparkSession, folder: str):
        self.gateway, self.jvm, self.folder = spark.sparkContext._gateway, spark._jvm, folder.rstrip("/")
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.path("").getFileSystem(self.conf)

    def path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}" if name else self.folder)

    def read(self, name: str) -> str | None:
        """The text of a file, None where there is none."""
        if not self.fs.exists(self.path(name)):
            return None
        stream = self.fs.open(self.path(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or none: it is written aside and renamed over the old one, which file systems do in one step."""
        aside = self.path(f"{name}.{uuid.uuid4().hex}")
        stream = self.fs.create(aside)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        over = self.gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf)
        context.rename(self.fs.makeQualified(aside), self.fs.makeQualified(self.path(name)), over)


class LazyStore:
    """Keeps nothing: every table stays a lazy plan over the raw tables."""

    buckets = None
    published = None

    def fit(self, *panels: DataFrame) -> None:
        """Nothing is written, so nothing needs sizing."""

    def step(self, layer: str) -> None:
        """Nothing is written in between, either."""

    def keep(self, layer: str, name: str, df: DataFrame, by_contract: bool = False, by: str | None = None) -> DataFrame:
        return df


class TableStore:
    """Writes every table in full into the databases raw, stg, core and mart behind a prefix, under this build's version.

    The databases live under `folder`; their tables are managed, so dropping removes the files. A
    database that exists already is used only if a store made it in the same folder; any other is
    left alone, and the store refuses to start. `buckets` is the number of contract buckets of the
    large tables; left out, it follows from the rows of the panel.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None, prefix: str = "arrearview_",
                 buckets: int | None = None):
        if not prefix:
            raise ValueError("a prefix is needed, so that the layers' databases are the store's own")
        self.spark = spark
        self.folder = folder or f"{shared_folder(spark)}/book-{uuid.uuid4().hex[:12]}"
        self.prefix = prefix
        self.buckets = buckets
        self.version = f"b{time.strftime('%Y%m%d%H%M%S', time.gmtime())}_{uuid.uuid4().hex[:8]}"
        self.published: dict | None = None  # the manifest, in a store that reads a published build
        self.made: dict[str, dict] = {}
        names = [f"{prefix}{layer}" for layer in LAYERS]
        for layer, name in zip(LAYERS, names):
            if spark.catalog.databaseExists(name) and not self._own(name, f"{self.folder}/{layer}"):
                raise ForeignDatabase(f"database {name} exists and is not this store's")
        for layer, name in zip(LAYERS, names):
            spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}` COMMENT '{MARK}' LOCATION '{self.folder}/{layer}'")

    @classmethod
    def open(cls, spark: SparkSession, folder: str, prefix: str = "arrearview_") -> TableStore:
        """The build that was published in a folder, to read. Its tables are named to the session where it lacks them."""
        files = SmallFiles(spark, folder)
        version = files.read(POINTER)
        if version is None:
            raise NothingPublished(f"no build was published in {folder}")
        manifest = json.loads(files.read(f"builds/{version}.json"))
        store = cls(spark, folder, prefix, manifest["buckets"])
        store.version, store.published = version, manifest
        for entry in manifest["tables"]:
            store._declare(entry)
        return store

    def _declare(self, entry: dict) -> None:
        """A written table, as a table of this session; the files stay as they are."""
        target = self.table(entry["layer"], entry["name"])
        if self.spark.catalog.tableExists(target):
            return
        schema = T.StructType.fromJson(entry["schema"])
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        clustered = (f"CLUSTERED BY ({CONTRACT}) SORTED BY ({', '.join(entry['sorted'])}) INTO {self.buckets} BUCKETS"
                     if entry["sorted"] else "")
        parted = f"PARTITIONED BY ({entry['by']})" if entry["by"] else ""
        place = f"{self.folder}/{entry['layer']}/{self.named(entry['name'])}"
        self.spark.sql(f"CREATE TABLE {target} ({columns}) USING parquet {parted} {clustered} LOCATION '{place}'")
        if entry["by"]:
            self.spark.sql(f"MSCK REPAIR TABLE {target}")

    def _own(self, name: str, folder: str) -> bool:
        found = self.spark.catalog.getDatabase(name)
        bare = lambda path: path.split(":", 1)[-1].replace("//", "/").rstrip("/")
        return found.description == MARK and bare(found.locationUri).endswith(bare(folder))

    @property
    def definitions(self) -> Definitions:
        """The definitions that a published build was made by."""
        given = self.published["definitions"]
        return Definitions(**{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})

    def fit_rows(self, rows: int) -> None:
        """Enough buckets to occupy every core, more when the panel is larger, never more than the session allows.

        Beyond that bound (2e11 rows at Spark's default) buckets hold more rows; the joins and
        windows on them sort, and spill what exceeds memory.
        """
        if self.buckets is None:
            least = min(int(self.spark.conf.get("spark.sql.shuffle.partitions")),
                        self.spark.sparkContext.defaultParallelism)
            most = int(self.spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
            self.buckets = min(most, max(least, -(-rows // ROWS_PER_BUCKET)))

    def fit(self, *panels: DataFrame) -> None:
        """Size the buckets by counting; for parquet tables the count comes from the file footers."""
        if self.buckets is None:
            self.fit_rows(sum(p.count() for p in panels))

    def named(self, name: str) -> str:
        return f"{name}__{self.version}"

    def table(self, layer: str, name: str) -> str:
        """The table as this build wrote it. The published build is also found without the version, as a view."""
        return f"`{self.prefix}{layer}`.`{self.named(name)}`"

    def keep(self, layer: str, name: str, df: DataFrame, by_contract: bool = False, by: str | None = None) -> DataFrame:
        """The table written and read back: bucketed by contract, or partitioned by a column of few values, or plain."""
        target = self.table(layer, name)
        if self.published is not None:
            if not any((t["layer"], t["name"]) == (layer, name) for t in self.published["tables"]):
                raise NotInBuild(f"{layer}.{name} is not in build {self.version}")
            return self.spark.table(target)
        in_order = [c for c in (CONTRACT, "months_balance") if c in df.columns] if by_contract else []
        if by_contract:
            # One task per bucket writes one sorted file; a plan already in this distribution
            # (built from bucketed tables) is not shuffled again.
            writer = (
                df.repartition(self.buckets, F.col(CONTRACT)).write
                .bucketBy(self.buckets, CONTRACT)
                .sortBy(*in_order)
            )
        elif by:
            # Every task sorts its rows by the column and writes a file for each value: the rows do not move.
            writer = df.write.partitionBy(by)
        else:
            writer = df.write
        made = {"layer": layer, "name": name, "sorted": in_order, "by": by}
        self.made[target] = made  # what a failed write leaves is dropped, too
        with settings(self.spark, **self._planned()):
            writer.format("parquet").option("compression", "zstd").mode("overwrite").saveAsTable(target)
        out = self.spark.table(target)
        made["schema"] = json.loads(out.schema.json())
        return out

    def _planned(self) -> dict[str, str]:
        """How the plan of a kept table is laid out: partitions of an exchange grow with the panel, as its buckets do, and
        the file of a bucket is read in the order it was written in, so what needs that order does not sort again."""
        least = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        return {"spark.sql.shuffle.partitions": str(max(least, self.buckets or 0)),
                "spark.sql.legacy.bucketedTableScan.outputOrdering": "true"}

    def step(self, layer: str) -> Callable[[DataFrame, str], DataFrame] | None:
        """How a plan writes what it needs to look at before it goes on; none in a published build, which is only read."""
        return None if self.published is not None else lambda df, name: self.keep(layer, name, df)

    def rows(self) -> list[tuple[str, str, int]]:
        """Layer, table and rows of what this build holds, counted from the tables."""
        entries = self.published["tables"] if self.published is not None else self.made.values()
        return sorted((t["layer"], t["name"], self.spark.table(self.table(t["layer"], t["name"])).count())
                      for t in entries)

    def publish(self, definitions: Definitions, inputs: list[dict] = ()) -> dict:
        """Make this build the one that readers find, whole. Returns its manifest.

        The pointer moves in one step; the views without a version, for SQL users, follow one by one. Tables of the build
        before stay for readers that have them open, older ones go.
        """
        counted = {(layer, name): n for layer, name, n in self.rows()}
        tables = [{**t, "rows": counted[t["layer"], t["name"]]} for t in self.made.values()]
        manifest = {"version": self.version, "buckets": self.buckets, "definitions": asdict(definitions),
                    "inputs": list(inputs), "tables": sorted(tables, key=lambda t: (t["layer"], t["name"]))}
        files = SmallFiles(self.spark, self.folder)
        before = files.read(POINTER)
        manifest["before"] = before
        files.write(f"builds/{self.version}.json", json.dumps(manifest, indent=1))
        files.write(POINTER, self.version)
        for t in tables:
            self.spark.sql(f"CREATE OR REPLACE VIEW `{self.prefix}{t['layer']}`.`{t['name']}` AS "
                           f"SELECT * FROM {self.table(t['layer'], t['name'])}")
        self._drop_older({self.version, before})
        return manifest

    def _drop_older(self, kept: set[str | None]) -> None:
        """Tables of builds that were published before those to keep, with their files."""
        files = SmallFiles(self.spark, self.folder)
        manifest = json.loads(files.read(f"builds/{self.version}.json"))
        while manifest is not None and manifest["version"] in kept:
            text = files.read(f"builds/{manifest['before']}.json") if manifest["before"] else None
            manifest = json.loads(text) if text else None
        while manifest is not None:
            for t in manifest["tables"]:
                name = f"{t['name']}__{manifest['version']}"
                self.spark.sql(f"DROP TABLE IF EXISTS `{self.prefix}{t['layer']}`.`{name}`")
                files.fs.delete(files.path(f"{t['layer']}/{name}"), True)
            files.fs.delete(files.path(f"builds/{manifest['version']}.json"), False)
            text = files.read(f"builds/{manifest['before']}.json") if manifest["before"] else None
            manifest = json.loads(text) if text else None

    def drop(self) -> None:
        """Remove the tables this build wrote, with their files, and the databases that are empty then.

        A published build is not removed by the store that reads it.
        """
        if self.published is not None:
            return
        for target, t in sorted(self.made.items()):
            view = f"`{self.prefix}{t['layer']}`.`{t['name']}`"
            if self.spark.catalog.tableExists(view) and self._views(view):
                self.spark.sql(f"DROP VIEW {view}")
            self.spark.sql(f"DROP TABLE IF EXISTS {target}")
        files = SmallFiles(self.spark, self.folder)
        if self.made and files.read(POINTER) == self.version:
            files.fs.delete(files.path(POINTER), False)
        self.made.clear()
        for layer in LAYERS:
            name = f"{self.prefix}{layer}"
            if self.spark.catalog.databaseExists(name) and not self.spark.catalog.listTables(name):
                self.spark.sql(f"DROP DATABASE `{name}`")

    def _views(self, view: str) -> bool:
        """Whether a view reads a table of this build."""
        text = self.spark.sql(f"SHOW CREATE TABLE {view}").first()[0]
        return re.search(rf"__{self.version}\b", text) is not None
