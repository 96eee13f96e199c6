"""What the operators share: scratch tables in the cluster's shared folder, and words as arrays of hashes."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterator, Sequence

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word rule `[^\x20\x09-\x0D]+`; bytes.split() splits at exactly these characters.
SPACE = "[\\x20\\x09-\\x0D]+"


#: Spark then deletes the shuffle files of a query when the query ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Settings while a step is written: batches for Python workers are bounded in rows and bytes, and those of a scan in rows,
#: as a row can hold a long text or a large set of hashes.
WRITING = {CLEANUP: "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
           "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20), "spark.sql.parquet.columnarReaderBatchSize": "512"}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{table}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir; below the warehouse where that is unset, as in tests."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    top = top or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/llm-scratch"
    return f"{top.rstrip('/')}/{uuid.uuid4().hex}"


#: Scratch folders of this application that are still there, with the session that made them.
_LEFT: dict[str, SparkSession] = {}


def written(df: DataFrame) -> DataFrame:
    """The rows, written as Parquet in the shared folder and read back: lineage ends there, executors may go.

    The folder goes by `discard`, else when the application ends.
    """
    session, path = df.sparkSession, scratch(df.sparkSession)
    _LEFT[path] = session
    before = {key: session.conf.get(key, None) for key in WRITING}
    for key, value in WRITING.items():
        session.conf.set(key, value)
    try:
        df.write.parquet(path)
    finally:
        for key, value in before.items():
            session.conf.unset(key) if value is None else session.conf.set(key, value)
    out = session.read.schema(df.schema).parquet(path)
    out.scratch_folder = path
    return out


def _delete(session: SparkSession, folder: str) -> None:
    path = session._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(session._jsc.hadoopConfiguration()).delete(path, True)


def discard(df: DataFrame) -> None:
    """Delete the files of a table made by `written` that nothing reads any more."""
    folder = df.scratch_folder
    if _LEFT.pop(folder, None) is not None:
        _delete(df.sparkSession, folder)


@atexit.register
def discard_all() -> None:
    """Delete what is left of the scratch folders, where their session still runs."""
    while _LEFT:
        folder, session = _LEFT.popitem()
        if session.sparkContext._jsc is not None:
            _delete(session, folder)


def text_keys(text: Column) -> list[Column]:
    """128 bits that stand for a text."""
    text = F.coalesce(text, F.lit(""))
    return [F.xxhash64(text).alias("k1"), F.xxhash64(F.lit(1), text, F.length(text)).alias("k2")]


class Words(dict):
    """Numbers words as they come; `hashes` has a stable 64-bit hash of each."""

    LIMIT = 1 << 17

    def __init__(self) -> None:
        super().__init__()
        self.hashes = np.empty(1 << 12, np.uint64)

    def __missing__(self, word: bytes) -> int:
        n = len(self)
        if n == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.empty(n, np.uint64)])
        self.hashes[n] = xxhash.xxh64_intdigest(word)
        self[word] = n
        return n

    def of(self, words: Sequence[bytes]) -> np.ndarray:
        """The hashes of the words of one text."""
        if len(self) > self.LIMIT:  # a worker's memory stays bounded
            self.clear()
        numbers = np.fromiter(map(self.__getitem__, words), np.int64, len(words))  # may grow the table
        return self.hashes[numbers]


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all others."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(h: np.ndarray, n: int, base: int = 0x9E3779B97F4A7C15) -> np.ndarray:
    """Hashes of all runs of n consecutive elements."""
    if len(h) < n:
        return np.empty(0, np.uint64)
    base, out = np.uint64(base | 1), np.zeros(len(h) - n + 1, np.uint64)
    for i in range(n):
        out = out * base + h[i:len(h) - n + 1 + i]
    return mixed(out)


def runs(starts: np.ndarray, length: int) -> np.ndarray:
    """Ascending starts of intervals of one length, merged where they overlap or touch: rows of start, end."""
    if not len(starts):
        return np.empty((0, 2), np.int64)
    gap = np.flatnonzero(np.diff(starts) > length)
    return np.stack([starts[np.r_[0, gap + 1]], starts[np.r_[gap, len(starts) - 1]] + length], axis=1)


def pieces(frames: Iterator, rows: int = 512) -> Iterator:
    """Pandas frames in slices, so that what is made of one slice stays small."""
    for frame in frames:
        for i in range(0, len(frame), rows):
            yield frame.iloc[i:i + rows]
