"""Best-fit packing with certified partitions.

Pieces are dealt over partitions of about `partition_rows`. Each partition packs its pieces best fit decreasing and
computes a lower bound on its bins from dual feasible functions: for a threshold e the function counts pieces longer
than capacity - e as a whole bin, pieces shorter than e as nothing, and the others by their length; the bound is the
largest over all e. A partition that meets its bound is certified and stays as it is. The others keep the bins that are
filled to 99 % and give up the rest; these pieces are dealt anew over as many fewer partitions, and best fit decreasing
runs again, until every partition is certified, one is left, or a round gives up nearly as much as the one before. Every
piece is always in exactly one bin. `bins_and_bound` holds the bins of a packing against the bound of all its pieces.

Pieces are numbered when they are written and dealt by that number, so rows that are alike spread like any others.
Documents are cut only when they exceed the capacity, the first piece takes the remainder. A null text is empty and
makes one token. Rows with a null id are packed too. Repeated rows are packed as often as they occur. An empty table
gives no rows.
"""

from __future__ import annotations

import bisect
import zlib
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import written
from arrearview.llm.tokens import Encoder

PIECES = "doc_id long, piece int, start long, length int, ids_crc32 long"


def pieces_of(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0) -> DataFrame:
    """Documents as token ids with an end id, cut where they exceed the capacity."""
    def cut(frames):
        encoder, last = Encoder(path), end.to_bytes(4, "little")
        for frame in frames:
            out = []
            for doc, text in zip(frame["doc_id"], frame["text"]):
                ids = encoder.ids(text) + last
                n, at, k = len(ids) // 4, 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    out.append((doc, k, at, size, zlib.crc32(ids[4 * at:4 * (at + size)])))
                    at, k = at + size, k + 1
            done = pd.DataFrame(out, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            done["doc_id"] = done["doc_id"].astype("Int64")
            yield done

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(cut, PIECES)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each piece; pieces are taken by decreasing length, each into the fullest bin that holds it."""
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    rooms: list[int] = []  # the distinct free sizes, ascending
    open_bins: dict[int, list[int]] = {}
    made = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        at = bisect.bisect_left(rooms, size)
        if at == len(rooms):
            b, room, made = made, capacity, made + 1
        else:
            room = rooms[at]
            b = open_bins[room].pop()
            if not open_bins[room]:
                del open_bins[room], rooms[at]
        bins[i], offsets[i] = b, capacity - room
        if room > size:
            if room - size not in open_bins:
                bisect.insort(rooms, room - size)
                open_bins[room - size] = []
            open_bins[room - size].append(b)
    return bins, offsets


def lower_bound(lengths: np.ndarray, capacity: int, times: np.ndarray | None = None) -> int:
    """Least number of bins that the dual feasible functions prove; each length occurs once, or as often as given."""
    count = np.zeros(capacity + 1, np.int64)
    np.add.at(count, lengths, 1 if times is None else times)
    n, total = np.cumsum(count), np.cumsum(count * np.arange(capacity + 1))
    e = np.arange(0, capacity // 2 + 1)
    below = np.where(e > 0, total[e - 1], 0)
    middle = total[capacity - e] - below
    bound = (n[-1] - n[capacity - e]) * capacity + middle
    return int(-(-bound.max() // capacity))


def _grouped(work):
    def of_group(key, frame):
        return work(key, frame)

    return of_group


def _pack_partition(key, frame: pd.DataFrame, capacity: int, base: int, settled: float) -> pd.DataFrame:
    """Bins of one partition. All stay if the bound certifies their number, else those filled to `settled`."""
    lengths = frame["length"].to_numpy()
    bins, offsets = best_fit(lengths, capacity)
    fill = np.bincount(bins, lengths)
    certified = len(fill) == lower_bound(lengths, capacity)
    out = frame.drop(columns="_part")
    out["sequence_id"] = base + (int(key[0]) << 28) + bins
    out["offset"], out["stays"], out["certified"] = offsets, certified | (fill >= settled)[bins], certified
    return out


def bins_and_bound(packed: DataFrame, capacity: int = 2048) -> tuple[int, int]:
    """Bins of a packing, and the least number that its pieces need by the dual feasible functions."""
    sizes = packed.groupBy(F.col("length").cast("int").alias("length")).agg(F.count("*").alias("n")).collect()
    lengths, times = (np.array([r[c] for r in sizes], np.int64) for c in ("length", "n"))
    return packed.select("sequence_id").distinct().count(), lower_bound(lengths, capacity, times)


def pack(pieces: DataFrame, capacity: int = 2048, partition_rows: int = 20_000) -> DataFrame:
    """The pieces with sequence_id and offset. Needs the columns of PIECES."""
    spark = pieces.sparkSession
    table = written(pieces.select("doc_id", "piece", "start", "length", "ids_crc32",
                                  F.monotonically_increasing_id().alias("_deal")))
    whole = table.filter(F.col("length") == capacity).drop("_deal").select(
        "*", (F.lit(-1) - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest = table.filter(F.col("length") < capacity)
    left, before, step, done = rest.count(), None, 0, [whole]

    while left:
        parts = -(-left // partition_rows)
        last = parts == 1 or before is not None and left > 0.9 * before
        dealt = rest.withColumn("_part", F.pmod(F.xxhash64("_deal", F.lit(step)), F.lit(parts)))
        schema = f"{PIECES}, _deal long, sequence_id long, offset long, stays boolean, certified boolean"
        # The sequence ids of each round and partition have a range of their own.
        work = partial(_pack_partition, capacity=capacity, base=step << 56, settled=0 if last else 0.99 * capacity)
        out = written(dealt.groupBy("_part").applyInPandas(_grouped(work), schema))
        before, left, step = left, out.filter("not stays").count(), step + 1
        done.append(out.filter("stays"))
        rest = out.filter("not stays").select(*rest.columns)

    columns = ["doc_id", "piece", "start", F.col("length").cast("long").alias("length"), "ids_crc32", "sequence_id",
               "offset"]
    result = done[0].select(*columns)
    for part in done[1:]:
        result = result.unionByName(part.select(*columns))
    return result
