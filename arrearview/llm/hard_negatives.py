"""Hard-negative mining with length buckets and coordinate pruning.

Components become whole numbers, floor(256 * x), and a score is the inner product of two rows. An anchor's positives are
its best rows of the same label; for each positive the best rows of other labels whose score lies between `low` and
`high` per cent of the positive's are its hard negatives. Higher scores come first, ties by smaller id.

Anchors are held in blocks of a bounded size; all rows are streamed past each block by descending length, in buckets. An
anchor has a threshold: the score that a row needs to enter its current lists. By the lengths alone a bucket whose
longest row cannot reach it is passed over. Else the threshold bounds the angle between anchor and row, and with it the
range of values that the row may have in each of the anchor's `focus` largest coordinates. Each bucket holds its rows
sorted by coordinate, so a range is a stretch of a list; rows in the stretches of all focus coordinates are candidates.
If the ranges take in nearly the whole lists (as with rows in all directions), the bucket is verified whole. Scores are
always computed exactly, and thresholds let ties through, so pruning loses nothing.

Every block and split of the rows is one task that keeps only the best rows of its anchors and emits them once, so no
pairs move: rows times blocks are dealt, and (lists x splits) come back. Of rows that are alike in label and components
only those with the smallest ids can be in a list, so the others of a large group of copies are left out beforehand, as
candidates, never as anchors.

Rows with a null id, label or vector or a null or non-finite component take no part; equal rows (id, label, components)
count once, rows that share an id only are not each other's positives or negatives. A shorter vector is filled with
zeros. A score that does not fit a long is an error. An empty table, or one without anchors, gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from arrearview.llm.common import written

BLOCK = 8192        # anchors that a task holds
SCORES = 1 << 22    # scores that are computed at once
FOUND = "anchor long, slot int, score long, other long"
RESULT = ("anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")


def whole(vector: Column) -> Column:
    """floor(256 * x) of each component, as doubles, which hold any of these numbers exactly."""
    def floor(x: Column) -> Column:
        y = 256 * x.cast("double")
        return F.when(F.abs(y) < 2.0 ** 53, F.floor(y).cast("double")).otherwise(y)

    return F.transform(vector, floor)


def usable(rows: DataFrame) -> DataFrame:
    """id, label, v and its length of all rows that take part, each once."""
    v = F.col("embedding")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    own = rows.select(F.col("vec_id").cast("long").alias("id"), F.col("label").cast("long").alias("label"),
                      F.when(~bad, whole(v)).alias("v"))
    size = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return own.dropna().distinct().withColumn("length", size)


def scores(q: np.ndarray, p: np.ndarray) -> np.ndarray:
    """Exact inner products of whole numbers held as doubles."""
    most = np.abs(q).max(initial=0) * np.abs(p).max(initial=0) * q.shape[1]
    if most < 2.0 ** 53:
        return (q @ p.T).astype(np.int64)
    exact = [[int(x) for x in row] for row in p]
    return np.array([[sum(int(a) * b for a, b in zip(row, other)) for other in exact] for row in q], np.int64
                    ).reshape(len(q), len(p))


def share(percent: int, score: np.ndarray) -> np.ndarray:
    """floor(percent * score / 100) without leaving 64 bits."""
    return score // 100 * percent + score % 100 * percent // 100


class Bucket:
    """Rows of one stretch of lengths, with a sorted list for each coordinate that is asked for."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, p: np.ndarray) -> None:
        self.ids, self.labels, self.p = ids, labels, p
        length = np.sqrt((p * p).sum(1))
        self.longest = length.max(initial=0)
        self.unit = p / np.where(length > 0, length, 1)[:, None]
        self.least, self.most = self.unit.min(0, initial=1), self.unit.max(0, initial=-1)
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, coordinate: int) -> tuple[np.ndarray, np.ndarray]:
        if coordinate not in self.lists:
            order = np.argsort(self.unit[:, coordinate], kind="stable")
            self.lists[coordinate] = order, self.unit[order, coordinate]
        return self.lists[coordinate]


class Anchors:
    """One block of anchors with its thresholds."""

    def __init__(self, keys: np.ndarray, ids: np.ndarray, labels: np.ndarray, q: np.ndarray, focus: int) -> None:
        self.keys, self.ids, self.labels, self.q = keys, ids, labels, q
        self.length = np.sqrt((q * q).sum(1))
        unit = np.clip(q / np.where(self.length > 0, self.length, 1)[:, None], -1, 1)
        self.focus = np.argsort(-np.abs(unit), axis=1, kind="stable")[:, :focus]
        self.angle = np.arccos(np.take_along_axis(unit, self.focus, 1))

    def search(self, of: np.ndarray, need: np.ndarray, bucket: Bucket) -> Iterator[tuple[np.ndarray, ...]]:
        """Anchor (place in the block), row (place in the bucket) and score of pairs that reach the anchor's need."""
        most = self.length[of] * bucket.longest * (1 + 1e-9)
        of, need = of[need <= most], need[need <= most]  # by length
        if not len(of) or not len(bucket.ids):
            return
        reach = need / np.maximum(self.length[of] * bucket.longest, 1e-300)
        wide = np.where(need > 0, np.arccos(np.clip(reach, 0, 1)) + 1e-7, np.pi)[:, None]
        low, high = np.cos(np.minimum(np.pi, self.angle[of] + wide)), np.cos(np.maximum(0, self.angle[of] - wide))
        narrow = ((low > bucket.least[self.focus[of]]) | (high < bucket.most[self.focus[of]])).any(1)
        pruned = np.zeros(len(of), bool)
        for i in np.flatnonzero(narrow).tolist():
            places, fewest = [], len(bucket.ids)
            for f, a, b in zip(self.focus[of[i]].tolist(), low[i], high[i]):
                order, values = bucket.sorted_list(f)
                start, end = np.searchsorted(values, [a - 1e-7, b + 1e-7])
                places.append(order[start:max(end, start)])
                fewest = min(fewest, len(places[-1]))
            if 4 * fewest < len(bucket.ids):
                pruned[i] = True
                times = np.zeros(len(bucket.ids), np.int16)
                for place in places:
                    times[place] += 1
                rows = np.flatnonzero(times == len(places))
                s = scores(self.q[of[i]:of[i] + 1], bucket.p[rows])[0]
                good = s >= need[i]
                yield np.full(good.sum(), of[i]), rows[good], s[good]
        of, need = of[~pruned], need[~pruned]
        step = max(1, SCORES // len(bucket.ids))
        for i in range(0, len(of), step):
            s = scores(self.q[of[i:i + step]], bucket.p)
            a, r = np.nonzero(s >= need[i:i + step, None])
            yield of[i + a], r, s[a, r]


class Best:
    """The `keep` best (score, id) of each of `slots` lists, and the score that a new entry needs."""

    def __init__(self, floor: np.ndarray, keep: int) -> None:
        self.need, self.keep = floor.astype(float), keep
        self.slot, self.score, self.id = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64)

    def add(self, slot: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        if not len(slot):
            return
        slot, score, ids = np.r_[self.slot, slot], np.r_[self.score, score], np.r_[self.id, ids]
        order = np.lexsort((ids, -score, slot))
        slot = slot[order]
        first = np.r_[True, slot[1:] != slot[:-1]]
        rank = np.arange(len(slot)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        stays = order[rank < self.keep]
        self.slot, self.score, self.id = slot[rank < self.keep], score[stays], ids[stays]
        full = rank == self.keep - 1
        self.need[slot[full]] = score[order[full]]


def positives_of(anchors: Anchors, best: Best, bucket: Bucket) -> None:
    """Rows of the anchor's label; each label of the bucket is searched by its own anchors."""
    for label in np.intersect1d(anchors.labels, bucket.labels):
        of, rows = np.flatnonzero(anchors.labels == label), np.flatnonzero(bucket.labels == label)
        part = Bucket(bucket.ids[rows], bucket.labels[rows], bucket.p[rows])
        for a, r, s in anchors.search(of, best.need[of], part):
            other = part.ids[r] != anchors.ids[a]
            best.add(a[other], s[other], part.ids[r[other]])


def negatives_of(anchors: Anchors, best: Best, bucket: Bucket, floor: np.ndarray, ceiling: np.ndarray) -> None:
    """Rows of other labels from the floor to the ceiling of each of the anchor's positives."""
    slots = ceiling.shape[1]
    need = best.need.reshape(-1, slots)
    of = np.flatnonzero(np.isfinite(need).any(1))
    for a, r, s in anchors.search(of, need[of].min(1), bucket):
        other = (bucket.labels[r] != anchors.labels[a]) & (bucket.ids[r] != anchors.ids[a])
        a, r, s = a[other], r[other], s[other]
        s_of = s[:, None]
        i, j = np.nonzero((s_of <= ceiling[a]) & (s_of >= floor[a]) & (s_of >= need[a]))
        best.add(a[i] * slots + j, s[i], bucket.ids[r[i]])


def matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column, filled with zeros up to `width`."""
    sizes, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def buckets(first: int, rows: int) -> Iterator[slice]:
    """Slices that double in size from the first: thresholds rise on small buckets."""
    at = 0
    while at < rows:
        yield slice(at, min(rows, at + first))
        at, first = at + first, 2 * first


def searched(dealt: DataFrame, width: int, focus: int, keep: int, low: int, high: int) -> DataFrame:
    """The best rows of each anchor within a task. A task's rows come by block and split, anchors first, then by length.

    An anchor without `goals` looks for its positives; one with goals, the scores of its positives, for its negatives.
    """
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, anchors, best, limits, first = None, [], None, None, None, 512

        def result():
            if best is None or not len(best.slot):
                return
            slots = 1 if limits is None else limits[0].shape[1]
            table = pa.table({"anchor": anchors.keys[best.slot // slots], "slot": (best.slot % slots).astype(np.int32),
                              "score": best.score, "other": best.id})
            yield from table.to_batches()

        def ready():
            keys, ids, labels, q, goals = (np.concatenate([h[i] for h in held]) if i != 4 else
                                           [g for h in held for g in h[4]] for i in range(5))
            made = Anchors(keys, ids, labels, q, focus)
            if all(g is None for g in goals):
                return made, Best(np.full(len(keys), -np.inf), keep), None
            slots = max(map(len, goals))
            floor = np.full((len(keys), slots), np.iinfo(np.int64).max)
            ceiling = np.full((len(keys), slots), np.iinfo(np.int64).min)
            for i, g in enumerate(goals):
                g = np.array(g, np.int64)
                floor[i, :len(g)], ceiling[i, :len(g)] = -share(low, -g), share(high, g)
            return made, Best(np.where(floor <= ceiling, floor, np.inf).ravel(), keep), (floor, ceiling)

        for batch in batches:
            columns = {n: batch.column(n) for n in batch.schema.names}
            part = np.asarray(columns["part"])
            cut = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
            for start, end in zip(cut[:-1].tolist(), cut[1:].tolist()):
                if part[start] != now:
                    yield from result()
                    now, held, anchors, best, limits, first = part[start], [], None, None, None, 512
                rows = {n: c.slice(start, end - start) for n, c in columns.items()}
                key = np.asarray(rows["anchor"].fill_null(-1))
                asking = int((key >= 0).sum())
                ids, labels = np.asarray(rows["id"]), np.asarray(rows["label"])
                v = matrix(rows["v"], width)
                if asking:
                    held.append((key[:asking], ids[:asking], labels[:asking], v[:asking],
                                 rows["goals"].slice(0, asking).to_pylist()))
                if asking == len(key) or not held:
                    continue
                if anchors is None:
                    anchors, best, limits = ready()
                for s in buckets(first, len(key) - asking):
                    s = slice(s.start + asking, s.stop + asking)
                    bucket = Bucket(ids[s], labels[s], v[s])
                    if limits is None:
                        positives_of(anchors, best, bucket)
                    else:
                        negatives_of(anchors, best, bucket, *limits)
                    first = 2 * len(bucket.ids)
        yield from result()

    return dealt.mapInArrow(search, FOUND)


def meet(anchors: DataFrame, rows: DataFrame, blocks: int, splits: int) -> DataFrame:
    """Each block of anchors with each split of the rows: a partition gets whole parts, anchors first, rows by length."""
    part = F.col("block") * splits + F.col("split")
    asking = anchors.select(
        "anchor", "id", "label", "v", "goals", "length", F.pmod(F.xxhash64("anchor"), F.lit(blocks)).alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(splits - 1))).alias("split"))
    passing = rows.select(
        F.lit(None).cast("long").alias("anchor"), "id", "label", "v", F.lit(None).cast("array<bigint>").alias("goals"),
        "length", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("id", "label"), F.lit(splits)).alias("split"))
    return (asking.unionByName(passing).withColumn("part", part.cast("long")).drop("block", "split")
            .repartition(blocks * splits, "part")
            .sortWithinPartitions("part", F.col("anchor").isNull(), F.col("length").desc()))


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90,
          focus: int = 3, block: int = BLOCK) -> DataFrame:
    """Hard negatives of every anchor, by RESULT. `is_anchor` is a condition on the column `id`."""
    spark = rows.sparkSession
    table = written(usable(rows))
    nothing = spark.createDataFrame([], RESULT)
    alike = Window.partitionBy("label", "v").orderBy("id")
    candidates = written(table.withColumn("copy", F.row_number().over(alike))
                         .filter(F.col("copy") <= max(positives + 1, negatives)).drop("copy"))
    asking = written(table.filter(is_anchor).withColumn("anchor", F.monotonically_increasing_id()))
    n, width = asking.count(), table.agg(F.max(F.size("v"))).first()[0]
    if not n:
        return nothing
    blocks = -(-n // block)
    splits = max(1, -(-2 * spark.sparkContext.defaultParallelism // blocks))

    def best(anchors: DataFrame, keep: int) -> DataFrame:
        dealt = meet(anchors, candidates, blocks, splits)
        order = Window.partitionBy("anchor", "slot").orderBy(F.desc("score"), "other")
        found = searched(dealt, width, focus, keep, low, high).withColumn("rank", F.row_number().over(order))
        return written(found.filter(F.col("rank") <= keep))

    first = best(asking.withColumn("goals", F.lit(None).cast("array<bigint>")), positives)
    goals = first.groupBy("anchor").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda x: x["score"]).alias("goals"))
    second = best(asking.join(goals, "anchor"), negatives)
    wanted = first.select("anchor", (F.col("rank") - 1).alias("slot"), F.col("other").alias("positive_id"),
                          F.col("score").alias("positive_score"))
    named = asking.select("anchor", F.col("id").alias("anchor_id"))
    return second.join(wanted, ["anchor", "slot"]).join(named, "anchor").select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
