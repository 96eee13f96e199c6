"""Near-duplicates by the Jaccard similarity of five-word shingles, for the pipeline.

Two texts link when the sets of their shingles have a similarity of at least `least`. Candidates come from operator 4:
the SimHash of the set, joined through the pigeonring filter. A 64-bit SimHash alone loses links, as pairs at 0.8 differ
in more bits than any selective key allows; MinHash in `BANDS` bands of `ROWS` values adds what lies beyond its radius: a
pair at the threshold of 0.8 shares no band with probability 3.2e-6, a pair above it more seldom. Every candidate of
either kind is compared exactly before it links.

Texts with equal sets are one node. A band key with up to `hot` nodes gives all its pairs. In a larger one nodes with
too many shingles of their own to reach the threshold with any other are set aside; the others are compared with
up to `leaders` nodes that have the fewest of their own. What then hangs together needs no more comparisons; pairs of the
nodes outside the largest component are compared unless the shingles that both share with a leader, and those that are
neither the leader's nor their own, are too few. So near copies of one text cost some comparisons each, and no link
between components is lost.

Nulls: null texts and texts without words have the empty set and are copies of each other; a text of fewer words than
a shingle is one shingle. Rows with a null id get the component of their text, but name none. Repeated rows come out
repeated. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm import simhash
from arrearview.llm.common import discard, mixed, pieces, written
from arrearview.llm.components import components
from arrearview.llm.simhash import LOWER

BANDS, ROWS = 24, 4
_R = np.random.default_rng(11)
_TIMES = _R.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_PLUS = _R.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)
ROW = "doc_id long, node long, fp long, bands array<long>, text string"


def shingles(text: str | None, shingle: int = 5) -> np.ndarray:
    """The hashes of the text's distinct shingles, ascending."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return np.empty(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter(
        [digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist())], np.uint64, n))


def bands(hashes: np.ndarray) -> np.ndarray:
    """A key for each band."""
    if not len(hashes):
        return np.empty(0, np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1 << 12):
        least = np.minimum(least, ((hashes[i:i + (1 << 12)] ^ _PLUS) * _TIMES).min(axis=1))
    out = np.zeros(BANDS, np.uint64)
    for row in least.reshape(BANDS, ROWS).T:
        out = mixed(out ^ row)
    return out.view(np.int64)


def shared(x: np.ndarray, y: np.ndarray) -> int:
    return len(np.intersect1d(x, y, assume_unique=True))


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    def made(frames):
        for frame in pieces(frames, 128):
            sets = [shingles(t, shingle) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "node": np.array([xxhash.xxh64_intdigest(s.tobytes()) for s in sets],
                                                 np.uint64).view(np.int64),
                                "fp": np.array([simhash.majority(s) for s in sets], np.int64),
                                "bands": [bands(s) for s in sets], "text": frame["text"]})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(made, ROW)


def _sets(texts: DataFrame, shingle: int) -> DataFrame:
    def made(frames):
        for frame in pieces(frames, 128):
            yield pd.DataFrame({"node": frame["node"], "hashes": [shingles(t, shingle).tobytes() for t in frame["text"]]})

    return texts.select("node", "text").mapInPandas(made, "node long, hashes binary")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, both (the number of shared shingles), similarity of pairs of nodes."""
    def made(frames):
        for frame in pieces(frames):
            both = np.array([shared(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))
                             for x, y in zip(frame["x"], frame["y"])], np.int64)
            either = (frame["x"].str.len() + frame["y"].str.len()).to_numpy() // 8 - both
            yield pd.DataFrame({"a": frame["a"], "b": frame["b"], "both": both, "similarity": both / either})

    # The end b first: then the rows of a leader are large, and the skew join splits them.
    both = pairs.join(sets.select(F.col("node").alias("b"), F.col("hashes").alias("y")), "b").join(
        sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), "a")
    return both.select("a", "b", "x", "y").mapInPandas(made, "a long, b long, both long, similarity double")


def _pairs(members: DataFrame) -> DataFrame:
    x, y = members.select("band", "key", F.col("node").alias("a")), members.select("band", "key", F.col("node").alias("b"))
    return x.join(y, ["band", "key"]).filter("a < b").select("a", "b")


def _own(sets: DataFrame) -> DataFrame:
    """node, size, own: the number of shingles of each set, and of those that no other of these sets has."""
    def counted(frames):
        for frame in pieces(frames):
            sets = [np.frombuffer(x, np.uint64) for x in frame["hashes"]]
            every, first, n = np.unique(np.concatenate(sets), return_index=True, return_counts=True)
            node = np.repeat(frame["node"].to_numpy(), [len(x) for x in sets])[first]
            yield pd.DataFrame({"hash": every.view(np.int64), "node": node, "n": n})

    once = (sets.mapInPandas(counted, "hash long, node long, n long").groupBy("hash")
            .agg(F.sum("n").alias("n"), F.min("node").alias("_node")).filter("n = 1"))
    own = once.groupBy("_node").agg(F.count("*").alias("own"))
    size = (F.octet_length("hashes") / 8).cast("long")
    return sets.select("node", size.alias("size")).join(own, F.col("node") == F.col("_node"), "left").select(
        "node", "size", F.coalesce("own", F.lit(0)).alias("own"))


def _hot_links(members: DataFrame, sets: DataFrame, least: float, leaders: int) -> tuple[list[DataFrame], DataFrame]:
    """Links by leaders, and the pairs (a, b) that are still to be compared, for members (band, key, node)."""
    spark, by = members.sparkSession, ["band", "key"]
    owned = written(_own(sets.join(members.select("node").distinct(), "node", "left_semi")))
    members = written(members.join(owned, "node"))
    smallest = written(members.groupBy(*by).agg(F.min("size").alias("smallest")))
    need = least / (1 + least) * (F.col("size") + F.greatest(least * F.col("size"), F.col("smallest"))) - 1e-6
    members = written(members.join(smallest, by).filter(F.col("size") - F.col("own") >= need)
                      .select("node", *by, "size", "own", F.struct("own", "node").alias("rank")))
    found, last = [], None
    for i in range(leaders):
        after = members if last is None else members.join(last, by).filter("rank > leader").drop("leader")
        last = written(after.groupBy(*by).agg(F.min("rank").alias("leader")))
        led = written(members.join(last, by))
        seen = written(_compared(led.select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
                                 .filter("a <> b").distinct(), sets))
        found.append(seen.filter(F.col("similarity") >= least).select("a", "b"))
        seen = seen.toDF("_a", "_b", "both", "similarity")
        led = written(led.join(seen, (F.col("leader.node") == F.col("_a")) & (F.col("node") == F.col("_b")), "left")
                      .drop("_a", "_b", "leader").withColumn(f"with{i}", F.coalesce("both", "size")).drop("both"))
        still = written(led.filter(F.col("similarity") < least).select(*by).distinct())  # else all hang together
        members = written(led.drop("similarity").join(still, by))
        if members.isEmpty():
            return found, spark.createDataFrame([], "a long, b long")
    together = found[0]
    for more in found[1:]:
        together = together.union(more)
    part = components(together)
    members = written(members.join(part.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
                      .drop("_node", "rank").withColumn("component", F.coalesce("component", "node")))
    main = written(members.groupBy(*by, "component").agg(F.count("*").alias("n")).groupBy(*by).agg(
        F.max(F.struct("n", "component")).alias("main")))
    outer = written(members.join(main, by).filter("component <> main.component").drop("main"))
    own = outer.select(*by, *[F.col(c).alias(f"_{c}") for c in outer.columns if c not in by])
    apart = F.col("component") != F.col("_component")
    need = least / (1 + least) * (F.col("size") + F.col("_size")) - 1e-6
    for i in range(leaders):  # what two sets share is either in the leader's set, or outside it and nobody's own
        outside = [F.greatest(F.lit(0), F.col(f"{x}size") - F.col(f"{x}with{i}") - F.col(f"{x}own")) for x in ("", "_")]
        apart = apart & (F.least(f"with{i}", f"_with{i}") + F.least(*outside) >= need)
    pairs = members.join(own, by).filter(apart)
    return found, pairs.select(F.least("node", "_node").alias("a"), F.greatest("node", "_node").alias("b")).distinct()


def _prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes whose fingerprints operator 4 links, with one node for each fingerprint, and its equals."""
    first = written(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    equal = nodes.join(first, "fp").select(F.col("first").alias("a"), F.col("node").alias("b"))
    linked = simhash.links(first.select("fp"))
    near = linked.join(first.toDF("a", "x"), "a").join(first.toDF("b", "y"), "b").select("x", "y")
    return written(equal.filter("a <> b").union(near).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")))


def links(nodes: DataFrame, texts, shingle: int = 5, least: float = 0.8, hot: int = 32,
          leaders: int = 4) -> DataFrame:
    """Links (a, b) that connect all nodes of a similarity of at least `least`; `texts` gives some nodes their text."""
    marked = written(nodes.select("node", "fp"))
    prints = _prints(marked)
    keyed = nodes.select("node", F.posexplode("bands").alias("band", "key"))
    # A counted key is written before it is joined: only a join of two plain exchanges has its hot keys split.
    sizes = written(keyed.groupBy("band", "key").agg(F.count("*").alias("n")).filter("n > 1"))
    dense = written(keyed.join(sizes, ["band", "key"]))
    wanted = dense.select("node").union(prints.select("a")).union(prints.select("b")).distinct()
    sets = written(_sets(texts(wanted), shingle))
    pairs, found = prints.union(_pairs(dense.filter(F.col("n") <= hot))), []
    burning = dense.filter(F.col("n") > hot).drop("n")
    if not burning.isEmpty():
        found, more = _hot_links(burning, sets, least, leaders)
        pairs = pairs.union(more)
    out = _compared(written(pairs.distinct()), sets).filter(F.col("similarity") >= least).select("a", "b")
    for more in found:
        out = out.union(more)
    out = written(out.distinct())
    for done in (marked, prints, sizes, dense, sets):
        discard(done)
    return out


def near_duplicates(docs: DataFrame, shingle: int = 5, least: float = 0.8, hot: int = 32) -> DataFrame:
    """doc_id, component_id (the least doc_id reachable over links, the document's own included) of every row."""
    rows = written(_rows(docs, shingle).withColumn("row", F.monotonically_increasing_id()))
    nodes = written(rows.groupBy("node").agg(F.min("doc_id").alias("least"), F.min("row").alias("row")))

    def texts(wanted: DataFrame) -> DataFrame:
        one = written(nodes.join(wanted, "node", "left_semi").select("row"))
        return rows.join(one, "row").select("node", "text")

    keyed = rows.join(nodes.select("row"), "row", "left_semi").select("node", "fp", "bands")
    found = components(links(keyed, texts, shingle, least, hot))
    named = written(nodes.join(found.withColumnRenamed("node", "_node"), F.col("node") == F.col("_node"), "left")
                    .select("node", "least", F.coalesce("component", "node").alias("component")))
    # Counted and written before it is joined, so that a component of any size is split by the skew join.
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = written(named.join(ids, "component").select("node", "component_id"))
    slim = written(rows.select("doc_id", "node"))
    discard(rows)
    return slim.join(named, "node").select("doc_id", "component_id")
