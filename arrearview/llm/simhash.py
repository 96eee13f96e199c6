"""SimHash near-duplicates with the pigeonring filter.

A text's fingerprint has 64 bits; a bit is 1 if it is set in over half of the XXH64 hashes of the text's shingles.
Two fingerprints link when they differ in at most `radius` bits.

Candidates: the 64 bits form a ring of `segments` segments. If two fingerprints differ in at most r bits, then some
segment starts a chain in which every first l segments together differ in at most l * r / segments bits (the strong
pigeonhole principle on a ring). While that budget is below one bit, segments must be equal: with 9 segments and r = 2
the first four, 28 bits, which make the join key. The longer prefixes of the chain are checked on the pair before the
full Hamming distance is. Fingerprints are distinct before they are joined, so copies cost nothing.

A key with more than `hot` distinct fingerprints is not joined with itself. For its members the same links are reached
through masks: two fingerprints within two bits are equal once those bits are cleared, so each member is grouped under
its values with any `radius` bits cleared and linked to the least of the group. That is one row per member and mask,
not one per pair, and it loses no link.

Nulls: a null text has no shingle and the fingerprint zero, which links like any other; rows with a null id get a
fingerprint and the component of their fingerprint, but name no component. Repeated rows come out repeated. An empty
table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import pieces, written
from arrearview.llm.components import components

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """The fingerprint as a signed 64-bit number."""
    words = (text or "").encode().translate(LOWER).split()
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]]
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter([digest(line[a:b], 42) for a, b in zip(starts[:n].tolist(), (ends[-n:] - 1).tolist())],
                         np.uint64, n)
    return majority(hashes)


def majority(hashes: np.ndarray) -> int:
    """The bits set in over half of the hashes, as a signed 64-bit number; zero where there is none."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        part = hashes[i:i + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """doc_id, fp (long) of every row."""
    def made(frames):
        for frame in pieces(frames):
            yield pd.DataFrame({"doc_id": frame["doc_id"].astype("Int64"),
                                "fp": np.array([fingerprint(t, shingle) for t in frame["text"]], np.int64)})

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(made, "doc_id long, fp long")


def bounds(segments: int) -> list[tuple[int, int]]:
    """First bit and width of the segments, from the lowest bit on."""
    cuts = [i * 64 // segments for i in range(segments + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:])]


def _mask(ring: list[int], parts: list[tuple[int, int]]) -> int:
    """Bits of the given segments, as a signed long."""
    mask = sum(((1 << w) - 1) << a for a, w in (parts[i] for i in ring))
    return mask - (1 << 64) if mask >> 63 else mask


def links(fps: DataFrame, radius: int = 2, segments: int = 9, hot: int = 256) -> DataFrame:
    """Links (a, b) between the distinct fingerprints of column fp that connect all within the radius."""
    parts = bounds(segments)
    chain = [[(i + k) % segments for k in range(segments)] for i in range(segments)]
    equal = max(n for n in range(1, segments) if n * radius < segments)
    keys = [F.struct(F.lit(i).alias("start"), F.col("fp").bitwiseAND(F.lit(_mask(ring[:equal], parts))).alias("bits"))
            for i, ring in enumerate(chain)]
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("key")).select("fp", "key.start", "key.bits")
    # A counted key is written before it is joined: only a join of two plain exchanges has its hot keys split.
    sizes = written(rows.groupBy("start", "bits").agg(F.count("*").alias("n")).filter("n > 1"))
    dense = rows.join(sizes, ["start", "bits"])
    cool, burning = dense.filter(F.col("n") <= hot), dense.filter(F.col("n") > hot)

    x, y = cool.select("start", "bits", "fp"), cool.select("start", "bits", F.col("fp").alias("other"))
    differ = F.col("fp").bitwiseXOR(F.col("other"))
    ring = F.lit(True)
    for i in range(segments):
        steps = [F.bit_count(differ.bitwiseAND(F.lit(_mask(chain[i][:n], parts)))) <= n * radius // segments
                 for n in range(equal + 1, segments)]
        within = F.lit(True)
        for s in steps:
            within = within & s
        ring = ring & ((F.col("start") != i) | within)
    pairs = (x.join(y, ["start", "bits"]).filter(F.col("fp") < F.col("other")).filter(ring)
             .filter(F.bit_count(differ) <= radius).select(F.col("fp").alias("a"), F.col("other").alias("b")))

    masked = burning.select("fp").distinct().withColumns({"which": F.lit(""), "rest": F.col("fp"), "bit": F.lit(-1)})
    for i in range(radius):  # clear each combination of `radius` bits
        masked = masked.select("fp", "which", "rest", F.explode(F.sequence(F.col("bit") + 1, F.lit(64 - radius + i)))
                               .alias("bit"))
        masked = masked.select("fp", F.concat_ws(",", "which", "bit").alias("which"),
                               F.expr("rest & ~shiftleft(1L, bit)").alias("rest"), "bit")
    least = written(masked.groupBy("which", "rest").agg(F.min("fp").alias("least"), F.count("*").alias("n"))
                    .filter("n > 1"))
    stars = masked.join(least, ["which", "rest"]).filter("fp <> least").select(F.col("least").alias("a"), "fp")
    return pairs.union(stars.toDF("a", "b")).distinct()


def near_duplicates(docs: DataFrame, shingle: int = 3, radius: int = 2, segments: int = 9,
                    hot: int = 256) -> DataFrame:
    """doc_id, fp, component_id (the least doc_id reachable over links, the document's own included) of every row."""
    rows = written(fingerprints(docs, shingle))
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    found = components(links(nodes, radius, segments, hot))
    named = written(nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left")
                    .select("fp", "least", F.coalesce("component", "fp").alias("component")))
    # Counted and written before it is joined, so that a component of any size is split by the skew join.
    ids = written(named.groupBy("component").agg(F.min("least").alias("component_id")))
    named = written(named.join(ids, "component").select("fp", "component_id"))
    return rows.join(named, "fp").select("doc_id", "fp", "component_id")
