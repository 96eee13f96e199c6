"""Repeated byte strings by breadth-first backward extension on a Burrows-Wheeler transform.

Every string of `length` bytes that starts at two or more places of the corpus is found; matches never cross texts.

Dealing. A string is placed by its minimizer: of all grams inside it, the one with the least hash. Neighbouring starts
with the same minimizer make one slice of text, so every string lies in exactly one slice per occurrence, and equal
strings always meet under one minimizer. Minimizers met once are dropped. Equal slices become one slice with a weight,
whatever their number. A minimizer left with one slice needs no search: each string in it occurs as often as the
slice's weight says. The others are dealt to tasks by minimizer and cut into blocks of whole minimizers.

Search in a block. The slices are joined with separators and sorted into a transform. The row intervals of all strings
of one size are extended backward by one byte, breadth first; an extension that ends where no boundary is known yet
fixes that common prefix at the current size. So common prefixes come out by increasing value, and the search stops at
`length`: rows with no boundary between them share at least `length` bytes. A class of rows whose slices weigh two or
more in all is a repeat.

A minimizer with more than `hot` distinct slices (a common passage with many different surroundings) would not fit a
task. Its strings are counted one by one instead, by a 128-bit hash with map-side sums: more rows, but no large group.

A text is known by its doc_id and 64 bits of its hash, `tag`, so texts that share a doc_id are told apart however many
they are. Nulls: a null text is empty. Rows with a null id take no part and lose nothing. Repeated rows are copies of
each other. Texts that occur twice or more repeat as a whole if they are long enough. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import discard, mixed, pieces, runs, text_keys, written

GRAM = 80


def byte_grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n bytes, by doubling."""
    power, have, size = np.uint64(0x100000001B3), data.astype(np.uint64) + np.uint64(1), 1
    out, done = None, 0
    while True:
        if n & size:
            if out is None:
                out, done = have, size
            else:  # the grams so far, then the next `size` bytes
                count = len(data) - done - size + 1
                out = out[:count] * power + have[done:done + count]
                done += size
        if size * 2 > n:
            return mixed(out)
        count = len(data) - 2 * size + 1
        have = have[:count] * power + have[size:size + count]
        with np.errstate(over="ignore"):
            power, size = power * power, size * 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` consecutive values: block-wise minima from both sides."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n - width + 1], ahead[width - 1:n])


def slices_of(data: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizer hash, first start and number of starts of each slice of a text of at least `length` bytes."""
    h = byte_grams(data, gram)
    low = np.uint64(0xFFFFFFFF)
    place = window_minima((h & ~low) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & low
    first = np.flatnonzero(np.r_[True, np.diff(place) != 0])
    return h[place[first]], first, np.diff(np.r_[first, len(place)])


#: Bytes of a suffix that fit one sort key.
FIRST = 7


def transform(text: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of all suffixes sorted by their first `depth` bytes, where each row's predecessor stands, and which rows
    differ from the row above in their first FIRST bytes. Rows that no longer tie are not sorted again."""
    n, size = len(text), FIRST
    padded = np.r_[text, np.zeros(size, np.int64)]
    key = np.zeros(n, np.int64)
    for i in range(size):
        key = (key << 9) | padded[i:n + i]
    order = np.argsort(key)
    new = np.r_[True, np.diff(key[order]) != 0]
    early, rank, places = new.copy(), np.empty(n, np.int64), np.arange(n)
    while True:
        rank[order] = np.maximum.accumulate(np.where(new, places, 0))
        tied = np.flatnonzero(~(new & np.r_[new[1:], True]))
        if size >= depth or not len(tied):
            break
        add = min(size, depth - size)
        rows = order[tied]
        after = np.where(rows + add < n, rank[np.minimum(rows + add, n - 1)] + 1, 0)
        key = rank[rows] * (n + 1) + after
        by = np.argsort(key)
        order[tied], key, size = rows[by], key[by], size + add
        new[tied] |= np.r_[True, np.diff(key) != 0]
    rank[order] = places
    return order, rank[order - 1], early


def classes(text: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted rows (suffix starts) and, by row, whether a new class of common prefixes of `length` begins there.

    Separators are 0; strings with a separator are not extended.
    """
    n = len(text)
    order, back, early = transform(text, length)
    before = text[order - 1]
    before[order == 0] = 0  # nothing stands before the first byte
    known = np.r_[early, True]
    # The sort key knows the common prefixes below FIRST; the search goes on from all strings of that size.
    left = np.flatnonzero(early)
    right = np.r_[left[1:], n]
    near = np.flatnonzero(text == 0)
    room = near[np.searchsorted(near, order[left])] - order[left]  # the last separator ends the text
    left, right = left[room >= FIRST], right[room >= FIRST]
    for _ in range(FIRST, length):
        if not len(left):
            break
        one = right - left == 1
        single = left[one]
        single = back[single[before[single] > 0]]
        left, sizes = left[~one], (right - left)[~one]
        owner = np.repeat(np.arange(len(left)), sizes)
        rows = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes - left, sizes)
        some = before[rows] > 0
        owner, rows = owner[some], rows[some]
        # Rows of one interval with one byte before them have neighbouring places.
        key = owner * n + back[rows]
        by = np.argsort(key, kind="stable")
        key, byte = key[by], before[rows[by]]
        owner = key // n
        place = key - owner * n
        new = np.r_[True, (np.diff(owner) != 0) | (np.diff(byte) != 0)] if len(by) else np.empty(0, bool)
        left = np.r_[single, place[new]]
        right = np.r_[single, place[np.r_[new[1:], True]] if len(by) else place] + 1
        fresh = ~(known[left] & known[right])
        known[left] = known[right] = True
        left, right = left[fresh], right[fresh]
    return order, known[:n]


def repeats_in_block(slices: list[bytes], weights: np.ndarray, length: int) -> list[np.ndarray]:
    """For each slice the starts of the strings that weigh two or more in the block."""
    sizes = np.array([len(s) for s in slices], np.int64)
    base = np.r_[0, np.cumsum(sizes + 1)]
    text = np.zeros(base[-1], np.int64)
    for at, s in zip(base, slices):
        text[at:at + len(s)] = np.frombuffer(s, np.uint8)
        text[at:at + len(s)] += 1
    order, starts = classes(text, length)
    owner = np.repeat(np.arange(len(slices)), sizes + 1)
    valid = np.arange(len(text)) - base[owner] <= sizes[owner] - length
    weight = np.where(valid, weights[owner], 0)[order]
    number = np.cumsum(starts) - 1
    heavy = np.bincount(number, weight)[number] >= 2
    found = np.sort(order[heavy & valid[order]])
    return [part - at for part, at in zip(np.split(found, np.searchsorted(found, base[1:-1])), base)]


def _slice_rows(docs: DataFrame, length: int, gram: int) -> DataFrame:
    def made(frames):
        for frame in pieces(frames, 256):
            ids, parts = [], []
            for doc, tag, text in zip(frame["doc_id"], frame["tag"], frame["text"]):
                raw = text.encode()
                if len(raw) < length:
                    continue
                h, first, count = slices_of(np.frombuffer(raw, np.uint8), length, gram)
                view = memoryview(raw)
                same = [xxhash.xxh3_64_intdigest(view[a:b]) for a, b in
                        zip(first.tolist(), (first + count + length - 1).tolist())]
                ids.append(np.full(len(h), doc, np.int64))
                parts.append((h.view(np.int64), np.array(same, np.uint64).view(np.int64),
                              np.full(len(h), tag, np.int64), first, count))
            if parts:
                mini, same, tag, first, count = (np.concatenate(p) for p in zip(*parts))
                yield pd.DataFrame({"mini": mini, "same": same, "doc_id": np.concatenate(ids), "tag": tag,
                                    "at": first.astype(np.int32), "n": count.astype(np.int32)})

    return docs.mapInPandas(made, "mini long, same long, doc_id long, tag long, at int, n int")


#: A position that stands for the whole text.
WHOLE = -1


def _with_bytes(wanted: DataFrame, docs: DataFrame, length: int) -> DataFrame:
    """mini, same, weight and the bytes of each slice, taken from the text of one document that has it."""
    packed = wanted.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("mini", "same", "weight", "at", "n")).alias("cuts"))

    def made(frames):
        for frame in pieces(frames, 256):
            out = []
            for text, cuts in zip(frame["text"], frame["cuts"]):
                raw = text.encode()
                out += [(c["mini"], c["same"], c["weight"], raw[c["at"]:c["at"] + c["n"] + length - 1]) for c in cuts]
            yield pd.DataFrame(out, columns=["mini", "same", "weight", "bytes"])

    return docs.join(packed, ["doc_id", "tag"]).select("text", "cuts").mapInPandas(
        made, "mini long, same long, weight long, bytes binary")


def _search(slices: DataFrame, length: int, block: int) -> DataFrame:
    """mini, same, starts: the repeated strings of each slice, as starts within it."""
    def made(frames):
        def done(rows):
            rows = rows.drop_duplicates(["mini", "same"])
            found = repeats_in_block(rows["bytes"].tolist(), rows["weight"].to_numpy(), length)
            some = np.array([len(f) > 0 for f in found], bool)
            starts = pd.Series([f.astype(np.int32) for f in found if len(f)], dtype=object)
            return pd.DataFrame({"mini": rows["mini"].to_numpy()[some], "same": rows["same"].to_numpy()[some],
                                 "starts": starts})

        rows = None
        for frame in frames:
            rows = frame if rows is None else pd.concat([rows, frame], ignore_index=True)
            mini, size, at = rows["mini"].to_numpy(), np.cumsum(rows["bytes"].str.len().to_numpy()), 0
            for end in (np.flatnonzero(mini[1:] != mini[:-1]) + 1).tolist():
                if size[end - 1] - (size[at - 1] if at else 0) >= block:
                    yield done(rows.iloc[at:end])
                    at = end
            rows = rows.iloc[at:]  # other slices of the last minimizer may still come
        if rows is not None and len(rows):
            yield done(rows)

    dealt = slices.repartition("mini").sortWithinPartitions("mini")
    return dealt.mapInPandas(made, "mini long, same long, starts array<int>")


def _count_strings(slices: DataFrame, length: int) -> DataFrame:
    """The same for hot minimizers: every string by its hash."""
    def made(frames):
        for frame in pieces(frames, 256):
            out = []
            for mini, same, weight, raw in zip(frame["mini"], frame["same"], frame["weight"], frame["bytes"]):
                view = memoryview(raw)
                for i in range(len(raw) - length + 1):
                    h = xxhash.xxh3_128_digest(view[i:i + length])
                    out.append((mini, same, weight, i, h))
            yield pd.DataFrame(out, columns=["mini", "same", "weight", "start", "string"])

    rows = slices.mapInPandas(made, "mini long, same long, weight long, start int, string binary")
    heavy = written(rows.groupBy("string").agg(F.sum("weight").alias("total")).filter("total >= 2").select("string"))
    return rows.join(heavy, "string").groupBy("mini", "same").agg(F.collect_set("start").alias("starts"))


def repeated(docs: DataFrame, length: int = 200, gram: int = GRAM, block: int = 1 << 18,
             hot: int = 10_000) -> DataFrame:
    """doc_id, tag, ats: first starts and numbers of starts of the repeated strings of each text that has any."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"), "text").filter(
        "doc_id is not null and text is not null")
    keys = docs.select("doc_id", "tag", (F.octet_length("text") >= length).alias("long"),
                       *text_keys(F.col("text")))
    # A counted key is written before it is joined: only a join of two plain exchanges has its hot keys split.
    many = written(keys.groupBy("k1", "k2").agg(F.count("*").alias("copies")).filter("copies > 1"))
    copies = written(keys.join(many, ["k1", "k2"]).filter("long").select("doc_id", "tag").distinct())

    rows = written(_slice_rows(docs, length, gram))
    shared = written(rows.groupBy("mini").agg(F.count("*").alias("times")).filter("times > 1").select("mini"))
    met = written(rows.join(shared, "mini"))
    discard(rows)
    # Of copied texts one is enough to look at, with the weight of all.
    kinds = met.groupBy("mini", "same").agg(F.sum(F.lit(1).cast("long")).alias("weight"), F.min(
        F.struct("doc_id", "tag", "at", "n")).alias("one"))
    kinds = written(kinds.select("mini", "same", "weight", "one.*"))
    sizes = written(kinds.groupBy("mini").agg(F.count("*").alias("kinds")))
    sized = kinds.join(sizes, "mini")
    plain = sized.filter("kinds = 1 and weight > 1").select(
        "mini", "same", F.array(F.struct(F.lit(0).alias("start"), "n")).alias("found"))
    slices = written(_with_bytes(sized.filter("kinds > 1"), docs, length))
    hot_minis = sizes.filter(F.col("kinds") > hot).select("mini")
    searched = _search(slices.join(hot_minis, "mini", "left_anti"), length, block).unionByName(
        _count_strings(slices.join(hot_minis, "mini"), length))

    @F.pandas_udf("array<struct<start:int,n:int>>")
    def in_runs(starts: pd.Series) -> pd.Series:
        return pd.Series([[{"start": int(a), "n": int(b - a)} for a, b in runs(np.sort(s), 1)] for s in starts],
                         dtype=object)

    found = plain.unionByName(searched.select("mini", "same", in_runs("starts").alias("found")))
    places = met.join(found, ["mini", "same"]).select("doc_id", "tag", F.explode(F.transform(
        "found", lambda f: F.struct((F.col("at") + f["start"]).alias("at"), f["n"].alias("n")))).alias("run"))
    whole = copies.select("doc_id", "tag", F.struct(F.lit(WHOLE).alias("at"), F.lit(0).alias("n")).alias("run"))
    return places.union(whole).groupBy("doc_id", "tag").agg(F.collect_list("run").alias("ats"))


CUT = "bytes binary, n_removed long, spans array<struct<first:long,last:long>>"


def without_repeats(docs: DataFrame, length: int = 200, **limits) -> DataFrame:
    """doc_id, n_bytes, n_removed, spans (first and last byte of each removed run) and the remaining bytes of every row.

    The remaining bytes need not be valid UTF-8: a removed run may end inside a character.
    """
    marks = repeated(docs, length, **limits)

    @F.pandas_udf(CUT)
    def cut(texts: pd.Series, marked: pd.Series) -> pd.DataFrame:
        out = []
        for text, ats in zip(texts, marked):
            if text is None or ats is None:
                out.append((None, None, None))
                continue
            raw = text.encode()
            own = sorted((a["at"], a["n"]) for a in ats)
            if own[0][0] == WHOLE:
                own = [(0, len(raw) - length + 1)]
            spans: list[list[int]] = []
            for start, n in own:
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], start + n + length - 1)
                else:
                    spans.append([start, start + n + length - 1])
            left, at = [], 0
            for a, b in spans:
                left.append(raw[at:a])
                at = b
            left.append(raw[at:])
            out.append((b"".join(left), sum(b - a for a, b in spans),
                        [{"first": a, "last": b - 1} for a, b in spans]))
        return pd.DataFrame(out, columns=["bytes", "n_removed", "spans"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("tag"),
                       F.coalesce("text", F.lit("")).alias("text"))
    joined = rows.join(marks, ["doc_id", "tag"], "left")
    joined = joined.withColumn("_cut", cut(F.when(F.col("ats").isNotNull(), F.col("text")), F.col("ats")))
    none = F.array().cast("array<struct<first:bigint,last:bigint>>")
    return joined.select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"),
        F.coalesce("_cut.n_removed", F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce("_cut.spans", none).alias("spans"),
        F.coalesce("_cut.bytes", F.encode("text", "UTF-8")).alias("bytes"))
