"""Periodic runs of words: recursive frequency splitting, then a lag scan of what survives.

A run is a stretch of words with smallest period q (words q apart are equal) of at least max(24, 3 * q) words that no
neighbouring word extends. Every word of a run occurs three times or more inside it, so a word that occurs less often
in the current segment is in no run and splits the segment; the pieces are counted again until none has such a word.
Pieces under 24 words go. A run is never split, as its own words keep it whole.

Surviving segments are scanned by lag: the words are compared with themselves q places on, and stretches of equal words
that are long enough are runs, unless a run of a divisor of q covers them (then q is not the smallest period). Lags up
to 32 are all tried. A longer lag q, with size / 2 < q <= size for a power of two, is tried only where some block of
`size` words recurs next exactly q places on: a run of length 3 * q has such blocks, because a block of at least q words
of it recurs first after q. Blocks get exact numbers by doubling, not hashes.

The work is a map over documents without a shuffle, so no source, copy or key gathers anywhere; a text is one value of a
task and costs n log n for n words besides the lags tried.

Null and empty texts have no words and no run. Ids are not used: null ids, ties and repeated rows come out as they went
in. An empty table gives no rows. All input columns are returned, but for one named like the result, which is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAST, TIMES, SMALL = 24, 3, 32
RESULT = "n_words long, runs array<struct<start: long, length: long, period: long>>, text string"


def numbered(words: list[bytes]) -> np.ndarray:
    """A number for each word, equal words equal."""
    names = {w: i for i, w in enumerate(dict.fromkeys(words))}
    return np.fromiter(map(names.__getitem__, words), np.int64, len(words))


def segments(ids: np.ndarray) -> Iterator[tuple[int, int]]:
    """Maximal stretches (start, end) of at least LEAST words in which no word occurs fewer than TIMES times."""
    if len(ids) < LEAST:
        return
    place, piece, width = np.arange(len(ids)), np.zeros(len(ids), np.int64), int(ids.max()) + 1
    while len(place):
        _, back, count = np.unique(piece * width + ids[place], return_inverse=True, return_counts=True)
        enough = count[back] >= TIMES
        split = np.bincount(piece, ~enough) > 0
        for p in np.flatnonzero(~split):
            low, high = np.searchsorted(piece, [p, p + 1])
            yield int(place[low]), int(place[high - 1]) + 1
        place = place[enough & split[piece]]
        piece = np.cumsum(np.r_[False, np.diff(place) > 1]) if len(place) else place
        long = np.bincount(piece)[piece] >= LEAST if len(place) else np.empty(0, bool)
        place = place[long]
        piece = np.unique(piece[long], return_inverse=True)[1]


def lags(ids: np.ndarray) -> Iterator[int]:
    """Ascending lags that can be the period of a run: all small ones, and distances at which a long block recurs."""
    most = len(ids) // TIMES
    yield from range(1, min(most, SMALL) + 1)
    name, size = ids, 1
    while size // 2 < most:
        if size > SMALL:
            order = np.argsort(name, kind="stable")
            gap = np.diff(order)[name[order[1:]] == name[order[:-1]]]
            yield from np.unique(gap[(gap > size // 2) & (gap <= min(size, most))]).tolist()
        if len(name) <= size:
            break
        pair = name[:-size] * (int(name.max()) + 1) + name[size:]  # both below the number of words: no overflow
        name, size = np.unique(pair, return_inverse=True)[1], 2 * size


def runs_of(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of numbered words by start, then period."""
    out = []
    for first, end in segments(ids):
        part, found = ids[first:end], {}
        for q in lags(part):
            edge = np.flatnonzero(np.diff(np.r_[False, part[:-q] == part[q:], False].astype(np.int8)))
            start, stop = edge[::2], edge[1::2] + q
            long = stop - start >= max(LEAST, TIMES * q)
            start, stop = start[long], stop[long]
            for p, (s, e) in found.items():
                if len(start) and q % p == 0:
                    at = np.searchsorted(s, start, "right") - 1
                    new = (at < 0) | (e[at] < stop)
                    start, stop = start[new], stop[new]
            if len(start):
                found[q] = start, stop
                out.extend((first + s, e - s, q) for s, e in zip(start.tolist(), stop.tolist()))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapse(text: str) -> tuple[int, list[tuple[int, int, int]], str]:
    """Number of words, runs, and the text without what each run repeats after its first period."""
    words = text.encode().split()
    found = runs_of(numbered(words)) if len(words) >= LEAST else []
    if not found:
        return len(words), found, b" ".join(words).decode()
    edge = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        edge[start + period] += 1
        edge[start + length] -= 1
    kept = np.cumsum(edge[:-1]) == 0
    return len(words), found, b" ".join(w for w, k in zip(words, kept.tolist()) if k).decode()


def _collapsed(texts: pd.Series) -> pd.DataFrame:
    made = [collapse(t) for t in texts]
    return pd.DataFrame({
        "n_words": [n for n, _, _ in made],
        "runs": [[{"start": s, "length": n, "period": p} for s, n, p in found] for _, found, _ in made],
        "text": [t for _, _, t in made]})


def with_runs(docs: DataFrame, result: str = "periodic") -> DataFrame:
    """All rows and columns, and the struct `periodic`: n_words, runs, and text, the words that stay joined by a space."""
    made = F.pandas_udf(_collapsed, RESULT)(F.coalesce(docs["text"].cast("string"), F.lit("")))
    return docs.select(*[docs[f"`{c}`"] for c in docs.columns if c != result], made.alias(result))
