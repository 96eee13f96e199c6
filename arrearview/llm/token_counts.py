"""Token counts by two-tier lookup on the map side.

Tier one is a compact table of frequent pre-tokens and how many tokens they make, sent once to every task. Its size is
bounded: at most `table_size` entries of at most 64 characters. They are counted over all documents: each task keeps a
bounded counter and emits those of its `table_size` most frequent that make up a 100,000th of its pre-tokens; these are
summed, and a histogram of the sums (some hundred rows) gives the least sum that at most `table_size` of them reach, so
the driver never collects more. The table only decides what is fast, never a count. Tier two is each worker's own cache,
filled by encoding the pre-tokens that tier one lacks. Only the tasks' summaries are shuffled, no documents and no stream
of their pre-tokens: the counts are one map over the documents.

Null texts count as empty; an empty table gives no rows, and a task without pre-tokens adds nothing to the table. Rows
keep their order of columns doc_id, n_bytes, n_tokens, over_limit; other columns of the input are ignored, repeated rows
and null ids come out as they went in.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arrearview.llm.common import discard, written
from arrearview.llm.tokens import Encoder

SCHEMA = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class Lengths(dict):
    """Pre-token to its number of tokens: the broadcast table first, then what this worker has encoded."""

    LIMIT = 1 << 18

    def __init__(self, path: str, frequent: dict[str, int]) -> None:
        super().__init__(frequent)
        self.frequent, self.encoder = frequent, Encoder(path)

    def __missing__(self, pretoken: str) -> int:
        self[pretoken] = n = self.encoder.piece_length(pretoken)
        return n

    def count(self, text: str) -> int:
        if len(self) > self.LIMIT:
            self.clear()
            self.update(self.frequent)
        if self.encoder.ordinary(text):
            return sum(map(self.__getitem__, self.encoder.pretokens(text)))
        return len(self.encoder.whole(text))


def frequent_lengths(docs: DataFrame, path: str, table_size: int = 20_000) -> dict[str, int]:
    """The most frequent pre-tokens of all documents with their token counts."""
    def count(frames):
        import pandas as pd

        encoder, seen = Encoder(path), Counter()
        for frame in frames:
            for text in frame["text"]:
                if encoder.ordinary(text):
                    seen.update(x for x in encoder.pretokens(text) if len(x) <= 64)
                if len(seen) > Lengths.LIMIT:  # a worker's memory stays bounded
                    seen = Counter(dict(seen.most_common(Lengths.LIMIT // 2)))
        least = sum(seen.values()) / 100_000
        top = [(x, n) for x, n in seen.most_common(table_size) if n >= least]
        if top:
            yield pd.DataFrame(top, columns=["pretoken", "seen"])

    per_task = docs.select("text").filter("text is not null").mapInPandas(count, "pretoken string, seen long")
    summed = written(per_task.groupBy("pretoken").agg(F.sum("seen").alias("seen")))
    size = F.floor(8 * F.log2("seen"))  # pre-tokens of nearly one frequency; a long has at most 505 such sizes
    least, kept = None, 0
    for row in summed.groupBy(size.alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("size")).collect():
        kept += row["n"]
        if kept > table_size:
            break
        least = row["size"]
    lengths = Lengths(path, {})
    top = summed.filter(size >= least).select("pretoken").collect() if least is not None else []
    discard(summed)
    return {r["pretoken"]: lengths[r["pretoken"]] for r in top}


def token_counts(docs: DataFrame, path: str, limit: int = 1024, table_size: int = 20_000) -> DataFrame:
    frequent = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path, table_size))

    def count(frames):
        import pandas as pd

        lengths = Lengths(path, frequent.value)
        for frame in frames:
            n = [lengths.count(t) for t in frame["text"]]
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n_bytes": [len(t.encode()) for t in frame["text"]],
                                "n_tokens": n, "over_limit": [x > limit for x in n]})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInPandas(count, SCHEMA)
