"""The registered queries themselves, on the odd rows and a tiny corpus, against plain versions."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from fixtures import odd_rows, prose
from test_hot_and_odd import alike
from test_operators import bag, fingerprint, groups, words_left
from tokenizers import Tokenizer

from arrearview.llm import cotraining

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def sf(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(odd_rows(), DOCS).repartition(3).write.parquet(f"{path}/documents.parquet")
    items = [(0, prose(7, 60)), (1, prose(40, 30)), (2, None), (3, "one two")]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, i % 2, 0) for i in range(12)] + [(None, 1, 1), (3, None, None)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def rows():
    return [(d, t) for d, t, *_ in odd_rows()]


def run(spark, sf, name):
    from arrearview.llm.queries import QUERIES

    return QUERIES[name](spark, sf)


def test_op1(spark, sf, rows):
    out = run(spark, sf, "op1_cotraining")
    assert out.columns == ["doc_id", "score", "text_score", "meta_score", "good"]
    got = out.collect()
    assert Counter(r["doc_id"] for r in got) == Counter(d for d, _ in rows)
    assert all(0 <= r[c] <= 1 for r in got for c in ("score", "text_score", "meta_score"))
    assert all(r["good"] == (r["score"] >= 0.5) for r in got)


def test_pseudo_labels_do_not_drown_labels():
    base, given = np.array([[8.0, 2.0], [0.0, 10.0]]), np.array([[400.0, 600.0], [1.0, 0.0]])
    added = given * cotraining._weight(base, given, 0.2)
    assert np.allclose(added, [[0.8, 1.2], [1.0, 0.0]])


def test_op3(spark, sf, rows):
    want = [(d, n, gone, hashlib.sha256(left).hexdigest()) for d, n, gone, left in words_left(rows)]
    assert bag(map(tuple, run(spark, sf, "op3_seed_extend").collect())) == bag(want)


def test_op4(spark, sf, rows):
    want = [(d, f"{f:016x}", c) for d, f, c in groups([(d, fingerprint(t)) for d, t in rows])]
    assert bag(map(tuple, run(spark, sf, "op4_simhash").collect())) == bag(want)


def test_op5(spark, sf, rows):
    items = [(0, prose(7, 60).split()), (1, prose(40, 30).split())]
    want = set()
    for d, text in rows:
        words = (text or "").lower().replace("<|endoftext|>", "endoftext").split()
        for i, item in items:
            n = len(item)
            if len(words) >= 5 and max(alike(words[s:s + n], item) for s in range(max(1, len(words) - n + 1))
                                       if set(words[s:s + n]) & set(item) or s == 0) >= 0.8:
                want.add((d, i))
    got = run(spark, sf, "op5_decontamination").collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and all(r["similarity"] >= 0.8 for r in got)


def test_op6(spark, sf, rows):
    times = Counter()
    for d, t in rows:
        b = (t or "").encode()
        times.update(b[i:i + 200] for i in range(len(b) - 199) if d is not None)
    want = []
    for d, t in rows:
        b, edge = (t or "").encode(), Counter()
        for i in range(len(b) - 199) if d is not None else ():
            if times[b[i:i + 200]] > 1:
                edge[i] += 1
                edge[i + 200] -= 1
        depth = np.cumsum([edge[i] for i in range(len(b))]) > 0 if b else np.empty(0, bool)
        spans = int((np.diff(np.r_[False, depth].astype(int)) == 1).sum())
        left = bytes(x for x, g in zip(b, depth) if not g)
        want.append((d, len(b), int(depth.sum()), spans, hashlib.sha256(left).hexdigest()))
    assert bag(map(tuple, run(spark, sf, "op6_bwt_repeats").collect())) == bag(want)


def plain_language(learn):
    """Mean log share of a text's letter pairs in each language."""
    counts = defaultdict(Counter)
    for text, lang in learn:
        counts[lang].update(zip(text.lower(), text.lower()[1:]))
    return lambda text: max(sorted(counts), key=lambda la: sum(
        math.log((counts[la][p] + 0.5) / (sum(counts[la].values()) + 500)) for p in zip(text.lower(), text.lower()[1:])))


def test_op7(spark, star_dir, tmp_path):
    """Held-out accuracy, and that the languages of held-out documents are not looked at."""
    docs = spark.read.parquet(f"{star_dir}/documents.parquet").select("doc_id", "text", "lang")
    held = lambda d: zlib.crc32(str(d).encode()) % 3 == 1
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in docs.collect()]
    spark.createDataFrame([(d, t, "xx" if held(d) else la) for d, t, la in rows], docs.schema).write.parquet(
        f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in run(spark, str(tmp_path), "op7_language_id").collect()}
    assert len(out) == len(rows) and all(out[d]["held_out"] == held(d) for d, *_ in rows)
    plain = plain_language([(t, la) for d, t, la in rows if t and la and not held(d)])
    asked = [(d, t, la) for d, t, la in rows if held(d) and la and t and any(c.isalpha() for c in t)]
    right = sum(out[d]["lang_pred"] == la for d, _, la in asked)
    assert right >= max(0.98 * len(asked), sum(plain(t) == la for _, t, la in asked) - 1)


def test_op10(spark, sf, rows):
    tokenizer, expected, bins = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), Counter(), defaultdict(list)
    for d, t in rows:
        ids, at, k = tokenizer.encode(t or "", add_special_tokens=False).ids + [0], 0, 0
        while at < len(ids):
            n = (len(ids) - 1) % 2048 + 1 if at == 0 else 2048
            expected[d, k, at, n, zlib.crc32(np.array(ids[at:at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    got = run(spark, sf, "op10_packing").collect()
    assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == expected
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in bins.values():
        ends = np.cumsum([n for _, n in sorted(places)])
        assert [o for o, _ in sorted(places)] == [0, *ends[:-1]] and ends[-1] <= 2048
    assert len(bins) == -(-sum(n for p in bins.values() for _, n in p) // 2048)
