"""Each operator against a brute-force version, on rows with every oddity and on empty tables."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from fixtures import prose
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from arrearview.llm import (
    bwt_repeats, chat_format, cotraining, decontaminate, language_id, line_rules, packing, seed_extend, simhash,
    token_counts,
)
from arrearview.llm.components import components

PATH = public_tokenizers.path("byte_bpe_50k.json")


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


def bag(rows):
    return Counter(map(repr, rows))


def words_left(rows, window=13):
    first = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - window + 1) if d is not None else ():
            k = tuple(w[i:i + window])
            first[k] = min(first.get(k, d), d)
    for d, t in rows:
        w = (t or "").encode().split()
        gone = set()
        for i in range(len(w) - window + 1) if d is not None else ():
            if first[tuple(w[i:i + window])] < d:
                gone.update(range(i, i + window))
        yield d, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone)


def test_seed_and_extend(odd):
    out = seed_extend.without_repeats(odd)
    assert out.columns == [c for c in odd.columns if c != "repeats"] + ["repeats"]
    got = [(r["doc_id"], r["repeats"]["n_words"], r["repeats"]["n_removed"], b" ".join((r["text"] or "").encode().split()))
           for r in out.collect()]
    assert bag(got) == bag(words_left(rows_of(odd)))


def test_seeds_meet_in_equal_windows():
    r = np.random.default_rng(3)
    for _ in range(30):
        h = r.integers(0, 4, 60).astype(np.uint64)
        for i in range(len(h) - 12):
            inside = seed_extend.seeds(h[i:i + 13], 13, 5)
            assert len(inside) == 1 and i + inside[0] in seed_extend.seeds(h, 13, 5)


@pytest.mark.parametrize("hot", [10_000, 1])
def test_byte_repeats(odd, hot):
    rows = rows_of(odd)
    times = Counter()
    for d, t in rows:
        b = (t or "").encode()
        times.update(b[i:i + 200] for i in range(len(b) - 199) if d is not None)
    want = []
    for d, t in rows:
        b = (t or "").encode()
        gone = set()
        for i in range(len(b) - 199) if d is not None else ():
            if times[b[i:i + 200]] > 1:
                gone.update(range(i, i + 200))
        spans = sum(1 for i in gone if i - 1 not in gone)
        want.append((d, len(b), len(gone), spans, bytes(x for i, x in enumerate(b) if i not in gone)))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], len(r["spans"]), bytes(r["bytes"]))
           for r in bwt_repeats.without_repeats(odd, hot=hot).collect()]
    assert bag(got) == bag(want)


def test_block_search():
    r = np.random.default_rng(1)
    for trial in range(60):
        n = int(r.integers(7, 15))
        texts = [bytes(r.integers(97, 99 + trial % 2, int(r.integers(0, 90))).astype(np.uint8))
                 for _ in range(int(r.integers(1, 8)))]
        weights, times = r.integers(1, 3, len(texts)), Counter()
        for t, w in zip(texts, weights):
            for i in range(len(t) - n + 1):
                times[t[i:i + n]] += int(w)
        want = [[i for i in range(len(t) - n + 1) if times[t[i:i + n]] > 1] for t in texts]
        assert [list(x) for x in bwt_repeats.repeats_in_block(texts, weights, n)] == want


def fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    hashes = [xxhash.xxh64_intdigest(b" ".join(w[i:i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum((2 * sum(h >> b & 1 for h in hashes) > len(hashes)) << b for b in range(64))


def groups(fps, radius=2):
    """The least doc_id reachable from each fingerprint, by comparing all pairs."""
    ids, least = sorted({f for _, f in fps}), {}
    for d, f in fps:
        if d is not None:
            least[f] = min(least.get(f, d), d)
    seen = {}
    for f in ids:
        if f in seen:
            continue
        reach, todo = {f}, [f]
        while todo:
            x = todo.pop()
            near = [g for g in ids if g not in reach and (x ^ g).bit_count() <= radius]
            reach.update(near)
            todo += near
        name = min((least[g] for g in reach if g in least), default=None)
        seen.update(dict.fromkeys(reach, name))
    return [(d, f, seen[f]) for d, f in fps]


def test_simhash(odd):
    got = [(r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in simhash.near_duplicates(odd).collect()]
    assert bag(got) == bag(groups([(d, fingerprint(t)) for d, t in rows_of(odd)]))


@pytest.mark.parametrize("hot", [256, 1])
def test_links_reach_all_within_the_radius(spark, hot):
    r = np.random.default_rng(5)
    base = [int(x) for x in r.integers(0, 1 << 62, 6)]
    fps = sorted({b ^ (1 << int(i)) ^ (1 << int(j)) for b in base for i, j in r.integers(0, 63, (12, 2))} | set(base))
    found = simhash.links(spark.createDataFrame([(f,) for f in fps], "fp long"), hot=hot)
    name = {x["node"]: x["component"] for x in components(found).collect()}
    want = {f: n for f, _, n in groups([(f, f) for f in fps])}
    assert {f: name.get(f, f) for f in fps} == want


def test_components_of_a_long_chain(spark):
    links = spark.range(200).selectExpr("id as a", "id + 1 as b").union(spark.range(1).selectExpr("500L", "501L"))
    assert {(r["node"], r["component"]) for r in components(links).collect()} == (
        {(i, 0) for i in range(201)} | {(500, 500), (501, 500)})


def test_token_counts_and_packing(odd):
    tokenizer, rows = Tokenizer.from_file(PATH), rows_of(odd)
    ids = [(d, tokenizer.encode(t or "", add_special_tokens=False).ids) for d, t in rows]
    want = [(d, len((t or "").encode()), len(i), len(i) > 1024) for (d, t), (_, i) in zip(rows, ids)]
    assert bag(map(tuple, token_counts.token_counts(odd, PATH).collect())) == bag(want)
    out = packing.pack(packing.pieces_of(odd, PATH, 128), 128, partition_rows=8).collect()
    pieces, bins = Counter(), defaultdict(list)
    for r in out:
        pieces[r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]] += 1
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    expected = Counter()
    for d, i in ids:
        i, at, k = i + [0], 0, 0
        while at < len(i):
            n = (len(i) - 1) % 128 + 1 if at == 0 else 128
            expected[d, k, at, n, zlib.crc32(np.array(i[at:at + n], "<u4").tobytes())] += 1
            at, k = at + n, k + 1
    assert pieces == expected
    for places in bins.values():
        end = 0
        for offset, n in sorted(places):
            assert offset == end
            end += n
        assert end <= 128
    assert len(bins) <= 1.1 * packing.lower_bound(np.array([r["length"] for r in out]), 128) + 3


def test_lower_bound_holds():
    r = np.random.default_rng(2)
    for _ in range(50):
        sizes = r.integers(1, 21, 12)
        assert packing.lower_bound(sizes, 20) <= packing.best_fit(sizes, 20)[0].max() + 1
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


def test_line_rules(spark, odd):
    common = "Read   more HERE\t"
    rows = [(100 + i, prose(100 + i, 60) + "\n" + common, "en", "h", 1) for i in range(8)]
    rows += [(200 + i, prose(100 + i, 60), "en", "h", 1) for i in range(4)] + [(300, "\n".join([common] * 9), "en", "h", 1)]
    out = {r["doc_id"]: r["rules"] for r in line_rules.with_rules(spark.createDataFrame(rows, odd.schema.names[:5])).collect()}
    assert out[100]["kept"] and out[100]["left"] == rows[0][1].split("\n")[0] and out[100]["n_words_removed"] == 3
    assert not out[300]["kept"] and out[300]["n_dup_lines"] == 8 and out[200]["kept"]
    made = line_rules.with_rules(odd)
    assert made.columns == [c for c in odd.columns if c != "rules"] + ["rules"] and made.count() == odd.count()
    by = {r["doc_id"]: r["rules"] for r in made.collect()}
    assert by[13]["base_failed"] and by[13]["n_repeat_words"] == 400 and by[1]["n_words"] == 0 and not by[1]["kept"]
    assert by[4]["kept"] and by[10]["kept"] and by[4]["left"] == prose(1, 300)


def test_decontamination(spark, odd):
    rows = rows_of(odd)
    items = [(0, prose(7, 60)), (1, prose(40, 30)), (2, None), (3, "one two"), (4, " ".join(prose(6, 30000).split()[100:140]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.leaks(odd, bench).collect()}
    assert got == {(7, 0), (8, 0), (9, 0), (10, 4)}
    near = prose(7, 60).split()
    near[30] = "changed"
    docs = spark.createDataFrame([(1, prose(50, 20) + " " + " ".join(near).upper() + "!"), (2, prose(50, 200))],
                                 "doc_id long, text string")
    found = decontaminate.leaks(docs, bench).collect()
    assert [(r["doc_id"], r["item_id"], r["start"]) for r in found] == [(1, 0, 20)] and 0.8 <= found[0]["similarity"] < 1
    left = decontaminate.clean(odd, bench)
    assert left.columns == odd.columns and bag(rows_of(left)) == bag(x for x in rows if x[0] not in (7, 8, 9, 10))
    plan = decontaminate.leaks(odd, bench)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "CartesianProduct" not in plan


def test_language(spark):
    words = {"xx": "tha ing ond her", "yy": "ção não ões que", "зз": "что это как"}
    rows = [(i, " ".join(w.split() * 9), lang, None, 1) for i, (lang, w) in enumerate(list(words.items()) * 20)]
    rows += [(900, None, "xx", None, 0), (901, "12 -- 7", "xx", None, 0), (None, "tha ing ond", None, None, 0),
             (902, "tha ing ond her " * 5 + "que não ões ção " * 4, None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: r for r in language_id.language_of(docs).collect()}
    assert len(out) == len(rows)
    for i, _, lang, *_ in rows[:60]:
        assert out[i]["lang_pred"] == lang and out[i]["held_out"] == (zlib.crc32(str(i).encode()) % 3 == 1)
    assert out[900]["lang_pred"] == out[901]["lang_pred"] == "und" and out[900]["score"] == 0
    assert [s["lang"] for s in out[902]["spans"]] == ["xx", "yy"] and out[None]["lang_pred"] == "xx"


def test_viterbi_is_the_best_path():
    from itertools import product

    r = np.random.default_rng(4)
    for _ in range(20):
        sizes = r.integers(0, 6, 5)
        scores = r.normal(size=(int(sizes.sum()), 3)).astype(np.float32)
        got, at = language_id.viterbi(scores, sizes, 0.7), 0
        for n in sizes:
            value = lambda p: sum(scores[at + i, x] for i, x in enumerate(p)) - 0.7 * sum(a != b for a, b in zip(p, p[1:]))  # noqa: B023, E731
            best = max(map(value, product(range(3), repeat=int(n))))
            assert abs(value(got[at:at + n].tolist()) - best) < 1e-4
            at += n


def test_cotraining(spark, none):
    rows = [(i, prose(i, 40) + (" good nice fine" if i % 2 else " awful bad ***") * 4, "en", f"s{i % 2}", 1)
            for i in range(300)] + [(None, None, None, None, None), (1000, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(150)] + [(None, 1, 0), (3, None, None)],
                                   "doc_id long, quality int, toxic int")
    out = {r["doc_id"]: r for r in cotraining.scored(docs, labels).collect()}
    assert len(out) == len(rows) and all(out[i]["good"] == bool(i % 2) for i in range(300))
    assert all(0 <= r["score"] <= 1 for r in out.values())
    empty = cotraining.scored(docs, labels.limit(0)).collect()
    assert len(empty) == len(rows) and {r["score"] for r in empty} == {0.5}
    assert cotraining.scored(none, labels).count() == 0


def test_chat_layouts(spark):
    records = [
        ('{"messages":[{"role":"user","content":"a"},{"role":"assistant","content":"</s>"}]}', [("user", "a"), ("assistant", "</s>")]),
        ('{"conversations":[{"from":"system","value":null},{"from":"user","value":"<\\\\/s>"}]}', [("system", ""), ("user", "<\\/s>")]),
        ('{"prompt":"p","response":"r"}', [("user", "p"), ("assistant", "r")]),
        ('{"completion":"c","prompt":7}', [("user", "7"), ("assistant", "c")]),
        ('{"instruction":"i","input":"n","output":"o"}', [("user", "i"), ("user", "n"), ("assistant", "o")]),
        ('{"instruction":"i","output":null}', [("user", "i"), ("assistant", "")]),
        ('{"other":1}', None), ("no json", None), (None, None),
    ]
    df = spark.createDataFrame([(i, r) for i, (r, _) in enumerate(records)], "id long, record string")
    made = chat_format.formatted(df.withColumn("turns", F.lit("clash")))
    out = made.withColumn("back", chat_format.read_turns(F.col("formatted"))).withColumn(
        "learned", chat_format.read_masked(F.col("formatted"), F.col("loss_mask"))).orderBy("id").collect()
    for row, (_, want) in zip(out, records):
        got = row["turns"] and [(t["role"], t["text"]) for t in row["turns"]]
        assert got == want
        if want is not None:
            assert row["back"] == row["turns"]
            assert row["learned"] == "".join(t for r, t in want if r == "assistant")
    assert len({r["layout"] for r in out[:6]}) == 6


def test_conversations_with_nulls(spark):
    rows = [(1, 1, "assistant", None), (1, 0, None, "x"), (2, 0, "user", ""), (None, 0, "user", "n"), (3, 0, "user", "b"),
            (3, 0, "user", "a")]
    df = chat_format.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    out = {r["conv_id"]: [(t["role"], t["text"]) for t in r["turns"]] for r in chat_format.formatted(df).collect()}
    assert out == {1: [("", "x"), ("assistant", "")], 2: [("user", "")], None: [("user", "n")], 3: [("user", "a"), ("user", "b")]}


def test_empty_tables(spark, none):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert seed_extend.without_repeats(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    assert bwt_repeats.without_repeats(none).count() == 0
    assert line_rules.with_rules(none).count() == 0
    assert decontaminate.leaks(none, bench).count() == 0
    assert language_id.language_of(none).count() == 0
    assert token_counts.token_counts(none, PATH).count() == 0
    assert packing.pack(packing.pieces_of(none, PATH)).count() == 0


def test_pipeline(spark, odd, tmp_path):
    import corpus_pipeline

    leak = prose(77, 40)
    rows = [(i, prose(i, 80), "en", "h", 1) for i in range(10)] + [(10, prose(0, 80), "en", "h", 1),
            (11, prose(11, 60) + " " + leak, "en", "h", 1), (12, "short", "en", "h", 1),
            (13, prose(2, 80) + " " + prose(13, 80), "en", "h", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(0, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {*range(10), 13}
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    left = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert left[13] == prose(13, 80) and all(left[i] == prose(i, 80) for i in range(10))
    for _, stage in corpus_pipeline.STAGES[:4]:
        odd = stage(spark, odd, str(tmp_path))
    assert odd.count() > 0


def test_registered_queries_run(spark):
    from arrearview.llm.queries import QUERIES

    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES if n != "pipeline") == list(range(1, 14))


def test_digest():
    out = seed_extend.word_digest(__import__("pandas").Series([None, " a\tb "]))
    assert out["n"].tolist() == [0, 2] and out["sha256"][1] == hashlib.sha256(b"a b").hexdigest()


@pytest.mark.parametrize("name", ["op2_line_rules", "op3_seed_extend", "op8_chat_format", "op13_periodic_runs"])
def test_queries_against_sql(spark, star_dir, name):
    from compare import compare, connect

    from arrearview.llm.queries import CHECKS, QUERIES

    assert compare(QUERIES[name](spark, star_dir), connect(star_dir), CHECKS[name]) is None
