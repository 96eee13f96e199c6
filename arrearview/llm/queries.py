"""The registered queries of this subpackage, each over its whole table, and their DuckDB checks."""

from __future__ import annotations

import os
import zlib

import pandas as pd
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from arrearview.llm import (
    bwt_repeats, chat_format, cotraining, decontaminate, hard_negatives, html_template, language_id, line_rules, packing,
    periodic_runs, seed_extend, simhash, token_counts,
)
from arrearview.llm.common import read

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.scored(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op2_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.with_rules(read(spark, sf_dir, "documents")).select(
        "doc_id", "rules.n_words", "rules.word_chars", "rules.n_symbols", "rules.n_dup_lines", "rules.n_repeat_words",
        "rules.base_failed", F.col("rules.n_lines_removed").cast("long").alias("n_lines_removed"),
        "rules.n_words_removed", "rules.kept")


def op3_seed_extend(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    left = seed_extend.without_repeats(docs).withColumn(
        "left", F.pandas_udf(seed_extend.word_digest, "n long, sha256 string")("text"))
    return left.select("doc_id", (F.col("left.n") + F.col("repeats.n_removed")).alias("n_words"), "repeats.n_removed",
                       F.col("left.sha256").alias("kept_sha256"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.leaks(docs, read(spark, sf_dir, "benchmark")).select(
        "doc_id", "item_id", "start", "hamming", "similarity")


def op6_bwt_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_repeats.without_repeats(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("bytes", 256).alias("kept_sha256"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return language_id.language_of(docs).select("doc_id", "held_out", "lang_pred", "score",
                                                F.size("spans").alias("n_spans"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                F.lit(probe).alias("text"))
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    made = chat_format.formatted(chat_format.conversation_records(rows))
    back = made.select("conv_id", "layout", "formatted", chat_format.read_turns(F.col("formatted")).alias("back"),
                       chat_format.read_masked(F.col("formatted"), F.col("loss_mask")).alias("learned"))
    text = F.array_join(F.transform("back", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"),
                       F.char_length("learned").cast("long").alias("loss_chars"),
                       F.sha2("learned", 256).alias("loss_sha256"),
                       F.char_length("formatted").cast("long").alias("formatted_chars"))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(read(spark, sf_dir, "documents"), TOKENIZER)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(packing.pieces_of(read(spark, sf_dir, "documents"), TOKENIZER))


def op11_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_template.with_main_text(read(spark, sf_dir, "pages")).select(
        "page_id", "url", "main.text", F.char_length("main.text").cast("long").alias("n_chars"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = read(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hard_negatives.mined(rows, F.col("id") % 100 == 0)


def with_repetition(ids: pd.Series, texts: pd.Series) -> pd.Series:
    """The texts, those of every tenth CRC-32 of an id repeating a stretch of its words up to the end."""
    out = []
    for doc, text in zip(ids, texts):
        g, rest = divmod(zlib.crc32(doc.encode()), 10) if doc is not None else (0, 1)
        words = text.encode().split() if rest == 0 and text else []
        if words:
            n, a = len(words), g % len(words)
            period = 1 + (n - a) // (3 + g % 8)
            unit = words[a:a + period]
            text = b" ".join(words[:a] + (unit * -(-(n - a) // period))[:n - a]).decode()
        out.append(text)
    return pd.Series(out, dtype=object)


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select(
        "doc_id", F.pandas_udf(with_repetition, "string")(F.col("doc_id").cast("string"), "text").alias("text"))
    runs = F.col("periodic.runs")
    best = F.array_max(F.transform(runs, lambda r: F.struct(
        (r["length"] / r["period"]).alias("exponent"), (-r["start"]).alias("start"), (-r["period"]).alias("period"),
        r["length"].alias("length"))))
    lines = F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return periodic_runs.with_runs(docs).withColumn("best", best).select(
        "doc_id", F.size(runs).cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), "best.length",
        (-F.col("best.period")).alias("period"),
        F.floor(1000 * F.col("best.length") / -F.col("best.period")).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2(F.col("periodic.text"), 256).alias("collapsed_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _reachable(query):
    """Python workers of a session that was started elsewhere find this package, too."""
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        env = spark.sparkContext.environment
        paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
        if ROOT not in paths:
            env["PYTHONPATH"] = os.pathsep.join([ROOT, *paths])
        return query(spark, sf_dir)

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {q.__name__: _reachable(q) for q in (
    op1_cotraining, op2_line_rules, op3_seed_extend, op4_simhash, op5_decontamination, op6_bwt_repeats,
    op7_language_id, op8_chat_format, op9_token_counts, op10_packing, op11_html_template,
    op12_hard_negatives, op13_periodic_runs, pipeline)}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"
_NORMAL = r"trim(regexp_replace(lower(line), '[\x20\x09-\x0D]+', ' ', 'g'))"

CHECKS = {
    "op2_line_rules": rf"""
with d as materialized (select doc_id, coalesce(text, '') as text, coalesce(source, '') as host, {_WORDS} as w,
                  row_number() over () as r from documents),
l as (select r, host, text, line, {_NORMAL} as norm
      from (select r, host, text, unnest(string_split(text, chr(10))) as line from d)),
counted as (select host, norm, count(distinct text) as n from l where norm <> '' group by all),
hosts as (select host, count(distinct text) as texts from d group by host),
bad as (select host, norm from counted join hosts using (host) where n > 5 and n > 0.05 * texts),
cut as (select r, count(*) as n_lines_removed,
               sum(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+'))) as n_words_removed
        from (select r, host, line, norm from l) semi join bad using (host, norm) group by r),
dup as (select r, count(*) - count(distinct line) as n_dup_lines
        from l where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
win as (select r, i, array_to_string(w[i:i + 7], ' ') as g
        from (select r, w, unnest(range(1, len(w) - 6)) as i from d)),
twice as (select r, i from (select r, i, count(*) over (partition by r, g) as n from win) where n > 1),
rep as (select r, count(distinct i + o) as n_repeat_words from twice, (select unnest(range(8)) as o) group by r),
f as (select doc_id, len(w)::bigint as n_words, length(array_to_string(w, ''))::bigint as word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
             coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
             coalesce(n_lines_removed, 0)::bigint as n_lines_removed,
             coalesce(n_words_removed, 0)::bigint as n_words_removed
      from d left join dup using (r) left join rep using (r) left join cut using (r))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines_removed, n_words_removed,
       (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
       not (n_words < 20 or 100 * n_repeat_words > 30 * n_words) and n_words - n_words_removed >= 20
           and n_words_removed <= 0.5 * n_words as kept
from f""",
    "op3_seed_extend": rf"""
with d as (select doc_id, {_WORDS} as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 12], ' ') as g
        from (select doc_id, w, unnest(range(1, len(w) - 11)) as i from d)),
late as (select doc_id, i from (select doc_id, i, min(doc_id) over (partition by g) as f from win) where f < doc_id),
gone as (select distinct doc_id, i + o as i from late, (select unnest(range(13)) as o)),
words as (select doc_id, unnest(w) as word, unnest(range(1, len(w) + 1)) as i from d),
kept as (select doc_id, string_agg(word, ' ' order by i) as text, count(*) as n
         from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, len(w)::bigint as n_words, (len(w) - coalesce(n, 0))::bigint as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from d left join kept using (doc_id)""",
    "op8_chat_format": r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -1, t, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(t, r)),
e as (select *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') as safe_role,
             regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') as safe_text from c)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(safe_role) + length(safe_text) + 20)::bigint as formatted_chars
from e group by conv_id""",
    "op12_hard_negatives": """
with e as materialized (
    select distinct vec_id as id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
           list_transform(embedding, lambda x: floor(256 * x::double)) as v
    from embeddings
    where vec_id is not null and label is not null and embedding is not null
      and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as materialized (
    select a.id as anchor_id, a.label = e.label as same, e.id, list_inner_product(a.v, e.v)::bigint as score
    from e a join e on a.id <> e.id where a.id % 100 = 0),
p as (select anchor_id, id as positive_id, score as positive_score from s where same
      qualify row_number() over (partition by anchor_id order by score desc, id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, id)::int as rank,
       id as negative_id, positive_score, score as negative_score
from p join s using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10""",
    "op13_periodic_runs": r"""
with w0 as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w,
       xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(doc_id::varchar) + 1),
                            lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint)),
           lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, (x & 1) * 3988292384))),
           4294967295) as h,
       row_number() over () as r from documents),
w1 as (select r, doc_id, w, len(w) as n, h, h // 10 as g,
              case when h % 10 = 0 and len(w) > 0 then (h // 10) % len(w) end as a from w0),
d as (select r, doc_id, n, case when a is null then w else
             list_transform(range(0, n), lambda i: w[1 + case when i < a then i
                            else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end]) end as w from w1),
win as (select r, i, hash(array_to_string(w[i + 1:i + 12], ' ')) as k
        from (select r, w, unnest(range(0, n - 11)) as i from d)),
lag as materialized (select distinct x.r, y.i - x.i as q from win x join win y on x.r = y.r and x.k = y.k and x.i < y.i),
eq as (select r, q, n, w, unnest(range(0, n - q)) as i from lag join d using (r) where 3 * q <= n and n >= 24),
hit as (select r, q, i, i - row_number() over (partition by r, q order by i) as part from eq where w[i + 1] = w[i + q + 1]),
st as (select r, q, min(i) as s, count(*) + q as len from hit group by r, q, part having count(*) + q >= greatest(24, 3 * q)),
run as materialized (select * from st a where not exists (select 1 from st b where b.r = a.r and b.q < a.q and a.q % b.q = 0
                     and b.s <= a.s and b.s + b.len >= a.s + a.len)),
gone as (select distinct r, unnest(range(s + q, s + len)) as i from run),
kept as (select r, string_agg(x, ' ' order by i) as text from
         (select r, unnest(w) as x, unnest(range(0, n)) as i from d) anti join gone using (r, i) group by r),
agg as (select r, count(*) as n_runs, string_agg(s || ',' || len || ',' || q || chr(10), '' order by s, q) as t from run group by r),
best as (select r, s, len, q from run qualify row_number() over (partition by r order by len::double / q desc, s, q) = 1)
select doc_id, coalesce(n_runs, 0)::bigint as n_runs, s::bigint as start, len::bigint as length, q::bigint as period,
       (1000 * len // q)::bigint as exponent_milli, sha256(coalesce(t, '')) as runs_sha256,
       sha256(coalesce(kept.text, '')) as collapsed_sha256
from d left join agg using (r) left join best using (r) left join kept using (r)""",
}
