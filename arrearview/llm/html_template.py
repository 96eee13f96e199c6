"""Main text of web pages by equivalence-class template deduction.

Pages of one host are filled-in templates. A page's tokens are the tags of its blocks, each with its path in the tree as
role, and the strings between tags. A token's occurrence vector says how often it occurs on each page of the host; tokens
with the same vector on at least four pages, and on 5 % of the host's, form an equivalence class if a tag is among them.
A class is valid if on every page its tokens occur in the same order, instance after instance, and its instances nest in
those of other classes. The valid classes are the host's template; what lies between two successive tokens of an instance
is a slot.

A page's main text comes from the slots: strings that belong to the template themselves go (in a class with the tag that
holds them), and slots whose words are mostly links on the host's pages go. Of the rest, the article is what stands in an
`article` element or one named like it, else in `main`, else in the innermost template element that pages have once and
that holds 60 % of the words of such pages; menus, headers, footers, sidebars, notices, adverts, forms, scripts and
comments go by element and class names. A page without a template (a host with fewer than four pages, an unknown layout,
no host) is judged by its own elements alone, where blocks of links are menus unless they stand in a marked article.

Occurrence vectors are never gathered: a vector is the sum over pages of 62 bits that hash page and count, so tokens are
counted with map-side sums keyed by host and token, and a host with a third of all pages is many keys. A host's template
has at most 20 times the tokens of its mean page, as each of its tokens is on 5 % of the pages. It is one row, and pages
meet it in a join by host, broadcast only if its size on disk allows, else with skewed hosts split.

A null html is empty and has an empty text; a null url or one without a host has no template; null ids pass through.
Repeated rows come out repeated, and count as pages each time. An empty table gives no rows. All input columns are
returned, but for one named like the result, which is replaced.
"""

from __future__ import annotations

import html as entities
from collections import defaultdict
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from arrearview.llm.common import written
from arrearview.llm.page_tokens import HEADING, LINK, NEVER_HERE, SELDOM_HERE, Parser, Text

HALF = (1 << 31) - 1
COUNTED = "host string, token long, tag boolean, v1 long, v2 long, pages long, total long, place double"
JUDGED = "host string, kind int, class long, gap int, n long, m long"
#: Kinds of JUDGED: violations of a class; words and link words of a slot; words in a tag's element at a depth (`gap`).
BROKEN, SLOT, AREA = 0, 1, 2


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def hosted(pages: DataFrame) -> DataFrame:
    """The input rows as one struct `page`, and their host."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^\s*[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:\s]+)", 1))
    return pages.select(F.struct(*[pages[f"`{c}`"] for c in pages.columns]).alias("page"),
                        F.when(host != "", host).alias("host"), F.coalesce("html", F.lit("")).alias("html"))


def _batches(names: str, rows: list[tuple], size: int = 50_000) -> Iterator[pa.RecordBatch]:
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64()}
    schema = pa.schema([(n, kinds[t]) for n, t in (x.split() for x in names.split(", "))])
    for i in range(0, len(rows), size):
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows[i:i + size]), schema)], schema=schema)


def count_tokens(batches: Iterator[pa.RecordBatch], limit: int = 200_000) -> Iterator[pa.RecordBatch]:
    """Sums of the vectors of each token of a host over the pages of a task; given out when they grow large."""
    parser, sums = Parser(), {}

    def result():
        yield from _batches(COUNTED, [(h, signed(t), *s) for (h, t), s in sums.items()])
        sums.clear()

    for batch in batches:
        for host, html, key in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "key"))):
            tokens, texts = parser.page(html)
            strings, seen = {t.token for t in texts}, {}
            for i, token in enumerate(tokens):
                if token in seen:
                    seen[token][0] += 1
                else:
                    seen[token] = [1, i]
            bits = {}
            for token, (count, first) in seen.items():
                if count not in bits:
                    bits[count] = xxhash.xxh64_intdigest(count.to_bytes(8, "little"), key & ((1 << 64) - 1))
                b, place = bits[count], first / len(tokens)
                s = sums.get((host, token))
                if s is None:
                    sums[host, token] = [token not in strings, b & HALF, b >> 33, 1, count, place]
                else:
                    s[1] += b & HALF
                    s[2] += b >> 33
                    s[3] += 1
                    s[4] += count
                    s[5] += place
            if len(sums) > limit:
                yield from result()
    yield from result()


def classes(pages: DataFrame, least_pages: int, least_share: float) -> DataFrame:
    """host, class and its tokens in order, of the equivalence classes that hold a tag."""
    key = F.xxhash64("page", "html")
    counted = pages.filter("host is not null").select("host", "html", key.alias("key")).mapInArrow(count_tokens, COUNTED)
    tokens = counted.groupBy("host", "token").agg(
        F.max("tag").alias("tag"), *[F.sum(c).alias(c) for c in ("v1", "v2", "pages", "total", "place")])
    often = written(tokens.filter(F.col("pages") >= least_pages))
    # The root element is on nearly every page: the largest number of pages of a token is the host's.
    size = written(often.groupBy("host").agg(F.max("pages").alias("most")))
    often = often.join(size, "host").filter(F.col("pages") >= least_share * F.col("most"))
    member = F.struct(F.col("place") / F.col("pages"), "token", "tag")
    alike = often.groupBy("host", "v1", "v2", "pages", "total").agg(F.array_sort(F.collect_list(member)).alias("tokens"))
    good = F.exists("tokens", lambda t: t["tag"]) & (F.size("tokens") > 1)
    return alike.filter(good).select(
        "host", F.xxhash64("v1", "v2", "total").alias("class"), F.col("pages").alias("on"),
        (F.col("total") == F.col("pages")).alias("once"), F.transform("tokens", lambda t: t["token"]).alias("tokens"))


class Template:
    """What a task knows of a host: class and place of each token, and which classes a page has once."""

    def __init__(self, plan: list[dict] | None, links: list | None = None, area: int | None = None) -> None:
        self.of, self.size, self.once = {}, {}, set()
        for c in plan or ():
            self.size[c["class"]] = len(c["tokens"])
            if c["once"]:
                self.once.add(c["class"])
            for place, token in enumerate(c["tokens"]):
                self.of[token & ((1 << 64) - 1)] = c["class"], place
        self.links = {(x["class"], x["gap"]) for x in links or ()}
        area = area & ((1 << 64) - 1) if area is not None else None
        self.area = area if area in self.of else None

    def fixed(self, text: Text) -> bool:
        """Whether a string belongs to the template: it is in the class of the tag that holds it."""
        mine, tag = self.of.get(text.token), self.of.get(text.parent)
        return mine is not None and tag is not None and mine[0] == tag[0] and not text.marks & HEADING

    def slots(self, tokens: list[int], texts: list[Text]) -> tuple[list[tuple], set[int]]:
        """For each string the open instances around it as (class, gap), outermost first; and the violated classes."""
        strings = {t.at for t in texts}
        out, bad, open_now = [], set(), []
        for i, token in enumerate(tokens):
            if i in strings:
                out.append(tuple(open_now))
            if token not in self.of:
                continue
            name, place = self.of[token]
            if place and any(c == name for c, _ in open_now):
                while open_now[-1][0] != name:
                    bad.add(open_now.pop()[0])  # not closed inside the gap that it began in
                if open_now[-1][1] != place - 1:
                    bad.add(name)
                if place == self.size[name] - 1:
                    open_now.pop()
                else:
                    open_now[-1] = name, place
            elif place:
                bad.add(name)
            else:
                if any(c == name for c, _ in open_now):
                    bad.add(name)
                    while open_now.pop()[0] != name:
                        pass
                open_now.append((name, 0))
        bad.update(c for c, _ in open_now)
        return out, bad


def _templates(batches: Iterator[pa.RecordBatch], columns: list[str], limit: int = 64) -> Iterator[tuple]:
    """Batches with the Template of each row; a host's is made once while its pages follow each other closely."""
    held: dict = {}
    for batch in batches:
        hosts, found = batch.column("host").to_pylist(), []
        parts = [batch.column(c) if c in batch.schema.names else None for c in ("plan", *columns)]
        for i, host in enumerate(hosts):
            if host not in held:
                if len(held) >= limit:
                    held.clear()
                held[host] = Template(*(p[i].as_py() for p in parts if p is not None))
            found.append(held[host])
        yield batch, hosts, found


def areas(parser: Parser, texts: list[Text], once) -> list[tuple[int, int, int]]:
    """Depth, path and words outside links of the elements that a page has once; of pages without a marked article."""
    words: dict = defaultdict(int)
    shown = [t for t in texts if not t.marks & (NEVER_HERE | SELDOM_HERE)]
    if not any(t.level for t in shown):
        for t in shown:
            if not t.marks & LINK:
                for depth, path in enumerate(parser.ancestors(t.parent)):
                    if once(path):
                        words[depth, path] += len(t.text.split())
    return [(depth, path, n) for (depth, path), n in words.items()]


def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counted over the pages of a task: violations of classes, and the words of slots."""
    parser, sums = Parser(), defaultdict(lambda: [0, 0])

    def result():
        yield from _batches(JUDGED, [(*k, *v) for k, v in sums.items()])
        sums.clear()

    for batch, hosts, templates in _templates(batches, []):
        for host, html, template in zip(hosts, batch.column("html").to_pylist(), templates):
            tokens, texts = parser.page(html)
            around, bad = template.slots(tokens, texts)
            for c in bad:
                sums[host, BROKEN, c, 0][0] += 1
            for text, slots in zip(texts, around):
                if text.marks & (NEVER_HERE | SELDOM_HERE) or template.fixed(text) or not slots:
                    continue
                words, links = len(text.text.split()), text.marks & LINK
                s = sums[host, SLOT, *slots[-1]]
                s[0] += words
                s[1] += words if links else 0
            once = lambda path: path in template.of and template.of[path][0] in template.once
            for depth, path, words in areas(parser, [t for t in texts if not template.fixed(t)], once):
                sums[host, AREA, signed(path), depth][0] += words
        if len(sums) > 100_000:
            yield from result()
    yield from result()


def deduced(pages: DataFrame, least_pages: int, least_share: float, area_share: float) -> DataFrame:
    """One row per host: plan (its valid classes), links (slots that hold links) and area (the slot of most words)."""
    found = written(classes(pages, least_pages, least_share))
    plans = written(found.groupBy("host").agg(
        F.collect_list(F.struct("class", "once", "tokens")).alias("plan")))
    judged = written(pages.select("host", "html").join(plans, "host").mapInArrow(judge, JUDGED)
                     .groupBy("host", "kind", "class", "gap").agg(F.sum("n").alias("n"), F.sum("m").alias("m")))
    bad = judged.filter(F.col("kind") == BROKEN).select("host", "class")
    valid = found.join(bad, ["host", "class"], "left_anti")
    plan = valid.groupBy("host").agg(F.collect_list(F.struct("class", "once", "tokens")).alias("plan"))
    links = judged.filter((F.col("kind") == SLOT) & (2 * F.col("m") > F.col("n"))).groupBy("host").agg(
        F.collect_list(F.struct("class", "gap")).alias("links"))
    held = judged.filter(F.col("kind") == AREA)
    most = held.groupBy("host").agg(F.max("n").alias("most"))
    area = held.join(most, "host").filter(F.col("n") >= area_share * F.col("most")).groupBy("host").agg(
        F.max(F.struct("gap", "n", "class"))["class"].alias("area"))
    return plan.join(links, "host", "left").join(area, "host", "left")


def blocks_of(texts: list[Text]) -> list[str]:
    """The texts of blocks, decoded, each run of white space one space."""
    out, now = [], None
    for text in texts:
        if text.block != now:
            out.append([])
            now = text.block
        out[-1].append(text.text)
    decoded = (" ".join(entities.unescape("".join(parts)).split()) for parts in out)
    return [b for b in decoded if b]


def main_blocks(parser: Parser, html: str, template: Template, area_share: float = 0.6) -> list[str]:
    tokens, texts = parser.page(html)
    around, _ = template.slots(tokens, texts)
    rest = [(t, slots) for t, slots in zip(texts, around) if not t.marks & (NEVER_HERE | SELDOM_HERE)]
    level = max((t.level for t, _ in rest), default=0)
    if level:
        rest = [(t, slots) for t, slots in rest if t.level == level]
    else:
        inside = lambda area: [x for x in rest if area in parser.ancestors(x[0].parent)]
        if template.area is not None and (found := inside(template.area)):
            rest = found
        else:
            held = areas(parser, texts, lambda path: tokens.count(path) == 1)
            most = max((n for _, _, n in held), default=0)
            rest = inside(max(x for x in held if x[2] >= area_share * most)[1]) if held else rest
            prose = {t.block for t, _ in rest if not t.marks & LINK}
            rest = [(t, slots) for t, slots in rest if t.block in prose]  # blocks of links alone are menus
    kept = [t for t, slots in rest if not template.fixed(t) and not (slots and slots[-1] in template.links)]
    return blocks_of(kept or [t for t, _ in rest])


def extract(batches: Iterator[pa.RecordBatch], area_share: float) -> Iterator[pa.RecordBatch]:
    parser = Parser()
    for batch, _, templates in _templates(batches, ["links", "area"]):
        made = [main_blocks(parser, html, template, area_share)
                for html, template in zip(batch.column("html").to_pylist(), templates)]
        yield pa.record_batch([batch.column("page"), pa.array(made, pa.list_(pa.string()))], ["page", "blocks"])


def with_main_text(pages: DataFrame, result: str = "main", least_pages: int = 4, least_share: float = 0.05,
                   area_share: float = 0.6) -> DataFrame:
    """All rows and columns, and the struct `main`: blocks, and text, the blocks joined by an empty line."""
    own = hosted(pages)
    templates = written(deduced(own, least_pages, least_share, area_share))
    shape = own.select("page").schema.fields + [T.StructField("blocks", T.ArrayType(T.StringType()))]
    made = own.join(templates, "host", "left").mapInArrow(partial(extract, area_share=area_share), T.StructType(shape))
    main = F.struct("blocks", F.array_join("blocks", "\n\n").alias("text"))
    kept = [F.col(f"page.`{c}`").alias(c) for c in pages.columns if c != result]
    return made.select(*kept, main.alias(result))
