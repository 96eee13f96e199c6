"""Template deduction and main text against plain versions, and sites of several shapes."""

import html
import random
import re
from collections import Counter, defaultdict

import pytest
from fixtures import prose
from pyspark.sql import functions as F

from arrearview.llm import html_template
from arrearview.llm.page_tokens import Parser

SCHEMA = "page_id long, url string, html string"


def article(page: str) -> str:
    """The main text of the given tables' pages, by their one known shape."""
    inside = page.split("<article>")[1].split("</article>")[0]
    blocks = re.split(r"</?(?:p|h1)>", re.sub(r"</?b>|<br>", "", inside))
    return "\n\n".join(x for x in (" ".join(html.unescape(b).split()) for b in blocks) if x)


def test_query(spark, star_dir):
    from arrearview.llm.queries import QUERIES

    pages = spark.read.parquet(f"{star_dir}/pages.parquet").collect()
    want = Counter((p["page_id"], p["url"], article(p["html"]), len(article(p["html"]))) for p in pages)
    got = QUERIES["op11_html_template"](spark, star_dir)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == want


def soup(i: int, host: str = "soup.example") -> tuple:
    """A page of nameless blocks: a list of links, a fixed line, the text, and rows of links below it."""
    r = random.Random(i)
    text = "".join(f"<p>{prose(1000 * i + j, r.randint(30, 80))}" for j in range(r.randint(2, 6)))
    links = "".join(f"<li><a href='/{j}'>{prose(7 * i + j, 2)}</a>" for j in range(r.randint(3, 6)))
    below = "".join(f"<div class=c3><a href='/x{j}'>{prose(9 * i + j, 5)}</a></div>" for j in range(r.randint(1, 3)))
    page = (f"<html><body><div class=c1><ul>{links}</ul></div><div class=c2><div class=c5>Print or send this</div>"
            f"<h2>{prose(i, 4)}</h2>{text}{below}</div><div class=c4>Made by us &amp; others</div></body></html>")
    return i, f"https://{host}/{i}", page


def soup_text(i: int) -> str:
    r = random.Random(i)
    blocks = [prose(1000 * i + j, r.randint(30, 80)) for j in range(r.randint(2, 6))]
    return "\n\n".join([prose(i, 4), *blocks])


def texts(df):
    return {r["page_id"]: r["main"]["text"] for r in df.collect()}


def test_site_without_names(spark):
    rows = [soup(i) for i in range(40)]
    got = texts(html_template.with_main_text(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    assert got == {i: soup_text(i) for i in range(40)}


def test_vectors(spark):
    """Classes equal those of whole occurrence vectors."""
    rows = [soup(i, f"h{i % 2}.example") for i in range(30)]
    parser, vectors, tags = Parser(), defaultdict(lambda: defaultdict(dict)), set()
    for i, url, page in rows:
        tokens, strings = parser.page(page)
        tags |= set(tokens) - {t.token for t in strings}
        for token, n in Counter(tokens).items():
            vectors[url.split("/")[2]][html_template.signed(token)][i] = n
    want = set()
    for host, of in vectors.items():
        alike = defaultdict(set)
        for token, v in of.items():
            if len(v) >= 4:
                alike[tuple(sorted(v.items()))].add(token)
        want |= {(host, frozenset(c)) for c in alike.values()
                 if len(c) > 1 and c & {html_template.signed(t) for t in tags}}
    df = html_template.hosted(spark.createDataFrame(rows, SCHEMA).repartition(4))
    got = {(r["host"], frozenset(r["tokens"])) for r in html_template.classes(df, 4, 0.05).collect()}
    assert got == want and len(got) >= 4


def test_classes_must_be_ordered_and_nested():
    plan = [{"class": 1, "once": True, "tokens": [10, 11, 12]}, {"class": 2, "once": False, "tokens": [20, 21]}]
    t = html_template.Template(plan)
    assert t.slots([10, 20, 21, 20, 21, 11, 20, 21, 12], [])[1] == set()
    assert t.slots([10, 20, 11, 21, 12], [])[1] == {2}
    assert t.slots([11, 10, 12], [])[1] == {1}
    assert t.slots([10, 11], [])[1] == {1}


NAMED = """<html><head><title>T</title></head><body class="has-sidebar"><header class="site-header"><h1>Site</h1></header>
<div id="cookie-notice">We use cookies</div><nav><a href="/">Home</a></nav>
<main><article><header><h1>The &lt;title&gt;</h1></header><p>One <b>two</b>&nbsp;three
 four.<div class="ad-slot">Buy</div><p hidden>secret</p><p>Five<!-- not this --> six &amp; seven<script>var x = "<p>";</script>
<form><input value="v"><label>Name</label></form><table><tr><td>a<td>b<tr><td>c</table>
<section id="comments"><article class="comment"><p>First!</p></article></section></article>
<aside>More</aside></main><footer>&copy; us</footer></body"""


def test_named_parts():
    got = html_template.main_blocks(Parser(), NAMED, html_template.Template(None))
    assert got == ["The <title>", "One two three four.", "Five six & seven", "a", "b", "c"]
    lone = html_template.main_blocks(Parser(), soup(3)[2], html_template.Template(None))
    assert lone == ["Print or send this", *soup_text(3).split("\n\n")]


@pytest.mark.parametrize("page", ["", "<", "<p", "a < b", "<a" * 20000, "<!--" * 5000, "<p 'x>" * 20000, "</p></x>" * 10,
                                  "<script>never closed <p>x</p>", "<div>" * 3000 + "x", "&amp &#x41; &nosuch;", "\x00퟿"])
def test_broken_pages(page):
    html_template.main_blocks(Parser(), page, html_template.Template(None))


def test_odd_rows(spark):
    long = "<article>" + "".join(f"<p>{prose(i, 200)}</p>" for i in range(300)) + "</article>"
    rows = [soup(1), soup(1), soup(1), soup(1), (None, None, None), (2, None, soup(2)[2]), (3, "no host", "plain text"),
            (4, "http://long.example/", long), (5, "http://u@empty.example:80/", ""), (5, "HTTP://EMPTY.example", None)]
    rows += [soup(i) for i in range(6, 20)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    df = df.withColumns({c: F.lit("x") for c in ("host", "page", "plan", "links", "area", "blocks", "main", "class")})
    out = html_template.with_main_text(df)
    assert out.columns == [c for c in df.columns if c != "main"] + ["main"]
    assert out.count() == len(rows) and {r["host"] for r in out.select("host").collect()} == {"x"}
    got = texts(out)
    assert [got[i] for i in (None, 3, 5)] == ["", "plain text", ""] and got[1] == soup_text(1)
    assert got[4].split() == re.sub("<[^>]*>", " ", long).split()
    assert html_template.with_main_text(df.limit(0)).count() == 0
