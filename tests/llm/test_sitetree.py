import math
import random
from collections import Counter, defaultdict

import pytest

from tessella.llm import sitetree

SCHEMA = "page_id long, url string, html string, text int, n_chars string, host string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa".split()


def sentence(rng):
    return " ".join(rng.choice(WORDS) for _ in range(12))


def site(rng, host, n):
    """Pages of a template without a word that tells: the menu, the box and the line at the end are all ``div``s of one look."""
    for i in range(n):
        body = [sentence(rng) for _ in range(rng.randrange(2, 7))]
        lead = "<i>x</i>" * rng.randrange(4)
        yield (
            f"https://{host}/p/{i}",
            f'<html><body><div class="a1"><ul><li>Home<li>News<li>About</ul></div><div class="b"><h2>Top {host}</h2><p>offer of the day</div><div class="c"><h1>{sentence(rng)}</h1>'
            + "".join(f"<p>{lead}{b}</p>" for b in body) + '</div><div class="z">All rights</div></body>',
            ["x" * lead.count("x") + b for b in body],
        )


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "n", "h") for r in rows], SCHEMA)


@pytest.mark.parametrize("threshold", ["-1", "10m"])
def test_tree_finds_templates(spark, threshold):
    """No element has a meaning and no class a word: what all pages of a host agree on goes, what differs stays whole; with trees sent and shuffled."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    rng = random.Random(1)
    pages = [p for host in ("one.example", "two.example:80") for p in site(rng, host, 40)]
    rows = [(i, u, h) for i, (u, h, _) in enumerate(pages)]
    got = {r.page_id: r for r in sitetree.main_texts(frame(spark, rows)).collect()}
    for i, (url, _, body) in enumerate(pages):
        assert got[i].text.split("\n")[1:] == body and got[i].url == url and got[i].n_chars == len(got[i].text) and got[i].host == "h"
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars", "host"}


def test_importance_is_that_of_plain_counts(spark):
    rng = random.Random(2)
    pages = [(i, f"http://h{i % 3}.example/{i}", h) for i, (_, h, _) in enumerate(site(rng, "x", 30))] + [(99, "http://alone.example/", "<p>a")]
    seen = defaultdict(lambda: (Counter(), Counter()))
    for _, url, page in pages:
        for node, values in sitetree.outlined(page).items():
            for counter, v in zip(seen[url.split("/")[2], node], values, strict=True):
                counter[v] += 1
    want = {}
    for key, counters in seen.items():
        m = sum(counters[0].values())
        if m > 1:
            want[key] = [((-sum(c / m * math.log(c / m) for c in k.values()) / math.log(m)) * m + 2) / (m + 2) for k in counters]
    found = sitetree.trees(frame(spark, pages).selectExpr("split(url, '/')[2] AS _site_host", "html AS _site_page")).collect()
    got = {(r._site_host, n.node): [n.looks, n.says] for r in found for n in r._site_tree}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_meanings():
    page = """<!DOCTYPE html><head><title>t</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1></header><script>var a = "</p><p>no";</script>
    <div class="page-with-sidebar"><div id="cookie-notice">We use</div><main><article><header><h1>T &amp; x&nbsp;&#33;</h1></header><p>One
     line<!-- hidden --><p>Two <b>bold</b><span class="ad">buy</span> end<ul><li>a<li>b</ul><div class="comments"><p>first!</div></article></main><aside>beside</aside></div>
    <form>Name <input><button>go</button></form><nav>menu</nav><p hidden>h<p style="display: none">n<footer>&copy;</footer>"""
    assert sitetree.extracted(page, {}) == "T & x !\nOne line\nTwo bold end\na\nb"
    assert sitetree.extracted("<div>a longer line beside it, without a name of its own</div><article><p>short one</p></article>", {}) == "short one"
    assert sitetree.extracted("<article>x</article><div>the text of this page is here</div>", {}) == "x\nthe text of this page is here"
    assert sitetree.extracted("plain < text<br>on &lt;p&gt;", {}) == "plain < text on <p>"
    assert sitetree.extracted('<div class="sidebar">the only text, and a long one</div><div class="ad">x</div>', {}) == "the only text, and a long one"
    assert sitetree.extracted("<nav>only menu</nav>", {}) == "" == sitetree.extracted("", {})
    assert sitetree.extracted("<p title='a>b'>x<p a=\"1>y", {}) == "x\ny"


def test_odd_rows(spark):
    deep, long = "<div>" * 5000 + "deep", "<article><p>" + "word " * 200_000 + "</article>"
    copies = [(7, "http://same.example/", "<article><h1>A</h1><p>text</article><footer>f</footer>")] * 9
    rows = [(1, None, "<p>a\n b</p>"), (2, "no address", "<nav>m</nav><p>c"), (3, "http://e.example", None), (None, "http://e.example", ""), (5, "http://d.example/", deep), (6, "http://d.example/", long), *copies]
    got = [(r.page_id, r.text, r.n_chars) for r in sitetree.main_texts(frame(spark, rows)).collect()]
    text = ("word " * 200_000).strip()
    want = [(1, "a b", 3), (2, "c", 1), (3, "", 0), (None, "", 0), (5, "deep", 4), (6, text, len(text)), *[(7, "A\ntext", 6)] * 9]
    assert sorted(got, key=str) == sorted(want, key=str)
    assert sitetree.main_texts(frame(spark, rows[:1]).limit(0)).count() == 0


def test_driver_pages(spark):
    """The tables' pages have their article between its tags: with meanings all texts are right; the tree alone finds them on large hosts."""
    import html
    import re

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in sitetree.main_texts(pages).collect()}
    for r in pages.collect():
        parts = re.split(r"</?(?:p|h1)>", re.search(r"<article>(.*?)</article>", r.html, re.S)[1])
        lines = [" ".join(html.unescape(re.sub("<[^>]*>", "", x)).split()) for x in parts]
        assert got[r.page_id] == "\n".join(x for x in lines if x)
