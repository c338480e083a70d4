"""Main text of web pages by a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements with their classes, such as
``body/div.post/p``. On each page a node has one presentation (the sequence of its children) and one content (its texts). Over the m pages
that have the node, presentation and content have an entropy; divided by log m it is 0 where all pages agree, as templates do, and 1 where
all differ. What a page shows in a node is as important as the mean of the node's content entropy and of the largest presentation entropy on
its branch; the less important branches are removed. ``PRIOR`` pages that all differ are added to m, so that two or three pages prove little.

What HTML itself says comes on top: elements that are not the article by their meaning (``nav``, ``footer``, ``form`` ...) or by a
word in their class or id (``ad``, ``sidebar``, ``comments`` ...) have no importance, and an article's own unnamed elements are not removed.

The tree is never in one place: tasks count (node, presentation or content) per page, a shuffle adds the counts, and each host's nodes that
more than one page has, with their two entropies, are joined to its pages as an array.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Importance below which a branch goes; pages of prior belief that it differs on every page.
LEAST, PRIOR = 0.6, 2
#: Counts that a task holds before it passes them on.
HELD = 1 << 18

# What HTML's elements mean.
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp", "template"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer",
    "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary", "table", "tbody", "thead", "tfoot",
    "tr", "td", "th", "caption", "ul", "select", "option", "button", "noscript", "svg", "object", "video", "audio", "canvas",
}
CHROME = {"head", "nav", "footer", "aside", "form", "menu", "dialog", "search", "select", "button", "noscript", "svg", "object", "video", "audio", "canvas", "fieldset", "input"}
ARIA = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form"}
#: A start tag of the first closes an open element of the second, up to an element of the third.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table", "thead", "tbody", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
# Words of classes and ids that name what is not the article.
SAYS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies", "consent", "notice", "notices", "popup", "modal",
    "newsletter", "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "sidebar", "widget", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs",
    "pagination", "pager", "footer", "masthead", "toolbar", "copyright", "header", "alert", "gdpr", "overlay", "teaser", "teasers", "trending", "recommendations",
}
REMARKS = {"comment", "comments", "disqus", "replies", "respond"}

MARKUP = re.compile(r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>|<[!?/][^>]*>""", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))|\b(hidden)\b""")
HOST = r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


class Node:
    """A block element, or an inline one that matters because it is removed. ``key`` is its node of the site's tree."""

    __slots__ = ("tag", "key", "parent", "block", "inside", "plain", "gone", "named", "style")

    def __init__(self, tag: str, label: str, parent: Node | None, block: bool):
        parent = parent and parent.own()
        self.tag, self.parent, self.block, self.style = tag, parent, block, []
        self.key = xxhash.xxh64_intdigest(f"{parent.key if parent else 0}/{label}") - (1 << 63) if block else parent.key
        own = tag in ("article", "main")
        self.inside = own or bool(parent and parent.inside)
        self.plain = own or bool(parent and parent.plain and label == tag)  # nothing between it and its article has a name
        self.gone = self.named = False

    def own(self) -> Node:
        """This element, or the one that an inline element's text belongs to."""
        return self if self.block or self.gone else self.parent


def described(tag: str, text: str) -> tuple[str, set[str], bool]:
    """The label of an element (its tag and classes, numbers left out), the words of its class and id, and if it is out of sight or has a role that is not the article's."""
    if not text.strip(" /\t\r\n"):
        return tag, set(), False
    at: dict[str, str] = {}
    for m in ATTRIBUTE.finditer(text):
        at.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
    names = re.sub(r"\d+", "", at.get("class", "").lower()).split()
    words = set(re.findall(r"[a-z]+", f"{at.get('class', '')} {at.get('id', '')}".lower()))
    hidden = "hidden" in at or at.get("aria-hidden", "").lower() == "true" or at.get("role", "").lower() in ARIA or "display:none" in at.get("style", "").replace(" ", "").lower()
    return ".".join([tag, *sorted(set(names))]), words, hidden


Runs = list[tuple[Node, str, int]]


def parsed(page: str, roles: bool = True) -> tuple[list[Node], Runs]:
    """The block elements in page order, and the texts of the page, each with its element and the number of its line, which a removed inline
    element may divide; white space is one blank, empty texts are left out."""
    root = Node("", "", None, True)
    nodes, runs, stack, words = [root], [], [root], []
    line = 0
    opened: Counter = Counter()

    def flush(block: bool = True) -> None:
        nonlocal line
        if words:
            if text := " ".join("".join(words).split()):
                runs.append((stack[-1].own(), text, line))
                stack[-1].own().style.append("#")
            words.clear()
        line += block

    def close(n: int) -> None:
        """Leaves the innermost elements, down to ``n`` that stay open."""
        while len(stack) > n:
            if stack[-1].block or stack[-1].gone:
                flush(stack[-1].block)
            opened[stack.pop().tag] -= 1

    def innermost(tags: set[str], stop: set[str]) -> int:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in tags:
                return i
            if stack[i].tag in stop:
                break
        return 0

    at, end = 0, page.rfind(">") + 1
    while at < len(page):
        m = MARKUP.search(page, at, end) if at < end else None
        upto = m.start() if m else len(page)
        if upto > at:
            words.append(entities.unescape(page[at:upto]))
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, block = m[2].lower(), m[2].lower() in BLOCK
        if m[1]:
            if opened[tag] > 0:
                i = innermost({tag}, BLOCK - {tag} if not block else set())
                if i:
                    close(i)
            continue
        if tag in RAW:
            closing = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = closing.end() if closing else len(page)
            continue
        if block:
            if tag in CLOSES and any(opened[t] > 0 for t in CLOSES[tag][0]) and (i := innermost(*CLOSES[tag])):
                close(i)
            if opened["p"] > 0 and tag not in ("html", "head", "body", "option", "button", "svg", "object", "video", "audio", "canvas", "noscript") and (i := innermost({"p"}, {"button", "td", "th", "caption", "object"})):
                close(i)
            if opened["head"] > 0 and tag not in ("noscript", "object") and (i := innermost({"head"}, {"html"})):
                close(i)
        if tag in VOID:
            words.append(" ")
            stack[-1].own().style.append(tag)
            if tag == "hr":
                flush()
            continue
        label, said, hidden = described(tag, m[3])
        named, gone = False, roles and (tag in CHROME or hidden)
        if roles and not gone and said and tag not in ("html", "body", "article", "main"):
            named = bool(said & SAYS - ({"header"} if said & {"article", "post", "entry", "page"} or stack[-1].inside else set())) or bool(said & REMARKS)
        if roles and tag == "article" and said & REMARKS or roles and tag == "header" and not stack[-1].inside:
            gone = True
        stack[-1].own().style.append(label)
        node = Node(tag, label, stack[-1], block)
        if block or gone or named:
            flush(block)
            node.gone, node.named = gone or named, named and not said & REMARKS
            if tag in ("article", "main") and not gone:
                above = node.parent
                while above is not None and above.named:
                    above.gone = above.named = False  # what holds the article isn't a part beside it, whatever its name
                    above = above.parent
            nodes.append(node)
        stack.append(node)
        opened[tag] += 1
    close(1)
    flush()
    return nodes, runs


def removed(nodes: list[Node], runs: Runs) -> set[int]:
    """Ids of the elements that have no importance by their meaning. Where a page doesn't say which part is its article, a class or an id is not
    believed if it would take most of the page."""
    if not any(n.inside for n, _, _ in runs):
        size = Counter()
        for n, text, _ in runs:
            size[id(n)] += len(text)
        for n in reversed(nodes):
            if n.named or not n.gone:
                size[id(n.parent)] += size[id(n)]
        total = size[id(nodes[0].parent)] if nodes else 0
        for n in nodes:
            if n.named and size[id(n)] > 0.6 * total:
                n.gone = n.named = False
    out: set[int] = set()
    for n in nodes:
        if n.gone or id(n.parent) in out:
            out.add(id(n))
    return out


def outlined(page: str, roles: bool = True) -> dict[int, tuple[int, int]]:
    """Of each node of the tree that the page has: hashes of what it looks like and of what it says. Parts without importance are left out."""
    nodes, runs = parsed(page, roles)
    out = removed(nodes, runs)
    looks: dict[int, list[str]] = {}
    says: dict[int, list[str]] = {}
    for n in nodes:
        if id(n) not in out and n.block:
            looks.setdefault(n.key, []).append(" ".join(n.style))
    for n, text, _ in runs:
        if id(n) not in out:
            says.setdefault(n.key, []).append(text)
    digest = lambda x: xxhash.xxh64_intdigest("\n".join(x).encode("utf-8", "surrogatepass")) - (1 << 63)
    return {k: (digest(v), digest(says.get(k, ()))) for k, v in looks.items()}


def extracted(page: str, tree: dict[int, tuple[float, float]], roles: bool = True) -> str:
    """The texts of the page's important branches, one a line. ``tree``: importance of presentation and content by node, 1 if absent."""
    nodes, runs = parsed(page, roles)
    out = removed(nodes, runs)
    looks: dict[int, float] = {}
    for n in nodes:
        own = tree.get(n.key, (1.0, 1.0))[0] if n.tag not in ("", "html", "body") else 0.0
        looks[id(n)] = max(own, looks[id(n.parent)] if n.parent is not None else 0.0)
    kept = [r for r in runs if id(r[0]) not in out]
    if roles:  # a page that says which part is its article is believed, unless that is a small one
        within = [r for r in kept if r[0].inside]
        if 10 * sum(len(r[1]) for r in within) >= sum(len(r[1]) for r in kept):
            kept = within
    worth = [1.0 if roles and n.plain or n.key not in tree else (tree[n.key][1] + looks[id(n)]) / 2 for n, _, _ in kept]
    least = min(LEAST, max(worth, default=0.0) - 0.05)  # nothing important: the best there is
    best = [r for r, w in zip(kept, worth, strict=True) if w >= least]
    return "\n".join(" ".join(text for _, text, _ in own) for _, own in groupby(best, key=lambda r: r[2]))


COUNTS = "host string, node long, kind int, value long, n long"


def counted(pages: DataFrame, roles: bool = True) -> DataFrame:
    """COUNTS: on how many pages of the host a node has a presentation (kind 0) or content (kind 1), added up per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def passed() -> pa.RecordBatch:
            rows = [[*k, n] for k, n in held.items()]
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], [c.split()[0] for c in COUNTS.split(", ")])

        for b in batches:
            for host, page in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for node, values in outlined(page, roles).items():
                    for kind, value in enumerate(values):
                        held[host, node, kind, value] += 1
                if len(held) >= HELD:
                    yield passed()
        if held:
            yield passed()

    return pages.where("_site_host IS NOT NULL AND _site_page <> ''").select("_site_host", "_site_page").mapInArrow(run, COUNTS)


def trees(pages: DataFrame, roles: bool = True) -> DataFrame:
    """_site_host, _site_tree: the nodes that two or more of the host's pages have, with the importance of their presentation and content."""
    values = counted(pages, roles).groupBy("host", "node", "kind", "value").agg(F.sum("n").alias("n"))
    entropy = values.groupBy("host", "node", "kind").agg(F.sum("n").alias("m"), F.sum(F.col("n") * F.log("n")).alias("s")).where("m > 1")
    worth = F.expr(f"((1 - s / (m * ln(m))) * m + {PRIOR}) / (m + {PRIOR})")
    both = entropy.withColumn("worth", worth).groupBy("host", "node").agg(F.max(F.expr("if(kind = 0, worth, null)")).alias("looks"), F.max(F.expr("if(kind = 1, worth, null)")).alias("says"))
    return both.groupBy(F.col("host").alias("_site_host")).agg(F.collect_list(F.struct("node", "looks", "says")).alias("_site_tree"))


def main_texts(pages: DataFrame, roles: bool = True) -> DataFrame:
    """``pages`` (page_id, url, html) without html, and with text and n_chars; columns of these names are replaced, others stay.

    Null and empty html give an empty text. A page without a host in its url (null, or no address) is a site of its own, and so is the one page of
    a host: nothing is known of their templates, only what their elements mean. Each row is a page: repeated pages and ids count as often
    as they are there, and get the same text. If all of a page is of little importance, the most important of it stays. Very long pages are parsed whole, in time
    linear in their length; an empty table gives no rows. A host's tree is one array, joined to its pages; Spark splits a host that holds many of the rows.
    ``roles``: if false, elements' meanings are ignored and the tree alone decides.
    """
    own = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    read = pages.select(*own, F.nullif(F.regexp_extract(F.lower("url"), HOST, 1), F.lit("")).alias("_site_host"), F.coalesce("html", F.lit("")).alias("_site_page"))
    known, _ = common.materialise(trees(read, roles), "site-trees")  # Spark sees its size: pages stay where they are if it is small enough to send
    joined = read.join(known, "_site_host", "left").select(*own, "_site_page", "_site_tree")
    schema = joined.drop("_site_page", "_site_tree").withColumns({"text": F.lit(""), "n_chars": F.lit(0).cast("long")}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            tree = b.column("_site_tree")
            texts = []
            offsets, flat = tree.offsets.to_pylist(), tree.values
            node, looks, says = (flat.field(k).to_pylist() for k in ("node", "looks", "says"))
            for i, page in enumerate(b.column("_site_page").to_pylist()):
                s, e = offsets[i], offsets[i + 1]
                known = dict(zip(node[s:e], zip(looks[s:e], says[s:e], strict=True), strict=True))
                texts.append(extracted(page, known, roles))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in own), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], [*own, "text", "n_chars"])

    return joined.mapInArrow(run, schema)


def op12_html(spark, sf_dir: str) -> DataFrame:
    return main_texts(common.spread(common.table(spark, sf_dir, "pages").select("page_id", "url", "html")))
