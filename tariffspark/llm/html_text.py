"""Operator 12, main text of HTML pages by composite text density.

1. A page's tags become a tree (an open paragraph, list item or table part ends where HTML says so; what is left open ends
   with its parent). Parts that are never article text are taken out first: scripts, styles, forms, navigation, page
   headers and footers, asides, dialogs, hidden parts, and elements whose role, id or class names one of BOILERPLATE.
2. Each node has characters C, tags T, and characters LC and tags LT inside links. Its composite text density is
   C / T * log(C * T / (LC * LT)) to the base ln(C * LC / (C - LC) + LC_body * C / C_body + e), or e where that is less:
   characters a tag, adjusted downwards by links; a count of 0 below a line is 1. A node's density sum is the sum of its children's densities.
3. The node of largest density sum is the heart of the article; the least density on its path from the body is the
   threshold. From the heart up, as long as the page has no <article> or <main> around it that ends the climb, a parent is
   taken when beside the path it holds headings, text blocks, or parts with text blocks whose density reaches the threshold.
   Parts below the threshold beside the path, and lists and boxes that are mostly links, stay out.
4. The text blocks of that subtree, in page order: white space is one space, character references are decoded, one line
   each. <br> is white space inside its block.

A page is handled in its task alone; pages are never shuffled, and work grows in proportion to a page's length.

Defined results: null and empty pages, and pages without text, give the empty text; text outside any element counts as the
body's; each input row gives one output row; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._core import table

# Element names of the HTML standard, and common names of page parts.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template head title nav header footer aside form button select option textarea input label fieldset iframe object embed svg math canvas audio video dialog menu map".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr br".split())
TEXT_BLOCKS = frozenset("p blockquote pre ul ol dl li dd dt table figure figcaption address details center tr td th tbody thead".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: A start tag ends these open elements, up to the given limits.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"})}
#: Words of role, id and class (parts between marks, digits and changes of case) that name what is not the article.
BOILERPLATE = frozenset("ad ads adv advert adverts advertisement advertising banner sponsor sponsored sponsors promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar sidebars complementary contentinfo footer masthead topbar toolbar cookie cookies consent gdpr notice notices alert alertdialog popup modal overlay newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus respond replies related recommended recommendations pagination pager widget skip copyright".split())
KEPT = frozenset("html body article main".split())
CLIMB_ENDS = frozenset("article main body".split())
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class _Tree(HTMLParser):
    """Nodes in page order: tag, parent, whether taken out; and the pieces of text with the node they stand in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.tag, self.parent, self.out, self.link = ["body"], [-1], [False], [False]
        self.texts: list[tuple[int, int, str]] = []  # node, number of block edges before, text
        self.open, self.edges = [0], 0

    def _names_boilerplate(self, attrs) -> bool:
        for k, v in attrs:
            if k == "hidden" or (k == "aria-hidden" and v == "true"):
                return True
            if k in ("class", "id", "role") and v and not BOILERPLATE.isdisjoint(w.lower() for w in _NAMES.findall(v)):
                return True
            if k == "style" and v and "display:none" in v.replace(" ", "").lower():
                return True
        return False

    def updatepos(self, i: int, j: int) -> int:
        return j  # line numbers are not asked for

    def _close_to(self, depth: int) -> None:
        self.edges += any(self._edge(self.tag[i]) for i in self.open[depth:])
        del self.open[depth:]

    @staticmethod
    def _edge(tag: str) -> bool:
        return tag not in INLINE and tag not in ("script", "style", "noscript", "template")

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag in ("html", "body"):
            return
        if tag not in INLINE:  # a block ends an open paragraph, unless a box inside it has opened since
            for d in range(len(self.open) - 1, 0, -1):
                name = self.tag[self.open[d]]
                if name == "p" or (name in HEADINGS and tag in HEADINGS):
                    self._close_to(d)
                    break
                if name not in INLINE:
                    break
            if self.tag[self.open[-1]] == "head" and tag not in ("title", "meta", "link", "script", "style", "base", "noscript", "template"):
                self._close_to(len(self.open) - 1)
        ends, limits = ENDS.get(tag, ((), ()))
        for d in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[d]]
            if name in limits or not ends:
                break
            if name in ends:
                self._close_to(d)
        if tag == "br":
            self.texts.append((self.open[-1], self.edges, " "))
            return
        top, n = self.open[-1], len(self.tag)
        self.edges += self._edge(tag)
        self.tag.append(tag)
        self.parent.append(top)
        self.out.append(self.out[top] or tag in SILENT or (tag not in KEPT and self._names_boilerplate(attrs)))
        self.link.append(self.link[top] or tag == "a")
        if tag not in VOID:
            self.open.append(n)

    def handle_startendtag(self, tag: str, attrs) -> None:
        self.handle_starttag(tag, attrs)  # HTML has no empty elements but the void ones

    def handle_endtag(self, tag: str) -> None:
        for d in range(len(self.open) - 1, 0, -1):
            name = self.tag[self.open[d]]
            if name == tag:
                self._close_to(d)
                return
            if tag in INLINE and name not in INLINE:
                return  # a stray end of an inline element does not end a block

    def handle_data(self, data: str) -> None:
        self.texts.append((self.open[-1], self.edges, data))


def densities(tag: list[str], parent: list[int], chars: list[int], linked: list[int], link: list[bool]) -> tuple[list[float], list[float], list[int], list[int]]:
    """Composite text density and density sum of each node, and characters and linked characters of its subtree; parents
    stand before children."""
    n = len(tag)
    c, lc, t, lt = chars[:], linked[:], [0] * n, [0] * n
    for i in range(n - 1, 0, -1):
        p = parent[i]
        c[p] += c[i]
        lc[p] += lc[i]
        t[p] += t[i] + 1
        lt[p] += lt[i] + link[i]
    ratio = lc[0] / c[0] if c[0] else 0.0
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if c[i]:
            base = math.log(c[i] * lc[i] / max(1, c[i] - lc[i]) + ratio * c[i] + math.e)
            share = c[i] / max(1, lc[i]) * max(1, t[i]) / max(1, lt[i])
            density[i] = c[i] / max(1, t[i]) * math.log(max(share, 1.0)) / math.log(max(base, math.e))
        if i:
            total[parent[i]] += density[i]
    return density, total, c, lc


def main_text(html: str | None) -> str:
    """The article of a page, a block a line."""
    if not html:
        return ""
    tree = _Tree()
    tree.feed(html)
    tree.close()
    # The tree without what was taken out.
    number = [-1] * len(tree.tag)
    tag, parent, link = [], [], []
    for i, name in enumerate(tree.tag):
        if not tree.out[i]:
            number[i] = len(tag)
            tag.append(name)
            parent.append(number[tree.parent[i]] if i else -1)
            link.append(tree.link[i])
    texts = [(number[i], e, x) for i, e, x in tree.texts if number[i] >= 0]
    chars, linked = [0] * len(tag), [0] * len(tag)
    for i, _, x in texts:
        size = len("".join(x.split()))
        chars[i] += size
        linked[i] += size if link[i] else 0
    density, total, c, lc = densities(tag, parent, chars, linked, link)
    if not c[0]:
        return ""
    children: list[list[int]] = [[] for _ in tag]
    for i in range(1, len(tag)):
        children[parent[i]].append(i)
    heart = max(range(len(tag)), key=lambda i: (total[i], density[i], -i))
    path = [heart]
    while path[-1]:
        path.append(parent[path[-1]])
    threshold = min(density[i] for i in path)
    has_block = [name in TEXT_BLOCKS or name in HEADINGS for name in tag]
    for i in range(len(tag) - 1, 0, -1):
        has_block[parent[i]] |= has_block[i]
    root, left_out, pending = heart, set(), set()
    for at in path:
        above = parent[at]
        if above < 0 or (tag[at] in CLIMB_ENDS and tag[at] != "body"):
            break
        beside = [x for x in children[above] if x != at]
        weak = {x for x in beside if tag[x] not in INLINE and tag[x] not in HEADINGS and tag[x] not in TEXT_BLOCKS and not (has_block[x] and density[x] >= threshold)}
        pending |= weak
        inside = tag[at] in INLINE or tag[at] in TEXT_BLOCKS or tag[at] in HEADINGS
        if inside or chars[above] or any(x not in weak and c[x] for x in beside):
            root, left_out = above, set(pending)
    wanted = [False] * len(tag)
    for i in range(len(tag)):
        inside = i == root or (i > 0 and wanted[parent[i]])
        links = tag[i] in ("ul", "ol", "dl", "div", "section", "table") and c[i] and lc[i] > 0.6 * c[i] and i != root
        wanted[i] = inside and i not in left_out and not links
    # Blocks: a piece of text joins the one before unless a block starts or ends in between.
    lines: list[list[str]] = []
    last = -1
    for i, edges, x in texts:
        if wanted[i]:
            if edges != last:
                lines.append([])
                last = edges
            lines[-1].append(x)
    found = (" ".join("".join(x).split()) for x in lines)
    return "\n".join(x for x in found if x)


def extract(pages: DataFrame, id_col: str = "page_id", html_col: str = "html", keep: tuple[str, ...] = ("url",)) -> DataFrame:
    """id, the kept columns, text."""
    slim = pages.select(F.col(f"`{id_col}`").alias("id"), *[F.col(f"`{c}`").alias(f"k{n}") for n, c in enumerate(keep)], F.col(f"`{html_col}`").cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            text = pa.array([main_text(x) for x in b.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], text], [*b.schema.names[:-1], "text"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    out = slim.mapInArrow(run, f"{kinds}, text string")
    return out.select("id", *[F.col(f"k{n}").alias(c) for n, c in enumerate(keep)], "text")


def op12_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select(F.col("id").alias("page_id"), "url", "text", F.length("text").cast("long").alias("n_chars"))


#: The given pages hold one <article> of <h1> and <p>, each on its own; for such pages SQL can say what its text is.
OP12_SQL = r"""
WITH a AS (SELECT page_id, url, regexp_split_to_array(regexp_replace(regexp_extract(coalesce(html, ''), '(?s)<article>(.*?)(</article>|$)', 1), '\s+', ' ', 'g'), '</?(?:p|h1)>') AS parts FROM pages),
b AS (SELECT page_id, url, list_transform(parts, lambda x: regexp_replace(regexp_replace(replace(replace(regexp_replace(x, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;?', '"', 'g'), '&amp;?', '&', 'g')) AS parts FROM a),
c AS (SELECT page_id, url, array_to_string(list_filter(list_transform(parts, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS text FROM b)
SELECT page_id, url, text, CAST(length(text) AS BIGINT) AS n_chars FROM c
"""
