import html
import math
import re

from tariffspark.llm import html_text as H

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{margin:0}</style><script>var t="</p>";</script></head><body>
<header><a href=/>Home</a> Site</header><div id="cookie-notice">We use cookies. <button>OK</button></div>
<div class="wrap"><div class="left"><ul><li><a href=1>One link</a></li><li><a href=2>Two links</a></li></ul></div>
<div class="content"><h1>Big title &amp; more</h1><p>First paragraph of the story, with <a href=x>a link</a> in it, which goes on so that it is dense.</p><p>Short.</p>
<div class="section"><h2>Sub</h2><p>Second part, a paragraph with text that goes on and on for many words in a row.</p><p>And<br>more   text
here, long enough to count as text.</p><ul><li>item one<li>item two</ul></div>
<div class="section"><p>Third part, one paragraph, also with many words that make it dense enough.</p></div>
<div class="ad-box">Buy now!</div><form><input name=q>Search</form></div>
<div id="comments"><p>A reader's very long comment, longer than each part of the article by itself, and so dense that it may win.</p></div></div>
<footer>&copy; 2020</footer></body></html>"""


def test_article_without_the_rest():
    assert H.main_text(PAGE).split("\n") == [
        "Big title & more",
        "First paragraph of the story, with a link in it, which goes on so that it is dense.",
        "Short.",
        "Sub",
        "Second part, a paragraph with text that goes on and on for many words in a row.",
        "And more text here, long enough to count as text.",
        "item one",
        "item two",
        "Third part, one paragraph, also with many words that make it dense enough.",
    ]


def test_short_article_beside_unmarked_text():
    page = '<body><nav><ul><li><a href="/a">a</a></ul></nav><div class="ad">Plain text of an advert, dense as an article.</div><article><h1>Title</h1><p><b>Only line.<br></article><footer>&copy; x</footer>'
    assert H.main_text(page) == "Title\nOnly line."


def test_soup():
    assert H.main_text(None) == H.main_text("") == H.main_text("<!-- x --><p> </p>") == ""
    assert H.main_text("just text") == "just text"
    assert H.main_text("<p>one<p>two <b>bold<p>th&eacute;e &lt;i&gt; &#8364;") == "one\ntwo bold\nthée <i> €"
    assert H.main_text("<p>a</b></i>b</div></p>c") == "ab\nc"
    assert H.main_text("<article>" + "<div>" * 5000 + "deep text" + "</div>" * 5000) == "deep text"
    long = " ".join(f"word{i}" for i in range(60_000))
    assert H.main_text(f"<body><p>{long}</p></body>") == long


def test_densities_by_the_formula():
    # body > (div > (p, p > a)): characters of the node itself, and those inside links
    tag, parent = ["body", "div", "p", "p", "a"], [-1, 0, 1, 1, 3]
    density, total, c, lc = H.densities(tag, parent, [0, 0, 100, 40, 20], [0, 0, 0, 0, 20], [False, False, False, False, True])
    assert c == [160, 160, 100, 60, 20] and lc == [20, 20, 0, 20, 20]

    def plain(chars, linked, tags, links):
        base = max(math.e, math.log(chars / max(1, chars - linked) * linked + 20 / 160 * chars + math.e))
        return chars / max(1, tags) * math.log(max(1, chars / max(1, linked) * max(1, tags) / max(1, links)), base)

    want = [plain(160, 20, 4, 1), plain(160, 20, 3, 1), plain(100, 0, 0, 0), plain(60, 20, 1, 1), plain(20, 20, 0, 0)]
    assert all(abs(x - y) < 1e-9 for x, y in zip(density, want, strict=True))
    assert abs(total[1] - density[2] - density[3]) < 1e-9 and abs(total[0] - density[1]) < 1e-9


def test_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (None, None, None, None), (2, "", "", "y")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = H.extract(df).collect()
    assert sorted([r["id"] or 0, len(r["text"])] for r in got) == [[0, 0], [1, len(H.main_text(PAGE))], [1, len(H.main_text(PAGE))], [2, 0]]
    assert H.extract(df.limit(0)).collect() == []


def test_pages_of_the_tables(spark):
    """The given pages hold one <article>: all its lines, and nothing else."""

    def plain(page):
        body = re.search(r"<article>(.*?)(</article>|$)", page, re.S)[1].replace("\n", " ")
        lines = re.sub(r"<[^>]*>", " ", re.sub(r"</?(p|h1)>", "\n", body)).split("\n")
        return "\n".join(x for x in (" ".join(html.unescape(y).split()) for y in lines) if x)

    got = H.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), keep=("html",)).collect()
    assert len(got) == 250 and all(r["text"] == plain(r["html"]) for r in got)
