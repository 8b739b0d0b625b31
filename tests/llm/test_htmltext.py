"""Main text of pages: the given pages with and without their marks, and pages written by hand."""

import html
import re
import time

import pytest
from check_oracle import duck
from pyspark.sql import functions as F

from wardline.llm import catalog, htmltext


@pytest.fixture(scope="module")
def weights(spark, sf):
    return htmltext.fit(spark.read.parquet(f"{sf}/pages.parquet"))


def article(page):
    inner = re.search(r"<article>(.*)</article>", page, re.S).group(1)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", " ", re.sub(r"</?b>", "", inner))).split())


def test_query(spark, sf):
    want = {(i, u, article(h), len(article(h))) for i, u, h in duck(sf).sql("SELECT page_id, url, html FROM pages").fetchall()}
    got = catalog.QUERIES["op13_html_extraction"](spark, sf).collect()
    assert {(r["page_id"], r["url"], r["text"], r["n_chars"]) for r in got} == want and len(got) == len(want)


def test_region_of_unmarked_pages(sf, weights):
    """The same pages without their marks: the best region is still the article."""
    pages = [h for (h,) in duck(sf).sql("SELECT html FROM pages").fetchall()]
    assert all(htmltext.Page(re.sub("</?article>", "", h)).main_text(weights) == article(h) for h in pages)


def test_signs(weights):
    assert weights["word", "p", False] > 0 and all(v > 0 if what == "word" else v < 0 for (what, _, _), v in weights.items())


BODY = "One two <em>th</em>ree four five six seven, eight nine ten. "
PAGES = [
    ("<p>foo<b>bar</b> x &amp; y&nbsp;z<br>q", "foobar x & y z q"),
    (
        f"<body><nav>menu</nav><div class='sidebar'>side</div><main><header><h1>T</h1><p>by X</p></header><p>{BODY}</p><aside>no</aside>"
        "<div class=comments><p>c c c c c c c c c c c c c c</p></div><form>f <input value='x'><p>g</form><p>end</p></main><footer>f</footer>",
        "T One two three four five six seven, eight nine ten. end",
    ),
    (
        "<article><p>a b c</p><div class='cookie-notice'>no</div><ul><li>one<li>two</ul><script>if(a<b){'</p>'}</script><style>p{}</style>tail</article>",
        "a b c one two tail",
    ),
    (
        f"<article><h1>A</h1><p>{BODY}</p><section class='commentList'><article class='comment'>{BODY * 3}</article></section></article>",
        "A One two three four five six seven, eight nine ten.",
    ),
    ("<article>x<div><article-note>y</div></article>", "x y"),
    ("<div><article><b>x y</div> z</b> w</article> out", "x y z w"),
    ("<article><p>1 &lt; 2 &#233;&#x1F600; &copy &unknown; &am</article>", "1 < 2 é😀 © &unknown; &am"),
    (f"<body class='has-sidebar'><div id='page-header-fixed'><article><p>{BODY}</article></div>", "One two three four five six seven, eight nine ten."),
    ("<!-- a <article>no</article> --><article>yes<!-- no --> <![CDATA[x]]>more</article><!-- open", "yes more"),
    ("<ARTICLE><TABLE><TR><TD>a<TD>b<TR><TD>c</TABLE></ARTICLE>", "a b c"),
    ("<article><pre>a\n\t b</pre>c</article>", "a b c"),
    ("<div itemprop='articleBody'>in</div><div>out out out</div>", "in"),
    ("<article>a<textarea><p>x</textarea><title>t</title><button>b</button><select><option>o</select>z</article>", "a z"),
    ("plain text only", "plain text only"), ("", ""), (None, ""), ("<", "<"), ("<a b=\"", ""), ("<nav>menu</nav>", ""), ("   \n ", ""),
]


def test_pages_by_hand(spark):
    rows = [(None if i == 1 else i, f"u{i}", h) for i, (h, _) in enumerate(PAGES)]
    pages = spark.createDataFrame(rows + rows[:2], "page_id bigint, url string, html string")
    pages = pages.withColumns({c: F.lit("x") for c in ("text", "n_chars", "what", "name", "linked", "inside")})
    want = [(None if i == 1 else i, f"u{i}", t, len(t)) for i, (_, t) in enumerate(PAGES)]
    got = htmltext.extract(pages, {}).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want + want[:2]))
    empty = pages.limit(0)
    assert htmltext.fit(empty) == {} and htmltext.extract(empty, {}).count() == 0


@pytest.mark.parametrize("part, times", [
    ('<a b="c" ', 100_000), ("<a<a", 100_000), ("<b><div>", 50_000), ("<div></b>", 50_000), ("<!--", 100_000), ("<script>", 100_000),
    ("<p class='", 100_001), ("word ", 500_000), ("<article>", 20_000), ("&amp", 100_000), ("<div class=ad>x", 30_000),
])
def test_time_grows_with_the_page(part, times):
    start = time.time()
    htmltext.Page(part * times).main_text({})
    assert time.time() - start < 20


def test_long_pages_are_whole():
    words = " ".join(f"w{i}" for i in range(300_000))
    assert htmltext.Page(f"<nav>x</nav><article><p>{words}</p></article>").main_text({}) == words
