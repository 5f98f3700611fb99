"""Main text of pages with known parts, and of sites with repeated branches."""

import math
from collections import Counter

import pytest
from resrisk.llm import html

PAGES = {
    "": "",
    "<p>a&amp;b &lt;c&gt; &eacute;&#233;&#x41;</p>": "a&b <c> ééA",
    "<nav>menu</nav><article><h1>T</h1><p><b>x<br>y</b>  z\n\n w<p>next</article><footer>f</footer>": "T x y z w next",
    "<header>site</header><main><article><header><h1>Title</h1></header><p>one</p><form>f</form></article></main>": "Title one",
    "<script>var a='<p>no</p>';</script><style>p{}</style><p>yes<!-- <p>no</p> --> too</p>": "yes too",
    "<article><p>keep</p><div class='comments'><p>nice!</p></div><section id=\"reader-comments\">c</section></article>": "keep",
    "<div class=\"cookie-notice\">c</div><div class=\"sidebar left\">s</div><div class='ad'>a</div><div>t</div>": "t",
    "<article><ul><li>a<li>b</ul><table><tr><td>1<td>2</table>tail": "a b 1 2 tail",
    "<article><p>a <span>b</span><em>c</em> d</p><aside>no</aside>e</article><p>outside": "a bc d e",
    "<article><p>cut off <a href=\"x": "cut off",
    "<p>1 < 2 and 3 > 2</p>": "1 < 2 and 3 > 2",
    "<title>t</title><p>x</p><template><p>no</p></template><noscript>no</noscript>": "x",
    "<article><h2>h</h2><div>a<div>b</div>c</div><button>press</button></article>": "h a b c",
    "<article><header class='entry-header'><h1>My Title</h1></header><p>x</p></article>": "My Title x",
    "<article><div class='post-header'><h1>T</h1></div><h2 id='related-work'>Related work</h2><p>x</p></article>": "T Related work x",
    "<div class='reader-content'>all</div>": "all",
    "<p class='social-science'>s</p><section id='share-prices'>p</section>": "s p",
    "<article><p>x</p><div class='inline-ad'>a</div><div id='adBox300'>b</div><div class='share-buttons'>c</div></article>": "x",
    "<article><p>x</p><article class='comment'><p>no</p></article></article>": "x",
}


@pytest.mark.parametrize("page", PAGES)
def test_known_pages(page):
    assert html._main_text(page, set(), False) == PAGES[page]


def test_site_style_tree(spark):
    def page(i):
        return (f"<body><div class='x'>Same words on all pages</div><div class='y'><p>Story number {i} told</p>"
                f"<p>and {i * 7} more</p></div></body>")
    rows = [(i, f"http://a.example/{i}", page(i), "t") for i in range(20)]
    rows += [(100 + i, f"http://b.example/{i}", "<article><p>The same article</p></article>", "t") for i in range(20)]
    rows += [(200, "http://c.example/", page(3), "t"), (201, None, None, None), (202, "x", "", "t")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert got[4] == "Story number 4 told and 28 more"
    assert got[105] == "The same article"
    assert got[200] == "Same words on all pages Story number 3 told and 21 more"
    assert got[201] == got[202] == ""
    assert html.extract_text(pages.limit(0)).count() == 0
    trees = {(r["host"], r["path"]): r["importance"] for r in html.style_trees(
        pages.selectExpr("'h' AS host", "html").limit(20)).collect()}
    assert trees["h", path("/body/div.x")] < 0.05 < 0.9 < trees["h", path("/body/div.y/p")]


def path(text):
    """The hash of a path written as /body/div.x."""
    found = 0
    for label in text.split("/")[1:]:
        found = html.short(f"{found}/{label}")
    return found


def importances(pages, doubt=0.9, decay=0.9):
    """The site style tree of one host's pages by the definition, node for node."""
    style, content, prior, above = {}, {}, {}, {}
    for page in pages:
        for node, up, _, p, kinds, text in html.page_nodes(page):
            style.setdefault(node, Counter())[kinds] += 1
            prior[node], above[node] = p, up
            if text:
                content.setdefault(node, Counter())[text] += 1

    def entropy(values):
        n = sum(values.values())
        h = 1.0 if n == 1 else -sum(v / n * math.log(v / n) for v in values.values()) / math.log(n)
        return (n * h + doubt) / (n + doubt)

    found = {}
    for node in style:
        top = bottom = 0.0
        for below in style:
            if below == node or node in above[below]:
                w = sum(content.get(below, Counter()).values()) + 0.01 * sum(style[below].values())
                w *= decay ** (len(above[below]) - len(above[node]))
                top += w * entropy(content.get(below) or style[below])
                bottom += w
        found[node] = top / bottom * prior[node]
    return found


def test_importance_by_definition(spark):
    pages = [f"<body><div class='byline'>By the staff</div><article><h1>Title {i}</h1><p>Words {i % 3}<p>more"
             f"<div class='press-notice-text'>Seen {'here' if i else 'there'}</div></article>"
             + ("<div><span class='q'>odd</span></div>" if i % 2 else "") + "</body>" for i in range(7)]
    rows = [("h", p) for p in pages] + [("two", p) for p in pages[:2]] + [("one", pages[3])] + [(None, pages[1]), ("empty", None)]
    got = html.style_trees(spark.createDataFrame(rows, "host string, html string")).collect()
    for host in ("h", "two", "one"):
        want = importances([p for h, p in rows if h == host])
        here = {r["path"]: r["importance"] for r in got if r["host"] == host}
        assert here.keys() == want.keys()
        assert all(math.isclose(here[p], want[p], rel_tol=1e-9) for p in want)


def test_tree_decides_from_two_pages_on(spark):
    def page(i):
        return (f"<article><h1>Overview</h1><p>Story number {i}</p><div class='notice-text-long'>Read our rules</div>"
                f"<div class='byline'>By the staff</div></article>")
    rows = [(i, f"http://two.example/{i}", page(i)) for i in range(2)]
    rows += [(10 + i, f"http://five.example/{i}", page(i)) for i in range(5)] + [(20, "http://one.example/", page(0))]
    # Repeated rows and a host of copies: nothing varies, nothing goes.
    rows += [(30, "http://same.example/", page(7))] * 6
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = Counter((r["page_id"], r["text"]) for r in html.extract_text(pages).collect())
    off = Counter((r["page_id"], r["text"]) for r in html.extract_text(pages, least=0.0).collect())
    assert got[1, "Overview Story number 1 By the staff"] == 1
    assert got[14, "Overview Story number 4"] == 1
    whole = "Overview Story number {} Read our rules By the staff"
    assert got[20, whole.format(0)] == 1 and got[30, whole.format(7)] == 6
    assert off == Counter((i, whole.format(u[-1] if u[-1] != "/" else 7 if i == 30 else 0)) for i, u, _ in rows)


def test_a_very_long_page(spark):
    words = " ".join(f"w{i}" for i in range(200_000))
    pages = spark.createDataFrame([(1, "http://l.example/", f"<nav>n</nav><article><p>{words}</p></article>"),
                                   (2, "http://l.example/2", "<div>" * 3000 + "deep")], "page_id bigint, url string, html string")
    got = {r["page_id"]: r["text"] for r in html.extract_text(pages).collect()}
    assert got == {1: words, 2: "deep"}
