"""Main text of web pages by site style trees."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .urls import host_of
from .names import shielded

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    # A quote that never ends is read as any other character.
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)

#: Element and attribute names of HTML with a fixed meaning.
BLOCKS = set("""address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre
section summary table tbody td tfoot th thead title tr ul""".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp noembed noframes".split())
NEVER = set("""head title script style noscript template iframe object svg math canvas audio video nav footer aside
form button select textarea input menu dialog noembed noframes xmp""".split())
ROLES = set("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
HINTS = set("""ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments
consent cookie cookies copyright disclaimer disqus footer gdpr header masthead menu modal nav navbar navigation
newsletter notice notices overlay paywall popup promo promotion promoted recommended related replies
respond reviews share sharing sidebar signup social sponsor sponsored subscribe subscription toolbar widget
widgets""".split())
#: Words that say nothing about what a named element holds, and whose header is part of the text.
FILLERS = set("""area bar block body bottom box btn button buttons col column container content group inner item items
left link links list outer panel posts right row section slot top wrap wrapper zone""".split())
TITLED = set("article chapter content entry post section story".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
#: What an opening tag closes, within which ancestor.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
          "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
          "option": ({"option"}, {"select"})}

#: Factors of a node's importance: its name is that of boilerplate, or has such a word beside others.
NAMED, MENTIONED = 0.1, 0.6

_WORDS = re.compile(r"[A-Za-z]{2,}")


def short(text: str) -> int:
    """A 64-bit hash of a text."""
    return int.from_bytes(blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True)


class _Node:
    """An element. `path` is a hash of its label and those above it: pages of any depth have short paths."""

    __slots__ = ("tag", "path", "parent", "drop", "main", "prior", "children")

    def __init__(self, tag: str, label: str, parent: _Node | None, drop: bool = False, main: str = "", prior: float = 1.0) -> None:
        self.tag, self.parent, self.drop, self.main, self.prior = tag, parent, drop, main, prior
        self.path = short(f"{parent.path}/{label}") if parent else 0
        self.children: list[str] = []

    def above(self) -> Iterator[int]:
        """The paths of the elements that hold this one, from the innermost out."""
        node = self.parent
        while node is not None and node.parent is not None:
            yield node.path
            node = node.parent


def name_prior(name: str, inside: bool) -> float:
    """The factor of one class or id. The last word that tells something is what the element is:
    `inline-ad` and `ad-box` are adverts, `ad-agencies` and `share-prices` only mention one.
    `inside` an article, and beside words for a text, a header is the header of the text."""
    words = [w.lower() for w in _WORDS.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name))]
    if inside or TITLED & set(words):
        words = [w for w in words if w != "header"]
    if not HINTS & set(words):
        return 1.0
    telling = [w for w in words if w not in FILLERS]
    return NAMED if telling[-1] in HINTS else MENTIONED


def _attributes(rest: str) -> dict[str, str]:
    return {n.lower(): v.strip("\"'") for n, v in _ATTRIBUTE.findall(rest)} if rest and not rest.isspace() else {}


def _open(tag: str, rest: str, parent: _Node) -> _Node:
    a = _attributes(rest)
    name = " ".join(x for x in (a.get("class", ""), a.get("id", "")) if x)
    label = tag + "".join("." + w for w in sorted(set(re.sub(r"\d+", "", name).split())))
    if tag in ("html", "body", "main"):
        prior = 1.0
    elif tag == "article":
        words = {w.lower() for w in _WORDS.findall(name)}
        prior = NAMED if words & {"comment", "comments", "reply", "ad", "promo", "related"} else 1.0
    else:
        prior = min((name_prior(x, bool(parent.main)) for x in name.split()), default=1.0)
    drop = (tag in NEVER or a.get("role", "").lower() in ROLES or "hidden" in a or a.get("aria-hidden") == "true"
            or prior == NAMED
            # The header of a page goes, that of an article has its title.
            or (tag == "header" and not parent.main))
    main = tag if tag in ("article", "main") and not drop else parent.main
    parent.children.append(label)
    return _Node(tag, label, parent, parent.drop or drop, main, prior)


def parse(page: str) -> tuple[list[tuple[_Node, str]], list[_Node]]:
    """Blocks of text in page order with their element, and all elements."""
    root = _Node("", "", None)
    stack, nodes, blocks, text = [root], [root], [], []
    at, n = 0, len(page)

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined:
                blocks.append((stack[-1], joined))

    def close(i: int) -> None:
        flush()
        del stack[i:]

    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            text.append(page[at:])
            break
        text.append(page[at:m.start()])
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag = tag.lower()
        if m["end"]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    close(i)
                    break
                if tag not in BLOCKS and stack[i].tag in BLOCKS:
                    break
            continue
        if tag == "br":
            text.append(" ")
            continue
        rest = m["rest"]
        if tag in BLOCKS:
            flush()
            if tag != "option" and stack[-1].tag == "p":
                close(len(stack) - 1)
            if tag in CLOSES:
                ends, within = CLOSES[tag]
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        close(i)
                        break
                    if stack[i].tag in within:
                        break
        if tag in VOID or (tag not in BLOCKS and tag not in NEVER and "=" not in rest and not rest.strip(" /").startswith("hidden")):
            continue  # plain inline elements neither end a block nor make a node
        node = _open(tag, rest, stack[-1])
        if tag not in BLOCKS and not node.drop:
            stack[-1].children.pop()
            continue
        if tag not in BLOCKS:
            flush()
        if rest.rstrip().endswith("/") and tag not in BLOCKS:
            continue
        stack.append(node)
        nodes.append(node)
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else n
            stack.pop()
    flush()
    return blocks, nodes


def page_nodes(page: str) -> list[tuple[int, list[int], bool, float, str, str]]:
    """(path, paths above, within an article or main, prior, presentation, content) of a page's merged tree:
    child elements and own text.

    Elements that never hold text of the page, with all below them, are no nodes.
    """
    blocks, nodes = parse(page)
    first: dict[int, _Node] = {}
    children: dict[int, list[str]] = {}
    for node in nodes:
        if node.tag and not node.drop:
            first.setdefault(node.path, node)
            children.setdefault(node.path, []).extend(node.children)
    own: dict[int, list[str]] = {}
    for node, text in blocks:
        if not node.drop:
            own.setdefault(node.path, []).append(text)
    return [(p, list(x.above()), bool(x.main), x.prior, " ".join(dict.fromkeys(children[p])), "\n".join(own.get(p, [])))
            for p, x in first.items()]


def _nodes(pages: DataFrame, html: str) -> DataFrame:
    """The nodes of every page, with hashes of presentation and content."""
    schema = pa.schema([("host", pa.string()), ("path", pa.int64()), ("above", pa.list_(pa.int64())), ("core", pa.bool_()),
                        ("prior", pa.float64()), ("style", pa.int64()), ("content", pa.int64())])

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                rows = []
                for host, page in zip(batch.column(0).slice(at, 256).to_pylist(), batch.column(1).slice(at, 256).to_pylist()):
                    rows += [(host, path, above, core, prior, short(style), short(content) if content else None)
                             for path, above, core, prior, style, content in page_nodes(page)]
                    if len(rows) >= 4096:
                        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                        rows = []
                if rows:
                    yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return pages.select("host", F.coalesce(F.col(html), F.lit("")).alias("_html")).mapInArrow(
        explode, "host string, path bigint, above array<bigint>, core boolean, prior double, style bigint, content bigint")


def style_trees(pages: DataFrame, html: str = "html", decay: float = 0.9, doubt: float = 0.9) -> DataFrame:
    """(host, path, core, pages, importance) of the merged trees of all pages of each host.
    `core` marks the nodes of articles and main elements.

    A node's own importance is the entropy of its texts over the host's pages and, if it has no
    text, of its presentations (the kinds of its child elements). A branch's importance is the
    mean over its nodes, weighted by the pages that have them and by `decay` for each level down,
    times the prior of its name. Entropies are those of the pages read and `doubt` further ones
    that have nothing in common: one page says nothing, two that agree lower a node to 0.31, four
    to 0.18. With a name that mentions boilerplate, two pages are below the usual 0.2.
    Counts per distinct value are summed before they are shuffled; a host of a third of all pages
    is spread by path and value.
    """
    rows = _nodes(pages, html)
    kinds = F.explode(F.array(
        F.struct(F.lit("style").alias("kind"), F.col("style").alias("value")),
        F.struct(F.lit("content").alias("kind"), F.col("content").alias("value"))))
    node = ["host", "path", "above", "core", "prior"]
    values = rows.select("host", "path", "above", "core", "prior", kinds.alias("k")).filter("k.value IS NOT NULL").groupBy(
        *node, "k.kind", "k.value").agg(F.count(F.lit(1)).alias("n"))
    # Read twice below: the pages are parsed once for it.
    values = written_table(values, "llm-html-values")
    per_kind = values.groupBy(*node, "kind").agg(
        F.sum("n").alias("total"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    entropy = F.when(F.col("total") > 1, (F.log("total") - F.col("nlogn") / F.col("total")) / F.log("total")).otherwise(1.0)
    # To the base of the number of pages: 0 if all agree, 1 if no two do.
    per_kind = per_kind.withColumn("entropy", (F.col("total") * entropy + doubt) / (F.col("total") + doubt))
    pick = lambda kind, c: F.max(F.when(F.col("kind") == kind, F.col(c)))
    nodes = per_kind.groupBy(*node).agg(
        pick("style", "total").alias("pages"), pick("style", "entropy").alias("style"),
        pick("content", "entropy").alias("content"), pick("content", "total").alias("with_text"))
    weight = F.coalesce("with_text", F.lit(0))
    nodes = nodes.withColumn("own", F.coalesce("content", "style"))
    branch = F.posexplode(F.concat(F.array("path"), F.col("above"))).alias("down", "branch")
    # Elements without text of their own say little beside those that have some.
    spread = nodes.select("host", branch, "own", ((weight + F.lit(0.01) * F.col("pages")) * F.pow(F.lit(decay), "down")).alias("w"))
    merged = spread.groupBy("host", F.col("branch").alias("path")).agg((F.sum(F.col("own") * F.col("w")) / F.sum("w")).alias("importance"))
    merged = merged.withColumnsRenamed({"host": "_host", "path": "_path"})
    same = F.col("host").eqNullSafe(F.col("_host")) & (F.col("path") == F.col("_path"))
    return nodes.join(merged, same).select("host", "path", "core", "pages", (F.col("importance") * F.col("prior")).alias("importance"))


def _main_text(page: str, low: set[int], varied: bool) -> str:
    """The text of the blocks that are kept. `low`: paths of low-importance branches."""
    blocks, _ = parse(page)
    kept = [(node, text) for node, text in blocks if not node.drop and node.tag not in RAW]
    for kind in ("article", "main"):
        if any(node.main == kind for node, _ in kept):
            kept = [(node, text) for node, text in kept if node.main == kind]
            break

    def is_low(node: _Node) -> bool:
        # A heading goes with the branch it stands in.
        alone = node.main and node.tag in HEADINGS
        return (not alone and node.path in low) or any(path in low for path in node.above())

    inside = any(node.main for node, _ in kept)
    if low and (varied or not inside):
        better = [(node, text) for node, text in kept if not is_low(node)]
        kept = better or kept
    return " ".join(text for _, text in kept)


@shielded
def extract_text(pages: DataFrame, url: str = "url", html: str = "html", least: float = 0.2) -> DataFrame:
    """Every row of `pages` with `text`, the page's main text.

    A branch goes if its importance is below `least`. Elements and roles of HTML that are
    navigation, footer, sidebar, form, script or style have none. The importance of all others is
    that of the site style tree of the host, times a factor for their classes and ids: 0.1 if one
    is the name of a header, notice, advert, comment or the like, which vary from page to page so
    that entropy cannot tell them from text, and 0.6 if it has such a word beside others. If an
    article (else a main element) is left, only that is read. A host whose articles have no
    branch that varies, as where all its pages are copies, keeps them. Headings of an article go only
    with the branch that they stand in.

    Character references are decoded, white space inside a block becomes one space, and blocks are
    joined by one space in page order. A null page is empty and has an empty text; pages without
    a host form one site. Texts of any length are read whole. An input column `text` is replaced.
    An empty table gives an empty one; repeated rows give repeated rows.
    """
    rows = pages.withColumn("_host", host_of(F.col(url)))
    trees = style_trees(rows.select(F.col("_host").alias("host"), html), html)
    trees = written_table(trees, "llm-html-trees")
    low = trees.filter(F.col("importance") < least)
    # A node of an article or main element that varies shows that a low branch in it is not part of the text.
    varied = trees.filter("core").groupBy(F.col("host").alias("_site")).agg(
        F.max("importance").alias("_best"))
    site = low.groupBy(F.col("host").alias("_site")).agg(F.collect_list("path").alias("_low")).join(varied, "_site", "left")
    site = site.select("_site", "_low", (F.coalesce("_best", F.lit(0.0)) >= 0.5).alias("_varied"))
    # As a table of its own it joins by size, and a host of many pages can be split in the join.
    site = written_table(site, "llm-html-sites")
    kept = [c for c in pages.columns if c != "text"]
    joined = rows.select(*[F.col(f"`{c}`") for c in kept], "_host").join(site, F.col("_host") == F.col("_site"), "left")

    @F.pandas_udf("string")
    def read(html: pd.Series, low: pd.Series, varied: pd.Series) -> pd.Series:
        return pd.Series([_main_text(h or "", set(x) if x is not None else set(), bool(v)) for h, x, v in zip(html, low, varied)], dtype=object)

    return joined.select(*[F.col(f"`{c}`") for c in kept], read(F.col(html), "_low", F.coalesce("_varied", F.lit(False))).alias("text"))
