"""URL filter: listed rules first, then trust and distrust propagated over host links."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .names import shielded

Rule = tuple[str, str]  #: (host and path prefix such as "org/", "allow" or "block")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; null where none fits.

    A rule fits its host and all subdomains, if the path starts with the rule's path. The list
    becomes one expression, so it is meant for up to some hundreds of rules.
    """
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def host_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links between different hosts in the pages' markup: source, target, links."""
    links = F.regexp_extract_all(
        F.coalesce(F.col(html), F.lit("")),
        F.lit(r"""(?i)<a\s[^>]*?href\s*=\s*["']?((?:https?:)?//[^\s"'>]+)"""), F.lit(1))
    found = pages.select(host_of(F.col(url)).alias("source"), F.explode(links).alias("_link"))
    target = host_of(F.concat(F.lit("http:"), F.regexp_replace("_link", "^(?i)https?:", "")))
    return found.select("source", target.alias("target")).filter(
        "source != target AND source != '' AND target != ''"
    ).groupBy("source", "target").agg(F.count(F.lit(1)).alias("links"))


def propagate(seeds: DataFrame, edges: DataFrame, damping: float = 0.85, tolerance: float = 1e-6,
              max_rounds: int = 50, write_every: int = 5) -> DataFrame:
    """Personalised PageRank of trust along the links and of distrust against them.

    `seeds` has a row per host: host, trusted and blocked (seed weights, 0 or more). Returns host,
    trust, distrust; either sums to at most one over all hosts, rank that reaches a host without
    further links ends there. Both ranks move in one pass, as rows of (kind, host). A host with
    many links has one row per linked host, and sums per target are taken before the shuffle.
    Rounds end when the ranks change by less than `tolerance` in all, or after `max_rounds`, when
    what is left is below `damping ** max_rounds`.
    """
    spark = seeds.sparkSession
    total = seeds.agg(F.sum("trusted").cast("double").alias("_t"), F.sum("blocked").cast("double").alias("_b")).first()
    sums = {"trust": total["_t"] or 0.0, "distrust": total["_b"] or 0.0}
    start = None
    for kind, column in (("trust", "trusted"), ("distrust", "blocked")):
        part = seeds.filter(F.col(column) > 0).select(
            F.lit(kind).alias("kind"), "host", (F.col(column) / F.lit(sums[kind] or 1.0)).alias("seed"))
        start = part if start is None else start.unionByName(part)
    start = written_table(start, "llm-url-seeds")
    moves = edges.select(F.lit("trust").alias("kind"), F.col("source").alias("host"), F.col("target").alias("to"), "links")
    moves = moves.unionByName(edges.select(
        F.lit("distrust").alias("kind"), F.col("target").alias("host"), F.col("source").alias("to"), "links"))
    out_links = moves.groupBy("kind", "host").agg(F.sum("links").alias("_out"))
    moves = written_table(moves.join(out_links, ["kind", "host"]).select(
        "kind", "host", "to", (F.col("links") / F.col("_out")).alias("share")), "llm-url-moves")
    rank = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
    if moves.isEmpty():
        rank = start.select("kind", "host", F.col("seed").alias("rank"))
        max_rounds = 0
    before = None
    for i in range(max_rounds):
        arrived = rank.join(moves, ["kind", "host"]).groupBy("kind", F.col("to").alias("host")).agg(
            (F.sum(F.col("rank") * F.col("share")) * damping).alias("rank"))
        given = start.select("kind", "host", (F.col("seed") * (1 - damping)).alias("rank"))
        rank = given.unionByName(arrived).groupBy("kind", "host").agg(F.sum("rank").alias("rank"))
        if (i + 1) % write_every == 0:
            rank = written_table(rank, "llm-url-ranks")
            if before is not None:
                moved = rank.alias("a").join(before.alias("b"), ["kind", "host"], "full").agg(F.sum(F.abs(
                    F.coalesce("a.rank", F.lit(0.0)) - F.coalesce("b.rank", F.lit(0.0)))).alias("d")).first()["d"]
                if (moved or 0.0) < tolerance:
                    break
            before = rank
    pick = lambda kind: F.sum(F.when(F.col("kind") == kind, F.col("rank")).otherwise(0.0))
    return rank.groupBy("host").agg(pick("trust").alias("trust"), pick("distrust").alias("distrust"))


@shielded
def judge_urls(pages: DataFrame, rules: Sequence[Rule], edges: DataFrame | None = None,
               url: str = "url", html: str = "html", ratio: float = 1.0,
               least: float = 1e-9, **options) -> DataFrame:
    """Every row of `pages` with host, path, rule, verdict, decided_by, trust and distrust.

    A page that a rule fits gets the rule's verdict. The pages under allow and block rules are the
    seeds of their hosts' trust and distrust; both are propagated over `edges` (from the markup,
    unless given as source, target, links). A host is blocked if its distrust is at least `least`
    and more than `ratio` times its trust; a host that neither rank reaches is allowed.

    A null URL, or one without `://`, has an empty host and path, no rule, and is allowed. Input
    columns called as the results are replaced. An empty table gives an empty one; repeated rows
    count once each. Pages of one host meet no other than its one row of ranks, in a join that
    Spark can split where a host holds many pages.
    """
    out = ["host", "path", "rule", "verdict", "decided_by", "trust", "distrust"]
    kept = [c for c in pages.columns if c not in out]
    address = F.col(url)
    rows = pages.select(*[F.col(f"`{c}`") for c in kept], host_of(address).alias("host"), path_of(address).alias("path"))
    rule, says = rule_of(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("_says", says)
    seeds = rows.filter("host != ''").groupBy("host").agg(
        F.count_if(F.col("_says") == "allow").alias("trusted"), F.count_if(F.col("_says") == "block").alias("blocked"))
    seeds = written_table(seeds, "llm-url-hosts")
    if edges is None:
        edges = host_edges(pages, url, html)
    ranks = propagate(seeds, edges, **options)
    known = ranks.select(F.col("host").alias("_host"), "trust", "distrust")
    rows = rows.join(known, F.col("host") == F.col("_host"), "left").drop("_host").withColumns({
        "trust": F.coalesce("trust", F.lit(0.0)), "distrust": F.coalesce("distrust", F.lit(0.0))})
    blocked = (F.col("distrust") >= least) & (F.col("distrust") > ratio * F.col("trust"))
    rows = rows.withColumn("verdict", F.coalesce("_says", F.when(blocked, F.lit("block")).otherwise(F.lit("allow"))))
    rows = rows.withColumn("decided_by", F.when(F.col("rule").isNotNull(), F.lit("rule")).otherwise(F.lit("ranks")))
    return rows.select(*[F.col(f"`{c}`") for c in kept], *out)
