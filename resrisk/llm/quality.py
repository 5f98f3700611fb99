"""Quality rules: a decision list learned by sequential covering from labelled statistics."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .names import shielded

#: ASCII white space and capitals, listed one by one: such classes are table look-ups in Java.
SPACE = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]"
CAPITALS = "[ABCDEFGHIJKLMNOPQRSTUVWXYZ]+"
SYMBOLS = "[#*$%&|<>]+"

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
#: What rules may test: shares and sizes of a text, all computed by `text_statistics`.
FEATURES = ["n_words", "mean_word_chars", "symbols_per_word", "dup_line_share", "repeat_share",
            "distinct_share", "upper_share"]


def text_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of `docs` with counts and shares of the whole text in native expressions.

    Counts (long): n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words. A word is a run of
    characters other than ASCII white space. n_dup_lines counts lines with a word that equal an
    earlier line. n_repeat_words counts the words that lie in a three-word window found twice or
    more in the text, the first included. Shares (double) are those of `FEATURES`. A null or empty
    text has no words and shares of 0. Input columns called as a result are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.withColumn("_whole", whole).withColumn(
        "_words", F.array_remove(F.split("_whole", SPACE), ""))
    n = F.size("_words").cast("long")
    lines = F.filter(F.split("_whole", "\n"), lambda x: x.rlike(WORD))
    rows = rows.withColumns({
        "n_words": n,
        "_lines": lines,
        "word_chars": F.length(F.array_join("_words", "")).cast("long"),
        "n_symbols": (F.length("_whole") - F.length(F.regexp_replace("_whole", SYMBOLS, ""))).cast("long"),
    })
    # A window's key is its hash with the place in the low bits, so that a sort of plain numbers
    # brings equal hashes together. What is left of the hash finds candidates; the few windows
    # found are then compared by their whole hashes.
    hash_at = lambda i: F.xxhash64(F.col("_words")[i], F.col("_words")[i + 1], F.col("_words")[i + 2])
    places = F.call_function("shiftleft", F.lit(1).cast("long"), F.ceil(F.log2(F.greatest(n, F.lit(2)))).cast("int") + 1)
    rows = rows.withColumn("_mask", places - 1)
    keys = F.when(n >= 3, F.sort_array(F.transform(
        F.sequence(F.lit(0), F.size("_words") - 3),
        lambda i: hash_at(i).bitwiseAND(F.bitwise_not("_mask")).bitwiseOR(i.cast("long")))))
    rows = rows.withColumn("_keys", F.coalesce(keys, F.array().cast("array<bigint>")))
    key = F.col("_keys")
    same = lambda x, y: F.coalesce(x.bitwiseXOR(y) <= F.col("_mask"), F.lit(False)) & F.coalesce(x.bitwiseXOR(y) >= 0, F.lit(False))
    alike = F.filter(key, lambda x, k: same(F.get(key, k + 1), x) | same(F.get(key, k - 1), x))
    rows = rows.withColumn("_windows", F.sort_array(F.transform(alike, lambda x: F.struct(
        hash_at(x.bitwiseAND(F.col("_mask")).cast("int")).alias("h"), x.bitwiseAND(F.col("_mask")).cast("int").alias("i")))))
    w = F.col("_windows")
    last = F.size(w) - 1
    twice = F.filter(w, lambda x, k: F.when(k > 0, F.get(w, k - 1)["h"] == x["h"]).otherwise(False)
                     | F.when(k < last, F.get(w, k + 1)["h"] == x["h"]).otherwise(False))
    rows = rows.withColumn("_twice", F.sort_array(F.transform(twice, lambda x: x["i"])))
    t = F.col("_twice")
    # Each window covers three words, less those that the next one covers too.
    covered = F.aggregate(
        t, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).alias("end")),
        lambda a, i: F.struct((a["n"] + F.least(F.lit(3), i + 3 - F.greatest(a["end"], i))).alias("n"), (i + 3).alias("end")))
    rows = rows.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_repeat_words": F.when(F.size(t) > 0, covered["n"]).otherwise(F.lit(0).cast("long")),
    })
    chars = F.greatest(F.col("word_chars"), F.lit(1))
    words = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumns({
        "mean_word_chars": F.col("word_chars") / words,
        "symbols_per_word": F.col("n_symbols") / words,
        "dup_line_share": F.col("n_dup_lines") / F.greatest(F.size("_lines"), F.lit(1)),
        "repeat_share": F.col("n_repeat_words") / words,
        "distinct_share": F.size(F.array_distinct("_words")) / words,
        "upper_share": (F.length("_whole") - F.length(F.regexp_replace("_whole", CAPITALS, ""))) / chars,
    })
    # A generator stands between the expressions and what is built on them: a filter on a result
    # would else be pushed below and have the word arrays computed anew for each of their elements.
    out = [*COUNTS, *[f for f in FEATURES if f not in COUNTS]]
    kept = [c for c in docs.columns if c not in out]
    return rows.select(*[F.col(f"`{c}`") for c in kept], F.explode(F.array(F.struct(*out))).alias("_found")).select(
        *[F.col(f"`{c}`") for c in kept], "_found.*")


@dataclass(frozen=True)
class Test:
    """`feature >= edge` if `above`, else `feature < edge`."""

    feature: str
    above: bool
    edge: float

    def column(self) -> Column:
        c = F.col(self.feature)
        return c >= F.lit(self.edge) if self.above else c < F.lit(self.edge)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.edge:.6g}"


Rule = tuple[Test, ...]


def _all(tests: Rule) -> Column:
    return reduce(lambda a, b: a & b, [t.column() for t in tests], F.lit(True))


def rejects(rules: list[Rule]) -> Column:
    """The number (from 1) of the first rule that fits, as one conditional expression; else null."""
    said = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        said = F.when(_all(rule), F.lit(i)).otherwise(said)
    return said


def _counts(rows: DataFrame, edges: dict[str, list[float]]) -> dict[Test, tuple[int, int]]:
    """(bad, good) rows that each possible test would keep; one aggregate, bounded by the edges."""
    at_or_below = lambda f, es: F.size(F.filter(F.lit(es), lambda e: e <= F.col(f)))
    slots = F.array(*[F.struct(F.lit(f).alias("f"), at_or_below(f, es).alias("slot")) for f, es in edges.items()])
    found = rows.select("bad", F.explode(slots).alias("s")).groupBy("s.f", "s.slot").agg(
        F.count_if("bad").alias("bad"), F.count_if(~F.col("bad")).alias("good")).collect()
    by_feature: dict[str, dict[int, tuple[int, int]]] = {}
    for r in found:
        by_feature.setdefault(r["f"], {})[r["slot"]] = (r["bad"], r["good"])
    counts = {}
    for f, slots_of in by_feature.items():
        all_bad, all_good = (sum(x[i] for x in slots_of.values()) for i in (0, 1))
        below_bad = below_good = 0
        for i, e in enumerate(edges[f]):
            b, g = slots_of.get(i, (0, 0))
            below_bad, below_good = below_bad + b, below_good + g
            counts[Test(f, False, e)] = (below_bad, below_good)
            counts[Test(f, True, e)] = (all_bad - below_bad, all_good - below_good)
    return counts


def _gain(after: tuple[int, int], before: tuple[int, int]) -> float:
    """Bad rows kept, times the bits that their share rises by (FOIL's gain)."""
    from math import log2
    if not after[0]:
        return 0.0
    return after[0] * (log2(after[0] / sum(after)) - log2(before[0] / sum(before)))


def learn_rules(rows: DataFrame, features: list[str] = FEATURES, key: str = "doc_id", edges_per_feature: int = 48,
                most_tests: int = 4, most_rules: int = 24, precision: float = 0.98, least_rows: int = 8) -> list[Rule]:
    """Sequential covering over labelled statistics: `features`, `key` and boolean `bad`.

    Two thirds of the rows (by a hash of the key) grow a rule: test by test, the one of largest
    gain, until no good row is left or no test gains. The other third prunes it: the tests at its
    end go while (bad - good) / (bad + good) does not fall. A rule is taken if its share of bad
    rows is `precision` or more and it covers `least_rows` or more over both parts; the rows it
    covers go and the next rule is grown. Candidate edges are quantiles of either class. Each
    step is one aggregate of bounded size; rows stay in Spark. Without bad rows, or without good
    ones, there are no rules. Null labels and null features are left out.
    """
    rows = rows.filter(F.col("bad").isNotNull()).dropna(subset=features)
    at = [i / edges_per_feature for i in range(1, edges_per_feature)] + [0.001, 0.003, 0.997, 0.999]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(f, at, 10_000).alias(f) for f in features]).collect()
    if len(quantiles) < 2:
        return []
    edges = {f: sorted({e for q in quantiles for e in q[f]}) for f in features}
    # The middle between neighbours keeps rows of either class away from the edge.
    edges = {f: sorted({(a + b) / 2 for a, b in zip(es, es[1:])} or set(es)) for f, es in edges.items()}
    rows = rows.withColumn("_grow", F.pmod(F.xxhash64(F.col(key)), F.lit(3)) != 0)
    rules: list[Rule] = []
    while len(rules) < most_rules:
        left = rows.filter(rejects(rules).isNull())
        grow = left.filter("_grow")
        rule: Rule = ()
        now = None
        while len(rule) < most_tests:
            counts = _counts(grow.filter(_all(rule)), edges)
            if not counts:
                break
            if now is None:
                first = next(iter(counts))
                other = Test(first.feature, not first.above, first.edge)
                now = tuple(a + b for a, b in zip(counts[first], counts[other]))
                if not now[0]:
                    break
            best = max(counts, key=lambda t: (_gain(counts[t], now), counts[t][0], t.feature, t.above, t.edge))
            if _gain(counts[best], now) <= 0:
                break
            rule, now = (*rule, best), counts[best]
            if not now[1]:
                break
        if not rule:
            break
        # All prefixes of the rule are judged in one pass, on either part.
        sizes = left.agg(*[f(_all(rule[:k]) & (F.col("bad") == bad) & (F.col("_grow") == part)).alias(f"k{k}_{bad}_{part}")
                           for f in [F.count_if] for k in range(1, len(rule) + 1)
                           for bad in (True, False) for part in (True, False)]).first()
        worth = lambda k: (
            (sizes[f"k{k}_True_False"] - sizes[f"k{k}_False_False"])
            / max(sizes[f"k{k}_True_False"] + sizes[f"k{k}_False_False"], 1))
        k = len(rule)
        while k > 1 and worth(k - 1) >= worth(k):
            k -= 1
        bad, good = (sum(sizes[f"k{k}_{b}_{p}"] for p in (True, False)) for b in (True, False))
        if bad + good < least_rows or bad < precision * (bad + good):
            break
        rules.append(rule[:k])
    return rules


def fit_quality(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id",
                most_labelled: int = 60_000, **options) -> list[Rule]:
    """Rules from the documents that `labels` (key, quality 0 or 1) covers.

    At most about `most_labelled` labelled documents are used, chosen by a hash of the key; that
    bounds the learning only. Documents with conflicting or null labels are left out.
    """
    known = labels.groupBy(key).agg(F.min("quality").alias("_low"), F.max("quality").alias("_high"))
    known = known.filter("_low = _high").select(F.col(key), (F.col("_low") == 0).alias("bad"))
    slot = F.pmod(F.xxhash64(F.col(key), F.lit("quality sample")), F.lit(1 << 20))
    share = min(1.0, most_labelled / max(known.count(), 1))
    chosen = lambda df: df.filter(slot < F.lit(int(share * (1 << 20)))) if share < 1 else df
    rows = text_statistics(chosen(docs.select(key, text)), text).select(key, *FEATURES)
    rows = written_table(rows.join(chosen(known), key), "llm-quality-labelled")
    return learn_rules(rows, key=key, **options)


@shielded
def judge_quality(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """Every row of `docs` with its statistics, `base_failed`, `rule_no` and `kept`.

    A document fails the base with fewer than 50 words, or if more than half of its words lie in
    repeated three-word windows. It is kept if it does not fail the base and no rule fits;
    `rule_no` is the first rule that fits. Null texts, empty tables and clashing columns as in
    `text_statistics`; rows are judged one by one, repeated ones alike.
    """
    rows = text_statistics(docs, text)
    return rows.withColumn("base_failed", (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
                           ).withColumn("rule_no", rejects(rules)
                           ).withColumn("kept", ~F.col("base_failed") & F.col("rule_no").isNull())


@shielded
def keep_good(docs: DataFrame, rules: list[Rule], text: str = "text") -> DataFrame:
    """The rows of `docs` that `judge_quality` keeps, with the columns of `docs`."""
    marked = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row"), F.col(text).alias("_of"))
    return judge_quality(marked, rules, "_of").filter("kept").select("_row.*")
