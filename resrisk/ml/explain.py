"""Contributions of a fitted model's features, and importance by permutation."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.metrics import Y, auc_columns, descending_totals
from ..session import written_table
from .fits import Trees


def encoded_names(rows: DataFrame, features: str = "features") -> list[str]:
    """Names of a feature vector's entries, from the column's metadata."""
    attrs = rows.schema[features].metadata["ml_attr"]["attrs"]
    names = {a["idx"]: a["name"] for kind in attrs.values() for a in kind}
    return [names[i] for i in range(len(names))]


def raw_name(encoded: str, raw: Sequence[str]) -> str:
    """The raw feature of an encoded entry: the longest name that is it or its prefix up to `_`."""
    fits = [r for r in raw if encoded == r or encoded.startswith(f"{r}_")]
    return max(fits, key=len, default="_other")


class Explainer:
    """Margins of a fitted logistic or boosted model, and what each entry of a row adds to them.

    Logistic: coefficient times distance from the mean of the rows given as `background`. Boosted:
    changes of the node value along the row's paths. Contributions and `base` add up to the margin.
    """

    def __init__(self, model, background: DataFrame | None = None) -> None:
        self.trees = Trees(model) if hasattr(model, "treeWeights") else None
        if self.trees is None:
            self.weights, self.intercept = model.coefficients.toArray(), float(model.intercept)
            self.mean = np.zeros(len(self.weights))
            if background is not None:
                self.mean = background.select(Summarizer.mean(F.col("features"))).first()[0].toArray()

    @property
    def base(self) -> float:
        return self.trees.base if self.trees else self.intercept + float(self.weights @ self.mean)

    def margins(self, x: np.ndarray) -> np.ndarray:
        if self.trees:
            return self.trees.margins(x, [len(self.trees.roots)])[:, 0]
        return x @ self.weights + self.intercept

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        # The boosted margin is half of the log odds.
        return 1 / (1 + np.exp(-(2 if self.trees else 1) * self.margins(x)))

    def exchanged(self, x: np.ndarray, exchanges: Iterable[tuple[Sequence[int], np.ndarray]]) -> Iterator[np.ndarray]:
        """Probabilities of `x` for each (entries, order): with these entries taken from the rows in that order.

        A tree without a split on the entries adds what it added, so only the others are walked again.
        """
        known = self.trees.each(x, range(len(self.trees.roots))) if self.trees else None
        for entries, order in exchanges:
            mixed = x.copy()
            mixed[:, entries] = x[np.ix_(order, entries)]
            if known is None:
                yield self.probabilities(mixed)
                continue
            again, total = self.trees.each(mixed, self.trees.splitting_on(entries)), np.zeros(len(x))
            for t, added in known.items():
                total += again.get(t, added)
            yield 1 / (1 + np.exp(-2 * total))

    def contributions(self, x: np.ndarray) -> np.ndarray:
        return self.trees.contributions(x) if self.trees else (x - self.mean) * self.weights

    def column(self, groups: Sequence[int], n_groups: int, features: str = "features", marked: bool = False) -> Column:
        """An array of contributions, summed over the entries of each group.

        `marked` adds as many numbers: the entries of each group that are not 0.
        """
        of = np.eye(n_groups)[list(groups)]

        @F.pandas_udf("array<double>")
        def summed(vectors: pd.Series) -> pd.Series:
            x = np.vstack(vectors) if len(vectors) else np.zeros((0, len(of)))
            each = self.contributions(x)
            return pd.Series(list(np.hstack([each @ of, (each != 0) @ of]) if marked else each @ of))

        return summed(vector_to_array(features))


def attribution_rows(explainer: Explainer, rows: DataFrame, keys: Sequence[str],
                     features: str = "features") -> DataFrame:
    """(keys, encoded, contribution) of every entry that adds to a row's margin."""
    names = encoded_names(rows, features)
    each = rows.select(*keys, F.posexplode(explainer.column(range(len(names)), len(names), features)).alias("_i", "contribution"))
    named = F.element_at(F.array(*[F.lit(n) for n in names]), F.col("_i") + 1)
    return each.filter("contribution != 0").select(*keys, named.alias("encoded"), "contribution")


def attribution_sums(explainer: Explainer, rows: DataFrame, keys: Sequence[str], raw: Sequence[str],
                     features: str = "features") -> tuple[DataFrame, list[str]]:
    """The contributions of `attribution_rows` summed by key and raw feature, side by side; the features.

    `_s0`, `_s1`... are the sums, and `_h0`, `_h1`... true where a feature has an entry that adds to
    the margin. The entries of a row are summed in the row, so what is grouped is the rows.
    """
    order = [*dict.fromkeys(raw), "_other"]
    at = [order.index(raw_name(n, raw)) for n in encoded_names(rows, features)]
    n = len(order)
    each = rows.select(*keys, explainer.column(at, n, features, marked=True).alias("_c"))
    sums = each.groupBy(*keys).agg(
        *[F.sum(F.when(F.col("_c")[n + i] > 0, F.col("_c")[i])).alias(f"_s{i}") for i in range(n)],
        *[F.max(F.when(F.col("_c")[n + i] > 0, True)).alias(f"_h{i}") for i in range(n)])
    return sums, order


def with_top_features(explainer: Explainer, rows: DataFrame, raw: Sequence[str], k: int = 5,
                      features: str = "features", name: str = "top_features") -> DataFrame:
    """`rows` and an array of the k raw features that add most, with value and contribution.

    Sums over the entries of a raw feature and the choice of the largest are made in the row, so
    nothing is shuffled.
    """
    names = encoded_names(rows, features)
    found = [raw_name(n, raw) for n in names]
    order = [*raw, "_other"]
    wide = rows.withColumn("_c", explainer.column([order.index(f) for f in found], len(order), features))
    value = lambda c: F.col(f"`{c}`").cast("string") if c in rows.columns else F.lit(None).cast("string")
    cells = F.array(*[
        F.struct(-F.round(F.abs(F.col("_c")[i]), 12).alias("_o"), F.lit(c).alias("feature"), value(c).alias("value"),
                 F.round(F.col("_c")[i], 4).alias("contribution")) for i, c in enumerate(order)])
    some = F.filter(cells, lambda c: (c["feature"] != "_other") | (F.abs(c["contribution"]) >= 1e-6))
    top = F.transform(F.slice(F.sort_array(some), 1, k), lambda c: F.struct(
        c["feature"].alias("feature"), c["value"].alias("value"), c["contribution"].alias("contribution")))
    return wide.withColumn(name, top).drop("_c")


def feature_groups(names: Sequence[str], raw: Sequence[str]) -> dict[str, list[int]]:
    """Entries of each raw feature that has any."""
    groups: dict[str, list[int]] = {}
    for i, n in enumerate(names):
        groups.setdefault(raw_name(n, raw), []).append(i)
    return groups


def permuted_scores(explainer: Explainer, rows: DataFrame, keys: Sequence[str], groups: dict[str, list[int]],
                    repeats: int = 20, seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """(feature, repeat, target, score): every row once per feature and repeat, that feature permuted.

    Rows are dealt by a hash of their key into blocks, anew for each repeat, and a feature's values
    are exchanged within the block by a permutation that is seeded by (seed, repeat, block,
    feature). So the exchange is a bijection on all rows that needs no join, a repeated task makes
    the same one, and a block is one task however large the table. The feature `none` has no
    exchange.
    """
    def every_row(labels: list[str], repeat: int, y: np.ndarray, scores: list[np.ndarray]) -> pa.Table:
        return pa.table({
            "feature": pa.array(np.repeat(labels, len(y)).tolist(), pa.string()),
            "repeat": pa.array(np.full(len(y) * len(labels), repeat, np.int32)),
            Y: pa.array(np.tile(y, len(labels)).astype(np.int32)),
            "score": pa.array(np.concatenate(scores))})

    return _by_block(explainer, rows, keys, groups, repeats, seed, block_rows, every_row,
                     f"feature string, repeat int, {Y} int, score double")


def permuted_counts(explainer: Explainer, rows: DataFrame, keys: Sequence[str], groups: dict[str, list[int]],
                    repeats: int = 20, seed: int = 42, block_rows: int = 4096) -> DataFrame:
    """(feature, repeat, score, pos, neg): the rows of `permuted_scores` counted per distinct score.

    They are counted within their block first, so rows of equal scores leave it as one.
    """
    def counted(labels: list[str], repeat: int, y: np.ndarray, scores: list[np.ndarray]) -> pa.Table:
        each = []
        for s in scores:
            found, at = np.unique(s, return_inverse=True)
            each.append((found, *(np.bincount(at[y == k], minlength=len(found)) for k in (1, 0))))
        sizes = [len(found) for found, _, _ in each]
        score, pos, neg = (np.concatenate(c) for c in zip(*each))
        return pa.table({
            "feature": pa.array(np.repeat(labels, sizes).tolist(), pa.string()),
            "repeat": pa.array(np.full(len(score), repeat, np.int32)), "score": pa.array(score),
            "pos": pa.array(pos.astype(np.int64)), "neg": pa.array(neg.astype(np.int64))})

    each = _by_block(explainer, rows, keys, groups, repeats, seed, block_rows, counted,
                     "feature string, repeat int, score double, pos bigint, neg bigint")
    return each.groupBy("feature", "repeat", "score").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def _by_block(explainer: Explainer, rows: DataFrame, keys: Sequence[str], groups: dict[str, list[int]], repeats: int,
              seed: int, block_rows: int, made: Callable, schema: str) -> DataFrame:
    """What `made` makes of each block's labels, repeat, targets and scores by label."""
    blocks = max(1, round(rows.count() / block_rows))
    labels = ["none", *groups]

    def score(block: pa.Table) -> pa.Table:
        block = block.sort_by("_o")
        x = np.vstack(block["x"].to_numpy())
        at = int(block["block"][0].as_py()), int(block["repeat"][0].as_py())
        # `none` exchanges no entry.
        orders = (([] if name == "none" else groups[name], np.random.default_rng([seed, *at, i]).permutation(len(x)))
                  for i, name in enumerate(labels))
        return made(labels, at[1], block[Y].to_numpy(), list(explainer.exchanged(x, orders)))

    each = rows.select(F.col(Y).cast("int").alias(Y), vector_to_array("features").alias("x"), *keys,
                       F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = each.select(
        Y, "x", "repeat", F.pmod(F.xxhash64(*keys, "repeat", F.lit(seed)), F.lit(blocks)).cast("int").alias("block"),
        F.xxhash64(*keys, F.lit(seed + 1)).alias("_o"))
    return each.groupBy("repeat", "block").applyInArrow(score, schema)


def permutation_importance(explainer: Explainer, rows: DataFrame, keys: Sequence[str], groups: dict[str, list[int]],
                           repeats: int = 20, seed: int = 42, alpha: float = 0.05, **options) -> DataFrame:
    """ROC-AUC lost per feature: mean, deviation and percentile interval over the repeats.

    `groups` gives the entries of the feature vector that are exchanged together: those of a raw
    feature, or of several raw features as one.
    """
    by = ["feature", "repeat"]
    # Written once: the running totals and both sides of the comparison read them.
    counts = written_table(permuted_counts(explainer, rows, keys, groups, repeats, seed, **options), "permuted-counts")
    aucs = descending_totals(counts, by).groupBy(*by).agg(*auc_columns())
    base = aucs.filter("feature = 'none'").select("repeat", F.col("roc_auc").alias("_base"))
    lost = aucs.filter("feature != 'none'").join(base, "repeat").withColumn("lost", F.col("_base") - F.col("roc_auc"))
    # One row per feature and repeat: small.
    return lost.groupBy("feature").agg(
        F.count("lost").alias("repeats"), F.avg("lost").alias("mean_importance"), F.stddev_samp("lost").alias("std_importance"),
        F.percentile("lost", alpha / 2).alias("ci_low"), F.percentile("lost", 1 - alpha / 2).alias("ci_high"))


def merged_groups(groups: dict[str, list[int]], family_of: Callable[[str], str]) -> dict[str, list[int]]:
    """Groups of raw features taken together by family."""
    out: dict[str, list[int]] = {}
    for name, entries in groups.items():
        out.setdefault(family_of(name), []).extend(entries)
    return out
