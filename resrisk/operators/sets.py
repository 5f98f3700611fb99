"""Joins, duplicates and set comparisons."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import Y
from .ordering import running_sums, unpivot, with_value_levels


def metrics_with_cost(metrics: DataFrame, costs: DataFrame, key: str = "model") -> DataFrame:
    return metrics.join(costs, key, "inner")


def rows_of_top_models(rows: DataFrame, models: DataFrame, best: Sequence[Column], k: int,
                       key: str = "model") -> DataFrame:
    """Keep the rows of the k best models; the order takes the top k of each task first."""
    return rows.join(models.orderBy(*best).limit(k).select(key), key, "left_semi")


def union_splits(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def duplicate_summary(df: DataFrame) -> DataFrame:
    """Rows before and after dropping exact copies; copies are counted, never gathered."""
    groups = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    out = groups.agg(F.sum("_n").alias("rows_before"), F.count(F.lit(1)).alias("rows_after"))
    return out.withColumn("dropped_share",
                          1 - F.try_divide(F.col("rows_after"), F.col("rows_before")))


def first_copies(df: DataFrame, features: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row, by ``order`` and then all other columns, of the rows that agree in ``features``.

    Null equals null, and comes first in the order. Unlike `dropDuplicates`, which keeps whichever copy a shuffle delivers first,
    every reading keeps the same rows, so cuts found on one reading hold on the next.
    """
    first = [c for c in order if c not in features]
    rest = [c for c in df.columns if c not in (*features, *first)]
    kept = df.groupBy(*features).agg(F.min(F.struct(*first, *rest)).alias("_first"))
    return kept.select(*[c if c in features else F.col(f"_first.{c}").alias(c) for c in df.columns])


def duplicate_clusters(df: DataFrame, features: Sequence[str], label: str = Y) -> DataFrame:
    """How many feature vectors repeat, and whether their labels agree (null equals null)."""
    groups = df.groupBy(*features).agg(
        F.count(F.lit(1)).alias("n"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    multi = F.col("n") > 1
    out = groups.agg(
        F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_unique"),
        F.count_if(multi).alias("n_clusters"),
        F.count_if(multi & (F.col("lo") == F.col("hi"))).alias("n_consistent"))
    rate = F.coalesce(F.try_divide("n_duplicates", "n_rows"), F.lit(0.0))
    agree = F.coalesce(F.try_divide("n_consistent", "n_clusters"), F.lit(0.0))
    return out.withColumn("n_duplicates", F.col("n_rows") - F.col("n_unique")).withColumns(
        {"duplicate_rate": rate, "consistent_share": agree}).withColumn(
            # Limits of the verdict.
            "verdict",
            F.when((F.col("duplicate_rate") >= 0.30) & (F.col("consistent_share") >= 0.90),
                   "DATASET CLUSTER STRUCTURE")
            .when(F.col("duplicate_rate") >= 0.15, "ELEVATED DUPLICATION")
            .otherwise("LOW DUPLICATION"))


def cluster_size_histogram(df: DataFrame, features: Sequence[str]) -> DataFrame:
    sizes = df.groupBy(*features).agg(F.count(F.lit(1)).alias("cluster_size"))
    return sizes.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n_clusters"))


def split_overlap(test: DataFrame, seen: DataFrame, features: Sequence[str]) -> DataFrame:
    """Test rows whose feature vector also occurs in the other rows.

    Test rows are counted per vector first, so both join sides hold each vector once and a hot
    vector is a single row.
    """
    mine = test.groupBy(*features).agg(F.count(F.lit(1)).alias("n"))
    theirs = seen.select(*features).distinct().select(
        *[F.col(f).alias(f"_{f}") for f in features], F.lit(True).alias("_seen"))
    same = reduce(lambda a, b: a & b, [F.col(f).eqNullSafe(F.col(f"_{f}")) for f in features])
    out = mine.join(theirs, same, "left").agg(
        F.sum("n").alias("n_test"),
        F.coalesce(F.sum(F.when(F.col("_seen"), F.col("n"))), F.lit(0)).alias("n_seen"))
    return out.withColumn("seen_share", F.coalesce(F.try_divide("n_seen", "n_test"), F.lit(0.0)))


def category_set_diff(a: DataFrame, b: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Distinct (dimension, value) pairs found in one table only or in both."""
    pairs = lambda df: unpivot(df, dims).filter("segment IS NOT NULL").distinct()
    both = pairs(a).intersect(pairs(b)).withColumn("found_in", F.lit("both"))
    only_a = pairs(a).exceptAll(pairs(b)).withColumn("found_in", F.lit("a_only"))
    only_b = pairs(b).exceptAll(pairs(a)).withColumn("found_in", F.lit("b_only"))
    return union_splits(both, only_a, only_b)


def full_outer_counts(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    """Counts per value in both tables, 0 where a table lacks the value."""
    count = lambda df, name: df.filter(F.col(col).isNotNull()).groupBy(col).agg(
        F.count(F.lit(1)).alias(name))
    return count(a, "n_a").join(count(b, "n_b"), col, "full_outer").fillna({"n_a": 0, "n_b": 0})


def rank_alignment(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """Ranks of the shared keys of two rankings (small tables), highest value first."""
    both = a.select(key, F.col(value).alias("value_a")).join(
        b.select(key, F.col(value).alias("value_b")), key)
    ranked = both
    for side in ("a", "b"):
        # Average rank over ties, from the number of keys with a higher value.
        value = f"value_{side}"
        counts = ranked.groupBy(F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
        placed = with_value_levels(counts, "_v", [])
        cum = running_sums(placed, [F.desc("_v")], {"_cum": F.col("_n")}, [-F.col("_slice")])
        rank = cum.select("_v", (F.col("_cum") - (F.col("_n") - 1) / 2).alias(f"rank_{side}"))
        ranked = ranked.join(rank, F.col(value).eqNullSafe(F.col("_v"))).drop("_v")
    return ranked


def spearman(ranked: DataFrame) -> DataFrame:
    return ranked.agg(F.count(F.lit(1)).alias("n_shared"),
                      F.corr("rank_a", "rank_b").alias("spearman"))


def share_alignment(a: DataFrame, b: DataFrame, key: str, value: str, k: int = 10) -> DataFrame:
    """Shares of the union of both top-k lists, with flags for where a key is known."""
    share = lambda df, side: df.select(
        key, (F.col(value) / df.agg(F.sum(value)).scalar()).alias(f"share_{side}"))
    sa, sb = share(a, "a"), share(b, "b")
    top = lambda df, side: df.orderBy(F.desc(f"share_{side}"), key).limit(k).select(key)
    keys = top(sa, "a").union(top(sb, "b")).distinct()
    joined = keys.join(sa, key, "left").join(sb, key, "left")
    return joined.withColumns({
        "in_a": F.col("share_a").isNotNull(), "in_b": F.col("share_b").isNotNull(),
    }).fillna({"share_a": 0.0, "share_b": 0.0})


def with_calendar(facts: DataFrame, dates: DataFrame, day: str) -> DataFrame:
    """Facts with the date dimension (one row per calendar day: small enough to broadcast)."""
    return facts.join(F.broadcast(dates), facts[day] == dates["date"], "left")
