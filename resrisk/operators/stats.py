"""Statistics: association tests, skylines, scaling, ranks and distribution summaries."""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .metrics import Y, histogram
from .ordering import (
    exact_quantiles, quantile_columns, running_max, running_sums, unpivot, with_value_levels,
)


def clip_to_quantile(df: DataFrame, col: str, q: float = 0.99, name: str = "clipped") -> DataFrame:
    """Cap values at a quantile of the column."""
    cap = exact_quantiles(df, col, [q]).select("value").scalar()
    return df.withColumn(name, F.when(F.col(col).isNotNull(), F.least(F.col(col), cap)))


def chi2_tail(x: float, dof: int) -> float:
    """Upper tail of the chi-squared distribution for whole degrees of freedom.

    A finite sum of Poisson terms; each is taken from its logarithm, so none underflows early.
    """
    if x <= 0:
        return 1.0
    half = x / 2
    step = 0.0 if dof % 2 == 0 else 0.5
    terms = [math.exp((i + step) * math.log(half) - half - math.lgamma(i + step + 1))
             for i in range((dof - int(2 * step)) // 2)]
    return min(1.0, math.fsum(terms) + (math.erfc(math.sqrt(half)) if step else 0.0))


@F.pandas_udf(DoubleType())
def _chi2_p(x: pd.Series, dof: pd.Series) -> pd.Series:
    return pd.Series([chi2_tail(a, int(b)) if pd.notna(a) and b > 0 else None
                      for a, b in zip(x, dof)])


def chi2_independence(df: DataFrame, cols: Sequence[str], target: str = Y) -> DataFrame:
    """Chi-squared test and Cramér's V of each categorical column against a 0 / 1 target.

    Two-by-two tables get the continuity correction; columns with one level are left out.
    """
    long = unpivot(df, cols, [target], ("feature", "value")).filter(
        F.col("value").isNotNull() & F.col(target).isNotNull())
    cells = long.groupBy("feature", "value").agg(
        F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) == 0).alias("neg"))
    totals = cells.groupBy("feature").agg(
        F.sum("pos").alias("_p"), F.sum("neg").alias("_n"), F.count(F.lit(1)).alias("_k"))
    kept = cells.join(totals, "feature").filter("_k >= 2 AND _p > 0 AND _n > 0")
    size, rows = F.col("_p") + F.col("_n"), F.col("pos") + F.col("neg")

    def term(observed: Column, margin: Column) -> Column:
        expected = rows * margin / size
        gap = F.abs(observed - expected)
        gap = F.when(F.col("_k") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return gap * gap / expected

    chi2 = F.sum(term(F.col("pos"), F.col("_p")) + term(F.col("neg"), F.col("_n")))
    out = kept.groupBy("feature").agg(
        chi2.alias("chi2"), (F.max("_k") - 1).alias("dof"),
        F.max(F.col("_p") + F.col("_n")).alias("n"))
    return out.withColumns({
        "cramers_v": F.sqrt(F.col("chi2") / F.col("n")),
        "p_value": _chi2_p("chi2", "dof"),
    }).withColumn("significant", F.col("p_value") < 0.05)


def target_correlation(df: DataFrame, cols: Sequence[str], target: str = Y, k: int = 10
                       ) -> DataFrame:
    """The k numeric columns most correlated with the target, from one aggregate.

    A column that does not vary has no correlation.
    """
    y = F.col(target).cast("double")

    def r(c: str) -> Column:
        x = F.col(c).cast("double")
        both = x.isNotNull() & y.isNotNull()
        spread = F.stddev_pop(F.when(both, x)) * F.stddev_pop(F.when(both, y))
        return F.try_divide(F.covar_pop(x, y), spread).alias(c)

    facts = df.agg(*[r(c) for c in cols])
    rows = facts.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), F.col(c).alias("r")) for c in cols])))
    return rows.filter("r IS NOT NULL").orderBy(F.desc(F.abs("r")), "feature").limit(k)


def fold_summary(df: DataFrame, by: str, metrics: Sequence[str]) -> DataFrame:
    """Mean, spread, range and normal 95 % interval of each metric over folds."""
    long = unpivot(df, metrics, [by], ("metric", "value"), "double")
    out = long.groupBy(by, "metric").agg(
        F.count("value").alias("n_folds"), F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"), F.stddev_pop("value").alias("std_pop"),
        F.min("value").alias("min"), F.max("value").alias("max"))
    reach = 1.96 * F.col("std") / F.sqrt("n_folds")
    return out.withColumns({"ci_low": F.col("mean") - reach, "ci_high": F.col("mean") + reach})


def pareto_frontier(df: DataFrame, x: str, y: str, lower_x: bool = True, higher_y: bool = True
                    ) -> DataFrame:
    """Rows no other row beats on both axes: one ordered pass with a running best."""
    sign = lambda c, up: F.col(c).cast("double") if up else -F.col(c).cast("double")
    rows = df.withColumns({"_x": sign(x, lower_x), "_y": sign(y, higher_y)})
    steps = rows.groupBy("_x").agg(F.max("_y").alias("_top"))
    placed = with_value_levels(steps, "_x", [])
    best = running_max(placed, [F.asc("_x")], {"_best": F.col("_top")}, [F.col("_slice")])
    # A frontier step is the smallest x at which the running best reaches its value.
    front = best.groupBy(F.col("_best").alias("_y")).agg(F.min("_x").alias("_x"))
    return rows.join(front, ["_x", "_y"], "left_semi").drop("_x", "_y")


def minmax_scale(df: DataFrame, cols: dict[str, bool]) -> DataFrame:
    """Scale each column so that 1 is best (``True``: higher is better); constant gives 0.5."""
    span = df.agg(*[f(c).cast("double").alias(f"{n}_{c}")
                    for c in cols for n, f in (("lo", F.min), ("hi", F.max))])
    edge = lambda name: span.select(name).scalar()
    ready = df.withColumns({name: edge(name) for name in span.columns})
    out = {}
    for c, higher in cols.items():
        lo, hi, v = F.col(f"lo_{c}"), F.col(f"hi_{c}"), F.col(c).cast("double")
        up = (v - lo) if higher else (hi - v)
        out[f"{c}_scaled"] = F.when(hi == lo, 0.5).otherwise(F.try_divide(up, hi - lo))
    return ready.withColumns(out).drop(*span.columns)


def rank_normalise(df: DataFrame, value: str, name: str = "rank_unit") -> DataFrame:
    """Average rank scaled to [0, 1]; null values get 0.5."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(F.col(value).alias("_v")).agg(
        F.count(F.lit(1)).alias("_n"))
    placed = with_value_levels(counts, "_v", [], _total=F.sum("_n"), _top=F.max("_v"))
    cum = running_sums(placed, [F.asc("_v")], {"_cum": F.col("_n")}, [F.col("_slice")])
    rank = cum.withColumn("_rank", F.col("_cum") - (F.col("_n") - 1) / 2)
    # The highest average rank belongs to the largest value.
    highest = rank.filter(F.col("_v") == F.col("_top")).select("_rank").scalar()
    unit = rank.withColumn("_highest", highest).select("_v", (
        (F.col("_rank") - 1) / F.greatest(F.col("_highest") - 1, F.lit(1.0))).alias(name))
    # Null values need no rank; as one key of the join they would meet in one task.
    known = df.filter(F.col(value).isNotNull()).join(unit, F.col(value) == F.col("_v")).drop("_v")
    return known.unionByName(df.filter(F.col(value).isNull()).withColumn(name, F.lit(0.5)))


def frequency_code(df: DataFrame, col: str, name: str = "code") -> DataFrame:
    """Category to ordinal by ascending frequency (ties by value)."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    placed = with_value_levels(counts, "_n", [])
    codes = running_sums(placed, [F.asc("_n"), F.asc(col)], {name: F.lit(1)}, [F.col("_slice")])
    return df.join(codes.select(col, (F.col(name) - 1).alias(name)), col, "left")


def distribution_summary(df: DataFrame, value: str, bins: int = 50) -> tuple[DataFrame, DataFrame]:
    """Median and upper quantiles, and the histogram of values capped at the 99th percentile."""
    stats = quantile_columns(df, value, {"median": 0.5, "p95": 0.95, "p99": 0.99})
    row = stats.first()
    top = row["p99"] or 1.0
    capped = df.withColumn("_capped", F.least(F.col(value), F.lit(top)))
    low = capped.agg(F.min("_capped")).first()[0] or 0.0
    return stats, histogram(capped, "_capped", bins, lo=low, hi=top)


def probability_medians(df: DataFrame, bucket: str, day: str, p: str) -> DataFrame:
    ranges = df.groupBy(bucket).agg(F.min(day).alias("first_day"), F.max(day).alias("last_day"),
                                    F.count(F.lit(1)).alias("n"))
    return ranges.join(quantile_columns(df, p, {"median_score": 0.5}, [bucket]), bucket)
