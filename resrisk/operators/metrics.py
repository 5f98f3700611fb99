"""Binary-classification, calibration and regression metrics as aggregates.

Every metric takes ``by``: with it one job yields the metric for all groups at once.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordering import exact_quantiles, quantile_columns, running_sums, slice_of

Y, P = "is_canceled", "cancel_probability"


def confusion_aggs(t: Column | float, y: str = Y, p: str = P) -> list[Column]:
    """TN, FP, FN, TP; a score equal to the threshold counts as positive."""
    hit, actual = F.col(p) >= t, F.col(y) == 1
    return [
        F.count_if(~hit & ~actual).alias("tn"), F.count_if(hit & ~actual).alias("fp"),
        F.count_if(~hit & actual).alias("fn"), F.count_if(hit & actual).alias("tp"),
    ]


def ratio0(a: Column, b: Column) -> Column:
    """a / b, or 0 where b is 0."""
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def prf_columns() -> dict[str, Column]:
    """Precision, recall, F1 and balanced accuracy from confusion counts."""
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    recall = F.try_divide(tp, tp + fn)
    specificity = F.try_divide(tn, tn + fp)
    return {
        "precision": ratio0(tp, tp + fp),
        "recall": F.coalesce(recall, F.lit(0.0)),
        "f1": ratio0(2 * tp, 2 * tp + fp + fn),
        # With one class only the present class counts.
        "balanced_accuracy": F.when(recall.isNull(), specificity).when(specificity.isNull(), recall)
        .otherwise((recall + specificity) / 2),
    }


def rate_columns() -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return {
        "tpr": F.try_divide(tp, tp + fn), "tnr": F.try_divide(tn, tn + fp),
        "fpr": F.try_divide(fp, tn + fp), "fnr": F.try_divide(fn, tp + fn),
    }


def confusion_counts(df: DataFrame, t: float, by: Sequence[str] = (), y: str = Y, p: str = P
                     ) -> DataFrame:
    return df.groupBy(*by).agg(*confusion_aggs(t, y, p))


def score_groups(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """Positives and negatives per distinct score; a hot score collapses before the shuffle."""
    return df.filter(F.col(p).isNotNull()).groupBy(*by, F.col(p).alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg"))


def descending_totals(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives at or above each distinct score in [0, 1]."""
    return running_sums(
        groups, [F.desc("score")], {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
        [slice_of(1 - F.col("score"))], by)


def auc_columns() -> list[Column]:
    """Exact ROC-AUC (ties count half) and average precision over descending totals."""
    pos, neg = F.col("pos"), F.col("neg")
    pairs = F.sum(pos).cast("double") * F.sum(neg)
    lost = F.sum(pos * (F.col("cum_neg") - neg / 2))
    steps = F.sum(pos * F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg")))
    return [
        F.when(pairs > 0, 1 - lost / F.nullif(pairs, F.lit(0.0))).alias("roc_auc"),
        F.when(pairs > 0, steps / F.nullif(F.sum(pos), F.lit(0))).alias("pr_auc"),
    ]


def auc_metrics(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    return descending_totals(score_groups(df, by, y, p), by).groupBy(*by).agg(*auc_columns())


def threshold_metrics(df: DataFrame, t: float, by: Sequence[str] = (), y: str = Y, p: str = P
                      ) -> DataFrame:
    """Both AUCs and the threshold metrics, all from one pre-aggregation by score.

    The confusion counts at ``t`` are sums over score groups too, so rows are read once.
    """
    return metrics_of_groups(score_groups(df, by, y, p), t, by)


def metrics_of_groups(groups: DataFrame, t: float, by: Sequence[str] = ()) -> DataFrame:
    """`threshold_metrics` of rows already counted by `score_groups`."""
    totals = descending_totals(groups, by)
    hit = F.col("score") >= t
    cell = lambda keep, c: F.coalesce(F.sum(F.when(keep, F.col(c))), F.lit(0))
    out = totals.groupBy(*by).agg(
        *auc_columns(), cell(~hit, "neg").alias("tn"), cell(hit, "neg").alias("fp"),
        cell(~hit, "pos").alias("fn"), cell(hit, "pos").alias("tp"))
    return out.withColumns(prf_columns())


def curve_points(df: DataFrame, by: Sequence[str] = (), y: str = Y, p: str = P) -> DataFrame:
    """ROC and precision-recall curve points, one per distinct score."""
    totals = descending_totals(score_groups(df, by, y, p), by)
    sums = totals.groupBy(*by).agg(F.sum("pos").alias("_p"), F.sum("neg").alias("_n"))
    if by:
        joined = totals.join(sums, list(by))
    else:
        joined = totals.withColumns({
            "_p": sums.select("_p").scalar(), "_n": sums.select("_n").scalar()})
    return joined.select(
        *by, F.col("score").alias("threshold"), F.col("cum_pos").alias("tp"),
        F.col("cum_neg").alias("fp"),
        F.try_divide("cum_pos", "_p").alias("tpr"), F.try_divide("cum_neg", "_n").alias("fpr"),
        (F.col("cum_pos") / (F.col("cum_pos") + F.col("cum_neg"))).alias("precision"))


def brier(y: str = Y, p: str = P) -> Column:
    return F.avg(F.pow(F.col(p) - F.col(y), 2))


def log_loss(y: str = Y, p: str = P, eps: float = 1e-15) -> Column:
    q = F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))
    return F.avg(-F.when(F.col(y) == 1, F.log(q)).otherwise(F.log(1 - q)))


def uniform_bin(p: Column, bins: int, closed_last: bool = True) -> Column:
    """0-based bin on [0, 1] by the exact bin edges k / bins."""
    b = F.floor(p * bins)
    b = F.when((b + 1) / bins <= p, b + 1).when(b / bins > p, b - 1).otherwise(b)
    return F.least(b, F.lit(bins - 1)) if closed_last else F.when(b < bins, b)


def calibration_bins(df: DataFrame, by: Sequence[str] = (), bins: int = 10,
                     closed_last: bool = True, y: str = Y, p: str = P) -> DataFrame:
    b = uniform_bin(F.col(p), bins, closed_last)
    return (
        df.filter(F.col(p).isNotNull()).groupBy(*by, b.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"),
             F.avg(y).alias("frac_pos"))
    )


def ece(df: DataFrame, by: Sequence[str] = (), bins: int = 10, closed_last: bool = True,
        y: str = Y, p: str = P) -> DataFrame:
    """Expected calibration error; an open last bin leaves out scores of exactly 1."""
    gap = F.abs(F.col("frac_pos") - F.col("mean_pred"))
    inside = F.col("bin").isNotNull()
    return calibration_bins(df, by, bins, closed_last, y, p).groupBy(*by).agg(
        F.try_divide(F.sum(F.when(inside, F.col("n") * gap)), F.sum("n")).alias("ece"))


def reliability_quantile(df: DataFrame, bins: int = 10, y: str = Y, p: str = P) -> DataFrame:
    """Mean prediction and observed rate per quantile bin; empty bins are left out."""
    rows = exact_quantiles(df, p, [i / bins for i in range(1, bins)]).collect()
    edges = [r["value"] for r in rows]
    bin_of = sum(((F.col(p) > e).cast("int") for e in edges), F.lit(0))
    return df.groupBy(bin_of.cast("bigint").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_pred"), F.avg(y).alias("frac_pos"))


def reliability_uniform(df: DataFrame, by: Sequence[str] = (), bins: int = 10, min_rows: int = 5,
                        y: str = Y, p: str = P) -> DataFrame:
    points = calibration_bins(df, by, bins, False, y, p)
    return points.filter(F.col("bin").isNotNull() & (F.col("n") >= min_rows))


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (),
              lo: float = 0.0, hi: float = 1.0) -> DataFrame:
    """Counts and density per bin of equal width; the last bin is closed."""
    width = (hi - lo) / bins
    unit = (F.col(value) - lo) / (hi - lo)
    counts = (
        df.filter(F.col(value).between(lo, hi))
        .groupBy(*by, uniform_bin(unit, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    )
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(
        Window.partitionBy(F.lit(0)))
    return counts.withColumn("density", F.col("n") / (total * width))


def class_cdf(df: DataFrame, y: str = Y, p: str = P) -> DataFrame:
    """Share of rows at or below each distinct score, per class."""
    groups = df.groupBy(F.col(y).alias("class"), F.col(p).alias("score")).agg(
        F.count(F.lit(1)).alias("n"))
    cum = running_sums(groups, [F.asc("score")], {"cum": F.col("n")},
                       [slice_of(F.col("score"))], ["class"])
    sizes = groups.groupBy("class").agg(F.sum("n").alias("total"))
    return cum.join(sizes, "class").select(
        "class", "score", "n", (F.col("cum") / F.col("total")).alias("cdf"))


def outcome_label(t: float, y: str = Y, p: str = P) -> Column:
    hit, actual = F.col(p) >= t, F.col(y) == 1
    return F.when(hit & actual, "TP").when(hit, "FP").when(actual, "FN").otherwise("TN")


def outcome_profile(df: DataFrame, t: float, features: Sequence[str]) -> DataFrame:
    return df.groupBy(outcome_label(t).alias("outcome")).agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(f).alias(f"mean_{f}") for f in features])


def regression_metrics(df: DataFrame, actual: str, pred: str, by: Sequence[str] = ()) -> DataFrame:
    a, e = F.col(actual), F.col("_e")
    known = df.filter(a.isNotNull() & F.col(pred).isNotNull()).withColumn(
        "_e", a - F.col(pred)).select(*by, actual, "_e")
    out = known.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (1 - F.try_divide(F.sum(e * e), F.var_pop(actual) * F.count(F.lit(1)))).alias("r2"),
        (100 * F.avg(F.abs(F.try_divide(e, a)))).alias("mape"),
        F.avg(e).alias("resid_mean"), F.stddev_samp(e).alias("resid_std"),
        F.avg((F.abs(e) <= 25).cast("double")).alias("within_25"),
        F.avg((F.abs(e) <= 50).cast("double")).alias("within_50"))
    middle = quantile_columns(known, "_e", {"resid_median": 0.5}, by)
    if by:
        return out.join(middle, list(by))
    return out.withColumn("resid_median", middle.scalar())
