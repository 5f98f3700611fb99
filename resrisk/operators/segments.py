"""Segment reports: grouped metrics, breakdowns, matrices and lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from .metrics import P, Y, auc_metrics, confusion_aggs, metrics_of_groups, prf_columns
from .ordering import most_frequent, quantile_columns, unpivot

METRICS = ["roc_auc", "pr_auc", "precision", "recall", "f1", "balanced_accuracy"]


def segment_metrics(df: DataFrame, t: float, dims: dict[str, int] = C.SEGMENT_DIMENSIONS,
                    min_rows: int = C.SEGMENT_MIN_ROWS, policy: str = "max_f1") -> DataFrame:
    """Metrics of the most frequent values of each dimension; small or one-class ones are skipped.

    All segments come from one long table, so a hundred segments cost as much as one. Its rows are
    grouped by segment and score once; sizes, the most frequent values and the curves follow from
    these groups.
    """
    keys = ["dimension", "segment"]
    long = unpivot(df, list(dims), [Y, P]).fillna({"segment": "UNKNOWN"})
    groups = long.groupBy(*keys, F.col(P).alias("score")).agg(
        F.count_if(F.col(Y) == 1).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg"),
        F.count(F.lit(1)).alias("_n"))
    sizes = groups.groupBy(*keys).agg(F.sum("_n").alias("n_rows"))
    top = most_frequent(sizes, dims).select(*keys)
    # Only the groups of the wanted segments go on to the score curves.
    wanted = groups.filter(F.col("score").isNotNull()).drop("_n").join(top, keys, "left_semi")
    stats = metrics_of_groups(wanted, t, keys)
    total = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    positive = F.col("tp") + F.col("fn")
    mixed = (positive > 0) & (positive < total)
    gated = (total >= min_rows) & mixed
    return stats.select(
        F.lit(policy).alias("policy"), *keys, total.alias("n_rows"),
        (positive / total).alias("positive_rate"), gated.alias("gated"),
        F.lit(float(t)).alias("threshold"),
        *[F.when(gated, F.col(m)).alias(m) for m in METRICS],
        F.when(total < min_rows, "insufficient_rows").when(~mixed, "single_class")
        .alias("skip_reason"))


def segment_cost_benefit(df: DataFrame, dims: Sequence[str], t: float, fp_cost: float = C.FP_COST
                         ) -> DataFrame:
    long = unpivot(df, dims, [Y, P, "revenue_at_risk"]).filter(F.col("segment").isNotNull())
    p, y, value = F.col(P), F.col(Y), F.col("revenue_at_risk")
    money = lambda cond: F.coalesce(F.sum(F.when(cond, value)), F.lit(0.0))
    out = long.groupBy("dimension", "segment").agg(
        *confusion_aggs(t), money((p >= t) & (y == 1)).alias("revenue_saved"),
        money((p < t) & (y == 1)).alias("fn_loss"))
    spend = F.col("fp") * F.lit(float(fp_cost))
    return out.withColumns({
        "fp_spend": spend, "net_benefit": F.col("revenue_saved") - spend - F.col("fn_loss")})


def late_window_report(df: DataFrame, policies: dict[str, float]) -> DataFrame:
    """Bookings made shortly before arrival: share, rates and metrics per policy.

    The threshold metrics of all policies and both AUCs come from one pre-aggregation by score.
    """
    late = F.coalesce(F.col("lead_time") <= C.LATE_WINDOW_DAYS, F.lit(False))
    share = df.agg(
        F.count_if(late).alias("n_late"), F.count(F.lit(1)).alias("n_total"),
        F.avg(Y).alias("cancel_rate_overall"), F.avg(F.when(late, F.col(Y))).alias(
            "cancel_rate_late")).withColumn("late_share", F.col("n_late") / F.col("n_total"))
    rows = df.filter(late).select(Y, P, F.inline(F.array(*[
        F.struct(F.lit(n).alias("policy"), F.lit(float(t)).alias("threshold"))
        for n, t in policies.items()])))
    shifted = rows.groupBy("policy", "threshold").agg(*confusion_aggs(F.col("threshold")))
    auc = auc_metrics(df.filter(late))
    return shifted.withColumns(prf_columns()).withColumns({
        **{c: share.select(c).scalar() for c in share.columns},
        **{c: auc.select(c).scalar() for c in auc.columns},
    })


def category_breakdown(df: DataFrame, dims: Sequence[str], min_rows: int = 50) -> DataFrame:
    """Size, outcome and averages per value of each dimension, with its share of the rows."""
    long = unpivot(df, dims, [Y, "lead_time", "adr", "total_stay"]).filter("segment IS NOT NULL")
    out = long.groupBy("dimension", "segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(Y).alias("cancelled"), F.avg(Y).alias("cancel_rate"),
        F.avg("lead_time").alias("mean_lead"), F.avg("adr").alias("mean_adr"),
        F.avg("total_stay").alias("mean_stay"))
    totals = out.groupBy("dimension").agg(F.sum("n").alias("_total"))
    return out.join(totals, "dimension").withColumn(
        "share", F.col("n") / F.col("_total")).drop("_total").filter(F.col("n") >= min_rows)


def rate_cells(df: DataFrame, a: str, b: str, min_rows: int = 300) -> DataFrame:
    """Outcome rate per pair of values; thin cells keep their size but show no rate."""
    return df.groupBy(a, b).agg(
        F.count(F.lit(1)).alias("n"),
        F.when(F.count(F.lit(1)) >= min_rows, F.avg(Y)).alias("cancel_rate"))


def rate_heatmap(df: DataFrame, rows: str, cols: str, domain: Sequence[str], min_rows: int = 300
                 ) -> DataFrame:
    """Rates as a matrix, rows ordered by their marginal rate."""
    enough = F.count(F.lit(1)) >= min_rows
    matrix = df.groupBy(rows).pivot(cols, list(domain)).agg(F.when(enough, F.avg(Y)))
    marginal = df.groupBy(rows).agg(F.avg(Y).alias("row_rate"))
    return matrix.join(marginal, rows).orderBy(F.desc("row_rate"), rows)


def heatmap_extremes(df: DataFrame, a: str, b: str, k: int = 5, min_rows: int = 300) -> DataFrame:
    cells = rate_cells(df, a, b, min_rows).filter("cancel_rate IS NOT NULL")
    label = lambda d, kind: d.withColumn("kind", F.lit(kind))
    high = cells.orderBy(F.desc("cancel_rate"), a, b).limit(k)
    low = cells.orderBy("cancel_rate", a, b).limit(k)
    return label(high, "highest").unionByName(label(low, "lowest"))


def crosstab(df: DataFrame, rows: str, cols: str, domain: Sequence[str], value: str = Y
             ) -> DataFrame:
    """Counts and mean outcome of every combination, as columns per value."""
    return df.groupBy(rows).pivot(cols, list(domain)).agg(
        F.count(F.lit(1)).alias("n"), F.avg(value).alias("rate"))


def value_counts(df: DataFrame, col: str, domain: Sequence[str] | None = None) -> DataFrame:
    """Count and share per value; values of the domain without rows appear as 0."""
    counts = df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    if domain is not None:
        wanted = df.sparkSession.createDataFrame([(v,) for v in domain], f"{col} string")
        counts = wanted.join(counts, col, "left").fillna({"n": 0})
    return counts.withColumn("share", F.try_divide(F.col("n"), total))


def band(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Right-closed bands (edges[i], edges[i+1]]; outside values become null."""
    out = F
    for lo, hi, label in zip(edges, edges[1:], labels):
        out = out.when((value > lo) & (value <= hi), label)
    return out


def lead_time_bands(df: DataFrame, edges: Sequence[float], labels: Sequence[str], t: float
                    ) -> DataFrame:
    flagged = F.col(P) >= t
    rows = df.withColumn("lead_band", band(F.col("lead_time"), edges, labels))
    return rows.filter("lead_band IS NOT NULL").groupBy("lead_band").agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"),
        F.avg(P).alias("mean_probability"),
        F.coalesce(F.try_divide(F.count_if(flagged & (F.col(Y) == 1)), F.count_if(flagged)),
                   F.lit(0.0)).alias("precision"),
        F.avg("revenue_at_risk").alias("mean_revenue"))


def top_countries(df: DataFrame, k: int = 15, min_rows: int = 50) -> DataFrame:
    """Leading countries by revenue and by rate."""
    base = df.groupBy("country").agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"),
        F.sum("revenue_at_risk").alias("revenue")).filter(F.col("n") >= min_rows)
    lead = lambda c: base.orderBy(F.desc(c), "country").limit(k).withColumn("ranked_by", F.lit(c))
    return lead("revenue").unionByName(lead("cancel_rate"))


def tier_profile(df: DataFrame, tier: Column, features: Sequence[str], domain: Sequence[str]
                 ) -> DataFrame:
    """Mean features per tier, one row per feature and a column per tier."""
    means = df.groupBy(tier.alias("_tier")).agg(*[F.avg(f).alias(f) for f in features])
    long = unpivot(means, features, ["_tier"], ("feature", "mean"), "double")
    return long.groupBy("feature").pivot("_tier", list(domain)).agg(F.max("mean"))


def revenue_quantiles(df: DataFrame, by: str = "risk_tier", value: str = "revenue_at_risk"
                      ) -> DataFrame:
    quartiles = quantile_columns(df, value, {"p25": 0.25, "p50": 0.5, "p75": 0.75}, [by])
    return df.groupBy(by).agg(F.avg(value).alias("mean")).join(quartiles, by)


def segment_rank(metrics: DataFrame, metric: str = "roc_auc") -> DataFrame:
    """Gated segments ranked inside their dimension (at most a few dozen per dimension)."""
    w = Window.partitionBy("dimension").orderBy(F.desc(metric), "segment")
    return metrics.filter("gated").select(
        "dimension", "segment", "n_rows", metric,
        F.row_number().over(w).cast("bigint").alias("rank"))


def segment_prf(df: DataFrame, dim: str, t: float) -> DataFrame:
    """Precision, recall and F1 per value; null without flags or positives."""
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.groupBy(dim).agg(*confusion_aggs(t)).withColumns({
        "precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn),
        "f1": F.when((tp + fp > 0) & (tp + fn > 0), 2 * tp / (2 * tp + fp + fn)),
    })


def action_list(df: DataFrame, t: float, keys: Sequence[str], k: int = 50) -> DataFrame:
    flagged = df.filter((F.col(P) >= t) & F.col("revenue_at_risk").isNotNull())
    return flagged.orderBy(F.desc("revenue_at_risk"), *keys).limit(k).select(
        *keys, "arrival_date", "lead_time", P, "revenue_at_risk")


def flagged_lead_time(df: DataFrame, t: float) -> DataFrame:
    flagged = F.col(P) >= t
    return df.agg(F.count_if(flagged).alias("flagged"),
                  F.avg(F.when(flagged, F.col("lead_time"))).alias("mean_lead"))


def price_ladder(df: DataFrame, dim: str = "reserved_room_type", min_rows: int = 50) -> DataFrame:
    """Room types by median rate: the first three premium, the next three mid, then standard."""
    base = df.groupBy(dim).agg(F.count("adr").alias("n"), F.avg("adr").alias("mean_adr"),
                               F.avg(Y).alias("cancel_rate"))
    ladder = base.filter(F.col("n") >= min_rows).join(
        quantile_columns(df, "adr", {"median_adr": 0.5}, [dim]), dim)
    place = F.row_number().over(Window.orderBy(F.desc("median_adr"), dim))
    return ladder.withColumn("place", place.cast("bigint")).withColumn(
        "price_tier", F.when(F.col("place") <= 3, "premium").when(F.col("place") <= 6, "mid")
        .otherwise("standard"))


def price_matrix(df: DataFrame, months: Sequence[str]) -> DataFrame:
    return df.groupBy("hotel").pivot("arrival_date_month", list(months)).agg(F.avg("adr"))


def price_extremes(df: DataFrame) -> DataFrame:
    """The dearest and the cheapest (hotel, month) cell."""
    cells = df.groupBy("hotel", "arrival_date_month").agg(F.avg("adr").alias("mean_adr"))
    key = F.struct("mean_adr", "hotel", "arrival_date_month")
    best = cells.agg(F.max(key).alias("peak"), F.min(key).alias("trough"))
    return best.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("cell"), F.col(f"{n}.hotel").alias("hotel"),
                 F.col(f"{n}.arrival_date_month").alias("arrival_date_month"),
                 F.col(f"{n}.mean_adr").alias("mean_adr")) for n in ("peak", "trough")])))


def box_stats(df: DataFrame, by: str, value: str) -> DataFrame:
    """Quartiles, whiskers at the last values within 1.5 IQR, and outliers, by group."""
    box = quantile_columns(df, value, {"q1": 0.25, "median": 0.5, "q3": 0.75}, [by])
    v, reach = F.col(value), 1.5 * (F.col("q3") - F.col("q1"))
    inside = v.between(F.col("q1") - reach, F.col("q3") + reach)
    return df.filter(v.isNotNull()).join(box, by).groupBy(by, "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.when(inside, v)).alias("whisker_low"),
        F.max(F.when(inside, v)).alias("whisker_high"), F.count_if(~inside).alias("n_outliers"))
