"""Threshold sweeps and policies.

A sweep needs one pass: every row is counted once under the highest grid threshold it reaches,
and totals per threshold are reverse running sums over at most ``steps`` rows per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from .metrics import P, Y, confusion_aggs, prf_columns, ratio0


def threshold_grid(spark: SparkSession, steps: int = 100) -> DataFrame:
    return spark.range(steps).select(F.round(F.col("id") / steps, 4).alias("threshold"))


def reached(p: Column, steps: int) -> Column:
    """Index of the highest grid threshold k / steps not above p, or -1."""
    b = F.floor(p * steps)
    b = F.when((b + 1) / steps <= p, b + 1).when(b / steps > p, b - 1).otherwise(b)
    return F.greatest(F.least(b, F.lit(steps - 1)), F.lit(-1)).cast("int")


def sweep_totals(df: DataFrame, sums: dict[str, Column], steps: int, by: Sequence[str],
                 keep_unscored: bool = False) -> DataFrame:
    """For each group and k: totals of rows reaching threshold k, and group totals ``all_*``.

    Rows without a score count nowhere, or with ``keep_unscored`` in the total of ``n`` alone.
    """
    by = list(by)
    scored = F.col(P).isNotNull()
    if keep_unscored:
        rows, k = df, F.coalesce(reached(F.col(P), steps), F.lit(-1))
        sums = {n: c if n == "n" else F.when(scored, c).otherwise(F.lit(0)) for n, c in sums.items()}
    else:
        rows, k = df.filter(scored), reached(F.col(P), steps)
    counts = rows.groupBy(*by, k.alias("k")).agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    # A zero row per group and grid point, so that thresholds without rows appear as well.
    groups = counts.select(*by).distinct() if by else counts.limit(1).select(F.lit(1).alias("_one"))
    zeros = groups.select(
        *by, F.explode(F.sequence(F.lit(-1), F.lit(steps - 1))).alias("k"),
        *[F.lit(0).cast(counts.schema[n].dataType).alias(n) for n in sums])
    filled = counts.unionByName(zeros).groupBy(*by, "k").agg(*[F.sum(n).alias(n) for n in sums])
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    up = part.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(
        *by, "k", *[F.sum(n).over(up).alias(n) for n in sums],
        *[F.sum(n).over(part).alias(f"all_{n}") for n in sums],
    ).filter("k >= 0").withColumn("threshold", F.round(F.col("k") / steps, 4))


def threshold_sweep(df: DataFrame, steps: int = 100, by: Sequence[str] = ()) -> DataFrame:
    ones = {"pos": (F.col(Y) == 1).cast("bigint"), "neg": (F.col(Y) == 0).cast("bigint")}
    return sweep_columns(sweep_totals(df, ones, steps, by), by)


def sweep_columns(totals: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Metrics of each grid threshold from ``sweep_totals`` of pos and neg."""
    tp, fp = F.col("pos"), F.col("neg")
    return totals.select(
        *by, "threshold", ratio0(tp, tp + fp).alias("precision"),
        ratio0(tp, F.col("all_pos")).alias("recall"),
        ratio0(2 * tp, tp + fp + F.col("all_pos")).alias("f1"),
        ratio0(tp + fp, F.col("all_pos") + F.col("all_neg")).alias("positive_rate"))


def cost_sweep(df: DataFrame, cost: str = "fn_cost", fp_cost: float = C.FP_COST, steps: int = 100,
               by: Sequence[str] = ()) -> DataFrame:
    positive = F.col(Y) == 1
    sums = {
        "pos": positive.cast("bigint"), "neg": (F.col(Y) == 0).cast("bigint"),
        "saved": F.when(positive, F.coalesce(F.col(cost), F.lit(0.0))).otherwise(0.0),
    }
    return cost_columns(sweep_totals(df, sums, steps, by), by, fp_cost)


def cost_columns(totals: DataFrame, by: Sequence[str] = (), fp_cost: float = C.FP_COST) -> DataFrame:
    """Money at each grid threshold from ``sweep_totals`` of pos, neg and saved."""
    fp = F.col("neg") * F.lit(float(fp_cost))
    fn = F.col("all_saved") - F.col("saved")
    return totals.select(
        *by, "threshold", F.col("neg").alias("fp_count"),
        (F.col("all_pos") - F.col("pos")).alias("fn_count"), fp.alias("fp_cost_total"),
        fn.alias("fn_cost_total"), (fp + fn).alias("total_cost"),
        F.col("all_saved").alias("no_model_cost"))


def _first_per(df: DataFrame, by: Sequence[str], *order: Column) -> DataFrame:
    w = (Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def _or_default(best: DataFrame, by: Sequence[str], values: dict) -> DataFrame:
    """The selected row, or a row of defaults when the sweep had none."""
    if by:
        return best
    spare = best.sparkSession.range(1).select(F.lit(1).alias("_one"))
    out = spare.join(best.withColumn("_one", F.lit(1)), "_one", "left").drop("_one")
    return out.withColumns({
        c: F.coalesce(F.col(c), F.lit(values.get(c, 0)).cast(best.schema[c].dataType))
        for c in best.columns
    })


def select_max_f1(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    best = _first_per(sweep.filter(F.col("f1").isNotNull()), by, F.desc("f1"), F.asc("threshold"))
    return _or_default(best, by, {"threshold": C.DEFAULT_THRESHOLD})


def select_min_cost(sweep: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    best = _first_per(sweep, by, F.asc("total_cost"), F.asc("threshold"))
    return _or_default(best, by, {"threshold": C.DEFAULT_THRESHOLD})


def select_high_precision(sweep: DataFrame, by: Sequence[str] = (),
                          min_positive_rate: float = C.MIN_POSITIVE_RATE,
                          min_recall: float = C.MIN_RECALL) -> DataFrame:
    """Best precision under both floors, else under the recall floor, else at all."""
    rate_ok = F.col("positive_rate") >= min_positive_rate
    recall_ok = F.col("recall") >= min_recall
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    flagged = sweep.withColumns({
        "constraint_met": F.bool_or(rate_ok & recall_ok).over(part),
        "positive_rate_constraint_met": F.bool_or(rate_ok).over(part),
        "recall_constraint_met": F.bool_or(recall_ok).over(part),
        "min_positive_rate": F.lit(min_positive_rate), "min_recall": F.lit(min_recall),
    })
    place = F.when(rate_ok & recall_ok, 0).when(recall_ok, 1).otherwise(2)
    best = _first_per(flagged, by, place, F.desc("precision"), F.desc("recall"),
                      F.asc("threshold"))
    return _or_default(best, by, {
        "threshold": C.DEFAULT_THRESHOLD, "constraint_met": False,
        "positive_rate_constraint_met": False, "recall_constraint_met": False,
        "min_positive_rate": min_positive_rate, "min_recall": min_recall})


def clamp_threshold(raw: Column) -> Column:
    """Numeric text to [0, 1]; anything else (true / false included) becomes null."""
    number = F.nanvl(raw.try_cast("double"), F.lit(None).cast("double"))
    return F.when(number.isNotNull(), F.least(F.greatest(number, F.lit(0.0)), F.lit(1.0)))


def resolve_thresholds(df: DataFrame) -> DataFrame:
    """Usable thresholds from stored text values, with source, fallback flag and alerts."""
    pick = lambda c: clamp_threshold(F.col(c).cast("string"))
    f1 = F.coalesce(pick("max_f1"), F.lit(C.DEFAULT_THRESHOLD))
    missing = pick("cost_sensitive").isNull()
    others = [c for c in df.columns if c not in ("high_precision", "max_f1", "cost_sensitive")]
    return df.select(
        *others,
        F.coalesce(pick("high_precision"), F.lit(C.DEFAULT_THRESHOLD)).alias("high_precision"),
        f1.alias("max_f1"), F.coalesce(pick("cost_sensitive"), f1).alias("cost_sensitive"),
        F.when(missing, "max_f1_fallback").otherwise("artifact").alias("cost_source"),
        missing.alias("cost_fallback_used"),
        F.when(missing, "cost_sensitive threshold missing; using max_f1 fallback.").alias("alert"))


def policy_flags(df: DataFrame, policies: dict[str, float], prefix: str = "predicted_cancel_"
                 ) -> DataFrame:
    return df.withColumns({
        f"{prefix}{name}": (F.col(P) >= F.lit(float(t))).cast("int")
        for name, t in policies.items()
    })


def policy_comparison(df: DataFrame, policies: dict[str, float], fp_cost: float = C.FP_COST,
                      value: str = "revenue_at_risk") -> DataFrame:
    """Confusion, revenue saved and money spent or lost, per policy in one pass."""
    p, y = F.col(P), F.col(Y)
    money = lambda cond: F.coalesce(F.sum(F.when(cond, F.col(value))), F.lit(0.0))
    facts = df.agg(*[
        F.struct(F.lit(n).alias("policy"), F.lit(float(t)).alias("threshold"), *confusion_aggs(t),
                 money((p >= t) & (y == 1)).alias("revenue_saved"),
                 money((p < t) & (y == 1)).alias("fn_loss")).alias(n)
        for n, t in policies.items()
    ])
    rows = facts.select(F.inline(F.array(*policies)))
    spend = F.col("fp") * F.lit(float(fp_cost))
    return rows.withColumns({
        **{k: v for k, v in prf_columns().items() if k != "balanced_accuracy"},
        "flagged": F.col("tp") + F.col("fp"), "fp_spend": spend,
        "net_benefit": F.col("revenue_saved") - spend - F.col("fn_loss"),
    })


def what_if(df: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """Metrics at an arbitrary list of thresholds; any number of them costs one pass.

    The list (a slider's values) is sorted into an array literal; each row is counted under the
    number of listed thresholds it reaches.
    """
    ts = sorted({float(t) for t in thresholds})
    listed = F.array(*[F.lit(t) for t in ts])
    k = F.size(F.filter(listed, lambda t: t <= F.col(P)))
    counts = df.filter(F.col(P).isNotNull()).groupBy(k.alias("k")).agg(
        F.count_if(F.col(Y) == 1).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg"))
    at_least = lambda c, i: F.coalesce(F.sum(F.when(F.col("k") > i, F.col(c))), F.lit(0))
    below = lambda c, i: F.coalesce(F.sum(F.when(F.col("k") <= i, F.col(c))), F.lit(0))
    facts = counts.agg(*[
        F.struct(F.lit(t).alias("threshold"), below("neg", i).alias("tn"),
                 at_least("neg", i).alias("fp"), below("pos", i).alias("fn"),
                 at_least("pos", i).alias("tp")).alias(f"t{i}")
        for i, t in enumerate(ts)
    ])
    return facts.select(F.inline(F.array(*[f"t{i}" for i in range(len(ts))]))).withColumns(
        prf_columns())


def segment_thresholds(df: DataFrame, segments: DataFrame, global_f1: float, global_cost: float,
                       min_rows: int = C.SEGMENT_MIN_ROWS, fp_cost: float = C.FP_COST,
                       steps: int = 100, cost: str = "revenue_at_risk") -> DataFrame:
    """Own best thresholds of each (dimension, segment) against the global ones.

    ``segments`` is the long table with one row per booking and dimension. All segments are swept
    by one aggregate, whose few rows per segment give size, best thresholds and global values.
    """
    by = ["dimension", "segment"]
    positive = F.col(Y) == 1
    totals = sweep_totals(segments, {
        "pos": positive.cast("bigint"), "neg": (F.col(Y) == 0).cast("bigint"),
        "saved": F.when(positive, F.coalesce(F.col(cost), F.lit(0.0))).otherwise(0.0),
        "scored": F.lit(1).cast("bigint"), "n": F.lit(1).cast("bigint"),
    }, steps, by, keep_unscored=True)
    t, tp, fp = F.col("threshold"), F.col("pos"), F.col("neg")
    f1 = ratio0(2 * tp, tp + fp + F.col("all_pos"))
    price = fp * F.lit(float(fp_cost)) + (F.col("all_saved") - F.col("saved"))
    # Ties go to the smaller threshold.
    best = lambda c, sign: F.min_by(F.struct("threshold", c), F.struct(sign * F.col(c), t))
    at = lambda c, wanted: F.max(F.when(t == F.lit(wanted), F.col(c)))
    rows = totals.withColumns({"_f1": f1, "_price": price}).groupBy(*by).agg(
        F.max("all_n").alias("n"), best("_f1", -1).alias("_best"), best("_price", 1).alias("_cheap"),
        at("_f1", global_f1).alias("f1_at_global"), at("_price", global_cost).alias("cost_at_global"),
        F.max("all_scored").alias("_scored"))
    # A segment without a score, or a global threshold off the grid, has nothing to compare.
    comparable = (F.col("_scored") > 0) & F.col("f1_at_global").isNotNull() & F.col("cost_at_global").isNotNull()
    return (
        rows.filter((F.col("n") >= min_rows) & comparable)
        .select(*by, "n", F.col("_best.threshold").alias("thr_max_f1"), F.col("_best._f1").alias("best_f1"),
                F.col("_cheap.threshold").alias("thr_cost"), F.col("_cheap._price").alias("best_cost"),
                "f1_at_global", "cost_at_global")
        .withColumns({
            "delta_f1_threshold": F.col("thr_max_f1") - global_f1,
            "delta_cost_threshold": F.col("thr_cost") - global_cost,
            "f1_gain": F.col("best_f1") - F.col("f1_at_global"),
            "cost_saving": F.col("cost_at_global") - F.col("best_cost"),
        })
    )
