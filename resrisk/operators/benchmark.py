"""The benchmark report of several models' scores: all tables are grouped from one table of counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import written_table
from . import splits, thresholds
from .metrics import P, Y, auc_columns, descending_totals, prf_columns, rate_columns, uniform_bin
from .ordering import bucket_starts, unpivot

#: Policies of the report, in the order of its tables.
POLICIES = ["default", "max_f1", "high_precision", "cost_sensitive"]


def _parts(rows: DataFrame, day: str, keys: Sequence[str], split: str, buckets: int) -> DataFrame:
    """`rows` with `part`, once for each part of the report that a row belongs to.

    Parts are the validation and test rows, the time buckets of the test rows and the evaluation
    windows of the rolling folds over all rows before them. A row has few, and training rows that
    are in no window have none.
    """
    test, before = F.col(split) == "test", F.col(split) != "test"
    later = splits.CutKeys(rows.filter(test), day, keys, lambda n: bucket_starts(n, buckets))
    cuts, folds = splits.fold_cuts(rows.filter(before), day, keys, splits.rolling_folds)
    bucket = later.label(bucket_starts(later.n, buckets))
    names = [F.when(F.col(split) == "val", "val"), F.when(test, "test"),
             F.when(test, F.concat(F.lit("bucket "), bucket.cast("string")))]
    names += [F.when(before & cuts.within(f.test_start, f.test_end), f"fold {f.name}") for f in folds]
    return rows.withColumn("part", F.explode(F.array_compact(F.array(*names))))


def benchmark_cube(rows: DataFrame, models: Sequence[str], day: str, keys: Sequence[str], split: str = "split",
                   buckets: int = 6, cost: str = "fn_cost") -> DataFrame:
    """(model, part, late, score) with positives, negatives and the cost of the positives; written once.

    `models` are columns of scores. A hot score is one row after the map-side combine, and no table
    of the report reads the rows again.
    """
    kept = _parts(rows, day, keys, split, buckets)
    late = F.coalesce(F.col("lead_time") <= C.LATE_WINDOW_DAYS, F.lit(False))
    long = unpivot(kept.withColumn("late", late), models, ["part", "late", Y, cost], ("model", "score"), "double")
    positive = F.col(Y) == 1
    return written_table(long.filter("score IS NOT NULL").groupBy("model", "part", "late", "score").agg(
        F.count_if(positive).alias("pos"), F.count_if(F.col(Y) == 0).alias("neg"),
        F.sum(F.when(positive, F.coalesce(F.col(cost), F.lit(0.0))).otherwise(0.0)).alias("saved")), "benchmark-cube")


def _scores(cube: DataFrame, parts: str) -> DataFrame:
    return cube.filter(F.col("part").rlike(parts)).groupBy("model", "part", "score").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))


def part_aucs(cube: DataFrame, parts: str) -> DataFrame:
    """Sizes and both AUCs per model and part; `parts` is a pattern."""
    by = ["model", "part"]
    totals = descending_totals(_scores(cube, parts), by)
    return totals.groupBy(*by).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_pos"), *auc_columns())


def probability_metrics(cube: DataFrame) -> DataFrame:
    """03: AUCs, Brier score, log loss and calibration error on the test rows."""
    rows = _scores(cube, "^test$")
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    q = F.least(F.greatest(s, F.lit(1e-15)), F.lit(1 - 1e-15))
    of = rows.groupBy("model").agg(
        (F.sum(pos * F.pow(s - 1, 2) + neg * s * s) / F.sum(pos + neg)).alias("brier"),
        (-F.sum(pos * F.log(q) + neg * F.log(1 - q)) / F.sum(pos + neg)).alias("log_loss"))
    bins = rows.groupBy("model", uniform_bin(s, 10).alias("bin")).agg(
        F.sum(pos + neg).alias("_n"), F.abs(F.sum(pos) - F.sum(s * (pos + neg))).alias("_gap"))
    gaps = bins.groupBy("model").agg((F.sum("_gap") / F.sum("_n")).alias("ece"))
    return part_aucs(cube, "^test$").drop("part").join(of, "model").join(gaps, "model")


def chosen_thresholds(cube: DataFrame) -> DataFrame:
    """07: the threshold of each policy per model, chosen on the validation rows."""
    rows = cube.filter("part = 'val'").withColumn(P, F.col("score"))
    counts = {"pos": F.col("pos"), "neg": F.col("neg")}
    sweep = thresholds.sweep_columns(thresholds.sweep_totals(rows, counts, 100, ["model"]), ["model"])
    priced = thresholds.cost_columns(thresholds.sweep_totals(rows, {**counts, "saved": F.col("saved")}, 100, ["model"]), ["model"])
    precise = thresholds.select_high_precision(sweep, ["model"])
    return thresholds.select_max_f1(sweep, ["model"]).select("model", F.col("threshold").alias("max_f1")).join(
        precise.select("model", F.col("threshold").alias("high_precision"), "constraint_met"), "model").join(
        thresholds.select_min_cost(priced, ["model"]).select("model", F.col("threshold").alias("cost_sensitive")), "model").select(
        "model", F.lit(C.DEFAULT_THRESHOLD).alias("default"), "max_f1", "high_precision", "cost_sensitive", "constraint_met")


def policy_confusion(cube: DataFrame, chosen: DataFrame, parts: str = "^test$") -> DataFrame:
    """08: confusion counts per model, part and policy, with the money of both errors."""
    long = unpivot(chosen, POLICIES, ["model"], ("policy", "threshold"), "double")
    rows = cube.filter(F.col("part").rlike(parts)).join(F.broadcast(long), "model")
    hit = F.col("score") >= F.col("threshold")
    total = lambda keep, c: F.sum(F.when(keep, F.col(c)).otherwise(0))
    sums = []
    for suffix, some in (("", F.lit(True)), ("_late", F.col("late"))):
        sums += [total(some & ~hit, "neg").alias(f"tn{suffix}"), total(some & hit, "neg").alias(f"fp{suffix}"),
                 total(some & ~hit, "pos").alias(f"fn{suffix}"), total(some & hit, "pos").alias(f"tp{suffix}")]
    return rows.groupBy("model", "part", "policy", "threshold").agg(
        *sums, F.sum(F.when(~hit, F.col("saved")).otherwise(0.0)).alias("missed"))


def threshold_tables(cube: DataFrame, confusion: DataFrame) -> DataFrame:
    """04, 05, 06: metrics at the policies' thresholds with the model's AUCs."""
    aucs = part_aucs(cube, "^test$").select("model", "roc_auc", "pr_auc")
    return confusion.filter("part = 'test'").withColumns(prf_columns()).join(aucs, "model").select(
        "model", "policy", "threshold", "precision", "recall", "f1", "balanced_accuracy", "roc_auc", "pr_auc")


def confusion_tables(confusion: DataFrame, policy: str = "max_f1") -> DataFrame:
    """08, 09: counts and rates at one policy's threshold."""
    return confusion.filter((F.col("part") == "test") & (F.col("policy") == policy)).withColumns(rate_columns()).select(
        "model", "policy", "tn", "fp", "fn", "tp", "tpr", "tnr", "fpr", "fnr")


def fold_metrics(cube: DataFrame) -> DataFrame:
    """10: AUCs on the evaluation window of each rolling fold."""
    return part_aucs(cube, "^fold ").withColumn("fold", F.substring("part", 6, 100)).drop("part")


def fold_table(folds: DataFrame) -> DataFrame:
    """11: mean, deviation and range over the folds."""
    stats = [("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max)]
    return folds.groupBy("model").agg(F.count(F.lit(1)).alias("folds"), *[
        f(m).alias(f"{m}_{n}") for m in ("roc_auc", "pr_auc") for n, f in stats])


def stability(cube: DataFrame, chosen: DataFrame) -> DataFrame:
    """12: AUCs, rate and F1 at the model's own threshold per time bucket of the test rows."""
    f1 = policy_confusion(cube, chosen, "^bucket ").filter("policy = 'max_f1'").withColumns(prf_columns())
    return part_aucs(cube, "^bucket ").join(f1.select("model", "part", "f1"), ["model", "part"]).select(
        "model", F.substring("part", 8, 100).cast("bigint").alias("bucket"), "n",
        (F.col("n_pos") / F.col("n")).alias("cancel_rate"), "roc_auc", "pr_auc", "f1")


def cost_table(confusion: DataFrame, fp_cost: float = C.FP_COST) -> DataFrame:
    """15: money at the cost-sensitive and the default threshold, and the late window's metrics."""
    late = {n: F.col(f"{n}_late") for n in ("tn", "fp", "fn", "tp")}
    priced = confusion.filter((F.col("part") == "test") & F.col("policy").isin("cost_sensitive", "default")).withColumn(
        "total_cost", F.col("fp") * F.lit(float(fp_cost)) + F.col("missed"))
    of_late = priced.select("model", "policy", "threshold", "total_cost", *[c.alias(n) for n, c in late.items()])
    return of_late.withColumns(prf_columns()).select(
        "model", "policy", "threshold", "total_cost", F.col("f1").alias("late_f1"), F.col("recall").alias("late_recall"))


def rankings(probability: DataFrame) -> DataFrame:
    """16: models by PR-AUC, then ROC-AUC, then name (one row per model)."""
    order = Window.orderBy(F.desc("pr_auc"), F.desc("roc_auc"), "model")
    return probability.withColumn("rank", F.row_number().over(order))


def model_specs(sizes: dict[str, dict], spark) -> DataFrame:
    """02: what each family is fitted with."""
    import json

    return spark.createDataFrame(
        [(name, json.dumps(size, sort_keys=True)) for name, size in sorted(sizes.items())], "model string, params_json string"
    ).withColumns({"calibration": F.lit("isotonic on the validation rows"),
                   "threshold_default": F.lit(C.DEFAULT_THRESHOLD)})


def benchmark_tables(rows: DataFrame, models: Sequence[str], day: str, keys: Sequence[str], sizes: dict[str, dict],
                     replicates: int = C.BOOTSTRAP_REPLICATES) -> dict[str, DataFrame]:
    """All sixteen tables by name, for `sources.prediction_log.write_report`."""
    from ..ml.models import bootstrap_aucs, bootstrap_ci, paired_delta

    cube = benchmark_cube(rows, models, day, keys)
    chosen = chosen_thresholds(cube)
    confusion = policy_confusion(cube, chosen)
    probability, folds = probability_metrics(cube), fold_metrics(cube)
    at = lambda policy: threshold_tables(cube, confusion).filter(F.col("policy") == policy)
    champion = rankings(probability).filter("rank = 1").first()["model"]
    drawn = bootstrap_aucs(rows.filter("split = 'test'"), models, replicates)
    both = confusion_tables(confusion)
    return {
        "01_dataset_split_summary": splits.split_summary(rows, day), "02_model_specs": model_specs(sizes, rows.sparkSession),
        "03_holdout_probability_metrics": probability, "04_holdout_threshold_metrics_050": at("default"),
        "05_holdout_threshold_metrics_max_f1": at("max_f1"),
        "06_holdout_threshold_metrics_high_precision": at("high_precision"), "07_thresholds_per_model": chosen,
        "08_confusion_matrix_counts_per_model": both.drop("tpr", "tnr", "fpr", "fnr"),
        "09_confusion_matrix_rates_per_model": both.drop("tn", "fp", "fn", "tp"),
        "10_rolling_origin_fold_metrics": folds, "11_rolling_origin_summary": fold_table(folds),
        "12_temporal_stability_by_bucket": stability(cube, chosen), "13_bootstrap_confidence_intervals": bootstrap_ci(drawn),
        "14_paired_significance_vs_champion": paired_delta(drawn, champion), "15_training_inference_cost": cost_table(confusion),
        "16_rankings": rankings(probability)}
