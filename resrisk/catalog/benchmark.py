"""Queries of the benchmark report, on the two stand-in scores."""

from __future__ import annotations

from ..ml import models
from ..operators import benchmark, splits
from ..operators.metrics import P, Y
from ..session import written_table
from ..sources.star_schema import KEYS, scored
from .base import BALANCED_SQL, PRF_SQL, auc_sql, confusion_sql, register, with_ctes
from .evaluation import DAY, SPLIT, sweep_sql, cost_sql

MODELS = [P, "rival_probability"]
# Every model and part of the report; p is the model's score.
LONG = ("long AS (" + " UNION ALL ".join(
    f"SELECT '{m}' AS model, {m} AS p, is_canceled, fn_cost, lead_time, split, position FROM split_scored"
    for m in MODELS) + ")")
SIZES = """
sizes AS (SELECT count(*) FILTER (split <> 'test') AS n, count(*) FILTER (split = 'test') AS m FROM split_scored),
windows AS (SELECT f, CAST(floor(n * f) AS BIGINT) AS a, CAST(floor(n * f) AS BIGINT)
    + greatest(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), 500) AS b, n
  FROM sizes, (VALUES (0.6::DOUBLE), (0.7::DOUBLE), (0.8::DOUBLE)) AS v(f))"""
PARTS = """
parted AS (
  SELECT model, split AS part, p, is_canceled, fn_cost, lead_time FROM long WHERE split <> 'train'
  UNION ALL SELECT model, 'fold ' || printf('%.2f', f), p, is_canceled, fn_cost, lead_time
    FROM long JOIN windows ON position >= a AND position < b AND b <= n AND a >= 1500
  UNION ALL SELECT model, 'bucket ' || CASE WHEN position - n < (m % 6) * (m // 6 + 1)
      THEN (position - n) // (m // 6 + 1) + 1 ELSE m % 6 + (position - n - (m % 6) * (m // 6 + 1)) // (m // 6) + 1 END,
    p, is_canceled, fn_cost, lead_time FROM long, sizes WHERE split = 'test')"""
GRID = "grid AS (SELECT round(k / 100.0::DOUBLE, 4) AS threshold FROM range(100) AS r(k))"
VAL = "valid AS (SELECT model, p AS cancel_probability, is_canceled, fn_cost FROM parted WHERE part = 'val')"
PICK = """
chosen AS (
  SELECT model, 0.5::DOUBLE AS "default", max_f1, high_precision, cost_sensitive, constraint_met FROM
    (SELECT model, threshold AS max_f1 FROM sweep QUALIFY row_number() OVER (PARTITION BY model ORDER BY f1 DESC, threshold) = 1)
    JOIN (SELECT model, threshold AS high_precision,
        bool_or(positive_rate >= 0.05 AND recall >= 0.2) OVER (PARTITION BY model) AS constraint_met FROM sweep
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY CASE WHEN positive_rate >= 0.05 AND recall >= 0.2 THEN 0
        WHEN recall >= 0.2 THEN 1 ELSE 2 END, precision DESC, recall DESC, threshold) = 1) USING (model)
    JOIN (SELECT model, threshold AS cost_sensitive FROM costs
      QUALIFY row_number() OVER (PARTITION BY model ORDER BY total_cost, threshold) = 1) USING (model)),
policies AS (UNPIVOT chosen ON "default", max_f1, high_precision, cost_sensitive INTO NAME policy VALUE threshold),
judged AS (SELECT model, part, policy, threshold, """ + confusion_sql("threshold", p="p") + """,
    COALESCE(sum(fn_cost) FILTER (p < threshold AND is_canceled = 1), 0) AS missed,
    """ + ", ".join(f"count(*) FILTER (lead_time <= 3 AND p {c} threshold AND is_canceled = {y}) AS {n}_late"
                    for n, c, y in (("tn", "<", 0), ("fp", ">=", 0), ("fn", "<", 1), ("tp", ">=", 1))) + """
  FROM parted JOIN policies USING (model) GROUP BY ALL)"""
BASE = (SPLIT, LONG, SIZES, PARTS)
AUCS = (*BASE, auc_sql("parted", "model, part", p="p"))
CHOSEN = (*AUCS, GRID, VAL, sweep_sql(source="valid", by="model"), cost_sql(source="valid", by="model"), PICK)


def _rows(spark, sf):
    """The columns of the report with their split, written once: the cuts and the counts read them, not the joins."""
    names = [DAY, *KEYS, *MODELS, Y, "fn_cost", "lead_time"]
    return splits.time_split(written_table(scored(spark, sf).select(*names), "benchmark-rows"), DAY, KEYS)


def _cube(spark, sf, rows=None):
    return benchmark.benchmark_cube(_rows(spark, sf) if rows is None else rows, MODELS, DAY, KEYS)


def _confusion(spark, sf):
    cube = _cube(spark, sf)
    return cube, benchmark.policy_confusion(cube, benchmark.chosen_thresholds(cube))


PROBABILITY = """
probability AS (SELECT model, n, n_pos, roc_auc, pr_auc, brier, log_loss, ece FROM
  (SELECT model, count(*) AS n, sum(is_canceled)::BIGINT AS n_pos, avg((p - is_canceled) ** 2) AS brier,
    -avg(CASE WHEN is_canceled = 1 THEN ln(greatest(least(p, 1 - 1e-15), 1e-15))
      ELSE ln(1 - greatest(least(p, 1 - 1e-15), 1e-15)) END) AS log_loss
   FROM parted WHERE part = 'test' GROUP BY 1)
  JOIN (SELECT * FROM aucs WHERE part = 'test') USING (model)
  JOIN (SELECT model, sum(gap) / sum(n) AS ece FROM (SELECT model, least(floor(round(p * 10000) / 1000), 9) AS bin,
      count(*) AS n, abs(sum(is_canceled) - sum(p)) AS gap FROM parted WHERE part = 'test' GROUP BY 1, 2) GROUP BY 1)
  USING (model))"""
RATES = "roc_auc pr_auc brier log_loss ece"
register("m8_03_probability_metrics", lambda spark, sf: benchmark.probability_metrics(_cube(spark, sf)),
         with_ctes(*AUCS, PROBABILITY, body="SELECT * FROM probability"), dbl=RATES)
register("m8_16_rankings", lambda spark, sf: benchmark.rankings(benchmark.probability_metrics(_cube(spark, sf))),
         with_ctes(*AUCS, PROBABILITY, body="""
SELECT *, CAST(row_number() OVER (ORDER BY pr_auc DESC, roc_auc DESC, model) AS INTEGER) AS rank FROM probability"""), dbl=RATES)
register("m8_07_thresholds_per_model", lambda spark, sf: benchmark.chosen_thresholds(_cube(spark, sf)),
         with_ctes(*CHOSEN, body="SELECT * FROM chosen"))
register("m8_04_06_threshold_metrics", lambda spark, sf: benchmark.threshold_tables(*_confusion(spark, sf)),
         with_ctes(*CHOSEN, body=f"""
SELECT model, policy, threshold, {PRF_SQL}, {BALANCED_SQL}, roc_auc, pr_auc FROM judged JOIN aucs USING (model, part)
WHERE part = 'test'"""), dbl="precision recall f1 balanced_accuracy roc_auc pr_auc")
register("m8_08_09_confusion", lambda spark, sf: benchmark.confusion_tables(_confusion(spark, sf)[1]),
         with_ctes(*CHOSEN, body="""
SELECT model, policy, tn, fp, fn, tp, tp / (tp + fn) AS tpr, tn / (tn + fp) AS tnr, fp / (tn + fp) AS fpr, fn / (tp + fn) AS fnr
FROM judged WHERE part = 'test' AND policy = 'max_f1'"""), dbl="tpr tnr fpr fnr")
FOLDS = """
folds AS (SELECT model, part[6:] AS fold, n, n_pos, roc_auc, pr_auc FROM aucs JOIN (
  SELECT model, part, count(*) AS n, sum(is_canceled)::BIGINT AS n_pos FROM parted GROUP BY 1, 2) USING (model, part)
  WHERE part LIKE 'fold %')"""
register("m8_10_fold_metrics", lambda spark, sf: benchmark.fold_metrics(_cube(spark, sf)),
         with_ctes(*AUCS, FOLDS, body="SELECT * FROM folds"), dbl="roc_auc pr_auc")
STATS = [f"{m}_{s}" for m in ("roc_auc", "pr_auc") for s in ("mean", "std", "min", "max")]
register("m8_11_fold_summary", lambda spark, sf: benchmark.fold_table(benchmark.fold_metrics(_cube(spark, sf))),
         with_ctes(*AUCS, FOLDS, body="SELECT model, count(*) AS folds, " + ", ".join(
             f"{f}({m}) AS {m}_{s}" for m in ("roc_auc", "pr_auc")
             for s, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max")))
             + " FROM folds GROUP BY 1"), dbl=" ".join(STATS))


def _stability(spark, sf):
    cube = _cube(spark, sf)
    return benchmark.stability(cube, benchmark.chosen_thresholds(cube))


register("m8_12_stability", _stability, with_ctes(*CHOSEN, body="""
SELECT model, CAST(part[8:] AS BIGINT) AS bucket, tn + fp + fn + tp AS n, (tp + fn) / (tn + fp + fn + tp) AS cancel_rate,
  roc_auc, pr_auc, 2 * tp / (2 * tp + fp + fn) AS f1
FROM judged JOIN aucs USING (model, part) WHERE part LIKE 'bucket %' AND policy = 'max_f1'"""),
         dbl="cancel_rate roc_auc pr_auc f1")
register("m8_15_cost", lambda spark, sf: benchmark.cost_table(_confusion(spark, sf)[1]),
         with_ctes(*CHOSEN, body="""
SELECT model, policy, threshold, 15::DOUBLE * fp + missed AS total_cost,
  COALESCE(2 * tp_late / NULLIF(2 * tp_late + fp_late + fn_late, 0), 0) AS late_f1,
  COALESCE(tp_late / NULLIF(tp_late + fn_late, 0), 0) AS late_recall
FROM judged WHERE part = 'test' AND policy IN ('cost_sensitive', 'default')"""), dbl="late_f1 late_recall", money="total_cost")


def _drawn(rows):
    return models.bootstrap_aucs(rows.filter("split = 'test'"), MODELS)


def _significance(spark, sf):
    rows = _rows(spark, sf)
    champion = benchmark.rankings(benchmark.probability_metrics(_cube(spark, sf, rows))).filter("rank = 1").first()["model"]
    return models.paired_delta(_drawn(rows), champion)


register("m8_13_intervals", lambda spark, sf: models.bootstrap_ci(_drawn(_rows(spark, sf))))
register("m8_14_significance", _significance)
