"""Queries of the split, metric, threshold and cost operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rules
from ..operators import cost, metrics, ordering, splits, thresholds
from ..operators.metrics import P, Y
from ..sources.star_schema import KEYS, POLICIES, cleaned, scored
from .base import (
    BALANCED_SQL, CLEAN, ORDER_BY, POSITIONED, PRF_SQL, SCORED, auc_sql, confusion_sql,
    long_form, register, with_ctes,
)

DAY = "arrival_date"
KEY_SQL = ", ".join(KEYS)
POLICY_SQL = ("policies AS (SELECT * FROM (VALUES "
              + ", ".join(f"('{n}', {t}::DOUBLE)" for n, t in POLICIES.items())
              + ") AS v(policy, threshold))")
FOLD_SQL = """
SELECT fold, count(*) FILTER (position < train_end) AS n_train,
  count(*) FILTER (position >= test_start AND position < test_end) AS n_test,
  avg(is_canceled) FILTER (position < train_end) AS train_rate,
  avg(is_canceled) FILTER (position >= test_start AND position < test_end) AS test_rate,
  max(arrival_date) FILTER (position < train_end) AS train_end,
  min(arrival_date) FILTER (position >= test_start AND position < test_end) AS test_start,
  max(arrival_date) FILTER (position >= test_start AND position < test_end) AS test_end
FROM positioned, folds GROUP BY fold"""


def fold_query(name, folds, fold_sql, **kw):
    register(name, lambda spark, sf: splits.fold_summary(
        cleaned(spark, sf), DAY, KEYS, folds, **kw),
        with_ctes(POSITIONED, "sizes AS (SELECT max(n_all) AS n FROM positioned)",
                  f"folds AS ({fold_sql})", body=FOLD_SQL), dbl="train_rate test_rate")


def split_scored(spark, sf):
    return splits.time_split(scored(spark, sf), DAY, KEYS)


def test_rows(spark, sf):
    return splits.time_rows(scored(spark, sf), DAY, KEYS, "test")


SPLIT = POSITIONED + """,
split_scored AS (
  SELECT *, CASE WHEN position < CAST(floor(n_all * 0.8::DOUBLE) AS BIGINT) THEN 'train'
    WHEN position < CAST(floor(n_all * 0.8::DOUBLE) AS BIGINT)
      + CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT) THEN 'val' ELSE 'test' END AS split
  FROM positioned
), test AS (SELECT * FROM split_scored WHERE split = 'test')"""

register("d1_time_split",
         lambda spark, sf: split_scored(spark, sf).select(*KEYS, "split"),
         with_ctes(SPLIT, body=f"SELECT {KEY_SQL}, split FROM split_scored"))
register("d2_split_summary",
         lambda spark, sf: splits.split_summary(split_scored(spark, sf), DAY),
         with_ctes(SPLIT, body="""
SELECT split, count(*) AS n_rows, min(arrival_date) AS first_day, max(arrival_date) AS last_day,
  avg(is_canceled) AS target_rate, CAST(33 AS BIGINT) AS n_features
FROM split_scored GROUP BY 1"""), dbl="target_rate")
fold_query("d3_rolling_windows", splits.rolling_folds, """
SELECT f AS fold, e AS train_end, e AS test_start, e + size AS test_end FROM (
  SELECT f, CAST(floor(n * CAST(f AS DOUBLE)) AS BIGINT) AS e, n,
    greatest(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), 500) AS size
  FROM sizes, (VALUES ('0.60'), ('0.70'), ('0.80')) AS v(f))
WHERE e >= 1500 AND e + size <= n""")
fold_query("d4_wide_rolling", splits.wide_folds, """
SELECT f AS fold, e AS train_end, e AS test_start, least(n, e + size) AS test_end FROM (
  SELECT f, CAST(floor(n * CAST(f AS DOUBLE)) AS BIGINT) AS e, n,
    greatest(CAST(floor(n * 0.1::DOUBLE) AS BIGINT), 2000) AS size
  FROM sizes, (VALUES ('0.50'), ('0.58'), ('0.66'), ('0.74'), ('0.82')) AS v(f))
WHERE e >= 5000 AND least(n, e + size) - e >= 1000""")
fold_query("d5_expanding_folds", splits.expanding_folds, """
SELECT CAST(i AS VARCHAR) AS fold, n - (6 - i) * (n // 6) AS train_end,
  n - (6 - i) * (n // 6) AS test_start, n - (5 - i) * (n // 6) AS test_end
FROM sizes, range(1, 6) AS r(i)""")
fold_query("d6_cutoff_folds", splits.cutoff_folds, """
SELECT f AS fold, CAST(floor(n * a) AS BIGINT) AS train_end,
  CAST(floor(n * a) AS BIGINT) AS test_start, CAST(floor(n * b) AS BIGINT) AS test_end
FROM sizes, (VALUES ('1', 0.4::DOUBLE, 0.55::DOUBLE), ('2', 0.55::DOUBLE, 0.7::DOUBLE),
  ('3', 0.7::DOUBLE, 0.85::DOUBLE)) AS v(f, a, b)""", two_classes=True)
register("d7_stratified_folds",
         lambda spark, sf: splits.stratified_folds(cleaned(spark, sf), KEYS, 10).groupBy(
             "fold", Y).agg(F.count(F.lit(1)).alias("n"), F.sum("order_key").alias("key_sum")),
         with_ctes(CLEAN, body="""
SELECT fold, is_canceled, count(*) AS n, CAST(sum(order_key) AS BIGINT) AS key_sum FROM (
  SELECT *, ntile(10) OVER (PARTITION BY is_canceled ORDER BY md5('42|' || order_key || '|'
    || line_no || '|' || part_key || '|' || supp_key || '|' || list_price)) AS fold FROM clean)
GROUP BY 1, 2"""))
fold_query("d8_learning_subsets", splits.learning_folds, """
SELECT f AS fold, CAST(floor(base * CAST(f AS DOUBLE)) AS BIGINT) AS train_end,
  base AS test_start, n AS test_end
FROM (SELECT n, CAST(floor(n * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n * 0.1::DOUBLE) AS BIGINT)
    AS base FROM sizes),
  (VALUES ('0.1'), ('0.2'), ('0.3'), ('0.5'), ('0.7'), ('0.9'), ('1.0')) AS v(f)""")


def _random_subsets(spark, sf):
    df = cleaned(spark, sf).withColumns({
        f"u{s}": splits.digest_share(splits.shuffle_key(KEYS, s)) for s in (1, 2)})
    facts = df.agg(*[
        F.struct(F.lit(s).alias("seed"), F.lit(f).alias("fraction"),
                 F.count_if(F.col(f"u{s}") < f).alias("n"),
                 F.avg(F.when(F.col(f"u{s}") < f, F.col(Y))).alias("target_rate")
                 ).alias(f"s{s}_{int(f * 100)}")
        for s in (1, 2) for f in (0.1, 0.25, 0.5)])
    return facts.select(F.inline(F.array(*[F.col(c) for c in facts.columns])))


register("d9_random_subsets", _random_subsets, with_ctes(CLEAN, body="""
SELECT seed, fraction, count(*) AS n, avg(is_canceled) AS target_rate FROM (
  SELECT is_canceled, seed, CAST(('0x' || md5(seed || '|' || order_key || '|' || line_no || '|'
    || part_key || '|' || supp_key || '|' || list_price)[1:13]) AS BIGINT)
    / 4503599627370496::DOUBLE AS u FROM clean, (VALUES (1), (2)) AS s(seed)),
  (VALUES (0.1::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE)) AS f(fraction)
WHERE u < fraction GROUP BY 1, 2"""), dbl="target_rate")
register("d10_subtrain_val",
         lambda spark, sf: splits.subtrain_val(cleaned(spark, sf), DAY, KEYS).groupBy("part").agg(
             F.count(F.lit(1)).alias("n"), F.min(DAY).alias("first_day"),
             F.sum("order_key").alias("key_sum")),
         with_ctes(POSITIONED, body="""
SELECT CASE WHEN position < base - CAST(floor(base * 0.2::DOUBLE) AS BIGINT) THEN 'subtrain'
    WHEN position < base THEN 'subval' ELSE 'test' END AS part, count(*) AS n,
  min(arrival_date) AS first_day, CAST(sum(order_key) AS BIGINT) AS key_sum
FROM (SELECT *, CAST(floor(n_all * 0.8::DOUBLE) AS BIGINT)
  + CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT) AS base FROM positioned) GROUP BY 1"""))
register("d11_date_split",
         lambda spark, sf: splits.date_split(cleaned(spark, sf), DAY, "2000-01-01").groupBy(
             "split").agg(F.count(F.lit(1)).alias("n"), F.avg("adr").alias("mean_adr")),
         with_ctes(CLEAN, body="""
SELECT CASE WHEN arrival_date >= DATE '2000-01-01' THEN 'test' ELSE 'train' END AS split,
  count(*) AS n, avg(adr) AS mean_adr FROM clean GROUP BY 1"""), dbl="mean_adr")
register("d12_month_batches",
         lambda spark, sf: splits.month_batches(cleaned(spark, sf)).groupBy("batch").agg(
             F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate")),
         with_ctes(CLEAN, body="""
SELECT CASE month(arrival_date) WHEN 6 THEN 'baseline' WHEN 7 THEN 'batch_1' ELSE 'batch_2' END
  AS batch, count(*) AS n, avg(is_canceled) AS cancel_rate
FROM clean WHERE month(arrival_date) IN (6, 7, 8) GROUP BY 1"""), dbl="cancel_rate")

# --- E: metrics ----------------------------------------------------------------------------
T = 0.41
register("e1_confusion_counts",
         lambda spark, sf: metrics.confusion_counts(scored(spark, sf), T, ["hotel"]),
         with_ctes(SCORED, body=f"SELECT hotel, {confusion_sql(T)} FROM scored GROUP BY 1"))
COUNTS = f"counts AS (SELECT hotel, {confusion_sql(T)} FROM scored GROUP BY 1)"
register("e2_threshold_metrics",
         lambda spark, sf: metrics.threshold_metrics(scored(spark, sf), T, ["hotel"]),
         with_ctes(SCORED, auc_sql("scored", "hotel"), COUNTS, body=f"""
SELECT hotel, tn, fp, fn, tp, roc_auc, pr_auc, {PRF_SQL}, {BALANCED_SQL}
FROM counts JOIN aucs USING (hotel)"""),
         dbl="roc_auc pr_auc precision recall f1 balanced_accuracy")
register("e3_safe_threshold_metrics",
         lambda spark, sf: metrics.threshold_metrics(
             scored(spark, sf), T, ["is_late_window"]),
         with_ctes(SCORED, auc_sql("scored", "is_late_window"),
                   f"counts AS (SELECT is_late_window, {confusion_sql(T)} FROM scored GROUP BY 1)",
                   body=f"""
SELECT is_late_window, tn, fp, fn, tp, roc_auc, pr_auc, {PRF_SQL}, {BALANCED_SQL}
FROM counts JOIN aucs USING (is_late_window)"""),
         dbl="roc_auc pr_auc precision recall f1 balanced_accuracy")
register("e4_roc_auc",
         lambda spark, sf: metrics.auc_metrics(scored(spark, sf)).select("roc_auc"),
         with_ctes(SCORED, auc_sql("scored"), body="SELECT roc_auc FROM aucs"), dbl="roc_auc:8")
register("e5_pr_auc",
         lambda spark, sf: metrics.auc_metrics(scored(spark, sf), ["market_segment"]).select(
             "market_segment", "pr_auc"),
         with_ctes(SCORED, auc_sql("scored", "market_segment"),
                   body="SELECT market_segment, pr_auc FROM aucs"), dbl="pr_auc:8")
register("e6_brier",
         lambda spark, sf: scored(spark, sf).agg(metrics.brier().alias("brier")),
         with_ctes(SCORED, body="""
SELECT avg((cancel_probability - is_canceled) ** 2) AS brier FROM scored"""), dbl="brier")
ECE = """
SELECT {by}sum(n * abs(frac_pos - mean_pred)) / sum(n) AS ece FROM (
  SELECT {by}least(CAST(floor(round(cancel_probability * 10000) / 1000) AS INTEGER), 9) AS bin,
    count(*) AS n, avg(cancel_probability) AS mean_pred, avg(is_canceled) AS frac_pos
  FROM scored GROUP BY ALL) {group}"""
register("e7_ece", lambda spark, sf: metrics.ece(scored(spark, sf), ["hotel"]),
         with_ctes(SCORED, body=ECE.format(by="hotel, ", group="GROUP BY hotel")), dbl="ece")


def _ece_open(spark, sf):
    """Scores of the top row moved to exactly 1, which the open last bin leaves out."""
    top = scored(spark, sf).withColumn(P, F.when(F.col(P) >= 0.95, 1.0).otherwise(F.col(P)))
    return metrics.ece(top, closed_last=False)


register("e8_ece_open_last", _ece_open, with_ctes(SCORED, body="""
SELECT sum(n * abs(frac_pos - mean_pred)) FILTER (bin < 10) / sum(n) AS ece FROM (
  SELECT CASE WHEN cancel_probability >= 0.95 THEN 10
      ELSE floor(round(cancel_probability * 10000) / 1000) END AS bin,
    count(*) AS n, avg(cancel_probability) AS mean_pred, avg(is_canceled) AS frac_pos
  FROM scored GROUP BY 1)"""), dbl="ece")
register("e9_confusion_rates",
         lambda spark, sf: metrics.confusion_counts(scored(spark, sf), T, ["hotel"]).withColumns(
             metrics.rate_columns()),
         with_ctes(SCORED, COUNTS, body="""
SELECT *, tp / (tp + fn) AS tpr, tn / (tn + fp) AS tnr, fp / (tn + fp) AS fpr,
  fn / (tp + fn) AS fnr FROM counts"""), dbl="tpr tnr fpr fnr")
register("e10_roc_pr_curve",
         lambda spark, sf: metrics.curve_points(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, tp / p AS tpr, fp / n AS fpr,
  tp / (tp + fp) AS precision
FROM (SELECT cancel_probability AS threshold,
    CAST(sum(sum(is_canceled)) OVER (ORDER BY cancel_probability DESC) AS DOUBLE) AS tp,
    CAST(sum(sum(1 - is_canceled)) OVER (ORDER BY cancel_probability DESC) AS DOUBLE) AS fp
  FROM scored GROUP BY 1),
  (SELECT sum(is_canceled) AS p, sum(1 - is_canceled) AS n FROM scored)"""),
         dbl="tpr fpr precision")
register("e11_reliability_curve",
         lambda spark, sf: metrics.reliability_quantile(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT CAST(len(list_filter(edges, lambda e: e < cancel_probability)) AS BIGINT) AS bin,
  count(*) AS n, avg(cancel_probability) AS mean_pred, avg(is_canceled) AS frac_pos
FROM scored, (SELECT quantile_cont(cancel_probability,
  [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges FROM scored) GROUP BY 1"""),
         dbl="mean_pred frac_pos")
register("e11_reliability_uniform",
         lambda spark, sf: metrics.reliability_uniform(scored(spark, sf), ["risk_tier"]),
         with_ctes(SCORED, body="""
SELECT * FROM (SELECT risk_tier,
    CAST(floor(round(cancel_probability * 10000) / 1000) AS BIGINT) AS bin, count(*) AS n,
    avg(cancel_probability) AS mean_pred, avg(is_canceled) AS frac_pos
  FROM scored GROUP BY 1, 2) WHERE n >= 5"""), dbl="mean_pred frac_pos")
register("e12_score_histogram",
         lambda spark, sf: metrics.histogram(scored(spark, sf), P, 20, [Y]),
         with_ctes(SCORED, body="""
SELECT is_canceled, CAST(floor(round(cancel_probability * 10000) / 500) AS BIGINT) AS bin,
  count(*) AS n, count(*) / (sum(count(*)) OVER (PARTITION BY is_canceled) * 0.05) AS density
FROM scored GROUP BY 1, 2"""), dbl="density")
register("e13_class_cdf", lambda spark, sf: metrics.class_cdf(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT is_canceled AS class, cancel_probability AS score, count(*) AS n,
  CAST(sum(count(*)) OVER (PARTITION BY is_canceled ORDER BY cancel_probability) AS DOUBLE)
    / sum(count(*)) OVER (PARTITION BY is_canceled) AS cdf
FROM scored GROUP BY 1, 2"""), dbl="cdf")
register("e14_outcome_label",
         lambda spark, sf: metrics.outcome_profile(
             scored(spark, sf), T, ["lead_time", "adr", "total_stay"]),
         with_ctes(SCORED, body="""
SELECT CASE WHEN cancel_probability >= 0.41 AND is_canceled = 1 THEN 'TP'
  WHEN cancel_probability >= 0.41 THEN 'FP' WHEN is_canceled = 1 THEN 'FN' ELSE 'TN' END AS outcome,
  count(*) AS n, avg(lead_time) AS mean_lead_time, avg(adr) AS mean_adr,
  avg(total_stay) AS mean_total_stay FROM scored GROUP BY 1"""),
         dbl="mean_lead_time mean_adr mean_total_stay")


def predictions(spark, sf):
    """Bookings with a deterministic stand-in rate forecast."""
    noise = (F.col("supp_key") * 31 + F.col("line_no") * 7) % 21 - 10
    return scored(spark, sf).withColumn("predicted_adr", F.col("adr") * 0.9 + noise)


PREDICTED = SCORED + """,
predictions AS (
  SELECT *, adr * 0.9::DOUBLE + ((supp_key * 31 + line_no * 7) % 21 - 10) AS predicted_adr
  FROM scored
)"""
REGRESSION_SQL = """count(*) AS n, sqrt(avg(e * e)) AS rmse, avg(abs(e)) AS mae,
  1 - sum(e * e) / NULLIF(var_pop(adr) * count(*), 0) AS r2,
  100 * avg(abs(e / NULLIF(adr, 0))) AS mape,
  avg(e) AS resid_mean, median(e) AS resid_median, stddev_samp(e) AS resid_std,
  avg(CASE WHEN abs(e) <= 25 THEN 1 ELSE 0 END) AS within_25,
  avg(CASE WHEN abs(e) <= 50 THEN 1 ELSE 0 END) AS within_50"""
REGRESSION_COLS = ("rmse mae r2 mape resid_mean:5 resid_median:5 resid_std within_25 within_50")
register("e15_regression_metrics",
         lambda spark, sf: metrics.regression_metrics(
             predictions(spark, sf), "adr", "predicted_adr", ["hotel"]),
         with_ctes(PREDICTED, body=f"""
SELECT hotel, {REGRESSION_SQL}
FROM (SELECT *, adr - predicted_adr AS e FROM predictions WHERE adr IS NOT NULL) GROUP BY 1"""),
         dbl=REGRESSION_COLS)
register("e16_log_loss",
         lambda spark, sf: scored(spark, sf).groupBy("hotel").agg(metrics.log_loss().alias("loss")),
         with_ctes(SCORED, body="""
SELECT hotel, avg(-ln(CASE WHEN is_canceled = 1
  THEN least(greatest(cancel_probability, 1e-15), 1 - 1e-15)
  ELSE 1 - least(greatest(cancel_probability, 1e-15), 1 - 1e-15) END)) AS loss
FROM scored GROUP BY 1"""), dbl="loss")

# --- F: thresholds -------------------------------------------------------------------------
GRID = "grid AS (SELECT round(k / 100.0::DOUBLE, 4) AS threshold FROM range(100) AS r(k))"
SWEEP_COLS = "precision recall f1 positive_rate"


def sweep_sql(source="scored", by=""):
    lead = f"{by}, " if by else ""
    return f"""
sweep AS (
  SELECT {lead}threshold, {PRF_SQL}, (tp + fp) / CAST(tp + fp + fn + tn AS DOUBLE) AS positive_rate
  FROM (SELECT {lead}threshold, {confusion_sql('threshold')} FROM {source}, grid GROUP BY ALL)
)"""


def cost_sql(source="scored", by="", value="fn_cost", fp="15"):
    lead = f"{by}, " if by else ""
    return f"""
costs AS (
  SELECT *, fp_cost_total + fn_cost_total AS total_cost FROM (
    SELECT {lead}threshold,
      count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0) AS fp_count,
      count(*) FILTER (cancel_probability < threshold AND is_canceled = 1) AS fn_count,
      {fp}::DOUBLE * count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0)
        AS fp_cost_total,
      COALESCE(sum({value}) FILTER (cancel_probability < threshold AND is_canceled = 1), 0)
        AS fn_cost_total,
      COALESCE(sum({value}) FILTER (is_canceled = 1), 0) AS no_model_cost
    FROM {source}, grid GROUP BY ALL)
)"""


register("f1_threshold_grid",
         lambda spark, sf: thresholds.threshold_grid(spark).join(scored(spark, sf).select(
             F.round((thresholds.reached(F.col(P), 100) / 100), 4).alias("t")
         ).groupBy("t").agg(F.count(F.lit(1)).alias("n")), F.col("t") == F.col("threshold"), "left")
         .select("threshold", F.coalesce("n", F.lit(0)).alias("n_reaching_last")),
         with_ctes(SCORED, GRID, body="""
SELECT threshold, count(cancel_probability) AS n_reaching_last FROM grid LEFT JOIN scored
  ON cancel_probability >= threshold
  AND (cancel_probability < round((threshold * 100 + 1) / 100, 4) OR threshold = 0.99)
GROUP BY 1"""))
register("f2_threshold_sweep", lambda spark, sf: thresholds.threshold_sweep(scored(spark, sf)),
         with_ctes(SCORED, GRID, sweep_sql(), body="SELECT * FROM sweep"), dbl=SWEEP_COLS)
register("f3_select_max_f1",
         lambda spark, sf: thresholds.select_max_f1(thresholds.threshold_sweep(
             scored(spark, sf), by=["hotel"]), ["hotel"]),
         with_ctes(SCORED, GRID, sweep_sql(by="hotel"), body="""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
  PARTITION BY hotel ORDER BY f1 DESC, threshold) AS r FROM sweep) WHERE r = 1"""), dbl=SWEEP_COLS)
register("f4_select_high_precision",
         lambda spark, sf: thresholds.select_high_precision(
             thresholds.threshold_sweep(scored(spark, sf))),
         with_ctes(SCORED, GRID, sweep_sql(), body="""
SELECT threshold, precision, recall, f1, positive_rate,
  any_both AS constraint_met, any_rate AS positive_rate_constraint_met,
  any_recall AS recall_constraint_met, 0.05::DOUBLE AS min_positive_rate, 0.2::DOUBLE AS min_recall
FROM (SELECT *, bool_or(positive_rate >= 0.05 AND recall >= 0.2) OVER () AS any_both,
  bool_or(positive_rate >= 0.05) OVER () AS any_rate, bool_or(recall >= 0.2) OVER () AS any_recall
  FROM sweep)
ORDER BY CASE WHEN positive_rate >= 0.05 AND recall >= 0.2 THEN 0 WHEN recall >= 0.2 THEN 1
  ELSE 2 END, precision DESC, recall DESC, threshold LIMIT 1"""), dbl=SWEEP_COLS)
COST_COLS = "fp_cost_total fn_cost_total total_cost no_model_cost"
register("f5_cost_sweep", lambda spark, sf: thresholds.cost_sweep(scored(spark, sf)),
         with_ctes(SCORED, GRID, cost_sql(), body="SELECT * FROM costs"), money=COST_COLS)
register("f6_select_min_cost",
         lambda spark, sf: thresholds.select_min_cost(
             thresholds.cost_sweep(scored(spark, sf), by=["hotel"]), ["hotel"]),
         with_ctes(SCORED, GRID, cost_sql(by="hotel"), body="""
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (
  PARTITION BY hotel ORDER BY total_cost, threshold) AS r FROM costs) WHERE r = 1"""),
         money=COST_COLS)


def _resolve(spark, sf):
    """Stored policies per segment, some out of range, unreadable or missing."""
    raw = scored(spark, sf).groupBy("market_segment").agg(
        F.count(F.lit(1)).alias("n"), F.sum(Y).alias("c"))
    odd = F.col("n") % 3
    return thresholds.resolve_thresholds(raw.select(
        "market_segment",
        F.when(odd == 0, "true").otherwise((F.col("n") / F.col("c")).cast("string"))
        .alias("high_precision"),
        (F.col("c") / F.col("n")).cast("string").alias("max_f1"),
        F.when(odd == 1, F.lit(None).cast("string")).otherwise("-0.5").alias("cost_sensitive")))


register("f7_resolve_thresholds", _resolve, with_ctes(SCORED, body="""
SELECT market_segment, CASE WHEN n % 3 = 0 THEN 0.5 ELSE 1 END AS high_precision, c / n AS max_f1,
  CASE WHEN n % 3 = 1 THEN c / n ELSE 0 END AS cost_sensitive,
  CASE WHEN n % 3 = 1 THEN 'max_f1_fallback' ELSE 'artifact' END AS cost_source,
  n % 3 = 1 AS cost_fallback_used, CASE WHEN n % 3 = 1 THEN
    'cost_sensitive threshold missing; using max_f1 fallback.' END AS alert
FROM (SELECT market_segment, count(*) AS n, CAST(sum(is_canceled) AS DOUBLE) AS c
  FROM scored GROUP BY 1)"""), dbl="high_precision max_f1 cost_sensitive")

SEG_DIMS = ["hotel", "market_segment", "deposit_type"]
SEG_KEEP = ["is_canceled", "cancel_probability", "revenue_at_risk"]


def segments_long(spark, sf, dims=SEG_DIMS, keep=SEG_KEEP):
    return ordering.unpivot(scored(spark, sf), dims, keep)


register("f8_segment_thresholds",
         lambda spark, sf: thresholds.segment_thresholds(
             scored(spark, sf), segments_long(spark, sf), 0.41, 0.06),
         with_ctes(SCORED, GRID,
                   f"long AS ({long_form('scored', SEG_DIMS, ', '.join(SEG_KEEP))})",
                   sweep_sql("long", "dimension, segment"),
                   cost_sql("long", "dimension, segment", "revenue_at_risk"), body="""
SELECT dimension, segment, n, thr_max_f1, best_f1, thr_cost, best_cost, f1_at_global,
  cost_at_global, thr_max_f1 - 0.41::DOUBLE AS delta_f1_threshold,
  thr_cost - 0.06::DOUBLE AS delta_cost_threshold, best_f1 - f1_at_global AS f1_gain,
  cost_at_global - best_cost AS cost_saving
FROM (SELECT dimension, segment, count(*) AS n FROM long GROUP BY 1, 2 HAVING count(*) >= 500)
JOIN (SELECT dimension, segment, threshold AS thr_max_f1, f1 AS best_f1, row_number() OVER (
    PARTITION BY dimension, segment ORDER BY f1 DESC, threshold) AS r FROM sweep) AS a
  USING (dimension, segment)
JOIN (SELECT dimension, segment, threshold AS thr_cost, total_cost AS best_cost,
    row_number() OVER (PARTITION BY dimension, segment ORDER BY total_cost, threshold) AS r2
    FROM costs) AS b USING (dimension, segment)
JOIN (SELECT dimension, segment, f1 AS f1_at_global FROM sweep WHERE threshold = 0.41) AS c
  USING (dimension, segment)
JOIN (SELECT dimension, segment, total_cost AS cost_at_global FROM costs WHERE threshold = 0.06)
  AS d USING (dimension, segment)
WHERE r = 1 AND r2 = 1"""),
         dbl="best_f1 f1_at_global delta_f1_threshold delta_cost_threshold f1_gain",
         money="best_cost cost_at_global cost_saving")
FLAGS = ", ".join(f"CASE WHEN cancel_probability >= {t} THEN 1 ELSE 0 END AS predicted_cancel_{n}"
                  for n, t in POLICIES.items())
register("f9_policy_flags",
         lambda spark, sf: thresholds.policy_flags(scored(spark, sf), POLICIES).select(
             *KEYS, *[f"predicted_cancel_{n}" for n in POLICIES]),
         with_ctes(SCORED, body=f"SELECT {KEY_SQL}, {FLAGS} FROM scored"))
register("f10_policy_comparison",
         lambda spark, sf: thresholds.policy_comparison(scored(spark, sf), POLICIES),
         with_ctes(SCORED, POLICY_SQL, body=f"""
SELECT *, {PRF_SQL}, tp + fp AS flagged, 15::DOUBLE * fp AS fp_spend,
  revenue_saved - 15 * fp - fn_loss AS net_benefit
FROM (SELECT policy, threshold, {confusion_sql('threshold')},
    sum(revenue_at_risk) FILTER (cancel_probability >= threshold AND is_canceled = 1)
      AS revenue_saved,
    COALESCE(sum(revenue_at_risk) FILTER (
      cancel_probability < threshold AND is_canceled = 1), 0) AS fn_loss
  FROM scored, policies GROUP BY 1, 2)"""),
         dbl="precision recall f1", money="revenue_saved fn_loss fp_spend net_benefit")
SLIDER = [0.155, 0.25, 0.333, 0.5, 0.66, 0.9]
register("f11_what_if_threshold", lambda spark, sf: thresholds.what_if(scored(spark, sf), SLIDER),
         with_ctes(SCORED, "slider AS (SELECT * FROM (VALUES "
                   + ", ".join(f"({t}::DOUBLE)" for t in SLIDER) + ") AS v(threshold))", body=f"""
SELECT *, {PRF_SQL}, {BALANCED_SQL}
FROM (SELECT threshold, {confusion_sql('threshold')} FROM scored, slider GROUP BY 1)"""),
         dbl="precision recall f1 balanced_accuracy")

# --- G: cost and revenue -------------------------------------------------------------------
register("g1_fn_cost",
         lambda spark, sf: scored(spark, sf).select(*KEYS, "fn_cost"),
         with_ctes(SCORED, body=f"SELECT {KEY_SQL}, fn_cost FROM scored"))
register("g2_cost_at_threshold",
         lambda spark, sf: cost.cost_at_thresholds(scored(spark, sf), POLICIES),
         with_ctes(SCORED, POLICY_SQL, body="""
SELECT *, fp_count * 15.0::DOUBLE AS fp_cost_total, fp_count * 15.0 + fn_cost_total AS total_cost
FROM (SELECT policy, threshold,
  count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0) AS fp_count,
  count(*) FILTER (cancel_probability < threshold AND is_canceled = 1) AS fn_count,
  COALESCE(sum(fn_cost) FILTER (cancel_probability < threshold AND is_canceled = 1), 0)
    AS fn_cost_total
  FROM scored, policies GROUP BY 1, 2)"""), money="fn_cost_total fp_cost_total total_cost")
SUMMARY = ("baseline_050_cost intervene_all_cost no_model_cost savings_vs_050 "
           "savings_vs_no_model savings_vs_intervene_all")
register("g3_cost_policy_summary",
         lambda spark, sf: cost.cost_policy_summary(scored(spark, sf)),
         with_ctes(SCORED, GRID, cost_sql(), body="""
SELECT *, 15::DOUBLE AS fp_cost_assumption, baseline_050_cost - total_cost AS savings_vs_050,
  no_model_cost - total_cost AS savings_vs_no_model,
  intervene_all_cost - total_cost AS savings_vs_intervene_all
FROM (SELECT *, max(total_cost) FILTER (threshold = 0.5) OVER () AS baseline_050_cost,
  max(total_cost) FILTER (threshold = 0) OVER () AS intervene_all_cost FROM costs)
ORDER BY total_cost, threshold LIMIT 1"""),
         money=SUMMARY + " fp_cost_total fn_cost_total total_cost")


def _heldout(spark, sf):
    """The threshold is chosen on the validation rows and priced on the test rows."""
    df = split_scored(spark, sf)
    chosen = thresholds.select_min_cost(thresholds.cost_sweep(df.filter("split = 'val'")))
    return cost.heldout_cost_report(df.filter("split = 'test'"), chosen.first()["threshold"])


HELDOUT = (SPLIT, "val AS (SELECT * FROM split_scored WHERE split = 'val')", GRID, cost_sql("val"),
           "chosen AS (SELECT threshold FROM costs ORDER BY total_cost, threshold LIMIT 1)", """
report AS (
  SELECT threshold,
    count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0) AS fp_count,
    count(*) FILTER (cancel_probability < threshold AND is_canceled = 1) AS fn_count,
    15::DOUBLE * count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0)
      + COALESCE(sum(fn_cost) FILTER (cancel_probability < threshold AND is_canceled = 1), 0)
      AS total_cost,
    15::DOUBLE * count(*) FILTER (cancel_probability >= 0.5 AND is_canceled = 0)
      + COALESCE(sum(fn_cost) FILTER (cancel_probability < 0.5 AND is_canceled = 1), 0)
      AS baseline_050_cost,
    15::DOUBLE * count(*) FILTER (is_canceled = 0) AS intervene_all_cost,
    sum(fn_cost) FILTER (is_canceled = 1) AS no_model_cost
  FROM test, chosen GROUP BY 1
)""")
register("g4_heldout_cost_report", _heldout, with_ctes(*HELDOUT, body="""
SELECT *, baseline_050_cost - total_cost AS savings_vs_050,
  intervene_all_cost - total_cost AS savings_vs_intervene_all,
  no_model_cost - total_cost AS savings_vs_no_model FROM report"""), money=SUMMARY + " total_cost")
register("g5_risk_tier",
         lambda spark, sf: scored(spark, sf).groupBy(
             rules.risk_tier(F.col(P)).alias("risk_tier"),
             rules.risk_tier_right_closed(F.col(P)).alias("band")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(SCORED, body="""
SELECT risk_tier, CASE WHEN cancel_probability > 0.7 THEN 'high'
  WHEN cancel_probability > 0.4 THEN 'medium' ELSE 'low' END AS band, count(*) AS n
FROM scored GROUP BY 1, 2"""))
register("g6_tier_business_summary",
         lambda spark, sf: cost.tier_business_summary(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT COALESCE(risk_tier, 'all') AS risk_tier, count(*) AS n,
  avg(cancel_probability) AS mean_probability, avg(is_canceled) AS cancel_rate,
  avg(adr) AS mean_adr, avg(revenue_at_risk) AS mean_revenue,
  sum(revenue_at_risk) AS total_revenue,
  100.0 * count(*) / (SELECT count(*) FROM scored) AS share_pct
FROM scored GROUP BY ROLLUP (risk_tier)"""),
         dbl="mean_probability cancel_rate mean_adr mean_revenue share_pct", money="total_revenue")
FP_COSTS = [5, 10, 15, 20, 30, 40, 50, 60]
register("g7_fp_cost_sensitivity",
         lambda spark, sf: cost.fp_cost_sensitivity(scored(spark, sf), FP_COSTS),
         with_ctes(SCORED, GRID, cost_sql(value="revenue_at_risk"), body=f"""
SELECT threshold, fp_count, fn_count, fn_cost_total, fp_cost, fp_cost_total, total_cost FROM (
  SELECT *, row_number() OVER (PARTITION BY fp_cost ORDER BY total_cost, threshold) AS r FROM (
    SELECT threshold, fp_count, fn_count, fn_cost_total, fp_cost,
      fp_count * fp_cost AS fp_cost_total, fp_count * fp_cost + fn_cost_total AS total_cost
    FROM costs, (SELECT CAST(unnest({FP_COSTS}) AS DOUBLE) AS fp_cost))) WHERE r = 1"""),
         money="fn_cost_total fp_cost_total total_cost")
register("g8_cost_ladder", lambda spark, sf: cost.cost_ladder(_heldout(spark, sf)),
         with_ctes(*HELDOUT, body=" UNION ALL ".join(
             f"SELECT '{n}' AS policy, {c} AS cost, 100 * (1 - {c} / no_model_cost) AS saving_pct "
             "FROM report" for n, c in [
                 ("no_model", "no_model_cost"), ("intervene_all", "intervene_all_cost"),
                 ("threshold_050", "baseline_050_cost"), ("cost_policy", "total_cost")])),
         money="cost", dbl="saving_pct")
register("g9_kpi_overview", lambda spark, sf: cost.kpi_overview(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT min(arrival_date) AS first_arrival, max(arrival_date) AS last_arrival,
  count(*) AS bookings, CAST(sum(is_canceled) AS BIGINT) AS cancellations,
  avg(is_canceled) AS cancel_rate, avg(cancel_probability) AS mean_probability,
  sum(revenue_at_risk) AS total_revenue,
  sum(revenue_at_risk) FILTER (is_canceled = 1) AS lost_revenue, avg(adr) AS mean_adr,
  count(*) FILTER (risk_tier = 'high') AS high_risk_bookings,
  count(*) FILTER (risk_tier = 'high') / count(*) AS high_risk_share,
  sum(revenue_at_risk) FILTER (risk_tier = 'high') AS high_risk_revenue FROM scored"""),
         dbl="cancel_rate mean_probability mean_adr high_risk_share",
         money="total_revenue lost_revenue high_risk_revenue")
register("g10_revenue_exposure",
         lambda spark, sf: cost.revenue_exposure(
             scored(spark, sf), "reserved_room_type", F.col("revenue_at_risk"), T),
         with_ctes(SCORED, body="""
SELECT *, 100 * flagged_value / total_value AS at_risk_pct FROM (
  SELECT reserved_room_type, sum(revenue_at_risk) AS total_value,
    sum(revenue_at_risk) FILTER (cancel_probability >= 0.41) AS flagged_value
  FROM scored GROUP BY 1)"""), money="total_value flagged_value", dbl="at_risk_pct")
