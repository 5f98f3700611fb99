"""Queries of the segment, time-series, join and set operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import MONTHS
from ..functions import rules
from ..operators import ordering, segments, sets, splits, timeseries
from ..operators.metrics import P, Y
from ..sources.bookings import canonicalise_pms
from ..sources.star_schema import KEYS, POLICIES, bookings, cleaned, pms_export, scored
from .base import (
    BALANCED_SQL, BOOKINGS, CLEAN, ORDER_BY, POSITIONED, PRF_SQL, SCORED, auc_sql, confusion_sql,
    long_form, register, with_ctes,
)
from .evaluation import POLICY_SQL, SPLIT, split_scored
from .ordering import MODEL_FOLDS, model_folds

T = 0.41
KEY_SQL = ", ".join(KEYS)
METRICS = "roc_auc pr_auc precision recall f1 balanced_accuracy"
SEG_DIMS = {"hotel": 10, "market_segment": 4, "distribution_channel": 3, "arrival_date_month": 12,
            "country": 12}

# --- H ---------------------------------------------------------------------------------------
TOP = ("top AS (SELECT dimension, segment FROM (SELECT *, row_number() OVER (PARTITION BY dimension"
       " ORDER BY n DESC, segment) AS r FROM (SELECT dimension, segment, count(*) AS n FROM long"
       " GROUP BY 1, 2)) JOIN (SELECT * FROM (VALUES "
       + ", ".join(f"('{d}', {n})" for d, n in SEG_DIMS.items())
       + ") AS v(dimension, k)) USING (dimension) WHERE r <= k)")
LONG = f"long AS ({long_form('scored', list(SEG_DIMS), 'is_canceled, cancel_probability')})"
SEGMENT_METRICS = (SCORED, LONG, TOP, auc_sql("long", "dimension, segment"),
                   f"counts AS (SELECT dimension, segment, {confusion_sql(T)} FROM long "
                   "GROUP BY 1, 2)", f"""
seg AS (
  SELECT 'max_f1' AS policy, dimension, segment, n_rows, (tp + fn) / n_rows AS positive_rate,
    n_rows >= 2000 AND tp + fn > 0 AND tn + fp > 0 AS gated, 0.41::DOUBLE AS threshold,
    {", ".join(f"CASE WHEN n_rows >= 2000 AND tp + fn > 0 AND tn + fp > 0 THEN {m} END AS {m}"
               for m in METRICS.split())},
    CASE WHEN n_rows < 2000 THEN 'insufficient_rows'
      WHEN NOT (tp + fn > 0 AND tn + fp > 0) THEN 'single_class' END AS skip_reason
  FROM (SELECT *, tn + fp + fn + tp AS n_rows, {PRF_SQL}, {BALANCED_SQL}
    FROM counts JOIN aucs USING (dimension, segment) JOIN top USING (dimension, segment))
)""")


def _segment_metrics(spark, sf):
    return segments.segment_metrics(scored(spark, sf), T, SEG_DIMS, min_rows=2000)


register("h1_segment_metrics", _segment_metrics,
         with_ctes(*SEGMENT_METRICS, body="SELECT * FROM seg"), dbl="positive_rate " + METRICS)
COST_DIMS = ["hotel", "deposit_type", "customer_type"]
register("h2_segment_cost_benefit",
         lambda spark, sf: segments.segment_cost_benefit(scored(spark, sf), COST_DIMS, T),
         with_ctes(SCORED, "long AS (" + long_form(
             "scored", COST_DIMS, "is_canceled, cancel_probability, revenue_at_risk") + ")",
             body=f"""
SELECT *, 15::DOUBLE * fp AS fp_spend, revenue_saved - 15 * fp - fn_loss AS net_benefit FROM (
  SELECT dimension, segment, {confusion_sql(T)},
    sum(revenue_at_risk) FILTER (cancel_probability >= 0.41 AND is_canceled = 1) AS revenue_saved,
    sum(revenue_at_risk) FILTER (cancel_probability < 0.41 AND is_canceled = 1) AS fn_loss
  FROM long GROUP BY 1, 2)"""), money="revenue_saved fn_loss fp_spend net_benefit")
register("h3_late_window_report",
         lambda spark, sf: segments.late_window_report(scored(spark, sf), POLICIES),
         with_ctes(SCORED, POLICY_SQL, "late AS (SELECT * FROM scored WHERE lead_time <= 3)",
                   auc_sql("late"), body=f"""
SELECT *, {PRF_SQL}, {BALANCED_SQL} FROM (
  SELECT policy, threshold, {confusion_sql('threshold')} FROM late, policies GROUP BY 1, 2), aucs,
  (SELECT count(*) FILTER (lead_time <= 3) AS n_late, count(*) AS n_total,
     avg(is_canceled) AS cancel_rate_overall,
     avg(is_canceled) FILTER (lead_time <= 3) AS cancel_rate_late,
     count(*) FILTER (lead_time <= 3) / count(*) AS late_share FROM scored)"""),
         dbl=METRICS + " cancel_rate_overall cancel_rate_late late_share")
BREAK_DIMS = ["hotel", "meal", "country", "deposit_type", "agent"]
register("h4_category_breakdown",
         lambda spark, sf: segments.category_breakdown(cleaned(spark, sf), BREAK_DIMS),
         with_ctes(CLEAN, "long AS (" + long_form(
             "clean", BREAK_DIMS, "is_canceled, lead_time, adr, total_stay") + ")", body="""
SELECT * FROM (SELECT dimension, segment, count(*) AS n,
    CAST(sum(is_canceled) AS BIGINT) AS cancelled, avg(is_canceled) AS cancel_rate,
    avg(lead_time) AS mean_lead, avg(adr) AS mean_adr, avg(total_stay) AS mean_stay,
    count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS share
  FROM long GROUP BY 1, 2) WHERE n >= 50"""),
         dbl="cancel_rate mean_lead mean_adr mean_stay share")
SEGS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]
SHORT = MONTHS


def _pivot_sql(col, domain, expr):
    return ", ".join(f"{expr.format(f=f'FILTER ({col} = {chr(39)}{v}{chr(39)})')} AS \"{v}\""
                     for v in domain)


register("h5_rate_heatmap",
         lambda spark, sf: segments.rate_heatmap(
             cleaned(spark, sf), "market_segment", "arrival_date_month", MONTHS, 850),
         with_ctes(CLEAN, body=f"""
SELECT market_segment, avg(is_canceled) AS row_rate, {_pivot_sql('arrival_date_month', MONTHS,
    'CASE WHEN count(*) {f} >= 850 THEN avg(is_canceled) {f} END')}
FROM clean GROUP BY 1"""), dbl="row_rate " + " ".join(MONTHS))
register("h5_heatmap_extremes",
         lambda spark, sf: segments.heatmap_extremes(
             cleaned(spark, sf), "market_segment", "distribution_channel"),
         with_ctes(CLEAN, "cells AS (SELECT market_segment, distribution_channel, count(*) AS n, "
                   "avg(is_canceled) AS cancel_rate FROM clean GROUP BY 1, 2 "
                   "HAVING count(*) >= 300)", body="""
SELECT * FROM (SELECT *, 'highest' AS kind FROM cells
  ORDER BY cancel_rate DESC, market_segment, distribution_channel LIMIT 5)
UNION ALL SELECT * FROM (SELECT *, 'lowest' AS kind FROM cells
  ORDER BY cancel_rate, market_segment, distribution_channel LIMIT 5)"""), dbl="cancel_rate")
TIERS = ["low", "medium", "high"]
register("h6_crosstab",
         lambda spark, sf: segments.crosstab(scored(spark, sf), "deposit_type", "risk_tier", TIERS),
         with_ctes(SCORED, body="SELECT deposit_type, " + ", ".join(
             f"count(*) FILTER (risk_tier = '{t}') AS {t}_n, "
             f"avg(is_canceled) FILTER (risk_tier = '{t}') AS {t}_rate" for t in TIERS)
             + " FROM scored GROUP BY 1"), dbl=" ".join(f"{t}_rate" for t in TIERS))
register("h7_month_segment_matrix",
         lambda spark, sf: cleaned(spark, sf).groupBy("market_segment").pivot(
             "arrival_date_month", MONTHS).agg(F.avg(Y)),
         with_ctes(CLEAN, body=f"""
SELECT market_segment, {_pivot_sql('arrival_date_month', MONTHS, 'avg(is_canceled) {f}')}
FROM clean GROUP BY 1"""), dbl=" ".join(MONTHS))
register("h8_value_counts",
         lambda spark, sf: segments.value_counts(
             scored(spark, sf), "risk_tier", [*TIERS, "extreme"]),
         with_ctes(SCORED, body="""
SELECT risk_tier, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM scored GROUP BY 1
UNION ALL SELECT 'extreme', 0, 0"""), dbl="share")
EDGES = [-1, 3, 14, 30, 60, 120, 365, 9999]
LABELS = ["0-3 days", "4-14 days", "15-30 days", "31-60 days", "61-120 days", "121-365 days",
          ">365 days"]
BAND_SQL = "CASE " + " ".join(
    f"WHEN lead_time > {a} AND lead_time <= {b} THEN '{n}'"
    for a, b, n in zip(EDGES, EDGES[1:], LABELS)) + " END"
register("h9_lead_time_bands",
         lambda spark, sf: segments.lead_time_bands(scored(spark, sf), EDGES, LABELS, T),
         with_ctes(SCORED, body=f"""
SELECT {BAND_SQL} AS lead_band, count(*) AS n, avg(is_canceled) AS cancel_rate,
  avg(cancel_probability) AS mean_probability,
  COALESCE(avg(is_canceled) FILTER (cancel_probability >= 0.41), 0) AS precision,
  avg(revenue_at_risk) AS mean_revenue FROM scored GROUP BY 1"""),
         dbl="cancel_rate mean_probability precision mean_revenue")
register("h10_top_countries",
         lambda spark, sf: segments.top_countries(cleaned(spark, sf)),
         with_ctes(CLEAN, "base AS (SELECT country, count(*) AS n, avg(is_canceled) AS cancel_rate, "
                   "sum(revenue_at_risk) AS revenue FROM clean GROUP BY 1 HAVING count(*) >= 50)",
                   body="""
SELECT * FROM (SELECT *, 'revenue' AS ranked_by FROM base ORDER BY revenue DESC, country LIMIT 15)
UNION ALL SELECT * FROM (SELECT *, 'cancel_rate' AS ranked_by FROM base
  ORDER BY cancel_rate DESC, country LIMIT 15)"""), dbl="cancel_rate", money="revenue")
PROFILE = ["lead_time", "adr", "total_stay", "total_guests"]
register("h11_tier_profile",
         lambda spark, sf: segments.tier_profile(
             scored(spark, sf), rules.risk_tier_right_closed(F.col(P)), PROFILE, TIERS),
         with_ctes(SCORED, body=" UNION ALL ".join(
             f"SELECT '{f}' AS feature, avg({f}) FILTER (cancel_probability <= 0.4) AS low, "
             f"avg({f}) FILTER (cancel_probability > 0.4 AND cancel_probability <= 0.7) AS medium, "
             f"avg({f}) FILTER (cancel_probability > 0.7) AS high FROM scored"
             for f in PROFILE)), dbl="low medium high")
register("h12_tier_revenue_quantiles",
         lambda spark, sf: segments.revenue_quantiles(scored(spark, sf)),
         with_ctes(SCORED, body="""
SELECT risk_tier, avg(revenue_at_risk) AS mean, quantile_cont(revenue_at_risk, 0.25) AS p25,
  quantile_cont(revenue_at_risk, 0.5) AS p50, quantile_cont(revenue_at_risk, 0.75) AS p75
FROM scored GROUP BY 1"""), dbl="mean p25 p50 p75")
register("h13_segment_rank_matrix",
         lambda spark, sf: segments.segment_rank(_segment_metrics(spark, sf)),
         with_ctes(*SEGMENT_METRICS, body="""
SELECT dimension, segment, n_rows, roc_auc, row_number() OVER (
  PARTITION BY dimension ORDER BY roc_auc DESC, segment) AS rank FROM seg WHERE gated"""),
         dbl="roc_auc")
register("h14_per_segment_prf",
         lambda spark, sf: segments.segment_prf(scored(spark, sf), "deposit_type", T),
         with_ctes(SCORED, body=f"""
SELECT *, tp / NULLIF(tp + fp, 0) AS precision, tp / NULLIF(tp + fn, 0) AS recall,
  2 * tp / (2 * tp + fp + fn) AS f1
FROM (SELECT deposit_type, {confusion_sql(T)} FROM scored GROUP BY 1)"""),
         dbl="precision recall f1")
register("h15_action_list",
         lambda spark, sf: segments.action_list(scored(spark, sf), T, KEYS),
         with_ctes(SCORED, body=f"""
SELECT {KEY_SQL}, arrival_date, lead_time, cancel_probability, revenue_at_risk FROM scored
WHERE cancel_probability >= 0.41 AND revenue_at_risk IS NOT NULL
ORDER BY revenue_at_risk DESC, {KEY_SQL} LIMIT 50"""))
register("h15_flagged_lead_time",
         lambda spark, sf: segments.flagged_lead_time(scored(spark, sf), T),
         with_ctes(SCORED, body="""
SELECT count(*) AS flagged, avg(lead_time) AS mean_lead FROM scored
WHERE cancel_probability >= 0.41"""), dbl="mean_lead")
register("h16_price_ladder",
         lambda spark, sf: segments.price_ladder(cleaned(spark, sf)),
         with_ctes(CLEAN, body="""
SELECT *, CASE WHEN place <= 3 THEN 'premium' WHEN place <= 6 THEN 'mid' ELSE 'standard' END
  AS price_tier
FROM (SELECT *, row_number() OVER (ORDER BY median_adr DESC, reserved_room_type) AS place FROM (
  SELECT reserved_room_type, count(adr) AS n, avg(adr) AS mean_adr, avg(is_canceled) AS cancel_rate,
    median(adr) AS median_adr FROM clean GROUP BY 1 HAVING count(adr) >= 50))"""),
         dbl="mean_adr cancel_rate median_adr")
register("h17_month_hotel_price_matrix",
         lambda spark, sf: segments.price_matrix(cleaned(spark, sf), MONTHS),
         with_ctes(CLEAN, body=f"""
SELECT hotel, {_pivot_sql('arrival_date_month', MONTHS, 'avg(adr) {f}')} FROM clean GROUP BY 1"""),
         dbl=" ".join(MONTHS))
register("h17_price_extremes",
         lambda spark, sf: segments.price_extremes(cleaned(spark, sf)),
         with_ctes(CLEAN, "cells AS (SELECT hotel, arrival_date_month, avg(adr) AS mean_adr "
                   "FROM clean GROUP BY 1, 2)", body="""
SELECT * FROM (SELECT 'peak' AS cell, * FROM cells ORDER BY mean_adr DESC LIMIT 1)
UNION ALL SELECT * FROM (SELECT 'trough' AS cell, * FROM cells ORDER BY mean_adr LIMIT 1)"""),
         dbl="mean_adr")
register("h18_box_stats",
         lambda spark, sf: segments.box_stats(cleaned(spark, sf), "deposit_type", "adr"),
         with_ctes(CLEAN, "box AS (SELECT deposit_type, quantile_cont(adr, 0.25) AS q1, "
                   "quantile_cont(adr, 0.5) AS median, quantile_cont(adr, 0.75) AS q3 FROM clean "
                   "GROUP BY 1)", body="""
SELECT deposit_type, q1, median, q3, count(adr) AS n,
  min(adr) FILTER (adr >= q1 - 1.5 * (q3 - q1)) AS whisker_low,
  max(adr) FILTER (adr <= q3 + 1.5 * (q3 - q1)) AS whisker_high,
  count(adr) FILTER (adr < q1 - 1.5 * (q3 - q1) OR adr > q3 + 1.5 * (q3 - q1)) AS n_outliers
FROM clean JOIN box USING (deposit_type) GROUP BY 1, 2, 3, 4"""),
         dbl="q1 median q3 whisker_low whisker_high")

# --- I ---------------------------------------------------------------------------------------
register("i1_monthly_trend",
         lambda spark, sf: timeseries.monthly_trend(cleaned(spark, sf)),
         with_ctes(CLEAN, "monthly AS (SELECT date_trunc('month', arrival_date)::DATE AS month, "
                   "count(*) AS n, avg(is_canceled) AS cancel_rate FROM clean GROUP BY 1)", body="""
SELECT month, COALESCE(n, 0) AS n, cancel_rate, avg(cancel_rate) OVER (
  ORDER BY month ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS rate_3m
FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH))::DATE AS month
  FROM monthly) LEFT JOIN monthly USING (month)"""), dbl="cancel_rate rate_3m")
register("i2_monthly_revenue_timeline",
         lambda spark, sf: timeseries.monthly_revenue(scored(spark, sf), T),
         with_ctes(SCORED, body="""
SELECT date_trunc('month', arrival_date)::DATE AS month, count(*) AS n,
  count(*) FILTER (cancel_probability >= 0.41) AS flagged, avg(is_canceled) AS cancel_rate,
  sum(revenue_at_risk) AS revenue,
  COALESCE(sum(revenue_at_risk) FILTER (cancel_probability >= 0.41), 0) AS flagged_revenue,
  COALESCE(sum(revenue_at_risk) FILTER (risk_tier = 'high'), 0) AS high_tier_revenue
FROM scored GROUP BY 1"""), dbl="cancel_rate", money="revenue flagged_revenue high_tier_revenue")
DAILY = ("daily AS (SELECT hotel, arrival_date AS day, avg(adr) AS adr_mean, count(*) AS n "
         "FROM clean WHERE adr > 0 GROUP BY 1, 2)")


def _daily(spark, sf):
    return timeseries.daily_adr(cleaned(spark, sf), ["hotel"])


register("i3_rolling_7d",
         lambda spark, sf: timeseries.rolling_rows(_daily(spark, sf), "adr_mean", 7, ["hotel"]),
         with_ctes(CLEAN, DAILY, body="""
SELECT *, avg(adr_mean) OVER (PARTITION BY hotel ORDER BY day ROWS BETWEEN 6 PRECEDING
  AND CURRENT ROW) AS adr_mean_roll7 FROM daily"""), dbl="adr_mean adr_mean_roll7")
register("i4_rolling_28d_range",
         lambda spark, sf: timeseries.rolling_days(
             timeseries.daily_rate(cleaned(spark, sf)), "cancel_rate", 28),
         with_ctes(CLEAN, body="""
SELECT day, cancel_rate, n, avg(cancel_rate) OVER (ORDER BY day RANGE BETWEEN INTERVAL 27 DAY
  PRECEDING AND CURRENT ROW) AS cancel_rate_28d
FROM (SELECT arrival_date AS day, avg(is_canceled) AS cancel_rate, count(*) AS n FROM clean
  GROUP BY 1)"""), dbl="cancel_rate cancel_rate_28d")
BUCKETED = POSITIONED + f""",
bucketed AS (SELECT *, ntile(6) OVER (ORDER BY {ORDER_BY}) AS bucket FROM positioned)"""
register("i5_temporal_stability",
         lambda spark, sf: timeseries.temporal_stability(scored(spark, sf), KEYS, 6, T),
         with_ctes(BUCKETED, auc_sql("bucketed", "bucket"),
                   f"counts AS (SELECT bucket, {confusion_sql(T)}, count(*) AS n, "
                   "min(arrival_date) AS first_day, max(arrival_date) AS last_day, "
                   "avg(is_canceled) AS positive_rate FROM bucketed GROUP BY 1)", body="""
SELECT bucket, n, first_day, last_day, positive_rate, roc_auc, pr_auc,
  2 * tp / (2 * tp + fp + fn) AS f1 FROM counts JOIN aucs USING (bucket)"""),
         dbl="positive_rate roc_auc pr_auc f1")
register("i6_tier_calibration_over_time",
         lambda spark, sf: timeseries.tier_calibration(scored(spark, sf), KEYS, 6),
         with_ctes(BUCKETED, body="""
SELECT COALESCE(bucket, 0) AS bucket, risk_tier, count(*) AS n,
  avg(cancel_probability) AS predicted, avg(is_canceled) AS observed,
  avg(is_canceled) - avg(cancel_probability) AS gap
FROM bucketed GROUP BY GROUPING SETS ((bucket, risk_tier), (risk_tier))"""),
         dbl="predicted observed gap")
register("i7_seasonal_decompose",
         lambda spark, sf: timeseries.seasonal_decompose(
             _daily(spark, sf), "adr_mean", ["hotel"]).withColumn(
                 "phase", F.col("phase").cast("bigint")),
         with_ctes(CLEAN, DAILY, """
parts AS (
  SELECT *, (row_number() OVER w - 1) % 7 AS phase,
    CASE WHEN count(*) OVER c = 7 THEN avg(adr_mean) OVER c END AS trend
  FROM daily WINDOW w AS (PARTITION BY hotel ORDER BY day),
    c AS (PARTITION BY hotel ORDER BY day ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING)
), phases AS (
  SELECT hotel, phase, raw - avg(raw) OVER (PARTITION BY hotel) AS seasonal
  FROM (SELECT hotel, phase, avg(adr_mean - trend) AS raw FROM parts GROUP BY 1, 2)
)""", body="""
SELECT hotel, day, adr_mean, n, phase, trend, seasonal, adr_mean - trend - seasonal AS residual
FROM parts JOIN phases USING (hotel, phase)"""), dbl="adr_mean trend seasonal residual")


def acf_sql(source):
    return f"""
centred AS (SELECT hotel, day, adr_mean - avg(adr_mean) OVER (PARTITION BY hotel) AS c,
  row_number() OVER (PARTITION BY hotel ORDER BY day) AS i FROM {source})"""


ACF_BODY = """
SELECT a.hotel, CAST(b.i - a.i AS INTEGER) AS lag, sum(a.c * b.c) / max(v) AS acf
FROM centred AS a JOIN centred AS b ON a.hotel = b.hotel AND b.i - a.i BETWEEN 1 AND 40
JOIN (SELECT hotel, sum(c * c) AS v FROM centred GROUP BY 1) AS t ON t.hotel = a.hotel
GROUP BY 1, 2"""
register("i8_autocorrelation",
         lambda spark, sf: timeseries.autocorrelation(_daily(spark, sf), "adr_mean", ["hotel"]),
         with_ctes(CLEAN, DAILY, acf_sql("daily"), body=ACF_BODY), dbl="acf")
register("i8_autocorrelation_diff",
         lambda spark, sf: timeseries.autocorrelation(timeseries.first_difference(
             _daily(spark, sf), "adr_mean", ["hotel"]), "adr_mean", ["hotel"]),
         with_ctes(CLEAN, DAILY, "diff AS (SELECT * FROM (SELECT hotel, day, adr_mean "
                   "- lag(adr_mean) OVER (PARTITION BY hotel ORDER BY day) AS adr_mean FROM daily) "
                   "WHERE adr_mean IS NOT NULL)", acf_sql("diff"), body=ACF_BODY), dbl="acf")
register("i9_baseline_forecast",
         lambda spark, sf: timeseries.baseline_forecast(
             _daily(spark, sf), "adr_mean", "1997-01-01", ["hotel"]),
         with_ctes(CLEAN, DAILY, body="""
SELECT hotel, count(*) AS horizon, sqrt(avg((adr_mean - f) ** 2)) AS rmse,
  avg(abs(adr_mean - f)) AS mae, 100 * avg(abs((adr_mean - f) / adr_mean)) AS mape
FROM daily JOIN (SELECT hotel, avg(adr_mean) AS f FROM daily WHERE day < DATE '1997-01-01'
  GROUP BY 1) USING (hotel) WHERE day >= DATE '1997-01-01' GROUP BY 1"""), dbl="rmse mae mape")
CALENDAR = """
dates AS (
  SELECT unnest(generate_series(min(arrival_date), max(arrival_date), INTERVAL 1 DAY))::DATE AS date
  FROM clean
)"""
CAL_COLS = """date, CAST(year(date) AS INTEGER) AS year, CAST(month(date) AS INTEGER) AS month,
  strftime(date, '%B') AS month_name, CAST(weekofyear(date) AS INTEGER) AS iso_week,
  CAST(quarter(date) AS INTEGER) AS quarter, CAST(dayofweek(date) + 1 AS INTEGER) AS weekday"""
register("i10_calendar_table",
         lambda spark, sf: timeseries.calendar(cleaned(spark, sf), "arrival_date"),
         with_ctes(CLEAN, CALENDAR, body=f"SELECT {CAL_COLS} FROM dates"))
register("i11_daily_adr_series",
         lambda spark, sf: timeseries.daily_adr(cleaned(spark, sf)),
         with_ctes(CLEAN, body="""
SELECT arrival_date AS day, avg(adr) AS adr_mean, count(*) AS n FROM clean WHERE adr > 0
GROUP BY 1"""), dbl="adr_mean")

# --- J ---------------------------------------------------------------------------------------


def _perf(spark, sf):
    return scored(spark, sf).groupBy(F.col("supp_key").alias("model")).agg(
        F.round(F.avg(P), 6).alias("mean_score"), F.round(F.avg("adr"), 6).alias("mean_adr"))


def _costs(spark, sf):
    return scored(spark, sf).groupBy(
        F.col("supp_key").alias("model")).agg(F.round(F.sum("fn_cost"), 2).alias("cost"))


PERF = """
perf AS (SELECT supp_key AS model, round(avg(cancel_probability), 6) AS mean_score,
  round(avg(adr), 6) AS mean_adr FROM scored GROUP BY 1)"""
COSTS = """
costs AS (SELECT supp_key AS model, round(sum(fn_cost), 2) AS cost FROM scored GROUP BY 1)"""
register("j1_inner_join_metrics_cost",
         lambda spark, sf: sets.metrics_with_cost(_perf(spark, sf), _costs(spark, sf)),
         with_ctes(SCORED, PERF, COSTS, body="SELECT * FROM perf JOIN costs USING (model)"),
         dbl="mean_score mean_adr", money="cost")


def _top_models(spark, sf):
    rows = scored(spark, sf).withColumnRenamed("supp_key", "model")
    best = [F.desc("mean_score"), F.asc("model")]
    return sets.rows_of_top_models(rows, _perf(spark, sf), best, 5).groupBy("model").agg(
        F.count(F.lit(1)).alias("n"), F.sum(Y).alias("cancelled"))


register("j2_semi_join_top_models", _top_models, with_ctes(SCORED, PERF, body="""
SELECT supp_key AS model, count(*) AS n, CAST(sum(is_canceled) AS BIGINT) AS cancelled FROM scored
WHERE supp_key IN (SELECT model FROM perf ORDER BY mean_score DESC, model LIMIT 5) GROUP BY 1"""))


def _union(spark, sf):
    df = split_scored(spark, sf)
    both = sets.union_splits(df.filter("split = 'train'"), df.filter("split = 'val'"))
    return both.groupBy("hotel").agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"))


register("j3_union_splits", _union, with_ctes(SPLIT, body="""
SELECT hotel, count(*) AS n, avg(is_canceled) AS cancel_rate FROM split_scored
WHERE split <> 'test' GROUP BY 1"""), dbl="cancel_rate")
DUP = ["hotel", "deposit_type", "customer_type", "adults", "children"]
DUP_SQL = ", ".join(DUP)
register("j4_drop_duplicates",
         lambda spark, sf: sets.duplicate_summary(bookings(spark, sf).select(*DUP, Y)),
         with_ctes(BOOKINGS, body=f"""
SELECT CAST(sum(n) AS BIGINT) AS rows_before, count(*) AS rows_after,
  1 - count(*) / sum(n) AS dropped_share
FROM (SELECT count(*) AS n FROM bookings GROUP BY {DUP_SQL}, is_canceled)"""), dbl="dropped_share")
register("j5_duplicate_clusters",
         lambda spark, sf: sets.duplicate_clusters(
             bookings(spark, sf), [*DUP, "meal", "country", "adr"]),
         with_ctes(BOOKINGS, body=f"""
SELECT *, CASE WHEN duplicate_rate >= 0.3 AND consistent_share >= 0.9
    THEN 'DATASET CLUSTER STRUCTURE'
  WHEN duplicate_rate >= 0.15 THEN 'ELEVATED DUPLICATION' ELSE 'LOW DUPLICATION' END AS verdict
FROM (SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(*) AS n_unique,
    count(*) FILTER (n > 1) AS n_clusters, count(*) FILTER (n > 1 AND k = 1) AS n_consistent,
    CAST(sum(n) - count(*) AS BIGINT) AS n_duplicates,
    (sum(n) - count(*)) / sum(n) AS duplicate_rate,
    COALESCE(count(*) FILTER (n > 1 AND k = 1) / NULLIF(count(*) FILTER (n > 1), 0), 0)
      AS consistent_share
  FROM (SELECT count(*) AS n, count(DISTINCT is_canceled) AS k FROM bookings
    GROUP BY {DUP_SQL}, meal, country, adr))"""), dbl="duplicate_rate consistent_share")
register("j5_cluster_sizes",
         lambda spark, sf: sets.cluster_size_histogram(bookings(spark, sf), [*DUP, "meal",
                                                                            "country"]),
         with_ctes(BOOKINGS, body=f"""
SELECT n AS cluster_size, count(*) AS n_clusters FROM (SELECT count(*) AS n FROM bookings
  GROUP BY {DUP_SQL}, meal, country) GROUP BY 1"""))
OVER = [*DUP, "meal", "country", "reserved_room_type", "lead_time"]


def _overlap(spark, sf):
    df = split_scored(spark, sf)
    return sets.split_overlap(df.filter("split = 'test'"), df.filter("split != 'test'"), OVER)


SAME = " AND ".join(f"s.{c} IS NOT DISTINCT FROM t.{c}" for c in OVER)
register("j6_cross_split_overlap", _overlap, with_ctes(SPLIT, body=f"""
SELECT count(*) AS n_test, count(*) FILTER (seen) AS n_seen,
  count(*) FILTER (seen) / count(*) AS seen_share
FROM (SELECT EXISTS (SELECT 1 FROM split_scored AS s WHERE split <> 'test' AND {SAME}) AS seen
  FROM test AS t)"""), dbl="seen_share")
SHARED = ["reserved_room_type", "deposit_type", "arrival_date_month"]
register("j7_category_set_diff",
         lambda spark, sf: sets.category_set_diff(
             cleaned(spark, sf), canonicalise_pms(pms_export(spark, sf)), SHARED),
         with_ctes(CLEAN, f"a AS (SELECT DISTINCT * FROM ({long_form('clean', SHARED, '1 AS x')}))",
                   """
pms AS (
  SELECT c_mktsegment AS reserved_room_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'No Deposit' ELSE 'Refundable' END AS deposit_type,
    strftime(o_orderdate::DATE + CAST(o_orderkey % 90 AS INTEGER), '%B') AS arrival_date_month
  FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderstatus IN ('F', 'O') AND o_orderkey % 97 <> 0
)""", f"b AS (SELECT DISTINCT * FROM ({long_form('pms', SHARED, '1 AS x')}))", body="""
SELECT dimension, segment, CASE WHEN b.x IS NULL THEN 'a_only' WHEN a.x IS NULL THEN 'b_only'
  ELSE 'both' END AS found_in FROM a FULL JOIN b USING (dimension, segment)"""))
register("j8_full_outer_categories",
         lambda spark, sf: sets.full_outer_counts(
             cleaned(spark, sf).filter("hotel = 'City Hotel'"),
             cleaned(spark, sf).filter("hotel = 'Resort Hotel'"), "agent"),
         with_ctes(CLEAN, body="""
SELECT agent, count(*) FILTER (hotel = 'City Hotel') AS n_a,
  count(*) FILTER (hotel = 'Resort Hotel') AS n_b FROM clean
WHERE hotel IN ('City Hotel', 'Resort Hotel') AND agent IS NOT NULL GROUP BY 1"""))


def _market(hotel):
    return lambda spark, sf: cleaned(spark, sf).filter(F.col("hotel") == hotel).groupBy(
        "country").agg(F.round(F.avg("adr"), 1).alias("importance"))


MARKETS = """
ma AS (SELECT country, round(avg(adr), 1) AS v FROM clean WHERE hotel = 'City Hotel' GROUP BY 1),
mb AS (SELECT country, round(avg(adr), 1) AS v FROM clean WHERE hotel = 'Resort Hotel' GROUP BY 1)"""
RANKED = MARKETS + """,
ranked AS (
  SELECT country, ma.v AS value_a, mb.v AS value_b,
    rank() OVER (ORDER BY ma.v DESC) + (count(*) OVER (PARTITION BY ma.v) - 1) / 2 AS rank_a,
    rank() OVER (ORDER BY mb.v DESC) + (count(*) OVER (PARTITION BY mb.v) - 1) / 2 AS rank_b
  FROM ma JOIN mb USING (country)
)"""


def _ranks(spark, sf):
    return sets.rank_alignment(_market("City Hotel")(spark, sf), _market("Resort Hotel")(spark, sf),
                               "country", "importance")


register("j9_rank_alignment", _ranks, with_ctes(CLEAN, RANKED, body="SELECT * FROM ranked"),
         dbl="value_a value_b rank_a rank_b")
register("j9_spearman", lambda spark, sf: sets.spearman(_ranks(spark, sf)),
         with_ctes(CLEAN, RANKED, body="""
SELECT count(*) AS n_shared, corr(rank_a, rank_b) AS spearman FROM ranked"""), dbl="spearman")
register("j10_share_alignment",
         lambda spark, sf: sets.share_alignment(
             _market("City Hotel")(spark, sf), _market("Resort Hotel")(spark, sf),
             "country", "importance", 10),
         with_ctes(CLEAN, MARKETS, body="""
SELECT country, COALESCE(sa, 0) AS share_a, COALESCE(sb, 0) AS share_b, sa IS NOT NULL AS in_a,
  sb IS NOT NULL AS in_b
FROM (SELECT country FROM (SELECT country FROM ma ORDER BY v DESC, country LIMIT 10)
  UNION SELECT country FROM (SELECT country FROM mb ORDER BY v DESC, country LIMIT 10))
LEFT JOIN (SELECT country, v / sum(v) OVER () AS sa FROM ma) USING (country)
LEFT JOIN (SELECT country, v / sum(v) OVER () AS sb FROM mb) USING (country)"""),
         dbl="share_a share_b")


def _calendar_join(spark, sf):
    df = cleaned(spark, sf)
    dates = timeseries.calendar(df, "arrival_date")
    return sets.with_calendar(df.select("arrival_date", Y), dates, "arrival_date").groupBy(
        "year", "quarter").agg(F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"))


register("j11_date_dimension_join", _calendar_join, with_ctes(CLEAN, body="""
SELECT CAST(year(arrival_date) AS INTEGER) AS year, CAST(quarter(arrival_date) AS INTEGER)
  AS quarter, count(*) AS n, avg(is_canceled) AS cancel_rate FROM clean GROUP BY 1, 2"""),
    dbl="cancel_rate")
