"""Queries of the drift, monitoring and statistics operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import NUMERIC_FEATURES
from ..operators import drift, ordering, splits, stats
from ..operators.metrics import P, Y
from ..sources.star_schema import KEYS, cleaned, scored
from .base import CLEAN, ORDER_BY, SCORED, long_form, register, with_ctes
from .ordering import MODEL_FOLDS, model_folds

T = 0.41
NUM = ["lead_time", "adr", "total_stay"]
CAT = ["country", "market_segment", "deposit_type", "customer_type", "agent", "hotel", "meal"]
# Live rows arrive in 1999 or later.
RECENT = "arrival_date_year >= 1999"


def both(spark, sf):
    df = scored(spark, sf)
    return df.withColumn("is_live", F.expr(RECENT).cast("int"))


BOTH = SCORED + f""",
both_sides AS (
  SELECT *, CASE WHEN {RECENT} THEN 1 ELSE 0 END AS is_live FROM scored
)"""


def long_numeric(source, cols, keep):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS feature, CAST({c} AS DOUBLE) AS value, {keep} FROM {source} "
        f"WHERE {c} IS NOT NULL" for c in cols)


def psi_numeric_sql(by="feature", name="psi_num", long="long_num"):
    lead = ", ".join(f"e.{b}" for b in by.split(", "))
    return f"""
{name}_edges AS (
  SELECT {by}, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS edges
  FROM {long} WHERE is_live = 0 GROUP BY {by}
), {name}_bins AS (
  SELECT {lead}, len(list_filter(edges, lambda x: x <= value)) AS bin,
    count(*) FILTER (is_live = 0) AS b, count(*) FILTER (is_live = 1) AS l
  FROM {long} AS e JOIN {name}_edges USING ({by}) GROUP BY ALL
), {name} AS (
  SELECT {by}, sum((l1 - b1) * ln(l1 / b1)) AS psi FROM (
    SELECT {by}, (COALESCE(b, 0) + 1e-4) / tb AS b1, (COALESCE(l, 0) + 1e-4) / tl AS l1
    FROM (SELECT {by}, sum(b) AS tb, sum(l) AS tl FROM {name}_bins GROUP BY {by})
    CROSS JOIN (SELECT unnest(range(10)) AS bin) LEFT JOIN {name}_bins USING ({by}, bin)
    WHERE tb > 0 AND tl > 0
  ) GROUP BY {by}
)"""


def psi_categorical_sql(by="feature", name="psi_cat", long="long_cat"):
    return f"""
{name} AS (
  SELECT {by}, sum((l1 - b1) * ln(l1 / b1)) AS psi FROM (
    SELECT {by}, count(*) FILTER (is_live = 0) / CAST(max(tb) AS DOUBLE) + 1e-6 AS b1,
      count(*) FILTER (is_live = 1) / CAST(max(tl) AS DOUBLE) + 1e-6 AS l1
    FROM {long} JOIN (SELECT {by}, count(*) FILTER (is_live = 0) AS tb,
        count(*) FILTER (is_live = 1) AS tl FROM {long} GROUP BY {by}) USING ({by})
    WHERE tb > 0 AND tl > 0 GROUP BY {by}, segment
  ) GROUP BY {by}
)"""


LONG_NUM = f"long_num AS ({long_numeric('both_sides', NUM, 'is_live')})"
LONG_CAT = ("long_cat AS (SELECT dimension AS feature, segment, is_live FROM ("
            + long_form("both_sides", CAT, "is_live") + ") WHERE segment IS NOT NULL)")
register("k1_psi_numeric",
         lambda spark, sf: drift.psi_numeric(drift.long_numeric(both(spark, sf), NUM)),
         with_ctes(BOTH, LONG_NUM, psi_numeric_sql(), body="SELECT * FROM psi_num"), dbl="psi")
register("k2_psi_categorical",
         lambda spark, sf: drift.psi_categorical(drift.long_categorical(both(spark, sf), CAT)),
         with_ctes(BOTH, LONG_CAT, psi_categorical_sql(), body="SELECT * FROM psi_cat"), dbl="psi")
ZONE = "CASE WHEN {p} < 0.1 THEN 'stable' WHEN {p} < 0.25 THEN 'monitor' ELSE 'retrain' END"


def _scaled_psi(spark, sf):
    """Drift of three columns of which the derived ones are made to move."""
    df = both(spark, sf)
    moved = df.withColumns({
        "slow": F.col("adr") * (1 + F.col("is_live") * 0.05),
        "fast": F.col("adr") * (1 + F.col("is_live") * 0.3)})
    return moved


def _zones(spark, sf):
    long = drift.long_numeric(_scaled_psi(spark, sf), ["adr", "slow", "fast"])
    return drift.psi_numeric(long).withColumns({
        "zone": drift.psi_zone(F.col("psi")), "status": drift.psi_status(F.col("psi"))})


MOVED = BOTH + """,
moved AS (SELECT *, adr * (1 + is_live * 0.05::DOUBLE) AS slow,
  adr * (1 + is_live * 0.3::DOUBLE) AS fast FROM both_sides)"""
STATUS = "CASE WHEN psi < 0.1 THEN 'OK' WHEN psi < 0.2 THEN 'WARN' ELSE 'ALERT' END"
register("k3_psi_zone",
         lambda spark, sf: _zones(spark, sf).drop("status"),
         with_ctes(MOVED, f"long_num AS ({long_numeric('moved', ['adr', 'slow', 'fast'], 'is_live')})",
                   psi_numeric_sql(), body=f"""
SELECT feature, psi, {ZONE.format(p='psi')} AS zone FROM psi_num"""), dbl="psi")
register("k6_psi_status_020",
         lambda spark, sf: _zones(spark, sf).drop("zone"),
         with_ctes(MOVED, f"long_num AS ({long_numeric('moved', ['adr', 'slow', 'fast'], 'is_live')})",
                   psi_numeric_sql(), body=f"""
SELECT feature, psi, {STATUS} AS status FROM psi_num"""), dbl="psi")
REPORT_NUM = ["cancel_probability", "lead_time", "adr"]


def _report(spark, sf):
    df = scored(spark, sf)
    return drift.drift_report(df.filter(f"NOT ({RECENT})"), df.filter(RECENT), REPORT_NUM, CAT)


REPORT = (BOTH, f"long_num AS ({long_numeric('both_sides', REPORT_NUM, 'is_live')})", LONG_CAT,
          psi_numeric_sql(), psi_categorical_sql(), f"""
report AS (
  SELECT feature, kind, round(psi, 6) AS psi, {ZONE.format(p='psi')} AS zone, n_live, n_baseline
  FROM (SELECT *, 'numeric' AS kind FROM psi_num
    UNION ALL SELECT *, 'categorical' AS kind FROM psi_cat),
  (SELECT count(*) FILTER (is_live = 1) AS n_live, count(*) FILTER (is_live = 0) AS n_baseline
   FROM both_sides)
)""")
register("k4_drift_report",
         lambda spark, sf: _report(spark, sf).drop("computed_at_utc"),
         with_ctes(*REPORT, body="SELECT * FROM report"), dbl="psi")
register("k12_retrain_rule", lambda spark, sf: drift.retrain_rule(_report(spark, sf)),
         with_ctes(*REPORT, body="""
SELECT count(*) FILTER (zone = 'stable') AS n_stable, count(*) FILTER (zone = 'monitor')
  AS n_monitor, count(*) FILTER (zone = 'retrain') AS n_retrain,
  count(*) FILTER (zone = 'retrain') > 0 OR count(*) FILTER (zone = 'monitor') >= 5 AS retrain
FROM report"""))

BATCH_NUM = ["lead_time", "adr", "revenue_at_risk"]
BATCH_CAT = ["hotel", "market_segment", "deposit_type", "customer_type"]


def batches(spark, sf):
    return splits.month_batches(scored(spark, sf))


def paired(cols):
    return f"""
batched AS (
  SELECT *, CASE month(arrival_date) WHEN 6 THEN 'baseline' WHEN 7 THEN 'batch_1'
    ELSE 'batch_2' END AS batch FROM scored WHERE month(arrival_date) IN (6, 7, 8)
), paired AS (
  SELECT * EXCLUDE (batch), b AS batch, 0 AS is_live
  FROM batched, (VALUES ('batch_1'), ('batch_2')) AS v(b) WHERE batch = 'baseline'
  UNION ALL BY NAME SELECT *, 1 AS is_live FROM batched WHERE batch <> 'baseline'
)"""


BATCH_PSI = (SCORED, paired(BATCH_NUM),
             f"long_num AS ({long_numeric('paired', BATCH_NUM, 'is_live, batch')})",
             "long_cat AS (SELECT dimension AS feature, segment, is_live, batch FROM ("
             + long_form("paired", BATCH_CAT, "is_live, batch") + "))",
             psi_numeric_sql("feature, batch"), psi_categorical_sql("feature, batch"), f"""
rows_ AS (SELECT *, {STATUS} AS status FROM (SELECT *, 'numeric' AS kind FROM psi_num
  UNION ALL SELECT *, 'categorical' AS kind FROM psi_cat))""")


def _batch_drift(spark, sf):
    return drift.batch_drift(batches(spark, sf), BATCH_NUM, BATCH_CAT)


register("k5_batch_drift", _batch_drift, with_ctes(*BATCH_PSI, body="SELECT * FROM rows_"),
         dbl="psi")
register("k5_batch_drift_matrix",
         lambda spark, sf: drift.drift_matrix(_batch_drift(spark, sf), ["batch_1", "batch_2"]),
         with_ctes(*BATCH_PSI, body="""
SELECT feature, max(psi) FILTER (batch = 'batch_1') AS batch_1,
  max(psi) FILTER (batch = 'batch_2') AS batch_2 FROM rows_ GROUP BY 1"""), dbl="batch_1 batch_2")
register("k7_psi_uniform_bins",
         lambda spark, sf: drift.psi_uniform(drift.long_numeric(both(spark, sf), [P])),
         with_ctes(BOTH, body="""
SELECT 'cancel_probability' AS feature, sum((l - b) * ln(l / b)) AS psi FROM (
  SELECT greatest(count(*) FILTER (is_live = 0 AND k = bin) / max(tb), 1e-6) AS b,
    greatest(count(*) FILTER (is_live = 1 AND k = bin) / max(tl), 1e-6) AS l
  FROM (SELECT is_live, floor(round(cancel_probability * 10000) / 1000) AS k FROM both_sides),
    (SELECT unnest(range(10)) AS bin),
    (SELECT CAST(count(*) FILTER (is_live = 0) AS DOUBLE) AS tb,
       CAST(count(*) FILTER (is_live = 1) AS DOUBLE) AS tl FROM both_sides)
  GROUP BY bin)"""), dbl="psi")
register("k8_ks_two_sample",
         lambda spark, sf: drift.ks_two_sample(drift.long_numeric(both(spark, sf), NUM)),
         with_ctes(BOTH, LONG_NUM, """
cdf AS (
  SELECT feature, value, tb, tl, sum(b) OVER w / tb AS fb, sum(l) OVER w / tl AS fl
  FROM (SELECT feature, value, count(*) FILTER (is_live = 0) AS b,
      count(*) FILTER (is_live = 1) AS l FROM long_num GROUP BY 1, 2)
  JOIN (SELECT feature, CAST(count(*) FILTER (is_live = 0) AS DOUBLE) AS tb,
      CAST(count(*) FILTER (is_live = 1) AS DOUBLE) AS tl FROM long_num GROUP BY 1) USING (feature)
  WINDOW w AS (PARTITION BY feature ORDER BY value)
), ks AS (
  SELECT feature, max(abs(fb - fl)) AS ks, CAST(max(tb) AS BIGINT) AS n_base,
    CAST(max(tl) AS BIGINT) AS n_live FROM cdf GROUP BY 1
), tested AS (
  SELECT feature, ks, n_base, n_live, CASE WHEN max(lam2) < 0.04 THEN 1 ELSE
    least(greatest(sum(CASE WHEN j % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * j * j * lam2)), 0), 1) END
    AS p_value
  FROM (SELECT *, ks * ks * n_base * n_live / (n_base + n_live) AS lam2 FROM ks),
    (SELECT unnest(range(1, 101)) AS j) GROUP BY ALL
)""", body="""
SELECT *, CASE WHEN p_value < 0.01 THEN 'ALERT' WHEN p_value < 0.05 THEN 'WARN' ELSE 'OK' END
  AS status FROM tested"""), dbl="ks p_value")
TIERS = ["low", "medium", "high"]
MIX = ("mix AS (SELECT batch, count(*) AS n, " + ", ".join(
    f"count(*) FILTER (risk_tier = '{t}') / count(*) AS share_{t}" for t in TIERS)
    + " FROM batched GROUP BY 1)")
register("k9_tier_mix_shift", lambda spark, sf: drift.tier_mix(batches(spark, sf)),
         with_ctes(SCORED, paired([]), MIX, body="SELECT m.*, " + ", ".join(
             f"m.share_{t} - b.share_{t} AS shift_{t}" for t in TIERS)
             + " FROM mix AS m, mix AS b WHERE b.batch = 'baseline'"),
         dbl=" ".join(f"share_{t} shift_{t}" for t in TIERS))
KPIS = """
kpis AS (SELECT batch, count(*) AS n, avg(is_canceled) AS cancel_rate,
  avg(CASE WHEN cancel_probability >= 0.41 THEN 1 ELSE 0 END) AS flagged_rate,
  avg(cancel_probability) AS mean_probability, avg(adr) AS mean_adr,
  avg(revenue_at_risk) AS mean_revenue,
  avg(CASE WHEN risk_tier = 'high' THEN 1 ELSE 0 END) AS high_share FROM batched GROUP BY 1)"""
register("k10_batch_kpis", lambda spark, sf: drift.batch_kpis(batches(spark, sf), T),
         with_ctes(SCORED, paired([]), KPIS, body="SELECT * FROM kpis"),
         dbl="cancel_rate flagged_rate mean_probability mean_adr mean_revenue high_share")


def shifted(spark, sf):
    """Batches whose later months drift, so that the dashboard has something to show."""
    return batches(spark, sf).withColumn(
        "adr", F.col("adr") * F.when(F.col("batch") == "batch_2", 1.3).otherwise(1.0))


RAG = (SCORED, paired([]), """
moved AS (SELECT * REPLACE (adr * CASE WHEN is_live = 1 AND batch = 'batch_2' THEN 1.3::DOUBLE
  ELSE 1 END AS adr) FROM paired)""",
       f"long_num AS ({long_numeric('moved', ['cancel_probability', 'adr'], 'is_live, batch')})",
       psi_numeric_sql("feature, batch"), KPIS, f"""
ece AS (
  SELECT batch, sum(n * abs(f - m)) / sum(n) AS v FROM (
    SELECT batch, floor(round(cancel_probability * 10000) / 1000) AS bin, count(*) AS n,
      avg(is_canceled) AS f, avg(cancel_probability) AS m
    FROM batched WHERE batch <> 'baseline' GROUP BY 1, 2) GROUP BY 1
), deltas AS (
  SELECT a.batch, abs(a.cancel_rate - b.cancel_rate) AS c, abs(a.high_share - b.high_share) AS h
  FROM kpis AS a, kpis AS b WHERE b.batch = 'baseline' AND a.batch <> 'baseline'
), dashboard AS (
  SELECT batch, CASE WHEN feature = 'adr' THEN 'ADR feature PSI' ELSE 'Score PSI' END AS metric,
    psi AS value, {STATUS} AS status, CASE WHEN psi < 0.2 THEN 'Monitor'
      WHEN feature = 'adr' THEN 'Seasonal ADR expected; review cost threshold'
      ELSE 'Review seasonal model recalibration' END AS action FROM psi_num
  UNION ALL SELECT batch, 'Calibration ECE', v, CASE WHEN v > 0.05 THEN 'ALERT' ELSE 'OK' END,
    CASE WHEN v > 0.05 THEN 'Refit isotonic calibrator on recent data' ELSE 'No action' END FROM ece
  UNION ALL SELECT batch, 'Cancel rate delta', c, CASE WHEN c > 0.05 THEN 'WARN' ELSE 'OK' END,
    CASE WHEN c > 0.05 THEN 'Review threshold policy for new base rate' ELSE 'No action' END
    FROM deltas
  UNION ALL SELECT batch, 'High-risk tier delta', h, CASE WHEN h > 0.05 THEN 'WARN' ELSE 'OK' END,
    CASE WHEN h > 0.05 THEN 'Flag to operations team' ELSE 'No action' END FROM deltas
)""")
register("k11_rag_dashboard", lambda spark, sf: drift.rag_dashboard(shifted(spark, sf), T),
         with_ctes(*RAG, body="SELECT * FROM dashboard"), dbl="value")
register("k11_status_counts",
         lambda spark, sf: drift.status_counts(drift.rag_dashboard(shifted(spark, sf), T)),
         with_ctes(*RAG, body="""
SELECT count(*) FILTER (status = 'ALERT') AS n_alert, count(*) FILTER (status = 'WARN') AS n_warn,
  count(*) FILTER (status = 'OK') AS n_ok FROM dashboard"""))
register("k13_probability_bucket_medians",
         lambda spark, sf: stats.probability_medians(
             splits.time_buckets(scored(spark, sf), "arrival_date", KEYS, 4), "bucket",
             "arrival_date", P),
         with_ctes(SCORED, body=f"""
SELECT bucket, min(arrival_date) AS first_day, max(arrival_date) AS last_day, count(*) AS n,
  median(cancel_probability) AS median_score
FROM (SELECT *, ntile(4) OVER (ORDER BY {ORDER_BY}) AS bucket FROM scored) GROUP BY 1"""),
         dbl="median_score")

# --- L ---------------------------------------------------------------------------------------
CHI = ["hotel", "market_segment", "deposit_type", "country", "reserved_room_type"]
register("l1_chi2_cramers_v",
         lambda spark, sf: stats.chi2_independence(cleaned(spark, sf), CHI).drop(
             "p_value", "significant"),
         with_ctes(CLEAN, f"long AS ({long_form('clean', CHI, 'is_canceled')})", """
cells AS (SELECT dimension AS feature, segment, is_canceled, count(*) AS o FROM long GROUP BY ALL),
full_cells AS (
  SELECT feature, segment, y, COALESCE(o, 0) AS o FROM
    (SELECT DISTINCT feature, segment FROM cells) CROSS JOIN (VALUES (0), (1)) AS v(y)
    LEFT JOIN (SELECT feature, segment, is_canceled AS y, o FROM cells) USING (feature, segment, y)
), expected AS (
  SELECT *, CAST(sum(o) OVER (PARTITION BY feature, segment) AS DOUBLE)
      * sum(o) OVER (PARTITION BY feature, y) / sum(o) OVER (PARTITION BY feature) AS e,
    sum(o) OVER (PARTITION BY feature) AS n, count(*) OVER (PARTITION BY feature) // 2 AS k
  FROM full_cells
)""", body="""
SELECT feature, sum(gap * gap / e) AS chi2, CAST(max(k) - 1 AS BIGINT) AS dof,
  CAST(max(n) AS BIGINT) AS n, sqrt(sum(gap * gap / e) / max(n)) AS cramers_v
FROM (SELECT *, CASE WHEN k = 2 THEN abs(o - e) - least(0.5, abs(o - e)) ELSE abs(o - e) END AS gap
  FROM expected) GROUP BY 1"""), dbl="chi2 cramers_v")
register("l1_chi2_p_values",
         lambda spark, sf: stats.chi2_independence(cleaned(spark, sf), CHI).select(
             "feature", "p_value", "significant"))
CORR = NUMERIC_FEATURES
register("l2_target_correlation",
         lambda spark, sf: stats.target_correlation(cleaned(spark, sf), CORR, k=5),
         with_ctes(CLEAN, "r AS (" + " UNION ALL ".join(
             f"SELECT '{c}' AS feature, CASE WHEN stddev_pop({c}) > 0 THEN corr({c}, is_canceled) END AS r FROM clean"
             for c in CORR) + ")", body="SELECT * FROM r ORDER BY abs(r) DESC NULLS LAST, feature LIMIT 5"), dbl="r")
register("l6_fold_summary",
         lambda spark, sf: stats.fold_summary(model_folds(spark, sf), "model",
                                              ["pr_auc", "roc_auc"]),
         with_ctes(MODEL_FOLDS, "long AS (SELECT model, 'pr_auc' AS metric, pr_auc AS v "
                   "FROM model_folds UNION ALL SELECT model, 'roc_auc', roc_auc FROM model_folds)",
                   body="""
SELECT *, mean - 1.96 * std / sqrt(n_folds) AS ci_low, mean + 1.96 * std / sqrt(n_folds) AS ci_high
FROM (SELECT model, metric, count(v) AS n_folds, avg(v) AS mean, stddev_samp(v) AS std,
  stddev_pop(v) AS std_pop, min(v) AS min, max(v) AS max FROM long GROUP BY 1, 2)"""),
         dbl="mean std std_pop min max ci_low ci_high")


def per_supplier(spark, sf):
    return cleaned(spark, sf).groupBy(F.col("supp_key").alias("model")).agg(
        F.round(F.avg("lead_time"), 2).alias("cost"), F.round(F.avg("adr"), 2).alias("gain"),
        F.count(F.lit(1)).alias("n"))


SUPPLIERS = """
suppliers AS (SELECT supp_key AS model, round(avg(lead_time), 2) AS cost,
  round(avg(adr), 2) AS gain, count(*) AS n FROM clean GROUP BY 1)"""
register("l7_pareto_frontier",
         lambda spark, sf: stats.pareto_frontier(per_supplier(spark, sf), "cost", "gain"),
         with_ctes(CLEAN, SUPPLIERS, body="""
SELECT * FROM suppliers AS a WHERE NOT EXISTS (SELECT 1 FROM suppliers AS b
  WHERE b.cost <= a.cost AND b.gain >= a.gain AND (b.cost < a.cost OR b.gain > a.gain))"""))


def _frontier_rows(spark, sf):
    """Skyline over single bookings: short lead time against high rate."""
    return stats.pareto_frontier(
        cleaned(spark, sf).filter("adr IS NOT NULL"), "lead_time", "adr").select(
            *KEYS, "lead_time", "adr")


register("l7_pareto_bookings", _frontier_rows, with_ctes(CLEAN, f"""
best AS (SELECT lead_time, max(adr) AS top FROM clean GROUP BY 1),
front AS (SELECT lead_time, top FROM (SELECT *, max(top) OVER (
    ORDER BY lead_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM best)
  WHERE before IS NULL OR top > before)""", body=f"""
SELECT {', '.join('clean.' + k for k in KEYS)}, clean.lead_time, adr FROM clean JOIN front
ON clean.lead_time = front.lead_time AND adr = top"""))
register("l8_minmax_scale",
         lambda spark, sf: stats.minmax_scale(
             per_supplier(spark, sf).withColumn("same", F.lit(3)),
             {"cost": False, "gain": True, "same": True}),
         with_ctes(CLEAN, SUPPLIERS, body="""
SELECT *, 3 AS same, (max(cost) OVER () - cost) / (max(cost) OVER () - min(cost) OVER ())
    AS cost_scaled,
  (gain - min(gain) OVER ()) / (max(gain) OVER () - min(gain) OVER ()) AS gain_scaled,
  0.5::DOUBLE AS same_scaled FROM suppliers"""), dbl="cost_scaled gain_scaled")
register("l9_rank_normalise",
         lambda spark, sf: stats.rank_normalise(cleaned(spark, sf), "adr").select(
             *KEYS, "adr", "rank_unit"),
         with_ctes(CLEAN, """
ranks AS (SELECT *, rank() OVER (ORDER BY adr) + (count(*) OVER (PARTITION BY adr) - 1) / 2 AS r
  FROM clean WHERE adr IS NOT NULL)""", body=f"""
SELECT {', '.join(KEYS)}, adr, (r - 1) / greatest(max(r) OVER () - 1, 1) AS rank_unit FROM ranks
UNION ALL SELECT {', '.join(KEYS)}, adr, 0.5 FROM clean WHERE adr IS NULL"""), dbl="rank_unit")
register("l10_frequency_code",
         lambda spark, sf: stats.frequency_code(cleaned(spark, sf), "country").groupBy(
             "country", "code").agg(F.count(F.lit(1)).alias("n")),
         with_ctes(CLEAN, body="""
SELECT country, row_number() OVER (ORDER BY n, country) - 1 AS code, n
FROM (SELECT country, count(*) AS n FROM clean GROUP BY 1)"""))
register("l12_distribution_summary",
         lambda spark, sf: stats.distribution_summary(cleaned(spark, sf), "adr")[0],
         with_ctes(CLEAN, body="""
SELECT median(adr) AS median, quantile_cont(adr, 0.95) AS p95, quantile_cont(adr, 0.99) AS p99
FROM clean"""), dbl="median p95 p99")
register("l12_clipped_histogram",
         lambda spark, sf: stats.distribution_summary(cleaned(spark, sf), "lead_time", 20)[1],
         with_ctes(CLEAN, "cap AS (SELECT quantile_cont(lead_time, 0.99) AS hi, "
                   "min(lead_time) AS lo FROM clean)", body="""
SELECT least(CAST(floor((least(lead_time, hi) - lo) / (hi - lo) * 20) AS BIGINT), 19) AS bin,
  count(*) AS n, count(*) / (sum(count(*)) OVER () * (max(hi) - max(lo)) / 20) AS density
FROM clean, cap GROUP BY 1"""), dbl="density")
