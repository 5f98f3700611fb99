"""Queries of the model, resampling, price, gate, scoring and streaming operators."""

from __future__ import annotations

import functools

from pyspark.sql import functions as F

from ..config import BOOST_DEPTH, BOOST_ROUNDS, CATEGORICAL_FEATURES, NUMERIC_FEATURES, SEGMENT_DIMENSIONS, TARGET
from ..ml import fits, models
from ..operators import adr, drift, gates, metrics, ordering, segments, splits, thresholds
from ..operators.metrics import P, Y
from ..plans import scoring
from ..session import input_state, lasting, scratch_path, written_table
from ..sources.star_schema import KEYS, POLICIES, cleaned, scored
from ..streaming import jobs
from .base import CLEAN, SCORED, auc_sql, confusion_sql, long_form, register, with_ctes
from .evaluation import PREDICTED, SPLIT, predictions, split_scored, test_rows

KEY_SQL = ", ".join(KEYS)
CATS, NUMS = CATEGORICAL_FEATURES, NUMERIC_FEATURES
# The rate itself and what is computed from it are no inputs of its forecast.
ADR_NUMS = [c for c in NUMS if c not in ("adr", "adr_per_person", "revenue_at_risk")]
GATED = list(SEGMENT_DIMENSIONS)
# Stricter than the standing gates, so that some segments of the test data fall short.
STRICT = [("roc_auc", 0.93), ("pr_auc", 0.86), ("f1", 0.80)]

# Size of the registered fits of the first boosted family, and the (depth, rounds) that its curves compare:
# rounds at its depth, depths at its rounds.
SIZE = {"rounds": BOOST_ROUNDS, "depth": BOOST_DEPTH}
GRID = [*[(BOOST_DEPTH, r) for r in (50, 100, 200, 300)], *[(d, BOOST_ROUNDS) for d in (2, 3, 7)]]

# --- M, deterministic parts ---------------------------------------------------------------
register("m1_rare_levels",
         lambda spark, sf: models.level_counts(cleaned(spark, sf), CATS, 0.03),
         with_ctes(CLEAN, f"long AS ({long_form('clean', CATS, '1 AS x')})", body="""
SELECT *, share >= 0.03 AS kept FROM (SELECT dimension AS feature, segment AS level, count(*) AS n,
  count(*) / sum(count(*)) OVER (PARTITION BY dimension) AS share FROM long GROUP BY 1, 2)"""),
         dbl="share")
register("m2_class_ratio", lambda spark, sf: models.class_ratio(cleaned(spark, sf)),
         with_ctes(CLEAN, body="""
SELECT count(*) FILTER (is_canceled = 1) AS n_pos, count(*) FILTER (is_canceled = 0) AS n_neg,
  count(*) FILTER (is_canceled = 0) / count(*) FILTER (is_canceled = 1) AS ratio FROM clean"""),
         dbl="ratio")
register("m6_calibration_report",
         lambda spark, sf: models.calibration_report(
             split_scored(spark, sf).filter("split != 'train'"), [P, "rival_probability"]),
         with_ctes(SPLIT, """
long AS (SELECT split, 'cancel_probability' AS kind, is_canceled AS y, cancel_probability AS p
  FROM split_scored UNION ALL SELECT split, 'rival_probability', is_canceled, rival_probability
  FROM split_scored)""", body="""
SELECT split, kind, brier, ece FROM (SELECT split, kind, avg((p - y) ** 2) AS brier FROM long
  GROUP BY 1, 2) JOIN (SELECT split, kind, sum(n * abs(f - m)) / sum(n) AS ece FROM (
    SELECT split, kind, floor(round(p * 10000) / 1000) AS bin, count(*) AS n, avg(y) AS f,
      avg(p) AS m FROM long GROUP BY 1, 2, 3) GROUP BY 1, 2) USING (split, kind)
WHERE split <> 'train'"""), dbl="brier ece")
COEF = {"lead_time": 0.004, "total_stay": -0.05, "previous_cancellations": 0.6,
        "total_of_special_requests": -0.3, "total_guests": 0.02}
RAW = ["lead_time", "total_stay", "total", "previous_cancellations", "previous"]


def _terms(spark, sf):
    return models.attribution_terms(cleaned(spark, sf), COEF, KEYS)


def _by_feature(spark, sf):
    return models.attribution_by_feature(_terms(spark, sf), RAW, KEYS)


MEANS = ("means AS (SELECT " + ", ".join(f"avg({c}) AS {c}" for c in COEF) + " FROM clean)")
TERMS = ("terms AS (" + " UNION ALL ".join(
    f"SELECT {', '.join('clean.' + k for k in KEYS)}, '{c}' AS encoded, "
    f"{w}::DOUBLE * (clean.{c} - means.{c}) AS contribution FROM clean, means"
    for c, w in COEF.items()) + ")")
BY_FEATURE = f"""
by_feature AS (SELECT {KEY_SQL}, CASE encoded WHEN 'total_of_special_requests' THEN 'total'
    WHEN 'total_guests' THEN 'total' ELSE encoded END AS feature,
  sum(contribution) AS contribution FROM terms GROUP BY ALL),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL}
  ORDER BY abs(contribution) DESC, feature) AS rank FROM by_feature) WHERE rank <= 3)"""
register("m14_attribution_ranking",
         lambda spark, sf: models.attribution_ranking(_by_feature(spark, sf)),
         with_ctes(CLEAN, MEANS, TERMS, BY_FEATURE, body="""
SELECT feature, avg(abs(contribution)) AS mean_abs FROM by_feature GROUP BY 1"""), dbl="mean_abs")
register("m14_top_contributions",
         lambda spark, sf: models.top_of_terms(_terms(spark, sf), RAW, KEYS, 3).groupBy(
             "feature", "rank").agg(F.count(F.lit(1)).alias("n"),
                                    F.sum("contribution").alias("total")),
         with_ctes(CLEAN, MEANS, TERMS, BY_FEATURE, body="""
SELECT feature, rank, count(*) AS n, sum(contribution) AS total FROM top GROUP BY 1, 2"""),
         dbl="total:4")
register("m20_contribution_waterfall",
         lambda spark, sf: models.top_of_terms(_terms(spark, sf), RAW, KEYS, 3, 0.3).groupBy(
                 "rank").agg(F.count(F.lit(1)).alias("n"), F.avg("running").alias("running")),
         with_ctes(CLEAN, MEANS, TERMS, BY_FEATURE, body=f"""
SELECT rank, count(*) AS n, avg(running) AS running FROM (SELECT rank, 0.3::DOUBLE
  + sum(contribution) OVER (PARTITION BY {KEY_SQL} ORDER BY rank) AS running FROM top)
GROUP BY 1"""), dbl="running")
TOGETHER = [P, "rival_probability"]
register("m16_ensemble_spread",
         lambda spark, sf: models.ensemble_spread(scored(spark, sf), TOGETHER).orderBy(
             F.desc("spread"), *KEYS).limit(50).select(*KEYS, "spread", "mean_score"),
         with_ctes(SCORED, body=f"""
SELECT {KEY_SQL}, abs(cancel_probability - rival_probability) AS spread,
  (cancel_probability + rival_probability) / 2 AS mean_score FROM scored
ORDER BY abs(cancel_probability - rival_probability) DESC, {KEY_SQL} LIMIT 50"""),
         dbl="spread mean_score")
register("m16_ensemble_metrics",
         lambda spark, sf: metrics.auc_metrics(
             models.ensemble_spread(scored(spark, sf), TOGETHER), p="mean_score"),
         with_ctes(SCORED, "mixed AS (SELECT is_canceled, (cancel_probability "
                   "+ rival_probability) / 2 AS mean_score FROM scored)",
                   auc_sql("mixed", p="mean_score"), body="SELECT * FROM aucs"),
         dbl="roc_auc pr_auc")


def _encodings(spark, sf):
    df = cleaned(spark, sf)
    top = [r[0] for r in ordering.top_categories(df, {"country": 20}).select("segment").collect()]
    return df.groupBy(models.ablation_region(F.col("country"), top).alias("country_top20")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"))


register("m17_ablation_encodings", _encodings, with_ctes(CLEAN, """
best AS (SELECT country FROM (SELECT country, count(*) AS n FROM clean GROUP BY 1)
  ORDER BY n DESC, country LIMIT 20)""", body="""
SELECT CASE WHEN country IN (SELECT country FROM best) THEN country ELSE 'Other' END
  AS country_top20, count(*) AS n, avg(is_canceled) AS cancel_rate FROM clean GROUP BY 1"""),
    dbl="cancel_rate")

# --- M, fitted models ---------------------------------------------------------------------


def shared(fn):
    """What several queries use is made once for a session and the state of its tables.

    It is kept for the last few states only, and made outside the scope of the query at work, so
    that releasing one query's tables leaves it to the others.
    """
    kept = {}

    @functools.wraps(fn)
    def run(spark, sf, *args):
        tables = ("lineitem", "orders", "customer", "part", "nation")
        key = (spark.sparkContext.applicationId, sf, *args, *[input_state(spark, f"{sf}/{t}.parquet") for t in tables])
        if key not in kept:
            while len(kept) >= 64:
                kept.pop(next(iter(kept)))
            kept[key] = lasting(fn)(spark, sf, *args)
        return kept[key]
    return run


@shared
def whole(spark, sf):
    """Bookings with their splits, the columns of the models, and the raw categories; written once."""
    names = dict.fromkeys([*KEYS, "arrival_date", TARGET, *CATS, *NUMS, "split"])
    # Dealt by rows: left to their bytes, the rows of a split lie in one or two files, read by as many tasks.
    parts = models.fit_parts(spark, spark.read.parquet(f"{sf}/lineitem.parquet").count())
    return written_table(split_scored(spark, sf).select(*names).repartition(parts), "model-rows")


@shared
def prepared(spark, sf):
    """The model table: rare levels merged as the training rows have them; read by every fit."""
    df = whole(spark, sf)
    return written_table(models.merge_rare(df, models.kept_levels(df.filter("split = 'train'"), CATS)), "model-table")


def part(spark, sf, name):
    return prepared(spark, sf).filter(F.col("split") == name)


@shared
def fitted(spark, sf, family):
    return models.fit_family(part(spark, sf, "train"), family, CATS, NUMS, part(spark, sf, "val"))


def fitted_together(spark, sf, families):
    """Fits the families at once, as far as they are to be held: between the jobs of one, the others use the cores."""
    return fits.by_family([(f, lambda f=f: fitted(spark, sf, f)) for f in families], part(spark, sf, "train").count())


def family_scores(spark, sf, families, split="test"):
    """Metrics of several families on one split."""
    fitted_together(spark, sf, families)
    rows = None
    for family in families:
        s = models.score(fitted(spark, sf, family), part(spark, sf, split), NUMS)
        one = metrics.threshold_metrics(s, 0.5).withColumn("family", F.lit(family))
        rows = one if rows is None else rows.unionByName(one)
    return rows


BOOSTED, BASELINES = models.BOOSTED, models.BASELINES
register("m3_fit_gbt", lambda spark, sf: family_scores(spark, sf, BOOSTED))
register("m4_fit_baselines", lambda spark, sf: family_scores(spark, sf, BASELINES).unionByName(
    metrics.threshold_metrics(models.score_majority(
        part(spark, sf, "train"), part(spark, sf, "test")), 0.5).withColumn(
            "family", F.lit("majority"))))


LADDER = ["majority", "naive_bayes", "decision_tree", "logistic", "random_forest", *BOOSTED]


def _ladder(spark, sf):
    """Each step of the ladder of models with its gain over the step before."""
    rows = family_scores(spark, sf, LADDER[1:]).unionByName(metrics.threshold_metrics(
        models.score_majority(part(spark, sf, "train"), part(spark, sf, "test")), 0.5).withColumn(
            "family", F.lit("majority")))
    rows = rows.withColumn("step", ordering.domain_rank("family", LADDER))
    before = rows.select((F.col("step") + 1).alias("step"), F.col("pr_auc").alias("_before"))
    return rows.join(before, "step", "left").select(
        "step", "family", "roc_auc", "pr_auc", "f1", (F.col("pr_auc") - F.col("_before")).alias("gain"))


register("m9_baseline_ladder", _ladder)


def _calibrated(spark, sf):
    model = fitted(spark, sf, "gradient_boosting")
    iso = models.fit_isotonic(models.score(model, part(spark, sf, "val"), NUMS))
    return models.calibrate(iso, models.score(model, part(spark, sf, "test"), NUMS))


register("m5_isotonic_calibrate",
         lambda spark, sf: models.calibration_report(_calibrated(spark, sf), [P, "calibrated"]))


def _protocols(spark, sf):
    """Ten stratified folds against all rolling ones, on the same model."""
    # Written once: every fit reads it several times.
    df = written_table(splits.stratified_folds(prepared(spark, sf), KEYS, 10), "model-folds")
    cells = [("stratified", df.filter(F.col("fold") != k), df.filter(F.col("fold") == k))
             for k in range(1, 11)]
    cuts, folds = splits.fold_cuts(df, "arrival_date", KEYS, splits.rolling_folds)
    cells += [("chronological", *splits.fold_parts(df, cuts, f)) for f in folds]
    def cell(protocol, train, test):
        m = models.fit_family(train, "logistic", CATS, NUMS)
        return protocol, metrics.auc_metrics(models.score(m, test, NUMS)).first()["pr_auc"]

    results = fits.together([lambda c=c: cell(*c) for c in cells], fits.at_once(df.count()))
    rows = spark.createDataFrame(results, "protocol string, pr_auc double")
    return rows.groupBy("protocol").agg(F.count(F.lit(1)).alias("folds"),
                                        F.avg("pr_auc").alias("mean"),
                                        F.stddev_samp("pr_auc").alias("std"))


register("m12_cv_protocol_compare", _protocols)
register("m13_score_batch",
         lambda spark, sf: _calibrated(spark, sf).select(*KEYS, P, "calibrated"))
register("m15_split_importance", lambda spark, sf: models.split_importance(
    fitted(spark, sf, "gradient_boosting"),
    models.as_numbers(part(spark, sf, "test"), NUMS), [*CATS, *NUMS]))
register("m18_counterfactual_counts", lambda spark, sf: models.flip_counts(
    fitted(spark, sf, "logistic"), part(spark, sf, "test"),
    {"lead_time": F.lit(7), "deposit_type": F.lit("Refundable"), "adr": F.col("adr") * 0.9,
     "total_of_special_requests": F.col("total_of_special_requests") + 1,
     "required_car_parking_spaces": F.lit(1), "market_segment": F.lit("Direct"),
     "is_repeated_guest": F.lit(1), "previous_cancellations": F.lit(0)}, NUMS, 0.4))

# --- L3-L5: resampling ----------------------------------------------------------------------


def _boot(spark, sf):
    return models.bootstrap_aucs(scored(spark, sf), TOGETHER, threshold=POLICIES["max_f1"])


register("l3_bootstrap_ci", lambda spark, sf: models.bootstrap_ci(_boot(spark, sf)))
register("l4_paired_bootstrap", lambda spark, sf: models.paired_delta(_boot(spark, sf), P))


def _family_intervals(spark, sf):
    """Both AUCs and F1 of every family on the test rows with bootstrap intervals."""
    df, families = part(spark, sf, "test"), [*BOOSTED, *BASELINES]
    fitted_together(spark, sf, families)
    for family in families:
        df = models.score(fitted(spark, sf, family), df, NUMS, family)
    return models.bootstrap_ci(models.bootstrap_aucs(df, families))


register("m19_family_comparison", _family_intervals)


# --- N -----------------------------------------------------------------------------------------


@shared
def rate_rows(spark, sf):
    return models.rate_rows(part(spark, sf, "train"), CATS, ADR_NUMS)


@shared
def fitted_adr(spark, sf, family):
    return models.fit_rate(rate_rows(spark, sf), family)


def _adr_metrics(spark, sf):
    known = rate_rows(spark, sf)
    families = models.REGRESSORS
    fitted = dict(zip(families, fits.by_family([(f, lambda f=f: fitted_adr(spark, sf, f)) for f in families], known.n_rows)))
    # Written once: the metrics of a family read its forecasts several times.
    scores = models.score_rates(known, fitted, prepared(spark, sf).select("split", "adr", *CATS, *ADR_NUMS), ADR_NUMS)
    scores = written_table(scores.select("split", "adr", *families), "rate-scores")
    long = ordering.unpivot(scores, families, ["split", "adr"], ("family", "predicted_adr"), "double")
    found = metrics.regression_metrics(long, "adr", "predicted_adr", ["split", "family"])
    return found.select(*[c for c in found.columns if c != "family"], "family")


register("n1_fit_adr", _adr_metrics)
register("n2_score_adr", lambda spark, sf: models.score_adr(
    fitted_adr(spark, sf, "decision_tree"), part(spark, sf, "test"), ADR_NUMS).select(
        *KEYS, "adr", "predicted_adr"))
register("n3_adr_residuals",
         lambda spark, sf: models.adr_residuals(predictions(spark, sf)).groupBy("hotel").agg(
             F.count("residual").alias("n"), F.avg("residual").alias("mean_residual"),
             F.max("abs_residual").alias("worst")),
         with_ctes(PREDICTED, body="""
SELECT hotel, count(adr) AS n, avg(round(adr - predicted_adr, 2)) AS mean_residual,
  max(round(abs(adr - predicted_adr), 2)) AS worst FROM predictions GROUP BY 1"""),
         dbl="mean_residual:3 worst:2")
register("n4_adr_segment_errors",
         lambda spark, sf: adr.segment_errors(predictions(spark, sf),
                                              ["hotel", "reserved_room_type"]),
         with_ctes(PREDICTED, body="""
SELECT hotel, reserved_room_type, count(*) AS n, sqrt(avg((adr - predicted_adr) ** 2)) AS rmse,
  avg(abs(adr - predicted_adr)) AS mae, avg(adr) AS mean_actual,
  avg(predicted_adr) AS mean_predicted
FROM predictions WHERE adr IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 50"""),
         dbl="rmse mae mean_actual mean_predicted")
register("n5_monthly_residual", lambda spark, sf: adr.monthly_residual(predictions(spark, sf)),
         with_ctes(PREDICTED, body="""
SELECT date_trunc('month', arrival_date)::DATE AS month, count(*) AS n,
  avg(adr - predicted_adr) AS mean_residual FROM predictions WHERE adr IS NOT NULL GROUP BY 1"""),
         dbl="mean_residual")
register("n5_residual_histogram", lambda spark, sf: adr.residual_histogram(predictions(spark, sf)),
         with_ctes(PREDICTED, body="""
SELECT CAST(floor((adr - predicted_adr) / 10) * 10 AS DOUBLE) AS bin, count(*) AS n
FROM predictions WHERE adr IS NOT NULL GROUP BY 1"""))


def _overfit(spark, sf):
    late = F.col("arrival_date") >= "2000-01-01"
    e2 = F.pow(F.col("adr") - F.col("predicted_adr"), 2)
    per = predictions(spark, sf).groupBy(F.col("deposit_type").alias("model")).agg(
        F.sqrt(F.avg(F.when(~late, e2))).alias("train_rmse"),
        F.sqrt(F.avg(F.when(late, e2))).alias("test_rmse"))
    return adr.overfit_gap(per)


register("n6_overfit_gap", _overfit, with_ctes(PREDICTED, body="""
SELECT *, test_rmse - train_rmse AS gap, test_rmse / train_rmse AS ratio FROM (
  SELECT deposit_type AS model,
    sqrt(avg((adr - predicted_adr) ** 2) FILTER (arrival_date < DATE '2000-01-01')) AS train_rmse,
    sqrt(avg((adr - predicted_adr) ** 2) FILTER (arrival_date >= DATE '2000-01-01')) AS test_rmse
  FROM predictions GROUP BY 1)"""), dbl="train_rmse test_rmse gap ratio")

# --- O -----------------------------------------------------------------------------------------


def _metric_table(spark, sf):
    m = metrics.threshold_metrics(scored(spark, sf), POLICIES["max_f1"])
    names = ["roc_auc", "pr_auc", "f1", "recall"]
    return ordering.unpivot(m, names, [F.lit("max_f1").alias("policy")], ("metric", "value"),
                            "double")


register("o1_metric_gates", lambda spark, sf: gates.metric_gates(_metric_table(spark, sf)),
         with_ctes(SCORED, auc_sql("scored"), f"counts AS (SELECT {confusion_sql(0.41)} "
                   "FROM scored)", """
m AS (SELECT 'roc_auc' AS metric, roc_auc AS value FROM aucs UNION ALL SELECT 'pr_auc', pr_auc
  FROM aucs UNION ALL SELECT 'f1', 2 * tp / (2 * tp + fp + fn) FROM counts
  UNION ALL SELECT 'recall', tp / (tp + fn) FROM counts)""", body="""
SELECT policy, metric, minimum, value, COALESCE(value >= minimum, false) AS passed
FROM (VALUES ('max_f1', 'roc_auc', 0.84::DOUBLE), ('max_f1', 'pr_auc', 0.74::DOUBLE),
  ('max_f1', 'f1', 0.71::DOUBLE), ('max_f1', 'recall', 0.82::DOUBLE),
  ('high_precision', 'precision', 0.98::DOUBLE), ('high_precision', 'recall', 0.07::DOUBLE))
  AS g(policy, metric, minimum)
LEFT JOIN (SELECT 'max_f1' AS policy, * FROM m) USING (policy, metric)"""), dbl="value minimum")
register("o2_segment_gates",
         lambda spark, sf: gates.segment_gates(
             segments.segment_metrics(scored(spark, sf), 0.41, SEGMENT_DIMENSIONS, min_rows=100), STRICT),
         with_ctes(SCORED, f"long AS ({long_form('scored', GATED, 'is_canceled, cancel_probability')})",
                   auc_sql("long", "dimension, segment"), f"""
counts AS (SELECT dimension, segment, {confusion_sql(0.41)} FROM long GROUP BY 1, 2
  HAVING count(*) >= 100)""", """
m AS (SELECT dimension, segment, 'roc_auc' AS metric, roc_auc AS value, {roc}::DOUBLE AS minimum
    FROM aucs JOIN counts USING (dimension, segment)
  UNION ALL SELECT dimension, segment, 'pr_auc', pr_auc, {pr}
    FROM aucs JOIN counts USING (dimension, segment)
  UNION ALL SELECT dimension, segment, 'f1', 2 * tp / (2 * tp + fp + fn), {f1} FROM counts)""".format(
                       roc=STRICT[0][1], pr=STRICT[1][1], f1=STRICT[2][1]),
                   body="""
SELECT *, 'below_minimum' AS problem FROM m WHERE value < minimum"""), dbl="value minimum")


def _sync(spark, sf):
    """Thresholds chosen on all rows against those chosen on the city hotel alone."""
    def chosen(df):
        f1 = thresholds.select_max_f1(thresholds.threshold_sweep(df))
        price = thresholds.select_min_cost(thresholds.cost_sweep(df))
        return f1.select(F.lit("max_f1").alias("policy"), "threshold").unionByName(
            price.select(F.lit("cost_sensitive").alias("policy"), "threshold"))

    df = scored(spark, sf)
    return gates.threshold_sync(chosen(df), chosen(df.filter("hotel = 'City Hotel'")))


def _chosen_sql(name, where):
    rows = f"(SELECT * FROM scored {where})"
    return f"""
{name} AS (
  SELECT 'max_f1' AS policy, threshold FROM (SELECT threshold,
      2 * count(*) FILTER (cancel_probability >= threshold AND is_canceled = 1)
        / (count(*) FILTER (cancel_probability >= threshold) + count(*) FILTER (is_canceled = 1))
      AS f1 FROM {rows}, grid GROUP BY 1 ORDER BY f1 DESC, threshold LIMIT 1)
  UNION ALL SELECT 'cost_sensitive', threshold FROM (SELECT threshold,
      15 * count(*) FILTER (cancel_probability >= threshold AND is_canceled = 0)
      + COALESCE(sum(fn_cost) FILTER (cancel_probability < threshold AND is_canceled = 1), 0)
      AS total FROM {rows}, grid GROUP BY 1 ORDER BY total, threshold LIMIT 1)
)"""


register("o3_threshold_sync", _sync, with_ctes(
    SCORED, "grid AS (SELECT round(k / 100.0::DOUBLE, 4) AS threshold FROM range(100) AS r(k))",
    _chosen_sql("a", ""), _chosen_sql("b", "WHERE hotel = 'City Hotel'"), body="""
SELECT policy, a.threshold AS threshold_a, b.threshold AS threshold_b,
  abs(a.threshold - b.threshold) <= 1e-6 AS in_sync FROM a JOIN b USING (policy)"""))


def _deltas(spark, sf):
    """Two runs of a summary, the second of which has drifted in one hotel."""
    run = lambda df: df.groupBy("hotel", "deposit_type").agg(
        F.round(F.avg("adr"), 6).alias("adr"), F.round(F.avg("lead_time"), 6).alias("lead"))
    df = cleaned(spark, sf)
    moved = df.withColumn("adr", F.when(F.col("hotel") == "City Hotel", F.col("adr") + 0.5)
                          .otherwise(F.col("adr")))
    return gates.table_delta(run(df), run(moved), ["hotel", "deposit_type"], ["adr", "lead"])


register("o4_table_delta", _deltas, with_ctes(CLEAN, """
runs AS (SELECT hotel, deposit_type, round(avg(adr), 6) AS a1,
  round(avg(adr + CASE WHEN hotel = 'City Hotel' THEN 0.5 ELSE 0 END), 6) AS a2,
  round(avg(lead_time), 6) AS l FROM clean GROUP BY 1, 2)""", body="""
SELECT hotel, deposit_type, 'adr' AS name, a1 AS left_value, a2 AS right_value,
  abs(a1 - a2) AS delta, abs(a1 - a2) > 1e-6 AS unstable FROM runs
UNION ALL SELECT hotel, deposit_type, 'lead', l, l, 0, false FROM runs"""),
    dbl="left_value:5 right_value:5 delta:5")


def _dedup(spark, sf):
    """The same summary with and without exact copies of the feature rows."""
    cols = ["hotel", "deposit_type", "customer_type", "adults", "lead_time", TARGET]
    df = cleaned(spark, sf).select(*cols)
    sizes = lambda d, n: d.agg(F.lit(n).alias("variant"), F.count(F.lit(1)).alias("n"),
                               F.avg(Y).alias("cancel_rate"))
    return sizes(df, "full").unionByName(sizes(df.dropDuplicates(), "deduplicated"))


register("o5_dedup_sensitivity", _dedup, with_ctes(CLEAN, """
part AS (SELECT hotel, deposit_type, customer_type, adults, lead_time, is_canceled FROM clean)""",
    body="""
SELECT 'full' AS variant, count(*) AS n, avg(is_canceled) AS cancel_rate FROM part
UNION ALL SELECT 'deduplicated', count(*), avg(is_canceled) FROM (SELECT DISTINCT * FROM part)"""),
    dbl="cancel_rate")


# --- P -----------------------------------------------------------------------------------------
register("p1_score_and_enrich",
         lambda spark, sf: scoring.enrich_scores(
             predictions(spark, sf), POLICIES, "max_f1_fallback").groupBy(
                 "risk_tier", "label_max_f1", "cost_threshold_source",
                 "cost_threshold_fallback_used").agg(
                 F.count(F.lit(1)).alias("n"), F.sum(F.size("alerts")).alias("alerts"),
                 F.sum(F.size("drivers")).alias("drivers"),
                 F.avg("adr_residual").alias("residual")),
         with_ctes(PREDICTED, body="""
SELECT risk_tier, CASE WHEN cancel_probability >= 0.41 THEN 1 ELSE 0 END AS label_max_f1,
  'max_f1_fallback' AS cost_threshold_source, true AS cost_threshold_fallback_used, count(*) AS n,
  count(*) AS alerts, CAST(sum(least(5, greatest(1,
    CASE WHEN deposit_type = 'Non Refund' THEN 1 ELSE 0 END
    + CASE WHEN lead_time >= 120 THEN 1 ELSE 0 END + 1 - is_repeated_guest
    + CASE WHEN total_of_special_requests = 0 THEN 1 ELSE 0 END
    + 1 - required_car_parking_spaces
    + CASE WHEN previous_cancellations > 0 THEN 1 ELSE 0 END))) AS BIGINT) AS drivers,
  avg(round(adr - predicted_adr, 2)) AS residual
FROM predictions GROUP BY ALL"""), dbl="residual:3")
register("p2_export_scored_test",
         lambda spark, sf: scoring.scored_export(
             test_rows(spark, sf), POLICIES).select(
                 *KEYS, P, "risk_tier", *[f"predicted_cancel_{n}" for n in POLICIES]),
         with_ctes(SPLIT, body=f"""
SELECT {KEY_SQL}, cancel_probability, risk_tier, """ + ", ".join(
             f"CASE WHEN cancel_probability >= {t} THEN 1 ELSE 0 END AS predicted_cancel_{n}"
             for n, t in POLICIES.items()) + " FROM test"))

# --- Q -----------------------------------------------------------------------------------------


def _out(spark, label):
    base = scratch_path(spark, label)
    return f"{base}/out", f"{base}/checkpoint"


def _stream_append(spark, sf):
    out, checkpoint = _out(spark, "stream-scores")
    label = lambda batch: batch.withColumn("large", (F.col("value") >= 100).cast("int"))
    jobs.drain_batches(jobs.event_stream(spark, sf), jobs.batch_folder(out, label), checkpoint)
    return spark.read.parquet(out).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("large").alias("n_large"))


register("q1_stream_score_append", _stream_append, """
SELECT event_type, count(*) AS n, count(*) FILTER (value >= 100) AS n_large FROM events
GROUP BY 1""")


def _stream_kpis(spark, sf):
    """Daily figures of all windows, open ones as they stand; a later batch replaces a day."""
    out, checkpoint = _out(spark, "stream-kpis")
    days = jobs.kpi_windows(jobs.event_stream(spark, sf))
    jobs.drain_batches(days, jobs.day_folders(out), checkpoint, "update")
    schema = "event_type string, n bigint, total double, n_large bigint, day date"
    return spark.read.schema(schema).parquet(out)


register("q2_stream_kpi_tumbling", _stream_kpis, """
SELECT ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 2) + 0 AS total,
  count(*) FILTER (value >= 100) AS n_large FROM events GROUP BY 1, 2""", money="total")


def _stream_drift(spark, sf):
    """Each batch of the stream against the first week of the table."""
    out, checkpoint = _out(spark, "stream-drift")
    base = spark.read.parquet(f"{sf}/events.parquet").filter("ts < TIMESTAMP_NTZ '2024-01-08'")

    def compare(batch):
        both = drift.mark_live(base.select("value"), batch.select("value"))
        return drift.psi_numeric(drift.long_numeric(both, ["value"]))

    jobs.drain_batches(jobs.event_stream(spark, sf), jobs.batch_folder(out, compare), checkpoint)
    return spark.read.parquet(out).withColumn("zone", drift.psi_zone(F.col("psi")))


register("q3_stream_drift", _stream_drift)


def _stream_dedup(spark, sf):
    out, checkpoint = _out(spark, "stream-dedup")
    jobs.drain(jobs.dedup(jobs.event_stream(spark, sf), ["user_id", "event_type"]), out, checkpoint)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


register("q4_stream_dedup_log", _stream_dedup, """
SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1""")
