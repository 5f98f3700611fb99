"""Queries of the ordering operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import cost, metrics, ordering, splits
from ..operators.ordering import CutKeys
from ..sources.star_schema import KEYS, bookings, cleaned, scored
from .base import BOOKINGS, CLEAN, ORDER_BY, POSITIONED, SCORED, register, with_ctes

TIERS = ["low", "medium", "high"]


def flagship(spark, sf):
    df = scored(spark, sf)
    test = splits.time_rows(df, "arrival_date", KEYS, "test")
    return cost.tier_business_summary(test)


register("flagship_test_tier_summary", flagship, with_ctes(POSITIONED, body="""
SELECT COALESCE(risk_tier, 'all') AS risk_tier, count(*) AS n,
  avg(cancel_probability) AS mean_probability, avg(is_canceled) AS cancel_rate,
  avg(adr) AS mean_adr, avg(revenue_at_risk) AS mean_revenue,
  sum(revenue_at_risk) AS total_revenue,
  100.0 * count(*) / max(n_test) AS share_pct
FROM (SELECT *, count(*) OVER () AS n_test FROM positioned
      WHERE position >= CAST(floor(n_all * 0.8::DOUBLE) AS BIGINT) + CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT))
GROUP BY ROLLUP (risk_tier)"""),
    dbl="mean_probability cancel_rate mean_adr mean_revenue share_pct", money="total_revenue")


def _position(spark, sf):
    df = cleaned(spark, sf)
    return ordering.global_position(df, "arrival_date", KEYS).select(*KEYS, "position")


KEY_SQL = "order_key, line_no, part_key, supp_key, list_price"
register("b1_global_position", _position, with_ctes(POSITIONED, body=f"""
SELECT {KEY_SQL}, position FROM positioned"""))


def _prefix(spark, sf):
    groups = metrics.score_groups(scored(spark, sf))
    levels = [ordering.slice_of(F.col("score"))]
    sums = {"cum_pos": F.col("pos"), "cum_neg": F.col("neg")}
    return ordering.running_sums(groups, [F.asc("score")], sums, levels)


register("b2_ordered_prefix_sum", _prefix, with_ctes(SCORED, body="""
SELECT score, pos, neg, CAST(sum(pos) OVER (ORDER BY score) AS BIGINT) AS cum_pos,
  CAST(sum(neg) OVER (ORDER BY score) AS BIGINT) AS cum_neg
FROM (SELECT cancel_probability AS score, count(*) FILTER (is_canceled = 1) AS pos,
        count(*) FILTER (is_canceled = 0) AS neg FROM scored GROUP BY 1)"""))


def _buckets(spark, sf):
    df = splits.time_buckets(cleaned(spark, sf), "arrival_date", KEYS, 7)
    return df.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min("arrival_date").alias("first_day"),
        F.max("arrival_date").alias("last_day"), F.sum("order_key").alias("key_sum"))


register("b3_equal_buckets", _buckets, with_ctes(CLEAN, body=f"""
SELECT bucket, count(*) AS n, min(arrival_date) AS first_day, max(arrival_date) AS last_day,
  CAST(sum(order_key) AS BIGINT) AS key_sum
FROM (SELECT *, ntile(7) OVER (ORDER BY {ORDER_BY}) AS bucket FROM clean) GROUP BY 1"""))


# Without a file order to rely on, the key gives the order in which rows are taken.
HEAD = ["order_key", "line_no", "part_key", "supp_key", "list_price", "booking_date"]
register("b4_head_rows",
         lambda spark, sf: ordering.head_rows(bookings(spark, sf), HEAD, 500).select(
             *KEYS, "hotel", "adr"),
         with_ctes(BOOKINGS, body=f"""
SELECT {KEY_SQL}, hotel, adr FROM bookings
ORDER BY {', '.join(HEAD)} LIMIT 500"""), dbl="adr")

register("b5_topk_by_value",
         lambda spark, sf: ordering.top_k(
             cleaned(spark, sf).filter("revenue_at_risk IS NOT NULL"), 50,
             F.desc("revenue_at_risk"), *[F.asc(k) for k in KEYS]
         ).select(*KEYS, "revenue_at_risk"),
         with_ctes(CLEAN, body=f"""
SELECT {KEY_SQL}, revenue_at_risk FROM clean WHERE revenue_at_risk IS NOT NULL
ORDER BY revenue_at_risk DESC, {KEY_SQL} LIMIT 50"""), dbl="revenue_at_risk")

DIMS = {"hotel": 10, "market_segment": 3, "distribution_channel": 3, "country": 8}
register("b6_topk_categories_per_dim",
         lambda spark, sf: ordering.top_categories(cleaned(spark, sf), DIMS),
         with_ctes(CLEAN, "limits AS (SELECT * FROM (VALUES "
                   + ", ".join(f"('{d}', {n})" for d, n in DIMS.items())
                   + ") AS v(dimension, top_n))",
                   "long AS (" + " UNION ALL ".join(
                       f"SELECT '{d}' AS dimension, {d} AS segment FROM clean" for d in DIMS)
                   + ")", body="""
SELECT dimension, segment, n_rows, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY dimension ORDER BY n_rows DESC, segment) AS rank
  FROM (SELECT dimension, segment, count(*) AS n_rows FROM long GROUP BY ALL)
) JOIN limits USING (dimension) WHERE rank <= top_n"""))


def model_folds(spark, sf):
    """Metric table of "models" (deposit types) per "fold" (arrival year)."""
    return cleaned(spark, sf).groupBy(
        F.col("arrival_date_year").alias("fold"), F.col("deposit_type").alias("model")
    ).agg(F.round(F.avg("adr"), 4).alias("pr_auc"), F.round(F.avg("lead_time"), 4).alias("roc_auc"))


MODEL_FOLDS = CLEAN + """,
model_folds AS (
  SELECT arrival_date_year AS fold, deposit_type AS model, round(avg(adr), 4) AS pr_auc,
    round(avg(lead_time), 4) AS roc_auc FROM clean GROUP BY 1, 2
)"""


def _wins(spark, sf):
    table = model_folds(spark, sf)
    winners = ordering.argmax_per_group(table, "fold", "pr_auc", "model")
    return ordering.win_counts(table, winners, "model")


register("b7_argmax_per_group",
         lambda spark, sf: ordering.argmax_per_group(model_folds(spark, sf), "fold", "pr_auc",
                                                     "model"),
         with_ctes(MODEL_FOLDS, body="""
SELECT fold, model AS winner, pr_auc FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pr_auc DESC, model) AS r
  FROM model_folds) WHERE r = 1"""), dbl="pr_auc")
register("b7_win_counts", _wins, with_ctes(MODEL_FOLDS, body="""
SELECT model, count(winner) AS wins FROM (SELECT DISTINCT model FROM model_folds)
LEFT JOIN (SELECT fold, model AS winner FROM (
  SELECT *, row_number() OVER (PARTITION BY fold ORDER BY pr_auc DESC, model) AS r
  FROM model_folds) WHERE r = 1) ON model = winner GROUP BY model"""))

register("b8_custom_order",
         lambda spark, sf: scored(spark, sf).groupBy("risk_tier").agg(
             F.count(F.lit(1)).alias("n")
         ).withColumn("place", ordering.domain_rank("risk_tier", TIERS)).orderBy("place"),
         with_ctes(SCORED, body="""
SELECT risk_tier, count(*) AS n,
  CAST(CASE risk_tier WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END AS BIGINT) AS place
FROM scored GROUP BY 1 ORDER BY place"""))


def _rank(spark, sf):
    table = model_folds(spark, sf).groupBy("model").agg(
        F.round(F.avg("pr_auc"), 4).alias("pr_auc"), F.round(F.avg("roc_auc"), 4).alias("roc_auc"))
    return ordering.rank_table(table, F.desc("pr_auc"), F.desc("roc_auc"), F.asc("model"))


register("b9_rank_table", _rank, with_ctes(MODEL_FOLDS, body="""
SELECT *, row_number() OVER (ORDER BY pr_auc DESC, roc_auc DESC, model) AS rank FROM (
  SELECT model, round(avg(pr_auc), 4) AS pr_auc, round(avg(roc_auc), 4) AS roc_auc
  FROM model_folds GROUP BY 1)"""), dbl="pr_auc roc_auc")


def _examples(spark, sf):
    """Rows with the highest, the lowest and the most undecided score."""
    key = F.struct(*KEYS)
    p = F.col("cancel_probability")
    picks = {"highest": -p, "lowest": p, "borderline": F.abs(p - 0.5)}
    best = scored(spark, sf).agg(*[
        F.min(F.struct(c.alias("by"), key.alias("key"), p.alias("p"))).alias(n)
        for n, c in picks.items()
    ])
    return best.select(F.inline(F.array(*[
        F.struct(F.lit(n).alias("example"), F.col(f"{n}.key.order_key").alias("order_key"),
                 F.col(f"{n}.key.line_no").alias("line_no"),
                 F.col(f"{n}.p").alias("cancel_probability")) for n in picks])))


register("b10_example_rows", _examples, with_ctes(SCORED, body=f"""
SELECT example, order_key, line_no, cancel_probability FROM (
  SELECT example, order_key, line_no, cancel_probability,
    row_number() OVER (PARTITION BY example ORDER BY by_value, {KEY_SQL}) AS r
  FROM (SELECT 'highest' AS example, -cancel_probability AS by_value, * FROM scored
    UNION ALL SELECT 'lowest', cancel_probability, * FROM scored
    UNION ALL SELECT 'borderline', abs(cancel_probability - 0.5::DOUBLE), * FROM scored)
) WHERE r = 1"""), dbl="cancel_probability")


def _quantile_examples(spark, sf):
    """Rows 10 %, 50 % and 90 % along the order of arrival."""
    df = scored(spark, sf)
    at = lambda n: [int(n * f) for f in (0.1, 0.5, 0.9)]
    cuts = CutKeys(df, "arrival_date", KEYS, lambda n: [q for p in at(n) for q in (p, p + 1)])
    spot = F
    for label, p in zip(("p10", "p50", "p90"), at(cuts.n)):
        spot = spot.when(cuts.within(p, p + 1), label)
    return df.withColumn("example", spot).filter("example IS NOT NULL").select(
        "example", *KEYS, "cancel_probability")


register("b10_position_examples", _quantile_examples, with_ctes(POSITIONED, body=f"""
SELECT CASE position WHEN CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT) THEN 'p10'
  WHEN CAST(floor(n_all * 0.5::DOUBLE) AS BIGINT) THEN 'p50' ELSE 'p90' END AS example,
  {KEY_SQL}, cancel_probability
FROM positioned WHERE position IN (CAST(floor(n_all * 0.1::DOUBLE) AS BIGINT),
  CAST(floor(n_all * 0.5::DOUBLE) AS BIGINT), CAST(floor(n_all * 0.9::DOUBLE) AS BIGINT))"""),
    dbl="cancel_probability")
