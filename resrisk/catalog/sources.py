"""Queries of the sources, sinks, cleaning and row-rule operators."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import NUMERIC_FEATURES
from ..functions import clean, rules
from ..operators import ordering, stats
from ..session import shared_folder
from ..sources import bookings as src
from ..sources import prediction_log as log
from ..sources.star_schema import (
    KEYS, POLICIES, bookings, cleaned, pms_export, requests, reservations, scored, table,
)
from .base import BOOKINGS, CLEAN, DERIVED, SCORED, long_form, register, with_ctes

KEY_SQL = ", ".join(KEYS)


def _scratch(spark, label):
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def per_hotel(df):
    """Small fingerprint of a booking table."""
    return df.groupBy("hotel", "arrival_date_month").agg(
        F.count(F.lit(1)).alias("n"), F.count("children").alias("n_children"),
        F.sum("lead_time").alias("sum_lead"), F.sum("adr").alias("sum_adr"),
        F.sum("is_canceled").alias("cancelled"))


PER_HOTEL = """
SELECT hotel, arrival_date_month, count(*) AS n, count(children) AS n_children,
  CAST(sum(lead_time) AS BIGINT) AS sum_lead, sum(adr) AS sum_adr,
  CAST(sum(is_canceled) AS BIGINT) AS cancelled
FROM bookings GROUP BY 1, 2"""


def _scan_csv(spark, sf):
    path = _scratch(spark, "bookings-csv")
    bookings(spark, sf).drop(*KEYS, "booking_date", "ship_day").write.option("header", True).csv(path)
    return per_hotel(src.scan_csv(spark, path))


register("a1_scan_bookings", lambda spark, sf: per_hotel(bookings(spark, sf)),
         with_ctes(BOOKINGS, body=PER_HOTEL), money="sum_adr")
register("a1_scan_bookings_csv", _scan_csv, with_ctes(BOOKINGS, body=PER_HOTEL), money="sum_adr")

PMS = """
pms AS (
  SELECT CAST(o_orderkey AS VARCHAR) AS booking_id,
    CASE o_orderstatus WHEN 'F' THEN 'Cancelled' WHEN 'O' THEN 'Checked-in' ELSE 'Pending' END
      AS booking_status,
    CASE WHEN o_orderkey % 97 <> 0
      THEN o_orderdate::DATE + CAST(o_orderkey % 90 AS INTEGER) END AS arrival,
    CAST(o_orderkey % 90 AS INTEGER) AS lead_time,
    CAST((o_orderkey % 5 + 1) % 3 AS INTEGER) AS weekend,
    CAST(o_orderkey % 5 + 1 - (o_orderkey % 5 + 1) % 3 AS INTEGER) AS week,
    CAST(o_custkey % 3 + 1 AS INTEGER) AS adults, CAST(o_custkey % 2 AS DOUBLE) AS children,
    o_totalprice / 100 AS adr, c_mktsegment AS reserved_room_type,
    CASE WHEN o_orderkey % 2 = 0 THEN 'No Deposit' ELSE 'Refundable' END AS deposit_type
  FROM orders JOIN customer ON o_custkey = c_custkey
), canonical AS (
  SELECT *, CASE WHEN booking_status = 'Cancelled' THEN 1 ELSE 0 END AS is_canceled,
    strftime(arrival, '%B') AS arrival_date_month, CAST(weekend + week AS DOUBLE) AS total_stay,
    adults + children AS total_guests
  FROM pms WHERE booking_status <> 'Pending' AND arrival IS NOT NULL
)"""


def _scan_pms(spark, sf):
    path = _scratch(spark, "pms-csv")
    pms_export(spark, sf).write.option("header", True).csv(path)
    return src.scan_csv(spark, path, src.PMS_SCHEMA).groupBy("Booking_Status").agg(
        F.count(F.lit(1)).alias("n"), F.sum("Lead_Time_Days").alias("sum_lead"),
        F.sum("ADR_Rate").alias("sum_adr"))


register("a2_scan_pms", _scan_pms, with_ctes(PMS, body="""
SELECT booking_status AS "Booking_Status", count(*) AS n,
  CAST(sum(lead_time) AS BIGINT) AS sum_lead, sum(adr) AS sum_adr FROM pms GROUP BY 1"""),
    money="sum_adr")

register("a3_adapt_reservations",
         lambda spark, sf: src.adapt_reservations(reservations(spark, sf)).groupBy(
             "meal", "reserved_room_type", "market_segment", "distribution_channel",
             "arrival_date_month"
         ).agg(F.count(F.lit(1)).alias("n"), F.sum("is_canceled").alias("cancelled"),
               F.sum("arrival_date_week_number").alias("weeks"), F.max("hotel").alias("hotel"),
               F.max("deposit_type").alias("deposit_type"), F.sum("adr").alias("sum_adr")),
         with_ctes("""
res AS (
  SELECT *, CASE o_orderkey % 5 WHEN 0 THEN 'BB' WHEN 1 THEN 'HB' WHEN 2 THEN 'FB'
      WHEN 3 THEN 'Undefined' ELSE 'Brunch' END AS meal,
    CASE WHEN o_orderkey % 8 = 7 THEN 'Room_Type 8'
      ELSE chr(CAST(65 + o_orderkey % 8 AS INTEGER)) END AS reserved_room_type,
    CASE o_orderkey % 6 WHEN 0 THEN 'Online' WHEN 1 THEN 'Offline' WHEN 2 THEN 'Corporate'
      WHEN 3 THEN 'Aviation' WHEN 4 THEN 'Complementary' ELSE 'Walk-in' END AS market_segment,
    CASE o_orderkey % 6 WHEN 2 THEN 'Corporate' WHEN 3 THEN 'Direct' WHEN 4 THEN 'Direct'
      ELSE 'TA/TO' END AS distribution_channel,
    TRY_CAST(strftime(o_orderdate, '%Y-%m-') || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0')
      AS DATE) AS day
  FROM orders
)""", body="""
SELECT meal, reserved_room_type, market_segment, distribution_channel,
  strftime(day, '%B') AS arrival_date_month, count(*) AS n,
  count(*) FILTER (o_orderstatus = 'F') AS cancelled, CAST(sum(weekofyear(day)) AS BIGINT) AS weeks,
  'City Hotel' AS hotel, 'No Deposit' AS deposit_type, sum(o_totalprice / 1000) AS sum_adr
FROM res WHERE day IS NOT NULL GROUP BY ALL"""), money="sum_adr")

register("a4_canonicalise_pms",
         lambda spark, sf: src.canonicalise_pms(pms_export(spark, sf)).groupBy(
             "reserved_room_type", "deposit_type", "arrival_date_month", "arrival_date_year"
         ).agg(F.count(F.lit(1)).alias("n"), F.sum("is_canceled").alias("cancelled"),
               F.sum("total_stay").alias("stay"), F.sum("total_guests").alias("guests"),
               F.sum("is_late_window").alias("late"), F.avg("month_sin").alias("month_sin"),
               F.sum("revenue_at_risk").alias("revenue")),
         with_ctes(PMS, body="""
SELECT reserved_room_type, deposit_type, arrival_date_month,
  CAST(year(arrival) AS INTEGER) AS arrival_date_year,
  count(*) AS n, CAST(sum(is_canceled) AS BIGINT) AS cancelled, sum(total_stay) AS stay,
  sum(total_guests) AS guests, count(*) FILTER (lead_time <= 3) AS late,
  avg(sin(2 * pi() * month(arrival) / 12)) AS month_sin, sum(adr * total_stay) AS revenue
FROM canonical GROUP BY ALL"""), dbl="month_sin revenue:4", money="stay guests")

register("a4_pms_issue_counts", lambda spark, sf: src.pms_issue_counts(pms_export(spark, sf)),
         with_ctes(PMS, body="""
SELECT count(*) FILTER (booking_status = 'Pending') AS rows_dropped_unknown_status,
  count(*) FILTER (booking_status <> 'Pending' AND arrival IS NULL)
    AS rows_dropped_unparseable_arrival_date FROM pms"""))

CHOICES = ["hotel", "market_segment", "distribution_channel", "meal", "country", "deposit_type"]
register("a5_select_columns_scan",
         lambda spark, sf: src.distinct_values(
             bookings(spark, sf), [*CHOICES, "no_such_column"], {"no_such_column": ["A", "B"]}),
         with_ctes(BOOKINGS, f"long AS ({long_form('bookings', CHOICES, '1')})", body="""
SELECT DISTINCT dimension AS column_name, trim(segment) AS choice FROM long
WHERE trim(segment) <> '' UNION ALL SELECT 'no_such_column', unnest(['A', 'B'])"""))


def _report(spark, sf):
    folder = _scratch(spark, "report")
    log.write_report(per_hotel(bookings(spark, sf)), folder, "per_hotel")
    return spark.read.parquet(f"{folder}/per_hotel.parquet")


register("a6_write_report_table", _report, with_ctes(BOOKINGS, body=PER_HOTEL), money="sum_adr")


def log_frame(spark, sf):
    """Scored bookings with nested values, as a scoring job would log them."""
    p = F.col("cancel_probability")
    return scored(spark, sf).select(
        *KEYS, "hotel", "arrival_date", p.alias("probability"), "risk_tier",
        (p >= POLICIES["max_f1"]).alias("label_max_f1"),
        F.array(F.lit("cost threshold missing")).alias("alerts"),
        F.array(F.struct(F.lit("adr").alias("feature"), F.col("adr").cast("string").alias("value"),
                         (p - 0.5).alias("contribution"))).alias("top_features"))


def _log(spark, sf):
    path = _scratch(spark, "log")
    at = F.trunc("arrival_date", "quarter").cast("timestamp")
    assert log.append_log(log_frame(spark, sf), path, at)
    return path


def _append(spark, sf):
    df = log.decode(log.read_log(spark, _log(spark, sf)))
    return df.groupBy("risk_tier", "label_max_f1").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("dt").alias("days"),
        F.sum(F.size("alerts")).alias("n_alerts"),
        F.sum(F.col("top_features")[0]["contribution"]).alias("contribution"))


register("a7_append_prediction_log", _append, with_ctes(SCORED, body="""
SELECT risk_tier, CASE WHEN cancel_probability >= 0.41 THEN 1 ELSE 0 END AS label_max_f1,
  count(*) AS n, count(DISTINCT date_trunc('quarter', arrival_date)) AS days, count(*) AS n_alerts,
  sum(cancel_probability - 0.5) AS contribution FROM scored GROUP BY 1, 2"""), money="contribution")


def _evolution(spark, sf):
    """An old log without the price columns, followed by rows of the new layout."""
    path = _scratch(spark, "log-versions")
    rows = log_frame(spark, sf)
    old = F.col("arrival_date") < "1998-01-01"
    at = F.trunc("arrival_date", "quarter").cast("timestamp")
    log.append_log(rows.filter(old).drop("top_features"), path, at)
    log.append_log(rows.filter(~old).withColumn("predicted_adr", F.lit(100.0)), path, at)
    return log.read_log(spark, path).groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.count("predicted_adr").alias("with_price"),
        F.count("top_features").alias("with_features"))


register("a8_log_schema_evolution", _evolution, with_ctes(SCORED, body="""
SELECT risk_tier, count(*) AS n,
  count(*) FILTER (arrival_date >= DATE '1998-01-01') AS with_price,
  count(*) FILTER (arrival_date >= DATE '1998-01-01') AS with_features FROM scored GROUP BY 1"""))


def _export(spark, sf):
    path, out = _log(spark, sf), _scratch(spark, "export")
    n = log.export_since(spark, path, out, "2000-03-15")
    rows = spark.read.option("header", True).csv(out)
    return rows.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.lit(n).cast("bigint").alias("n_exported"),
        F.min(F.substring("timestamp_utc", 1, 10)).alias("first_day"))


register("a9_export_log_since", _export, with_ctes(SCORED, body="""
SELECT risk_tier, count(*) AS n, CAST(sum(count(*)) OVER () AS BIGINT) AS n_exported,
  '2000-04-01' AS first_day
FROM scored WHERE arrival_date >= DATE '2000-04-01' GROUP BY 1"""))


def _count(spark, sf):
    n = log.count_log(spark, _log(spark, sf))
    none = log.count_log(spark, _scratch(spark, "absent"))
    return spark.createDataFrame([(n, none)], "n bigint, n_without_log bigint")


register("a10_count_log", _count, with_ctes(SCORED, body="""
SELECT count(*) AS n, CAST(0 AS BIGINT) AS n_without_log FROM scored"""))

MISSING = ["children", "country", "agent", "company", "adr", "lead_time"]
register("a11_missingness_profile",
         lambda spark, sf: clean.missingness_profile(bookings(spark, sf).select(*MISSING)),
         with_ctes(BOOKINGS, body=" UNION ALL ".join(
             f"SELECT '{c}' AS column_name, '{t}' AS dtype, count(*) - count({c}) AS n_null, "
             f"count(*) AS n_rows, 100.0 * (count(*) - count({c})) / count(*) AS pct_null "
             "FROM bookings" for c, t in zip(MISSING, [
                 "double", "string", "string", "string", "double", "int"]))), dbl="pct_null")

# --- C: projections, filters, rules -------------------------------------------------------
register("c1_null_like_to_null",
         lambda spark, sf: bookings(spark, sf).groupBy(
             clean.null_like_to_null(F.col("agent")).alias("agent"),
             clean.null_like_to_null(F.col("country")).alias("country")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(BOOKINGS, body="""
SELECT NULLIF(agent, 'NULL') AS agent, NULLIF(country, 'NULL') AS country, count(*) AS n
FROM bookings GROUP BY 1, 2"""))
register("c2_safe_numeric",
         lambda spark, sf: bookings(spark, sf).agg(
             F.sum(clean.safe_numeric(F.col("agent"))).alias("agents"),
             F.count(clean.safe_numeric(F.col("agent"))).alias("n_agents"),
             F.count(clean.safe_numeric(F.col("hotel"))).alias("n_hotels")),
         with_ctes(BOOKINGS, body="""
SELECT sum(TRY_CAST(agent AS DOUBLE)) AS agents, count(TRY_CAST(agent AS DOUBLE)) AS n_agents,
  count(TRY_CAST(hotel AS DOUBLE)) AS n_hotels FROM bookings"""), money="agents")


def _column_or_default(spark, sf):
    df = bookings(spark, sf)
    return df.agg(F.sum(clean.column_or_default(df, "babies")).alias("babies"),
                  F.sum(clean.column_or_default(df, "no_such_column", 2)).alias("absent"))


register("c3_column_or_default", _column_or_default, with_ctes(BOOKINGS, body="""
SELECT CAST(sum(babies) AS BIGINT) AS babies, CAST(2 * count(*) AS BIGINT) AS absent
FROM bookings"""))
register("c4_normalise_inputs",
         lambda spark, sf: clean.normalise_inputs(bookings(spark, sf)).groupBy("agent", "country")
         .agg(F.count(F.lit(1)).alias("n"), F.sum("children").alias("children"),
              F.sum("company").alias("company")),
         with_ctes(BOOKINGS, body="""
SELECT COALESCE(TRY_CAST(agent AS INTEGER), 0) AS agent,
  COALESCE(NULLIF(country, 'NULL'), 'Unknown') AS country, count(*) AS n,
  CAST(sum(COALESCE(children, 0)) AS DOUBLE) AS children,
  CAST(sum(TRY_CAST(company AS DOUBLE)) AS DOUBLE) AS company
FROM bookings GROUP BY 1, 2"""), money="children company")
DERIVED_COLS = ["total_stay", "total_guests", "adr_per_person", "is_weekend_heavy",
                "revenue_at_risk", "is_late_window", "had_company", "month_sin", "month_cos"]
register("c5_derive_features",
         lambda spark, sf: clean.derive_features(bookings(spark, sf)).select(*KEYS, *DERIVED_COLS),
         with_ctes(DERIVED, body=f"SELECT {KEY_SQL}, {', '.join(DERIVED_COLS)} FROM derived"),
         dbl="month_sin month_cos")
register("c6_ensure_features",
         lambda spark, sf: clean.ensure_features(
             bookings(spark, sf).drop("meal", "company")
         ).groupBy("hotel", "deposit_type").agg(
             F.count(F.lit(1)).alias("n"), F.count("meal").alias("n_meal"),
             F.sum("had_company").alias("had_company"), F.sum("total_stay").alias("stay")),
         with_ctes(BOOKINGS, body="""
SELECT hotel, deposit_type, count(*) AS n, CAST(0 AS BIGINT) AS n_meal,
  CAST(0 AS BIGINT) AS had_company,
  CAST(sum(stays_in_weekend_nights + stays_in_week_nights) AS DOUBLE) AS stay
FROM bookings GROUP BY 1, 2"""), money="stay")
register("c7_arrival_date",
         lambda spark, sf: clean.add_arrival_date(
             requests(spark, sf).drop("arrival_date")
         ).groupBy("arrival_date").agg(F.count(F.lit(1)).alias("n")),
         with_ctes(BOOKINGS, body="""
SELECT arrival_date, count(*) AS n FROM (SELECT TRY_CAST(
  CASE WHEN order_key % 3 = 0 AND month(ship_day) <> 5 OR order_key % 3 <> 0 AND order_key % 41 = 0
      OR order_key % 50 <> 0 AND order_key % 7 = 0 THEN NULL
    ELSE CAST(year(ship_day) + CASE WHEN order_key % 50 = 0 THEN 1 ELSE 0 END AS VARCHAR)
      || strftime(ship_day, '-%m-%d') END AS DATE) AS arrival_date FROM bookings)
GROUP BY 1"""))
register("c8_month_number",
         lambda spark, sf: requests(spark, sf).groupBy(
             "arrival_date_month", clean.month_number(F.col("arrival_date_month")).alias("number")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(BOOKINGS, body="""
SELECT name AS arrival_date_month, CASE WHEN name = strftime(ship_day, '%B')
    THEN CAST(month(ship_day) AS INTEGER) END AS number, count(*) AS n
FROM (SELECT *, CASE WHEN order_key % 3 = 0 THEN arrival_date_month[1:3]
  WHEN order_key % 41 = 0 THEN 'Smarch' ELSE arrival_date_month END AS name FROM bookings)
GROUP BY 1, 2"""))
register("c9_clean_bookings",
         lambda spark, sf: cleaned(spark, sf).select(
             *KEYS, "arrival_date", "agent", "country", "children", "adr"),
         with_ctes(CLEAN, body=f"""
SELECT {KEY_SQL}, arrival_date, agent, country, children, adr FROM clean"""))
register("c10_cleaning_issue_counts",
         lambda spark, sf: clean.cleaning_issue_counts(bookings(spark, sf)),
         with_ctes(DERIVED, body=" UNION ALL ".join(
             f"SELECT '{n}' AS issue, count(*) FILTER ({c}) AS n FROM derived" for n, c in {
                 "children_null_filled_zero": "children_was_null",
                 "agent_filled_as_direct": "agent = 0",
                 "country_unknown_rows": "lower(trim(country)) = 'unknown'",
                 "rows_dropped_negative_adr": "adr < 0",
                 "rows_dropped_adr_outlier": "adr >= 50000",
                 "rows_dropped_zero_guests": "total_guests = 0",
                 "rows_dropped_null_guests": "total_guests IS NULL",
                 "rows_dropped_total":
                     "COALESCE(adr, 0) < 0 OR COALESCE(adr, 0) >= 50000 OR total_guests <= 0",
             }.items())))
register("c11_validate_table",
         lambda spark, sf: clean.validate_table(clean.derive_features(
             bookings(spark, sf)).drop("meal")),
         with_ctes(DERIVED, body="""
SELECT 'required_columns_present' AS check_name, false AS passed,
  'Missing required columns: [''meal'']' AS message
UNION ALL SELECT 'target_non_empty', count(is_canceled) > 0,
  CASE WHEN count(is_canceled) = 0 THEN 'Target column has no non-null values.' END FROM derived
UNION ALL SELECT 'target_binary', bool_and(is_canceled IN (0, 1)),
  CASE WHEN NOT bool_and(is_canceled IN (0, 1)) THEN 'Target column must be binary 0/1.' END
  FROM derived
UNION ALL SELECT 'non_negative_numeric', min(adr) >= 0, CASE WHEN min(adr) < 0 THEN
  'Negative values found in adr. Negative values found in adr_per_person. '
  || 'Negative values found in revenue_at_risk.' END FROM derived"""))
REQUESTS = BOOKINGS + """,
requests AS (
  SELECT *, CASE WHEN order_key % 2 = 0 THEN ship_day END AS date,
    CASE WHEN order_key % 50 = 0 THEN arrival_date_year + 1
      WHEN order_key % 7 = 0 THEN NULL ELSE arrival_date_year END AS year_given,
    CASE WHEN order_key % 3 <> 0 AND order_key % 41 = 0 THEN NULL ELSE arrival_date_month END
      AS month_read,
    CASE WHEN order_key % 31 = 0 THEN -lead_time - 1 ELSE lead_time END AS lead_given,
    order_key % 61 = 0 AS no_hotel
  FROM bookings
), judged AS (
  SELECT *, [
    CASE WHEN no_hotel THEN 'hotel is required' END,
    CASE WHEN lead_given < 0 THEN 'lead_time is out of range' END,
    CASE WHEN adults < 1 THEN 'adults is out of range' END,
    CASE WHEN adr < 0 OR adr > 50000 THEN 'adr is out of range' END,
    CASE WHEN month_read IS NULL THEN 'arrival_date_month must be a full month name' END,
    CASE WHEN date IS NULL AND (year_given IS NULL OR month_read IS NULL)
      THEN 'arrival_date or all arrival_date parts are required' END,
    CASE WHEN year_given <> year(date) THEN 'arrival_date_year conflicts with arrival_date' END
  ] AS checks FROM requests
), verdicts AS (
  SELECT *, list_filter(checks, lambda x: x IS NOT NULL) AS reasons FROM judged
)"""
IDS = KEYS
register("c13_request_quarantine",
         lambda spark, sf: rules.split_requests(requests(spark, sf), IDS)[1].select(
             F.explode("reasons").alias("reason")).groupBy("reason").agg(
                 F.count(F.lit(1)).alias("n")),
         with_ctes(REQUESTS, body="""
SELECT reason, count(*) AS n FROM (SELECT unnest(reasons) AS reason FROM verdicts) GROUP BY 1"""))
register("c13_valid_requests",
         lambda spark, sf: rules.split_requests(requests(spark, sf), IDS)[0].groupBy(
             "arrival_date_year", "arrival_date_month").agg(
                 F.count(F.lit(1)).alias("n"),
                 F.sum("arrival_date_week_number").alias("weeks"),
                 F.sum("arrival_date_day_of_month").alias("days")),
         with_ctes(REQUESTS, body="""
SELECT CAST(COALESCE(year(date), year_given) AS INTEGER) AS arrival_date_year, arrival_date_month,
  count(*) AS n, CAST(sum(weekofyear(date)) AS BIGINT) AS weeks,
  CAST(sum(day(ship_day)) AS BIGINT) AS days
FROM verdicts WHERE len(reasons) = 0 GROUP BY 1, 2"""))
register("c14_pms_request_features",
         lambda spark, sf: src.pms_request_features(
             pms_export(spark, sf).drop("Booking_Status")).groupBy("deposit_type").agg(
                 F.count(F.lit(1)).alias("n"), F.sum("total_stay").alias("stay"),
                 F.sum("adr_per_person").alias("per_person")),
         with_ctes(PMS, body="""
SELECT deposit_type, count(*) AS n, CAST(sum(weekend + week) AS DOUBLE) AS stay,
  sum(adr / (adults + children)) AS per_person
FROM pms WHERE arrival IS NOT NULL GROUP BY 1"""), money="stay per_person")
MEALS = {"ECONOMY": "BB", "STANDARD": "HB", "PROMO": "FB"}
register("c15_value_map",
         lambda spark, sf: bookings(spark, sf).groupBy(
             clean.value_map(F.col("meal"), MEALS).alias("meal")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(BOOKINGS, body="""
SELECT CASE meal WHEN 'ECONOMY' THEN 'BB' WHEN 'STANDARD' THEN 'HB' WHEN 'PROMO' THEN 'FB'
  ELSE meal END AS meal, count(*) AS n FROM bookings GROUP BY 1"""))
register("c16_clip_to_quantile",
         lambda spark, sf: stats.clip_to_quantile(cleaned(spark, sf), "adr").agg(
             F.max("clipped").alias("cap"), F.avg("clipped").alias("mean_clipped"),
             F.avg("adr").alias("mean_adr"), F.count("clipped").alias("n")),
         with_ctes(CLEAN, body="""
SELECT max(least(adr, cap)) AS cap, avg(CASE WHEN adr IS NOT NULL THEN least(adr, cap) END)
  AS mean_clipped, avg(adr) AS mean_adr, count(adr) AS n
FROM clean, (SELECT quantile_cont(adr, 0.99) AS cap FROM clean)"""),
    dbl="cap mean_clipped mean_adr")

LEAD = "lead_time"
register("c17_risk_driver_rules",
         lambda spark, sf: scored(spark, sf).groupBy(
             F.array_join(rules.risk_drivers(), " | ").alias("drivers")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(SCORED, body="""
SELECT CASE WHEN len(fired) = 0 THEN 'No strong warning signal was triggered for this booking.'
  ELSE array_to_string(fired[1:5], ' | ') END AS drivers, count(*) AS n
FROM (SELECT list_filter([
  CASE WHEN deposit_type = 'Non Refund' THEN 'Non-Refund deposit — in booking data this deposit '
    || 'type correlates with higher dropout rates.' END,
  CASE WHEN lead_time >= 120 THEN 'Booked ' || lead_time || ' days in advance — very long lead '
    || 'times increase dropout risk.' END,
  CASE WHEN is_repeated_guest = 0
    THEN 'First-time guest — no prior booking history to indicate loyalty.' END,
  CASE WHEN total_of_special_requests = 0
    THEN 'No special requests made — lower engagement signal.' END,
  CASE WHEN required_car_parking_spaces = 0
    THEN 'No parking needed — slightly lower commitment signal.' END,
  CASE WHEN market_segment IN ('Groups', 'Online TA') THEN market_segment
    || ' bookings tend to have higher cancellation rates in our data.' END,
  CASE WHEN previous_cancellations > 0 THEN 'The guest has ' || previous_cancellations
    || ' previous cancellation(s) on record.' END], lambda x: x IS NOT NULL) AS fired FROM scored)
GROUP BY 1"""))
register("c18_intervention_rules",
         lambda spark, sf: scored(spark, sf).groupBy(
             F.array_join(rules.interventions(
                 F.col("cancel_probability"), POLICIES["max_f1"], POLICIES["high_precision"]),
                 " | ").alias("actions"),
             rules.recommended_action(F.col("risk_tier")).alias("short_action")
         ).agg(F.count(F.lit(1)).alias("n")),
         with_ctes(SCORED, body="""
SELECT array_to_string(list_filter([
  CASE WHEN risk_tier = 'high'
    THEN 'Call or message the guest now to confirm they are still coming.' END,
  CASE WHEN risk_tier = 'high' THEN
    'Hold a small room buffer for this arrival date in case this booking falls through.' END,
  CASE WHEN risk_tier = 'medium'
    THEN 'Send automated reminders at 72 h and 24 h before arrival.' END,
  CASE WHEN risk_tier = 'medium' THEN
    'Check room availability — review this booking manually if inventory is tight.' END,
  CASE WHEN risk_tier = 'low'
    THEN 'No action needed — continue with the standard booking flow.' END,
  CASE WHEN lead_time >= 120 THEN 'Set up a reconfirmation schedule: contact the guest at 90, 30 '
    || 'and 7 days before arrival.' END,
  CASE WHEN deposit_type IN ('No Deposit', 'Refundable') AND cancel_probability >= 0.41 THEN
    'Request a deposit or card pre-authorisation to strengthen the guest''s commitment.' END,
  CASE WHEN previous_cancellations > 0 THEN
    'Call or email this guest personally — they have cancelled a booking before.' END,
  CASE WHEN total_of_special_requests = 0 THEN 'Ask the guest if they have any special requests '
    || '— this increases booking engagement.' END,
  CASE WHEN is_repeated_guest = 0 AND cancel_probability >= 0.41 THEN 'Consider a small loyalty '
    || 'incentive (room upgrade or F&B voucher) to build commitment.' END,
  CASE WHEN cancel_probability >= 0.8 THEN
    'Flag this booking for daily monitoring in your reservations system.' END
  ], lambda x: x IS NOT NULL)[1:6], ' | ') AS actions,
  CASE risk_tier WHEN 'high' THEN 'Contact the guest within 24 hours to confirm intent. Consider '
      || 'an overbooking buffer for the arrival date.'
    WHEN 'medium' THEN 'Send a gentle reminder one week before arrival. Monitor cancellation rate '
      || 'in this cohort during the next quarter.'
    ELSE 'Standard handling. No proactive outreach required.' END AS short_action, count(*) AS n
FROM scored GROUP BY ALL"""))


def _families(spark, sf):
    """Mean absolute value of each numeric feature, grouped by family."""
    long = ordering.unpivot(cleaned(spark, sf), NUMERIC_FEATURES, names=("feature", "value"), cast="double")
    return long.groupBy("feature", rules.feature_family(F.col("feature")).alias("family")).agg(
        F.avg(F.abs("value")).alias("mean_abs"))


# Families of the numeric features; all others are `Other`.
FAMILY_SQL = "CASE " + " ".join(
    f"WHEN feature IN ({', '.join(repr(c) for c in names)}) THEN '{family}'" for family, names in rules.FEATURE_FAMILIES.items()
) + " ELSE 'Other' END"
register("c19_feature_family_label", _families, with_ctes(CLEAN, "long AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg(abs(CAST({c} AS DOUBLE))) AS mean_abs FROM clean" for c in NUMERIC_FEATURES) + ")",
    body=f"SELECT feature, {FAMILY_SQL} AS family, mean_abs FROM long"), dbl="mean_abs")
register("c20_booking_value",
         lambda spark, sf: cleaned(spark, sf).groupBy("hotel").agg(
             F.sum(clean.booking_value(F.col("adr"), F.col("total_stay"))).alias("value")),
         with_ctes(CLEAN, body="""
SELECT hotel, sum(adr * greatest(1, total_stay)) AS value FROM clean GROUP BY 1"""), money="value")


def _json(spark, sf):
    events = table(spark, sf, "events")
    parsed = F.from_json("props", "struct<k:bigint>")
    back = F.to_json(parsed)
    return events.withColumn("k", parsed["k"]).withColumn("again", back).groupBy("event_type").agg(
        F.sum("k").alias("k"), F.count("again").alias("n"),
        F.sum(F.get_json_object("again", "$.k").cast("bigint")).alias("k_again"))


register("c21_json_roundtrip", _json, """
SELECT event_type, CAST(sum(k) AS BIGINT) AS k, count(*) AS n, CAST(sum(k) AS BIGINT) AS k_again
FROM (SELECT event_type, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
GROUP BY 1""")
