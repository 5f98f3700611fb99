"""Registry of queries with their SQL counterparts, and the SQL form of the shared views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import owning

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

BOOKINGS = """
bookings AS (
  SELECT l_orderkey AS order_key, l_linenumber AS line_no, l_partkey AS part_key,
    l_suppkey AS supp_key, l_extendedprice AS list_price, o_orderdate::DATE AS booking_date,
    l_shipdate::DATE AS ship_day,
    CASE WHEN l_linestatus = 'O' THEN 'City Hotel' ELSE 'Resort Hotel' END AS hotel,
    CAST(abs(date_diff('day', o_orderdate::DATE, l_shipdate::DATE)) % 400 AS INTEGER) AS lead_time,
    CAST(year(l_shipdate) AS INTEGER) AS arrival_date_year,
    strftime(l_shipdate, '%B') AS arrival_date_month,
    CAST(day(l_shipdate) AS INTEGER) AS arrival_date_day_of_month,
    CAST(l_quantity AS INTEGER) % 3 AS stays_in_weekend_nights,
    CAST(l_quantity AS INTEGER) % 6 AS stays_in_week_nights,
    p_size % 4 AS adults,
    CASE WHEN l_linenumber <> 7 THEN CAST(l_linenumber % 2 AS DOUBLE) END AS children,
    CASE WHEN p_size % 25 = 0 THEN 1 ELSE 0 END AS babies,
    p_type AS meal, CASE WHEN n_nationkey = 24 THEN 'NULL' ELSE n_name END AS country,
    c_mktsegment AS market_segment, o_orderpriority AS distribution_channel,
    CASE WHEN o_custkey % 10 = 0 THEN 1 ELSE 0 END AS is_repeated_guest,
    CAST(o_custkey % 3 AS INTEGER) AS previous_cancellations,
    CAST(o_custkey % 5 AS INTEGER) AS previous_bookings_not_canceled,
    p_brand AS reserved_room_type,
    CASE l_linenumber % 3 WHEN 0 THEN 'Non Refund' WHEN 1 THEN 'No Deposit'
      ELSE 'Refundable' END AS deposit_type,
    CASE WHEN l_suppkey % 10 = 0 THEN 'NULL' ELSE CAST(l_suppkey % 20 AS VARCHAR) END AS agent,
    CASE WHEN l_suppkey % 7 = 0 THEN CAST(l_suppkey AS VARCHAR) END AS company,
    o_orderstatus AS customer_type,
    CASE WHEN p_size = 2 AND l_linenumber = 2 THEN NULL
      WHEN p_size = 1 AND l_linenumber = 1 THEN -(l_extendedprice / l_quantity / 100)
      ELSE l_extendedprice / l_quantity / 100 END AS adr,
    CASE WHEN l_partkey % 9 = 0 THEN 1 ELSE 0 END AS required_car_parking_spaces,
    CAST(l_partkey % 4 AS INTEGER) AS total_of_special_requests,
    CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS is_canceled
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    JOIN nation ON c_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""

DERIVED = BOOKINGS + """,
derived AS (
  SELECT * REPLACE (COALESCE(TRY_CAST(NULLIF(agent, 'NULL') AS INTEGER), 0) AS agent,
      COALESCE(children, 0) AS children, COALESCE(NULLIF(country, 'NULL'), 'Unknown') AS country),
    children IS NULL AS children_was_null, ship_day AS arrival_date,
    CAST(stays_in_weekend_nights + stays_in_week_nights AS DOUBLE) AS total_stay,
    adults + COALESCE(children, 0) + babies AS total_guests,
    adr / CASE WHEN adults + COALESCE(children, 0) + babies > 0
      THEN adults + COALESCE(children, 0) + babies ELSE 1 END AS adr_per_person,
    CASE WHEN stays_in_weekend_nights > stays_in_week_nights THEN 1 ELSE 0 END AS is_weekend_heavy,
    adr * (stays_in_weekend_nights + stays_in_week_nights) AS revenue_at_risk,
    CASE WHEN lead_time <= 3 THEN 1 ELSE 0 END AS is_late_window,
    CASE WHEN company IS NULL THEN 0 ELSE 1 END AS had_company,
    sin(2 * pi() * month(ship_day) / 12) AS month_sin,
    cos(2 * pi() * month(ship_day) / 12) AS month_cos
  FROM bookings
)"""

CLEAN = DERIVED + """,
clean AS (
  SELECT * EXCLUDE (company, ship_day, children_was_null) FROM derived
  WHERE COALESCE(adr, 0) >= 0 AND COALESCE(adr, 0) < 50000 AND total_guests > 0
)"""

SCORED = CLEAN + """,
scored AS (
  SELECT *, CASE WHEN cancel_probability >= 0.7 THEN 'high'
      WHEN cancel_probability >= 0.4 THEN 'medium' ELSE 'low' END AS risk_tier,
    COALESCE(adr, 0) * greatest(total_stay - 1, 0) AS fn_cost
  FROM (
    SELECT *, CAST((part_key * 7919 + supp_key * 104729 + line_no * 31) % 6000
        + 3000 * is_canceled + CASE WHEN lead_time > 200 THEN 999 ELSE 0 END AS DOUBLE) / 10000
      AS cancel_probability,
      CAST((part_key * 104729 + supp_key * 7919 + line_no * 17) % 7000
        + 2500 * is_canceled AS DOUBLE) / 10000 AS rival_probability
    FROM clean
  )
)"""

ORDER_BY = "arrival_date, order_key, line_no, part_key, supp_key, list_price"

POSITIONED = SCORED + f""",
positioned AS (
  SELECT *, row_number() OVER (ORDER BY {ORDER_BY}) - 1 AS position, count(*) OVER () AS n_all
  FROM scored
)"""


def long_form(source: str, dims: list[str], keep: str = "*") -> str:
    """SQL of the long (dimension, segment) table."""
    return " UNION ALL ".join(
        f"SELECT '{d}' AS dimension, CAST({d} AS VARCHAR) AS segment, {keep} FROM {source}"
        for d in dims)


def auc_sql(source: str, by: str = "", name: str = "aucs", y: str = "is_canceled",
            p: str = "cancel_probability") -> str:
    """CTEs ending in ``name``: exact ROC-AUC and average precision per group."""
    part = f"PARTITION BY {by}" if by else ""
    lead = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""
{name}_g AS (
  SELECT {lead}{p} AS score, count(*) FILTER ({y} = 1) AS pos, count(*) FILTER ({y} = 0) AS neg
  FROM {source} GROUP BY {lead}{p}
), {name}_c AS (
  SELECT *, sum(pos) OVER ({part} ORDER BY score DESC) AS cp,
    sum(neg) OVER ({part} ORDER BY score DESC) AS cn FROM {name}_g
), {name} AS (
  SELECT {lead}CASE WHEN sum(pos) * sum(neg) > 0 THEN
      1 - sum(CAST(pos AS DOUBLE) * (cn - neg / 2.0)) / CAST(sum(pos) * sum(neg) AS DOUBLE)
      END AS roc_auc,
    CASE WHEN sum(pos) * sum(neg) > 0 THEN
      sum(CAST(pos AS DOUBLE) * cp / (cp + cn)) / CAST(sum(pos) AS DOUBLE) END AS pr_auc
  FROM {name}_c {group}
)"""


def confusion_sql(t: str | float, y: str = "is_canceled", p: str = "cancel_probability") -> str:
    return f"""count(*) FILTER ({p} < {t} AND {y} = 0) AS tn,
  count(*) FILTER ({p} >= {t} AND {y} = 0) AS fp,
  count(*) FILTER ({p} < {t} AND {y} = 1) AS fn,
  count(*) FILTER ({p} >= {t} AND {y} = 1) AS tp"""


PRF_SQL = """COALESCE(tp / NULLIF(CAST(tp + fp AS DOUBLE), 0), 0) AS precision,
  COALESCE(tp / NULLIF(CAST(tp + fn AS DOUBLE), 0), 0) AS recall,
  COALESCE(2 * tp / NULLIF(CAST(2 * tp + fp + fn AS DOUBLE), 0), 0) AS f1"""
BALANCED_SQL = """CASE WHEN tp + fn = 0 THEN tn / NULLIF(CAST(tn + fp AS DOUBLE), 0)
  WHEN tn + fp = 0 THEN tp / NULLIF(CAST(tp + fn AS DOUBLE), 0)
  ELSE (tp / NULLIF(CAST(tp + fn AS DOUBLE), 0) + tn / NULLIF(CAST(tn + fp AS DOUBLE), 0)) / 2
  END AS balanced_accuracy"""


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], sql: str | None = None,
             dbl: str = "", money: str = "") -> None:
    """Add a query; listed double columns are rounded alike on both sides.

    Rates (``dbl``) keep 6 decimals, sums of money (``money``) 2, or as given by ``name:digits``:
    engines add in other orders.
    """
    digits = {}
    for spec, default in [(s, 6) for s in dbl.split()] + [(s, 2) for s in money.split()]:
        column, _, places = spec.partition(":")
        digits[column] = int(places or default)

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = fn(spark, sf_dir)
        return df.withColumns({c: F.round(c, d) + F.lit(0.0) for c, d in digits.items()})

    assert name not in QUERIES, name
    QUERIES[name] = owning(run)
    if sql:
        rounds = ", ".join(
            f"round(CAST({c} AS DOUBLE), {d}) + 0 AS {c}" for c, d in digits.items())
        head, body = _split_with(sql.strip())
        if rounds:
            body = f"SELECT * REPLACE ({rounds}) FROM (\n{body}\n) AS result"
        ORACLE[name] = head + body


def _split_with(sql: str) -> tuple[str, str]:
    """Separate leading CTEs from the final query, marked by a line holding ``---``."""
    if "\n---\n" in sql:
        ctes, body = sql.split("\n---\n", 1)
        return f"WITH {ctes.strip()}\n", body.strip()
    return "", sql


def with_ctes(*ctes: str, body: str) -> str:
    joined = ",\n".join(c.strip() for c in ctes)
    return f"{joined}\n---\n{body.strip()}"
