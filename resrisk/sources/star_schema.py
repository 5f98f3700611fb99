"""Booking-shaped views over the order / line-item star schema."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import clean
from ..functions.rules import risk_tier
from ..operators.cost import fn_cost

# Unique row key, in tie-break order (after the arrival date).
KEYS = ["order_key", "line_no", "part_key", "supp_key", "list_price"]
# The three decision policies used by the reports.
POLICIES = {"high_precision": 0.80, "max_f1": 0.41, "cost_sensitive": 0.06}


# Table schemas, so that no scan has to infer one.
TABLES = {
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, "
                "c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, "
            "p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
                "l_quantity double, l_extendedprice double, l_discount double, l_tax double, "
                "l_returnflag string, l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, "
              "value double, props string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


@lru_cache(maxsize=8)  # the lazy plan, not its rows
def bookings(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """One booking per line item, joined to its order, customer, nation and part.

    `lines` stands in for the line items: a part of them, or a stream.
    """
    t = lambda name: table(spark, sf_dir, name)
    joined = (
        (t("lineitem") if lines is None else lines)
        .join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
        .join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
        .join(t("part"), F.col("l_partkey") == F.col("p_partkey"))
    )
    ship, nights = F.to_date("l_shipdate"), F.col("l_quantity").cast("int")
    line, size = F.col("l_linenumber"), F.col("p_size")
    rate = F.col("l_extendedprice") / F.col("l_quantity") / 100
    supp = F.col("l_suppkey")
    flag = lambda cond: cond.cast("int")
    return joined.select(
        F.col("l_orderkey").alias("order_key"), line.alias("line_no"),
        F.col("l_partkey").alias("part_key"), supp.alias("supp_key"),
        F.col("l_extendedprice").alias("list_price"),
        F.to_date("o_orderdate").alias("booking_date"), ship.alias("ship_day"),
        F.when(F.col("l_linestatus") == "O", "City Hotel").otherwise("Resort Hotel").alias("hotel"),
        (F.abs(F.datediff(ship, F.to_date("o_orderdate"))) % 400).alias("lead_time"),
        F.year(ship).alias("arrival_date_year"),
        F.date_format(ship, "MMMM").alias("arrival_date_month"),
        F.day(ship).alias("arrival_date_day_of_month"),
        (nights % 3).alias("stays_in_weekend_nights"), (nights % 6).alias("stays_in_week_nights"),
        (size % 4).alias("adults"),
        F.when(line != 7, (line % 2).cast("double")).alias("children"),
        flag(size % 25 == 0).alias("babies"),
        F.col("p_type").alias("meal"),
        F.when(F.col("n_nationkey") == 24, "NULL").otherwise(F.col("n_name")).alias("country"),
        F.col("c_mktsegment").alias("market_segment"),
        F.col("o_orderpriority").alias("distribution_channel"),
        flag(F.col("o_custkey") % 10 == 0).alias("is_repeated_guest"),
        (F.col("o_custkey") % 3).cast("int").alias("previous_cancellations"),
        (F.col("o_custkey") % 5).cast("int").alias("previous_bookings_not_canceled"),
        F.col("p_brand").alias("reserved_room_type"),
        F.element_at(F.array(F.lit("Non Refund"), F.lit("No Deposit"), F.lit("Refundable")),
                     (line % 3 + 1).cast("int")).alias("deposit_type"),
        F.when(supp % 10 == 0, "NULL").otherwise((supp % 20).cast("string")).alias("agent"),
        F.when(supp % 7 == 0, supp.cast("string")).alias("company"),
        F.col("o_orderstatus").alias("customer_type"),
        F.when((size == 2) & (line == 2), F.lit(None)).when((size == 1) & (line == 1), -rate)
        .otherwise(rate).alias("adr"),
        flag(F.col("l_partkey") % 9 == 0).alias("required_car_parking_spaces"),
        (F.col("l_partkey") % 4).cast("int").alias("total_of_special_requests"),
        flag(F.col("l_returnflag") == "R").alias("is_canceled"),
    )


@lru_cache(maxsize=8)
def cleaned(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Clean bookings.  The day comes from the source, so that date filters reach the scan;
    a date built from its parts would be evaluated once per comparison."""
    return clean.clean_bookings(bookings(spark, sf_dir, lines)).withColumnRenamed(
        "ship_day", "arrival_date")


def with_score(df: DataFrame) -> DataFrame:
    """Deterministic stand-in score with ties; test data for metrics, never a model result."""
    mix = F.col("part_key") * 7919 + F.col("supp_key") * 104729 + F.col("line_no") * 31
    raw = mix % 6000 + 3000 * F.col("is_canceled") + 999 * (F.col("lead_time") > 200).cast("int")
    p = raw.cast("double") / 10000
    return df.withColumn("cancel_probability", p).withColumns({
        "risk_tier": risk_tier(p),
        "fn_cost": fn_cost(df),
    })


def second_score(df: DataFrame, name: str = "rival_probability") -> DataFrame:
    """A weaker stand-in score, for comparisons between two models."""
    mix = F.col("part_key") * 104729 + F.col("supp_key") * 7919 + F.col("line_no") * 17
    return df.withColumn(name, (mix % 7000 + 2500 * F.col("is_canceled")).cast("double") / 10000)


@lru_cache(maxsize=8)
def scored(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    return second_score(with_score(cleaned(spark, sf_dir, lines)))


@lru_cache(maxsize=8)
def pms_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second-market export: one row per order in the other market's column names."""
    t = lambda name: table(spark, sf_dir, name)
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    arrival = F.date_add(F.to_date("o_orderdate"), (key % 90).cast("int"))
    nights = (key % 5 + 1).cast("int")
    return joined.select(
        key.cast("string").alias("Booking_ID"),
        F.when(F.col("o_orderstatus") == "F", "Cancelled")
        .when(F.col("o_orderstatus") == "O", "Checked-in").otherwise("Pending")
        .alias("Booking_Status"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("Booking_Date"),
        F.when(key % 97 == 0, "n/a").otherwise(F.date_format(arrival, "yyyy-MM-dd"))
        .alias("Arrival_Date"),
        (key % 90).cast("int").alias("Lead_Time_Days"),
        (nights % 3).alias("Weekend_Nights"), (nights - nights % 3).alias("Week_Nights"),
        nights.alias("Nights_Stayed"),
        (cust % 3 + 1).cast("int").alias("Adults"), (cust % 2).cast("int").alias("Children"),
        F.lit(0).alias("Babies"), (cust % 3 + 1 + cust % 2).cast("int").alias("Total_Guests"),
        (F.col("o_totalprice") / 100).alias("ADR_Rate"),
        F.col("o_totalprice").alias("Total_Cost"),
        F.col("c_mktsegment").alias("Room_Type"),
        F.when(key % 2 == 0, "No Deposit").otherwise("Refundable").alias("Deposit_Type"),
        (key % 4).cast("int").alias("Special_Requests"),
        F.lit("Breakfast").alias("Meals"), F.lit("Guest").alias("Guest_Type"),
        (F.col("o_orderstatus") == "F").cast("int").alias("Is_Canceled"),
        F.year(arrival).alias("Arrival_Year"), F.date_format(arrival, "MMMM").alias("Arrival_Month"),
        F.date_format(arrival, "EEEE").alias("Arrival_DayOfWeek"),
    )


@lru_cache(maxsize=8)
def reservations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Public reservations layout: one row per order, some with impossible dates."""
    o = table(spark, sf_dir, "orders")
    key, cust, date = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_orderdate")
    pick = lambda values, i: F.element_at(F.array(*[F.lit(v) for v in values]),
                                          (i + 1).cast("int"))
    return o.select(
        key.alias("Booking_ID"), (cust % 4).cast("int").alias("no_of_adults"),
        (cust % 2).cast("int").alias("no_of_children"),
        (key % 3).cast("int").alias("no_of_weekend_nights"),
        (key % 6).cast("int").alias("no_of_week_nights"),
        pick(["Meal Plan 1", "Meal Plan 2", "Meal Plan 3", "Not Selected", "Brunch"], key % 5)
        .alias("type_of_meal_plan"),
        (key % 9 == 0).cast("int").alias("required_car_parking_space"),
        F.concat(F.lit("Room_Type "), (key % 8 + 1).cast("string")).alias("room_type_reserved"),
        (key % 300).cast("int").alias("lead_time"), F.year(date).alias("arrival_year"),
        F.month(date).alias("arrival_month"), (key % 31 + 1).cast("int").alias("arrival_date"),
        pick(["Online", "Offline", "Corporate", "Aviation", "Complementary", "Walk-in"], key % 6)
        .alias("market_segment_type"),
        (cust % 10 == 0).cast("int").alias("repeated_guest"),
        (cust % 3).cast("int").alias("no_of_previous_cancellations"),
        (cust % 5).cast("int").alias("no_of_previous_bookings_not_canceled"),
        (F.col("o_totalprice") / 1000).alias("avg_price_per_room"),
        (key % 4).cast("int").alias("no_of_special_requests"),
        F.when(F.col("o_orderstatus") == "F", "Canceled").otherwise("Not_Canceled")
        .alias("booking_status"),
    )


def requests(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None) -> DataFrame:
    """Scoring requests: bookings with the defects a caller might send; `lines` as in `bookings`."""
    b = bookings(spark, sf_dir, lines)
    key, month = F.col("order_key"), F.col("arrival_date_month")
    return b.withColumns({
        "arrival_date": F.when(key % 2 == 0, F.col("ship_day")),
        "arrival_date_year": F.when(key % 50 == 0, F.col("arrival_date_year") + 1)
        .when(key % 7 == 0, F.lit(None)).otherwise(F.col("arrival_date_year")),
        "arrival_date_month": F.when(key % 3 == 0, F.substring(month, 1, 3))
        .when(key % 41 == 0, "Smarch").otherwise(month),
        "lead_time": F.when(key % 31 == 0, -F.col("lead_time") - 1).otherwise(F.col("lead_time")),
        "hotel": F.when(key % 61 != 0, F.col("hotel")),
    }).drop("is_canceled", "booking_date", "ship_day")
