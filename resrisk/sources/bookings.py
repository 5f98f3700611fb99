"""Booking sources: CSV / Parquet scans with fixed schemas, and three adapters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.clean import derive_features, month_name, safe_numeric, value_map

_S, _I, _D = T.StringType(), T.IntegerType(), T.DoubleType()

BOOKINGS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("hotel", _S), ("is_canceled", _I), ("lead_time", _I), ("arrival_date_year", _I),
    ("arrival_date_month", _S), ("arrival_date_week_number", _I),
    ("arrival_date_day_of_month", _I), ("stays_in_weekend_nights", _I),
    ("stays_in_week_nights", _I), ("adults", _I), ("children", _D), ("babies", _I),
    ("meal", _S), ("country", _S), ("market_segment", _S), ("distribution_channel", _S),
    ("is_repeated_guest", _I), ("previous_cancellations", _I),
    ("previous_bookings_not_canceled", _I), ("reserved_room_type", _S),
    ("assigned_room_type", _S), ("booking_changes", _I), ("deposit_type", _S), ("agent", _S),
    ("company", _S), ("days_in_waiting_list", _I), ("customer_type", _S), ("adr", _D),
    ("required_car_parking_spaces", _I), ("total_of_special_requests", _I),
    ("reservation_status", _S), ("reservation_status_date", _S),
]])

PMS_SCHEMA = T.StructType([T.StructField(n, t) for n, t in [
    ("Booking_ID", _S), ("Booking_Status", _S), ("Booking_Date", _S), ("Arrival_Date", _S),
    ("Lead_Time_Days", _I), ("Weekend_Nights", _I), ("Week_Nights", _I), ("Nights_Stayed", _I),
    ("Adults", _I), ("Children", _I), ("Babies", _I), ("Total_Guests", _I), ("ADR_Rate", _D),
    ("Total_Cost", _D), ("Room_Type", _S), ("Deposit_Type", _S), ("Special_Requests", _I),
    ("Meals", _S), ("Guest_Type", _S), ("Is_Canceled", _I), ("Arrival_Year", _I),
    ("Arrival_Month", _S), ("Arrival_DayOfWeek", _S),
]])

# Column names of the second market's export and of the public reservations table.
PMS_RENAMES = {
    "Lead_Time_Days": "lead_time", "Weekend_Nights": "stays_in_weekend_nights",
    "Week_Nights": "stays_in_week_nights", "Adults": "adults", "Children": "children",
    "Babies": "babies", "ADR_Rate": "adr", "Room_Type": "reserved_room_type",
    "Deposit_Type": "deposit_type", "Special_Requests": "total_of_special_requests",
}
PMS_SHADOWED = ["Is_Canceled", "Arrival_Year", "Arrival_Month", "Arrival_DayOfWeek", "Total_Cost",
                "Total_Guests"]
PMS_SPENT = ["Booking_Status", "Booking_ID", "Meals", "Guest_Type", "Nights_Stayed",
             "Booking_Date", "Arrival_Date"]
PMS_STATUS = {"Cancelled": 1, "Checked-in": 0}
RESERVATION_RENAMES = {
    "no_of_adults": "adults", "no_of_children": "children",
    "no_of_weekend_nights": "stays_in_weekend_nights",
    "no_of_week_nights": "stays_in_week_nights", "type_of_meal_plan": "meal",
    "required_car_parking_space": "required_car_parking_spaces",
    "room_type_reserved": "reserved_room_type", "arrival_year": "arrival_date_year",
    "arrival_date": "arrival_date_day_of_month", "market_segment_type": "market_segment",
    "repeated_guest": "is_repeated_guest",
    "no_of_previous_cancellations": "previous_cancellations",
    "no_of_previous_bookings_not_canceled": "previous_bookings_not_canceled",
    "avg_price_per_room": "adr", "no_of_special_requests": "total_of_special_requests",
}
MEAL_PLANS = {"Meal Plan 1": "BB", "Meal Plan 2": "HB", "Meal Plan 3": "FB",
              "Not Selected": "Undefined"}
ROOM_LETTERS = {f"Room_Type {i}": letter for i, letter in enumerate("ABCDEFG", start=1)}
SEGMENT_CHANNELS = {"Online": "TA/TO", "Offline": "TA/TO", "Corporate": "Corporate",
                    "Aviation": "Direct", "Complementary": "Direct"}
RESERVATION_DEFAULTS = {"hotel": "City Hotel", "country": "UNKNOWN", "babies": 0,
                        "deposit_type": "No Deposit", "agent": "NULL",
                        "customer_type": "Transient"}


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = BOOKINGS_SCHEMA) -> DataFrame:
    """Header CSV with a fixed schema (no inference pass), byte-order mark tolerated.

    Columns are taken by name: the header may come in any order and lack some of them.
    """
    text = spark.read.option("header", True).csv(path)
    clean = [c.lstrip("﻿").strip() for c in text.columns]
    text = text.toDF(*clean)
    df = text.select([
        F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema if f.name in clean
    ])
    return require_rows(df, path)


def scan_parquet(spark: SparkSession, path: str) -> DataFrame:
    return require_rows(spark.read.parquet(path), path)


def require_rows(df: DataFrame, path: str) -> DataFrame:
    if df.isEmpty():
        raise ValueError(f"no rows in {path}")
    return df


def distinct_values(df: DataFrame, cols: list[str], fallback: dict[str, list[str]] | None = None
                    ) -> DataFrame:
    """Rows (column_name, choice): distinct trimmed non-empty values per column.

    A column without any has the values of its fallback list.
    """
    present = [c for c in cols if c in df.columns]
    pairs = F.array(*[F.struct(F.lit(c).alias("column_name"),
                               F.trim(F.col(c).cast("string")).alias("value")) for c in present])
    found = df.select(F.inline(pairs)).filter(F.col("value") != "").distinct()
    spare = df.sparkSession.createDataFrame(
        [(c, v) for c, values in (fallback or {}).items() if c in cols for v in values],
        "column_name string, value string")
    spare = spare.join(found.select("column_name").distinct(), "column_name", "left_anti")
    return found.unionByName(spare).withColumnRenamed("value", "choice")


def adapt_reservations(df: DataFrame) -> DataFrame:
    """Public reservations table to the booking schema; impossible dates are dropped."""
    if "booking_status" not in df.columns:
        raise ValueError("source has no booking_status column")
    df = df.withColumnsRenamed(RESERVATION_RENAMES)
    month = F.coalesce(F.floor(safe_numeric(F.col("arrival_month"))), F.lit(1)).cast("int")
    date = F.try_to_date(
        F.concat_ws("-", "arrival_date_year", month, "arrival_date_day_of_month"), "yyyy-M-d")
    df = df.withColumns({
        "is_canceled": (F.col("booking_status") == "Canceled").cast("int"),
        "arrival_date_month": month_name(F.greatest(F.lit(1), F.least(F.lit(12), month))),
        "arrival_date_week_number": F.weekofyear(date),
        "_date": date,
        "meal": value_map(F.col("meal"), MEAL_PLANS),
        "reserved_room_type": value_map(F.col("reserved_room_type"), ROOM_LETTERS),
        "distribution_channel": value_map(
            F.col("market_segment"), SEGMENT_CHANNELS, F.lit("TA/TO")),
    }).filter(F.col("_date").isNotNull())
    absent = {c: F.lit(v) for c, v in RESERVATION_DEFAULTS.items() if c not in df.columns}
    return (
        df.withColumns(absent).drop("booking_status", "Booking_ID", "arrival_month", "_date")
        .orderBy("arrival_date_year", "arrival_date_week_number", "arrival_date_day_of_month")
    )


def canonicalise_pms(df: DataFrame) -> DataFrame:
    """Second market's export to the booking schema, with derived features."""
    for needed in ("Booking_Status", "Arrival_Date"):
        if needed not in df.columns:
            raise ValueError(f"export has no {needed} column")
    arrival = F.try_to_date(F.col("Arrival_Date").cast("string"), "yyyy-MM-dd")
    kept = (
        df.drop(*PMS_SHADOWED).withColumnsRenamed(PMS_RENAMES)
        .filter(F.col("Booking_Status").isin(list(PMS_STATUS)))
        .withColumn("_arrival", arrival).filter(F.col("_arrival").isNotNull())
        .withColumns({
            "is_canceled": (F.col("Booking_Status") == "Cancelled").cast("int"),
            "arrival_date_year": F.year("_arrival"),
            "arrival_date_month": F.date_format("_arrival", "MMMM"),
            "arrival_date_day_of_month": F.day("_arrival"),
        })
        .drop("_arrival", *PMS_SPENT)
    )
    return derive_features(kept)


def pms_issue_counts(df: DataFrame) -> DataFrame:
    known = F.coalesce(F.col("Booking_Status").isin(list(PMS_STATUS)), F.lit(False))
    date = F.try_to_date(F.col("Arrival_Date").cast("string"), "yyyy-MM-dd")
    return df.agg(
        F.count_if(~known).alias("rows_dropped_unknown_status"),
        F.count_if(known & date.isNull()).alias("rows_dropped_unparseable_arrival_date"),
    )


def pms_request_features(df: DataFrame) -> DataFrame:
    """Scoring-time rows through the training cleaner, under a placeholder status."""
    held = df.withColumn("Booking_Status", F.lit("Checked-in"))
    return canonicalise_pms(held).drop("is_canceled")
