"""Cleaning, derivation and validation of booking rows as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C


def null_like_to_null(c: Column) -> Column:
    return F.when(~c.cast("string").isin(C.NULL_TOKENS), c)


def safe_numeric(c: Column) -> Column:
    """Text to double; anything unreadable (and NaN) becomes null."""
    number = c.try_cast("double")
    return F.nanvl(number, F.lit(None).cast("double"))


def column_or_default(df: DataFrame, name: str, default=0) -> Column:
    return F.col(name) if name in df.columns else F.lit(default)


def month_number(month: Column) -> Column:
    names = F.array(*[F.lit(m) for m in C.MONTHS])
    return F.nullif(F.array_position(names, month), F.lit(0)).cast("int")


def month_name(number: Column) -> Column:
    return F.try_element_at(F.array(*[F.lit(m) for m in C.MONTHS]), number)


def arrival_date(year: Column, month: Column, day: Column) -> Column:
    """Date from (year, month name, day); impossible dates become null.

    Built by day arithmetic, which is far cheaper per row than parsing text.
    """
    y, m, d = year.try_cast("int"), month_number(month), day.try_cast("int")
    first = F.make_date(F.when(y.between(1, 9999), y), m, F.lit(1))
    date = F.date_add(first, d - 1)
    return F.when((d >= 1) & (d <= 31) & (F.month(date) == m), date)


def value_map(c: Column, mapping: dict[str, str], default: Column | None = None) -> Column:
    """Mapped value, or the original (or a default) where the map has none."""
    table = F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv])
    return F.coalesce(F.try_element_at(table, c), c if default is None else default)


def normalise_inputs(df: DataFrame) -> DataFrame:
    rules = {
        "agent": lambda c: F.coalesce(safe_numeric(null_like_to_null(c)), F.lit(0)).cast("int"),
        "company": lambda c: safe_numeric(null_like_to_null(c)),
        "children": lambda c: F.coalesce(safe_numeric(c), F.lit(0.0)),
        "country": lambda c: F.coalesce(null_like_to_null(c), F.lit("Unknown")),
        "arrival_date_month": lambda c: F.initcap(F.trim(c.cast("string"))),
    }
    return df.withColumns({n: rule(F.col(n)) for n, rule in rules.items() if n in df.columns})


def derive_features(df: DataFrame) -> DataFrame:
    """Booking-time features; one projection, no shuffle."""
    df = normalise_inputs(df)
    zero = lambda name: F.coalesce(safe_numeric(column_or_default(df, name)), F.lit(0.0))
    maybe = lambda name: safe_numeric(column_or_default(df, name, None))
    weekend, week = zero("stays_in_weekend_nights"), zero("stays_in_week_nights")
    guests = zero("adults") + zero("children") + zero("babies")
    stay, adr = weekend + week, maybe("adr")
    if "company" in df.columns:
        had_company = F.col("company").isNotNull().cast("int")
    else:
        had_company = column_or_default(df, "had_company")
    angle = 2 * F.pi() * month_number(column_or_default(df, "arrival_date_month", None)) / 12
    return df.withColumns({
        "total_stay": stay,
        "total_guests": guests,
        "adr_per_person": adr / F.when(guests > 0, guests).otherwise(1.0),
        "is_weekend_heavy": (weekend > week).cast("int"),
        "revenue_at_risk": adr * stay,
        "is_late_window": F.coalesce(
            (maybe("lead_time") <= C.LATE_WINDOW_DAYS).cast("int"), F.lit(0)),
        "had_company": had_company,
        "month_sin": F.sin(angle),
        "month_cos": F.cos(angle),
    })


def ensure_features(df: DataFrame, features=C.FEATURES) -> DataFrame:
    """Fixed feature list in fixed order; absent ones as null."""
    derived = derive_features(df)
    return derived.select([
        F.col(c) if c in derived.columns else F.lit(None).cast("double").alias(c) for c in features
    ])


def add_arrival_date(df: DataFrame) -> DataFrame:
    return df.withColumn("arrival_date", arrival_date(
        F.col("arrival_date_year"), F.col("arrival_date_month"),
        F.col("arrival_date_day_of_month")))


def require_some_dates(df: DataFrame) -> DataFrame:
    """Fail when no row has a readable arrival date (stops at the first readable one)."""
    if df.filter(F.col("arrival_date").isNotNull()).isEmpty():
        raise ValueError("no record has a readable arrival date")
    return df


def _drop_rules() -> dict[str, Column]:
    return {
        "rows_dropped_negative_adr": F.col("adr") < 0,
        "rows_dropped_adr_outlier": F.col("adr") >= C.ADR_MAX_VALID,
        "rows_dropped_zero_guests": F.col("total_guests") == 0,
        "rows_dropped_null_guests": F.col("total_guests").isNull(),
    }


def _invalid() -> Column:
    rules = _drop_rules()
    guests = F.coalesce(F.col("total_guests"), F.lit(0.0)) <= 0
    return (
        F.coalesce(rules["rows_dropped_negative_adr"], F.lit(False))
        | F.coalesce(rules["rows_dropped_adr_outlier"], F.lit(False))
        | guests
    )


def clean_bookings(df: DataFrame) -> DataFrame:
    """Derived rows without negative or absurd rates and without empty parties."""
    return derive_features(df).filter(~_invalid()).drop("company")


def cleaning_issue_counts(df: DataFrame) -> DataFrame:
    """How often each cleaning rule matched, in one pass before rows are dropped."""
    raw_children = F.col("children").isNull() if "children" in df.columns else F.lit(False)
    marked = derive_features(df.withColumn("_children_null", raw_children))
    issues = {
        "children_null_filled_zero": F.col("_children_null"),
        "agent_filled_as_direct": F.col("agent") == 0,
        "country_unknown_rows": F.lower(F.trim("country")) == "unknown",
        **_drop_rules(),
        "rows_dropped_total": _invalid(),
    }
    counts = marked.agg(*[F.count_if(c).alias(n) for n, c in issues.items()])
    return melt(counts, "issue", "n")


def melt(df: DataFrame, key: str, value: str) -> DataFrame:
    """Turn a one-row frame into (name, value) rows."""
    return df.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias(key), F.col(c).alias(value)) for c in df.columns
    ])))


def validate_table(df: DataFrame, features=C.FEATURES, non_negative=C.NON_NEGATIVE) -> DataFrame:
    """Checks as (check_name, passed, message) rows from one aggregate."""
    missing = sorted(set([*features, C.TARGET]) - set(df.columns))
    has_target = C.TARGET in df.columns
    present = [c for c in non_negative if c in df.columns]
    y = F.col(C.TARGET) if has_target else F.lit(None).cast("int")
    facts = df.agg(
        F.count(y).alias("n_target"),
        F.count_if(~y.isin(0, 1)).alias("n_bad_target"),
        *[F.count_if(safe_numeric(F.col(c)) < 0).alias(f"neg_{c}") for c in present],
    )
    negative = F.array_compact(F.array(*[
        F.when(F.col(f"neg_{c}") > 0, F.lit(f"Negative values found in {c}.")) for c in present
    ])) if present else F.array().cast("array<string>")
    filled = F.col("n_target") > 0
    binary = filled & (F.col("n_bad_target") == 0)
    row = lambda name, ok, message: F.struct(
        F.lit(name).alias("check_name"), ok.alias("passed"), message.alias("message"))
    note = lambda ok, text: F.when(~ok, F.lit(text))
    return facts.select(F.inline(F.array(
        row("required_columns_present", F.lit(not missing),
            F.lit(f"Missing required columns: {missing}" if missing else None).cast("string")),
        row("target_non_empty", filled, note(filled, "Target column has no non-null values.")),
        row("target_binary", binary, note(binary, "Target column must be binary 0/1.")),
        row("non_negative_numeric", F.size(negative) == 0,
            F.when(F.size(negative) > 0, F.array_join(negative, " "))),
    )))


def missingness_profile(df: DataFrame) -> DataFrame:
    """Null count and share per column with its type, from one aggregate."""
    n = F.count(F.lit(1))
    facts = df.agg(n.alias("_n"), *[
        F.count_if(F.col(c).isNull()).alias(c) for c in df.columns
    ])
    return facts.select(F.inline(F.array(*[
        F.struct(F.lit(f.name).alias("column_name"), F.lit(f.dataType.simpleString()).alias("dtype"),
                 F.col(f.name).alias("n_null"), F.col("_n").alias("n_rows"),
                 (100.0 * F.try_divide(F.col(f.name), F.col("_n"))).alias("pct_null"))
        for f in df.schema.fields
    ])))


def booking_value(adr: Column, nights: Column) -> Column:
    return adr * F.greatest(F.lit(1.0), nights)


def all_true(conditions) -> Column:
    return reduce(lambda a, b: a & b, conditions)
