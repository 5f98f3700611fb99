"""Daily and monthly tables.  Windows here run over calendar-bounded series, never over rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import written_table
from .metrics import P, Y, threshold_metrics
from .splits import time_buckets


def _series(*by: str):
    return Window.partitionBy(*(by or (F.lit(0),)))


def calendar(df: DataFrame, day: str) -> DataFrame:
    """Date dimension over the days the table covers."""
    span = df.agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    days = span.select(F.explode(F.sequence("lo", "hi")).alias("date"))
    return days.select(
        "date", F.year("date").alias("year"), F.month("date").alias("month"),
        F.date_format("date", "MMMM").alias("month_name"), F.weekofyear("date").alias("iso_week"),
        F.quarter("date").alias("quarter"), F.dayofweek("date").alias("weekday"))


def monthly_trend(df: DataFrame, day: str = "arrival_date") -> DataFrame:
    """Bookings and rate per month with a trailing 3-month mean; empty months are present."""
    rows = df.filter(F.col(day).isNotNull())
    monthly = rows.groupBy(F.trunc(day, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"))
    span = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    months = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))
                                   ).alias("month"))
    full = months.join(monthly, "month", "left").fillna({"n": 0})
    trail = _series().orderBy("month").rowsBetween(-2, 0)
    return full.withColumn("rate_3m", F.avg("cancel_rate").over(trail))


def monthly_revenue(df: DataFrame, t: float, day: str = "arrival_date") -> DataFrame:
    flagged, high = F.col(P) >= t, F.col("risk_tier") == "high"
    money = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("revenue_at_risk"))), F.lit(0.0))
    return df.groupBy(F.trunc(day, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(flagged).alias("flagged"),
        F.avg(Y).alias("cancel_rate"), F.sum("revenue_at_risk").alias("revenue"),
        money(flagged).alias("flagged_revenue"), money(high).alias("high_tier_revenue"))


def daily_adr(df: DataFrame, by: Sequence[str] = (), day: str = "arrival_date") -> DataFrame:
    """Mean rate per arrival day, over rates above 0."""
    return df.filter((F.col("adr") > 0) & F.col(day).isNotNull()).groupBy(
        *by, F.col(day).alias("day")).agg(F.avg("adr").alias("adr_mean"),
                                          F.count(F.lit(1)).alias("n"))


def daily_rate(df: DataFrame, day: str = "arrival_date") -> DataFrame:
    return df.groupBy(F.col(day).alias("day")).agg(
        F.avg(Y).alias("cancel_rate"), F.count(F.lit(1)).alias("n"))


def rolling_rows(series: DataFrame, value: str, rows: int, by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean over a number of rows of each series."""
    w = _series(*by).orderBy("day").rowsBetween(1 - rows, 0)
    return series.withColumn(f"{value}_roll{rows}", F.avg(value).over(w))


def rolling_days(series: DataFrame, value: str, days: int, by: Sequence[str] = ()) -> DataFrame:
    """Trailing mean over calendar days, so gaps do not stretch the window."""
    number = F.unix_date("day")
    w = _series(*by).orderBy(number).rangeBetween(1 - days, 0)
    return series.withColumn(f"{value}_{days}d", F.avg(value).over(w))


def temporal_stability(df: DataFrame, keys: Sequence[str], k: int, t: float,
                       day: str = "arrival_date") -> DataFrame:
    """Size, dates, rate and metrics of k equal time buckets.

    The columns in use are written once: the cuts, the sizes and the metrics read them, and do not
    make ``df`` anew.
    """
    rows = time_buckets(written_table(df.select(*dict.fromkeys([day, *keys, Y, P])), "stability-rows"), day, keys, k)
    sizes = rows.groupBy("bucket").agg(
        F.count(F.lit(1)).alias("n"), F.min(day).alias("first_day"), F.max(day).alias("last_day"),
        F.avg(Y).alias("positive_rate"))
    return sizes.join(threshold_metrics(rows, t, ["bucket"]).select(
        "bucket", "roc_auc", "pr_auc", "f1"), "bucket")


def tier_calibration(df: DataFrame, keys: Sequence[str], k: int, day: str = "arrival_date"
                     ) -> DataFrame:
    """Predicted against observed rate per tier, per time bucket and overall (bucket 0); rows as in `temporal_stability`."""
    names = dict.fromkeys([day, *keys, "risk_tier", Y, P])
    rows = time_buckets(written_table(df.select(*names), "calibration-rows"), day, keys, k)
    return rows.groupingSets(
        [["bucket", "risk_tier"], ["risk_tier"]], "bucket", "risk_tier"
    ).agg(F.count(F.lit(1)).alias("n"), F.avg(P).alias("predicted"), F.avg(Y).alias("observed")
          ).withColumn("gap", F.col("observed") - F.col("predicted")).fillna({"bucket": 0})


def seasonal_decompose(series: DataFrame, value: str, by: Sequence[str], period: int = 7
                       ) -> DataFrame:
    """Additive parts: centred moving average, mean by phase (summing to 0), and the rest."""
    half = period // 2
    order = _series(*by).orderBy("day")
    centred = order.rowsBetween(-half, half)
    trend = F.when(F.count(value).over(centred) == period, F.avg(value).over(centred))
    parts = series.withColumns({
        "phase": ((F.row_number().over(order) - 1) % period), "trend": trend,
    })
    phases = parts.groupBy(*by, "phase").agg(F.avg(F.col(value) - F.col("trend")).alias("raw"))
    zero = F.avg("raw").over(_series(*by))
    phases = phases.select(*by, "phase", (F.col("raw") - zero).alias("seasonal"))
    return parts.join(phases, [*by, "phase"]).withColumn(
        "residual", F.col(value) - F.col("trend") - F.col("seasonal"))


def first_difference(series: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    order = _series(*by).orderBy("day")
    return series.withColumn(value, F.col(value) - F.lag(value).over(order)).filter(
        F.col(value).isNotNull())


def autocorrelation(series: DataFrame, value: str, by: Sequence[str], lags: int = 40) -> DataFrame:
    """Autocorrelation at lags 1..n; all lags come from one window pass over each series."""
    order = _series(*by).orderBy("day")
    centred = series.withColumn("_c", F.col(value) - F.avg(value).over(_series(*by)))
    shifted = centred.withColumns({f"_l{k}": F.lag("_c", k).over(order)
                                   for k in range(1, lags + 1)})
    sums = shifted.groupBy(*by).agg(
        F.sum(F.col("_c") * F.col("_c")).alias("_v"),
        *[F.sum(F.col("_c") * F.col(f"_l{k}")).alias(f"_s{k}") for k in range(1, lags + 1)])
    return sums.select(*by, F.inline(F.array(*[
        F.struct(F.lit(k).alias("lag"),
                 F.try_divide(F.coalesce(F.col(f"_s{k}"), F.lit(0.0)), F.col("_v")).alias("acf"))
        for k in range(1, lags + 1)])))


def baseline_forecast(series: DataFrame, value: str, split_day, by: Sequence[str]) -> DataFrame:
    """Errors of forecasting every test day by the mean of the training days."""
    past = F.col("day") < F.lit(split_day).cast("date")
    means = series.filter(past).groupBy(*by).agg(F.avg(value).alias("forecast"))
    e = F.col(value) - F.col("forecast")
    return series.filter(~past).join(means, list(by)).groupBy(*by).agg(
        F.count(F.lit(1)).alias("horizon"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"),
        (100 * F.avg(F.abs(F.try_divide(e, F.col(value))))).alias("mape"))
