"""Reports on price forecasts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def segment_errors(df: DataFrame, by: Sequence[str], min_rows: int = 50) -> DataFrame:
    """Forecast errors per segment, worst first."""
    e = F.col("adr") - F.col("predicted_adr")
    return df.filter(e.isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.abs(e)).alias("mae"), F.avg("adr").alias("mean_actual"),
        F.avg("predicted_adr").alias("mean_predicted"),
    ).filter(F.col("n") >= min_rows).orderBy(F.desc("rmse"), *by)


def monthly_residual(df: DataFrame, day: str = "arrival_date") -> DataFrame:
    e = F.col("adr") - F.col("predicted_adr")
    return df.filter(e.isNotNull()).groupBy(F.trunc(day, "month").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(e).alias("mean_residual"))


def residual_histogram(df: DataFrame, width: float = 10.0) -> DataFrame:
    e = F.col("adr") - F.col("predicted_adr")
    return df.filter(e.isNotNull()).groupBy((F.floor(e / width) * width).cast("double").alias("bin")
                                            ).agg(F.count(F.lit(1)).alias("n"))


def overfit_gap(df: DataFrame) -> DataFrame:
    """Test error against training error per model."""
    return df.withColumns({
        "gap": F.col("test_rmse") - F.col("train_rmse"),
        "ratio": F.try_divide("test_rmse", "train_rmse")})
