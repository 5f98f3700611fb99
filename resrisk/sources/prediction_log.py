"""Append-only prediction log as day-partitioned Parquet."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

logger = logging.getLogger(__name__)

TOP_FEATURES = "array<struct<feature:string,value:string,contribution:double>>"


def log_rows(df: DataFrame, at: Column | None = None) -> DataFrame:
    """Rows in the stored form: time stamp, booleans as 0 / 1, nested values as JSON text."""
    flat = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, T.BooleanType):
            flat[f.name] = F.col(f.name).cast("int")
        elif isinstance(f.dataType, (T.ArrayType, T.StructType, T.MapType)):
            flat[f.name] = F.to_json(F.col(f.name))
    stamp = F.current_timestamp() if at is None else at
    out = df.withColumns(flat).withColumn("timestamp_utc", stamp)
    return out.withColumn("dt", F.to_date("timestamp_utc"))


def append_log(df: DataFrame, path: str, at: Column | None = None) -> bool:
    """Append scored rows.  A failing log must not fail the scoring: it is reported as False."""
    try:
        # One task writes a day, or several of a large day: not every task a file for each day.
        rows = log_rows(df, at).hint("rebalance", "dt")
        rows.write.mode("append").partitionBy("dt").parquet(path)
        return True
    except Exception:
        logger.exception("could not append to the prediction log %s", path)
        return False


def read_log(spark: SparkSession, path: str, expected: T.StructType | None = None) -> DataFrame:
    """The log with the columns of all its versions; columns added later are null before."""
    df = spark.read.option("mergeSchema", True).parquet(path)
    return with_missing_columns(df, expected) if expected else df


def with_missing_columns(df: DataFrame, expected: T.StructType) -> DataFrame:
    return df.withColumns({
        f.name: F.lit(None).cast(f.dataType) for f in expected.fields if f.name not in df.columns
    })


def decode(df: DataFrame) -> DataFrame:
    return df.withColumns({
        "alerts": F.from_json("alerts", "array<string>"),
        "top_features": F.from_json("top_features", TOP_FEATURES),
    })


def log_since(df: DataFrame, since: str, day: str = "dt", stamp: str = "timestamp_utc"
              ) -> DataFrame:
    """Rows from ``since`` on; the day filter prunes partitions, the time filter row groups."""
    at = F.lit(since).cast("timestamp")
    return df.filter((F.col(day) >= F.to_date(at)) & (F.col(stamp) >= at)).orderBy(stamp)


def log_exists(spark: SparkSession, path: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def export_since(spark: SparkSession, path: str, out: str, since: str) -> int:
    """Write the rows since a time as CSV in time order; number of rows (0 without a log).

    A log that cannot be read, as with a missing column, raises.
    """
    if not log_exists(spark, path):
        return 0
    rows = log_since(read_log(spark, path), since).drop("dt")
    rows.write.mode("overwrite").option("header", True).csv(out)
    # Counted from what was written: rows may be appended to the log meanwhile.
    return spark.read.schema(rows.schema).option("header", True).option("multiLine", True).csv(out).count()


def count_log(spark: SparkSession, path: str) -> int:
    return read_log(spark, path).count() if log_exists(spark, path) else 0


def write_report(df: DataFrame, folder: str, name: str) -> None:
    """A report table as CSV and Parquet."""
    df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}.csv")
    df.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")
