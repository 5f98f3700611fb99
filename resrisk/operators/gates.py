"""Quality gates and run comparison as table operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import config as C
from .ordering import unpivot


def metric_gates(metrics: DataFrame, gates=C.METRIC_GATES) -> DataFrame:
    """Each gate against the (policy, metric, value) table; a missing metric fails."""
    wanted = metrics.sparkSession.createDataFrame(
        gates, "policy string, metric string, minimum double")
    return wanted.join(metrics, ["policy", "metric"], "left").withColumn(
        "passed", F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False)))


def segment_gates(segments: DataFrame, gates=C.SEGMENT_GATES,
                  dimensions: Sequence[str] = tuple(C.SEGMENT_DIMENSIONS)) -> DataFrame:
    """Gated segments below a minimum, and dimensions without any gated segment."""
    spark = segments.sparkSession
    gated = segments.filter("gated")
    limits = spark.createDataFrame(gates, "metric string, minimum double")
    long = unpivot(gated, [m for m, _ in gates], ["dimension", "segment"], ("metric", "value"),
                   "double")
    failed = long.join(F.broadcast(limits), "metric").filter(
        F.col("value").isNull() | (F.col("value") < F.col("minimum"))
    ).withColumn("problem", F.lit("below_minimum"))
    expected = spark.createDataFrame([(d,) for d in dimensions], "dimension string")
    missing = expected.join(gated, "dimension", "left_anti").withColumn(
        "problem", F.lit("missing_dimension"))
    return failed.unionByName(missing, allowMissingColumns=True)


def threshold_sync(a: DataFrame, b: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Policies whose stored thresholds differ between two tables."""
    both = a.select("policy", F.col("threshold").alias("threshold_a")).join(
        b.select("policy", F.col("threshold").alias("threshold_b")), "policy", "full_outer")
    gap = F.abs(F.col("threshold_a") - F.col("threshold_b"))
    return both.withColumn("in_sync", F.coalesce(gap <= tolerance, F.lit(False)))


def table_delta(a: DataFrame, b: DataFrame, keys: Sequence[str], values: Sequence[str],
                tolerance: float = 1e-6) -> DataFrame:
    """Absolute numeric differences between two runs of a table; NaN equals NaN."""
    long = lambda df, n: unpivot(df, values, list(keys), ("name", n), "double")
    both = long(a, "left_value").join(long(b, "right_value"), [*keys, "name"], "full_outer")
    same = F.isnan("left_value") & F.isnan("right_value")
    return both.withColumn(
        "delta", F.when(same, 0.0).otherwise(F.abs(F.col("left_value") - F.col("right_value")))
    ).withColumn("unstable", F.coalesce(F.col("delta") > tolerance, F.lit(True)))


def delta_summary(deltas: DataFrame) -> DataFrame:
    return deltas.agg(F.count(F.lit(1)).alias("checked"), F.max("delta").alias("max_delta"),
                      F.count_if("unstable").alias("n_unstable"))


def capacity_gap(metrics: DataFrame) -> DataFrame:
    """Split the gap champion - default into capacity (matched - default) and algorithm."""
    at = lambda n: F.max(F.when(F.col("variant") == n, F.col("pr_auc")))
    facts = metrics.agg(at("default").alias("d"), at("matched").alias("m"),
                        at("champion").alias("c"))
    share = F.try_divide(100 * (F.col("m") - F.col("d")), F.col("c") - F.col("d"))
    return facts.select(
        (F.col("c") - F.col("d")).alias("total_gap"), (F.col("m") - F.col("d")).alias("capacity"),
        (F.col("c") - F.col("m")).alias("algorithm"), share.alias("capacity_pct"),
        (100 - share).alias("algorithm_pct"))
