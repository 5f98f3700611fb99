"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table
from .names import shielded

#: Up to this many sources (a rate has less than 2 KB) are sent to all tasks; rows of more are
#: dealt by source and salt.
SENT_SOURCES, SALTS = 8192, 64

#: A larger rate is the sum of several independent Poisson counts, each of a rate up to this.
PART = 64.0


def uniform(*parts: Column) -> Column:
    """A double in [0, 1) from the first 52 bits of an MD5 hash of the parts."""
    digest = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def target_rates(docs: DataFrame, weights: Mapping[str, float], default: float = 1.0,
                 source: str = "source", epochs: float = 1.0) -> DataFrame:
    """One row per source: rows, mean repetition rate, and the Poisson distribution of one part.

    The rate is `epochs * rows of all * share / rows of the source`, so that the expected number
    of rows of the mix is `epochs` times the input and each source has its share of the weights.
    Sources without a weight get `default`; a null source is a source of its own. Weights are
    shares among the sources that occur.
    """
    if any(w < 0 for w in [default, *weights.values()]):
        raise ValueError("weights must not be negative")
    weight = F.lit(float(default))
    for name, w in weights.items():
        weight = F.when(F.col("_source") == name, F.lit(float(w))).otherwise(weight)
    counted = docs.select(F.col(source).alias("_source")).groupBy("_source").agg(
        F.count(F.lit(1)).alias("_rows")).withColumn("_weight", weight)
    counted = counted.withColumn("_all", counted.agg(F.sum("_rows")).scalar()).withColumn(
        "_weights", counted.agg(F.sum("_weight")).scalar())
    rate = F.when(F.col("_weights") > 0, F.lit(float(epochs)) * F.col("_all") * F.col("_weight")
                  / F.col("_weights") / F.col("_rows")).otherwise(F.lit(0.0))
    rated = counted.withColumn("_rate", rate)
    rated = rated.withColumn("_parts", F.greatest(F.lit(1), F.ceil(F.col("_rate") / PART)).cast("int"))
    rated = rated.withColumn("_mean", F.col("_rate") / F.col("_parts"))
    # P(count <= k) for k = 0, 1, ... far beyond the last double below one.
    last = F.ceil(F.col("_mean") + 12 * F.sqrt("_mean") + 40).cast("int")
    start = F.struct(F.exp(-F.col("_mean")).alias("p"), F.exp(-F.col("_mean")).alias("c"),
                     F.array(F.exp(-F.col("_mean"))).alias("all"))
    steps = F.aggregate(F.sequence(F.lit(1), last), start, lambda a, k: F.struct(
        (a["p"] * F.col("_mean") / k).alias("p"),
        (a["c"] + a["p"] * F.col("_mean") / k).alias("c"),
        F.concat(a["all"], F.array(a["c"] + a["p"] * F.col("_mean") / k)).alias("all")))
    return rated.select("_source", "_rows", "_rate", "_parts", steps["all"].alias("_at_most"))


@shielded
def poisson_mix(docs: DataFrame, weights: Mapping[str, float], default: float = 1.0,
                source: str = "source", key: str = "doc_id", epochs: float = 1.0,
                seed: int = 0, sent: int = SENT_SOURCES) -> DataFrame:
    """The rows of `docs`, each as often as its Poisson count says, globally shuffled.

    A row's count inverts the Poisson distribution of its source's rate at a uniform number that
    is a hash of seed and key, so a repeated task draws the same. Results: the input columns,
    `copy` (0, 1, ...) and `shuffle_key`. Rows are dealt over the shuffle partitions by the hash
    `shuffle_key` and ordered by it within each, which is a random order of the whole mix.

    The rates are counted: those of up to 8,192 sources are sent to all tasks and no row moves for
    them; beyond, rows meet them in a join by source and one of 64 salts.

    Rows with the same key get the same count each; a null key is hashed as the word null. Input
    columns called `copy` or `shuffle_key` are replaced. An empty table gives an empty one. The
    text is never looked at and may be null or of any length.
    """
    out = ["copy", "shuffle_key"]
    kept = [c for c in docs.columns if c not in out]
    rates = target_rates(docs, weights, default, source, epochs).select(
        F.col("_source").alias("_of"), "_parts", "_at_most")
    rates = written_table(rates, "llm-mix-rates")
    rows = docs.drop(*out).withColumn("_name", F.coalesce(F.col(key).cast("string"), F.lit("null")))
    same = F.col(source).eqNullSafe(F.col("_of"))
    if rates.count() <= sent:
        rows = rows.join(F.broadcast(rates), same)
    else:
        salted = rates.withColumn("_salt_of", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        rows = rows.withColumn("_salt", F.pmod(F.xxhash64("_name"), F.lit(SALTS)).cast("int"))
        rows = rows.join(salted, same & (F.col("_salt") == F.col("_salt_of")))
    draws = F.transform(F.sequence(F.lit(1), F.col("_parts")), lambda j: F.size(F.filter(
        "_at_most", lambda c: c <= uniform(F.lit(str(seed)), F.col("_name"), j.cast("string")))))
    rows = rows.withColumn("_count", F.aggregate(draws, F.lit(0), lambda a, x: a + x))
    rows = rows.filter("_count > 0").withColumn(
        "copy", F.explode(F.sequence(F.lit(0), F.col("_count") - 1)))
    rows = rows.withColumn("shuffle_key", F.md5(F.concat_ws(
        "|", F.lit(f"order {seed}"), "_name", F.col("copy").cast("string"))))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], *out)
    return rows.repartition("shuffle_key").sortWithinPartitions("shuffle_key")
