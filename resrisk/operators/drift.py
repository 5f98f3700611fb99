"""Drift between a baseline and a live table: all features in one long table, one job."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..session import written_table
from .metrics import P, Y, ece, uniform_bin
from .ordering import exact_quantiles, running_sums, unpivot, with_value_levels

LIVE = "is_live"


def psi_zone(psi: Column) -> Column:
    return F.when(psi < C.PSI_STABLE, "stable").when(psi < C.PSI_MONITOR, "monitor").otherwise(
        "retrain")


def psi_status(psi: Column) -> Column:
    """Labels of the monitoring report, whose alarm limit is lower."""
    return F.when(psi < C.PSI_WARN, "OK").when(psi < C.PSI_ALERT, "WARN").otherwise("ALERT")


def p_value_status(p: Column) -> Column:
    return F.when(p < 0.01, "ALERT").when(p < 0.05, "WARN").otherwise("OK")


def mark_live(baseline: DataFrame, live: DataFrame) -> DataFrame:
    """Both tables with a 0 / 1 mark."""
    return baseline.withColumn(LIVE, F.lit(0)).unionByName(live.withColumn(LIVE, F.lit(1)))


def long_numeric(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (LIVE,)) -> DataFrame:
    long = unpivot(df, features, list(keep), ("feature", "value"), "double")
    return long.filter(F.col("value").isNotNull() & ~F.isnan("value"))


def long_categorical(df: DataFrame, features: Sequence[str], keep: Sequence[str] = (LIVE,)
                     ) -> DataFrame:
    long = unpivot(df, features, list(keep), ("feature", "value"), "string")
    return long.filter(F.col("value").isNotNull())


def _psi_from_bins(counts: DataFrame, by: Sequence[str], bins: int, eps_on_share: float | None
                   ) -> DataFrame:
    """PSI from counts per bin; bins without rows take part with their smoothing term."""
    zeros = counts.select(*by).distinct().select(
        *by, F.explode(F.expr(f"sequence(0L, {bins - 1}L)")).alias("bin"),
        F.lit(0).cast("bigint").alias("n_base"), F.lit(0).cast("bigint").alias("n_live"))
    filled = counts.unionByName(zeros).groupBy(*by, "bin").agg(
        F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))
    totals = counts.groupBy(*by).agg(F.sum("n_base").alias("_b"), F.sum("n_live").alias("_l"))
    joined = filled.join(totals, list(by))
    if eps_on_share is None:
        share = lambda n, total: F.try_divide(F.col(n) + F.lit(C.PSI_COUNT_EPS), F.col(total))
    else:
        share = lambda n, total: F.greatest(F.try_divide(F.col(n), F.col(total)), F.lit(eps_on_share))
    return _psi_sum(joined, by, share)


def _psi_sum(joined: DataFrame, by: Sequence[str], share) -> DataFrame:
    """Sum over the bins; 0.0 where a side has no rows at all, so that no feature is lost."""
    b, l = share("n_base", "_b"), share("n_live", "_l")
    term = F.when((F.col("_b") > 0) & (F.col("_l") > 0), (l - b) * F.log(l / b)).otherwise(0.0)
    return joined.groupBy(*by).agg(F.sum(term).alias("psi"))


def _counts(df: DataFrame, by: Sequence[str], key: str) -> DataFrame:
    return df.groupBy(*by, key).agg(
        F.count_if(F.col(LIVE) == 0).alias("n_base"), F.count_if(F.col(LIVE) == 1).alias("n_live"))


def psi_numeric(long: DataFrame, by: Sequence[str] = ("feature",), bins: int = 10) -> DataFrame:
    """PSI on deciles of the baseline; a value on an edge belongs to the bin on its right."""
    by = list(by)
    probs = [i / bins for i in range(1, bins)]
    # Edges and bins both need only the counts per distinct value: written once, read twice.
    counts = written_table(_counts(long, by, "value"), "value-counts")
    edges = exact_quantiles(
        counts.filter("n_base > 0"), "value", probs, by, "n_base"
    ).groupBy(*by).agg(F.collect_list("value").alias("edges"))
    # A feature without baseline has no edges; it stays, in the first bin.
    edges = edges.withColumnsRenamed({c: f"_{c}" for c in by})
    on = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in by]
    bins_of = counts.join(edges, on, "left").withColumn("bin", F.coalesce(F.size(F.filter(
        "edges", lambda e: e <= F.col("value"))), F.lit(0)).cast("bigint"))
    binned = bins_of.groupBy(*by, "bin").agg(
        F.sum("n_base").alias("n_base"), F.sum("n_live").alias("n_live"))
    return _psi_from_bins(binned, by, bins, None)


def psi_uniform(long: DataFrame, by: Sequence[str] = ("feature",), bins: int = 10) -> DataFrame:
    """PSI on equal bins of [0, 1]; shares are kept off zero by clipping."""
    binned = long.withColumn("bin", uniform_bin(F.col("value"), bins).cast("bigint"))
    return _psi_from_bins(_counts(binned, by, "bin"), by, bins, C.PSI_SHARE_EPS)


def psi_categorical(long: DataFrame, by: Sequence[str] = ("feature",)) -> DataFrame:
    """PSI over the union of values of both tables."""
    return _psi_of_values(_counts(long, by, "value"), list(by))


def _psi_of_values(counts: DataFrame, by: Sequence[str]) -> DataFrame:
    totals = counts.groupBy(*by).agg(F.sum("n_base").alias("_b"), F.sum("n_live").alias("_l"))
    share = lambda n, total: F.try_divide(F.col(n), F.col(total)) + F.lit(C.PSI_SHARE_EPS)
    return _psi_sum(counts.join(totals, by), by, share)


def drift_report(baseline: DataFrame, live: DataFrame, numeric: Sequence[str],
                 categorical: Sequence[str], min_rows: int = 10) -> DataFrame:
    """PSI and zone of every feature, worst first; too few live rows give an error."""
    cols = [*numeric, *categorical]
    both = mark_live(baseline.select(*cols), live.select(*cols))
    n_live, n_base = both.agg(F.count_if(F.col(LIVE) == 1), F.count_if(F.col(LIVE) == 0)).first()
    if n_live < min_rows:
        raise ValueError(f"only {n_live} live rows, need {min_rows}")
    # Missing categories count as a value of their own in this report.
    texts = both.fillna("missing", subset=[c for c in categorical])
    rows = psi_numeric(long_numeric(both, numeric)).withColumn("kind", F.lit("numeric")).unionByName(
        psi_categorical(long_categorical(texts, categorical)).withColumn(
            "kind", F.lit("categorical")))
    # A feature whose values are null on both sides has no counts, but a row in the report.
    names = both.sparkSession.createDataFrame(
        [*((c, "numeric") for c in numeric), *((c, "categorical") for c in categorical)],
        "feature string, kind string")
    rows = names.join(rows, ["feature", "kind"], "left").fillna({"psi": 0.0})
    return rows.select(
        "feature", "kind", F.round("psi", 6).alias("psi"), psi_zone(F.col("psi")).alias("zone"),
        F.lit(n_live).cast("bigint").alias("n_live"),
        F.lit(n_base).cast("bigint").alias("n_baseline"),
        F.current_timestamp().alias("computed_at_utc")).orderBy(F.desc("psi"), "feature")


@dataclass(frozen=True)
class BaselineProfile:
    """What a baseline leaves for later comparisons: bin edges and counts per bin, without its rows."""

    edges: dict[str, list[float]]
    counts: DataFrame
    kinds: dict[str, str]
    n_base: int


def _bins(edges: dict[str, list[float]], numeric: Sequence[str], categorical: Sequence[str]) -> Column:
    """All (feature, kind, bin) of a row; a number without a value has none."""
    cells = [F.struct(F.lit("").alias("feature"), F.lit("rows").alias("kind"), F.lit("").alias("bin"))]
    for c in numeric:
        v = F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
        place = sum(((v >= F.lit(e)).cast("int") for e in edges.get(c, [])), F.lit(0))
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit("numeric").alias("kind"),
                              F.when(v.isNotNull(), place.cast("string")).alias("bin")))
    for c in categorical:
        cells.append(F.struct(F.lit(c).alias("feature"), F.lit("categorical").alias("kind"),
                              F.coalesce(F.col(c).cast("string"), F.lit("missing")).alias("bin")))
    return F.array(*cells)


def _bin_counts(rows: DataFrame, edges: dict[str, list[float]], numeric: Sequence[str],
                categorical: Sequence[str]) -> DataFrame:
    each = rows.select(F.inline(_bins(edges, numeric, categorical)))
    return each.filter(F.col("bin").isNotNull()).groupBy("feature", "kind", "bin").agg(F.count(F.lit(1)).alias("n"))


def baseline_profile(base: DataFrame, numeric: Sequence[str], categorical: Sequence[str], path: str,
                     bins: int = 10) -> BaselineProfile:
    """The profile of a baseline, its counts stored under ``path``; edges are exact quantiles."""
    rows = exact_quantiles(long_numeric(base.withColumn(LIVE, F.lit(0)), numeric), "value",
                           [i / bins for i in range(1, bins)], ["feature"]).collect()
    edges: dict[str, list[float]] = {}
    for r in sorted(rows, key=lambda r: r["prob"]):
        edges.setdefault(r["feature"], []).append(float(r["value"]))
    _bin_counts(base, edges, numeric, categorical).write.mode("overwrite").parquet(path)
    counts = base.sparkSession.read.schema("feature string, kind string, bin string, n bigint").parquet(path)
    total = counts.filter("kind = 'rows'").agg(F.sum("n")).first()[0] or 0
    kinds = {**{c: "numeric" for c in numeric}, **{c: "categorical" for c in categorical}}
    return BaselineProfile(edges, counts.filter("kind != 'rows'"), kinds, total)


def live_counts(rows: DataFrame, profile: BaselineProfile, numeric: Sequence[str], categorical: Sequence[str]
                ) -> DataFrame:
    """Counts per feature and bin of the rows so far; on a stream its state, one number per bin."""
    return _bin_counts(rows, profile.edges, numeric, categorical)


def report_from_counts(counts: DataFrame, profile: BaselineProfile, bins: int = 10) -> DataFrame:
    """The drift report from counts per bin of both sides; no row of either is read.

    Too few live rows for a report are reported as such by their number, ``n_live``.
    """
    spark = counts.sparkSession
    live = counts.filter("kind != 'rows'").withColumnRenamed("n", "n_live")
    both = profile.counts.withColumnRenamed("n", "n_base").join(live, ["feature", "kind", "bin"], "full").fillna(
        0, subset=["n_base", "n_live"])
    by = ["feature"]
    numbers = both.filter("kind = 'numeric'").select("feature", F.col("bin").cast("bigint").alias("bin"), "n_base", "n_live")
    texts = both.filter("kind = 'categorical'").select("feature", "n_base", "n_live")
    totals = texts.groupBy(*by).agg(F.sum("n_base").alias("_b"), F.sum("n_live").alias("_l"))
    share = lambda n, total: F.try_divide(F.col(n), F.col(total)) + F.lit(C.PSI_SHARE_EPS)
    psi = _psi_from_bins(numbers, by, bins, None).unionByName(_psi_sum(texts.join(totals, by), by, share))
    names = spark.createDataFrame(list(profile.kinds.items()), "feature string, kind string")
    size = counts.filter("kind = 'rows'").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    rows = names.join(psi, "feature", "left").fillna({"psi": 0.0})
    return rows.select(
        "feature", "kind", F.round("psi", 6).alias("psi"), psi_zone(F.col("psi")).alias("zone"),
        size.select("n").scalar().alias("n_live"), F.lit(profile.n_base).cast("bigint").alias("n_baseline"),
        F.current_timestamp().alias("computed_at_utc"))


def later_batches(df: DataFrame, batch: str, baseline: str) -> list[str]:
    """Labels of all batches but the baseline; there are few."""
    return sorted(r[0] for r in df.select(batch).distinct().collect() if r[0] not in (None, baseline))


def _against(counts: DataFrame, key: str, batch: str, baseline: str, later: Sequence[str]) -> DataFrame:
    """Counts of each later batch beside the baseline's, from one aggregate; no baseline row is repeated."""
    of = lambda b: F.coalesce(F.sum(F.when(F.col(batch) == b, F.col("n"))), F.lit(0))
    labels = list(later) or [baseline]
    wide = counts.groupBy("feature", key).agg(
        of(baseline).alias("n_base"), *[of(b).alias(f"n{i}") for i, b in enumerate(labels)])
    each = F.array(*[F.struct(F.lit(b).alias(batch), F.col(f"n{i}").alias("n_live"))
                     for i, b in enumerate(labels)])
    long = wide.select("feature", key, "n_base", F.inline(each))
    return long.filter(((F.col("n_base") > 0) | (F.col("n_live") > 0)) & (F.col(batch) != baseline))


def batch_psi_numeric(df: DataFrame, numeric: Sequence[str], batch: str, baseline: str, later: Sequence[str],
                      bins: int = 10) -> DataFrame:
    """`psi_numeric` of every later batch; rows are counted and the edges found once for all batches."""
    counts = written_table(long_numeric(df, numeric, (batch,)).groupBy("feature", batch, "value").agg(
        F.count(F.lit(1)).alias("n")), "value-counts")
    edges = exact_quantiles(
        counts.filter(F.col(batch) == baseline), "value", [i / bins for i in range(1, bins)], ["feature"], "n"
    ).groupBy("feature").agg(F.collect_list("value").alias("edges"))
    place = F.coalesce(F.size(F.filter("edges", lambda e: e <= F.col("value"))), F.lit(0)).cast("bigint")
    binned = counts.join(edges, "feature", "left").withColumn("bin", place).groupBy("feature", batch, "bin").agg(
        F.sum("n").alias("n"))
    return _psi_from_bins(_against(binned, "bin", batch, baseline, later), ["feature", batch], bins, None)


def batch_psi_categorical(df: DataFrame, categorical: Sequence[str], batch: str, baseline: str,
                          later: Sequence[str]) -> DataFrame:
    """`psi_categorical` of every later batch, from one count of the rows."""
    counts = long_categorical(df, categorical, (batch,)).groupBy("feature", batch, "value").agg(
        F.count(F.lit(1)).alias("n"))
    return _psi_of_values(_against(counts, "value", batch, baseline, later), ["feature", batch])


def batch_drift(df: DataFrame, numeric: Sequence[str], categorical: Sequence[str],
                batch: str = "batch", baseline: str = "baseline") -> DataFrame:
    """PSI and status per feature and batch."""
    later = later_batches(df, batch, baseline)
    num = batch_psi_numeric(df, numeric, batch, baseline, later)
    cat = batch_psi_categorical(df, categorical, batch, baseline, later)
    rows = num.withColumn("kind", F.lit("numeric")).unionByName(
        cat.withColumn("kind", F.lit("categorical")))
    return rows.withColumn("status", psi_status(F.col("psi")))


def drift_matrix(rows: DataFrame, batches: Sequence[str]) -> DataFrame:
    return rows.groupBy("feature").pivot("batch", list(batches)).agg(F.max("psi"))


def ks_two_sample(long: DataFrame, by: Sequence[str] = ("feature",), terms: int = 100) -> DataFrame:
    """Largest distance of the two distribution functions, and its asymptotic p-value.

    A feature with rows on one side only keeps its row, with null results. Distinct values are counted first, then summed along their order slice by slice.
    """
    by = list(by)
    counts = _counts(long, by, "value")
    placed = with_value_levels(counts, "value", by, _b=F.sum("n_base"), _l=F.sum("n_live"))
    cum = running_sums(placed, [F.asc("value")],
                       {"cum_b": F.col("n_base"), "cum_l": F.col("n_live")}, [F.col("_slice")], by)
    gap = F.abs(F.try_divide("cum_b", "_b") - F.try_divide("cum_l", "_l"))
    out = cum.groupBy(*by).agg(
        F.max(gap).alias("ks"), F.max("_b").alias("n_base"), F.max("_l").alias("n_live"))
    size = F.try_divide(F.col("n_base") * F.col("n_live"), F.col("n_base") + F.col("n_live"))
    lam2 = F.col("ks") * F.col("ks") * size
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, j: acc + F.when(j % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * j * j * lam2))
    p = F.when(F.col("ks").isNull(), F.lit(None)).when(lam2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))
    return out.withColumn("p_value", p).withColumn("status", p_value_status(F.col("p_value")))


def tier_mix(df: DataFrame, batch: str = "batch", baseline: str = "baseline",
             tiers: Sequence[str] = ("low", "medium", "high")) -> DataFrame:
    """Share of each tier per batch and its shift against the baseline (one row per batch)."""
    sizes = df.groupBy(batch).agg(F.count(F.lit(1)).alias("n"), *[
        F.avg((F.col("risk_tier") == t).cast("double")).alias(f"share_{t}") for t in tiers])
    base = sizes.filter(F.col(batch) == baseline)
    return sizes.withColumns({
        f"shift_{t}": F.col(f"share_{t}") - base.select(f"share_{t}").scalar() for t in tiers})


def batch_kpis(df: DataFrame, t: float, batch: str = "batch") -> DataFrame:
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n"), F.avg(Y).alias("cancel_rate"),
        F.avg((F.col(P) >= t).cast("double")).alias("flagged_rate"),
        F.avg(P).alias("mean_probability"), F.avg("adr").alias("mean_adr"),
        F.avg("revenue_at_risk").alias("mean_revenue"),
        F.avg((F.col("risk_tier") == "high").cast("double")).alias("high_share"))


def rag_dashboard(df: DataFrame, t: float, batch: str = "batch", baseline: str = "baseline"
                  ) -> DataFrame:
    """Five signals per batch with value, status and action."""
    psi = batch_psi_numeric(df, [P, "adr"], batch, baseline, later_batches(df, batch, baseline))
    # Signal names, limits and actions of the dashboard.
    signal = F.when(F.col("feature") == P, "Score PSI").otherwise("ADR feature PSI")
    psi_rows = psi.select(
        F.col(batch).alias("batch"), signal.alias("metric"), F.col("psi").alias("value"),
        psi_status(F.col("psi")).alias("status"),
        F.when(psi_status(F.col("psi")) != "ALERT", "Monitor")
        .when(F.col("feature") == P, "Review seasonal model recalibration")
        .otherwise("Seasonal ADR expected; review cost threshold").alias("action"))
    later = F.col(batch) != baseline
    ece_rows = ece(df.filter(later), [batch], closed_last=False).select(
        F.col(batch).alias("batch"), F.lit("Calibration ECE").alias("metric"),
        F.col("ece").alias("value"),
        F.when(F.col("ece") > 0.05, "ALERT").otherwise("OK").alias("status"),
        F.when(F.col("ece") > 0.05, "Refit isotonic calibrator on recent data")
        .otherwise("No action").alias("action"))
    kpis = batch_kpis(df, t, batch)
    base = kpis.filter(~later)
    deltas = kpis.filter(later).withColumns({
        f"_{c}": base.select(c).scalar() for c in ("cancel_rate", "high_share")
    }).select(F.col(batch).alias("batch"), F.inline(F.array(*[
        F.struct(F.lit(name).alias("metric"),
                 F.abs(F.col(c) - F.col(f"_{c}")).alias("value"), F.lit(act).alias("act"))
        for name, c, act in [
            ("Cancel rate delta", "cancel_rate", "Review threshold policy for new base rate"),
            ("High-risk tier delta", "high_share", "Flag to operations team")]])))
    warn = F.col("value") > 0.05
    delta_rows = deltas.select(
        "batch", "metric", "value", F.when(warn, "WARN").otherwise("OK").alias("status"),
        F.when(warn, F.col("act")).otherwise("No action").alias("action"))
    return psi_rows.unionByName(ece_rows).unionByName(delta_rows)


def status_counts(dashboard: DataFrame) -> DataFrame:
    return dashboard.agg(*[
        F.count_if(F.col("status") == s).alias(f"n_{s.lower()}") for s in ("ALERT", "WARN", "OK")])


def retrain_rule(report: DataFrame, max_monitor: int = 5) -> DataFrame:
    """Retrain when any feature asks for it or many are on watch."""
    return report.agg(
        F.count_if(F.col("zone") == "stable").alias("n_stable"),
        F.count_if(F.col("zone") == "monitor").alias("n_monitor"),
        F.count_if(F.col("zone") == "retrain").alias("n_retrain"),
    ).withColumn("retrain", (F.col("n_retrain") > 0) | (F.col("n_monitor") >= max_monitor))
