"""Cost of errors, policy comparison and revenue exposure."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.clean import column_or_default, safe_numeric
from .metrics import P, Y
from .thresholds import cost_sweep, select_min_cost


def fn_cost(df: DataFrame, recovery_nights: float = C.RECOVERY_NIGHTS) -> Column:
    """Rate times the nights lost after re-selling; unreadable values count as 0."""
    num = lambda n: F.coalesce(safe_numeric(column_or_default(df, n)), F.lit(0.0))
    if "total_stay" in df.columns:
        stay = num("total_stay")
    else:
        stay = num("stays_in_weekend_nights") + num("stays_in_week_nights")
    return num("adr") * F.greatest(stay - recovery_nights, F.lit(0.0))


def cost_columns(fp_cost: float = C.FP_COST) -> dict[str, Column]:
    fp = F.col("fp_count") * F.lit(float(fp_cost))
    return {"fp_cost_total": fp, "total_cost": fp + F.col("fn_cost_total")}


def cost_at_thresholds(df: DataFrame, thresholds: dict[str, float], fp_cost: float = C.FP_COST,
                       cost: str = "fn_cost") -> DataFrame:
    """Error counts and costs of several fixed thresholds in one pass over the rows."""
    p, y = F.col(P), F.col(Y)
    named = {n: (F.count_if((p >= t) & (y == 0)), F.count_if((p < t) & (y == 1)),
                 F.coalesce(F.sum(F.when((p < t) & (y == 1), F.col(cost))), F.lit(0.0)))
             for n, t in thresholds.items()}
    facts = df.agg(*[
        F.struct(F.lit(n).alias("policy"), F.lit(float(thresholds[n])).alias("threshold"),
                 fp.alias("fp_count"), fn.alias("fn_count"), total.alias("fn_cost_total")).alias(n)
        for n, (fp, fn, total) in named.items()
    ])
    return facts.select(F.inline(F.array(*thresholds))).withColumns(cost_columns(fp_cost))


def no_model_cost(cost: str = "fn_cost") -> Column:
    return F.coalesce(F.sum(F.when(F.col(Y) == 1, F.col(cost))), F.lit(0.0))


def cost_policy_summary(df: DataFrame, fp_cost: float = C.FP_COST, steps: int = 100,
                        cost: str = "fn_cost") -> DataFrame:
    """Cheapest threshold with baselines at 0.5, at 0 and without any model."""
    sweep = cost_sweep(df, cost, fp_cost, steps)
    at = lambda t: F.max(F.when(F.col("threshold") == t, F.col("total_cost")))
    base = sweep.agg(at(0.5).alias("baseline_050_cost"), at(0.0).alias("intervene_all_cost"))
    out = select_min_cost(sweep).withColumns({
        c: base.select(c).scalar() for c in ("baseline_050_cost", "intervene_all_cost")})
    total = F.col("total_cost")
    return out.withColumns({
        "fp_cost_assumption": F.lit(float(fp_cost)),
        "savings_vs_050": F.col("baseline_050_cost") - total,
        "savings_vs_no_model": F.col("no_model_cost") - total,
        "savings_vs_intervene_all": F.col("intervene_all_cost") - total,
    })


def heldout_cost_report(df: DataFrame, selected: float, fp_cost: float = C.FP_COST) -> DataFrame:
    """Costs of an already chosen threshold and the trivial policies on the same rows."""
    p, y = F.col(P), F.col(Y)
    total = lambda t: (
        F.count_if((p >= t) & (y == 0)) * F.lit(float(fp_cost))
        + F.coalesce(F.sum(F.when((p < t) & (y == 1), F.col("fn_cost"))), F.lit(0.0)))
    out = df.agg(
        F.count_if((p >= selected) & (y == 0)).alias("fp_count"),
        F.count_if((p < selected) & (y == 1)).alias("fn_count"),
        total(selected).alias("total_cost"), total(0.5).alias("baseline_050_cost"),
        total(0.0).alias("intervene_all_cost"), no_model_cost().alias("no_model_cost"))
    cost = F.col("total_cost")
    return out.withColumns({
        "threshold": F.lit(float(selected)),
        "savings_vs_050": F.col("baseline_050_cost") - cost,
        "savings_vs_intervene_all": F.col("intervene_all_cost") - cost,
        "savings_vs_no_model": F.col("no_model_cost") - cost,
    })


def cost_ladder(report: DataFrame) -> DataFrame:
    """The four policies from dearest to cheapest, with the saving against no model."""
    pairs = [("no_model", "no_model_cost"), ("intervene_all", "intervene_all_cost"),
             ("threshold_050", "baseline_050_cost"), ("cost_policy", "total_cost")]
    rows = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(c).alias("cost"),
                              F.col("no_model_cost").alias("base")) for n, c in pairs])
    return report.select(F.inline(rows)).select(
        "policy", "cost",
        (100 * (1 - F.try_divide("cost", "base"))).alias("saving_pct")).orderBy(F.desc("cost"))


def fp_cost_sensitivity(df: DataFrame, fp_costs: Sequence[float], steps: int = 100,
                        cost: str = "revenue_at_risk") -> DataFrame:
    """Cheapest threshold for each assumed intervention cost, from one sweep."""
    sweep = cost_sweep(df, cost, 1.0, steps)
    grid = sweep.select("threshold", "fp_count", "fn_count", "fn_cost_total",
                        F.explode(F.array(*[F.lit(float(c)) for c in fp_costs])).alias("fp_cost"))
    priced = grid.withColumn("fp_cost_total", F.col("fp_count") * F.col("fp_cost")).withColumn(
        "total_cost", F.col("fp_cost_total") + F.col("fn_cost_total"))
    w = Window.partitionBy("fp_cost").orderBy("total_cost", "threshold")
    return priced.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def tier_business_summary(df: DataFrame) -> DataFrame:
    """Per tier and in total: size, scores, outcome and revenue."""
    out = df.rollup("risk_tier").agg(
        F.count(F.lit(1)).alias("n"), F.avg(P).alias("mean_probability"),
        F.avg(Y).alias("cancel_rate"), F.avg("adr").alias("mean_adr"),
        F.avg("revenue_at_risk").alias("mean_revenue"),
        F.sum("revenue_at_risk").alias("total_revenue"))
    part = F.when(F.col("risk_tier").isNull(), F.lit(1)).otherwise(0)
    whole = Window.partitionBy(part)
    return out.withColumn("share_pct", 100 * F.col("n") / F.sum("n").over(whole)).fillna(
        {"risk_tier": "all"})


def kpi_overview(df: DataFrame) -> DataFrame:
    flagged = F.col("risk_tier") == "high"
    return df.agg(
        F.min("arrival_date").alias("first_arrival"), F.max("arrival_date").alias("last_arrival"),
        F.count(F.lit(1)).alias("bookings"), F.sum(Y).alias("cancellations"),
        F.avg(Y).alias("cancel_rate"), F.avg(P).alias("mean_probability"),
        F.sum("revenue_at_risk").alias("total_revenue"),
        F.sum(F.when(F.col(Y) == 1, F.col("revenue_at_risk"))).alias("lost_revenue"),
        F.avg("adr").alias("mean_adr"), F.count_if(flagged).alias("high_risk_bookings"),
        F.avg(flagged.cast("double")).alias("high_risk_share"),
        F.sum(F.when(flagged, F.col("revenue_at_risk"))).alias("high_risk_revenue"))


def revenue_exposure(df: DataFrame, dim: str, value: Column, t: float) -> DataFrame:
    flagged = F.when(F.col(P) >= t, value)
    out = df.groupBy(dim).agg(F.sum(value).alias("total_value"),
                              F.coalesce(F.sum(flagged), F.lit(0.0)).alias("flagged_value"))
    return out.withColumn("at_risk_pct", 100 * F.try_divide("flagged_value", "total_value"))
