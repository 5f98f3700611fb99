"""Cases that the whole-table queries no longer build by leaving rows out."""

import math

import pytest
from pyspark.sql import functions as F
from resrisk import session
from resrisk.operators import drift, metrics, ordering, sets, stats, timeseries
from resrisk.sources import prediction_log


def test_one_sided_features_keep_their_row(spark):
    rows = [("both", float(i % 7), i % 2) for i in range(60)]
    rows += [("only_base", float(i), 0) for i in range(30)] + [("only_live", float(i), 1) for i in range(30)]
    long = spark.createDataFrame(rows, "feature string, value double, is_live int")
    psi = {r["feature"]: r["psi"] for r in drift.psi_numeric(long).collect()}
    assert psi["only_base"] == psi["only_live"] == 0.0 and psi["both"] > 0
    text = long.withColumn("value", F.col("value").cast("string"))
    psi = {r["feature"]: r["psi"] for r in drift.psi_categorical(text).collect()}
    assert psi["only_base"] == psi["only_live"] == 0.0
    ks = {r["feature"]: (r["ks"], r["p_value"]) for r in drift.ks_two_sample(long).collect()}
    assert ks["only_base"] == ks["only_live"] == (None, None) and ks["both"][0] is not None


def test_dead_feature_stays_in_the_report(spark):
    base = spark.createDataFrame([(float(i), "a") for i in range(40)], "x double, c string")
    live = base.select(F.lit(None).cast("double").alias("x"), "c")
    report = {r["feature"]: r["psi"] for r in drift.drift_report(base, live, ["x"], ["c"]).collect()}
    assert report == {"x": 0.0, "c": 0.0}


@pytest.mark.parametrize("x, dof, tail", [
    (3.841459, 1, 0.05), (9.487729, 4, 0.05), (1500, 1500, 0.4951), (2000, 2000, 0.4958), (5000, 5000, 0.4973), (0, 3, 1.0)])
def test_chi_squared_tail(x, dof, tail):
    assert stats.chi2_tail(x, dof) == pytest.approx(tail, abs=2e-4)
    assert stats.chi2_tail(5200, 5000) == pytest.approx(0.0237, abs=2e-3)


def test_an_outlier_does_not_crowd_a_slice(spark):
    df = spark.range(20_000).select((F.col("id") / 20_000).alias("v")).unionByName(
        spark.createDataFrame([(1e9,)], "v double"))
    counts = df.groupBy("v").agg(F.count("*").alias("n"))
    sizes = ordering.with_value_levels(counts, "v", []).groupBy("_slice").count().agg(F.max("count")).first()[0]
    assert sizes < 200
    got = {r["prob"]: r["value"] for r in ordering.exact_quantiles(df, "v", [0.0, 0.5, 1.0]).collect()}
    assert got == {0.0: 0.0, 0.5: 0.5, 1.0: 1e9}


def test_ranks_with_nulls_and_ties(spark):
    df = spark.createDataFrame([(1.0,), (1.0,), (3.0,), (None,), (None,)], "v double")
    got = sorted(r["rank_unit"] for r in stats.rank_normalise(df, "v").collect())
    assert got == pytest.approx(sorted([0.25, 0.25, 1.0, 0.5, 0.5]))
    plan = stats.rank_normalise(df, "v")._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_average_ranks_of_shared_keys(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 2.0)], "k string, v double")
    b = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 3.0)], "k string, v double")
    got = {r["k"]: (r["rank_a"], r["rank_b"]) for r in sets.rank_alignment(a, b, "k", "v").collect()}
    assert got == {"x": (1.0, 3.0), "y": (2.5, 2.0), "z": (2.5, 1.0)}


def test_single_class_group_has_no_auc(spark, pairs):
    df = pairs([1, 1, 0, 1], [0.2, 0.9, 0.4, 0.6]).withColumn("g", F.when(F.col("cancel_probability") == 0.9, "one").otherwise("two"))
    got = {r["g"]: r["roc_auc"] for r in metrics.threshold_metrics(df, 0.5, ["g"]).collect()}
    assert got["one"] is None and got["two"] is not None


def test_months_without_rows_are_filled(spark):
    df = spark.sql("SELECT DATE '2020-01-05' AS arrival_date, 1 AS is_canceled UNION ALL SELECT DATE '2020-04-02', 0")
    rows = timeseries.monthly_trend(df).orderBy("month").collect()
    assert [r["n"] for r in rows] == [1, 0, 0, 1]


def test_log_reads(spark, tmp_path):
    assert prediction_log.count_log(spark, str(tmp_path / "none")) == 0
    (tmp_path / "broken").mkdir()
    with pytest.raises(Exception):
        prediction_log.count_log(spark, str(tmp_path / "broken"))


def test_a_session_without_a_shared_folder_raises():
    class Conf:
        def get(self, key, default=None):
            return default

    class Spark:
        conf = Conf()
        sparkContext = type("Context", (), {"applicationId": "none"})

    with pytest.raises(ValueError, match="shared scratch folder"):
        session.shared_folder(Spark())


def test_written_tables_are_dropped(spark):
    table = session.written_table(spark.range(10), "drop-me")
    path = table.inputFiles()[0]
    session.drop_written(spark, prefix="drop-me")
    assert not prediction_log.log_exists(spark, path) and math.isfinite(1.0)


def test_lazy_results_keep_their_tables(spark):
    read = session.owning(lambda n: session.written_table(spark.range(n), "llm-own"))
    first, second = read(3), read(4)
    session.drop_written(spark, prefix="llm-")
    assert (first.count(), second.count()) == (3, 4)
    path = first.inputFiles()[0]
    session.release(first)
    assert not prediction_log.log_exists(spark, path) and second.count() == 4
    session.release(second)
    with session.scratch():
        inner = read(5)
        path = inner.inputFiles()[0]
    assert not prediction_log.log_exists(spark, path)


def test_batches_against_one_baseline_equal_a_comparison_each(spark):
    rows = [(["baseline", "b1", "b2"][i % 3], float(i * 37 % 101), None if i % 5 == 0 else float(i % 11), "xyz"[i % (2 + i % 2)])
            for i in range(600)] + [("b2", None, None, "new")]
    df = spark.createDataFrame(rows, "batch string, u double, v double, c string")
    got = {(r["batch"], r["feature"]): r["psi"] for r in drift.batch_drift(df, ["u", "v"], ["c"]).collect()}
    for b in ("b1", "b2"):
        both = drift.mark_live(df.filter("batch = 'baseline'"), df.filter(F.col("batch") == b))
        each = drift.psi_numeric(drift.long_numeric(both, ["u", "v"])).unionByName(
            drift.psi_categorical(drift.long_categorical(both, ["c"])))
        for r in each.collect():
            assert got[(b, r["feature"])] == pytest.approx(r["psi"], abs=1e-12)
    assert len(got) == 6 and got[("b2", "c")] > 0
    assert drift.batch_drift(df.filter("batch = 'baseline'"), ["u"], ["c"]).count() == 0


def test_rank_of_a_value_that_most_rows_share(spark):
    values = [2.0] * 900 + [1.0, 3.0, 3.0] + [None] * 5
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, v double").repartition(5)
    got = {r["v"]: r["rank_unit"] for r in stats.rank_normalise(df, "v").collect()}
    want = {1.0: 0.0, 2.0: (451.5 - 1) / (902.5 - 1), 3.0: 1.0, None: 0.5}
    assert got == pytest.approx(want) and stats.rank_normalise(df, "v").count() == len(values)
