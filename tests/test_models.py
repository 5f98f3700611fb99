import random

import pytest
from pyspark.sql import functions as F

from resrisk.ml import models
from resrisk.operators.metrics import auc_metrics


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(7)
    data = []
    for i in range(800):
        x = rng.random()
        data.append((i, int(rng.random() < x), x, rng.choice(["a", "b", None])))
    return spark.createDataFrame(data, "id int, is_canceled int, x double, c string")


def test_logistic_ranks_and_calibrates(rows):
    df = models.merge_rare(rows, models.kept_levels(rows, ["c"]))
    scored = models.score(models.fit_family(df, "logistic", ["c"], ["x"]), df, ["x"])
    assert auc_metrics(scored).first()["roc_auc"] > 0.75
    out = models.calibrate(models.fit_isotonic(scored), scored)
    low, high = out.agg(F.min("calibrated"), F.max("calibrated")).first()
    assert 0 <= low <= high <= 1
    with pytest.raises(ValueError):
        models.fit_isotonic(scored.filter("is_canceled = 1"))


def test_scoring_works_after_an_observed_export(spark, rows, tmp_path):
    from pyspark.sql import Observation

    seen = Observation()
    rows.observe(seen, F.count(F.lit(1)).alias("n")).write.csv(str(tmp_path / "out"))
    assert seen.get["n"] == 800
    df = models.merge_rare(rows, models.kept_levels(rows, ["c"]))
    model = models.fit_family(df, "logistic", ["c"], ["x"])
    assert not model.stages[-1].hasSummary
    assert models.score(model, df, ["x"]).filter("cancel_probability is null").isEmpty()


def test_bootstrap_brackets_the_point(rows):
    df = rows.withColumns({"good": F.col("x"), "same": F.col("x")})
    aucs = models.bootstrap_aucs(df, ["good", "same"], 30)
    point = auc_metrics(df, p="good").first()["roc_auc"]
    for r in models.bootstrap_ci(aucs).filter("metric = 'roc_auc'").collect():
        assert r["ci_low"] <= point <= r["ci_high"]
    for r in models.paired_delta(aucs, "good").collect():
        assert r["delta"] == 0 and r["p_value"] == 1.0


def test_bootstrap_has_all_replicates_and_f1(rows):
    import numpy as np

    df = rows.withColumns({"good": F.round("x", 2), "rough": F.round("x", 1)})
    aucs = models.bootstrap_aucs(df, ["good", "rough"], threshold=0.4).collect()
    assert {(r["model"], r["replicate"]) for r in aucs} == {(m, i) for m in ("good", "rough") for i in range(2000)}
    # One replicate by hand: each group of rows as often as drawn.
    groups = df.groupBy("good", "rough", "is_canceled").count().withColumn(
        "key", F.xxhash64("good", "rough", "is_canceled")).collect()
    w = models.poisson_draws(42, 1, 250, [g["key"] for g in groups], [g["count"] for g in groups])[:, 7]
    y = np.array([g["is_canceled"] for g in groups])
    for r in (r for r in aucs if r["replicate"] == 257):
        s = np.array([g[r["model"]] for g in groups])
        wins = ((s[:, None] > s) + (s[:, None] == s) / 2)[y == 1][:, y == 0]
        roc = w[y == 1] @ wins @ w[y == 0] / (w[y == 1].sum() * w[y == 0].sum())
        ap = sum(w[(s == t) & (y == 1)].sum() * w[(s >= t) & (y == 1)].sum() / max(1, w[s >= t].sum()) for t in set(s)) / w[y == 1].sum()
        f1 = 2 * w[(s >= 0.4) & (y == 1)].sum() / (w[s >= 0.4].sum() + w[y == 1].sum())
        assert abs(r["roc_auc"] - roc) < 1e-9 and abs(r["pr_auc"] - ap) < 1e-9 and abs(r["f1"] - f1) < 1e-9
    assert {r["metric"] for r in models.bootstrap_ci(models.bootstrap_aucs(df, ["good"], 20)).collect()} == {"roc_auc", "pr_auc", "f1"}


def test_longest_name_wins(spark):
    df = spark.createDataFrame([("total_guests_2",), ("total_1",), ("zzz",)], "e string")
    got = [r[0] for r in df.select(
        models.raw_feature(F.col("e"), ["total", "total_guests"])).collect()]
    assert got == ["total_guests", "total", "_other"]


def test_registered_fits_have_the_full_size():
    from resrisk import config
    from resrisk.catalog import modelling

    assert modelling.SIZE == {"rounds": config.BOOST_ROUNDS, "depth": config.BOOST_DEPTH} == {"rounds": 100, "depth": 5}
    assert set(modelling.GRID) == {(5, 50), (5, 100), (5, 200), (5, 300), (2, 100), (3, 100), (7, 100)}


def test_long_boosting_cuts_its_lineage(spark, rows):
    model = models.fit_family(rows, "gradient_boosting", [], ["x"], rounds=12, depth=2)
    assert model.stages[-1].getNumTrees == 12
    assert spark.sparkContext.getCheckpointDir() is not None
