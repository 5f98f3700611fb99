"""Fits on shared matrices, staged scores, refits, selection, contributions and permutation."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from resrisk import config
from resrisk.ml import explain, fits, models
from resrisk.operators import splits
from resrisk.operators.metrics import auc_metrics


@pytest.fixture(scope="module")
def matrix(spark):
    rng = random.Random(5)
    data = []
    for i in range(1200):
        a, b, c = rng.random(), rng.random(), rng.choice(["x", "y", "z z"])
        data.append((i, int(rng.random() < (0.8 * a + 0.2 * (c == "x"))), a, b, c))
    df = spark.createDataFrame(data, "id int, is_canceled int, a double, a_b double, c string")
    return fits.feature_matrix(df.filter("id < 900"), df.filter("id >= 900"), ["c"], ["a", "a_b"], ["id"])


def test_matrix_is_fitted_on_the_training_rows(matrix):
    assert (matrix.n_train, matrix.n_test) == (900, 300)
    weights = matrix.train.groupBy("is_canceled").agg(F.sum("weight").alias("w")).collect()
    assert abs(weights[0]["w"] - weights[1]["w"]) < 1e-6
    assert explain.encoded_names(matrix.train) == ["a_num", "a_b_num", "c_hot_x", "c_hot_y", "c_hot_z z"] or set(
        explain.encoded_names(matrix.train)) == {"a_num", "a_b_num", "c_hot_x", "c_hot_y", "c_hot_z z"}


def test_staged_scores_are_those_of_smaller_fits(matrix):
    whole = fits.fit_on(matrix, "gradient_boosting", rounds=6, depth=3)
    staged = fits.staged_scores(whole, matrix.test, [2, 6, 9]).collect()
    for rounds in (2, 6):
        own = fits.fit_on(matrix, "gradient_boosting", rounds=rounds, depth=3)
        want = {r["id"]: r["cancel_probability"] for r in fits.scored(own, matrix.test).collect()}
        got = {r["id"]: r["cancel_probability"] for r in staged if r["rounds"] == rounds}
        assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-12
    last = {r["id"]: r["cancel_probability"] for r in staged if r["rounds"] == 9}
    assert last == {r["id"]: r["cancel_probability"] for r in staged if r["rounds"] == 6}
    curve = fits.round_curve(matrix, 3, [1, 4], ("train", "test"))
    assert [(r[0], r[1]) for r in curve if r[2] == "test"] in ([(3, 1), (3, 4)], [(3, 4), (3, 1)]) and len(curve) == 4


@pytest.mark.parametrize("family", ["gradient_boosting", "logistic"])
def test_contributions_add_up_to_the_margin(matrix, family):
    size = {"rounds": 4, "depth": 3} if family != "logistic" else {}
    model = fits.fit_on(matrix, family, **size)
    explainer = explain.Explainer(model, matrix.train)
    names = explain.encoded_names(matrix.test)
    terms = explain.attribution_rows(explainer, matrix.test, ["id"])
    sums = {r["id"]: r["s"] for r in terms.groupBy("id").agg(F.sum("contribution").alias("s")).collect()}
    margins = {r["id"]: r["rawPrediction"][1] for r in model.transform(matrix.test).collect()}
    assert max(abs(explainer.base + sums.get(k, 0.0) - m) for k, m in margins.items()) < 1e-9
    by_feature = models.attribution_by_feature(terms, ["a", "a_b", "c"], ["id"])
    assert {r["feature"] for r in by_feature.collect()} <= {"a", "a_b", "c"}
    top = explain.with_top_features(explainer, matrix.test.withColumn("a", F.lit(0.25)), ["a", "a_b", "c"], 2)
    wide = {(r["id"], r["feature"]): r["contribution"] for r in by_feature.collect()}
    for r in top.collect():
        assert len(r["top_features"]) == 2
        for t in r["top_features"]:
            assert abs(t["contribution"] - wide.get((r["id"], t["feature"]), 0.0)) < 1e-4
            assert t["value"] == ("0.25" if t["feature"] == "a" else None)
    assert [explain.raw_name(n, ["a", "a_b", "c"]) for n in ("a_b_num", "a_num", "c_hot_x", "q")] == ["a_b", "a", "c", "_other"]
    assert len(names) == 5


def test_permutation_keeps_values_and_finds_what_matters(matrix):
    explainer = explain.Explainer(fits.fit_on(matrix, "logistic"))
    groups = explain.feature_groups(explain.encoded_names(matrix.test), ["a", "a_b", "c"])
    assert groups["a"] == [0] and len(groups["c"]) == 3
    scores = explain.permuted_scores(explainer, matrix.test, ["id"], groups, repeats=3, block_rows=100)
    again = explain.permuted_scores(explainer, matrix.test.repartition(5), ["id"], groups, repeats=3, block_rows=100)
    order = ["feature", "repeat", "score", "is_canceled"]
    assert [tuple(r) for r in scores.orderBy(*order).collect()] == [tuple(r) for r in again.orderBy(*order).collect()]
    assert {r["n"] for r in scores.groupBy("feature", "repeat").agg(F.count(F.lit(1)).alias("n")).collect()} == {300}
    none = sorted(r["score"] for r in scores.filter("feature = 'none' and repeat = 0").collect())
    plain = sorted(r["cancel_probability"] for r in fits.scored(fits.fit_on(matrix, "logistic"), matrix.test).collect())
    assert np.allclose(none, plain)
    got = {r["feature"]: r for r in explain.permutation_importance(explainer, matrix.test, ["id"], groups, repeats=5).collect()}
    assert got["a"]["mean_importance"] > 0.1 > abs(got["a_b"]["mean_importance"])
    assert all(r["ci_low"] <= r["mean_importance"] <= r["ci_high"] and r["repeats"] == 5 for r in got.values())


def test_tiny_data_take_the_fallback_family(spark):
    df = spark.createDataFrame([(i, i % 2, float(i)) for i in range(50)], "id int, is_canceled int, a double")
    row = fits.select_champion(df, splits.rolling_folds(50), None, ["logistic"], [], ["a"]).first()
    assert (row["family"], row["folds"], row["rank"]) == (config.FALLBACK_FAMILY, 0, 1) and "too few" in row["fallback_reason"]


def test_champion_has_a_gap_to_the_next(spark):
    rng = random.Random(2)
    df = spark.createDataFrame(
        [(i, int(rng.random() < i % 10 / 10), float(i % 10)) for i in range(400)], "id int, is_canceled int, a double")
    folds = [splits.Fold("a", 200, 200, 300), splits.Fold("b", 300, 300, 400)]
    parts = lambda f: (df.filter(F.col("id") < f.train_end), df.filter(F.col("id").between(f.test_start, f.test_end - 1)))
    rows = fits.select_champion(df, folds, parts, ["decision_tree", "logistic"], [], ["a"]).orderBy("rank").collect()
    assert [r["folds"] for r in rows] == [2, 2] and sum(r["wins"] for r in rows) == 2
    assert rows[0]["gap_to_best"] == 0 and rows[0]["gap_to_next"] == pytest.approx(rows[1]["gap_to_best"])
    assert rows[1]["gap_to_next"] is None and rows[0]["fallback_reason"] is None


def test_challengers_have_the_same_capacity():
    two = [models.estimator(f) for f in models.BOOSTED[1:]]
    for name in ("getMaxIter", "getMaxDepth", "getStepSize"):
        assert len({getattr(e, name)() for e in two}) == 1
    assert (two[0].getMaxIter(), two[0].getMaxDepth()) == (300, 7) and models.estimator("gradient_boosting").getMaxIter() == 100


def test_refits_go_on_where_they_ended(spark, tmp_path):
    calls = []

    def cell(name, fails=False):
        def run():
            calls.append(name)
            if fails:
                raise RuntimeError("killed")
            return {"n_train": 3, "n_test": 1, "roc_auc": 0.5, "pr_auc": len(name) / 10, "f1": None}
        return run

    folder = str(tmp_path / "cells")
    with pytest.raises(RuntimeError):
        fits.refit_cells(spark, {"full": cell("full"), "less": cell("less", True)}, folder, 1)
    rows = fits.refit_cells(spark, {"full": cell("full"), "less": cell("less"), "some1": cell("some1")}, folder)
    assert sorted(calls) == ["full", "less", "less", "some1"]
    wide = {r["cell"]: r for r in fits.deltas_to(rows, "full").collect()}
    assert wide["some1"]["pr_auc_delta"] == pytest.approx(0.1) and wide["less"]["f1"] is None and len(wide) == 3


def test_fits_run_together_give_the_same(matrix):
    tasks = [lambda s=s: auc_metrics(fits.scored(fits.fit_on(matrix, "random_forest", rounds=3, depth=3, seed=s), matrix.test)).first()
             for s in (1, 2, 3)]
    assert fits.together(tasks) == fits.together(tasks, 1)
