"""Trees grown on compact rows: the fits of Spark ML's estimators, in few bytes a row."""

import numpy as np
import pandas as pd
import pytest
from pyspark.ml import Pipeline
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from resrisk.ml import explain, fits, models, trees
from resrisk.session import shared_folder

N = 3000


@pytest.fixture(scope="module")
def rows(spark):
    spark.sparkContext.setCheckpointDir(shared_folder(spark))
    rng = np.random.default_rng(3)
    a, b, c = rng.random(N), rng.random(N), rng.choice(list("xyzuv"), N)
    y = (rng.random(N) < 0.6 * a + 0.3 * (c == "x") + 0.1 * np.sin(9 * b)).astype(int)
    df = spark.createDataFrame(pd.DataFrame({
        "id": range(N), "a": a, "b": b, "k": rng.integers(0, 9, N).astype(float), "c": c, "is_canceled": y, "adr": 5 * a + b + (c == "y")}))
    ready = Pipeline(stages=models.preprocessor(["c"], ["a", "b", "k"])).fit(df)
    return ready.transform(df).withColumn("weight", F.when(F.col("is_canceled") == 1, 1.7).otherwise(1.0)).withColumn(
        "validation", F.col("id") % 5 == 0).coalesce(1).cache()


def _scores(model, rows, name="probability"):
    out = model.transform(rows).withColumn("_p", vector_to_array(name)[1] if name == "probability" else F.col(name))
    return np.array([r["_p"] for r in out.orderBy("id").select("_p").collect()])


@pytest.mark.parametrize("early, alone", [(False, N), (True, 0)])
def test_boosting_gives_what_spark_gives(rows, alone, early):
    est = models.estimator("gradient_boosting", rounds=6, depth=3, early_stop=early)
    want, got = est.fit(rows), trees.fit_trees(est, rows, 500, alone)
    assert type(got) is type(want) and got.getNumTrees == want.getNumTrees and got.treeWeights == want.treeWeights
    assert abs(_scores(got, rows) - _scores(want, rows)).max() < 1e-9
    assert abs(got.featureImportances.toArray() - want.featureImportances.toArray()).max() < 1e-9
    assert abs(fits.Trees(got).base - fits.Trees(want).base) < 1e-9


def test_a_tree_alone_gives_what_spark_gives(rows):
    est = models.estimator("decision_tree")
    want, got = est.fit(rows), trees.fit_trees(est, rows, 500)
    assert got.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1]
    assert abs(_scores(got, rows) - _scores(want, rows)).max() < 1e-12
    for family in ("decision_tree", "gradient_boosting"):
        est = models.regressor(family)
        est = est if family == "decision_tree" else est.setMaxIter(3)
        assert abs(_scores(trees.fit_trees(est, rows, 500), rows, "prediction") - _scores(est.fit(rows), rows, "prediction")).max() < 1e-9


@pytest.mark.parametrize("family", ["boosting_subsampled", "boosting_small_steps", "random_forest"])
def test_drawn_families_do_as_well_as_sparks(rows, family):
    est = models.estimator(family, rounds=5, depth=3)
    y = np.array([r[0] for r in rows.orderBy("id").select("is_canceled").collect()])
    loss = lambda p: -np.mean(np.where(y == 1, np.log(p), np.log(1 - p)))
    again = [_scores(trees.fit_trees(est, rows, 500, alone), rows) for alone in (N, 0)]
    assert abs(again[0] - again[1]).max() < 1e-12
    assert abs(loss(again[0]) - loss(_scores(est.fit(rows), rows))) < 0.03
    assert explain.encoded_names(rows)[:3] == ["a_num", "b_num", "k_num"]


def test_a_fit_of_more_rows_than_a_task_takes_keeps_few_bytes_a_row(spark, rows, monkeypatch):
    layout = trees.make_layout(rows.withColumn("_w", F.lit(1.0)), "features", 32, N, float(N), 1)
    assert len(layout.packs) < len(layout.columns) and max(layout.sizes) <= trees.CELLS
    marked = rows.select("features", F.col("is_canceled").cast("double").alias("_y"), F.col("weight").alias("_w"), F.lit(False).alias("_late"))
    blocks = trees.packed(marked, "features", layout, True, N, 3)
    held = blocks.map(lambda b: (sum(p.nbytes for p in b.packs) + b.y.nbytes, len(b.y))).collect()
    # Spark ML keeps four bytes for each of the entries.
    assert sum(h[1] for h in held) == N and sum(h[0] for h in held) <= N * (2 * len(layout.packs) + 1)
    # Beyond one task's least rows a fit goes this way, before it all went to Spark ML.
    asked = []
    monkeypatch.setattr(trees, "fit_trees", lambda est, rows, *a, **kw: asked.append(type(est).__name__))
    models.fit_rows(models.estimator("gradient_boosting"), rows, 20_001)
    models.fit_rows(models.estimator("random_forest"), rows, 20_001)
    assert asked == ["GBTClassifier", "RandomForestClassifier"]
    assert models.fit_rows(models.estimator("decision_tree"), rows, N).numFeatures == 8 and len(asked) == 2


def test_bins_are_sought_in_the_rows_that_spark_draws(spark):
    df = spark.range(24_000).select("id", F.rand(4).alias("a"), F.rand(5).alias("b"), (F.rand(6) * 3).cast("int").cast("string").alias("c"))
    df = df.withColumn("is_canceled", (F.col("a") + F.col("b") * F.col("c").cast("int") > 1).cast("int")).withColumn("weight", F.lit(1.0))
    ready = Pipeline(stages=models.preprocessor(["c"], ["a", "b"])).fit(df)
    rows = df.select("a", "b", "c", "is_canceled", "weight")
    est = models.estimator("decision_tree")
    want = est.fit(ready.transform(models.even_parts(rows, 24_000)))
    got = models.fit_rows(est, rows, 24_000, ready.transform)
    assert got.toDebugString.split("\n", 1)[1] == want.toDebugString.split("\n", 1)[1]


def test_fewer_fits_at_once_where_each_holds_much():
    assert fits.at_once(10_000) == fits.at_once(400_000) == fits.FITS_AT_ONCE
    assert fits.at_once(25_000_000) == 1 < fits.at_once(25_000_000 // 4, fits.TREE_BYTES) <= fits.FITS_AT_ONCE


def test_cells_come_in_the_order_of_their_families(rows):
    half = lambda name: rows.filter(F.col("validation") == (name == "test"))
    matrix = fits.Matrix(half("train"), half("test"), None, N - N // 5, N // 5, half("train"))
    cells = fits.fold_cells({"a": matrix, "b": matrix}, ["logistic", "decision_tree"], {})
    assert [c[:2] for c in cells] == [("logistic", "a"), ("logistic", "b"), ("decision_tree", "a"), ("decision_tree", "b")]


def test_entries_of_other_kinds_go_to_spark(spark):
    df = VectorAssembler(inputCols=["a"], outputCol="features").transform(spark.createDataFrame([(1.0, 1)], "a double, is_canceled int"))
    assert trees.fits_here(models.estimator("decision_tree"), df) and not trees.fits_here(models.estimator("logistic"), df)
    assert not trees.fits_here(models.estimator("decision_tree"), df.select(F.col("features").alias("features", metadata={})))


def test_zeros_that_a_sample_is_expected_to_hold_are_counted():
    assert trees.cut_points(np.array([0.0, 0, 1, 2]), np.ones(4), 31, 4.0).tolist() == [0.5, 1.5]
    assert trees.cut_points(np.array([3.0, 3.0]), np.ones(2), 31, 2.0).tolist() == []
    many = trees.cut_points(np.arange(1, 1001.0), np.ones(1000), 31, 1000.0)
    assert len(many) == 31 and abs(np.diff(many) - 1000 / 32).max() < 2
