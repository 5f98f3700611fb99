"""Cases of the third round's findings."""

import random

from pyspark.sql import functions as F

from resrisk.operators import sets


def test_copies_kept_do_not_depend_on_the_order_of_rows(spark):
    """cuts by day were taken on one reading and looked up on another one with other copies."""
    rng = random.Random(3)
    data = [(rng.choice(["a", None]), rng.randrange(3), rng.randrange(50), i, rng.random()) for i in range(300)]
    schema = "kind string, size int, day int, id int, x double"
    there, back = (spark.createDataFrame(rows, schema).repartition(n) for rows, n in ((data, 3), (data[::-1], 5)))
    kept = [sorted(map(str, sets.first_copies(df, ["kind", "size"], ["day", "id"]).collect())) for df in (there, back)]
    assert kept[0] == kept[1] and len(kept[0]) == 6
    first = {}
    for row in sorted(data, key=lambda r: r[2:4]):
        first.setdefault(row[:2], row)
    got = sets.first_copies(there, ["kind", "size"], ["day", "id"])
    assert got.columns == there.columns
    assert {tuple(r) for r in got.collect()} == set(first.values())


def test_time_buckets_read_their_source_once(spark):
    """F34 to F43: every cut and count made the joins below the rows anew."""
    from resrisk.operators import timeseries

    read = spark.sparkContext.accumulator(0)

    def seen(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = [(i % 40, i, i % 2, (i * 37 % 100) / 100, "high" if i % 3 else "low") for i in range(400)]
    df = spark.createDataFrame(rows, "n int, id int, is_canceled int, cancel_probability double, risk_tier string").select(
        F.date_add(F.lit("2024-01-01").cast("date"), F.col("n")).alias("arrival_date"), "id", "is_canceled",
        "cancel_probability", "risk_tier")
    counted = df.mapInArrow(seen, df.schema)
    out = timeseries.temporal_stability(counted, ["id"], 4, 0.5).collect()
    assert sorted((r["bucket"], r["n"]) for r in out) == [(b, 100) for b in range(1, 5)] and read.value == 400
    timeseries.tier_calibration(counted, ["id"], 4).collect()
    assert read.value == 800


def test_draws_are_poisson_and_cheap():
    """F2, F8, F9, F33: a generator per group and chunk took most of the time of the bootstrap."""
    import time

    import numpy as np

    from resrisk.ml import models

    keys = np.random.default_rng(5).integers(-2 ** 62, 2 ** 62, 4000)
    begun = time.process_time()
    one = models.poisson_draws(42, 3, 250, keys, np.ones(4000, int))
    assert time.process_time() - begun < 0.06  # 0.2 s and more with a generator each
    for n, drawn in ((1, one), (3, models.poisson_draws(42, 3, 250, keys, np.full(4000, 3))),
                     (40, models.poisson_draws(42, 3, 250, keys, np.full(4000, 40)))):
        assert drawn.shape == (4000, 250)
        assert abs(drawn.mean() / n - 1) < 0.01 and abs(drawn.var() / n - 1) < 0.02
    share = np.bincount(one.ravel(), minlength=5)[:5] / one.size
    assert np.abs(share - np.exp(-1) / np.array([1, 1, 2, 6, 24])).max() < 0.002
    # Neither replicates nor groups nor chunks go together.
    other = models.poisson_draws(42, 4, 250, keys, np.ones(4000, int))
    for a, b in ((one[:, :-1], one[:, 1:]), (one[:-1], one[1:]), (one, other)):
        assert abs(np.corrcoef(a.ravel(), b.ravel())[0, 1]) < 0.005
    assert (models.poisson_draws(42, 3, 250, keys[::-1], np.ones(4000, int)) == one[::-1]).all()
    # A group of rows is drawn alike whatever stands beside it.
    mixed = models.poisson_draws(42, 3, 30, keys[:3], [1, 4, 99])
    assert (mixed[1] == models.poisson_draws(42, 3, 30, keys[1:2], [4])[0]).all() and (mixed[0] == one[0, :30]).all()


def test_largest_contributions_are_chosen_in_the_row(spark):
    """a row's terms were sorted by key twice to rank a handful of features."""
    from resrisk.ml import models

    nan, rng = float("nan"), random.Random(11)
    rows = [(i % 60 if i % 60 else None, i % 2, rng.choice(["a", "a_1", "b_2", "c", "zz"]),
             rng.choice([None, nan, 0.0, -0.0, -2.0, 2.0, 1.0, 0.25])) for i in range(400)]
    terms = spark.createDataFrame(rows, "k int, j int, encoded string, contribution double")
    long = models.top_contributions(models.attribution_by_feature(terms, ["a", "b", "c"], ["k", "j"]), ["k", "j"], 3)
    want = models.waterfall(long, ["k", "j"], 0.5)
    got = models.top_of_terms(terms, ["a", "b", "c"], ["k", "j"], 3, 0.5)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    plain = models.top_of_terms(terms, ["a", "b", "c"], ["k", "j"], 3)
    assert plain.columns == long.columns and plain.count() == long.count()
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Sort " not in plan and "Window" not in plan


def test_fits_read_even_parts_whatever_the_files(spark):
    """F1 to F28: the rows of a split lay in one or two files, and every fit ran in as many tasks."""
    from resrisk.ml import fits, models
    from resrisk.session import written_table

    rows = spark.range(90_000).select(
        "id", (F.col("id") % 3 == 0).cast("int").alias("is_canceled"), (F.col("id") % 1000).cast("double").alias("a"),
        F.when(F.col("id") % 2 == 0, "x").otherwise("y").alias("c"))
    table = written_table(rows.coalesce(1), "one-file")
    matrix = fits.feature_matrix(table.filter("id < 85000"), table.filter("id >= 85000"), ["c"], ["a"], ["id"])
    sizes = lambda df: df.rdd.mapPartitions(lambda p: [sum(1 for _ in p)]).collect()
    found = sizes(matrix.train)
    assert len(found) == 4 and sum(found) == 85_000 and max(found) < 22_000
    assert sizes(matrix.test) == [5000]
    assert models.fit_parts(spark, 6_000_000) == 61
    # A part that is made again has its rows in the same order: a fit pairs them by place.
    order = lambda: models.even_parts(table, 90_000).rdd.map(lambda r: r["id"]).glom().collect()
    assert order() == order()
    copies = sizes(models.even_parts(table.select(F.lit(1).alias("same")), 90_000))
    assert max(copies) < 25_000


def test_fitted_contributions_are_summed_in_the_row(spark):
    """every entry of a row's vector became a row, which was shuffled and sorted twice."""
    from resrisk.ml import explain, fits, models

    rng = random.Random(7)
    df = spark.createDataFrame(
        [(i // 2, int(rng.random() < 0.4), rng.random(), float(i % 4), rng.choice(["x", "y", "z"])) for i in range(300)],
        "id int, is_canceled int, a double, b double, c string")
    matrix, raw = fits.feature_matrix(df.filter("id < 100"), df.filter("id >= 100"), ["c"], ["a", "b"], ["id"]), ["a", "b", "c"]
    for family, size in (("logistic", {}), ("gradient_boosting", {"rounds": 2, "depth": 2})):
        explainer = explain.Explainer(fits.fit_on(matrix, family, **size), matrix.train)
        terms = explain.attribution_rows(explainer, matrix.test, ["id"])
        long = models.top_contributions(models.attribution_by_feature(terms, raw, ["id"]), ["id"], 2)
        want = models.waterfall(long, ["id"], explainer.base).select("id", "rank", "feature", "contribution", "running")
        sums, features = explain.attribution_sums(explainer, matrix.test, ["id"], raw)
        got = models.top_of_sums(sums, features, ["id"], 2, explainer.base)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Sort " not in plan and "Window" not in plan
        plain = lambda d: sorted((r["id"], r["rank"], r["feature"], round(r["contribution"], 9), round(r["running"], 9)) for r in d.collect())
        assert plain(got) == plain(want) and got.count() == 100
        assert models.top_of_sums(sums, features, ["id"], 2).columns == long.columns


def test_an_exchange_walks_only_the_trees_that_split_on_it():
    import numpy as np
    from resrisk.ml import explain, fits

    trees = fits.Trees.__new__(fits.Trees)
    # Three trees of one split each: on entries 1, 0 and 1; a leaf leads to itself.
    trees.left, trees.right = np.array([1, 1, 2, 4, 4, 5, 7, 7, 8]), np.array([2, 1, 2, 5, 4, 5, 8, 7, 8])
    trees.feature, trees.threshold = np.array([1, 0, 0, 0, 0, 0, 1, 0, 0]), np.full(9, 0.5)
    trees.value = np.array([0, -0.1, 0.3, 0, 0.7, -0.2, 0, 0.11, 0.13])
    trees.roots, trees.leaf, trees.depth = np.array([0, 3, 6]), trees.left == np.arange(9), 2
    explainer = explain.Explainer.__new__(explain.Explainer)
    explainer.trees, walked, steps = trees, [], trees._steps
    trees._steps = lambda x, root: walked.append(int(root)) or steps(x, root)
    rnd = np.random.default_rng(1)
    x, order = rnd.random((50, 3)), rnd.permutation(50)
    cases = [[], [0], [1], [0, 1], [2]]
    got = list(explainer.exchanged(x, [(c, order) for c in cases]))
    assert walked == [0, 3, 6, *[3], *[0, 6], *[0, 3, 6]]
    for c, p in zip(cases, got):
        mixed = x.copy()
        mixed[:, c] = x[order][:, c]
        assert (p == explainer.probabilities(mixed)).all()


def test_permuted_rows_are_counted_in_their_block(spark, monkeypatch):
    """Equal scores leave a block as one row; counts and importance are those of all rows."""
    import numpy as np
    from pyspark.ml.functions import array_to_vector
    from resrisk.ml import explain
    from resrisk.operators.metrics import Y, score_groups

    explainer = explain.Explainer.__new__(explain.Explainer)
    explainer.trees, explainer.weights, explainer.intercept = None, np.array([1.0, -0.5]), 0.1
    rows = spark.range(600).select("id", (F.col("id") % 3 == 0).cast("int").alias(Y), array_to_vector(
        F.array((F.col("id") % 4).cast("double"), (F.col("id") % 5).cast("double"))).alias("features"))
    args = explainer, rows, ["id"], {"a": [0], "b": [1]}, 2
    by = ["feature", "repeat"]
    each = explain.permuted_scores(*args, block_rows=100)
    assert each.count() == 600 * 3 * 2
    want = score_groups(each, by, p="score").select(*by, "score", "pos", "neg")
    got = explain.permuted_counts(*args, block_rows=100).select(*by, "score", "pos", "neg")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    made, sizes = explain._by_block, []
    monkeypatch.setattr(explain, "_by_block", lambda *a: sizes.append(made(*a)) or sizes[0])
    assert explain.permutation_importance(*args, block_rows=100).count() == 2
    assert sizes[0].count() <= 6 * 2 * 3 * 20 < 600 * 3 * 2
