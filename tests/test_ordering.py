import datetime as dt
import random

import numpy as np
import pytest

from resrisk.operators import ordering, splits, stats


@pytest.fixture(scope="module")
def days(spark):
    """A third of the rows fall on one day; some have no day."""
    rng = random.Random(3)
    rows = []
    for i in range(3000):
        day = None if i % 100 == 7 else dt.date(2020, 1, 1) + dt.timedelta(rng.randint(0, 40))
        if day and i % 3 == 0:
            day = dt.date(2020, 1, 20)
        rows.append((day, i * 37 % 3001, i % 2))
    return spark.createDataFrame(rows, "day date, id bigint, is_canceled int")


def ordered(df):
    return sorted(((r["day"] or dt.date.max, r["id"]) for r in df.collect()))


@pytest.mark.parametrize("partitions", [1, 4, 16])
def test_position_equals_sorting(days, partitions):
    rows = ordering.global_position(days.repartition(partitions), "day", ["id"]).collect()
    got = [(r["day"] or dt.date.max, r["id"]) for r in sorted(rows, key=lambda r: r["position"])]
    assert [r["position"] for r in sorted(rows, key=lambda r: r["position"])] == list(range(3000))
    assert got == ordered(days)


def test_splits_follow_positions(days):
    df = splits.time_split(days, "day", ["id"])
    sizes = {r["split"]: r["count"] for r in df.groupBy("split").count().collect()}
    assert sizes == {"train": 2400, "val": 300, "test": 300}
    train = ordered(df.filter("split = 'train'"))
    assert train == ordered(days)[:2400]
    # Rows without a day come last.
    assert df.filter("day IS NULL AND split != 'test'").count() == 0


def test_too_small_split_fails(days):
    with pytest.raises(ValueError):
        splits.time_split(days.limit(3), "day", ["id"])


def test_buckets_like_array_split(days):
    rows = splits.time_buckets(days, "day", ["id"], 7).groupBy("bucket").count().collect()
    want = [len(a) for a in np.array_split(np.arange(3000), 7)]
    assert [r["count"] for r in sorted(rows, key=lambda r: r["bucket"])] == want


def test_expanding_folds_end_at_the_last_row():
    folds = splits.expanding_folds(103, 5)
    assert folds[-1].test_end == 103 and all(f.train_end == f.test_start for f in folds)


def test_stratified_folds_keep_the_ratio(days):
    rows = splits.stratified_folds(days, ["id"], 5).groupBy("fold", "is_canceled").count().collect()
    assert {r["count"] for r in rows} == {300} and len(rows) == 10


def test_stratified_folds_slice_again_where_a_slice_is_large(days, monkeypatch):
    folds = lambda: sorted(map(tuple, splits.stratified_folds(days, ["id"], 5).select("id", "fold").collect()))
    want = folds()
    monkeypatch.setattr(splits, "SLICE_ROWS", 1)
    assert folds() == want


def test_finer_slices_hold_the_places_of_the_coarser():
    found, largest = splits._finer({("1", "0a3"): [4, 5], ("1", "fff"): [0]}, [
        ("1", "0a3000", 5), ("1", "0a3fff", 9), ("1", "fff111", 2)])
    assert found == {("1", "0a3000"): [4], ("1", "0a3fff"): [0], ("1", "fff111"): [0]} and largest == 9


def test_quantiles_equal_numpy(spark):
    rng = random.Random(4)
    values = [rng.choice([5.0, 5.0, rng.gauss(0, 100)]) for _ in range(999)]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [0.0, 0.01, 0.25, 0.5, 0.9, 1.0]
    got = {r["prob"]: r["value"] for r in ordering.exact_quantiles(df, "v", probs).collect()}
    for p in probs:
        assert got[p] == pytest.approx(np.percentile(values, 100 * p), rel=1e-12)


def test_pareto_equals_brute_force(spark):
    rng = random.Random(5)
    points = [(i, rng.randint(0, 30), rng.randint(0, 30)) for i in range(300)]
    df = spark.createDataFrame(points, "id int, x int, y int")
    beaten = lambda a: any(b[1] <= a[1] and b[2] >= a[2] and (b[1] < a[1] or b[2] > a[2])
                           for b in points)
    got = {r["id"] for r in stats.pareto_frontier(df, "x", "y").collect()}
    assert got == {a[0] for a in points if not beaten(a)}


def test_chi2_tail():
    assert stats.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(5.991465, 2) == pytest.approx(0.05, abs=1e-6)
    assert stats.chi2_tail(11.0705, 5) == pytest.approx(0.05, abs=1e-5)


def test_random_subset_does_not_depend_on_partitions(days):
    ids = lambda d: {r["id"] for r in splits.random_subset(d, ["id"], 0.3, 1).collect()}
    assert ids(days) == ids(days.repartition(7))
