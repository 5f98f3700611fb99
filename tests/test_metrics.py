import random

import pytest

from resrisk.operators import cost, metrics, thresholds


def brute_auc(y, p):
    pos = [s for s, t in zip(p, y) if t]
    neg = [s for s, t in zip(p, y) if not t]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))


def test_threshold_is_inclusive(pairs):
    row = metrics.confusion_counts(pairs([1, 0], [0.5, 0.4]), 0.5).first()
    assert (row["tp"], row["tn"], row["fp"], row["fn"]) == (1, 1, 0, 0)


def test_perfect_scores(pairs):
    row = metrics.threshold_metrics(pairs([0, 0, 1, 1], [0.1, 0.2, 0.8, 0.9]), 0.5).first()
    assert row["f1"] == 1.0 and row["roc_auc"] == 1.0 and row["pr_auc"] == 1.0


def test_single_class_has_no_auc(pairs):
    row = metrics.auc_metrics(pairs([0, 0], [0.1, 0.2])).first()
    assert row["roc_auc"] is None and row["pr_auc"] is None


def test_auc_equals_pair_counting(pairs):
    rng = random.Random(1)
    y = [rng.randint(0, 1) for _ in range(300)]
    p = [round(rng.random(), 2) for _ in range(300)]
    got = metrics.auc_metrics(pairs(y, p)).first()["roc_auc"]
    assert got == pytest.approx(brute_auc(y, p), abs=1e-12)


def test_ece_limits(pairs):
    assert metrics.ece(pairs([0, 1], [0.0, 1.0])).first()["ece"] == 0.0
    assert metrics.ece(pairs([1, 0], [0.0, 1.0])).first()["ece"] > 0.5
    assert metrics.ece(pairs([0], [0.5]).filter("false")).first()["ece"] is None


def test_cost_at_threshold(pairs):
    df = pairs([0, 0, 1, 1], [0.2, 0.6, 0.4, 0.9], [50, 50, 80, 80])
    row = cost.cost_at_thresholds(df, {"half": 0.5}).first()
    assert (row["fp_count"], row["fn_count"], row["total_cost"]) == (1, 1, 95.0)


def test_intervene_all_costs_every_negative(pairs):
    df = pairs([0, 0, 0, 1, 1], [0.1, 0.2, 0.3, 0.8, 0.9], [100] * 5)
    assert cost.cost_policy_summary(df).first()["intervene_all_cost"] == 45.0


def test_fn_cost(spark):
    df = spark.createDataFrame([(100.0, 3.0), (200.0, 5.0), (80.0, 1.0), (None, 4.0)],
                               "adr double, total_stay double")
    got = [r[0] for r in df.select(cost.fn_cost(df)).collect()]
    assert got == [200.0, 800.0, 0.0, 0.0]


def test_sweep_equals_counting(pairs):
    rng = random.Random(2)
    y = [rng.randint(0, 1) for _ in range(500)]
    p = [rng.choice([rng.random(), 0.29, 0.57, 1.0, 0.0]) for _ in range(500)]
    rows = thresholds.threshold_sweep(pairs(y, p)).orderBy("threshold").collect()
    assert len(rows) == 100 and rows[0]["threshold"] == 0.0
    for r in rows:
        flagged = [t for s, t in zip(p, y) if s >= r["threshold"]]
        assert r["recall"] == pytest.approx(sum(flagged) / sum(y))
        assert r["positive_rate"] == pytest.approx(len(flagged) / 500)


def test_empty_sweep_gives_default(pairs):
    empty = pairs([0], [0.1]).filter("false")
    assert thresholds.select_max_f1(thresholds.threshold_sweep(empty)).first()["threshold"] == 0.5
    row = thresholds.select_min_cost(thresholds.cost_sweep(empty)).first()
    assert row["threshold"] == 0.5 and row["total_cost"] == 0.0


def test_resolve_thresholds(spark):
    df = spark.createDataFrame([("0.0", "1.7", "-2"), ("true", "x", None)],
                               "high_precision string, max_f1 string, cost_sensitive string")
    a, b = thresholds.resolve_thresholds(df).collect()
    assert (a["high_precision"], a["max_f1"], a["cost_sensitive"]) == (0.0, 1.0, 0.0)
    assert (b["high_precision"], b["max_f1"], b["cost_sensitive"]) == (0.5, 0.5, 0.5)
    assert b["cost_fallback_used"] and b["alert"]


def test_curve_ends_at_one(pairs):
    last = metrics.curve_points(pairs([0, 1, 1], [0.2, 0.3, 0.9])).orderBy("threshold").first()
    assert last["tpr"] == 1.0 and last["fpr"] == 1.0


def test_what_if_counts_every_row(pairs):
    rows = thresholds.what_if(pairs([0, 1, 1], [0.2, 0.3, 0.9]), [0.25, 0.95]).collect()
    assert all(r["tp"] + r["fp"] + r["fn"] + r["tn"] == 3 for r in rows)
    assert rows[0]["tp"] == 2 and rows[1]["tp"] == 0
