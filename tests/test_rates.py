"""Rate forecasts of several families on rows that are encoded once."""

import random

from resrisk.catalog import modelling
from resrisk.ml import models
from resrisk.operators import metrics

FAMILIES = ["linear", "decision_tree"]


def bookings(spark, n=300):
    rnd = random.Random(5)
    rows = []
    for i in range(n):
        hotel, nights = rnd.choice(["City", "Resort", None]), rnd.choice([1, 2, 7, None])
        rate = None if i % 17 == 0 else 80.0 + 10 * (nights or 3) + (25 if hotel == "City" else 0) + rnd.random()
        rows.append((i, ("train", "val", "test")[i % 3], hotel or "UNKNOWN", nights, rate))
    return spark.createDataFrame(rows, "id int, split string, hotel string, nights int, adr double")


def test_rates_of_families_are_those_of_single_fits(spark):
    rows = bookings(spark)
    train = rows.filter("split = 'train'")
    known = models.rate_rows(train, ["hotel"], ["nights"])
    fitted = {f: models.fit_rate(known, f) for f in FAMILIES}
    got = {r["id"]: r for r in models.score_rates(known, fitted, rows, ["nights"]).collect()}
    for family in FAMILIES:
        one = models.score_adr(models.fit_adr(train, family, ["hotel"], ["nights"]), rows, ["nights"]).collect()
        assert len(one) == len(got) and all(got[r["id"]][family] == r["predicted_adr"] for r in one)


def test_metrics_of_families_read_written_forecasts(spark, monkeypatch):
    rows = bookings(spark)
    known = models.rate_rows(rows.filter("split = 'train'"), ["hotel"], ["nights"])
    monkeypatch.setattr(models, "REGRESSORS", FAMILIES)
    monkeypatch.setattr(modelling, "CATS", ["hotel"])
    monkeypatch.setattr(modelling, "ADR_NUMS", ["nights"])
    monkeypatch.setattr(modelling, "part", lambda spark, sf, name: rows.filter(f"split = '{name}'"))
    monkeypatch.setattr(modelling, "prepared", lambda spark, sf: rows)
    monkeypatch.setattr(modelling, "rate_rows", lambda spark, sf: known)
    monkeypatch.setattr(modelling, "fitted_adr", lambda spark, sf, family: models.fit_rate(known, family))
    found = modelling._adr_metrics(spark, "none")
    # Each metric scored the whole table anew: the models were in the plan, not their forecasts.
    assert any("rate-scores" in f for f in found.inputFiles())
    assert "UDF(" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["family"], r["split"]): r for r in found.collect()}
    for family in FAMILIES:
        p = models.score_adr(models.fit_rate(known, family), rows, ["nights"])
        for r in metrics.regression_metrics(p, "adr", "predicted_adr", ["split"]).collect():
            same = got.pop((family, r["split"]))
            assert all(abs((same[c] or 0) - (r[c] or 0)) < 1e-9 for c in r.asDict() if c != "split")
    assert not got
