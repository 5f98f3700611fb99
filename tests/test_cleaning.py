import datetime as dt

import pytest
from pyspark.sql import functions as F

from resrisk.functions import clean, rules
from resrisk.operators import drift, gates
from resrisk.sources import bookings, prediction_log

ROW = {"hotel": "City Hotel", "lead_time": 10, "arrival_date_year": 2017,
       "arrival_date_month": "july", "arrival_date_day_of_month": 5, "stays_in_weekend_nights": 1,
       "stays_in_week_nights": 2, "adults": 2, "children": None, "babies": 0, "agent": "NULL",
       "company": None, "country": " ", "adr": 100.0, "is_canceled": 0}
SCHEMA = ("hotel string, lead_time int, arrival_date_year int, arrival_date_month string, "
          "arrival_date_day_of_month int, stays_in_weekend_nights int, stays_in_week_nights int, "
          "adults int, children double, babies int, agent string, company string, country string, "
          "adr double, is_canceled int")


@pytest.fixture
def frame(spark):
    def make(*changes):
        rows = [{**ROW, **c} for c in changes]
        return spark.createDataFrame([tuple(r.values()) for r in rows], SCHEMA)
    return make


def test_bad_rows_go_and_null_rate_stays(frame):
    df = frame({}, {"adr": -1.0}, {"adr": 50_000.0}, {"adults": 0}, {"adr": None})
    kept = clean.clean_bookings(df)
    assert kept.count() == 2 and "company" not in kept.columns
    issues = {r["issue"]: r["n"] for r in clean.cleaning_issue_counts(df).collect()}
    assert issues["children_null_filled_zero"] == 5 and issues["rows_dropped_total"] == 3
    assert issues["rows_dropped_zero_guests"] == 1 and issues["country_unknown_rows"] == 5


def test_derived_features(frame):
    r = clean.derive_features(frame({}, {"lead_time": None})).collect()
    assert (r[0]["total_stay"], r[0]["total_guests"], r[0]["adr_per_person"]) == (3.0, 2.0, 50.0)
    assert r[0]["revenue_at_risk"] == 300.0 and r[0]["agent"] == 0
    assert r[0]["month_sin"] ** 2 + r[0]["month_cos"] ** 2 == pytest.approx(1)
    assert r[1]["is_late_window"] == 0


def test_impossible_date_is_null(frame):
    df = clean.add_arrival_date(clean.normalise_inputs(frame(
        {}, {"arrival_date_month": "February", "arrival_date_day_of_month": 30})))
    assert [r["arrival_date"] for r in df.collect()] == [dt.date(2017, 7, 5), None]
    with pytest.raises(ValueError):
        clean.require_some_dates(df.filter("arrival_date IS NULL"))


def test_validation_names_the_problem(frame):
    checks = {r["check_name"]: r for r in clean.validate_table(
        frame({"is_canceled": 2, "lead_time": -3}), ["lead_time", "no_such"]).collect()}
    assert "no_such" in checks["required_columns_present"]["message"]
    assert not checks["target_binary"]["passed"]
    assert "lead_time" in checks["non_negative_numeric"]["message"]


def test_requests_are_judged(frame):
    df = frame({"arrival_date_month": "Jul"}, {"adults": 0}).drop("is_canceled")
    valid, rejected = rules.split_requests(df)
    assert valid.first()["arrival_date_month"] == "July"
    assert rejected.first()["reasons"] == ["adults is out of range"]
    extra = rules.request_reasons(df.withColumn("surprise", F.lit(1))).first()["reasons"]
    assert extra == ["surprise is not a known field"]


def test_tiers(spark):
    df = spark.createDataFrame([(0.39,), (0.4,), (0.7,)], "p double")
    assert [r[0] for r in df.select(rules.risk_tier(F.col("p"))).collect()] == [
        "low", "medium", "high"]
    assert [r[0] for r in df.select(rules.risk_tier_right_closed(F.col("p"))).collect()] == [
        "low", "low", "medium"]


def test_csv_with_byte_order_mark(spark, tmp_path):
    path = tmp_path / "b.csv"
    path.write_text("hotel,adr,children\nCity Hotel,99.5,NA\n", encoding="utf-8-sig")
    row = bookings.scan_csv(spark, str(path)).first()
    assert row["hotel"] == "City Hotel" and row["adr"] == 99.5 and row["children"] is None
    path.write_text("hotel,adr\n", encoding="utf-8")
    with pytest.raises(ValueError):
        bookings.scan_csv(spark, str(path))


def test_log_round_trip(spark, tmp_path):
    path = str(tmp_path / "log")
    assert prediction_log.count_log(spark, path) == 0
    df = spark.createDataFrame([(0.5, True, ["a"], [("adr", "9", 0.1)])],
                               "p double, hit boolean, alerts array<string>, "
                               f"top_features {prediction_log.TOP_FEATURES}")
    for _ in range(2):
        assert prediction_log.append_log(df, path, F.lit("2024-01-02 03:00:00").cast("timestamp"))
    assert prediction_log.count_log(spark, path) == 2
    row = prediction_log.decode(prediction_log.read_log(spark, path)).first()
    assert row["hit"] == 1 and row["alerts"] == ["a"] and row["top_features"][0]["value"] == "9"
    assert prediction_log.export_since(spark, path, str(tmp_path / "o"), "2024-01-03") == 0


def _psi(spark, base, live):
    rows = [("v", float(x), 0) for x in base] + [("v", float(x), 1) for x in live]
    df = spark.createDataFrame(rows, "feature string, value double, is_live int")
    return drift.psi_numeric(df).first()


def test_psi(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    a = rng.normal(size=1000)
    assert _psi(spark, a, a)["psi"] == pytest.approx(0, abs=1e-9)
    assert _psi(spark, a, a + 2)["psi"] > 0.25
    edges = np.percentile(a, np.linspace(0, 100, 11))
    edges[0], edges[-1] = -np.inf, np.inf
    b = a + 0.3
    p, q = [(np.histogram(x, edges)[0] + 1e-4) / 1000 for x in (a, b)]
    assert _psi(spark, a, b)["psi"] == pytest.approx(float(np.sum((q - p) * np.log(q / p))))


def test_missing_metric_fails_its_gate(spark):
    m = spark.createDataFrame([("max_f1", "f1", 0.9)], "policy string, metric string, value double")
    passed = {(r["policy"], r["metric"]): r["passed"] for r in gates.metric_gates(m).collect()}
    assert passed[("max_f1", "f1")] and not passed[("high_precision", "recall")]
