"""The stored scoring model in batch and on a stream, drift on a stream, and the benchmark report."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from resrisk.catalog import queries
from resrisk.catalog.modelling import ADR_NUMS, CATS, NUMS
from resrisk.catalog.monitoring import CAT, REPORT_NUM
from resrisk.ml import store
from resrisk.operators import benchmark, drift
from resrisk.sources.star_schema import KEYS, requests, scored
from resrisk.streaming import jobs

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark, tmp_path_factory):
    df = scored(spark, SF)
    made = store.fit_scoring_model(df.filter("arrival_date_year < 1997"), df.filter("arrival_date_year = 1997"), CATS, NUMS,
                                   ADR_NUMS, rounds=5, depth=3)
    folder = str(tmp_path_factory.mktemp("model"))
    assert [store.save(spark, made, folder), store.save(spark, made, folder)] == [1, 2]
    loaded = store.load(spark, folder)
    assert loaded.version == 2 and store.load(spark, folder, 1).version == 1
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder, 3)
    with pytest.raises(FileNotFoundError):
        store.load(spark, folder + "/none")
    assert (loaded.thresholds, loaded.levels, loaded.numbers) == (made.thresholds, made.levels, made.numbers)
    return loaded


def test_responses_follow_from_the_probability(spark, model):
    valid, rejected = store.answer(model, requests(spark, SF), KEYS)
    rows = valid.collect()
    assert len(rows) + rejected.count() == requests(spark, SF).count() and rejected.filter("size(reasons) = 0").isEmpty()
    for r in rows:
        p = r["cancel_probability"]
        assert 0 <= p <= 1 and r["model_version"] == 2
        assert r["risk_tier"] == ("high" if p >= 0.7 else "medium" if p >= 0.4 else "low")
        for name, t in model.thresholds.items():
            assert r[f"label_{name}"] == int(p >= t) and r[f"threshold_{name}"] == t
        if r["adr"] is not None:
            assert r["adr_residual"] == pytest.approx(round(r["adr"] - r["predicted_adr"], 2), abs=0.011)
        tops = [abs(t["contribution"]) for t in r["top_features"]]
        assert len(tops) == 5 and tops == sorted(tops, reverse=True)
    # Unknown levels, and a request without most fields.
    few = spark.createDataFrame([(1, "Other Hotel", 5, 2, dt.date(2020, 5, 1))],
                                "order_key int, hotel string, lead_time int, adults int, arrival_date date")
    some, none = store.answer(model, few, ["order_key"])
    found = some.collect() + none.collect()
    assert len(found) == 1


def test_stream_answers_equal_the_batch(spark, model, tmp_path):
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3)
    lines.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))
    wanted = [*KEYS, "cancel_probability", "risk_tier", "predicted_adr"]
    answer = lambda batch: store.answer(model, batch, KEYS)[0].select(*wanted)
    jobs.drain_batches(requests(spark, SF, stream), jobs.batch_folder(str(tmp_path / "out"), answer), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    assert got.select("batch_id").distinct().count() == 3
    batch = answer(requests(spark, SF))
    assert sorted(map(str, got.select(*wanted).collect())) == sorted(map(str, batch.collect()))


def test_stream_drift_adds_up_over_batches(spark, tmp_path):
    rows = scored(spark, SF)
    base, live = rows.filter("arrival_date_year < 1998"), rows.filter("arrival_date_year >= 1998")
    lines = spark.read.parquet(f"{SF}/lineitem.parquet").repartition(3)
    lines.write.parquet(str(tmp_path / "lines"))
    stream = spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "lines"))
    profile = drift.baseline_profile(base, REPORT_NUM, CAT, str(tmp_path / "profile"))
    counts = drift.live_counts(scored(spark, SF, stream).filter("arrival_date_year >= 1998"), profile, REPORT_NUM, CAT)
    seen = []

    def write(batch, i):
        report = drift.report_from_counts(batch, profile)
        seen.append({r["feature"]: r for r in report.collect()})

    jobs.drain_batches(counts, write, str(tmp_path / "check"), "complete")
    want = {r["feature"]: r for r in drift.drift_report(base, live, REPORT_NUM, CAT).collect()}
    assert len(seen) == 3 and seen[0]["adr"]["n_live"] < seen[1]["adr"]["n_live"] < seen[2]["adr"]["n_live"]
    for name, r in want.items():
        got = seen[-1][name]
        assert (got["kind"], got["n_live"], got["n_baseline"]) == (r["kind"], r["n_live"], r["n_baseline"])
        assert got["psi"] == pytest.approx(r["psi"], abs=2e-6)


def test_report_has_sixteen_tables(spark):
    from resrisk import config
    from resrisk.catalog.evaluation import DAY, split_scored

    rows = split_scored(spark, SF)
    tables = benchmark.benchmark_tables(rows, ["cancel_probability", "rival_probability"], DAY, KEYS, config.FAMILY_SIZES, 20)
    assert [t[:2] for t in sorted(tables)] == [f"{i:02d}" for i in range(1, 17)]
    assert all(df.count() > 0 for df in tables.values())
    assert tables["14_paired_significance_vs_champion"].filter("model = 'cancel_probability'").isEmpty()
    assert tables["05_holdout_threshold_metrics_max_f1"].count() == 2


def test_written_tables_go_with_their_result(spark):
    from resrisk import session

    before = set(session._WRITTEN)
    df = queries()["m8_11_fold_summary"](spark, SF)
    assert df.filter(F.col("folds") > 0).count() >= 0 and set(session._WRITTEN) - before
    session.release(df)
    assert set(session._WRITTEN) == before
