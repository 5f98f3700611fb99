"""The incremental eigendecomposition against a dense one."""

import numpy as np
import pytest
from resrisk.llm import queries, whitening
from resrisk.session import release


def dense(x):
    """Eigenvalues and eigenvectors of the covariance of whole-number rows, by falling value."""
    c = x - x.mean(0)
    e, q = np.linalg.eigh(c.T @ c / len(x))
    return e[::-1], q[:, ::-1]


@pytest.mark.parametrize("n,d,high,parts", [
    (1, 3, 9, 1), (5, 9, 4, 2), (40, 6, 1, 3), (60, 5, 2, 4), (300, 12, 1000, 5), (30, 8, 50, 30)])
def test_combined_spectra_are_those_of_all_rows(n, d, high, parts):
    x = np.random.default_rng(n * d).integers(0, high + 1, (n, d)) + 1_000_000
    whole = whitening.Spectrum(d)
    for rows in np.array_split(x, parts):
        own = whitening.Spectrum(d)
        for half in np.array_split(rows, 2):
            if len(half):
                own.add_rows(half)
        whole.add_spectrum(own.n, own.sums, own.values, own.vectors)
    c = x - x.mean(0)
    size = max(1.0, np.abs(c.T @ c).max())
    assert np.abs(whole.vectors * whole.values @ whole.vectors.T - c.T @ c).max() < 1e-12 * size
    assert np.abs(whole.vectors.T @ whole.vectors - np.eye(d)).max() < 1e-12
    assert whole.n == n and list(whole.sums) == list(x.sum(0))


def test_deflation_of_equal_values_and_missing_parts():
    values, vectors = np.zeros(6), np.eye(6)
    total = np.zeros((6, 6))
    for v in (np.eye(6)[2] * 3, np.ones(6), np.eye(6)[2] * 3, np.array([1e-9, 0, 0, 1e6, 0, 0]), np.zeros(6)):
        values, vectors = whitening.rank_one_update(values, vectors, v)
        total += np.outer(v, v)
    assert np.abs(vectors * values @ vectors.T - total).max() < 1e-12 * total.max()
    assert np.abs(vectors.T @ vectors - np.eye(6)).max() < 1e-13 and np.all(np.diff(values) >= 0)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, n string, row string, x string")


def check(got, vectors, components=32):
    """Against the dense result, whatever the signs."""
    x = np.floor(64 * np.array(vectors, np.float32).astype(float)).astype(np.int64) + 1_000_000
    e, q = dense(x)
    n, sums = len(x), x.sum(0)
    shown = min(components, int((e > 1e-9 * e.sum()).sum()))
    white = np.array([r["whitened"] for r in got])
    want = (x - x.mean(0)) @ q[:, :shown] / np.sqrt(e[:shown])
    assert white.shape == want.shape
    assert [int(r["deviation"]) for r in got] == [sum((n * int(v) - int(s)) ** 2 for v, s in zip(r, sums)) for r in x]
    assert all(np.allclose(r["explained"], e[:shown] / e.sum(), rtol=1e-9) and r["n"] == n for r in got)
    assert all(r["identity_error"] < 1e-9 for r in got)
    return white, want


def test_whitening_equals_a_dense_one(spark):
    rng = np.random.default_rng(5)
    vectors = (rng.normal(size=(200, 40)) * np.linspace(1, 3, 40)).tolist()
    rows = [(i, v, "old", "r", "x") for i, v in enumerate(vectors)]
    bad = [(900, None, "", "", ""), (901, [1.0] * 39 + [None], "", "", ""), (902, [float("nan")] * 40, "", "", ""),
           (903, [float("inf")] * 40, "", "", ""), (904, [], "", "", ""), (905, [1.0, 2.0], "", "", "")]
    got = whitening.whiten(frame(spark, bad + rows).repartition(20))
    assert got.columns == ["vec_id", "embedding", "row", "x", "n", "deviation", "whitened", "explained", "identity_error"]
    got = sorted(got.collect(), key=lambda r: r["vec_id"])
    assert [r["vec_id"] for r in got] == list(range(200)) and {(r["row"], r["x"]) for r in got} == {("r", "x")}
    white, want = check(got, vectors)
    assert np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-8)


def test_repeated_rows_without_variance_and_empty_tables(spark):
    same = [(i, [1.0, 2.0], "", "", "") for i in range(5)]
    assert whitening.whiten(frame(spark, same)).count() == 0
    assert whitening.whiten(frame(spark, [])).count() == 0
    assert whitening.whiten(frame(spark, same[:1])).count() == 0
    # One direction has no variance; a third of all rows is one vector; entries are large.
    vectors = [[3.0e7, float(i % 4), 5.0] if i % 3 else [1.0, 2.0, 5.0] for i in range(60)]
    got = whitening.whiten(frame(spark, [(i, v, "", "", "") for i, v in enumerate(vectors)]).repartition(3)).collect()
    check(sorted(got, key=lambda r: r["vec_id"]), vectors)
    # Sums of squares beyond 64 bits.
    vectors = [[1e12 * i, float(i * i % 7)] for i in range(30)]
    got = whitening.whiten(frame(spark, [(i, v, "", "", "") for i, v in enumerate(vectors)])).collect()
    assert max(int(r["deviation"]) for r in got) > 1 << 63


def test_registered_query(spark):
    df = queries()["op12_whitening"](spark, "/root/testdata/sf0.001")
    rows = df.collect()
    release(df)
    assert len(rows) == 500 * 32 and max(r["identity_error"] for r in rows) < 1e-9
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.floor(64 * np.array([r["embedding"] for r in table], np.float32).astype(float)) + 1_000_000
    e, q = dense(x.astype(np.int64))
    white = np.zeros((500, 32))
    for r in rows:
        white[r["vec_id"], r["component"] - 1] = r["whitened"]
    want = (x - x.mean(0)) @ q[:, :32] / np.sqrt(e[:32])
    assert np.allclose(white * np.sign((white * want).sum(0)), want, atol=1e-7)
