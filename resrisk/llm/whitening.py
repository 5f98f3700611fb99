"""Whitening of embeddings by an incremental eigendecomposition."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written_table

#: Rows whose scatter is reduced to a triangle before its updates are applied.
_BLOCK = 16_384
#: Spectra that one task combines.
_FAN = 16


def _secular_roots(d: np.ndarray, z: np.ndarray, rho: float) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of diag(d) + rho z z', as an origin (index into d) and a distance from it.

    `d` rises strictly, no z is zero, rho > 0. Root i lies between d[i] and d[i + 1], the last one
    below d[-1] + rho |z|^2. It is kept as a distance from the nearer pole, found by bisection, so
    that differences to the poles are exact to the last bits.
    """
    n = len(d)
    weight = rho * z * z
    upper = np.append(d[1:], d[-1] + weight.sum())
    middle = (d + upper) / 2
    at = 1 + (weight / (d - middle[:, None])).sum(1)
    # Where the function is negative half way, the root is nearer to the upper pole.
    origin = np.where((at < 0) & (np.arange(n) < n - 1), np.arange(n) + 1, np.arange(n))
    gaps = d - d[origin][:, None]
    low, high = np.zeros(n), np.where(origin > np.arange(n), 0.0, upper - d)
    half = (upper - d) / 2
    low = np.where(origin > np.arange(n), -half, low)
    high = np.where((origin == np.arange(n)) & (np.arange(n) < n - 1) & (at >= 0), half, high)
    for _ in range(1100):
        t = (low + high) / 2
        if np.all((t == low) | (t == high)):
            break
        with np.errstate(divide="ignore"):
            f = 1 + (weight / (gaps - t[:, None])).sum(1)
        low, high = np.where(f < 0, t, low), np.where(f < 0, high, t)
        if np.all(high - low <= 2e-16 * np.maximum(np.abs(low), np.abs(high))):
            break
    t = (low + high) / 2
    return origin, np.where(t == 0, np.where(low == 0, high, low), t)


def rank_one_update(values: np.ndarray, vectors: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues (rising) and eigenvectors of `vectors diag(values) vectors' + v v'`.

    Directions in which `v` has no part, and all but one of each group of equal eigenvalues (turned
    so that `v` meets one direction only), are deflated: they stay as they are. The rest solve the
    secular equation. The update's own vector is then computed anew from the roots found, of which
    it is the exact one, so that eigenvectors of close roots stay orthogonal.
    """
    rho = float(v @ v)
    if rho == 0.0:
        return values, vectors
    z = vectors.T @ v / np.sqrt(rho)
    d, q = values.copy(), vectors.copy()
    tol = 8 * np.finfo(float).eps * max(np.abs(d).max(), rho)
    # Turn the pairs of equal values, from the lowest on, so that the first gets no part of v.
    last = -1
    for i in np.flatnonzero(rho * np.abs(z) > tol):
        if last >= 0 and (d[i] - d[last]) * abs(z[last] * z[i]) <= tol * (z[last] ** 2 + z[i] ** 2):
            r = np.hypot(z[last], z[i])
            c, s = z[i] / r, z[last] / r
            q[:, [last, i]] = q[:, [last, i]] @ np.array([[c, s], [-s, c]])
            d[last], d[i] = d[last] * c * c + d[i] * s * s, d[last] * s * s + d[i] * c * c
            z[last], z[i] = 0.0, r
        last = i
    on = np.flatnonzero(rho * np.abs(z) > tol)
    if len(on):
        on = on[np.argsort(d[on], kind="stable")]
        base, part = d[on], z[on]
        origin, t = _secular_roots(base, part, rho)
        # Differences (pole j) - (root i), each from the root's own origin.
        diff = (base - base[origin][:, None]) - t[:, None]
        poles = base[None, :] - base[:, None]
        np.fill_diagonal(poles, 1.0)
        ratio = -diff / np.where(np.eye(len(on), dtype=bool), 1.0, poles.T)
        own = np.sqrt(np.abs(ratio.prod(axis=0) / rho)) * np.sign(part)
        w = own / diff
        w /= np.linalg.norm(w, axis=1)[:, None]
        q[:, on] = q[:, on] @ w.T
        d[on] = base[origin] + t
    order = np.argsort(d, kind="stable")
    return d[order], q[:, order]


class Spectrum:
    """Count, exact sums and eigendecomposition of the centred scatter of some whole-number vectors."""

    def __init__(self, size: int) -> None:
        self.n, self.sums = 0, np.zeros(size, object)
        self.values, self.vectors = np.zeros(size), np.eye(size)

    def _shift(self, n: int, sums: np.ndarray) -> np.ndarray:
        """The part that the distance of both means adds to the scatter; then counts both."""
        if self.n and n:
            # Whole numbers: the difference of the means loses nothing.
            apart = (sums * self.n - self.sums * n).astype(float) / (self.n * n)
            out = apart * np.sqrt(self.n * n / (self.n + n))
        else:
            out = np.zeros(len(self.sums))
        self.n, self.sums = self.n + n, self.sums + sums
        return out

    def _update(self, v: np.ndarray) -> None:
        self.values, self.vectors = rank_one_update(self.values, self.vectors, v)

    def add_rows(self, x: np.ndarray) -> None:
        """Rows of whole numbers. More rows than dimensions are first turned into a triangle with
        the same scatter; each row left is a rank-one update."""
        n, d = x.shape
        sums = x.sum(0).astype(object)
        # Shifted by a row first: the mean of what is left is small.
        near = (x - x[0]).astype(float)
        centred = near - near.mean(0)
        if n > d:
            centred = np.linalg.qr(centred, mode="r")
        self._update(self._shift(n, sums))
        for row in centred:
            self._update(row)

    def add_spectrum(self, n: int, sums: np.ndarray, values: np.ndarray, vectors: np.ndarray) -> None:
        """Another spectrum: an update for the means and one for each of its directions."""
        self._update(self._shift(n, sums))
        for value, vector in zip(values, vectors.T):
            if value > 0:
                self._update(np.sqrt(value) * vector)

    def row(self, part: int) -> pa.RecordBatch:
        return pa.record_batch([
            pa.array([part], pa.int64()), pa.array([self.n], pa.int64()),
            pa.array([[int(s) for s in self.sums]], pa.list_(pa.decimal128(38, 0))),
            pa.array([self.values.tolist()], pa.list_(pa.float64())),
            pa.array([self.vectors.ravel().tolist()], pa.list_(pa.float64()))], names=_NAMES)


_NAMES = ["part", "n", "sums", "eigenvalues", "vectors"]
_SPECTRUM = "part bigint, n bigint, sums array<decimal(38,0)>, eigenvalues array<double>, vectors array<double>"


def whole_numbers(c: Column, scale: int = 64, offset: int = 1_000_000) -> Column:
    """floor(scale * entry) + offset of each entry; null if the vector or an entry is null or not finite."""
    wide = F.transform(c, lambda e: e.cast("double"))
    whole = F.forall(wide, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    return F.when(c.isNotNull() & whole, F.transform(wide, lambda e: F.floor(e * scale) + F.lit(offset).cast("bigint")))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size)


def spectrum(vectors: DataFrame, size: int) -> Spectrum:
    """The spectrum of all rows of `vectors` (one column of `size` whole numbers each).

    Each partition builds its own from rank-one updates; partitions are combined `_FAN` at a time,
    level by level, so that a task holds a few matrices of size x size and the driver one.
    """
    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        own = Spectrum(size)
        for batch in batches:
            x = _matrix(batch.column(0), size)
            for at in range(0, len(x), _BLOCK):
                own.add_rows(x[at:at + _BLOCK])
        if own.n:
            yield own.row(TaskContext.get().partitionId())

    def combine(rows: pa.Table) -> pa.Table:
        own = Spectrum(size)
        for r in rows.sort_by("part").to_pylist():
            own.add_spectrum(r["n"], np.array([int(s) for s in r["sums"]], object),
                             np.array(r["eigenvalues"]), np.array(r["vectors"]).reshape(size, size))
        return pa.Table.from_batches([own.row(rows["part"][0].as_py() // _FAN)])

    parts = written_table(vectors.mapInArrow(build, _SPECTRUM), "llm-white-spectra")
    left = (parts.agg(F.max("part")).first()[0] or 0) + 1
    while left > 1:
        parts = parts.groupBy(F.floor(F.col("part") / _FAN).alias("_g")).applyInArrow(combine, _SPECTRUM)
        left = -(-left // _FAN)
    found, row = Spectrum(size), parts.first()
    if row is not None:
        found.n, found.sums = row["n"], np.array([int(s) for s in row["sums"]], object)
        found.values, found.vectors = np.array(row["eigenvalues"]), np.array(row["vectors"]).reshape(size, size)
    return found


def _centred(x: np.ndarray, n: int, sums: np.ndarray) -> np.ndarray:
    """x minus the mean: the whole part of the mean is taken off exactly."""
    whole = np.array([int(s) // n for s in sums], np.int64)
    rest = np.array([int(s) % n / n for s in sums])
    return (x - whole) - rest


def _moments(vectors: DataFrame, size: int, n: int, sums: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """Mean of y y' over all rows, y the centred row in `basis` (a matrix of columns)."""
    wide = basis.shape[1]

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((wide, wide))
        for batch in batches:
            y = _centred(_matrix(batch.column(0), size), n, sums) @ basis
            total += y.T @ y
        i, j = np.triu_indices(wide)
        yield pa.record_batch([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "v"])

    sums_of = vectors.mapInArrow(add, "i bigint, j bigint, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    out = np.zeros((wide, wide))
    for r in sums_of.collect():  # as many rows as the basis has pairs of columns
        out[r["i"], r["j"]] = out[r["j"], r["i"]] = r["v"] / n
    return out


def whiten(rows: DataFrame, vector: str = "embedding", components: int = 32, scale: int = 64,
           offset: int = 1_000_000) -> DataFrame:
    """Rows with a usable vector, and `n`, `deviation`, `whitened`, `explained`, `identity_error`.

    Entries become whole numbers floor(scale * entry) + offset. Components are the eigenvectors of
    their covariance V, by falling eigenvalue e. `whitened` has the centred vector's projections on
    the first `components` of them, each over the root of its e, and `explained` each e over the
    trace of V; `n` is the number of rows, `deviation` the exact sum over the dimensions of (n x - sum of x)^2 (a
    decimal), and `identity_error` the largest absolute entry of the whitened columns' covariance
    minus the identity, measured on all rows.

    1. A partition takes its rows in blocks. A block is centred, turned into a triangle with the
       same scatter if it has more rows than dimensions, and each row left updates the partition's
       eigendecomposition by a rank-one step (secular equation, with deflation); another step is
       for the distance of the means. Rows one by one would cost a cubic step each.
    2. Spectra are combined by successive rank-one updates, `_FAN` at a time.
    3. All rows are projected on the eigenvectors found; the small matrix of their second moments
       gives the exact eigenvectors in that basis (Rayleigh-Ritz). So rounding of the updates does
       not matter.

    A null vector, or one with null or non-finite entries, is left out, and so is one whose length
    is not the commonest (the longer of two equally common). Rows that repeat count each. Equal
    eigenvalues have any orthogonal vectors of their space, the same for all rows; components
    without variance (rounding aside) are left out. With one row, or none, there is none. Input
    columns called as the results are replaced.
    """
    out = ["n", "deviation", "whitened", "explained", "identity_error"]
    names = [c for c in rows.columns if c not in out]
    kinds = ["bigint", "decimal(38,0)", "array<double>", "array<double>", "double"]
    usable = rows.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"),
                         whole_numbers(F.col(f"`{vector}`"), scale, offset).alias("x")).filter("size(x) > 0")
    lengths = usable.groupBy(F.size("x").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    empty = usable.limit(0).select("row.*", *[F.lit(None).cast(k).alias(c) for c, k in zip(out, kinds)])
    if most is None:
        return empty
    size = most["size"]
    usable = usable.filter(F.size("x") == size)
    x = usable.select("x")
    found = spectrum(x, size)
    n, sums = found.n, found.sums
    # The refined basis: eigenvectors of the second moments in the basis of the updates.
    e, turn = np.linalg.eigh(_moments(x, size, n, sums, found.vectors))
    order = np.argsort(-e, kind="stable")
    e, basis = e[order], (found.vectors @ turn)[:, order]
    total = float(e.sum())
    shown = int((e[:components] > 1e-12 * max(total, 0.0)).sum()) if total > 0 else 0
    if not shown:
        return empty
    to_white = basis[:, :shown] / np.sqrt(e[:shown])
    error = float(np.abs(_moments(x, size, n, sums, to_white) - np.eye(shown)).max())
    explained = e[:shown] / total

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        exact = [int(s) for s in sums]
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                x = _matrix(part.column(1), size)
                white = _centred(x, n, sums) @ to_white
                # 64 bits where they hold the sum of squares, else Python's whole numbers.
                bound = max(abs(int(x.max()) * n - min(exact)), abs(max(exact) - int(x.min()) * n))
                if bound * bound * size < 1 << 62 and max(map(abs, exact)) < 1 << 62 and int(np.abs(x).max()) * n < 1 << 62:
                    apart = x * n - np.array(exact, np.int64)
                    deviation = pa.array((apart * apart).sum(1)).cast(pa.decimal128(38, 0))
                else:
                    deviation = pa.array([sum((int(v) * n - s) ** 2 for v, s in zip(r, exact)) for r in x], pa.decimal128(38, 0))
                m = part.num_rows
                offsets = pa.array(np.arange(0, (m + 1) * shown, shown, dtype=np.int32))
                yield pa.record_batch([
                    part.column(0), pa.array(np.full(m, n)), deviation, pa.ListArray.from_arrays(offsets, pa.array(white.ravel())),
                    pa.ListArray.from_arrays(offsets, pa.array(np.tile(explained, m))), pa.array(np.full(m, error))],
                    names=["row", *out])

    fields = ", ".join(f"{c} {k}" for c, k in zip(out, kinds))
    done = usable.mapInArrow(project, f"row {usable.schema['row'].dataType.simpleString()}, {fields}")
    return done.select("row.*", *out)
