"""Whitening of embeddings by an incremental eigendecomposition of their covariance.

Each partition keeps the mean and the spectrum (eigenvalues, eigenvectors) of the scatter matrix of the vectors it has seen. A new vector is a centred rank-one
update: components that the vector does not touch, and all but one of equal eigenvalues, are deflated; the others' new eigenvalues are the roots of the secular
equation. Partitions' spectra are combined in a tree, the second's eigenvectors and the shift of the means entering the first one by one as rank-one updates.
The result is the basis of a Rayleigh-Ritz step: the covariance, centred before multiplying, is gathered in that basis from all vectors, and its small
symmetric eigenproblem gives the components to double precision.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged

EPS = np.finfo(np.float64).eps
#: A component whose eigenvalue is below this share of the trace has no variance.
NO_VARIANCE = 1e-13


@np.errstate(all="ignore")  # a step that is no number is replaced by a halving
def secular_roots(d: np.ndarray, z2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Roots of 1 + sum(z2 / (d - x)) = 0 for rising d and positive z2, one between neighbours of d and one above: (index of the nearer pole, root minus that pole).

    All roots are found at once: a rational step that fits both neighbouring poles (Li's middle way), kept inside a bracket by halving it.
    """
    m = d.size
    poles = np.append(d, d[-1] + z2.sum())
    gap = poles[1:] - poles[:-1]
    mid = d + gap / 2
    above = 1 + (z2 / (d[None, :] - mid[:, None])).sum(axis=1) < 0  # the root lies in the upper half
    near = np.arange(m) + (above & (np.arange(m) < m - 1))
    delta = d[None, :] - d[near][:, None]
    low = np.where(near > np.arange(m), -gap / 2, np.where(above, gap / 2, 0.0))
    high = np.where(near > np.arange(m), 0.0, np.where(above, gap, gap / 2))
    x = (low + high) / 2
    left, right = d - d[near], poles[1:] - d[near]
    lower = (np.arange(m)[None, :] <= np.arange(m)[:, None]).astype(float)
    on = np.arange(m)  # roots still sought; the arrays below hold these only
    for _ in range(80):
        at = x[on]
        pull = 1 / (delta - at[:, None])
        f = 1 + pull @ z2
        size = f - 2 * ((pull * lower) @ z2)  # the same sum of absolute values
        low, high = np.where(f < 0, at, low), np.where(f > 0, at, high)
        open_ = (np.abs(f) > 16 * EPS * size) & (high - low > 2 * EPS * np.abs(at))
        if not open_.any():
            break
        pull *= pull
        both = pull @ z2
        psi = (pull * lower) @ z2
        a1, a2 = left - at, right - at
        c = f - a1 * psi - a2 * (both - psi)
        a = (a1 + a2) * f - a1 * a2 * both
        b = a1 * a2 * f
        root = np.sqrt(np.maximum(a * a - 4 * b * c, 0))
        new = at + np.where(a <= 0, (a - root) / (2 * c), 2 * b / (a + root))
        new = np.where((new > low) & (new < high), new, (low + high) / 2)
        x[on] = np.where(open_, new, at)
        if 2 * np.count_nonzero(open_) < on.size:
            on, low, high, left, right, delta, lower = (y[open_] for y in (on, low, high, left, right, delta, lower))
    return near, x


class Spectrum:
    """Count, sums (exact), mean and the spectrum of the scatter about the mean."""

    def __init__(self, size: int):
        self.n, self.sums, self.mean = 0, np.zeros(size, dtype=object), np.zeros(size)
        self.values, self.basis = np.zeros(size), np.eye(size)

    def rank_one(self, v: np.ndarray) -> None:
        """The spectrum of the scatter plus v v'."""
        z = v @ self.basis
        norm = np.abs(z).max(initial=0.0)
        if norm == 0:
            return
        d, basis = self.values, self.basis
        top = max(abs(d[-1]), float(z @ z))
        # of equal eigenvalues a reflection leaves one component: the others are deflated
        edges = np.flatnonzero(np.diff(d) > 8 * EPS * top) + 1
        if edges.size + 1 < d.size:
            for at, to in zip([0, *edges.tolist()], [*edges.tolist(), d.size], strict=True):
                if to - at > 1 and np.abs(z[at : to - 1]).max() > 0:
                    w = z[at:to].copy()
                    length = np.linalg.norm(w)
                    w[-1] += np.copysign(length, w[-1])
                    w /= np.linalg.norm(w)
                    block = basis[:, at:to]
                    basis[:, at:to] = block - 2 * np.outer(block @ w, w)
                    last = -np.copysign(length, z[to - 1])
                    z[at:to] = 0
                    z[to - 1] = last
        active = np.flatnonzero(np.abs(z) * np.sqrt(z @ z) > 8 * EPS * top)
        if not active.size:
            return
        dk, zk = d[active], z[active]
        near, mu = secular_roots(dk, zk * zk)
        # root j minus pole i, without cancellation; then the weights of which the roots are exact
        diff = (dk[near][None, :] - dk[:, None]) + mu[None, :]
        poles = dk[None, :] - dk[:, None]
        np.fill_diagonal(poles, 1.0)
        weight = np.sqrt(np.abs(np.prod(diff / poles, axis=1)))
        turn = np.copysign(weight, zk)[:, None] / diff
        turn /= np.linalg.norm(turn, axis=0)
        basis[:, active] = basis[:, active] @ turn
        d[active] = dk[near] + mu
        order = np.argsort(d, kind="stable")
        self.values, self.basis = d[order], basis[:, order]

    def add(self, x: np.ndarray) -> None:
        shift = x - self.mean
        self.rank_one(shift * np.sqrt(self.n / (self.n + 1)))
        self.n += 1
        self.mean += shift / self.n

    def merge(self, other: Spectrum) -> None:
        if not other.n:
            return
        for value, vector in zip(other.values, other.basis.T, strict=True):
            if value > 0:
                self.rank_one(vector * np.sqrt(value))
        total = self.n + other.n
        shift = other.mean - self.mean
        self.rank_one(shift * np.sqrt(self.n * other.n / total))
        self.mean += shift * (other.n / total)
        self.n, self.sums = total, self.sums + other.sums

    def row(self) -> list[float | int | str]:
        # the exact sums travel as text: they may pass 64 bits
        return [self.n, [str(s) for s in self.sums], self.mean.tolist(), self.values.tolist(), self.basis.reshape(-1).tolist()]

    @classmethod
    def of(cls, n, sums, mean, values, basis) -> Spectrum:
        out = cls(len(mean))
        out.n, out.sums = n, np.array([int(s) for s in sums], dtype=object)
        out.mean, out.values, out.basis = np.array(mean), np.array(values), np.array(basis).reshape(len(mean), -1)
        return out


SPECTRUM = "part long, n long, sums array<string>, mean array<double>, spectrum array<double>, basis array<double>"
SPECTRUM_ARROW = pa.schema([("part", pa.int64()), ("n", pa.int64()), ("sums", pa.list_(pa.string())), *[(c, pa.list_(pa.float64())) for c in ("mean", "spectrum", "basis")]])
MATRIX = "part long, m array<double>"
MATRIX_ARROW = pa.schema([("part", pa.int64()), ("m", pa.list_(pa.float64()))])


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, size) of a list column of equal lengths without nulls."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def each_part(vectors: DataFrame, start: Callable, step: Callable, end: Callable, schema: str, arrow: pa.Schema) -> DataFrame:
    """One row per partition that has vectors: end(state) after step(state, rows) for its batches."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = None
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                x = matrix(b.slice(at, 4096).column(0))
                state = start(x.shape[1]) if state is None else state
                state = step(state, x)
        if state is not None:
            yield pa.RecordBatch.from_pylist([dict(zip(arrow.names, [TaskContext.get().partitionId(), *end(state)], strict=True))], schema=arrow)

    return vectors.mapInArrow(run, schema)


def combined(parts: DataFrame, merge: Callable[[list[list]], list], name: str, schema: str, fan: int = 8) -> list | None:
    """The one row left when rows are merged `fan` at a time, level by level; None without rows. The driver sees that row alone."""
    columns = [c.split()[0] for c in schema.split(", ")]

    def together(key, frame):
        import pandas as pd

        rows = frame.sort_values("part")[columns[1:]].values.tolist()
        return pd.DataFrame([[key[0], *merge(rows)]], columns=columns)

    parts = staged(parts, name)
    while (most := parts.agg(F.max("part")).first()[0]) is not None and most > 0:
        grouped = parts.withColumn("up", F.floor(F.col("part") / fan)).groupBy("up")
        parts = staged(grouped.applyInPandas(together, schema), name)
    row = parts.first()
    return list(row)[1:] if row else None


def merge_spectra(rows: list[list]) -> list:
    out = Spectrum.of(*rows[0])
    for r in rows[1:]:
        out.merge(Spectrum.of(*r))
    return out.row()


def merge_sums(rows: list[list]) -> list:
    return [np.sum([np.asarray(r[0]) for r in rows], axis=0).tolist()]


def grid_vectors(rows: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(id, x) of the rows whose vector is not null and holds no null or non-finite entry: x = floor(scale * entry) as longs."""
    v = F.transform(F.col(vector_col), lambda c: c.cast("double"))
    whole = F.col(vector_col).isNotNull() & F.forall(v, lambda c: F.coalesce((c - c) == 0, F.lit(False)) & ~F.isnan(c))
    rows = rows.select(F.col(id_col).alias("id"), F.when(whole, v).alias("v")).filter("v is not null and size(v) > 0")
    return rows.select("id", F.transform("v", lambda c: F.floor(c * scale).cast("long")).alias("x"))


def fit_spectrum(fit: DataFrame) -> Spectrum | None:
    """Spectrum of the vectors x of fit, by rank-one updates in each partition and a tree of merges."""

    def step(s: Spectrum, x: np.ndarray) -> Spectrum:
        s.sums = s.sums + x.sum(axis=0).astype(object)
        for row in x.astype(np.float64):
            s.add(row)
        return s

    row = combined(each_part(fit, Spectrum, step, Spectrum.row, SPECTRUM, SPECTRUM_ARROW), merge_spectra, "spectra", SPECTRUM)
    return Spectrum.of(*row) if row else None


def covariance(fit: DataFrame, mean: np.ndarray, basis: np.ndarray, n: int) -> np.ndarray:
    """Covariance (divisor n) of the vectors of fit, centred first and then projected on the basis."""
    held = fit.sparkSession.sparkContext.broadcast((mean, basis))

    def step(s: np.ndarray, x: np.ndarray) -> np.ndarray:
        y = (x - held.value[0]) @ held.value[1]
        return s + y.T @ y

    size = basis.shape[1]
    parts = each_part(fit, lambda _: np.zeros((size, size)), step, lambda s: [s.reshape(-1).tolist()], MATRIX, MATRIX_ARROW)
    return np.array(combined(parts, merge_sums, "covariance", MATRIX)[0]).reshape(size, size) / n


OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def whiten(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, components: int = 4) -> DataFrame:
    """For each row with a usable vector and each component up to `components`: id_col, component, n, deviation, whitened, explained, identity_error.

    Vectors become whole numbers x = floor(scale * entry); every distinct x counts once in mean and covariance (n of them). deviation is the exact sum over
    dimensions of (n x - sums)^2, null where it passes 64 bits; whitened the centred x on the component over the root of its eigenvalue; explained the
    eigenvalue's share of the trace; identity_error the largest entry of |covariance of whitened - identity| over components with variance. A component without
    variance has whitened 0 and explained 0. Rows whose vector is null, empty or holds null or non-finite entries are dropped, and so are those of another length
    than most rows have (of equally common lengths the larger stays). There are no more components than dimensions. Repeated rows stay;
    other columns are not read. No usable row gives no rows.

    Held at once: one spectrum (dimensions squared) per task, a few on the driver.
    """
    spark = rows.sparkSession
    kind = rows.schema[id_col].dataType.simpleString()
    grid = grid_vectors(rows, id_col, vector_col, scale)
    size = grid.groupBy(F.size("x").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    if size is None:
        return spark.createDataFrame([], f"{id_col} {kind}, {OUT}")
    grid = grid.filter(F.size("x") == size[0])
    fit = staged(grid.select("x").distinct(), "fit-vectors")
    spectrum = fit_spectrum(fit)
    n, sums = spectrum.n, spectrum.sums
    mean = np.array([float(s) / n for s in sums])
    # Rayleigh-Ritz in the combined basis, made orthogonal again
    basis = np.linalg.qr(spectrum.basis)[0]
    small = covariance(fit, mean, basis, n)
    values, turn = np.linalg.eigh((small + small.T) / 2)
    trace = float(np.trace(small))
    values, vectors = values[::-1][:components], (basis @ turn)[:, ::-1][:, :components]
    some = values > NO_VARIANCE * trace if trace > 0 else np.zeros(values.size, bool)
    scaled = np.where(some, vectors / np.sqrt(np.where(some, values, 1.0)), 0.0)
    got = covariance(fit, mean, scaled, n)
    error = float(np.abs(got - np.diag(some.astype(float))).max(initial=0.0))
    explained = np.where(some, values / trace if trace > 0 else 0.0, 0.0)
    held = spark.sparkContext.broadcast((n, [int(s) for s in sums], mean, scaled, explained))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, mean, scaled, explained = held.value
        k = explained.size
        total = np.array(sums, dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = matrix(part.column(1))
                far = (np.abs(x).max(initial=0) * float(n) + max(map(abs, sums))) ** 2 * x.shape[1]
                if far < 2.0**62:
                    off = n * x - total.astype(np.int64)
                    deviation = pa.array((off * off).sum(axis=1), pa.int64())
                else:
                    exact = ((x.astype(object) * n - total) ** 2).sum(axis=1)
                    deviation = pa.array([v if v < 2**63 else None for v in exact], pa.int64())
                each = np.repeat(np.arange(part.num_rows), k)
                columns = [
                    part.column(0).take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows)), pa.array(np.full(each.size, n)), deviation.take(pa.array(each)),
                    pa.array(((x - mean) @ scaled).reshape(-1)), pa.array(np.tile(explained, part.num_rows)), pa.array(np.full(each.size, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=[id_col, *[c.split()[0] for c in OUT.split(", ")]])

    return grid.mapInArrow(run, f"{id_col} {kind}, {OUT}")
