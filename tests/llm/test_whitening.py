"""Rank-one updates, merges and the whitened result against numpy's eigenvalues of the whole covariance."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import whitening
from tidelog.llm.whitening import Spectrum


def scatter(x):
    y = x - x.mean(axis=0)
    return y.T @ y


def close(s, x):
    c = scatter(x)
    assert np.abs(s.basis.T @ s.basis - np.eye(x.shape[1])).max() < 1e-12
    assert np.abs(s.basis @ np.diag(s.values) @ s.basis.T - c).max() <= 1e-12 * max(1.0, np.abs(c).max())
    assert (np.diff(s.values) >= 0).all()


@pytest.mark.parametrize("size", [1, 2, 3, 17])
def test_updates_and_merges(size):
    rng = np.random.default_rng(size)
    x = np.floor(rng.standard_normal((90, size)) * 40 * np.linspace(0.1, 1, size))
    x[10:20], x[20:30], x[40] = x[9], 0, x[39] * 2  # repeats, zeros, parallel vectors: deflation
    x[50:60, : size // 2] = 7
    parts = []
    for at in range(0, 90, 30):
        s = Spectrum(size)
        for v in x[at : at + 30]:
            s.add(v)
        close(s, x[at : at + 30])
        s.sums = x[at : at + 30].sum(axis=0).astype(int).astype(object)
        parts.append(s.row())
    s = Spectrum.of(*whitening.merge_spectra(parts))
    close(s, x)
    assert s.n == 90 and list(s.sums) == x.sum(axis=0).astype(int).tolist() and np.allclose(s.mean, x.mean(axis=0), atol=1e-12)


def test_secular_roots_against_eigenvalues():
    rng = np.random.default_rng(3)
    for m in (1, 2, 9, 40):
        d = np.sort(rng.standard_normal(m)) * 10.0 ** rng.integers(-3, 4, m).cumsum().clip(-3, 3)
        d.sort()
        z = rng.standard_normal(m) * 10.0 ** rng.integers(-4, 2, m)
        near, mu = whitening.secular_roots(d, z * z)
        want = np.linalg.eigvalsh(np.diag(d) + np.outer(z, z))
        assert np.allclose(d[near] + mu, want, rtol=1e-11, atol=1e-11 * np.abs(want).max())


def expected(rows, k=4):
    """rows: (id, vector) -> {id: (deviation, |whitened|)}, explained, by a whole eigendecomposition."""
    kept = [(i, np.array([math.floor(256 * float(c)) for c in v], dtype=object)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    y = np.array(fit, float) - np.array([s / n for s in sums])
    cov = y.T @ y / n
    w, u = np.linalg.eigh(cov)
    w, u = w[::-1][:k], u[:, ::-1][:, :k]
    out = [(i, sum((n * a - s) ** 2 for a, s in zip(x, sums)), np.abs((x.astype(float) - np.array([s / n for s in sums])) @ u / np.sqrt(w))) for i, x in kept]
    return n, out, w / np.trace(cov)


def test_whole_table(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = whitening.whiten(docs.repartition(5)).orderBy("vec_id", "component").collect()
    n, want, explained = expected([(r["vec_id"], r["embedding"]) for r in docs.collect()])
    want.sort(key=lambda r: r[0])
    assert len(got) == 4 * len(want) and {r["n"] for r in got} == {n}
    assert [r["deviation"] for r in got] == [w[1] for w in want for _ in range(4)]
    assert np.allclose([abs(r["whitened"]) for r in got], [v for w in want for v in w[2]], atol=1e-9)
    assert np.allclose([r["explained"] for r in got[:4]], explained, rtol=1e-10)
    assert got[0]["identity_error"] < 1e-9
    x = np.array([r["whitened"] for r in got]).reshape(-1, 4)  # one sign for all rows of a component
    assert np.abs(np.cov(x.T, bias=True) - np.eye(4)).max() < 0.05


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5, -0.25, 1.0]), (1, [0.5, -0.25, 1.0]), (2, [0.501, -0.25, 1.0]), (3, None), (4, [0.1, None, 0.2]), (5, [nan, 0.0, 0.0]), (6, [inf, 0.0, 0.0]), (7, []),
            (8, [0.1, 0.2]), (9, [0.0, 0.0, 0.0]), (None, [-1.0, 2.0, 0.0]), (10, [3.0, -1e-9, -0.0])]
    table = spark.createDataFrame([(*r, "x", "y") for r in rows], "vec_id long, embedding array<float>, x string, component string")
    got = whitening.whiten(table).collect()
    usable = [(i, [float(np.float32(c)) for c in v]) for i, v in rows if v and len(v) == 3 and None not in v and np.isfinite(v).all()]
    n, want, _ = expected(usable, 3)
    assert len(got) == 3 * len(want) and got[0]["n"] == n  # three components of three dimensions; two equal x count once
    key = lambda i, c, d, w: (str(i), c, d, round(w, 8) + 0.0)
    assert sorted(key(r["vec_id"], r["component"], r["deviation"], abs(r["whitened"])) for r in got) == sorted(key(i, c + 1, d, w[c]) for i, d, w in want for c in range(3))
    assert whitening.whiten(table.filter("vec_id = 3")).count() == 0 and whitening.whiten(table.filter("false")).columns == whitening.whiten(table).columns


def test_no_variance_and_large_entries(spark):
    one = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = whitening.whiten(one).collect()
    assert len(got) == 4 and {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in got} == {(1, 0, 0.0, 0.0, 0.0)}
    line = spark.range(50).select(F.col("id").alias("vec_id"), F.array(F.col("id").cast("double"), F.lit(3.0), -F.col("id").cast("double")).alias("embedding"))
    got = whitening.whiten(line).filter("component > 1").agg(F.max(F.abs("whitened"))).first()[0]
    assert got == 0.0
    large = spark.createDataFrame([(1, [1e13, 0.0]), (2, [-1e13, 1.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert {r["deviation"] for r in whitening.whiten(large).filter("vec_id < 3").collect()} == {None}
