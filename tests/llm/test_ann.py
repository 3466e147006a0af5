import os

import numpy as np
import pytest

from tidelog.llm import ann
from tidelog.llm.queries import QUERIES


def plain(rows, pick, k):
    """query -> ids and scores of its k nearest, ties to smaller ids."""
    ids = np.array([i for i, _ in rows])
    x = np.array([v for _, v in rows], dtype=np.float64)
    out = {}
    for i, v in zip(ids, x):
        if pick(i):
            s = (x * v).sum(axis=1)
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out[int(i)] = [(int(ids[j]), float(s[j])) for j in order]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({i for i, _ in got.get(q, [])} & {i for i, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


def test_query_is_exact_on_few_vectors(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op6_learned_partitions"](spark, sf_dir)), plain(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys()
    for q in want:
        assert [i for i, _ in got[q]] == [i for i, _ in want[q]]
        assert np.allclose([s for _, s in got[q]], [s for _, s in want[q]], atol=1e-14)


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.1"), reason="needs the larger tables")
def test_recall_over_parts_and_blocks(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = found(ann.search(df, lambda v: v % 20 == 0, part_rows=200, block_rows=64, block_queries=16))
    want = plain(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values())
    assert recall(got, want) >= 0.9


def test_copies_ties_and_unusable_vectors(spark):
    rng = np.random.default_rng(2)
    base = rng.standard_normal((300, 6))
    rows = [(i, base[i].tolist()) for i in range(300)] + [(1000 + i, base[0].tolist()) for i in range(400)]
    odd = [(2000, None), (2020, [0.0] * 6), (2040, [float("nan")] + [1.0] * 5), (2060, [float("inf")] + [1.0] * 5), (2080, [None] + [1.0] * 5), (2100, [1.0, 2.0]), (None, [1.0] * 6), (20, base[20].tolist()), (2120, [])]
    df = spark.createDataFrame([(*r, 1, 2.0) for r in rows + odd], "vec_id long, embedding array<double>, part int, score double")
    got = found(ann.search(df, lambda v: v % 20 == 0, part_rows=60, block_rows=50, block_queries=7))
    want = plain(rows, lambda i: i % 20 == 0, 20)
    assert got.keys() == want.keys() and recall(got, want) >= 0.9
    assert [i for i, _ in got[1000]] == [i for i, _ in want[1000]]
    few = found(ann.search(df.filter("vec_id < 5"), lambda v: v == 0, k=20))
    assert [i for i, _ in few[0]] == [i for i, _ in plain(rows[:5], lambda i: i == 0, 20)[0]]
    assert ann.search(df.filter("false"), lambda v: v % 20 == 0).collect() == []
    assert ann.search(df, lambda v: v < 0).collect() == []


def test_parts_are_balanced():
    rng = np.random.default_rng(4)
    x = np.concatenate([rng.standard_normal((900, 8)) * 0.1 + 3, rng.standard_normal((300, 8))])
    graph = ann.top_rows(x, x, 5, np.arange(x.shape[0]))
    part = ann.balanced_parts(x, graph, 8, rng)
    assert np.bincount(part, minlength=8).max() <= 1.1 * 150 + 1 and np.bincount(part, minlength=8).min() > 0


@pytest.mark.parametrize("folder", ["sf0.001", "sf0.1"])
def test_query_uses_graph_parts_and_router_with_its_own_settings(spark, monkeypatch, folder):
    path = f"/root/testdata/{folder}"
    if not os.path.isdir(path):
        pytest.skip("needs the tables")
    made, fit = [], ann.fit
    monkeypatch.setattr(ann, "fit", lambda x, parts, *a: made.append((parts, fit(x, parts, *a))) or made[-1][1])
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{path}/embeddings.parquet").collect()]
    got, want = found(QUERIES["op6_learned_partitions"](spark, path)), plain(rows, lambda i: i % 20 == 0, 20)
    parts, router = made[0]
    print(f"{folder}: {len(rows)} vectors, {parts} parts, {router.visits} visits, recall {recall(got, want):.4f}")
    assert parts == ann.parts_of(len(rows)) > 10
    assert got.keys() == want.keys() and all(len(x) == 20 for x in got.values()) and recall(got, want) >= 0.9


def test_visits_come_from_vectors_that_the_router_was_not_fitted_on(monkeypatch):
    rng = np.random.default_rng(3)
    x, fitted, asked = rng.standard_normal((400, 8)), [], []
    train, scores = ann.train_router, ann.Router.scores
    monkeypatch.setattr(ann, "train_router", lambda v, *a: fitted.append(v) or train(v, *a))
    monkeypatch.setattr(ann.Router, "scores", lambda self, v: asked.append(v) or scores(self, v))
    ann.fit(x, 8)
    seen = {v.tobytes() for v in fitted[0]}
    assert asked and not any(v.tobytes() in seen for rows in asked for v in rows)


def test_rows_that_share_an_id(spark):
    rng = np.random.default_rng(6)
    rows = [(i // 2, [float(v) for v in rng.standard_normal(4)]) for i in range(40)]  # each id twice
    df = spark.createDataFrame([*rows, rows[0]], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df, lambda v: v == 0, k=5).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == {0} and len(got[0]) == 10  # two queries of the same id
    want = []
    for n, (i, v) in enumerate(rows[:2]):
        others = sorted(((-sum(a * b for a, b in zip(v, w)), j) for m, (j, w) in enumerate(rows) if m != n))[:5]
        want += [(k + 1, j, -s) for k, (s, j) in enumerate(others)]
    assert [(r, j, round(s, 9)) for r, j, s in sorted(got[0])] == [(r, j, round(s, 9)) for r, j, s in sorted(want)]
