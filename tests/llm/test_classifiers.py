import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidelog.llm import quality, toxicity
from tidelog.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.1"
larger = pytest.mark.skipif(not os.path.isdir(LARGER), reason="needs the larger tables")


def auc(score, y):
    order = np.argsort(score)
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    n1 = y.sum()
    return (rank[y == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(y) - n1))


@larger
def test_toxicity_on_held_out_rows(spark):
    rows = QUERIES["op2_convolution_toxicity"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y = rows["toxic"].iloc[:, 1].to_numpy() if rows["toxic"].ndim > 1 else rows["toxic"].to_numpy()
    assert rows["score"].between(0, 1).all() and ((rows["score"] >= 0.3) == (rows["predicted"] == 1)).all()
    assert auc(rows["score"].to_numpy(), y) > 0.95
    hit = (rows["predicted"] == 1).to_numpy()
    assert (hit & (y == 1)).sum() / hit.sum() > 0.85 and (hit & (y == 1)).sum() / y.sum() > 0.8


@larger
def test_quality_on_held_out_rows(spark):
    rows = QUERIES["op4_hierarchical_quality"](spark, LARGER).join(spark.read.parquet(f"{LARGER}/labels.parquet"), "doc_id").filter("held_out").toPandas()
    y = rows["quality"].to_numpy()
    assert auc(rows["score"].to_numpy(), y) > 0.95
    assert rows["keep"][y == 1].mean() > 0.98 and rows["keep"][y == 0].mean() < 0.3


def test_net_gradient_and_pieces():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 2**63, n, dtype=np.uint64) for n in (0, 1, 2, 3, 50, 333)]
    net = toxicity.new_net(docs, np.array([0, 1, 0, 1, 0, 1]), 8, 4, rng)
    whole = net.pooled(docs)
    assert np.allclose(whole, net.pooled(docs, most=7), atol=1e-5)
    for d, h in enumerate(docs):
        rows = np.concatenate((toxicity.table_rows(h) if h.size else np.full((2, 1), toxicity.ROWS), np.full((2, 2), toxicity.ROWS)), axis=1)
        x = net.table[rows[0]] + net.table[rows[1]]
        want = [max(float(sum(x[i + j] @ w[j][:, f] for j in range(w.shape[0]))) for i in range(max(1, h.size))) for w in net.filters for f in range(4)]
        assert np.allclose(whole[d], want, atol=1e-4)


def test_sites_shrink_to_their_parents(spark):
    rows = [("big", "a", i % 10 < 9) for i in range(400)] + [("big", "b", i % 10 < 3) for i in range(400)] + [("few", "a", 0)] + [("mid", "a", i % 2) for i in range(40)]
    rates, rate = quality.site_rates(spark.createDataFrame([(h, p, int(y)) for h, p, y in rows], "host string, path string, y int"))
    got = {(r.host, r.path): (r.host_rate, r.path_rate) for r in rates.collect()}
    assert abs(got["big", "a"][1] - 0.9) < 0.03 and abs(got["big", "b"][1] - 0.3) < 0.03
    assert 0.2 < got["few", "a"][1] < rate and got["few", "a"][1] <= got["few", "a"][0]
    even, rate = quality.site_rates(spark.createDataFrame([(f"h{i % 7}", "p", i % 2) for i in range(7000)], "host string, path string, y int"))
    assert all(abs(r.path_rate - rate) < 1e-3 for r in even.collect())


def test_site_of_a_source(spark):
    rows = [("www.a.org/news/x.html", "en"), ("a.org", "fr"), ("a.org/", "fr"), (None, None), ("", "de")]
    df = spark.createDataFrame(rows, "source string, lang string")
    got = [tuple(r) for r in df.select(*quality.site(F.col("source"), F.col("lang"))).collect()]
    assert got == [("www.a.org", "news"), ("a.org", "fr"), ("a.org", ""), ("", ""), ("", "de")]


def test_odd_rows_and_labels(spark, sf_dir, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, 1), (3, 0, 0), (4, 1, 1), (6, 0, 0), (7, 1, 0), (None, 1, 1), (5, None, None), (99, 1, 1)], "doc_id long, quality int, toxic int")
    for lab in (labels, labels.filter("false"), labels.filter("doc_id = 3")):
        model = toxicity.fit(odd_docs, lab)
        out = toxicity.with_scores(odd_docs.drop("score"), model)
        assert out.count() == odd_docs.count() and out.filter("score is null or not score between 0 and 1").count() == 0
        kept = toxicity.without_toxic(odd_docs, lab)
        assert kept.columns == odd_docs.columns
        judged = quality.assess(odd_docs, lab)
        assert judged.count() == odd_docs.count() and judged.filter("__keep is null or __score is null").count() == 0
        assert quality.without_poor(odd_docs, lab).columns == odd_docs.columns
        assert toxicity.without_toxic(no_docs, lab).collect() == [] and quality.without_poor(no_docs, lab).collect() == []
    assert toxicity.without_toxic(odd_docs, labels.filter("false")).count() == odd_docs.count()
    assert quality.without_poor(odd_docs, labels.filter("false")).count() == odd_docs.count()


def test_thresholds_come_from_all_labelled_rows_not_fitted_on(spark, monkeypatch):
    rng, rows = np.random.default_rng(8), []
    for i in range(3000):
        y, lang = int(i % 3 == 0), "rare" if i % 10 == 9 else "en"
        words = [f"w{rng.integers(400)}" for _ in range(12)] + [f"bad{rng.integers(30)}" if rng.random() < (0.8 if y else 0.15) else f"good{rng.integers(30)}" for _ in range(6)]
        rows.append((i, " ".join(words), lang, y))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, y int")
    seen, calibrated = [], toxicity.calibrated
    monkeypatch.setattr(toxicity, "calibrated", lambda net, bin, y, c, lang, share: seen.append((y, c, lang)) or calibrated(net, bin, y, c, lang, share))
    model = toxicity.fit(df, df.select("doc_id", F.col("y").alias("toxic")), positives=100, negatives=200)
    y, c, lang = seen[0]
    assert c.sum() == 3000 - 240 and c[y == 1].sum() == 1000 - 80 and c[lang == "rare"].sum() > 200
    assert set(model.by_language) == {"en", "rare"} and 0 < model.threshold < 1
    out = toxicity.with_scores(df, model).toPandas()
    hit = (out["score"] >= out["threshold"]).to_numpy()
    assert (hit == (out["y"] == 1)).mean() > 0.85 and abs(out["score"].mean() - 1 / 3) < 0.05


def test_quality_equals_plain_python(spark, sf_dir, monkeypatch):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    models, train = [], quality.train
    monkeypatch.setattr(quality, "train", lambda x, y, *a, **k: models.append((train(x, y, *a, **k), len(y))) or models[-1][0])
    got = {r.doc_id: r for r in quality.assess(docs, labels, sample_rows=40).collect()}
    rows = {r.doc_id: r for r in docs.collect()}
    y = {r.doc_id: r.quality for r in labels.collect() if r.quality is not None and r.doc_id in rows}
    assert models[0][1] == 40
    where = {i: ((r.source or "").split("/")[0], r.lang or "") for i, r in rows.items()}
    rate = (sum(y.values()) + 0.5) / (len(y) + 1)

    def grouped(key):
        out = {}
        for i, v in y.items():
            n, s = out.get(key(i), (0, 0))
            out[key(i)] = (n + 1, s + v)
        return out

    def strength(groups, parent):
        q = sum(n * (s / n - parent(k)) ** 2 for k, (n, s) in groups.items())
        e = sum(parent(k) * (1 - parent(k)) for k in groups)
        between = max(0.0, q - e) / max(1.0, sum(n for n, _ in groups.values()) - len(groups))
        return min(max(rate * (1 - rate) / between - 1, 2.0), 1e6) if between > 0 else 1e6

    hosts = grouped(lambda i: where[i][0])
    k = strength(hosts, lambda h: rate)
    host_rate = {h: (s + k * rate) / (n + k) for h, (n, s) in hosts.items()}
    paths = grouped(lambda i: where[i])
    k = strength(paths, lambda p: host_rate[p[0]])
    path_rate = {p: (s + k * host_rate[p[0]]) / (n + k) for p, (n, s) in paths.items()}
    odds = lambda p: np.log(p / (1 - p))
    logit = {i: models[0][0].logits(np.array([quality.statistics((r.text or "").encode())]))[0] + odds(path_rate.get(where[i], host_rate.get(where[i][0], rate))) - odds(rate) for i, r in rows.items()}
    for i, r in got.items():
        assert r["__score"] == pytest.approx(1 / (1 + np.exp(-logit[i])), abs=1e-9)
    # the threshold: no bin of log odds lower than it holds more than the allowed share of the good documents that were not fitted on
    fitted = {r.doc_id for r in labels.filter("quality in (0, 1)").join(docs, "doc_id").select("doc_id", F.xxhash64("doc_id").alias("h")).distinct().filter("pmod(h, 5) > 0").orderBy("h").limit(40).collect()}
    left = sorted(np.floor(np.clip(logit[i], -40, 40) * quality.BINS) for i, v in y.items() if v == 1 and i not in fitted)
    edge = max(b for b in left if sum(x < b for x in left) <= 0.005 * len(left)) / quality.BINS
    cut = min(0.5, 1 / (1 + np.exp(-edge)))
    assert {i for i, r in got.items() if r["__keep"]} == {i for i in rows if 1 / (1 + np.exp(-logit[i])) >= cut}
