"""Convolutional text classifier: hashed word embeddings, filters of several widths, max pooling, trained in numpy.

The net is fitted on a bounded sample of labelled documents; calibration and thresholds come from histograms of the scores of all other
labelled rows. Scoring runs over every whole text in the tasks. A word's embedding is the sum
of two rows of a fixed-size table, chosen by its hash, so two words are confused only if they share both. The first component starts
as the log odds of the word's rows between the classes, the others at random.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import hash_filter, id_hash, may_hold, set_apart, slices, staged, texts
from tidelog.llm.decontaminate import WordHashes

ROWS = 1 << 18
WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Bins of a histogram for one unit of the logit.
BINS = 32


def table_rows(h: np.ndarray) -> np.ndarray:
    """(2, n) table rows of word hashes."""
    return np.stack((h & np.uint64(ROWS - 1), (h >> np.uint64(24)) & np.uint64(ROWS - 1))).astype(np.int64)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Net:
    """Weights. table: one zero row more, for padding. filters: for each width, (width, dim, number)."""

    table: np.ndarray
    filters: list[np.ndarray]
    bias: np.ndarray
    out: np.ndarray
    shift: float = 0.0
    slope: float = 1.0
    offset: float = 0.0

    def convolve(self, rows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """Embeddings of padded rows and each width's responses at every start but the padding's last."""
        x = self.table[rows[0]] + self.table[rows[1]]
        n = x.shape[0] - PAD
        return x, [sum(x[j : n + j] @ w[j] for j in range(w.shape[0])) for w in self.filters]

    def pooled(self, docs: list[np.ndarray], most: int = 40_000) -> np.ndarray:
        """Largest response of each filter in each document; a long document goes in overlapping pieces."""
        out = np.full((len(docs), self.bias.size), -np.inf, np.float32)
        pending, held = [], 0

        def flush() -> None:
            if not pending:
                return
            size = np.array([r.shape[1] for _, r in pending])
            _, y = self.convolve(np.concatenate([r for _, r in pending], axis=1))
            begin = np.cumsum(size) - size
            # a piece's starts end where its padding begins
            cuts = np.stack((begin, begin + size - PAD), axis=1).reshape(-1)
            y = np.concatenate(y, axis=1)
            best = np.maximum.reduceat(np.concatenate((y, np.zeros((PAD + 1, y.shape[1]), y.dtype))), cuts, axis=0)[::2]
            np.maximum.at(out, np.array([d for d, _ in pending]), best)
            pending.clear()

        for d, h in enumerate(docs):
            rows = np.concatenate((table_rows(h) if h.size else np.full((2, 1), ROWS), np.full((2, PAD), ROWS)), axis=1)
            for at in range(0, rows.shape[1] - PAD, most):
                piece = rows[:, at : at + most + PAD]
                if held + piece.shape[1] > most:
                    flush()
                    held = 0
                pending.append((d, piece))
                held += piece.shape[1]
        flush()
        return out

    def logits(self, docs: list[np.ndarray]) -> np.ndarray:
        if not docs:
            return np.zeros(0)
        return np.maximum(self.pooled(docs) + self.bias, 0).astype(np.float64) @ self.out + self.shift

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return sigmoid(self.slope * self.logits(docs) + self.offset)


@dataclass
class Model:
    """net is None where the labels hold one class or none: every score is then `share`, the share of label 1."""

    net: Net | None
    share: float = 0.0
    threshold: float = 0.5
    by_language: dict[str, float] = field(default_factory=dict)

    def scores(self, docs: list[np.ndarray]) -> np.ndarray:
        return self.net.scores(docs) if self.net else np.full(len(docs), self.share)


def new_net(docs: list[np.ndarray], y: np.ndarray, dim: int, number: int, rng: np.random.Generator) -> Net:
    seen = np.zeros((2, ROWS), np.float64)
    for h, label in zip(docs, y):
        seen[int(label), np.unique(table_rows(h))] += 1
    n0, n1 = max(1, int((y == 0).sum())), max(1, int((y == 1).sum()))
    odds = np.log((seen[1] + 0.5) / (n1 + 1)) - np.log((seen[0] + 0.5) / (n0 + 1))
    table = (rng.standard_normal((ROWS + 1, dim)) * 0.02).astype(np.float32)
    table[:ROWS, 0] = np.where(seen.sum(0) > 0, 0.25 * odds / np.sqrt(1 / (seen[1] + 0.5) + 1 / (seen[0] + 0.5)), 0)
    table[ROWS] = 0
    filters = []
    for w in WIDTHS:
        f = rng.standard_normal((w, dim, number)) * 0.1
        f[:, 0, : number // 2] += 1.0 / w
        f[:, 0, number // 2 :] -= 0.5 / w
        filters.append(f.astype(np.float32))
    size = number * len(WIDTHS)
    return Net(table, filters, np.zeros(size, np.float32), np.concatenate([np.r_[np.full(number // 2, 0.3), np.full(number - number // 2, -0.1)] for _ in WIDTHS]).astype(np.float64))


def train(net: Net, docs: list[np.ndarray], y: np.ndarray, weight: np.ndarray, rng: np.random.Generator, epochs: int, batch: int = 32) -> None:
    """Gradient descent on weighted log loss: Adam for the weights, scaled steps for the table rows that a batch's maxima use."""
    dense = [*net.filters, net.bias, net.out]
    m, v, t = [np.zeros(a.shape) for a in dense], [np.zeros(a.shape) for a in dense], 0
    square = np.full(net.table.shape, 1e-4, np.float32)
    number = net.filters[0].shape[2]
    for epoch in range(epochs):
        rate = 0.01 * (1 - epoch / epochs) + 0.001
        for at in range(0, len(docs), batch):
            if at == 0:
                order = rng.permutation(len(docs))
            pick = order[at : at + batch]
            parts = [np.concatenate((table_rows(docs[i]) if docs[i].size else np.full((2, 1), ROWS), np.full((2, PAD), ROWS)), axis=1) for i in pick]
            rows = np.concatenate(parts, axis=1)
            x, responses = net.convolve(rows)
            ends = np.cumsum([p.shape[1] for p in parts])
            where = [np.stack([r[b - p.shape[1] : b - PAD].argmax(axis=0) + b - p.shape[1] for p, b in zip(parts, ends)]) for r in responses]
            pooled = np.concatenate([np.take_along_axis(r, a, 0) for r, a in zip(responses, where)], axis=1) + net.bias
            h = np.maximum(pooled, 0).astype(np.float64)
            g = (sigmoid(h @ net.out + net.shift) - y[pick]) * weight[pick] / pick.size
            dh = np.outer(g, net.out) * (pooled > 0)
            grads, dx_rows, dx = [], [], []
            for i, (w, a) in enumerate(zip(net.filters, where)):
                d = dh[:, i * number : (i + 1) * number]
                gw = np.zeros(w.shape)
                for j in range(w.shape[0]):
                    e = x[a + j]  # (documents, number, dim)
                    gw[j] = np.einsum("bn,bnd->dn", d, e)
                    dx_rows.append((a + j).reshape(-1))
                    dx.append((d[:, :, None] * w[j].T[None]).reshape(-1, w.shape[1]))
                grads.append(gw)
            grads += [dh.sum(axis=0), h.T @ g]
            t += 1
            for k, grad in enumerate(grads):
                m[k] = 0.9 * m[k] + 0.1 * grad
                v[k] = 0.99 * v[k] + 0.01 * grad * grad
                dense[k] -= (rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.99**t)) + 1e-8)).astype(dense[k].dtype)
            net.shift -= rate * float(g.sum()) * 10
            at_rows, step = rows[:, np.concatenate(dx_rows)].reshape(-1), np.tile(np.concatenate(dx), (2, 1))
            used, of = np.unique(at_rows, return_inverse=True)
            total = np.zeros((used.size, step.shape[1]))
            np.add.at(total, of, step)
            total[used == ROWS] = 0
            square[used] += total**2
            net.table[used] -= (0.05 * total / np.sqrt(square[used])).astype(np.float32)


def calibrate(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the weighted logistic fit of y on the logits, drawn a little towards slope 1."""
    a, b = 1.0, 0.0
    for _ in range(50):
        p = sigmoid(a * logits + b)
        s = weight * p * (1 - p)
        grad = np.array([(weight * (p - y) * logits).sum() + 1.0 * (a - 1), (weight * (p - y)).sum() + 0.1 * b])
        hess = np.array([[(s * logits**2).sum() + 1.0, (s * logits).sum()], [(s * logits).sum(), s.sum() + 0.1]])
        step = np.linalg.solve(hess, grad)
        a, b = a - float(np.clip(step[0], -1, 1)), b - float(np.clip(step[1], -2, 2))
    return max(a, 0.05), b


def best_threshold(score: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """Middle of the gap below the cut with the best weighted F1."""
    order = np.argsort(-score, kind="stable")
    s, w1, w = score[order], (weight * y)[order], weight[order]
    f1 = 2 * np.cumsum(w1) / (np.cumsum(w) + w1.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    at = int(f1.argmax())
    return float((s[at] + (s[at + 1] if at + 1 < s.size else 0.0)) / 2)


def signature(h: np.ndarray) -> bytes:
    """A text's 12 smallest word hashes; texts that share them count as copies."""
    return np.unique(h)[:12].tobytes()


def fit_net(docs: list[np.ndarray], y: np.ndarray, seed: int = 3, dim: int = 8, number: int = 8, epochs: int = 6) -> tuple[Net, set[bytes]]:
    """(net, signatures it was fitted on) from word hashes and labels of both classes. A fifth of each class is held out, if that leaves both in it."""
    y = y.astype(np.float64)
    # copies would count a document's chance words again: one document stands for those that share label and signature
    once = list({(label, signature(h)): i for i, (h, label) in reversed(list(enumerate(zip(docs, y))))}.values())[::-1]
    docs, y = [docs[i] for i in once], y[once]
    rng = np.random.default_rng(seed)
    held = np.zeros(y.size, bool)
    for label in (0, 1):
        rows = np.flatnonzero(y == label)
        held[rng.permutation(rows)[: rows.size // 5]] = True
    if not 0 < y[held].sum() < held.sum():
        held[:] = False  # too few rows to hold any out
    docs, y = [docs[i] for i in np.flatnonzero(~held)], y[~held]
    net = new_net(docs, y, dim, number, rng)
    balance = np.where(y == 1, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    train(net, docs, y, balance, rng, max(epochs, min(40, 12_000 // y.size)))
    return net, {signature(h) for h in docs}


def bins(logits: np.ndarray) -> np.ndarray:
    return np.rint(np.clip(logits, -40, 40) * BINS).astype(np.int32)


def calibrated(net: Net, bin: np.ndarray, target: np.ndarray, count: np.ndarray, languages: np.ndarray, share: float) -> Model:
    """Model of a net from a histogram: rows of a bin, label and language. share: label 1's share among all labelled rows, which the calibration restores.

    A language's threshold is its best cut, drawn in log odds towards the cut of all languages with the weight of 20 rows of label 1.
    """
    logits, target = bin / BINS, target.astype(np.float64)
    mean = (count * target).sum() / count.sum()
    weight = count * np.where(target == 1, share / mean, (1 - share) / (1 - mean))
    net.slope, net.offset = calibrate(logits, target, weight)
    score = sigmoid(net.slope * logits + net.offset)
    odds = lambda p: float(np.log(np.clip(p, 1e-6, 1 - 1e-6) / (1 - np.clip(p, 1e-6, 1 - 1e-6))))
    cut = best_threshold(score, target, weight)
    by_language = {}
    for lang in np.unique(languages):
        in_lang = languages == lang
        n = (count * target)[in_lang].sum()
        if lang and 0 < n < count[in_lang].sum():
            own_cut = best_threshold(score[in_lang], target[in_lang], weight[in_lang])
            by_language[str(lang)] = float(sigmoid(np.array((n * odds(own_cut) + 20 * odds(cut)) / (n + 20))))
    return Model(net, share, cut, by_language)


def histogram(docs: DataFrame, labels: DataFrame, net: Net, fitted: set[bytes]) -> DataFrame:
    """(lang, bin, y, c): rows of docs (doc_id, text, lang) with a label (doc_id, y), but for copies of fitted texts, by language and bin of their logit."""
    held = docs.sparkSession.sparkContext.broadcast((net, fitted, hash_filter(labels, "doc_id")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, (model, known, ids) = WordHashes(), held.value
        labelled = (b.filter(pa.array(may_hold(ids, b.column(3)))) for b in batches)  # others need no score
        for batch in slices(labelled, 256):
            h = hashes(texts(batch.column(1)))
            new = [i for i, x in enumerate(h) if signature(x) not in known]
            if new:
                at = pa.array(new, pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(2).take(at), pa.array(bins(model.logits([h[i] for i in new])), pa.int32())], names=["doc_id", "lang", "bin"])

    of = T.StructType([docs.schema["doc_id"], T.StructField("lang", T.StringType()), T.StructField("bin", T.IntegerType())])
    # texts do not travel: bins meet the labels
    docs = docs.select("doc_id", "text", "lang", id_hash("doc_id").alias("h"))
    return docs.mapInArrow(run, of).join(labels.select("doc_id", "y"), "doc_id").groupBy(F.coalesce("lang", F.lit("")).alias("lang"), "bin", "y").agg(F.count("*").alias("c"))


def fit(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", label_col: str = "toxic", positives: int = 3000, negatives: int = 5000, sample_words: int = 12_000_000) -> Model:
    """Model: the net from at most `positives` and `negatives` labelled documents by hash order, and no more once they hold `sample_words` words,
    calibration and thresholds from all labelled rows that the net was not fitted on.

    A fifth of the sample is not fitted on. Where the rows not fitted on lack a class, the sample calibrates.
    learn: a condition on the column `doc_id` of the labels that may be learnt from. A document with several labels has the largest;
    null labels and ids are left out. No usable labels give scores of 0.
    """
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y"))
    lab = lab.filter(learn) if learn is not None else lab
    n, ones = lab.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not n:
        return Model(None)
    order = F.xxhash64("doc_id").alias("h")
    drawn = lab.filter("y = 1").select("*", order).orderBy("h").limit(positives).unionByName(lab.filter("y = 0").select("*", order).orderBy("h").limit(negatives))
    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # the sample is bounded by its row limits, hence the broadcast

    def hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in slices(batches):
            h = hashes(texts(batch.column(0)))
            words = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *[x.size for x in h]]), pa.int32()), pa.array(np.concatenate(h).view(np.int64)))
            yield pa.RecordBatch.from_arrays([words, pa.array([x.size for x in h], pa.int64()), *batch.columns[1:]], names=["words", "n", "lang", "y", "h"])

    rows = src.join(F.broadcast(drawn), "doc_id").select("text", "lang", "y", "h").mapInArrow(hashed, "words array<long>, n long, lang string, y int, h long")
    # one text per id, that of the fewest words, so that a repeated id cannot fill the sample
    rows = rows.groupBy("h", "y").agg(F.min(F.struct("n", "words", "lang")).alias("s")).select("s.words", "s.n", "s.lang", "y", "h")
    rows = staged(rows, "labelled")
    sums = rows.select("h", "n").withColumn("before", F.sum("n").over(W.orderBy("h").rowsBetween(W.unboundedPreceding, -1))).groupBy("h").agg(F.min("before").alias("before"))
    last = sums.filter(F.coalesce("before", F.lit(0)) < sample_words).agg(F.max("h")).first()[0]
    table = rows.filter(F.col("h") <= (last if last is not None else -(1 << 63))).orderBy("h", "n").toArrow()
    if not table.num_rows:
        return Model(None, ones / n)
    words = table["words"].combine_chunks()
    at, flat = words.offsets.to_numpy(), words.values.to_numpy(zero_copy_only=False).view(np.uint64)
    sample, y, share = [flat[a:b] for a, b in zip(at[:-1], at[1:])], table["y"].to_numpy(), ones / n
    if not 0 < y.sum() < y.size:
        return Model(None, share)
    net, fitted = fit_net(sample, y)
    usable = src.filter("doc_id is not null")
    usable = usable.filter(learn) if learn is not None else usable
    got = histogram(usable, lab, net, fitted).toPandas()
    bin, target, count, lang = (got[c].to_numpy() for c in ("bin", "y", "c", "lang"))
    if not 0 < target.sum() < target.size:
        bin, target, count, lang = bins(net.logits(sample)), y, np.ones(y.size, np.int64), np.array([x or "" for x in table["lang"].to_pylist()])
    return calibrated(net, bin, target, count, lang, share)


def with_scores(docs: DataFrame, model: Model, text_col: str = "text", lang_col: str = "lang", score: str = "score", threshold: str = "threshold") -> DataFrame:
    """docs with the columns `score` and `threshold`: each whole text's score, and the cut of its language (of all, if null or unknown).

    The score depends on the text alone. Null and empty texts are scored as texts without words. All rows and columns stay; no rows give no rows.
    """
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, m = WordHashes(), held.value
        for batch in slices(batches, 256):
            text, lang = (batch.column(batch.schema.get_field_index(c)) for c in (text_col, lang_col))
            got = np.clip(m.scores(hashes(texts(text))), 0, 1)
            cut = [m.by_language.get(x, m.threshold) for x in lang.cast(pa.string()).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(got, pa.float64()), pa.array(cut, pa.float64())], names=[*batch.schema.names, score, threshold])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(score, T.DoubleType()), T.StructField(threshold, T.DoubleType())]))


def without_toxic(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs (doc_id, text, lang, ...) without the rows whose score reaches their language's threshold."""
    model = fit(docs, labels, learn)
    safe, back = set_apart(docs, ["doc_id", "text", "lang"])
    return back(with_scores(safe, model, score="__score", threshold="__threshold").filter("__score < __threshold"))
