"""Quality by hierarchical empirical Bayes: a document classifier's log odds and the shrunken rates of its host and path.

The classifier is a logistic regression on text statistics, fitted on a bounded labelled sample. Labelled documents are counted
by host and path; a host's rate is shrunk to the global rate and a path's to its host's, by prior strengths from the
spread between the groups (method of moments). The document's log odds and its path's log odds against the global rate add up.
"""

from __future__ import annotations

import operator
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidelog.llm.common import hash_filter, id_hash, may_hold, set_apart, slices, staged, texts

#: Byte classes whose shares are features: upper case, digits, end signs, other signs, blanks, beyond ASCII.
CLASSES = [b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'-", b"!#$%&*|@^~_=+<>/\\{}[]()\"`", b" \t\n\r", bytes(range(128, 256))]
CLASS_OF = np.full(256, len(CLASSES), np.int64)
for _i, _c in enumerate(CLASSES):
    CLASS_OF[list(_c)] = _i


def statistics(text: bytes) -> list[float]:
    """Features of a whole text; all zero for an empty one."""
    words = text.split()
    if not words:
        return [0.0] * 14
    n, lines = len(words), [x for x in text.split(b"\n") if x]
    shares = np.bincount(CLASS_OF, np.bincount(np.frombuffer(text, np.uint8), minlength=256), minlength=len(CLASSES) + 1)[: len(CLASSES)] / len(text)
    return [
        *shares.tolist(), float(np.log1p(n)), (len(text) - n) / n, len(set(words)) / n, sum(map(operator.eq, words, words[1:])) / n, len(set(lines)) / max(1, len(lines)), float(np.log1p(n / max(1, len(lines)))),
        sum(w.isupper() for w in words) / n, sum(w[-1:] in b"!#$%&*|" for w in words) / n,
    ]


@dataclass
class Classifier:
    """Logistic regression on standardised statistics and their squares."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    def design(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        return np.concatenate((np.ones((x.shape[0], 1)), z, z * z), axis=1)

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.clip(self.design(x) @ self.weight, -30, 30)


def train(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> Classifier:
    """Newton steps on the penalised likelihood."""
    c = Classifier(x.mean(axis=0), x.std(axis=0) + 1e-6, np.zeros(2 * x.shape[1] + 1))
    d = c.design(x)
    penalty = np.r_[1e-3, np.full(d.shape[1] - 1, ridge)]
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(d @ c.weight, -30, 30)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d + np.diag(penalty), d.T @ (p - y) + penalty * c.weight)
        c.weight -= step * min(1.0, 4 / (np.abs(step).max() + 1e-9))
    return c


def labelled(docs: DataFrame, labels: DataFrame, learn: Column | None, id_col: str, label_col: str, host: Column, path: Column) -> DataFrame:
    """(doc_id, host, path, y) of the rows of docs with a label that may be learnt from; several labels of an id: the smallest."""
    lab = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)")
    lab = lab.groupBy("doc_id").agg(F.min("y").alias("y"))
    lab = lab.filter(learn) if learn is not None else lab
    return docs.select(F.col(id_col).alias("doc_id"), host.alias("host"), path.alias("path")).join(lab, "doc_id")


def site_rates(rows: DataFrame) -> tuple[DataFrame, float]:
    """((host, path, host_rate, path_rate), global rate) from labelled rows (host, path, y).

    A group's rate is (ones + strength * parent's rate) / (rows + strength). The strength follows from how much more the groups' rates
    spread than chance makes them; no such spread gives a strength that leaves the parent's rate.
    """
    rows = rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("y").alias("ones"))
    rows = staged(rows, "sites")
    total, ones = rows.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("ones"), F.lit(0))).first()
    rate = (ones + 0.5) / (total + 1.0)

    def strength(groups: DataFrame, parent: Column) -> float:
        # weighted spread about the parent's rate, of which the chance part is p (1 - p) / n for each group
        p = F.col("ones") / F.col("n")
        got = groups.agg(F.sum(F.col("n") * (p - parent) ** 2).alias("q"), F.sum(parent * (1 - parent)).alias("e"), F.sum("n").alias("n"), F.count("*").alias("k")).first()
        between = max(0.0, (got["q"] or 0.0) - (got["e"] or 0.0)) / max(1.0, (got["n"] or 0.0) - (got["k"] or 0))
        return float(np.clip(rate * (1 - rate) / between - 1, 2.0, 1e6)) if between > 0 else 1e6

    hosts = rows.groupBy("host").agg(F.sum("n").alias("n"), F.sum("ones").alias("ones"))
    k = strength(hosts, F.lit(rate))
    hosts = hosts.select("host", ((F.col("ones") + k * rate) / (F.col("n") + k)).alias("host_rate"))
    paths = rows.join(hosts, "host")
    k = strength(paths, F.col("host_rate"))
    return paths.select("host", "path", "host_rate", ((F.col("ones") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate")), rate


def site(source: Column, section: Column) -> tuple[Column, Column]:
    """Host and path of a source: up to its first `/` and the first segment after it; without one, the section given is the path. Null is empty."""
    source = F.coalesce(source.cast("string"), F.lit(""))
    rest = F.regexp_extract(source, r"^[^/]*/([^/]*)", 1)
    return F.substring_index(source, "/", 1), F.when(source.contains("/"), rest).otherwise(F.coalesce(section.cast("string"), F.lit("")))


#: Bins of log odds, of width 1 / BINS between -40 and 40.
BINS = 50


def keep_threshold(src: DataFrame, lab: DataFrame, drawn: DataFrame, rates: DataFrame, model: Classifier, site_odds: Column, fitted: np.ndarray, most_lost: float) -> float:
    """The largest score up to 0.5 below which at most the share `most_lost` of the good labelled documents lies that were not fitted on.

    All of them are scored and counted by bin in Spark; texts without a label are passed over by a filter of the labelled ids. Where no good document is
    left over, the fitted ones (their scores) decide.
    """
    filtered = src.sparkSession.sparkContext.broadcast((model, hash_filter(lab.select("doc_id"), "doc_id")))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, ids = filtered.value
        for batch in batches:
            for part in slices([batch.filter(pa.array(may_hold(ids, batch.column(2))))]):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(m.logits(np.array([statistics(t) for t in texts(part.column(0))])), pa.float64())], names=["doc_id", "evidence"])

    rows = src.select("text", "doc_id", id_hash("doc_id").alias("h")).mapInArrow(run, T.StructType([src.schema["doc_id"], T.StructField("evidence", T.DoubleType())]))
    good = lab.filter("y = 1").join(F.broadcast(drawn.select("doc_id")), "doc_id", "left_anti").dropDuplicates(["doc_id"]).join(rates, ["host", "path"], "left")
    bins = rows.join(good.select("doc_id", site_odds.alias("o")), "doc_id").select(F.floor(F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.col("evidence") + F.col("o"))) * BINS).cast("int").alias("bin"))
    got = bins.groupBy("bin").agg(F.count("*").alias("n")).toPandas().sort_values("bin")
    if not len(got):
        return min(0.5, float(np.quantile(fitted, most_lost, method="lower")))
    below = got["n"].cumsum() - got["n"]
    # the lowest bin edge with more than the allowed share below the next one
    edge = got["bin"][below <= most_lost * got["n"].sum()].max() / BINS
    return min(0.5, float(1 / (1 + np.exp(-edge))))


def assess(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", section_col: str = "lang", label_col: str = "quality", sample_rows: int = 20_000, most_lost: float = 0.005) -> DataFrame:
    """docs with the columns __host, __path, __evidence, __host_rate, __path_rate, __score and __keep, for every row by its whole text.

    __evidence: the classifier's log odds of good quality; __score: the posterior probability of it; __keep: whether it reaches the threshold, the largest up to
    0.5 that loses at most the share `most_lost` of the good labelled documents that were not fitted on (`keep_threshold`). Sites without labels have their host's or the global rate. Null
    texts count as empty; a text without words is judged by its features, all zero, as any other. Without labels of both classes the evidence and the
    sites say nothing, the score is the global rate (0.5 without labels) and all rows are kept. The classifier learns from at most `sample_rows` labelled
    documents by hash order, the rates from all of them. Rows are never dropped or repeated; other columns stay.
    """
    spark = docs.sparkSession
    host, path = site(F.col(source_col), F.col(section_col))
    lab = staged(labelled(docs, labels, learn, id_col, label_col, host, path), "quality-labels")
    rates, rate = site_rates(lab)
    # a fifth of the labelled ids is never fitted on; what the limit leaves of the others is not either
    drawn = staged(lab.select("doc_id", "y", F.xxhash64("doc_id").alias("h")).distinct().filter("pmod(h, 5) > 0").orderBy("h").limit(sample_rows), "quality-sample")

    def sampled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            x = np.array([statistics(t) for t in texts(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), *batch.columns[1:]], names=["x", "doc_id", "y", "host", "path"])

    src = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), host.alias("host"), path.alias("path"))
    sample = src.join(F.broadcast(drawn), "doc_id").select("text", "doc_id", "y", "host", "path").mapInArrow(sampled, T.StructType([T.StructField("x", T.ArrayType(T.DoubleType())), src.schema["doc_id"], *T._parse_datatype_string("y int, host string, path string").fields]))
    # one row per id, so that a repeated id cannot fill the sample
    sample = sample.groupBy("doc_id").agg(F.min(F.struct("x", "y", "host", "path")).alias("s")).select("s.*")
    sample = sample.join(rates, ["host", "path"], "left").select("x", "y", F.coalesce("path_rate", F.lit(rate)).alias("r")).toPandas()
    y = sample["y"].to_numpy(dtype=np.float64)
    odds = lambda p: np.log(p / (1 - p))
    model, threshold = None, 0.0
    if 0 < y.sum() < y.size:
        x = np.stack(sample["x"].to_numpy())
        model = train(x, y)
        p = 1 / (1 + np.exp(-(model.logits(x) + odds(sample["r"].to_numpy(dtype=np.float64)) - odds(rate))))
        site_odds = F.log(F.coalesce("path_rate", F.lit(rate)) / (1 - F.coalesce("path_rate", F.lit(rate)))) - F.lit(float(odds(rate)))
        threshold = keep_threshold(src, lab, drawn, rates, model, site_odds, p[y == 1], most_lost)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            text = texts(batch.column(batch.schema.get_field_index(text_col)))
            logit = held.value.logits(np.array([statistics(t) for t in text])) if held.value else np.full(len(text), odds(rate))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(logit, pa.float64())], names=[*batch.schema.names, "__evidence"])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("__evidence", T.DoubleType())])).withColumn("__host", host).withColumn("__path", path)
    hosts = rates.select(F.col("host").alias("__host"), F.col("host_rate").alias("__host_rate")).distinct()
    paths = rates.select(F.col("host").alias("__host"), F.col("path").alias("__path"), F.col("path_rate").alias("__path_rate"))
    out = marked.join(hosts, "__host", "left").join(paths, ["__host", "__path"], "left")
    out = out.withColumn("__host_rate", F.coalesce("__host_rate", F.lit(rate))).withColumn("__path_rate", F.coalesce("__path_rate", "__host_rate"))
    site_odds = F.log(F.col("__path_rate") / (1 - F.col("__path_rate"))) - F.lit(float(odds(rate))) if model else F.lit(0.0)
    out = out.withColumn("__score", 1 / (1 + F.exp(-(F.col("__evidence") + site_odds))))
    return out.withColumn("__keep", F.col("__score") >= threshold)


def without_poor(docs: DataFrame, labels: DataFrame, learn: Column | None = None) -> DataFrame:
    """docs (doc_id, text, source, lang, ...) without the rows that assess() rejects."""
    safe, back = set_apart(docs, ["doc_id", "text", "source", "lang"])
    return back(assess(safe, labels, learn).filter("__keep"))
