"""Host-level rules against plain Python counts, the prior against its formula, and odd rows."""

import re

import pytest
from pyspark.sql import functions as F

from tidelog.llm import site_rules

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain(text):
    words = WORD.findall(text or "")
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    again = {w for w in windows if windows.count(w) > 1}
    covered = {i + k for i, w in enumerate(windows) if w in again for k in range(5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), len(lines)


TEXTS = [
    None, "", " \t\n\x0b\x0c\r ", "a b c d", "a b c d e", "a b c d e a b c d e", "x x x x x x x", "one\ntwo\none\n\n \none ", "l'été 漢字 🙂 stop | # a<b>c",
    "a b c d e f a b c d e g a b c d e f", " ".join(f"w{i % 50}" for i in range(400)), "\r\n".join(["same line here"] * 4), "a\x1fb\x85c d e f",
]


def test_counts(spark):
    rows = spark.createDataFrame([(i, "h", t) for i, t in enumerate(TEXTS)], "id long, host string, text string")
    got = {r["id"]: tuple(r[c] for c in site_rules.COUNTS) for r in site_rules.measures(rows).collect()}
    assert got == {i: plain(t) for i, t in enumerate(TEXTS)}


def test_prior_and_verdicts(spark):
    good, bad = "these are ten quite different words in one short plain line", "only five words of text"
    rows = [(i, good, f"Fine.org/{i}") for i in range(300)] + [(1000 + i, bad, "poor.org") for i in range(80)] + [(2000 + i, good, "poor.org") for i in range(20)]
    rows += [(3000, bad, "rare.org"), (3001, good, "rare.org"), (4000, good, None), (4001, bad, None)] + [(5000 + i, good + ("#$%" if i < 40 else ""), "signs.org") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: r for r in site_rules.judge(docs).collect()}
    assert len(got) == len(rows)
    assert all(got[i]["kept"] and got[i]["host"] == "fine.org" for i in range(300))
    assert not any(got[2000 + i]["kept"] for i in range(20)) and got[2000]["host_blocked"]  # good texts of a blocked host
    assert not got[3000]["kept"] and got[3001]["kept"]  # two rows cannot block a host: the prior holds
    assert got[4000]["kept"] and not got[4001]["kept"]
    assert [got[5000 + i]["kept"] for i in (0, 39, 40, 99)] == [False, False, True, True] and got[5000]["failed"] == ["signs"]  # a watched host

    measured = site_rules.measures(docs.select(F.col("doc_id").alias("id"), site_rules.host_of(F.col("source")).alias("host"), "text"))
    hosts = measured.select("host", F.expr(site_rules.RULES["short"]).alias("short")).filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), F.sum(F.col("short").cast("long")).alias("short"))
    mean, strength = site_rules.priors(hosts, ["short"])["short"]
    groups = [(300, 0), (100, 80), (2, 1), (100, 0)]
    n = sum(a for a, _ in groups)
    p = sum(b for _, b in groups) / n
    spread = sum(a * (b / a - p) ** 2 for a, b in groups)
    over = (spread - 3 * p * (1 - p)) / (p * (1 - p) * (n - sum(a * a for a, _ in groups) / n - 3))
    assert mean == pytest.approx(p) and strength == pytest.approx(1 / min(max(over, 1e-6), 0.5) - 1)


def test_hot_host_is_dealt_over_salts(spark):
    rows = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("few words").alias("text"), F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("h"), F.col("id").cast("string"))).alias("source"))
    got = site_rules.judge(rows)
    assert got.count() == 6000 and got.filter("kept").count() == 0 and got.filter("host = 'hot' and host_blocked").count() == 4000


def test_odd_and_empty(spark, odd_docs, no_docs):
    got = site_rules.judge(odd_docs).collect()
    want = sorted((str(r["doc_id"]), plain(r["text"])) if r["doc_id"] != 4 else ("4", None) for r in odd_docs.select("doc_id", "text").collect())
    assert sorted((str(r["doc_id"]), tuple(r[c] for c in site_rules.COUNTS)) if r["doc_id"] != 4 else ("4", None) for r in got) == want
    assert {r["doc_id"]: r["n_words"] for r in got}[4] == 120_000
    assert site_rules.judge(no_docs).count() == 0


def test_plan_is_native(spark, odd_docs):
    rows = site_rules.measures(odd_docs.select(F.col("doc_id").alias("id"), F.col("source").alias("host"), "text"))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Exchange", plan)
    # words are cut once: the split is no part of a later projection's lambda
    assert plan.count("split(text") == 2
