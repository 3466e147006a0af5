"""Quality rules by site: failures of text rules counted by host, rates shrunk by a beta prior, host verdicts joined back to documents.

Built-in functions only. A text is cut into words and five-word windows once; the windows' 64-bit hashes tell which windows repeat (two
different windows of one text share a hash with a chance below 1e-7 for a text of a million words). The prior of a rule is a beta
distribution whose mean is the corpus rate and whose strength follows from how much more the hosts' rates spread than chance makes them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidelog.llm.common import staged

BLANKS = "[\\x20\\x09-\\x0D]+"
SIGNS = "#*$%&|<>"
#: Rule name -> failure, over the counts of `measures`. The first two are the base rules.
RULES: dict[str, str] = {
    "short": "n_words < 10",
    "repeats": "100 * n_repeat_words > 20 * n_words",
    "word_length": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
    "signs": "10 * n_symbols > n_words",
    "same_lines": "100 * n_dup_lines > 30 * n_lines",
}
BASE = ("short", "repeats")
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def measures(rows: DataFrame, width: int = 5) -> DataFrame:
    """(id, host, text) rows -> id, host and COUNTS of the whole text; null texts have no words and no lines.

    Words are runs without ASCII blanks. A line counts if it holds a word; equal lines after the first are duplicates. Repeated words
    lie in a window of `width` words that occurs at least twice, each word counted once.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("id", "host", text.alias("text"))
    rows = rows.select(
        "id", "host", F.array_remove(F.split("text", BLANKS), "").alias("words"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")).alias("lines"),
        (F.length("text") - F.length(F.translate("text", SIGNS, ""))).cast("long").alias("n_symbols"),
    )
    window = F.transform(F.sequence(F.lit(0), F.size("words") - width), lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(width)]))
    rows = rows.select(
        "id", "host", "n_symbols", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size("words") >= width, window).alias("windows"),
    )
    counts = ["id", "host", "n_symbols", "n_words", "word_chars", "n_lines", "n_dup_lines"]
    # only texts with a repeated window are sorted
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"))
    same = lambda p, at: F.coalesce(F.get("placed", at)["h"] == p["h"], F.lit(False))
    places = F.sort_array(F.filter("placed", lambda p, i: same(p, i - 1) | same(p, i + 1))["i"])
    rows = rows.select(*counts, F.when(F.col("placed").isNotNull(), places).alias("places"))
    steps = F.transform(F.sequence(F.lit(1), F.size("places") - 1), lambda j: F.least(F.lit(width), F.get("places", j) - F.get("places", j - 1)).cast("long"))
    covered = F.aggregate(steps, F.lit(width).cast("long"), lambda a, x: a + x)
    return rows.select(*counts, F.coalesce(F.when(F.col("places").isNotNull(), covered), F.lit(0).cast("long")).alias("n_repeat_words"))


def host_of(source: Column) -> Column:
    """A source up to its first `/`, A-Z in lower case; null without one or when that is empty."""
    return F.nullif(F.translate(F.substring_index(source.cast("string"), "/", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def priors(hosts: DataFrame, rules: list[str]) -> dict[str, tuple[float, float]]:
    """Rule -> (mean, strength) of the beta prior, by the method of moments over the hosts' counts (n, and one column of failures a rule).

    The overdispersion is the spread of the hosts' rates, weighted by rows, less what chance gives, over its largest value; it is held between 1e-6 and 0.5, so the
    strength (the prior's number of pseudo-rows) lies between 1 and about 1e6. One host, no spread or no failure gives the strongest prior.
    """
    n = F.col("n").cast("double")
    per_rule = [F.sum(r).alias(f"{r}_f") for r in rules] + [F.sum(F.col(r).cast("double") * F.col(r) / n).alias(f"{r}_s") for r in rules]
    got = hosts.agg(F.count("*").alias("k"), F.sum(n).alias("n"), F.sum(n * n).alias("nn"), *per_rule).first()
    out = {}
    for r in rules:
        p = (got[f"{r}_f"] or 0) / got["n"] if got["n"] else 0.0
        room = p * (1 - p) * (got["n"] - got["nn"] / got["n"] - got["k"] + 1) if got["n"] else 0.0
        over = (got[f"{r}_s"] - p * p * got["n"] - p * (1 - p) * (got["k"] - 1)) / room if room > 0 else 0.0
        over = min(max(over, 1e-6), 0.5)
        out[r] = (p, 1 / over - 1)
    return out


def host_verdicts(rows: DataFrame, watch: float = 0.2, block: float = 0.5) -> DataFrame:
    """One row per host of rows (host, and one boolean per rule): n, the shrunk rate of each rule, `watched` (rules at `watch` or more) and `blocked` (some rule at `block` or more)."""
    rules = list(RULES)
    hosts = staged(rows.filter("host is not null").groupBy("host").agg(F.count("*").alias("n"), *[F.sum(F.col(r).cast("long")).alias(r) for r in rules]), "site-rules")
    prior = priors(hosts, rules)
    rate = {r: (F.col(r) + F.lit(m * s)) / (F.col("n") + F.lit(s)) for r, (m, s) in prior.items()}
    return hosts.select(
        "host", "n", *[rate[r].alias(f"{r}_rate") for r in rules],
        F.filter(F.array(*[F.when(rate[r] >= watch, F.lit(r)) for r in rules]), lambda x: x.isNotNull()).alias("watched"),
        (F.greatest(*rate.values()) >= block).alias("blocked"),
    )


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", watch: float = 0.2, block: float = 0.5, salts: int = 32) -> DataFrame:
    """One row per row of docs: id_col, host, COUNTS, base_failed, failed (names of the rules that it fails), host_blocked, kept.

    A document goes if a base rule fails, if its host is blocked (some rule's shrunk rate reaches `block`), or if it fails a rule whose shrunk rate on its host
    reaches `watch`. Documents without a host are judged by the base rules alone. Null, empty and blank texts fail `short`. Repeated ids stay apart: nothing is
    joined by id. Other columns of docs are not read, so their names cannot clash. No rows give no rows.

    Verdicts that differ from "none" are joined by (host, salt): a host with a third of all rows is dealt over `salts` keys.
    """
    rows = measures(docs.select(F.col(id_col).alias("id"), host_of(F.col(source_col)).alias("host"), F.col(text_col).cast("string").alias("text")))
    rows = staged(rows.select("id", "host", *COUNTS, *[F.expr(e).alias(r) for r, e in RULES.items()]), "text-rules")
    bad = host_verdicts(rows, watch, block).filter("blocked or size(watched) > 0").select("host", "watched", "blocked")
    bad = bad.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    counts = F.struct(*COUNTS)  # equal ids with equal counts may meet on one salt
    out = rows.withColumn("salt", F.pmod(F.xxhash64("id", counts), F.lit(salts)).cast("int")).join(bad, ["host", "salt"], "left")
    failed = F.filter(F.array(*[F.when(F.col(r), F.lit(r)) for r in RULES]), lambda x: x.isNotNull())
    base, blocked = F.expr(" or ".join(BASE)), F.coalesce("blocked", F.lit(False))
    watched = F.coalesce(F.arrays_overlap("watched", failed), F.lit(False))
    return out.select(F.col("id").alias(id_col), "host", *COUNTS, base.alias("base_failed"), failed.alias("failed"), blocked.alias("host_blocked"), (~base & ~blocked & ~watched).alias("kept"))
