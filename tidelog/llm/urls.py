"""URL rules by a sort-merge range join on reversed-host keys.

A url's key is its host's labels in reverse, then its path; a rule's host gives the interval of the keys of the host and all its
subdomains, and such intervals nest or are disjoint. Split keys, quantiles of a bounded key sample, cut the key space into ranges; a rule
goes to each range that its interval overlaps. Each range is sorted by key, rules before urls, and swept once: a stack holds the rules
whose interval is still open, and the longest one whose path fits judges the url.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LABEL, PATH, PAST = "\x01", "\x00", "\x02"


def url_host(url: Column) -> Column:
    """Host after the first `://`, A-Z in lower case; empty without one."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def url_path(url: Column) -> Column:
    """Path after the host up to `?`, `#` or the end; empty without `://`."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: str) -> str:
    return LABEL.join(reversed(host.split("."))) + LABEL


def sweep(batches: Iterable[pa.RecordBatch], names: list[str], default: str) -> Iterator[pa.RecordBatch]:
    """Judge the urls of sorted ranges; a batch holds rules and urls, and a new range empties the stack."""
    stack, at = [], None
    for batch in batches:
        d = batch.to_pydict()
        out: dict[str, list] = {n: [] for n in names}
        for row, key in enumerate(d["__key"]):
            if d["__range"][row] != at:
                stack, at = [], d["__range"][row]
            while stack and key >= stack[-1][0]:
                stack.pop()
            host, path = d["host"][row], d["path"][row]
            if d["__kind"][row] == 0:
                stack.append((key[:-1] + PAST, host, path, d["verdict"][row]))
                continue
            best = None
            for _, h, p, v in stack:
                if path.startswith(p) and (host == h or host.endswith("." + h)):
                    size = (h.count(".") + 1, len(h), len(p))
                    # of equal rules, block wins
                    if best is None or (size, v == "block") > best[0]:
                        best = ((size, v == "block"), h + p, v)
            for n in names:
                out[n].append(d[n][row] if n not in ("rule", "verdict") else (None if best is None else best[1]) if n == "rule" else default if best is None else best[2])
        yield pa.RecordBatch.from_pydict({n: pa.array(out[n], batch.schema.field(n).type if n in batch.schema.names else pa.string()) for n in names})


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = "allow", range_rows: int = 200_000, sample_rows: int = 100_000) -> DataFrame:
    """(id, host, path, rule, verdict) of every row of pages under rules(host, path, verdict).

    A rule fits its host and all subdomains if the url's path starts with the rule's. The rule with most host labels wins, then the one with
    the longest path, then block. rule is null and the verdict `default` where none fits: also for null urls and urls without `://`, whose host
    and path are empty. Repeated rows are judged each; null rule parts count as empty, rules without a host or a verdict are left out. Other
    columns are not read. Split keys come from at most `sample_rows` keys by hash order; a key that fills several ranges is dealt over all of them.
    """
    spark = pages.sparkSession
    url = F.col(url_col).cast("string")
    rows = pages.select(F.col(id_col).alias("__id"), url_host(url).alias("host"), url_path(url).alias("path"))
    rows = rows.withColumn("__key", F.concat(F.concat_ws(LABEL, F.reverse(F.split("host", r"\."))), F.lit(LABEL + PATH), "path"))
    n = rows.count()
    ranges = max(1, -(-n // range_rows))
    splits: list[str] = []
    if ranges > 1:
        share = min(1.0, sample_rows / n)
        drawn = sorted(r[0] for r in rows.select("__key", F.xxhash64("__id", "__key").alias("h")).orderBy("h").limit(min(sample_rows, 100 * ranges)).select(F.substring("__key", 1, 1000)).collect()) if share else []
        splits = [drawn[len(drawn) * i // ranges] for i in range(1, ranges)]

    @F.pandas_udf("int")
    def range_of(key: pd.Series, salt: pd.Series) -> pd.Series:
        # a key equal to several splits may go to any of the ranges between them
        return key.combine(salt, lambda k, s: (a := bisect_left(splits, k)) + s % (bisect_right(splits, k) - a + 1)).astype("int32")

    @F.pandas_udf("array<int>")
    def ranges_of(key: pd.Series) -> pd.Series:
        return key.map(lambda k: list(range(bisect_left(splits, k), bisect_right(splits, k[:-1] + PAST) + 1)))

    salt = F.pmod(F.xxhash64("__id"), F.lit(1 << 20))
    urls = rows.select(range_of("__key", salt).alias("__range") if splits else F.lit(0).alias("__range"), "__key", F.lit(1).alias("__kind"), "__id", "host", "path", F.lit(None).cast("string").alias("verdict"))
    rule = rules.select(F.lower(F.col("host").cast("string")).alias("host"), F.coalesce(F.col("path").cast("string"), F.lit("")).alias("path"), F.col("verdict").cast("string").alias("verdict"))
    rule = rule.filter("host is not null and host <> '' and verdict is not null").withColumn("__key", F.concat(F.concat_ws(LABEL, F.reverse(F.split("host", r"\."))), F.lit(LABEL)))
    opens = rule.select(F.explode(ranges_of("__key") if splits else F.array(F.lit(0))).alias("__range"), "__key", F.lit(0).alias("__kind"), F.lit(None).cast(rows.schema["__id"].dataType).alias("__id"), "host", "path", "verdict")
    names = ["__id", "host", "path", "rule", "verdict"]
    schema = T.StructType([rows.schema["__id"], *[T.StructField(c, T.StringType()) for c in names[1:]]])
    dealt = urls.unionByName(opens).repartition(ranges, "__range").sortWithinPartitions("__range", "__key", "__kind", "host", "path")
    return dealt.mapInArrow(lambda b: sweep(b, names, default), schema).withColumnRenamed("__id", id_col)
