"""Counts, shares, modes, top-N and exact percentiles, all with bounded per-task state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.round(F.try_divide(part * F.lit(100.0), whole), digits)


def grand_total(df: DataFrame, column: str) -> Column:
    """Sum of a column as a scalar subquery: no unpartitioned window over the groups."""
    return df.agg(F.sum(column)).scalar()


def with_share(df: DataFrame, column: str, out: str, digits: int = 2) -> DataFrame:
    """Share of the grand total in percent."""
    return df.withColumn(out, percent(F.col(column), grand_total(df, column), digits))


def with_group_share(df: DataFrame, group: list[str], column: str, out: str, digits: int = 2) -> DataFrame:
    """Share of the group's total; the totals are joined, so a large group is not one task."""
    totals = df.groupBy(*group).agg(F.sum(column).alias("_total"))
    joined = df.join(totals, group, "left")
    return joined.withColumn(out, percent(F.col(column), F.col("_total"), digits)).drop("_total")


def one_row(*frames: DataFrame) -> DataFrame:
    """Put single-row aggregates side by side (equi-join on a constant key)."""
    out = frames[0].withColumn("_k", F.lit(0))
    for f in frames[1:]:
        out = out.join(f.withColumn("_k", F.lit(0)), "_k")
    return out.drop("_k")


def counts(df: DataFrame, *by: Column | str, name: str = "count") -> DataFrame:
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias(name))


def modes(df: DataFrame, keys: list[str], column: str, out: str, extra: str | None = None) -> DataFrame:
    """Most frequent non-NULL value per key, lowest value on ties; NULL when a key has none.

    Two small aggregates: counts per (key, value) first, so no task holds a key's values.
    NULLs are left out inside the second one: a filter would be pushed below the projection
    that makes the value and run its patterns twice. ``extra`` names an output column with
    the winner's row count.
    """
    per_value = df.groupBy(*keys, column).agg(F.count(F.lit(1)).alias("_n"))
    ranked = F.when(F.col(column).isNotNull(), F.struct((-F.col("_n")).alias("n"), F.col(column).alias("v")))
    best = per_value.groupBy(*keys).agg(F.min(ranked).alias("_b"))
    cols = [F.col("_b")["v"].alias(out)]
    if extra:
        cols.append((-F.col("_b")["n"]).alias(extra))
    return best.select(*keys, *cols)


def summarize(
    df: DataFrame, keys: list[str], measures: dict[str, tuple[str, Column]], distinct: dict[str, str], mode: dict[str, str],
    rows: str = "requests",
) -> DataFrame:
    """Row count, measures, distinct counts and modes per key in one pass over ``df``.

    Each row gives one (field, value) entry per distinct or mode column. Entries are first
    counted per (key, field, value), map-side before the shuffle, so a hot key is spread over
    its values; the second aggregate then sees one row per value. ``measures`` maps a name to
    (sum | min | max, column). Modes are NULL when a key has no value, lowest on ties.
    """
    columns = list(dict.fromkeys([*distinct.values(), *mode.values()]))
    fold = {"sum": F.sum, "min": F.min, "max": F.max}
    entries = F.array(*[F.struct(F.lit(i).alias("_f"), F.col(c).cast("string").alias("_v")) for i, c in enumerate(columns)])
    long = df.select(*keys, *[c.alias(f"_m_{n}") for n, (_, c) in measures.items()], F.inline(entries))
    per = long.groupBy(*keys, "_f", "_v").agg(
        F.count(F.lit(1)).alias("_n"), *[fold[how](f"_m_{n}").alias(f"_m_{n}") for n, (how, _) in measures.items()])
    # the entries of the first field cover every row exactly once
    once = lambda c: F.when(F.col("_f") == 0, F.col(c))
    has = lambda c: (F.col("_f") == columns.index(c)) & F.col("_v").isNotNull()
    best = lambda c: F.min(F.when(has(c), F.struct((-F.col("_n")).alias("n"), F.col("_v").alias("v"))))["v"]
    return per.groupBy(*keys).agg(
        F.sum(once("_n")).alias(rows), *[fold[how](once(f"_m_{n}")).alias(n) for n, (how, _) in measures.items()],
        *[F.count_if(has(c)).alias(n) for n, c in distinct.items()], *[best(c).alias(n) for n, c in mode.items()])


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int, rank: str = "rn") -> DataFrame:
    """First n rows per group; Spark prunes to n per group before the shuffle."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n).withColumn(rank, F.col(rank).cast("long"))


def first_values(df: DataFrame, keys: list[str], column: str, n: int, out: str, separator: str = ", ") -> DataFrame:
    """The first n distinct values per key in order, joined to one text; only n per key are gathered."""
    distinct = df.select(*keys, column).where(F.col(column).isNotNull()).distinct()
    first = top_per_group(distinct, keys, [F.asc(column)], n)
    texts = F.transform(F.array_sort(F.collect_list(column)), lambda v: v.cast("string"))
    return first.groupBy(*keys).agg(F.array_join(texts, separator).alias(out))


def exact_percentiles(df: DataFrame, column: str, points: dict[str, float], width: int = 4096) -> DataFrame:
    """Interpolated percentiles of a numeric column, fractions included, as one row.

    Values are counted first, the counts are summed per block of ``width`` values, and
    only the blocks that hold a wanted rank are opened. One task thus sees at most
    (value range / width) blocks, or the distinct values of one block, whatever the number of rows.
    """
    v = F.col(column)
    if dict(df.select(v.alias("v")).dtypes)["v"] not in ("double", "float"):
        v = v.cast("long")
    per_value = df.where(v.isNotNull() & ~F.isnan(v.cast("double"))).groupBy(v.alias("v")).agg(F.count(F.lit(1)).alias("n"))
    blocks = per_value.groupBy(F.floor(F.col("v") / width).alias("block")).agg(F.sum("n").alias("n"))
    upto = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = blocks.withColumn("end", F.sum("n").over(upto)).withColumn("start", F.col("end") - F.col("n"))
    wanted = F.array(*[F.struct(F.lit(k).alias("p"), F.lit(q).alias("q")) for k, q in points.items()])
    ranks = (
        per_value.agg(F.sum("n").alias("rows")).select("rows", F.inline(wanted))
        .withColumn("pos", F.col("q") * (F.col("rows") - 1))
        .select("p", "pos", F.explode(F.array(F.floor("pos"), F.ceil("pos"))).alias("rank")).distinct()
    )
    hit = (
        blocks.join(F.broadcast(ranks), (F.col("rank") >= F.col("start")) & (F.col("rank") < F.col("end")))
        .select("block", "start", "p", "pos", "rank")
    )
    inside = per_value.withColumn("block", F.floor(F.col("v") / width)).join(F.broadcast(hit), "block")
    w = Window.partitionBy("p", "rank").orderBy("v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = inside.withColumn("end", F.col("start") + F.sum("n").over(w))
    found = inside.where((F.col("end") > F.col("rank")) & (F.col("end") - F.col("n") <= F.col("rank")))
    per_point = found.groupBy("p").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.first("pos").alias("pos"))
    value = F.col("lo") + (F.col("hi") - F.col("lo")) * (F.col("pos") - F.floor("pos"))
    return per_point.agg(*[F.max(F.when(F.col("p") == k, value)).alias(k) for k in points])


def value_counts(
    df: DataFrame, column: Column | str, top_n: int | None = None, other: bool = False, label: str = "(blank)"
) -> DataFrame:
    """value, count, pct of all rows; with ``other`` the rest is folded into one row."""
    c = (F.col(column) if isinstance(column, str) else column).cast("string")
    value = F.coalesce(F.nullif(c, F.lit("")), F.lit(label))
    per = counts(df, value.alias("value"))
    order = [F.desc("count"), F.asc("value")]
    if top_n is None:
        return with_share(per, "count", "pct")
    if not other:
        return per.orderBy(*order).limit(top_n).withColumn("pct", percent(F.col("count"), grand_total(per, "count")))
    head = per.orderBy(*order).limit(top_n)
    rest = per.join(F.broadcast(head.select("value")), "value", "left_anti")
    folded = rest.agg(F.sum("count").alias("count")).where(F.col("count").isNotNull())
    both = head.unionByName(folded.select(F.lit("Other").alias("value"), "count"))
    return both.withColumn("pct", percent(F.col("count"), grand_total(per, "count")))
