"""Ordered per-key logic that survives hot keys.

A plain ``lag``/``lead`` window puts every row of a key into one task. When one key
holds a large part of all rows, that task never ends. Here only the *hot* keys (more
than ``hot_rows`` rows) are cut into time slices; each slice is its own window
partition, and what must cross a slice border travels as one carry row per slice.
The result equals the plain window exactly.

Hot keys travel as 64-bit hashes: with the default of 5 million, 5e11 rows give at most 100,000
of them, under 2 MB, so they may be broadcast. Keys that share a hash are cut together, which changes no result.
If no key is hot the carry branches are empty and adaptive execution drops them before they scan
anything. Inputs of every size take this path; ``hot_rows`` is its only threshold.

Keys must not be NULL. The order columns, time first, must form a total order within a
key; rows that tie on all of them must be interchangeable.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HOT_ROWS = 5_000_000
SLICE_SECONDS = 60
_HOT = "_hot"
_KEY = "_key_hash"
_SLICE = "_slice"
_CARRY = "_carry"


@dataclass(frozen=True)
class Ordered:
    """Rows of a frame seen per key in order; every method returns a new ``Ordered``."""

    df: DataFrame
    keys: tuple[str, ...]
    order: tuple[str, ...]

    @staticmethod
    def by(
        df: DataFrame, keys: list[str], order: list[str], hot_rows: int = HOT_ROWS, slice_seconds: int = SLICE_SECONDS
    ) -> Ordered:
        key = F.xxhash64(*keys).alias(_KEY)
        hot = (
            df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
            .select(_KEY, F.lit(True).alias(_HOT))
        )
        number = F.when(F.col(_HOT), F.floor(F.col(order[0]) / F.lit(slice_seconds)).cast("long"))
        cut = df.select("*", key).join(F.broadcast(hot), _KEY, "left").drop(_KEY).withColumn(_SLICE, number)
        return Ordered(cut, tuple(keys), tuple(order))

    def rows(self) -> DataFrame:
        return self.df.drop(_HOT, _SLICE)

    def map(self, change: Callable[[DataFrame], DataFrame]) -> Ordered:
        """Row-wise change that keeps keys and order columns."""
        return replace(self, df=change(self.df))

    def step(self, lag: list[str] = (), lead: list[str] = (), known: dict[str, str] | None = None, running: dict[str, str] | None = None) -> Ordered:
        """One window pass: prev_<c> and next_<c>, the last non-NULL value strictly before a row (``known``: column -> output) and sums up to and including it (``running``).

        Hot keys: one aggregate per slice holds its first and last rows, last known values and sums; carried along the slices they make at most two extra rows
        per slice, one before and one after it. The test on ``_hot`` makes that branch an inner join, which adaptive execution replaces by nothing once the
        hot-key table proves empty.
        """
        known, running = known or {}, running or {}
        fields = [f for f in dict.fromkeys([*self.order, *lag, *lead]) if f not in self.keys]
        copy = {f"_known_{c}": F.col(c) for c in known} | {f"_sum_{c}": F.col(c).cast("long") for c in running}
        out = self.df.withColumns({**copy, _CARRY: F.lit(0)})

        slices = self.df.where(F.col(_HOT)).groupBy(*self.keys, _HOT, _SLICE).agg(
            F.max(F.struct(*fields)).alias("_last"), F.min(F.struct(*fields)).alias("_first"),
            *[F.max(F.when(F.col(c).isNotNull(), F.struct(*dict.fromkeys([*self.order, c])))).alias(f"_known_{c}") for c in known],
            *[F.sum(F.col(c).cast("long")).alias(f"_sum_{c}") for c in running])
        along = Window.partitionBy(*self.keys, _HOT).orderBy(_SLICE)
        earlier = along.rowsBetween(Window.unboundedPreceding, -1)
        slices = slices.select(
            *self.keys, _HOT, _SLICE, F.lag("_last").over(along).alias("_last"), F.lead("_first").over(along).alias("_first"),
            *[F.last(f"_known_{c}", ignorenulls=True).over(earlier)[c].alias(f"_known_{c}") for c in known], *[F.sum(f"_sum_{c}").over(earlier).alias(f"_sum_{c}") for c in running])
        side = lambda mark, row, keep: F.when(F.col(row).isNotNull(), F.struct(
            F.lit(mark).alias(_CARRY), *[F.col(row)[f].alias(f) for f in fields], *[(F.col(c) if keep else F.lit(None).cast(dict(slices.dtypes)[c])).alias(c) for c in copy]))
        sides = F.filter(F.array(side(-1, "_last", True), *([side(1, "_first", False)] if lead else [])), lambda x: x.isNotNull())
        # explode, not inline: adaptive execution sees that an empty branch stays empty through it
        carried = slices.select(*self.keys, _HOT, _SLICE, F.explode(sides).alias("_side"))
        out = out.unionByName(carried.select(*self.keys, _HOT, _SLICE, "_side.*"), allowMissingColumns=True)

        w = Window.partitionBy(*self.keys, _HOT, _SLICE).orderBy(_CARRY, *self.order)
        before, upto = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        columns = [F.lag(c).over(w).alias(f"prev_{c}") for c in lag] + [F.lead(c).over(w).alias(f"next_{c}") for c in lead]
        columns += [F.last(f"_known_{c}", ignorenulls=True).over(before).alias(o) for c, o in known.items()]
        columns += [F.sum(f"_sum_{c}").over(upto).cast("long").alias(o) for c, o in running.items()]
        return replace(self, df=out.select("*", *columns).where(F.col(_CARRY) == 0).drop(_CARRY, *copy))

    # -- single window steps -----------------------------------------------
    def neighbours(self, lag: list[str] = (), lead: list[str] = ()) -> Ordered:
        """Add prev_<c> for every c in ``lag`` and next_<c> for every c in ``lead``."""
        return self.step(lag=lag, lead=lead)

    def last_known(self, column: str, out: str) -> Ordered:
        """Last non-NULL value of ``column`` strictly before the current row."""
        return self.step(known={column: out})

    def running_sum(self, flag: str, out: str) -> Ordered:
        """Sum of ``flag`` over the key's rows up to and including the current one."""
        return self.step(running={flag: out})
