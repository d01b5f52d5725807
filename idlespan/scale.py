"""Ordered computation per key that holds when one key owns most of the rows.

A window partitioned by path puts a whole path into one task.  That is the best plan while every path is
small: one exchange, one sort.  It is the wrong plan when a path is a third of a 100 TB table.  Every
ordered operator of the library therefore goes through the four helpers here:

* ``plan_splits`` counts rows per key (one column scan, combined map-side).  If the largest key fits a task
  it answers ``None`` and the single-exchange plan is used.  Otherwise it returns equi-depth cut points of
  the order column, so a (key, segment) group is bounded whatever the skew in key or in time.
* ``running`` is a running aggregate per key.  With splits it runs inside (key, segment) and adds the carry
  of the earlier segments, taken from a table with one row per (key, segment).  Exact: sum, max and last
  are associative.
* ``trailing`` evaluates bounded row frames.  With splits it chunks by row number and copies the last rows
  of a chunk into the next one, so every frame is complete.
* ``order_statistics`` picks exact ranks from a cumulative histogram instead of holding a group in memory.

Cut points are literals in the plan, so a recomputed task lands on the same segments.  Key columns must not
be null; the data model has sentinel values for unknown devices and nodes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .session import cut

AUTO = "auto"
TARGET_ROWS = 4_000_000
MAX_SEGMENTS = 50_000
CHUNK_ROWS = 100_000
SEG, CHUNK, HALO = "_seg", "_chunk", "_halo"


@dataclass(frozen=True)
class Splits:
    """Cut points of the order column; segment i holds the values in [points[i-1], points[i])."""
    points: tuple[float, ...]


def plan_splits(df: DataFrame, order: str, key: Sequence[str] = (),
                target_rows: int = TARGET_ROWS) -> Splits | None:
    sizes = (df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
             .agg(F.max("_n").alias("largest"), F.sum("_n").alias("total")).first())
    if not sizes.largest or sizes.largest <= target_rows:
        return None
    segments = min(MAX_SEGMENTS, math.ceil(sizes.total / target_rows))
    points = (df.select(F.col(order).cast("double").alias(order))
              .approxQuantile(order, [i / segments for i in range(1, segments)], 1 / (4 * segments)))
    return Splits(tuple(sorted(set(points))))


def resolve(splits, df: DataFrame, order: str, key: Sequence[str]) -> Splits | None:
    return plan_splits(df, order, key) if splits == AUTO else splits


def with_segment(df: DataFrame, order: str, splits: Splits) -> DataFrame:
    """Segment of every row by its (numeric) order value; nulls sort first, as in a window."""
    cuts = [-math.inf, *splits.points, math.inf]
    place = F.coalesce(F.col(order).cast("double"), F.lit(-math.inf))
    bucketed = Bucketizer(splits=cuts, inputCol="_order", outputCol=SEG).transform(df.withColumn("_order", place))
    return bucketed.withColumn(SEG, F.col(SEG).cast("int")).drop("_order")


_LOCAL: dict[str, Callable[[Column], Column]] = {
    "sum": F.sum, "max": F.max, "min": F.min, "last": lambda c: F.last(c, ignorenulls=True)}


def _combine(how: str, local: Column, carry: Column) -> Column:
    if how == "sum":
        return F.coalesce(local, F.lit(0)) + F.coalesce(carry, F.lit(0))
    if how == "max":
        return F.greatest(local, carry)
    if how == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def carried(per_segment: DataFrame, key: Sequence[str], hows: dict[str, str], reverse: bool = False) -> DataFrame:
    """Per (key, segment) what the segments before it add up to: ``_carry_<name>`` of each named column, null where there is none before."""
    before = (Window.partitionBy(*key).orderBy(F.col(SEG).desc() if reverse else F.col(SEG).asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    return per_segment.select(*key, SEG, *[_LOCAL[how](F.col(n)).over(before).alias(f"_carry_{n}") for n, how in hows.items()])


def running(df: DataFrame, key: Sequence[str], order: Sequence[str], out: dict[str, tuple[str, Column]],
            inclusive: bool = True, reverse: bool = False, splits: Splits | None = None,
            totals: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """Add running aggregates ``out[name] = (sum|max|min|last, column)`` per key along ``order``.

    ``inclusive=False`` stops before the current row.  ``reverse=True`` runs from the end, so ``last``
    means the nearest following value.  ``last`` skips nulls.  ``totals`` are aggregates of the whole key,
    which cost no join of their own.
    """
    key, totals = list(key), totals or {}
    direction = [F.col(c).desc() if reverse else F.col(c).asc() for c in order]
    edge = Window.currentRow if inclusive else -1

    def frame(parts: list[str]):
        return Window.partitionBy(*parts).orderBy(*direction).rowsBetween(Window.unboundedPreceding, edge)

    if splits is None:
        local = {n: _LOCAL[how](c).over(frame(key)) for n, (how, c) in out.items()}
        whole = {n: _LOCAL[how](c).over(Window.partitionBy(*key)) for n, (how, c) in totals.items()}
        return df.withColumns({**{n: F.coalesce(c, F.lit(0)) if out[n][0] == "sum" else c
                                  for n, c in local.items()}, **whole})

    base = cut(with_segment(df, order[0], splits))
    position = F.struct(*order)
    pick = F.min_by if reverse else F.max_by
    per_segment = base.groupBy(*key, SEG).agg(*[
        (pick(c, F.when(c.isNotNull(), position)) if how == "last" else _LOCAL[how](c)).alias(n)
        for n, (how, c) in {**out, **totals}.items()])
    before = (Window.partitionBy(*key).orderBy(F.col(SEG).desc() if reverse else F.col(SEG).asc())
              .rowsBetween(Window.unboundedPreceding, -1))
    carry = per_segment.select(
        *key, SEG, *[_LOCAL[how](F.col(n)).over(before).alias(f"_carry_{n}") for n, (how, _) in out.items()],
        *[_LOCAL[how](F.col(n)).over(Window.partitionBy(*key)).alias(n) for n, (how, _) in totals.items()])
    local = base.withColumns({n: _LOCAL[how](c).over(frame([*key, SEG])) for n, (how, c) in out.items()})
    joined = local.join(carry, [*key, SEG], "left")
    return (joined.withColumns({n: _combine(how, F.col(n), F.col(f"_carry_{n}"))
                                for n, (how, _) in out.items()})
            .drop(SEG, *[f"_carry_{n}" for n in out]))


def numbered(df: DataFrame, key: Sequence[str], order: Sequence[str], name: str,
             splits: Splits | None = None, total: str | None = None) -> DataFrame:
    """0-based row number per key along ``order``, and the rows of the key as ``total`` if named.

    Rows that tie in ``order`` are numbered in any order, under either plan; give a unique order for repeatable numbers.
    """
    one = ("sum", F.lit(1).cast("long"))
    counted = running(df, key, order, {name: one}, splits=splits, totals={total: one} if total else None)
    return counted.withColumn(name, F.col(name) - 1)


def attach(df: DataFrame, per_key: DataFrame, key: Sequence[str], splits: Splits | None,
           spread_by: str = "start_ns", how: str = "left") -> DataFrame:
    """Join one row per key to all rows of the key.

    With splits a key may own most rows, so the rows meet their key's row in (key, segment of ``spread_by``): a heavy key
    in as many tasks as it has segments, a small one with one copy for each segment that it reaches.
    """
    if splits is None:
        return df.join(per_key, list(key), how)
    rows = cut(with_segment(df, spread_by, splits))
    met = rows.groupBy(*key, SEG).agg(F.count(F.lit(1)).alias("_rows")).drop("_rows")
    return rows.join(met.join(per_key, list(key)), [*key, SEG], how).drop(SEG)


def trailing(df: DataFrame, key: Sequence[str], index: str, lookback: int,
             columns: Callable[[Window], dict[str, Column]], splits: Splits | None = None,
             chunk: int = CHUNK_ROWS) -> DataFrame:
    """Add columns over row frames that reach at most ``lookback`` rows back.

    ``index`` is the dense 0-based row number per key.  ``columns`` gets the ordered window and returns
    the expressions.
    """
    if splits is None:
        return df.withColumns(columns(Window.partitionBy(*key).orderBy(index)))
    size = max(chunk, lookback)
    own = F.floor(F.col(index) / size)
    spread = df.withColumn(CHUNK, F.explode(
        F.when(F.col(index) % size >= size - lookback, F.array(own, own + 1)).otherwise(F.array(own))))
    spread = spread.withColumn(HALO, F.col(CHUNK) != own)
    full = spread.withColumns(columns(Window.partitionBy(*key, CHUNK).orderBy(index)))
    return full.filter(~F.col(HALO)).drop(CHUNK, HALO)


def linear(p: float) -> Callable[[Column], tuple[Column, Column, Column]]:
    """Linear interpolation between closest ranks, as numpy and ``percentile`` do."""
    def ranks(n: Column):
        exact = F.lit(float(p)) * (n - 1)
        low = F.floor(exact)
        return low, F.ceil(exact), exact - low
    return ranks


def nearest(rank: Callable[[Column], Column]) -> Callable[[Column], tuple[Column, Column, Column]]:
    """The value at a 0-based rank computed from the count."""
    def ranks(n: Column):
        r = rank(n)
        return r, r, F.lit(0.0)
    return ranks


def value_splits(splits):
    """Splits for ordering values of a table whose time splits are known: none needed where no key was large."""
    return None if splits is None else AUTO


def order_statistics(df: DataFrame, key: Sequence[str], value: str, picks: dict[str, Callable],
                     splits=AUTO, extras: dict[str, Callable[[Column, Column], Column]] | None = None,
                     weight: str | None = None) -> DataFrame:
    """Exact order statistics per key: one row per key with ``n`` and one double per pick.

    ``extras`` are further aggregates over (value, count) of the same histogram, so that counts, sums and
    ranks of a value come from one pass.  A row counts ``weight`` times, so that a kept histogram is read as its rows would be.
    """
    key = list(key)
    hist = (df.filter(F.col(value).isNotNull()).groupBy(*key, value)
            .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("_c")))
    splits = resolve(splits, hist, value, key)
    cum = running(hist, key, [value], {"_before": ("sum", F.col("_c"))}, inclusive=False, splits=splits,
                  totals={"n": ("sum", F.col("_c"))})
    ends = {name: ranks(F.col("n")) for name, ranks in picks.items()}

    def at(rank: Column) -> Column:
        inside = (F.col("_before") <= rank) & (rank < F.col("_before") + F.col("_c"))
        return F.max(F.when(inside, F.col(value).cast("double")))

    extras = {n: f(F.col(value), F.col("_c")) for n, f in (extras or {}).items()}
    aggs = [F.max("n").alias("n"), *[c.alias(n) for n, c in extras.items()]]
    for name, (low, high, fraction) in ends.items():
        aggs += [at(low).alias(f"_lo_{name}"), at(high).alias(f"_hi_{name}"),
                 F.max(fraction).alias(f"_fr_{name}")]
    picked = cum.groupBy(*key).agg(*aggs)
    return picked.select(*key, "n", *extras, *[
        (F.col(f"_lo_{n}") + (F.col(f"_hi_{n}") - F.col(f"_lo_{n}")) * F.col(f"_fr_{n}")).alias(n)
        for n in picks])
