"""Greedy chains: from each chosen row to the first later row that may be chosen.

"At least a period between two probes" and "one probe of a path at a time" are such chains.  They look sequential, since whether a row is
chosen depends on which were chosen before it, but where a chain goes *from* a row does not.  So:

1. Every row gets its successor, the first later row that starts when this one has let go: one as-of lookup over all rows, by running
   aggregates that split a heavy key into segments.
2. A row that starts when everything before it has let go is chosen whatever happened before.  Those are the roots, and chains end
   there.  Rows that are no root and nobody's successor are never chosen.
3. Between roots the chosen rows are found by pointer doubling: after k rounds all rows within 2^k steps of a root are marked, and every pointer
   leads 2^k steps on.  Rounds grow with the logarithm of the longest chain without a pause, not with the rows.

Rows are known by (key, row number), so the joins of a heavy key are dealt over all tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import AUTO, numbered, resolve, running
from ..session import cut

ROW = "_row"


def successors(rows: DataFrame, key: Sequence[str], splits) -> DataFrame:
    """``key``, row, ``root``, ``next`` (row; null at the end) of rows (``key``, row, ``t``, ``until``) whose row numbers follow ``t``."""
    key = list(key)
    none = F.lit(None).cast("long")
    starts = rows.select(*key, "t", F.lit(1).alias("rank"), F.col(ROW).alias("at"), "until", none.alias("asks"))
    asks = rows.select(*key, F.col("until").alias("t"), F.lit(0).alias("rank"), none.alias("at"), none.alias("until"), F.col(ROW).alias("asks"))
    order = ["t", "rank", "at"]
    points = running(starts.unionByName(asks), key, order, {"_held": ("max", F.col("until"))}, inclusive=False, splits=splits)
    points = running(points, key, order, {"_first": ("last", F.col("at"))}, reverse=True, splits=splits)
    own = F.coalesce("at", "asks")
    free = F.when(F.col("at").isNotNull(), F.col("_held").isNull() | (F.col("t") >= F.col("_held")))
    after = F.when(F.col("asks").isNotNull(), F.greatest(F.col("_first"), F.when(F.col("_first").isNotNull(), F.col("asks") + 1)))
    return points.groupBy(*key, own.alias(ROW)).agg(F.max(free).alias("root"), F.max(after).alias("next"))


def _inner(links: DataFrame, key: list[str]) -> DataFrame:
    """Rows that only a chain can choose, with the roots that lead to them; pointers to roots end."""
    led = links.filter("next is not null").select(*key, F.col("next").alias(ROW)).distinct()
    inner = links.filter("not root").join(led, [*key, ROW], "left_semi")
    live = inner.unionByName(links.filter("root"))
    ends = inner.select(*key, F.col(ROW).alias("next"), F.lit(True).alias("_inner"))
    return live.join(ends, [*key, "next"], "left").select(
        *key, ROW, "root", F.when(F.col("_inner"), F.col("next")).alias("next"), F.col("root").alias("marked")).filter("not root or next is not null")


def greedy_chain(df: DataFrame, key: Sequence[str], at: str, until: Column, name: str = "chosen", tie: Sequence[str] = (),
                 splits=AUTO) -> DataFrame:
    """Mark the rows of a greedy chain per key along ``at``: the first, then each first later row at or after ``until`` of the last marked one.

    ``until`` before ``at`` counts as ``at``, and a null one lets go at once; then the very next row follows.  Rows that tie in ``at`` go in the
    order of ``tie``, and without one in any order, of which one is kept for the whole run.  Rows without ``at`` are not marked.
    Exact for any number of rows of a key.
    """
    key = list(key)
    splits = resolve(splits, df, at, key)
    rows = cut(numbered(df, key, [at, *tie], ROW, splits))
    marks = rows.filter(F.col(at).isNotNull()).select(*key, ROW, F.col(at).alias("t"), F.greatest(F.col(at), until).alias("until"))
    links = cut(successors(marks, key, splits))
    live = cut(_inner(links, key))
    while not live.filter("marked and next is not null").isEmpty():
        hit = live.filter("marked and next is not null").select(*key, F.col("next").alias(ROW), F.lit(True).alias("_hit"))
        hop = live.select(*key, F.col(ROW).alias("next"), F.col("next").alias("_further"))
        live = cut(live.join(hop, [*key, "next"], "left").join(hit, [*key, ROW], "left").select(
            *key, ROW, "root", F.col("_further").alias("next"), (F.col("marked") | F.coalesce("_hit", F.lit(False))).alias("marked")))
    chosen = links.filter("root").select(*key, ROW).unionByName(live.filter("marked and not root").select(*key, ROW))
    found = rows.join(chosen.withColumn(name, F.lit(True)), [*key, ROW], "left")
    return found.select(*[F.col(f"`{c}`") for c in df.columns if c != name], F.coalesce(name, F.lit(False)).alias(name))


def with_spacing(df: DataFrame, period: int, key: Sequence[str], at: str = "start_ns", name: str = "chosen", tie: Sequence[str] = (),
                 splits=AUTO) -> DataFrame:
    """Mark a chain per key of rows at least ``period`` apart, each as early as it can be.  Of rows that tie at most one is marked."""
    return greedy_chain(df, key, at, F.col(at) + F.lit(period).cast("long"), name, tie, splits)
