"""Sorts, top-k, strides and row slices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..scale import AUTO, attach, numbered, resolve

KEY = tuple(K.PATH_KEY)


def sort_events(df: DataFrame, by: Sequence[str] = ("start_ns",)) -> DataFrame:
    """Range-partitioned global sort, for final output only; no operator needs sorted input."""
    return df.orderBy(*by)


def top_paths(df: DataFrame, n: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    return (df.groupBy(*key).agg(F.count(F.lit(1)).alias("events"))
            .orderBy(F.col("events").desc(), *key).limit(n))


def busiest_path(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return top_paths(df, 1, key)


def best_policies(metrics: DataFrame, min_probes: int = 100,
                  excluded: Sequence[str] = ("none", "oracle")) -> DataFrame:
    """The real policy with the highest bandwidth share, and the one with the lowest unsafe rate."""
    real = metrics.filter(~F.col("policy").isin(*excluded))
    enough = F.col("total_probes") > min_probes
    return real.agg(
        F.max_by("policy", F.struct("bw_ratio_pct", "policy")).alias("best_bandwidth"),
        F.max("bw_ratio_pct").alias("best_bw_ratio_pct"),
        F.min_by("policy", F.when(enough, F.struct("unsafe_rate_pct", "policy"))).alias("safest"),
        F.min(F.when(enough, F.col("unsafe_rate_pct"))).alias("lowest_unsafe_rate_pct"))


def first_k(df: DataFrame, k: int, order: Sequence[str], key: Sequence[str] = ()) -> DataFrame:
    """First ``k`` rows in order, overall or per key.

    Overall it is a top-k limit.  Per key the rank filter becomes a group limit on the map side, so at most
    ``k`` rows per key and task are shuffled.
    """
    if not key:
        return df.orderBy(*order).limit(k)
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_rank", rank).filter(F.col("_rank") <= k).drop("_rank")


def first_fraction(df: DataFrame, fraction: float, order: Sequence[str], splits=AUTO) -> DataFrame:
    """First ``int(n * fraction)`` rows in order."""
    rows = numbered(df, [], list(order), "_row", resolve(splits, df, order[0], []), total="_total")
    return rows.filter(F.col("_row") < F.floor(F.col("_total") * F.lit(fraction))).drop("_row", "_total")


def every_nth(df: DataFrame, k: int, index: str = "gap_idx", start: int = 0) -> DataFrame:
    """Rows start, start + k, ... of each key, by their row number."""
    return df.filter((F.col(index) >= start) & ((F.col(index) - start) % k == 0))


def min_rows_per_key(df: DataFrame, n: int, key: Sequence[str] = KEY, spread_by: str = "start_ns",
                     splits=AUTO) -> DataFrame:
    """Rows of the paths that have at least ``n`` of them: a count that combines map-side, joined back."""
    keep = df.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(*key)
    return attach(df, keep, key, resolve(splits, df, spread_by, key), spread_by, "left_semi")


def union_passes(*passes: DataFrame) -> DataFrame:
    """Append passes by column name; each keeps its label column."""
    out = passes[0]
    for more in passes[1:]:
        out = out.unionByName(more)
    return out


def new_gaps(now: DataFrame, before: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Gaps that an earlier poll had not seen."""
    return now.join(before.select(*key, "start_ns", "end_ns"), [*key, "start_ns", "end_ns"], "left_anti")


def smooth_by_n(df: DataFrame, order: Sequence[str], values: Sequence[str], n: int = 10,
                key: Sequence[str] = (), splits=AUTO) -> DataFrame:
    """Mean of every ``n`` consecutive readings."""
    rows = numbered(df, key, list(order), "_row", resolve(splits, df, order[0], key))
    return (rows.withColumn("block", F.floor(F.col("_row") / n)).groupBy(*key, "block")
            .agg(*[F.avg(v).alias(v) for v in values], F.count(F.lit(1)).alias("n")))

