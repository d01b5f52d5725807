"""Quantile sketches that are kept and merged, so that a profile over more passes reads no row again.

A KLL sketch of k items answers a rank within about 2.3 / k**0.92 of the rows (``rank_error`` rounds that up), whatever their number and
however often it was merged.  It is built by partial aggregation and is a few KB, so a table with one per path and pass stays small.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ITEMS = 400


def rank_error(items: int = ITEMS) -> float:
    """How far a rank may be off, as a share of the rows."""
    return 4.0 / items ** 0.92


def quantile_sketches(df: DataFrame, value: str, key: Sequence[str], items: int = ITEMS) -> DataFrame:
    """``key``, ``n``, ``low``, ``high`` and the ``sketch`` of every key.  Null values are left out; a key without values has none."""
    x = F.col(value).cast("double")
    rows = df.filter(x.isNotNull()).withColumn("_x", x)
    return rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.min("_x").alias("low"), F.max("_x").alias("high"),
                                  F.kll_sketch_agg_double("_x", F.lit(items)).alias("sketch"))


def merge_sketches(sketches: DataFrame, key: Sequence[str]) -> DataFrame:
    """The sketches of a coarser key, from sketches alone."""
    return sketches.groupBy(*key).agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"),
                                      F.kll_merge_agg_double("sketch").alias("sketch"))


def sketched_quantiles(sketches: DataFrame, key: Sequence[str], ps: Sequence[float]) -> DataFrame:
    """``key``, ``p``, ``n`` and the ``value`` that about a share ``p`` of the rows does not exceed; 0 and 1 are the exact extremes."""
    def value(p: float):
        if 0 < p < 1:
            return F.kll_sketch_get_quantile_double("sketch", F.lit(p))
        return F.col("low" if p <= 0 else "high")
    picks = F.array(*[F.struct(F.lit(p).alias("p"), value(p).alias("value")) for p in map(float, ps)])
    return sketches.select(*key, "n", F.explode(picks).alias("_p")).select(*key, "_p.p", "n", "_p.value")
