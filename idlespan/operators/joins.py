"""Joins that the analyses imply.  Catalyst picks the strategy; a side is broadcast only if its size is fixed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import ratio
from ..scale import AUTO, numbered, resolve
from .ranking import top_paths

KEY = tuple(K.PATH_KEY)


def align_gap_busy(gaps: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Each gap with the busy interval of the same number, which is the one right before it."""
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    counted = numbered(busy, key, ["start_ns"], "gap_idx", splits)
    return gaps.join(counted.select(*key, "gap_idx", F.col("start_ns").alias("busy_start_ns"),
                                    F.col("end_ns").alias("busy_end_ns"), "bytes_total"), [*key, "gap_idx"])


def top_path_semi(df: DataFrame, n: int = 8, key: Sequence[str] = KEY) -> DataFrame:
    """Rows of the ``n`` busiest paths; the list of paths has at most ``n`` rows, so it is broadcast."""
    return df.join(F.broadcast(top_paths(df, n, key).select(*key)), list(key), "left_semi")


def compare_runs(a: DataFrame, b: DataFrame, on: Sequence[str], metrics: Sequence[str]) -> DataFrame:
    """Metric values of two runs side by side with ``delta_* = b - a``."""
    left = a.select(*on, *[F.col(m).alias(f"a_{m}") for m in metrics])
    right = b.select(*on, *[F.col(m).alias(f"b_{m}") for m in metrics])
    return left.join(right, list(on)).withColumns(
        {f"delta_{m}": F.col(f"b_{m}") - F.col(f"a_{m}") for m in metrics})


def explode_values(df: DataFrame, name: str, values: Sequence, kind: str) -> DataFrame:
    return df.withColumn(name, F.explode(F.array(*[F.lit(v).cast(kind) for v in values])))


def explode_horizons(df: DataFrame, horizons: Sequence[int] = K.HORIZONS_NS) -> DataFrame:
    """One row per horizon; a literal list, so neither a join nor a shuffle."""
    return explode_values(df, "horizon_ns", horizons, "long")


def explode_settings(df: DataFrame, etas: Sequence[float], name: str = "eta") -> DataFrame:
    return explode_values(df, name, etas, "double")


def cohort_compare(df: DataFrame, cohort: Column, hit: Column, by: Sequence[str], min_rows: int = 5) -> DataFrame:
    """Share of ``hit`` in both cohorts of each group; groups too small in either are left out."""
    yes, late = hit.cast("int"), cohort
    out = df.groupBy(*by).agg(
        F.count_if(~late).alias("n_early"), F.count_if(late).alias("n_late"),
        F.sum(F.when(~late, yes)).alias("_e"), F.sum(F.when(late, yes)).alias("_l"))
    early, after = ratio(F.col("_e") * 100.0, F.col("n_early")), ratio(F.col("_l") * 100.0, F.col("n_late"))
    return (out.filter((F.col("n_early") >= min_rows) & (F.col("n_late") >= min_rows))
            .select(*by, "n_early", "n_late", early.alias("early_pct"), after.alias("late_pct"),
                    (after - early).alias("delta_pp")))
