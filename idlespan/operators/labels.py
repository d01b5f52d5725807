"""Horizon labels, training sets and the baselines that need no fitted model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..scale import AUTO, linear, order_statistics
from .aggregates import classification_metrics
from .joins import explode_horizons
from .windows import feature_rows

KEY = tuple(K.PATH_KEY)


def horizon_labels(df: DataFrame, horizons: Sequence[int] = K.HORIZONS_NS, value: str = "duration_ns") -> DataFrame:
    """Long form: one row per gap and horizon with label 1 when the gap reaches it."""
    return explode_horizons(df, horizons).withColumn("label", (F.col(value) >= F.col("horizon_ns")).cast("int"))


def horizon_label_columns(df: DataFrame, horizons: Sequence[int] = K.HORIZONS_NS,
                          value: str = "duration_ns") -> DataFrame:
    """Wide form: ``y_<horizon>`` columns."""
    return df.withColumns({f"y_{h}": (F.col(value) >= h).cast("int") for h in horizons})


def training_set(gaps: DataFrame, busy: DataFrame, key: Sequence[str] = KEY,
                 horizons: Sequence[int] = K.HORIZONS_NS, win: int = 50, min_history: int = 5,
                 splits=AUTO, **kw) -> DataFrame:
    """One row per gap: features from the gaps before it, labels from the gap itself."""
    return horizon_label_columns(feature_rows(gaps, busy, key, win, min_history, splits=splits, **kw), horizons)


def last_gap_training_set(gaps: DataFrame, busy: DataFrame, key: Sequence[str] = KEY,
                          horizons: Sequence[int] = K.HORIZONS_NS, win: int = 50, min_history: int = 5,
                          splits=AUTO) -> DataFrame:
    """One row per path: the row of its last gap."""
    last = gaps.groupBy(*key).agg(F.max("gap_idx").alias("gap_idx"))      # joined on key and number: no hot key
    return training_set(gaps, busy, key, horizons, win, min_history, splits).join(last, [*key, "gap_idx"], "left_semi")


# --- baselines --------------------------------------------------------------

def _with_rates(test: DataFrame, rates: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """Label the test rows and attach one probability per horizon.

    ``rates`` is a single row with one number per horizon; it is fetched and becomes literals of the plan.
    """
    row = rates.first()
    labelled = horizon_labels(test, horizons)
    p = F.lit(None).cast("double")
    for i, h in enumerate(horizons):
        p = F.when(F.col("horizon_ns") == h, F.lit(float(row[f"_r{i}"] or 0.0))).otherwise(p)
    return labelled.withColumn("p", p)


def base_rate_baseline(train: DataFrame, test: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """p = share of all training gaps that reach the horizon."""
    rates = train.agg(*[F.avg((F.col("duration_ns") >= h).cast("double")).alias(f"_r{i}")
                        for i, h in enumerate(horizons)])
    return _with_rates(test, rates, horizons)


def mean_threshold_baseline(train: DataFrame, test: DataFrame, horizons: Sequence[int]) -> DataFrame:
    """p = 1 when the mean training gap reaches the horizon, else 0."""
    mean = F.avg("duration_ns")
    rates = train.agg(*[(mean >= h).cast("double").alias(f"_r{i}") for i, h in enumerate(horizons)])
    return _with_rates(test, rates, horizons)


def trailing_baseline(train: DataFrame, test: DataFrame, horizons: Sequence[int], order: Sequence[str],
                      win: int = 100, min_samples: int = 10) -> DataFrame:
    """p = share of the last ``win`` training gaps, pooled over paths, that reach the horizon."""
    recent = train.orderBy(*[F.col(c).desc() for c in order]).limit(win)
    enough = F.count(F.lit(1)) >= min_samples
    rates = recent.agg(*[F.when(enough, F.avg((F.col("duration_ns") >= h).cast("double"))).otherwise(0.0)
                         .alias(f"_r{i}") for i, h in enumerate(horizons)])
    return _with_rates(test, rates, horizons)


def ewma_eval(train: DataFrame, test: DataFrame, horizons: Sequence[int], order: Sequence[str],
              win: int = 100, min_samples: int = 10) -> DataFrame:
    """Metrics of ``trailing_baseline`` per horizon."""
    return classification_metrics(trailing_baseline(train, test, horizons, order, win, min_samples))


def constant_model(train: DataFrame, horizon: int) -> DataFrame:
    """The one-class model: the mean label, as one row."""
    return train.agg(F.avg((F.col("duration_ns") >= horizon).cast("double")).alias("p")) \
        .select(F.lit(horizon).cast("long").alias("horizon_ns"), "p")


def lower_bound_flat(gaps: DataFrame, q: float = 0.05, key: Sequence[str] = (), min_samples: int = 10,
                     splits=AUTO) -> DataFrame:
    """Lower bound from all gaps of a key at once; 0 with fewer than ``min_samples``."""
    stats = order_statistics(gaps, key, "duration_ns", {"q": linear(q)}, splits)
    return stats.select(*key, "n", F.when(F.col("n") >= min_samples, F.col("q")).otherwise(0.0)
                        .alias("g_lower_bound"))
