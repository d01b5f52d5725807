"""Reliability, calibration and the confidence published with a safe window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import allowed_probe, compose_confidence, data_confidence, drift_confidence, has_flag, ratio
from ..scale import AUTO, attach, resolve

KEY = tuple(K.PATH_KEY)


def _edges(n_bins: int) -> list[float]:
    return [i * (1.0 / n_bins) for i in range(n_bins)] + [1.0]


def bin_of(p: Column, n_bins: int, closed: str = "left") -> Column:
    """0-based bin of p: ``left`` bins are [lo, hi), so p = 1 has none; ``right`` bins are (lo, hi], so p = 0
    has none.  No bin is null."""
    edges = _edges(n_bins)
    above = [(p >= e) if closed == "left" else (p > e) for e in edges]
    place = sum((c.cast("int") for c in above[1:]), above[0].cast("int")) - 1
    return F.when((place >= 0) & (place < n_bins), place)


def _per_bin(pred: DataFrame, n_bins: int, by: Sequence[str], closed: str) -> DataFrame:
    """Count, sum of labels and sum of p of every bin, empty ones too, in one pass over the predictions."""
    binned = pred.withColumn("_bin", bin_of(F.col("p"), n_bins, closed))
    aggs = [F.count(F.lit(1)).alias("_total")]
    for i in range(n_bins):
        here = F.col("_bin") == i
        aggs += [F.count_if(here).alias(f"_c{i}"), F.sum(F.when(here, F.col("label"))).alias(f"_l{i}"),
                 F.sum(F.when(here, F.col("p"))).alias(f"_p{i}")]
    edges = _edges(n_bins)
    rows = F.array(*[F.struct(
        F.lit(i).alias("bin"), F.lit(edges[i]).alias("lower"), F.lit(edges[i + 1]).alias("upper"),
        F.col(f"_c{i}").alias("count"), F.coalesce(F.col(f"_l{i}"), F.lit(0)).cast("double").alias("labels"),
        F.coalesce(F.col(f"_p{i}"), F.lit(0.0)).alias("probs")) for i in range(n_bins)])
    return binned.groupBy(*by).agg(*aggs).withColumn("_b", F.explode(rows)).select(*by, "_b.*", "_total")


def reliability_curve(pred: DataFrame, n_bins: int = 10, by: Sequence[str] = ("horizon_ns",)) -> DataFrame:
    """Confidence, accuracy, count and share per (lo, hi] bin; an empty bin reports its centre."""
    full = F.col("count") > 0
    return _per_bin(pred, n_bins, by, "right").select(
        *by, "bin", "lower", "upper",
        F.when(full, F.col("probs") / F.col("count")).otherwise((F.col("lower") + F.col("upper")) / 2).alias("confidence"),
        F.when(full, F.col("labels") / F.col("count")).otherwise(0.0).alias("accuracy"), "count",
        (F.col("count") / F.col("_total")).alias("proportion"))


def expected_calibration_error(curve: DataFrame, by: Sequence[str] = ("horizon_ns",)) -> DataFrame:
    """Sum over bins of share * |confidence - accuracy|."""
    return curve.groupBy(*by).agg(
        F.sum(F.col("proportion") * F.abs(F.col("confidence") - F.col("accuracy"))).alias("ece"))


def table_calibration_error(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The same from a calibration table, which knows only the bin centres."""
    centre = (F.col("lower") + F.col("upper")) / 2
    return table.groupBy(*by).agg((F.sum(F.col("count") * F.abs(F.col("accuracy") - centre))
                                   / F.greatest(F.lit(1), F.sum("count"))).alias("ece"))


def brier(pred: DataFrame, by: Sequence[str] = ("horizon_ns",)) -> DataFrame:
    miss = F.col("p") - F.col("label")
    return pred.groupBy(*by).agg(F.avg(miss * miss).alias("brier"), F.avg("p").alias("avg_confidence"),
                                 F.avg("label").alias("avg_accuracy"), F.count(F.lit(1)).alias("n"))


def fit_calibration(pred: DataFrame, n_bins: int = 10, by: Sequence[str] = ()) -> DataFrame:
    """Accuracy and count per [lo, hi) bin, empty bins included."""
    return _per_bin(pred, n_bins, by, "left").select(
        *by, "bin", "lower", "upper", ratio(F.col("labels"), F.col("count")).alias("accuracy"), "count")


def apply_calibration(pred: DataFrame, table: DataFrame, n_bins: int = 10, by: Sequence[str] = (),
                      min_count: int = 5) -> DataFrame:
    """Accuracy of the bin where it holds enough samples, else the raw p; values outside [0, 1] are clamped.

    The table has ``n_bins`` rows, or that many per horizon, so it is broadcast.  Grouped by anything whose
    number of values is not fixed, the join is left to the optimizer.
    """
    small = table.select(*by, F.col("bin").alias("_bin"), F.col("accuracy").alias("_acc"), F.col("count").alias("_cnt"))
    if set(by) <= {"horizon_ns"}:
        small = F.broadcast(small)
    p = F.col("p")
    joined = pred.withColumn("_bin", bin_of(p, n_bins)).join(small, [*by, "_bin"], "left")
    value = (F.when(p < 0, 0.0).when(p > 1, 1.0)
             .when(F.col("_cnt") >= min_count, F.col("_acc")).otherwise(p))
    return joined.withColumn("p_calibrated", value).drop("_bin", "_acc", "_cnt")


def merge_calibration(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Table of both samples together: counts add, accuracies weigh by count."""
    hits = F.sum(F.col("accuracy") * F.col("count"))
    n = F.sum("count")
    return a.unionByName(b).groupBy(*by, "bin", "lower", "upper").agg(
        ratio(hits, n).alias("accuracy"), n.alias("count"))


def quality_ratios(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Shares of unknown-path, asynchronous and dropped records per path, and the data confidence they give."""
    def share(bit: int) -> Column:
        return F.avg(has_flag("quality_flags", bit).cast("double"))
    out = df.groupBy(*key).agg(share(K.FLAG_UNKNOWN_PATH).alias("unknown_path_ratio"),
                               share(K.FLAG_ASYNC_UNCERTAINTY).alias("async_uncertainty_ratio"),
                               share(K.FLAG_RING_DROP).alias("drop_rate"), F.count(F.lit(1)).alias("n"))
    return out.withColumn("data_confidence", data_confidence(
        F.col("drop_rate"), F.col("unknown_path_ratio"), F.col("async_uncertainty_ratio")))


def with_window_verdict(df: DataFrame) -> DataFrame:
    """Allowed class and reason from ``confidence``."""
    return df.withColumns({
        "allowed_probe_type": allowed_probe(F.col("confidence")),
        "reason_code": F.when(F.col("confidence") >= K.ETA_TINY, K.REASON_SAFE).otherwise(K.REASON_LOW_CONFIDENCE)})


def recent_gaps(gaps: DataFrame, n: int, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Last ``n`` gaps of each path, found by number, so no window over a whole path is needed."""
    last = gaps.groupBy(*key).agg(F.max("gap_idx").alias("_last"))
    return attach(gaps, last, key, resolve(splits, gaps, "start_ns", key), how="inner").filter(F.col("gap_idx") > F.col("_last") - n).drop("_last")


def safe_windows(gaps: DataFrame, horizons: Sequence[int], key: Sequence[str] = KEY, win: int = 100,
                 min_samples: int = 10, bound_q: float = 0.05, bound_min: int = 20, splits=AUTO) -> DataFrame:
    """One window per path and horizon from the trailing survival estimate, when no model is fitted."""
    recent = recent_gaps(gaps, win, key, splits)
    x = F.col("duration_ns")
    n = F.count(F.lit(1))
    stats = recent.groupBy(*key).agg(
        n.alias("history"), F.max("end_ns").alias("t_publish"),
        F.when(n >= bound_min, F.percentile(x, bound_q)).otherwise(0.0).cast("long").alias("g_lower_bound"),
        *[F.when(n >= min_samples, F.avg((x >= h).cast("double"))).otherwise(0.0).alias(f"_s{i}")
          for i, h in enumerate(horizons)])
    pairs = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon_ns"), F.col(f"_s{i}").alias("p"))
                      for i, h in enumerate(horizons)])
    out = stats.withColumn("_h", F.explode(pairs)).select(
        *key, "t_publish", "g_lower_bound", "history", "_h.horizon_ns", F.round("_h.p", 4).alias("p_safe"),
        F.round("_h.p", 4).alias("confidence"))
    return with_window_verdict(out)


def model_safe_windows(scored: DataFrame, table: DataFrame, bounds: DataFrame, key: Sequence[str] = KEY,
                       n_bins: int = 10, drift: str = "drift_score") -> DataFrame:
    """Windows from model probabilities: calibrated, lowered by data quality and drift.

    ``scored`` has key, gap_idx, horizon_ns, p, the drift score and, if known, the three quality ratios.
    ``bounds`` has g_lower_bound per key and gap.
    """
    def given(name: str) -> Column:
        return F.col(name) if name in scored.columns else F.lit(0.0)
    calibrated = apply_calibration(scored, table, n_bins)
    data = data_confidence(given("drop_rate"), given("unknown_path_ratio"), given("async_uncertainty_ratio"))
    out = calibrated.withColumn("confidence", compose_confidence(
        F.col("p"), F.col("p_calibrated"), data, drift_confidence(given(drift))))
    out = out.join(bounds.select(*key, "gap_idx", "g_lower_bound"), [*key, "gap_idx"], "left")
    return with_window_verdict(out.select(*key, "gap_idx", "horizon_ns", F.col("p").alias("p_safe"), "confidence",
                                          F.col("g_lower_bound").cast("long").alias("g_lower_bound")))


def prediction_feedback(windows: DataFrame, outcomes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """What a published window promised against what the probe in that gap met."""
    seen = outcomes.select(*key, "gap_idx", F.col("gap_during_probe_ns").alias("actual_idle_ns"), "probe_type",
                           (F.col("end_ns") - F.col("start_ns")).alias("probe_duration_ns"),
                           (F.col("busy_overlap_ns") > 0).alias("overlap_flag"))
    promised = windows.select(*key, "gap_idx", F.col("g_lower_bound").alias("predicted_lower_ns"))
    return promised.join(seen, [*key, "gap_idx"]).withColumn(
        "prediction_error", F.col("predicted_lower_ns") - F.col("actual_idle_ns"))
