"""Trailing-window features of gaps and busy intervals.

Every operator takes ``splits``: the answer of ``plan_splits`` for the source table, or ``None`` when its
largest path is known to fit one task.  ``AUTO`` counts the rows per key first.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import path_label
from ..scale import AUTO, attach, numbered, resolve, running, trailing
from .sliding import sliding_quantiles

KEY = tuple(K.PATH_KEY)


def number_gaps(gaps: DataFrame, key: Sequence[str] = KEY, order: Sequence[str] = ("start_ns",),
                name: str = "gap_idx", splits=AUTO) -> DataFrame:
    return numbered(gaps, key, list(order), name, resolve(splits, gaps, order[0], key))


def gap_features(gaps: DataFrame, key: Sequence[str] = KEY, win: int = 50, min_history: int = 1,
                 splits=AUTO) -> DataFrame:
    """Seven statistics of the ``win`` gaps before each gap; the gap itself is never in its own history."""
    splits = resolve(splits, gaps, "start_ns", key)
    x = F.greatest(F.col("duration_ns").cast("double"), F.lit(1.0))

    def columns(w):
        frame = w.rowsBetween(-win, -1)
        return {"_p": F.percentile(x, F.array(F.lit(0.1), F.lit(0.5), F.lit(0.9))).over(frame),
                "f_gap_mean": F.avg(x).over(frame), "f_gap_std": F.stddev_pop(x).over(frame),
                "f_gap_last": F.lag(x, 1).over(w), "f_gap_last5_mean": F.avg(x).over(w.rowsBetween(-5, -1))}
    out = trailing(gaps, key, "gap_idx", win, columns, splits)
    return (out.withColumns({f"f_gap_p{p}": F.get("_p", F.lit(i)) for i, p in enumerate((10, 50, 90))})
            .drop("_p").filter(F.col("gap_idx") >= min_history))


def burst_features(busy: DataFrame, key: Sequence[str] = KEY, win: int = 50, splits=AUTO) -> DataFrame:
    """Per non-empty busy interval, statistics of the ``win`` lengths up to it, keyed by its number.

    ``f_burst_rate`` is intervals in the window per second since the first interval of the path.
    """
    splits = resolve(splits, busy, "start_ns", key)
    length = F.col("end_ns") - F.col("start_ns")
    first = running(busy.select(*key, "start_ns", "end_ns"), key, ["start_ns"],
                    {"_first": ("min", F.col("start_ns"))}, splits=splits)
    bursts = first.withColumn("burst_ns", length.cast("double")).filter(F.col("burst_ns") > 0)
    bursts = numbered(bursts, key, ["start_ns"], "burst_idx", splits)
    x = F.col("burst_ns")

    def columns(w):
        frame = w.rowsBetween(-(win - 1), 0)
        return {"_p": F.percentile(x, F.array(F.lit(0.5), F.lit(0.9))).over(frame),
                "f_burst_mean": F.avg(x).over(frame), "_n": F.count(x).over(frame)}
    out = trailing(bursts, key, "burst_idx", win, columns, splits)
    span_s = F.greatest((F.col("end_ns") - F.col("_first")) / 1e9, F.lit(0.001))
    return out.select(*key, "burst_idx", F.get("_p", F.lit(0)).alias("f_burst_p50"),
                      F.get("_p", F.lit(1)).alias("f_burst_p90"), "f_burst_mean",
                      (F.col("_n") / span_s).alias("f_burst_rate"),
                      F.col("burst_ns").alias("f_burst_last_duration"))


def event_rate(gaps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """Gaps per second of each path, over a span of at least 1 ms."""
    span = (F.max("end_ns") - F.min("start_ns")) / 1e9
    return gaps.groupBy(*key).agg((F.count(F.lit(1)) / F.greatest(span, F.lit(0.001))).alias("event_rate"))


def feature_rows(gaps: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, win: int = 50,
                 min_history: int = 50, direction: Column | int = K.D2H, causal: bool = False,
                 splits=AUTO) -> DataFrame:
    """One row per gap with the 30 feature columns, from history that ends before the gap.

    ``causal=False`` keeps the published constants: burst rate 0 and one look-ahead event rate per path.
    ``causal=True`` fills both from the past only.
    """
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    rows = gap_features(gaps, key, win, min_history, splits)
    bursts = burst_features(busy, key, win, splits)
    last = bursts.groupBy(*key).agg(F.max_by(F.struct("burst_idx", *K.BURST_FEATURES), "burst_idx").alias("_last"))
    rows = attach(rows, last, key, splits).withColumn("burst_idx", F.col("gap_idx") - 1)
    # gaps beyond the last burst take it from the path's row, so that they do not all meet at one index
    past = F.col("burst_idx") > F.col("_last.burst_idx")
    rows = rows.join(bursts, [*key, "burst_idx"], "left").withColumns(
        {c: F.when(past, F.col(f"_last.{c}")).otherwise(F.col(c)) for c in K.BURST_FEATURES}).drop("burst_idx", "_last")
    if causal:
        rows = running(rows, key, ["start_ns"], {"_from": ("min", F.col("start_ns"))}, splits=splits)
        span_s = F.greatest((F.col("start_ns") - F.col("_from")) / 1e9, F.lit(0.001))
        rows = rows.withColumn("f_ebpf_event_rate", F.col("gap_idx") / span_s).drop("_from")
    else:
        rates = event_rate(gaps, key).withColumnRenamed("event_rate", "f_ebpf_event_rate")
        rows = attach(rows, rates, key, splits).withColumn("f_burst_rate", F.lit(0.0))
    code = F.lit(direction) if isinstance(direction, int) else direction
    zero = F.lit(0.0)
    rows = rows.withColumns({
        **{name: F.coalesce(name, zero) for name in K.BURST_FEATURES},
        "path_id": path_label(key),
        "f_idle_age_ns": zero,
        "f_direction_code": code.cast("double"),
        "f_cross_numa_flag": zero,
        **{name: zero for group in ("stream", "phase", "quality", "time") for name in K.FEATURE_GROUPS[group]},
        "f_cpu_usage_pct": F.lit(50.0), "f_npu_util_pct": F.lit(50.0)})
    rows = rows.withColumn("f_path_id_norm", F.col("path_id") / 65536.0)
    return rows.select(*key, "path_id", "gap_idx", "start_ns", "end_ns", "duration_ns", *K.FEATURE_NAMES)


def ewma(gaps: DataFrame, key: Sequence[str] = KEY, alpha: float = 0.1, value: str = "duration_ns",
         name: str = "ewma") -> DataFrame:
    """e0 = x0; ei = alpha * xi + (1 - alpha) * e(i-1), exact to double precision.

    Rows are grouped in chunks of C, where (1 - alpha)^C is below double precision, and every chunk also
    sees the chunk before it.  Inside such a pair the recurrence is a weighted prefix sum, so the cost per
    row is constant and no path has to fit a task.
    """
    decay = 1.0 - alpha
    if decay == 0:
        return gaps.withColumn(name, F.col(value).cast("double"))
    size = max(2, math.ceil(math.log(1e-16) / math.log(decay)))
    own = F.floor(F.col("gap_idx") / size)
    spread = gaps.withColumn("_chunk", F.explode(F.array(own, own + 1)))
    place = (F.col("gap_idx") - (F.col("_chunk") - 1) * size).cast("double")
    weight = F.when(F.col("gap_idx") == 0, F.lit(1.0)).otherwise(F.lit(alpha))
    term = F.col(value) * weight * F.pow(F.lit(decay), -place)
    frame = (Window.partitionBy(*key, "_chunk").orderBy("gap_idx")
             .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return (spread.withColumn(name, F.sum(term).over(frame) * F.pow(F.lit(decay), place))
            .filter(F.col("_chunk") == own).drop("_chunk"))


def trailing_survival(gaps: DataFrame, horizons: Sequence[int], key: Sequence[str] = KEY, win: int = 100,
                      min_samples: int = 10, causal: bool = True, penalise_short: bool = False,
                      splits=AUTO) -> DataFrame:
    """Long form: share of the last ``win`` gaps of at least each horizon; 0 on a short history.

    ``causal`` ends the history before the gap.  ``penalise_short`` halves the share where the trailing
    p10 is below the horizon (the quantile baseline).
    """
    splits = resolve(splits, gaps, "start_ns", key)
    x = F.col("duration_ns")

    def columns(w):
        frame = w.rowsBetween(-win, -1) if causal else w.rowsBetween(-(win - 1), 0)
        out = {f"_s{i}": F.avg((x >= h).cast("double")).over(frame) for i, h in enumerate(horizons)}
        out["history"] = F.count(x).over(frame)
        if penalise_short:
            out["_p10"] = F.percentile(x, 0.1).over(frame)
        return out
    rows = trailing(gaps, key, "gap_idx", win, columns, splits)

    def share(i: int, h: int) -> Column:
        s = F.col(f"_s{i}")
        if penalise_short:
            s = F.when(F.col("_p10") < h, s * 0.5).otherwise(s)
        return F.when(F.col("history") >= min_samples, s).otherwise(0.0)
    pairs = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon_ns"), share(i, h).alias("p"))
                      for i, h in enumerate(horizons)])
    return (rows.withColumn("_h", F.explode(pairs))
            .select(*gaps.columns, "history", "_h.*"))


def quantile_survival(gaps: DataFrame, horizons: Sequence[int], key: Sequence[str] = KEY, win: int = 100,
                      min_samples: int = 10, causal: bool = True, splits=AUTO) -> DataFrame:
    return trailing_survival(gaps, horizons, key, win, min_samples, causal, True, splits)


def trailing_quantile(gaps: DataFrame, q: float = 0.1, key: Sequence[str] = KEY, win: int = 100,
                      min_samples: int = 10, causal: bool = True, name: str = "quantile",
                      splits=AUTO) -> DataFrame:
    """Linear quantile of the trailing window, 0 on a short history."""
    splits = resolve(splits, gaps, "start_ns", key)
    rows = sliding_quantiles(gaps, key, "gap_idx", "duration_ns", {"_q": q}, win, causal, splits)
    return rows.withColumn(name, F.when(F.col("_n") >= max(min_samples, 1), F.col("_q")).otherwise(0.0)) \
        .drop("_n", "_q")


def lower_bound(gaps: DataFrame, q: float = 0.05, key: Sequence[str] = KEY, win: int = 100,
                min_samples: int = 20, causal: bool = True, splits=AUTO) -> DataFrame:
    """Conservative bound of the next gap."""
    return trailing_quantile(gaps, q, key, win, min_samples, causal, "g_lower_bound", splits)


def rolling_stats(df: DataFrame, key: Sequence[str] = KEY, value: str = "duration_ns", win: int = 100,
                  splits=AUTO) -> DataFrame:
    """Mean and sample deviation of the window that ends at the row, and the change of the row against the
    mean of the window before it (0 where that mean is below 1)."""
    splits = resolve(splits, df, "start_ns", key)
    x = F.col(value)

    def columns(w):
        now, prior = w.rowsBetween(-(win - 1), 0), w.rowsBetween(-win, -1)
        return {"roll_mean": F.avg(x).over(now), "roll_std": F.coalesce(F.stddev_samp(x).over(now), F.lit(0.0)),
                "_mu": F.avg(x).over(prior)}
    rows = trailing(df, key, "gap_idx", win, columns, splits)
    return rows.withColumn("relative_change", F.when(F.col("_mu") >= 1.0, F.abs(x - F.col("_mu")) / F.col("_mu"))
                           .otherwise(0.0)).drop("_mu")


def drift_score(features: DataFrame, columns: Sequence[str], key: Sequence[str] = KEY, win: int = 200,
                threshold: float = 0.3, warmup: int | None = None, splits=AUTO) -> DataFrame:
    """Mean over features of min(|z| / 3, 1) against the trailing mean and deviation; 0 while warming up."""
    splits = resolve(splits, features, "start_ns", key)
    warmup = max(30, win // 4) if warmup is None else warmup

    def exprs(w):
        frame = w.rowsBetween(-win, -1)
        out = {"_n": F.count(F.lit(1)).over(frame)}
        for i, c in enumerate(columns):
            out[f"_m{i}"] = F.avg(c).over(frame)
            out[f"_d{i}"] = F.stddev_pop(c).over(frame)
        return out
    rows = trailing(features, key, "gap_idx", win, exprs, splits)
    parts = []
    for i, c in enumerate(columns):
        spread = F.when(F.col(f"_d{i}") < 1e-6, 1.0).otherwise(F.col(f"_d{i}"))
        parts.append(F.least(F.abs(F.col(c) - F.col(f"_m{i}")) / spread / 3.0, F.lit(1.0)))
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    score = F.when(F.col("_n") >= warmup, total / len(columns)).otherwise(0.0)
    return (rows.withColumn("drift_score", score).withColumn("drifted", F.col("drift_score") > threshold)
            .drop("_n", *[f"_{m}{i}" for i in range(len(columns)) for m in "md"]))


def phase_shift(gaps: DataFrame, key: Sequence[str] = KEY, win: int = 50, threshold: float = 0.3,
                splits=AUTO) -> DataFrame:
    """Whether the mean of the last ``win`` gaps left the mean of all gaps before them by ``threshold``."""
    splits = resolve(splits, gaps, "start_ns", key)
    x = F.col("duration_ns")
    rows = running(gaps, key, ["start_ns"], {"_all": ("sum", x.cast("decimal(20,0)"))}, splits=splits)

    def columns(w):
        return {"_recent": F.sum(x).over(w.rowsBetween(-(win - 1), 0))}
    rows = trailing(rows, key, "gap_idx", win, columns, splits)
    older = (F.col("_all") - F.col("_recent")).cast("double") / (F.col("gap_idx") + 1 - win)
    recent = F.col("_recent") / F.lit(float(win))
    shifted = (F.when(F.col("gap_idx") + 1 < 2 * win, False).when(older < 1.0, False)
               .otherwise(F.abs(recent - older) / older > threshold))
    return rows.withColumn("phase_shift", shifted).drop("_all", "_recent")


def consecutive_alarm(readings: DataFrame, n: int = 2, start: float | None = None, at: str = "t",
                      flag: str = "is_degraded", tie: Sequence[str] = (), key: Sequence[str] = (),
                      splits=AUTO) -> DataFrame:
    """First moment at which ``n`` readings in a row were degraded, and the delay from ``start``."""
    if start is not None:
        readings = readings.filter(F.col(at) >= start)
    splits = resolve(splits, readings, at, key)
    rows = numbered(readings, key, [at, *tie], "_idx", splits)

    def columns(w):
        return {"_streak": F.sum(F.col(flag).cast("int")).over(w.rowsBetween(-(n - 1), 0))}
    rows = trailing(rows, key, "_idx", n, columns, splits)
    found = rows.groupBy(*key).agg(F.min(F.when(F.col("_streak") >= n, F.col(at))).alias("detected_at"))
    return found.withColumn("detection_latency", F.col("detected_at") - F.lit(start)
                            if start is not None else F.lit(None).cast("double"))


def history_snapshot(gaps: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, n_gaps: int = 64,
                     n_busy: int = 64, splits=AUTO) -> DataFrame:
    """For a policy that wants raw history: the last gap lengths and busy intervals before each gap."""
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    rows = trailing(gaps, key, "gap_idx", n_gaps, lambda w: {
        "previous_gaps": F.collect_list("duration_ns").over(w.rowsBetween(-n_gaps, -1))}, splits)
    numbered_busy = numbered(busy.select(*key, "start_ns", "end_ns"), key, ["start_ns"], "busy_idx", splits)
    held = trailing(numbered_busy, key, "busy_idx", n_busy, lambda w: {
        "previous_busy": F.collect_list(F.struct("start_ns", "end_ns")).over(w.rowsBetween(-(n_busy - 1), 0))},
        splits)
    held = held.select(*key, (F.col("busy_idx") + 1).alias("gap_idx"), "previous_busy")
    first = F.col("gap_idx") == 0
    only = (numbered_busy.filter("busy_idx = 0")
            .select(*key, F.lit(0).cast("long").alias("gap_idx"),
                    F.array(F.struct("start_ns", "end_ns")).alias("previous_busy")))
    return rows.join(held.filter(~first).unionByName(only), [*key, "gap_idx"], "left")
