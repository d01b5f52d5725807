"""Summaries of traces, gaps, probe readings and policy outcomes.  Plain aggregates combine map-side; exact
medians and ranks come from ``order_statistics``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import direction_label, has_flag, ratio, with_transfer_metrics
from ..scale import (AUTO, linear, nearest, numbered, order_statistics, resolve, running, trailing,
                     value_splits)
from .joins import cohort_compare
from .ranking import first_fraction

KEY = tuple(K.PATH_KEY)


def _count() -> Column:
    return F.count(F.lit(1))


# --- gaps -------------------------------------------------------------------

def gap_stats(gaps: DataFrame, key: Sequence[str] = KEY, paths: DataFrame | None = None,
              at_least: dict[str, int] | None = None, splits=AUTO, weight: str | None = None) -> DataFrame:
    """Count, extremes, nearest-rank p50 / p90 and total per path, all from one histogram pass.

    ``at_least`` adds counts of gaps of at least a length.  ``paths`` lists keys that must appear, with zeros
    when they have no gap.  ``splits`` are those of the gaps.  ``weight`` counts the gaps of a row, in a histogram of lengths.
    """
    key = list(key)
    wanted = {"min_ns": lambda v, c: F.min(v), "max_ns": lambda v, c: F.max(v), "total_ns": lambda v, c: F.sum(v * c)}
    for name, length in (at_least or {}).items():
        wanted[name] = lambda v, c, n=length: F.sum(F.when(v >= n, c).otherwise(0))
    out = order_statistics(gaps, key, "duration_ns", {
        "p50_ns": nearest(lambda n: F.floor(n / 2)), "p90_ns": nearest(lambda n: F.floor(n * F.lit(0.9)))},
        value_splits(splits), wanted, weight)
    out = out.select(*key, F.col("n").alias("count"), "min_ns", "max_ns", F.col("p50_ns").cast("long").alias("p50_ns"),
                     F.col("p90_ns").cast("long").alias("p90_ns"), "total_ns", *(at_least or {}))
    if paths is not None:
        out = paths.select(*key).distinct().join(out, key, "left")
    return out.fillna(0, [c for c in out.columns if c not in key])


def safe_availability(gaps: DataFrame, durations: Sequence[int], margin: int = K.SAFETY_MARGIN_NS,
                      key: Sequence[str] = ()) -> DataFrame:
    """Per probe duration: how many gaps can hold it with its margin.

    One pass with one counter per duration; the rows are never multiplied.
    """
    counted = gaps.groupBy(*key).agg(_count().alias("total_count"), *[
        F.count_if(F.col("duration_ns") >= d + margin).alias(f"_s{i}") for i, d in enumerate(durations)])
    pairs = F.array(*[F.struct(F.lit(d).cast("long").alias("probe_duration_ns"), F.col(f"_s{i}").alias("safe_count"))
                      for i, d in enumerate(durations)])
    return (counted.withColumn("_p", F.explode(pairs)).select(*key, "_p.*", "total_count")
            .withColumn("safe_ratio", ratio(F.col("safe_count"), F.col("total_count"))))


def class_balance(gaps: DataFrame, horizons: Sequence[int] = K.HORIZONS_NS, key: Sequence[str] = ()) -> DataFrame:
    out = safe_availability(gaps, horizons, 0, key)
    return out.select(*key, F.col("probe_duration_ns").alias("horizon_ns"), F.col("safe_count").alias("positives"),
                      (F.col("total_count") - F.col("safe_count")).alias("negatives"),
                      F.col("safe_ratio").alias("positive_rate"))


def safe_fraction(gaps: DataFrame, horizons: Sequence[int], late: Column) -> DataFrame:
    """Per horizon, the share of gaps that reach it in the early and in the late cohort."""
    x = F.col("duration_ns")
    counted = gaps.agg(F.count_if(~late).alias("n_early"), F.count_if(late).alias("n_late"), *[
        F.count_if((late if side else ~late) & (x >= h)).alias(f"_{side}{i}")
        for side in (0, 1) for i, h in enumerate(horizons)])
    pairs = F.array(*[F.struct(F.lit(h).cast("long").alias("horizon_ns"), F.col(f"_0{i}").alias("e"),
                               F.col(f"_1{i}").alias("l")) for i, h in enumerate(horizons)])
    early, after = ratio(F.col("p.e") * 100.0, F.col("n_early")), ratio(F.col("p.l") * 100.0, F.col("n_late"))
    return counted.withColumn("p", F.explode(pairs)).select(
        "p.horizon_ns", early.alias("early_pct"), after.alias("late_pct"), (after - early).alias("delta_pp"))


def path_safe_shift(gaps: DataFrame, horizon: int, late: Column, key: Sequence[str] = KEY) -> DataFrame:
    return cohort_compare(gaps, late, F.col("duration_ns") >= horizon, key)


def quantile_profile(df: DataFrame, value: str, ps: Sequence[float] = (.10, .25, .50, .75, .90, .99),
                     key: Sequence[str] = (), approximate: int | None = None, splits=AUTO) -> DataFrame:
    """Quantiles, mean, population deviation and extremes.  Exact by default; ``approximate`` is the accuracy
    of a sketch for a quick look at a very large table."""
    key = list(key)
    x = F.col(value).cast("double")
    names = [f"p{round(p * 100)}" for p in ps]
    plain = [_count().alias("n"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std"), F.min(x).alias("min"),
             F.max(x).alias("max")]
    if approximate:
        sketch = F.percentile_approx(x, F.array(*[F.lit(float(p)) for p in ps]), F.lit(approximate))
        wide = df.groupBy(*key).agg(*plain, sketch.alias("_q"))
        return wide.withColumns({n: F.get("_q", F.lit(i)) for i, n in enumerate(names)}).drop("_q")
    ranks = order_statistics(df, key, value, {n: linear(p) for n, p in zip(names, ps)}, value_splits(splits)).drop("n")
    wide = df.groupBy(*key).agg(*plain)
    return wide.join(ranks, key) if key else one_row_join(wide, ranks)


def one_row_join(a: DataFrame, b: DataFrame) -> DataFrame:
    """Put two ungrouped aggregates, one row each, side by side."""
    row = b.select(F.struct(*b.columns).alias("_row")).scalar()
    return a.withColumn("_row", row).select(*a.columns, "_row.*")


def shift_verdict(gaps: DataFrame, late: Column, value: str = "duration_ns", splits=AUTO) -> DataFrame:
    """Did the median move?  More than 5 % up is longer, less than 5 % either way stable, otherwise shifted."""
    cohorts = gaps.withColumn("_late", late)
    medians = order_statistics(cohorts, ["_late"], value, {"m": linear(0.5)}, value_splits(splits))
    both = medians.agg(F.max(F.when(~F.col("_late"), F.col("m"))).alias("early_median"),
                       F.max(F.when(F.col("_late"), F.col("m"))).alias("late_median"))
    e, l = F.col("early_median"), F.col("late_median")
    return both.withColumn("verdict", F.when(l > e * 1.05, "longer")
                           .when(F.abs(l - e) < e * 0.05, "stable").otherwise("shifted"))


def gap_cdf(gaps: DataFrame, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Cumulative share of gaps per distinct length."""
    key = list(key)
    hist = gaps.groupBy(*key, "duration_ns").agg(_count().alias("_c"))
    splits = resolve(splits, hist, "duration_ns", key)
    cum = running(hist, key, ["duration_ns"], {"_cum": ("sum", F.col("_c"))}, splits=splits,
                  totals={"_n": ("sum", F.col("_c"))})
    return cum.select(*key, "duration_ns", (F.col("_cum") / F.col("_n")).alias("cdf"))


def gap_autocorrelation(gaps: DataFrame, lag: int = 1, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Correlation of a gap length with the one ``lag`` gaps earlier, per path."""
    splits = resolve(splits, gaps, "start_ns", key)
    rows = trailing(gaps, key, "gap_idx", lag, lambda w: {"_before": F.lag("duration_ns", lag).over(w)}, splits)
    rows = rows.filter(F.col("_before").isNotNull())
    return rows.groupBy(*key).agg(F.corr(F.col("duration_ns").cast("double"), F.col("_before").cast("double"))
                                  .alias("autocorrelation"), _count().alias("pairs"))


# --- traces -----------------------------------------------------------------

def trace_summary(df: DataFrame) -> DataFrame:
    rows = with_transfer_metrics(df)
    bw = F.when(F.col("bw_gbps") > 0, F.col("bw_gbps"))
    directions = [F.count_if(F.col("direction") == code).alias(f"n_{label.lower()}")
                  for code, label in K.DIRECTIONS.items()]
    synthetic = has_flag("quality_flags", K.FLAG_SYNTHETIC)
    return rows.agg(
        _count().alias("total_events"), F.count_if(~synthetic).alias("real"),
        F.count_if(synthetic).alias("synthetic"),
        F.round((F.max_by("end_ns", F.struct("start_ns", "end_ns")) - F.min("start_ns")) / 1e9, 1)
        .alias("duration_s"), *directions,
        F.round(F.min("size_mb"), 1).alias("size_mb_min"), F.round(F.max("size_mb"), 1).alias("size_mb_max"),
        F.round(F.coalesce(F.min(bw), F.lit(0.0)), 4).alias("bw_gbps_min"),
        F.round(F.coalesce(F.max(bw), F.lit(0.0)), 4).alias("bw_gbps_max"),
        F.round(F.min("latency_us"), 1).alias("latency_us_min"),
        F.round(F.max("latency_us"), 1).alias("latency_us_max"))


def path_totals(df: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return df.groupBy(*key).agg(
        _count().alias("events"), F.sum("size").alias("bytes_total"), F.min("start_ns").alias("first_ns"),
        F.max("end_ns").alias("last_ns"))


# fixed values: the four probe lengths of the per-path report (ns)
REPORT_DURATIONS = {"tiny": 50_000, "normal": 500_000, "bandwidth": 5_000_000, "large": 10_000_000}


def path_summary(df: DataFrame, busy: DataFrame, gaps: DataFrame, key: Sequence[str] = KEY,
                 durations: dict[str, int] | None = None, margin: int = K.SAFETY_MARGIN_NS,
                 splits=AUTO) -> DataFrame:
    """One report row per path: volume, gap statistics and the share of gaps that can hold each probe."""
    key = list(key)
    durations = durations or REPORT_DURATIONS
    n = F.coalesce("count", F.lit(0))
    events = df.groupBy(*key).agg(_count().alias("events"), F.sum("size").alias("_bytes"),
                                  direction_label(F.min_by("direction", "start_ns")).alias("direction_label"))
    intervals = busy.groupBy(*key).agg(_count().alias("busy_intervals"))
    stats = gap_stats(gaps, key, at_least={f"_{name}": d + margin for name, d in durations.items()}, splits=splits)
    out = events.join(intervals, key, "left").join(stats, key, "left")
    us = {f"gap_{s}_us": F.round(F.coalesce(f"{s}_ns", F.lit(0)) / 1000.0, 1) for s in ("p50", "p90", "min", "max")}
    shares = {f"safe_{name}_pct": F.round(ratio(F.coalesce(f"_{name}", F.lit(0)) * 100.0, n), 1)
              for name in durations}
    return out.select(*key, "events", F.round(F.col("_bytes") / float(K.MIB), 1).alias("total_mb"),
                      "direction_label", F.coalesce("busy_intervals", F.lit(0)).alias("busy_intervals"),
                      n.alias("gaps"), *[c.alias(a) for a, c in {**us, **shares}.items()])


# --- predictions ------------------------------------------------------------

def confusion(threshold: float = 0.5, p: str = "p", label: str = "label") -> dict[str, Column]:
    said, true = F.col(p) >= threshold, F.col(label) == 1
    return {"tp": F.count_if(said & true), "fp": F.count_if(said & ~true),
            "fn": F.count_if(~said & true), "tn": F.count_if(~said & ~true)}


def classification_metrics(pred: DataFrame, by: Sequence[str] = ("horizon_ns",), threshold: float = 0.5,
                           empty: float | None = 0.0) -> DataFrame:
    """tp, fp, fn, tn, precision, recall, false-safe rate fp/(fp+tn), Brier score and n per group."""
    counted = pred.groupBy(*by).agg(
        *[c.alias(n) for n, c in confusion(threshold).items()],
        F.avg((F.col("p") - F.col("label")) * (F.col("p") - F.col("label"))).alias("brier"), _count().alias("n"))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counted.select(*by, "tp", "fp", "fn", "tn", ratio(tp, tp + fp, empty).alias("precision"),
                          ratio(tp, tp + fn, empty).alias("recall"),
                          ratio(fp, fp + tn, empty).alias("false_safe_rate"), "brier", "n")


def mean_over_folds(metrics: DataFrame, by: Sequence[str] = ("horizon_ns",),
                    columns: Sequence[str] = ("precision", "recall", "false_safe_rate", "brier")) -> DataFrame:
    return metrics.groupBy(*by).agg(*[F.avg(c).alias(c) for c in columns], _count().alias("folds"))


def time_slice_metrics(pred: DataFrame, n: int = 10, order: Sequence[str] = ("start_ns",),
                       by: Sequence[str] = ("horizon_ns",), splits=AUTO) -> DataFrame:
    """Metrics per chronological slice; slice i holds the rows floor(N*i/n) to floor(N*(i+1)/n) - 1."""
    rows = _with_position(pred, order, list(by), splits)
    # The slice of row r is the largest i with floor(N*i/n) <= r, that is floor(((r+1)*n - 1) / N).
    block = F.floor(((F.col("_row") + 1) * n - 1) / F.col("_total")) + 1
    return classification_metrics(rows.withColumn("block", block), [*by, "block"])


def _with_position(pred: DataFrame, order: Sequence[str], by: list[str], splits) -> DataFrame:
    return numbered(pred, by, list(order), "_row", resolve(splits, pred, order[0], by), total="_total")


def early_late_metrics(pred: DataFrame, fraction: float = 0.8, order: Sequence[str] = ("start_ns",),
                       by: Sequence[str] = ("horizon_ns",), splits=AUTO) -> DataFrame:
    """Precision and false-safe rate of the first ``int(n * fraction)`` rows and of the rest, with the drift."""
    by = list(by)
    rows = _with_position(pred, order, by, splits)
    rows = rows.withColumn("_late", F.col("_row") >= F.floor(F.col("_total") * F.lit(fraction)))
    m = classification_metrics(rows, [*by, "_late"])
    wide = m.groupBy(*by).agg(*[F.max(F.when(F.col("_late") == side, F.col(c))).alias(f"{short}_{name}")
                                for side, name in ((False, "early"), (True, "late"))
                                for c, short in (("precision", "precision"), ("false_safe_rate", "fsr"))])
    return wide.withColumns({f"{s}_drift": F.col(f"{s}_late") - F.col(f"{s}_early") for s in ("precision", "fsr")})


def eta_sweep(pred: DataFrame, etas: Sequence[float], durations: dict[int, int] | None = None,
              empty: float = 1.0) -> DataFrame:
    """Per confidence limit: bandwidth probes chosen, their precision, and how many chosen classes fit.

    ``pred`` has p, label and duration_ns.  All limits are counted in one pass.
    """
    d = durations or K.PROBE_DURATIONS_NS
    aggs, p, x = [_count().alias("n")], F.col("p"), F.col("duration_ns")
    for i, eta in enumerate(etas):
        normal = max(0.5, eta - 0.05)
        need = F.when(p >= eta, d[K.PROBE_BANDWIDTH]).when(p >= normal, d[K.PROBE_NORMAL]).otherwise(d[K.PROBE_TINY])
        aggs += [F.count_if(p >= eta).alias(f"_n{i}"), F.count_if((p >= eta) & (F.col("label") == 1)).alias(f"_t{i}"),
                 F.count_if(x >= need).alias(f"_f{i}")]
    rows = F.array(*[F.struct(F.lit(float(e)).alias("eta_bw"), F.lit(round(max(0.5, e - 0.05), 2)).alias("eta_normal"),
                              F.col(f"_n{i}").alias("bw_probes"), F.col(f"_t{i}").alias("tp"),
                              F.col(f"_f{i}").alias("fit")) for i, e in enumerate(etas)])
    return pred.agg(*aggs).withColumn("r", F.explode(rows)).select(
        "r.eta_bw", "r.eta_normal", "r.bw_probes", ratio(F.col("r.tp"), F.col("r.bw_probes"), empty).alias("precision"),
        ratio(F.col("r.fit"), F.col("n")).alias("safe_ratio"), (F.col("n") - F.col("r.fit")).alias("unsafe_count"))


def oracle_gap(pred: DataFrame, latency: int, eta: float = 0.95) -> DataFrame:
    """Safe ratio of perfect selection against selection by confidence."""
    safe, sure = F.col("duration_ns") >= latency, F.col("p") >= eta
    out = pred.agg(F.count_if(safe).alias("oracle_probes"), F.count_if(sure & safe).alias("predicted_probes"))
    one = F.lit(1)
    return out.withColumns({
        "oracle_safe_ratio": F.col("oracle_probes") / F.greatest(one, F.col("oracle_probes")),
        "predicted_safe_ratio": F.col("predicted_probes") / F.greatest(one, F.col("predicted_probes"))}) \
        .withColumn("oracle_gap", F.col("oracle_safe_ratio") - F.col("predicted_safe_ratio"))


# --- policy outcomes --------------------------------------------------------

def policy_metrics(outcomes: DataFrame, trace_window_ns: Column | int, by: Sequence[str] = ("policy",),
                   key: Sequence[str] = KEY) -> DataFrame:
    """Per policy: probes by class, bandwidth share, overhead, mean gap use, unsafe rate and paths covered.

    ``outcomes`` comes from ``fit_outcomes``.
    """
    kind = F.col("probe_type")
    window = F.lit(trace_window_ns) if isinstance(trace_window_ns, int) else trace_window_ns
    c = outcomes.groupBy(*by).agg(
        _count().alias("total_probes"), F.count_if(kind == K.PROBE_BANDWIDTH).alias("bw_probes"),
        F.count_if(kind == K.PROBE_NORMAL).alias("normal_probes"), F.count_if(kind == K.PROBE_TINY).alias("tiny_probes"),
        F.sum("probe_ns").alias("_cost"), F.sum("utilisation").alias("_used"),
        F.count_if(F.col("unsafe")).alias("unsafe_probes"), F.count_distinct(*key).alias("paths_covered"))
    n = F.col("total_probes")
    return c.select(*by, "total_probes", "bw_probes", "normal_probes", "tiny_probes",
                    ratio(F.col("bw_probes") * 100.0, n).alias("bw_ratio_pct"),
                    (F.col("_cost") * 100.0 / F.greatest(F.lit(1), window)).alias("overhead_pct"),
                    ratio(F.col("_used") * 100.0, n).alias("avg_gap_util_pct"), "unsafe_probes",
                    ratio(F.col("unsafe_probes") * 100.0, n).alias("unsafe_rate_pct"), "paths_covered")


def policy_metrics_by_path(outcomes: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    kind = F.col("probe_type")
    return outcomes.groupBy("policy", *key).agg(
        _count().alias("total"), F.count_if(kind == K.PROBE_BANDWIDTH).alias("bw"),
        F.count_if(kind == K.PROBE_NORMAL).alias("normal"), F.count_if(kind == K.PROBE_TINY).alias("tiny"),
        F.count_if(F.col("unsafe")).alias("unsafe"))


def run_summary(outcomes: DataFrame, by: Sequence[str] = ("policy",), unsafe_overlap_only: bool = False) -> DataFrame:
    """Counts and ratios of placed probes.  ``outcomes`` comes from ``policies.outcomes``."""
    ran, safe = ~F.col("cancelled"), F.col("safe")
    counted = ran & ~safe if unsafe_overlap_only else ran
    c = outcomes.groupBy(*by).agg(
        _count().alias("scheduled"), F.count_if(ran).alias("executed"), F.count_if(ran & safe).alias("safe_probes"),
        F.count_if(ran & ~safe).alias("unsafe_probes"), F.count_if(~ran).alias("cancelled"),
        F.count_if(ran & F.col("downgraded")).alias("downgraded"),
        F.coalesce(F.sum(F.when(ran, F.col("end_ns") - F.col("start_ns"))), F.lit(0)).alias("total_probing_ns"),
        F.coalesce(F.sum(F.when(counted, F.col("busy_overlap_ns"))), F.lit(0)).alias("_overlap"))
    one = F.lit(1)
    return c.withColumns({
        "probe_overlap_ratio": F.col("_overlap") / F.greatest(one, F.col("total_probing_ns")),
        "safe_probing_ratio": F.col("safe_probes") / F.greatest(one, F.col("executed"))}).drop("_overlap")


def probe_overhead(df: DataFrame, probing: str = "total_probing_ns", total: str = "total_time_ns") -> DataFrame:
    return df.withColumn("overhead_pct", F.when(F.col(total) > 0, F.round(F.col(probing) / F.col(total) * 100, 3))
                         .otherwise(0.0))


def probe_rate(df: DataFrame, count: str = "executed", total: str = "total_time_ns") -> DataFrame:
    return df.withColumn("probes_per_s", F.when(F.col(total) > 0, F.round(F.col(count) / (F.col(total) / 1e9), 2))
                         .otherwise(0.0))


def probe_type_counts(outcomes: DataFrame, by: Sequence[str] = ("policy",)) -> DataFrame:
    return outcomes.filter(~F.col("cancelled")).groupBy(*by, "probe_type").agg(_count().alias("probes"))


def gap_coverage(outcomes: DataFrame, total_gaps: Column, by: Sequence[str] = ("policy",)) -> DataFrame:
    """Distinct safe gap lengths used, and the share of gaps used."""
    used = outcomes.groupBy(*by).agg(
        _count().alias("gaps_probed"),
        F.count_distinct(F.when(F.col("safe"), F.col("gap_during_probe_ns"))).alias("gaps_safe_probed"))
    out = used.withColumn("total_gaps", total_gaps)
    n = F.greatest(F.lit(1), F.col("total_gaps"))
    return out.withColumns({"coverage_pct": F.round(F.col("gaps_safe_probed") * 100.0 / n, 1),
                            "utilization_pct": F.round(F.col("gaps_probed") * 100.0 / n, 1)})


def compare_policies(outcomes: DataFrame, total_time_ns: Column) -> DataFrame:
    """Wide comparison table, one row per policy."""
    s = run_summary(outcomes)
    return s.select("policy", "executed", F.round(F.col("safe_probing_ratio") * 100, 1).alias("safe_pct"),
                    F.round(F.col("probe_overlap_ratio") * 100, 1).alias("overlap_pct"),
                    F.col("unsafe_probes").alias("harmful"),
                    F.round(F.col("total_probing_ns") * 100.0 / F.greatest(F.lit(1), total_time_ns), 2)
                    .alias("overhead_pct"), "downgraded")


# --- readings ---------------------------------------------------------------

def probe_cost(probes: DataFrame, span_s: Column | float) -> DataFrame:
    """Cost of the probes in a log: counts, mean latency by class, bandwidth range, share of the run."""
    bw, lat = F.col("type") == "BW", F.col("type") == "LAT"
    zero = F.lit(0.0)
    gb = F.when(bw, F.col("bandwidth_gbps"))
    out = probes.agg(
        _count().alias("total_probes"), F.count_if(lat).alias("latency_probes"), F.count_if(bw).alias("bandwidth_probes"),
        F.coalesce(F.sum("latency_us") / 1e6, zero).alias("total_probe_s"),
        F.coalesce(F.avg(F.when(lat, F.col("latency_us"))), zero).alias("avg_latency_probe_us"),
        F.coalesce(F.avg(F.when(bw, F.col("latency_us"))), zero).alias("avg_bandwidth_probe_us"),
        F.coalesce(F.avg(gb), zero).alias("avg_gbps"), F.coalesce(F.min(gb), zero).alias("min_gbps"),
        F.coalesce(F.max(gb), zero).alias("max_gbps"))
    span = F.lit(span_s) if not isinstance(span_s, Column) else span_s
    return out.withColumn("overhead_pct", F.col("total_probe_s") / span * 100)


def stage_bandwidth(readings: DataFrame, stages: Sequence[tuple[str, float | None, float | None]],
                    value: str = "bandwidth_gbps", at: str = "t", splits=AUTO) -> DataFrame:
    """n, mean, median, min, max per named time stage and the drop of its median from the first stage.

    Stages are closed intervals and may touch, so a reading at an edge counts in both.  A stage list is a
    few literals, so each reading is matched by expressions instead of a join.
    """
    inside = []
    for name, start, end in stages:
        hit = F.lit(True)
        if start is not None:
            hit = hit & (F.col(at) >= start)
        if end is not None:
            hit = hit & (F.col(at) <= end)
        inside.append(F.when(hit, F.lit(name)))
    rows = readings.withColumn("stage", F.explode(F.array_compact(F.array(*inside))))
    plain = rows.groupBy("stage").agg(_count().alias("n"), F.avg(value).alias("mean"), F.min(value).alias("min"),
                                      F.max(value).alias("max"))
    medians = order_statistics(rows, ["stage"], value, {"median": linear(0.5)}, splits).drop("n")
    out = plain.join(medians, "stage")
    # One row per stage is left, so a window over all of them is a handful of rows.
    base = F.max(F.when(F.col("stage") == stages[0][0], F.col("median"))).over(Window.partitionBy(F.lit(0)))
    return out.withColumn("drop_pct", F.when(F.col("stage") != stages[0][0], (1 - F.col("median") / base) * 100))


def baseline_median(readings: DataFrame, fault_start: float | None = None, value: str = "bandwidth_gbps",
                    at: str = "t", order: Sequence[str] = ("t",), splits=AUTO) -> float:
    """Median before the fault; of the first third of the readings when no time is known.

    One number, computed now: every later stage, batch or stream, compares with a constant.
    """
    before = readings.filter(F.col(at) < fault_start) if fault_start is not None \
        else first_fraction(readings, 1 / 3, order, splits)
    row = order_statistics(before, [], value, {"m": linear(0.5)}, splits).first()
    if row is None or row.m is None:
        raise ValueError("no reading before the fault, so there is no baseline")
    return row.m


def flag_degraded(readings: DataFrame, baseline: Column | float, threshold: float = 0.7,
                  value: str = "bandwidth_gbps") -> DataFrame:
    limit = baseline * F.lit(threshold)
    return readings.withColumn("limit_gbps", limit) \
        .withColumn("is_degraded", F.col(value) < F.col("limit_gbps"))


def degradation_report(flagged: DataFrame, fault_start: float, fault_end: float, value: str = "bandwidth_gbps",
                       at: str = "t") -> DataFrame:
    """Recall and precision of the degraded flag against a known fault window; null where undefined."""
    low = F.col("is_degraded")
    inside = F.col(at).between(fault_start, fault_end)
    v = F.when(low, F.col(value))
    out = flagged.agg(
        _count().alias("total"), F.count_if(low).alias("degraded"), F.count_if(inside).alias("during_fault"),
        F.count_if(low & inside).alias("hits"), F.min(v).alias("degraded_min"), F.avg(v).alias("degraded_mean"),
        F.max(v).alias("degraded_max"))
    return out.withColumns({"recall": ratio(F.col("hits"), F.col("during_fault"), None),
                            "precision": ratio(F.col("hits"), F.col("degraded"), None)})


def sample_summary(df: DataFrame, value: str, key: Sequence[str] = (), splits=AUTO) -> DataFrame:
    """n, mean, median, sample deviation (0 for one sample), min and max."""
    key = list(key)
    plain = df.groupBy(*key).agg(F.count(value).alias("n"), F.avg(value).alias("mean"),
                                 F.coalesce(F.stddev_samp(value), F.lit(0.0)).alias("stdev"),
                                 F.min(value).alias("min"), F.max(value).alias("max"))
    median = order_statistics(df, key, value, {"median": linear(0.5)}, splits).drop("n")
    return plain.join(median, key) if key else one_row_join(plain, median)


def overhead_delta(baseline: DataFrame, loaded: DataFrame, process: DataFrame | None = None,
                   n_cpu: int | None = None, value: str = "busy_pct", process_value: str = "cpu_pct") -> DataFrame:
    """Difference of the mean busy share of two phases, and the cost of one process on the whole machine."""
    tagged = baseline.select(F.lit(0).alias("phase"), F.col(value).alias("v")).unionByName(
        loaded.select(F.lit(1).alias("phase"), F.col(value).alias("v")))
    if process is not None:
        tagged = tagged.unionByName(process.select(F.lit(2).alias("phase"), F.col(process_value).alias("v")))
    means = tagged.agg(*[F.avg(F.when(F.col("phase") == i, F.col("v"))).alias(n)
                         for i, n in enumerate(("baseline_mean", "loaded_mean", "process_mean"))])
    return means.select("baseline_mean", "loaded_mean",
                        (F.col("loaded_mean") - F.col("baseline_mean")).alias("overhead_pp"),
                        (F.col("process_mean") / F.lit(n_cpu)).alias("process_pct"))
