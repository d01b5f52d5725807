"""Aggregations over gaps, traces, predictions and readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import aggregates as G
from ..operators import calibration as B
from ..operators import joins as J
from ..operators import ranking as R
from ..operators import sketches as Q
from ..operators import windows as W
from ..scale import attach
from ..sources.logs import parse_probe_lines
from . import adapter as A
from .endpoints import traced
from .predictions import rounded, trailing_predictions
from .q_sources import READINGS_SQL, probe_lines
from .registry import PATH, new_folder, query, timeline
from .sql import CONFUSION, RATES, T, TB, TBG, TBGP, TX, edges, with_

LATE_NS = 1_705_363_200_000_000_000        # 2024-01-16
LATE = f"start_ns >= {LATE_NS}"
DAY = 1_704_067_200.0                      # 2024-01-01


def late():
    return F.col("start_ns") >= LATE_NS


GAP_STATS_SQL = """r AS (SELECT path, duration_ns, row_number() OVER (PARTITION BY path ORDER BY duration_ns) - 1 AS r,
  count(*) OVER (PARTITION BY path) AS n FROM gaps),
stats AS (SELECT path, count(*) AS "count", min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
  max(CASE WHEN r = n // 2 THEN duration_ns END) AS p50_ns,
  max(CASE WHEN r = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN duration_ns END) AS p90_ns,
  CAST(sum(duration_ns) AS BIGINT) AS total_ns FROM r GROUP BY path)"""


@query("gap_stats", with_(f"{TBG}, {GAP_STATS_SQL}", "SELECT * FROM stats"))
def gap_stats(spark, sf):
    tl = timeline(spark, sf)
    return G.gap_stats(tl.gaps, PATH, splits=tl.splits)


@query("safe_availability", with_(TBG, """SELECT probe_duration_ns, count(*) FILTER (duration_ns >= probe_duration_ns +
100000000000) AS safe_count, count(*) AS total_count, round(count(*) FILTER (duration_ns >= probe_duration_ns +
100000000000) / count(*), 6) AS safe_ratio FROM gaps, (SELECT unnest([50000000000, 500000000000, 5000000000000,
10000000000000]) AS probe_duration_ns) GROUP BY 1"""))
def safe_availability(spark, sf):
    durations = [d * A.SCALE for d in G.REPORT_DURATIONS.values()]
    return rounded(G.safe_availability(timeline(spark, sf).gaps, durations, A.MARGIN))


@query("trace_summary", with_(TX, """SELECT count(*) AS total_events, count(*) FILTER (k % 7 <> 0) AS real, count(*)
FILTER (k % 7 = 0) AS synthetic, round((arg_max(end_ns, start_ns) - min(start_ns)) / 1e9, 1) AS duration_s, count(*)
FILTER (direction = 0) AS n_h2h, count(*) FILTER (direction = 1) AS n_h2d, count(*) FILTER (direction = 2) AS n_d2h,
count(*) FILTER (direction = 3) AS n_d2d, round(min(size) / 1048576.0, 1) AS size_mb_min, round(max(size) / 1048576.0, 1)
AS size_mb_max, round(min(size / (end_ns - start_ns)) FILTER (end_ns > start_ns), 4) AS bw_gbps_min,
round(max(size / (end_ns - start_ns)) FILTER (end_ns > start_ns), 4) AS bw_gbps_max, round(min(end_ns - start_ns) /
1000.0, 1) AS latency_us_min, round(max(end_ns - start_ns) / 1000.0, 1) AS latency_us_max FROM tx"""))
def trace_summary(spark, sf):
    flags = C.set_flag("quality_flags", K.FLAG_SYNTHETIC, F.col("k") % 7 == 0)
    return G.trace_summary(traced(spark, sf).withColumn("quality_flags", flags))


@query("path_summary", with_(f"{TBG}, {GAP_STATS_SQL}", """, e AS (SELECT path, count(*) AS events,
round(sum(size) / 1048576.0, 1) AS total_mb, CASE arg_min(direction, start_ns) WHEN 0 THEN 'H2H' WHEN 1 THEN 'H2D' WHEN 2
THEN 'D2H' ELSE 'D2D' END AS direction_label FROM t GROUP BY path), b AS (SELECT path, count(*) AS busy_intervals FROM
busy GROUP BY path), s AS (SELECT path, round(100.0 * count(*) FILTER (duration_ns >= 150000000000) / count(*), 1) AS
safe_tiny_pct, round(100.0 * count(*) FILTER (duration_ns >= 600000000000) / count(*), 1) AS safe_normal_pct, round(100.0
* count(*) FILTER (duration_ns >= 5100000000000) / count(*), 1) AS safe_bandwidth_pct, round(100.0 * count(*) FILTER
(duration_ns >= 10100000000000) / count(*), 1) AS safe_large_pct FROM gaps GROUP BY path)
SELECT path, events, total_mb, direction_label, busy_intervals, "count" AS gaps, round(p50_ns / 1000.0, 1) AS gap_p50_us,
round(p90_ns / 1000.0, 1) AS gap_p90_us, round(min_ns / 1000.0, 1) AS gap_min_us, round(max_ns / 1000.0, 1) AS gap_max_us,
safe_tiny_pct, safe_normal_pct, safe_bandwidth_pct, safe_large_pct
FROM e JOIN b USING (path) JOIN stats USING (path) JOIN s USING (path)"""))
def path_summary(spark, sf):
    tl = timeline(spark, sf)
    durations = {n: d * A.SCALE for n, d in G.REPORT_DURATIONS.items()}
    return G.path_summary(tl.transfers, tl.busy, tl.gaps, PATH, durations, A.MARGIN, tl.splits)


@query("path_totals", with_(TX, """SELECT src_dev, dst_dev, direction, src_numa, dst_numa, count(*) AS events,
CAST(sum(size) AS BIGINT) AS bytes_total, min(start_ns) AS first_ns, max(end_ns) AS last_ns FROM tx GROUP BY ALL"""))
def path_totals(spark, sf):
    return G.path_totals(traced(spark, sf))


@query("classification_metrics", with_(TBGP, f"""SELECT horizon_ns, tp, fp, fn, tn, {RATES}, n FROM
(SELECT horizon_ns, {CONFUSION} FROM pred GROUP BY horizon_ns)"""))
def classification_metrics(spark, sf):
    return rounded(G.classification_metrics(trailing_predictions(spark, sf)[1]))


@query("mean_over_folds", with_(TBGP, f"""SELECT horizon_ns, round(avg(precision), 5) AS precision, round(avg(recall), 5)
AS recall, round(avg(false_safe_rate), 5) AS false_safe_rate, round(avg(brier), 5) AS brier, count(*) AS folds FROM
(SELECT horizon_ns, path, {RATES.replace(', 6)', ', 12)')} FROM (SELECT horizon_ns, path, {CONFUSION} FROM pred GROUP BY
ALL)) GROUP BY horizon_ns"""))
def mean_over_folds(spark, sf):
    pred = trailing_predictions(spark, sf)[1]
    return rounded(G.mean_over_folds(G.classification_metrics(pred, ["horizon_ns", "path"])), 5)


CURVE_SQL = f"""{edges()},
tot AS (SELECT horizon_ns, count(*) AS n FROM pred GROUP BY 1),
m AS (SELECT horizon_ns, bin, count(*) AS "count", avg(p) AS conf, avg(CAST(label AS DOUBLE)) AS acc FROM pred JOIN bins
  ON p > lower AND p <= upper GROUP BY ALL),
curve AS (SELECT tot.horizon_ns, bins.bin, lower, upper, coalesce(conf, (lower + upper) / 2) AS confidence,
  coalesce(acc, 0) AS accuracy, coalesce("count", 0) AS "count", coalesce("count", 0) / n AS proportion
  FROM tot CROSS JOIN bins LEFT JOIN m ON m.horizon_ns = tot.horizon_ns AND m.bin = bins.bin)"""


@query("reliability_curve", with_(f"{TBGP}, {CURVE_SQL}", """SELECT horizon_ns, bin, round(lower, 6) AS lower, round(upper,
6) AS upper, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy, "count", round(proportion, 6) AS
proportion FROM curve"""))
def reliability_curve(spark, sf):
    return rounded(B.reliability_curve(trailing_predictions(spark, sf)[1]))


@query("calibration_error", with_(f"{TBGP}, {CURVE_SQL}", """SELECT horizon_ns, round(sum(proportion * abs(confidence -
accuracy)), 6) AS ece FROM curve GROUP BY horizon_ns"""))
def calibration_error(spark, sf):
    return rounded(B.expected_calibration_error(B.reliability_curve(trailing_predictions(spark, sf)[1])))


@query("brier", with_(TBGP, """SELECT horizon_ns, round(avg((p - label) * (p - label)), 6) AS brier, round(avg(p), 6) AS
avg_confidence, round(avg(label), 6) AS avg_accuracy, count(*) AS n FROM pred GROUP BY horizon_ns"""))
def brier(spark, sf):
    return rounded(B.brier(trailing_predictions(spark, sf)[1]))


@query("quantile_profile", with_(TBG, """SELECT path, count(*) AS n, round(quantile_cont(duration_ns / 1e9, 0.10), 4) AS
p10, round(quantile_cont(duration_ns / 1e9, 0.25), 4) AS p25, round(quantile_cont(duration_ns / 1e9, 0.50), 4) AS p50,
round(quantile_cont(duration_ns / 1e9, 0.75), 4) AS p75, round(quantile_cont(duration_ns / 1e9, 0.90), 4) AS p90,
round(quantile_cont(duration_ns / 1e9, 0.99), 4) AS p99, round(avg(duration_ns / 1e9), 4) AS mean,
round(stddev_pop(duration_ns / 1e9), 4) AS std, round(min(duration_ns / 1e9), 4) AS min, round(max(duration_ns / 1e9), 4)
AS max FROM gaps GROUP BY path"""))
def quantile_profile(spark, sf):
    tl = timeline(spark, sf)
    gaps = tl.gaps.withColumn("s", F.col("duration_ns") / 1e9)
    return rounded(G.quantile_profile(gaps, "s", key=PATH, splits=tl.splits), 4)


@query("quantile_profile_approximate")
def quantile_profile_approximate(spark, sf):
    return G.quantile_profile(timeline(spark, sf).gaps, "duration_ns", key=PATH, approximate=10_000)


PICKS = (.05, .25, .5, .75, .9, .99)


@query("quantile_sketches_merged", with_(TBG, f"""SELECT path, p, n, true AS within FROM (SELECT path, count(*) AS n FROM gaps GROUP BY path),
(SELECT unnest([{', '.join(f'CAST({p} AS DOUBLE)' for p in PICKS)}]) AS p)"""))
def quantile_sketches_merged(spark, sf):
    """A sketch per path and day is kept, merged per path without the gaps, and every pick is held against exact ranks."""
    tl, folder = timeline(spark, sf), new_folder(spark, "sketches")
    days = tl.gaps.withColumn("day", F.floor(F.col("start_ns") / 86_400_000_000_000))
    Q.quantile_sketches(days, "duration_ns", ["path", "day"]).write.parquet(folder)
    picks = Q.sketched_quantiles(Q.merge_sketches(spark.read.parquet(folder), PATH), PATH, PICKS)
    per_path = picks.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("p", "value", "n"))).alias("picks"))
    met = attach(tl.gaps.select("path", "start_ns", "duration_ns"), per_path, PATH, tl.splits)
    x = F.col("duration_ns").cast("double")
    found = F.array(*[F.struct(*[F.max(F.col("picks")[i][c]).alias(c) for c in ("p", "n")], F.avg((x < F.col("picks")[i]["value"]).cast("double")).alias("below"),
                               F.avg((x <= F.col("picks")[i]["value"]).cast("double")).alias("upto")) for i in range(len(PICKS))])
    ranks = met.groupBy("path").agg(found.alias("r")).select("path", F.inline("r"))
    error = Q.rank_error()
    return ranks.select("path", "p", "n", ((F.col("below") - error <= F.col("p")) & (F.col("p") <= F.col("upto") + error)).alias("within"))


@query("safe_fraction", with_(f"{TBGP}", f"""SELECT horizon_ns, round(100.0 * count(*) FILTER (NOT {LATE} AND label = 1) /
count(*) FILTER (NOT {LATE}), 6) AS early_pct, round(100.0 * count(*) FILTER ({LATE} AND label = 1) / count(*) FILTER
({LATE}), 6) AS late_pct, round(100.0 * count(*) FILTER ({LATE} AND label = 1) / count(*) FILTER ({LATE}) - 100.0 *
count(*) FILTER (NOT {LATE} AND label = 1) / count(*) FILTER (NOT {LATE}), 6) AS delta_pp FROM pred GROUP BY 1"""))
def safe_fraction(spark, sf):
    return rounded(G.safe_fraction(timeline(spark, sf).gaps, A.HORIZONS, late()))


@query("shift_verdict", with_(TBG, f"""SELECT *, CASE WHEN late_median > early_median * 1.05 THEN 'longer' WHEN
abs(late_median - early_median) < early_median * 0.05 THEN 'stable' ELSE 'shifted' END AS verdict FROM (SELECT
quantile_cont(duration_ns, 0.5) FILTER (NOT {LATE}) AS early_median, quantile_cont(duration_ns, 0.5) FILTER ({LATE}) AS
late_median FROM gaps)"""))
def shift_verdict(spark, sf):
    return G.shift_verdict(timeline(spark, sf).gaps, late())


@query("time_slice_metrics", with_(TBGP, f""", o AS (SELECT *, row_number() OVER (PARTITION BY horizon_ns ORDER BY
start_ns, path) - 1 AS r, count(*) OVER (PARTITION BY horizon_ns) AS total FROM pred), s AS (SELECT *, 1 + (SELECT
count(*) FROM range(1, 10) e(i) WHERE r >= (total * i) // 10) AS block FROM o)
SELECT horizon_ns, block, tp, fp, fn, tn, {RATES}, n FROM (SELECT horizon_ns, block, {CONFUSION} FROM s GROUP BY ALL)"""))
def time_slice_metrics(spark, sf):
    return rounded(G.time_slice_metrics(trailing_predictions(spark, sf)[1], 10, ["start_ns", "path"]))


@query("early_late_metrics", with_(TBGP, f""", o AS (SELECT *, row_number() OVER (PARTITION BY horizon_ns ORDER BY
start_ns, path) - 1 AS r, count(*) OVER (PARTITION BY horizon_ns) AS total FROM pred), m AS (SELECT horizon_ns, late,
{RATES.replace(', 6)', ', 12)')} FROM (SELECT horizon_ns, r >= floor(total * CAST(0.8 AS DOUBLE)) AS late, {CONFUSION}
FROM o GROUP BY ALL))
SELECT e.horizon_ns, round(e.precision, 6) AS precision_early, round(l.precision, 6) AS precision_late,
round(e.false_safe_rate, 6) AS fsr_early, round(l.false_safe_rate, 6) AS fsr_late, round(l.precision - e.precision, 6) AS
precision_drift, round(l.false_safe_rate - e.false_safe_rate, 6) AS fsr_drift FROM m e JOIN m l ON e.horizon_ns =
l.horizon_ns AND NOT e.late AND l.late"""))
def early_late_metrics(spark, sf):
    return rounded(G.early_late_metrics(trailing_predictions(spark, sf)[1], 0.8, ["start_ns", "path"]))


@query("class_balance", with_(TBGP, """SELECT horizon_ns, CAST(sum(label) AS BIGINT) AS positives, CAST(sum(1 - label) AS
BIGINT) AS negatives, round(avg(label), 6) AS positive_rate FROM pred GROUP BY 1"""))
def class_balance(spark, sf):
    return rounded(G.class_balance(timeline(spark, sf).gaps, A.HORIZONS))


ETAS = (0.50, 0.60, 0.70, 0.80, 0.85, 0.90, 0.95, 0.99)


@query("eta_sweep", with_(TBGP, f""", e AS (SELECT CAST(unnest([{', '.join(map(str, ETAS))}]) AS DOUBLE) AS eta_bw), x AS
(SELECT eta_bw, greatest(0.5, eta_bw - 0.05) AS eta_n, p, label, duration_ns FROM pred, e WHERE horizon_ns = 500000000000)
SELECT eta_bw, round(any_value(eta_n), 2) AS eta_normal, count(*) FILTER (p >= eta_bw) AS bw_probes, round(CASE WHEN
count(*) FILTER (p >= eta_bw) > 0 THEN count(*) FILTER (p >= eta_bw AND label = 1) / count(*) FILTER (p >= eta_bw) ELSE 1
END, 6) AS precision, round(count(*) FILTER (duration_ns >= need) / count(*), 6) AS safe_ratio, count(*) FILTER
(duration_ns < need) AS unsafe_count FROM (SELECT *, CASE WHEN p >= eta_bw THEN 5100000000000 WHEN p >= eta_n THEN
500000000000 ELSE 50000000000 END AS need FROM x) GROUP BY eta_bw"""))
def eta_sweep(spark, sf):
    pred = trailing_predictions(spark, sf)[1].filter(F.col("horizon_ns") == A.HORIZONS[5])
    return rounded(G.eta_sweep(pred, ETAS, A.DURATIONS))


@query("oracle_gap", with_(TBGP, """SELECT oracle_probes, predicted_probes, round(oracle_probes / greatest(1,
oracle_probes), 6) AS oracle_safe_ratio, round(predicted_probes / greatest(1, predicted_probes), 6) AS
predicted_safe_ratio, round(oracle_probes / greatest(1, oracle_probes) - predicted_probes / greatest(1, predicted_probes),
6) AS oracle_gap FROM (SELECT count(*) FILTER (duration_ns >= 2000000000000) AS oracle_probes, count(*) FILTER (p >= 0.7
AND duration_ns >= 2000000000000) AS predicted_probes FROM pred WHERE horizon_ns = 500000000000)"""))
def oracle_gap(spark, sf):
    pred = trailing_predictions(spark, sf)[1].filter(F.col("horizon_ns") == A.HORIZONS[5])
    return rounded(G.oracle_gap(pred, 2_000_000 * A.SCALE, 0.7))


@query("event_rate", with_(TBG, """SELECT path, round(count(*) / greatest((max(end_ns) - min(start_ns)) / 1e9, 0.001), 9)
AS event_rate FROM gaps GROUP BY path"""))
def event_rate(spark, sf):
    return rounded(W.event_rate(timeline(spark, sf).gaps, PATH), 9)


# --- joins ------------------------------------------------------------------

@query("align_gap_busy", with_(TBG, """SELECT path, gap_idx, g.start_ns, g.duration_ns, b.start_ns AS busy_start_ns,
b.end_ns AS busy_end_ns, b.bytes_total FROM gaps g JOIN (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_ns)
- 1 AS gap_idx FROM busy) b USING (path, gap_idx)"""))
def align_gap_busy(spark, sf):
    tl = timeline(spark, sf)
    return J.align_gap_busy(tl.gaps, tl.busy, PATH, tl.splits).drop("end_ns")


@query("top_path_semi", with_(TX, """SELECT event_id FROM tx SEMI JOIN (SELECT src_dev, dst_dev, direction, src_numa,
dst_numa, count(*) AS events FROM tx GROUP BY ALL ORDER BY events DESC, 1, 2, 3, 4, 5 LIMIT 8) USING (src_dev, dst_dev,
direction, src_numa, dst_numa)"""))
def top_path_semi(spark, sf):
    return J.top_path_semi(traced(spark, sf), 8).select("event_id")


@query("compare_runs", with_(TBGP, f""", m AS (SELECT pass, horizon_ns, {RATES.replace(', 6)', ', 12)')} FROM (SELECT
{LATE} AS pass, horizon_ns, {CONFUSION} FROM pred GROUP BY ALL))
SELECT a.horizon_ns, round(a.precision, 6) AS a_precision, round(b.precision, 6) AS b_precision, round(b.precision -
a.precision, 6) AS delta_precision, round(a.recall, 6) AS a_recall, round(b.recall, 6) AS b_recall, round(b.recall -
a.recall, 6) AS delta_recall FROM m a JOIN m b ON a.horizon_ns = b.horizon_ns AND NOT a.pass AND b.pass"""))
def compare_runs(spark, sf):
    pred = trailing_predictions(spark, sf)[1]
    a, b = (G.classification_metrics(pred.filter(c)) for c in (~late(), late()))
    return rounded(J.compare_runs(a, b, ["horizon_ns"], ["precision", "recall"]))


@query("cohort_compare", with_(TBG, f"""SELECT path, n_early, n_late, round(100.0 * e / n_early, 6) AS early_pct,
round(100.0 * l / n_late, 6) AS late_pct, round(100.0 * l / n_late - 100.0 * e / n_early, 6) AS delta_pp FROM (SELECT path,
count(*) FILTER (NOT {LATE}) AS n_early, count(*) FILTER ({LATE}) AS n_late, count(*) FILTER (NOT {LATE} AND duration_ns
>= 500000000000) AS e, count(*) FILTER ({LATE} AND duration_ns >= 500000000000) AS l FROM gaps GROUP BY path) WHERE
n_early >= 5 AND n_late >= 5"""))
def cohort_compare(spark, sf):
    return rounded(G.path_safe_shift(timeline(spark, sf).gaps, A.HORIZONS[5], late(), PATH))


# --- readings ---------------------------------------------------------------

def _readings(spark, sf):
    return parse_probe_lines(probe_lines(spark, sf))


def _bandwidth(spark, sf):
    return _readings(spark, sf).filter((F.col("type") == "BW") & F.col("t").isNotNull())


TR = f"{T}, {READINGS_SQL}"
BW_SQL = f"{TR}, bw AS (SELECT * FROM readings WHERE type = 'BW' AND t IS NOT NULL)"
FAULT = (DAY + 5 * 86400, DAY + 8 * 86400)


@query("probe_cost", with_(TR, """SELECT count(*) AS total_probes, count(*) FILTER (type = 'LAT') AS latency_probes,
count(*) FILTER (type = 'BW') AS bandwidth_probes, round(sum(latency_us) / 1e6, 6) AS total_probe_s, round(avg(latency_us)
FILTER (type = 'LAT'), 6) AS avg_latency_probe_us, round(avg(latency_us) FILTER (type = 'BW'), 6) AS
avg_bandwidth_probe_us, round(avg(bandwidth_gbps) FILTER (type = 'BW'), 6) AS avg_gbps, min(bandwidth_gbps) FILTER (type =
'BW') AS min_gbps, max(bandwidth_gbps) FILTER (type = 'BW') AS max_gbps, round(sum(latency_us) / 1e6 / 1200 * 100, 6) AS
overhead_pct FROM readings"""))
def probe_cost(spark, sf):
    return rounded(G.probe_cost(_readings(spark, sf), 1200.0))


STAGES = [("baseline", None, DAY + 5 * 86400), ("fault1", DAY + 5 * 86400, DAY + 8 * 86400),
          ("between", DAY + 8 * 86400, DAY + 12 * 86400), ("fault2", DAY + 12 * 86400, DAY + 15 * 86400),
          ("post", DAY + 15 * 86400, None)]
STAGE_ROWS = ", ".join(f"('{n}', {a if a is not None else 0}, {b if b is not None else 1e18})" for n, a, b in STAGES)


@query("stage_bandwidth", with_(BW_SQL, f""", st AS (SELECT * FROM (VALUES {STAGE_ROWS}) v(stage, a, b)), s AS (SELECT
stage, count(*) AS n, avg(bandwidth_gbps) AS mean, quantile_cont(bandwidth_gbps, 0.5) AS median, min(bandwidth_gbps) AS
min, max(bandwidth_gbps) AS max FROM bw JOIN st ON t BETWEEN a AND b GROUP BY stage)
SELECT stage, n, round(mean, 6) AS mean, round(median, 6) AS median, min, max, round(CASE WHEN stage <> 'baseline' THEN (1
- median / (SELECT median FROM s WHERE stage = 'baseline')) * 100 END, 6) AS drop_pct FROM s"""))
def stage_bandwidth(spark, sf):
    return rounded(G.stage_bandwidth(_bandwidth(spark, sf), STAGES))


FLAGGED_SQL = f"""{BW_SQL}, base AS (SELECT quantile_cont(bandwidth_gbps, 0.5) AS b FROM bw WHERE t < {FAULT[0]}),
fl AS (SELECT bw.*, bandwidth_gbps < b * CAST(0.7 AS DOUBLE) AS is_degraded FROM bw, base)"""


@query("degradation_report", with_(FLAGGED_SQL, f"""SELECT total, degraded, during_fault, hits, degraded_min,
round(degraded_mean, 6) AS degraded_mean, degraded_max, round(hits / during_fault, 6) AS recall, round(hits / degraded, 6)
AS precision FROM (SELECT count(*) AS total, count(*) FILTER (is_degraded) AS degraded, count(*) FILTER (t BETWEEN
{FAULT[0]} AND {FAULT[1]}) AS during_fault, count(*) FILTER (is_degraded AND t BETWEEN {FAULT[0]} AND {FAULT[1]}) AS hits,
min(bandwidth_gbps) FILTER (is_degraded) AS degraded_min, avg(bandwidth_gbps) FILTER (is_degraded) AS degraded_mean,
max(bandwidth_gbps) FILTER (is_degraded) AS degraded_max FROM fl)"""))
def degradation_report(spark, sf):
    bw = _bandwidth(spark, sf)
    flagged = G.flag_degraded(bw, G.baseline_median(bw, FAULT[0]))
    return rounded(G.degradation_report(flagged, *FAULT))


@query("degradation_without_time", with_(TR, """, o AS (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS r FROM readings WHERE
type = 'BW')
SELECT count(*) AS total, count(*) FILTER (bandwidth_gbps < b * CAST(0.7 AS DOUBLE)) AS degraded, round(any_value(b), 6)
AS baseline FROM o, (SELECT quantile_cont(bandwidth_gbps, 0.5) AS b FROM o WHERE r < (SELECT count(*) // 3 FROM o))"""))
def degradation_without_time(spark, sf):
    """No time known: the first third of the readings is the baseline."""
    bw = parse_probe_lines(probe_lines(spark, sf, "event_id")).filter(F.col("type") == "BW")
    base = G.baseline_median(bw, None, order=("event_id",))
    flagged = G.flag_degraded(bw, base).withColumn("base", F.lit(base))
    return rounded(flagged.agg(F.count(F.lit(1)).alias("total"), F.count_if("is_degraded").alias("degraded"),
                               F.max("base").alias("baseline")))


@query("sample_summary", with_(TR, """SELECT type, count(*) AS n, round(avg(latency_us), 6) AS mean,
round(quantile_cont(latency_us, 0.5), 6) AS median, round(stddev_samp(latency_us), 6) AS stdev, min(latency_us) AS min,
max(latency_us) AS max FROM readings GROUP BY type"""))
def sample_summary(spark, sf):
    return rounded(G.sample_summary(_readings(spark, sf), "latency_us", ["type"]))


@query("overhead_delta", with_(T, """SELECT round(a, 6) AS baseline_mean, round(b, 6) AS loaded_mean, round(b - a, 6) AS
overhead_pp, round(c / 192, 6) AS process_pct FROM (SELECT avg(k / 4.0) FILTER (pass = 1) AS a, avg(k / 4.0) FILTER (pass =
2) AS b, avg(k / 8.0) FILTER (pass = 2) AS c FROM t)"""))
def overhead_delta(spark, sf):
    t = A.transfers(spark, sf)
    busy = t.select("pass", (F.col("k") / 4.0).alias("busy_pct"), (F.col("k") / 8.0).alias("cpu_pct"))
    one, two = busy.filter("pass = 1"), busy.filter("pass = 2")
    return rounded(G.overhead_delta(one, two, two, 192))


@query("smooth_by_n", with_(BW_SQL, """, o AS (SELECT *, row_number() OVER (ORDER BY t, path_id, bandwidth_gbps) - 1 AS r
FROM bw) SELECT r // 10 AS block, round(avg(t), 2) AS t, round(avg(bandwidth_gbps), 6) AS bandwidth_gbps, count(*) AS n
FROM o GROUP BY ALL"""))
def smooth_by_n(spark, sf):
    out = R.smooth_by_n(_bandwidth(spark, sf), ["t", "path_id", "bandwidth_gbps"], ["t", "bandwidth_gbps"])
    return out.select("block", F.round("t", 2).alias("t"), F.round("bandwidth_gbps", 6).alias("bandwidth_gbps"), "n")


@query("consecutive_alarm", with_(FLAGGED_SQL, f""", o AS (SELECT *, sum(CAST(is_degraded AS INTEGER)) OVER (ORDER BY t,
path_id ROWS BETWEEN 1 PRECEDING AND CURRENT ROW) AS streak FROM fl WHERE t >= {FAULT[0]})
SELECT min(t) FILTER (streak >= 2) AS detected_at, round(min(t) FILTER (streak >= 2) - {FAULT[0]}, 3) AS detection_latency
FROM o"""))
def consecutive_alarm(spark, sf):
    bw = _bandwidth(spark, sf)
    flagged = G.flag_degraded(bw, G.baseline_median(bw, FAULT[0]))
    out = W.consecutive_alarm(flagged, 2, FAULT[0], tie=["path_id"])
    return out.withColumn("detection_latency", F.round("detection_latency", 3))


# --- sorts, top-k, sets -----------------------------------------------------

@query("sort_events", with_(TBG, "SELECT path, gap_idx, start_ns FROM gaps"))
def sort_events(spark, sf):
    return R.sort_events(timeline(spark, sf).gaps, ["start_ns", "path"]).select("path", "gap_idx", "start_ns")


@query("top_paths", with_(TX, """SELECT src_dev, dst_dev, direction, src_numa, dst_numa, count(*) AS events FROM tx GROUP
BY ALL ORDER BY events DESC, 1, 2, 3, 4, 5 LIMIT 15"""))
def top_paths(spark, sf):
    return R.top_paths(traced(spark, sf), 15)


@query("busiest_path", with_(T, "SELECT path, count(*) AS events FROM t GROUP BY path ORDER BY 2 DESC, 1 LIMIT 1"))
def busiest_path(spark, sf):
    return R.busiest_path(A.transfers(spark, sf), PATH)


@query("first_k", with_(TBG, """SELECT 'all' AS scope, path, gap_idx FROM (SELECT * FROM gaps ORDER BY start_ns, path LIMIT
200) UNION ALL SELECT 'path', path, gap_idx FROM gaps QUALIFY row_number() OVER (PARTITION BY path ORDER BY start_ns) <=
50 UNION ALL SELECT 'half', path, gap_idx FROM gaps QUALIFY row_number() OVER (ORDER BY start_ns, path) <= (SELECT
count(*) // 2 FROM gaps)"""))
def first_k(spark, sf):
    gaps, order = timeline(spark, sf).gaps, ["start_ns", "path"]
    parts = {"all": R.first_k(gaps, 200, order), "path": R.first_k(gaps, 50, ["start_ns"], PATH),
             "half": R.first_fraction(gaps, 0.5, order)}
    return R.union_passes(*[df.select(F.lit(n).alias("scope"), "path", "gap_idx") for n, df in parts.items()])


@query("union_passes", with_(T, "SELECT pass, path, count(*) AS events FROM t GROUP BY ALL"))
def union_passes(spark, sf):
    t = A.transfers(spark, sf)
    both = R.union_passes(t.filter("pass = 1"), t.filter("pass = 2"))
    return both.groupBy("pass", "path").agg(F.count(F.lit(1)).alias("events"))


@query("new_gaps", with_(TBG, f"SELECT path, start_ns, end_ns FROM gaps WHERE end_ns >= {LATE_NS}"))
def new_gaps(spark, sf):
    gaps = timeline(spark, sf).gaps
    return R.new_gaps(gaps, gaps.filter(F.col("end_ns") < LATE_NS), PATH).select("path", "start_ns", "end_ns")


@query("gap_cdf", with_(TBG, """SELECT DISTINCT path, duration_ns, round(cume_dist() OVER (PARTITION BY path ORDER BY
duration_ns), 9) AS cdf FROM gaps"""))
def gap_cdf(spark, sf):
    return rounded(G.gap_cdf(timeline(spark, sf).gaps, PATH), 9)


@query("gap_autocorrelation", with_(TBG, """SELECT path, round(corr(duration_ns, before), 6) AS autocorrelation, count(*)
AS pairs FROM (SELECT path, duration_ns, lag(duration_ns, 2) OVER (PARTITION BY path ORDER BY gap_idx) AS before FROM
gaps) WHERE before IS NOT NULL GROUP BY path"""))
def gap_autocorrelation(spark, sf):
    tl = timeline(spark, sf)
    return rounded(G.gap_autocorrelation(tl.gaps, 2, PATH, tl.splits))
