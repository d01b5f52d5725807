"""Placement policies, their outcomes and metrics, triggers and severity."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import with_interval_metrics
from ..operators import aggregates as G
from ..operators import calibration as B
from ..operators import policies as P
from ..operators import severity as V
from ..operators.ranking import best_policies as pick_best
from ..operators.windows import lower_bound, trailing_survival
from . import adapter as A
from .predictions import rounded
from .q_features import EWMA_SQL
from .q_stats import BW_SQL, _bandwidth
from .registry import PATH, query, timeline
from .sql import TB, TBG, TBGP, with_

D = A.DURATIONS
PERIOD = 1_000_000 * A.SCALE            # 1 ms stands for 1 000 s here
LOW, HIGH = 500_000 * A.SCALE, 5_000_000 * A.SCALE
EWMA_MARGIN = 200_000 * A.SCALE
OUT = ["path", "gap_idx", "probe_type"]

FIT = """CASE WHEN {x} >= 5100000000000 THEN 3 WHEN {x} >= 500000000000 THEN 2 WHEN {x} >= 50000000000 THEN 1 ELSE 0 END"""
BASE = "policy, path, gap_idx, start_ns, end_ns, duration_ns, probe_type"
FIXED_SQL = f"""SELECT 'fixed_interval' AS policy, path, gap_idx, start_ns, end_ns, duration_ns, 1 AS probe_type FROM gaps
  QUALIFY row_number() OVER (PARTITION BY path, start_ns // {PERIOD} ORDER BY start_ns) = 1"""
THRESHOLD_SQL = f"""SELECT 'threshold' AS policy, path, gap_idx, start_ns, end_ns, duration_ns, CASE WHEN duration_ns >= {HIGH}
  THEN 3 ELSE 2 END AS probe_type FROM gaps WHERE duration_ns >= {LOW}"""
ORACLE_SQL = f"""SELECT 'oracle' AS policy, path, gap_idx, start_ns, end_ns, duration_ns, {FIT.format(x='duration_ns')} AS
  probe_type FROM gaps WHERE duration_ns >= 50000000000"""


def _ewma_sql(causal: bool) -> str:
    frame = "100 PRECEDING AND 1 PRECEDING" if causal else "99 PRECEDING AND CURRENT ROW"
    e = "lag(ewma) OVER (PARTITION BY path ORDER BY gap_idx)" if causal else "ewma"
    return f"""SELECT 'ewma' AS policy, path, gap_idx, start_ns, end_ns, duration_ns, {FIT.format(x='room')} AS probe_type FROM
  (SELECT *, greatest({e}, quantile_cont(duration_ns, 0.1) OVER w) - {EWMA_MARGIN} AS room, count(*) OVER w AS h FROM ew
  WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN {frame})) WHERE h >= 10 AND room >= 50000000000"""


def predictive_sql(causal: bool) -> str:
    def room(ns: int) -> str:
        return "true" if causal else f"duration_ns >= {ns}"
    return f"""SELECT 'predictive' AS policy, path, gap_idx, start_ns, end_ns, duration_ns, probe_type FROM (SELECT *, CASE WHEN p
  >= 0.8 AND {room(5100000000000)} THEN 3 WHEN p >= 0.7 AND {room(500000000000)} THEN 2 WHEN {room(50000000000)} THEN 1 ELSE 0
  END AS probe_type FROM pred WHERE horizon_ns = 500000000000) WHERE probe_type > 0"""


DEC = f"""{TBGP}, {EWMA_SQL}, dec AS ({FIXED_SQL} UNION ALL {THRESHOLD_SQL} UNION ALL {ORACLE_SQL} UNION ALL
  {_ewma_sql(True)} UNION ALL {predictive_sql(True)})"""
NS = "[50000000000, 500000000000, 5100000000000][probe_type]"
FITTED = f"""{DEC}, fo AS (SELECT *, {NS} AS probe_ns, {NS} > duration_ns AS unsafe, {NS} / duration_ns AS utilisation
  FROM dec)"""
PLACED = f"""{DEC}, dg AS (SELECT {BASE.replace('probe_type', '')} CASE WHEN low THEN 2 ELSE probe_type END AS probe_type,
  low AS downgraded FROM (SELECT *, probe_type = 3 AND duration_ns < 5100000000000 AND duration_ns >= 500000000000 AS low
  FROM dec)),
pl AS (SELECT *, {NS} AS probe_ns FROM dg WHERE duration_ns >= {NS}),
pr AS (SELECT policy, path, gap_idx, probe_type, downgraded, duration_ns, start_ns + 1000 AS s, start_ns + 1000 + probe_ns
  AS e FROM pl),
oc AS (SELECT policy, pr.path, gap_idx, probe_type, downgraded, duration_ns AS gap_during_probe_ns, s AS start_ns, e AS
  end_ns, CAST(coalesce(sum(CASE WHEN b.path IS NOT NULL THEN least(e, b.end_ns) - greatest(s, b.start_ns) END), 0) AS
  BIGINT) AS busy_overlap_ns FROM pr LEFT JOIN busy b ON b.path = pr.path AND s < b.end_ns AND e > b.start_ns GROUP BY
  ALL)"""


def _with_p(tl):
    """Gaps with ``p``, the trailing share of gaps that reach 500 us."""
    return trailing_survival(tl.gaps, [A.HORIZONS[5]], PATH, splits=tl.splits).drop("history", "horizon_ns")


def decisions(spark, sf):
    """All policies in long form over one timeline."""
    tl = timeline(spark, sf)
    runs = P.apply_policies(_with_p(tl), {
        "none": {}, "fixed_interval": {"key": PATH, "period": PERIOD},
        "threshold": {"low": LOW, "high": HIGH}, "oracle": {"durations": D},
        "ewma": {"key": PATH, "margin": EWMA_MARGIN, "durations": D, "splits": tl.splits},
        "predictive": {"key": PATH, "eta_bandwidth": 0.8, "eta_normal": 0.7, "durations": D}})
    return tl, runs.drop("p")


def placed(spark, sf):
    tl, runs = decisions(spark, sf)
    return tl, P.outcomes(P.downgrade_to_fit(runs, D), tl.busy, PATH, splits=tl.splits)


def _one(gaps, name, **options):
    return P.apply_policy(name, gaps, **options).select(*OUT)


@query("policy_none", with_(TBG, "SELECT path, count(*) AS gaps, 0 AS probes FROM gaps GROUP BY path"))
def policy_none(spark, sf):
    rows = P.policy_none(timeline(spark, sf).gaps)
    return rows.groupBy("path").agg(F.count(F.lit(1)).alias("gaps"), F.count_if(F.col("probe_type") > 0).alias("probes"))


@query("policy_fixed_interval", with_(TBG, f"SELECT path, gap_idx, probe_type FROM ({FIXED_SQL})"))
def policy_fixed_interval(spark, sf):
    return _one(timeline(spark, sf).gaps, "fixed_interval", key=PATH, period=PERIOD)


@query("policy_random")
def policy_random(spark, sf):
    return _one(timeline(spark, sf).gaps, "random", key=PATH, probability=0.1)


@query("policy_threshold", with_(TBG, f"SELECT path, gap_idx, probe_type FROM ({THRESHOLD_SQL})"))
def policy_threshold(spark, sf):
    return _one(timeline(spark, sf).gaps, "threshold", low=LOW, high=HIGH)


def _ewma(spark, sf, causal):
    tl = timeline(spark, sf)
    return _one(tl.gaps, "ewma", key=PATH, margin=EWMA_MARGIN, durations=D, causal=causal, splits=tl.splits)


@query("policy_ewma", with_(f"{TBG}, {EWMA_SQL}", f"SELECT path, gap_idx, probe_type FROM ({_ewma_sql(True)})"))
def policy_ewma(spark, sf):
    return _ewma(spark, sf, True)


@query("policy_ewma_retrospective", with_(f"{TBG}, {EWMA_SQL}", f"SELECT path, gap_idx, probe_type FROM ({_ewma_sql(False)})"))
def policy_ewma_retrospective(spark, sf):
    return _ewma(spark, sf, False)


def _predictive(spark, sf, causal):
    tl = timeline(spark, sf)
    return _one(tl.gaps, "predictive", key=PATH, predictions=_with_p(tl), eta_bandwidth=0.8, eta_normal=0.7,
                durations=D, causal=causal)


@query("policy_predictive", with_(TBGP, f"SELECT path, gap_idx, probe_type FROM ({predictive_sql(True)})"))
def policy_predictive(spark, sf):
    return _predictive(spark, sf, True)


@query("policy_predictive_retrospective", with_(TBGP, f"SELECT path, gap_idx, probe_type FROM ({predictive_sql(False)})"))
def policy_predictive_retrospective(spark, sf):
    return _predictive(spark, sf, False)


@query("policy_oracle", with_(TBG, f"SELECT path, gap_idx, probe_type FROM ({ORACLE_SQL})"))
def policy_oracle(spark, sf):
    return _one(timeline(spark, sf).gaps, "oracle", durations=D)


@query("apply_policies", with_(DEC, "SELECT policy, path, gap_idx, probe_type FROM dec"))
def apply_policies(spark, sf):
    return decisions(spark, sf)[1].select("policy", *OUT)


@query("downgrade_to_fit", with_(PLACED, "SELECT policy, path, gap_idx, probe_type, downgraded, probe_ns FROM pl"))
def downgrade_to_fit(spark, sf):
    return P.downgrade_to_fit(decisions(spark, sf)[1], D).select("policy", *OUT, "downgraded", "probe_ns")


@query("limit_per_window", with_(DEC, """SELECT policy, path, gap_idx, probe_type FROM dec QUALIFY row_number() OVER
(PARTITION BY policy, start_ns // 3600000000000 ORDER BY start_ns, path, gap_idx) <= 3"""))
def limit_per_window(spark, sf):
    return P.limit_per_window(decisions(spark, sf)[1], 3, 3600 * 10**9).select("policy", *OUT)


@query("outcomes", with_(PLACED, """SELECT policy, path, gap_idx, probe_type, start_ns, end_ns, busy_overlap_ns,
busy_overlap_ns = 0 AS safe FROM oc"""))
def outcomes(spark, sf):
    return placed(spark, sf)[1].select("policy", *OUT, "start_ns", "end_ns", "busy_overlap_ns", "safe")


@query("fit_outcomes", with_(FITTED, "SELECT policy, path, gap_idx, probe_ns, unsafe, round(utilisation, 9) AS utilisation FROM fo"))
def fit_outcomes(spark, sf):
    return rounded(P.fit_outcomes(decisions(spark, sf)[1], D).select(
        "policy", "path", "gap_idx", "probe_ns", "unsafe", "utilisation"), 9)


def _placed_one_by_one(ctes: str, of: str) -> str:
    """Each placed probe is followed by the first whose gap starts at its end or later."""
    return f"""WITH RECURSIVE {ctes}, c AS (SELECT policy, path, min(gap_idx) AS gap_idx FROM {of} GROUP BY ALL UNION ALL
  SELECT c.policy, c.path, min(o.gap_idx) FROM c JOIN {of} p USING (policy, path, gap_idx) JOIN {of} o ON o.policy = c.policy
  AND o.path = c.path AND o.gap_idx > c.gap_idx AND o.start_ns - 1000 >= p.end_ns GROUP BY c.policy, c.path)
SELECT policy, path, gap_idx FROM c"""


@query("one_per_path_at_a_time", _placed_one_by_one(PLACED, "oc"))
def one_per_path_at_a_time(spark, sf):
    tl, out = placed(spark, sf)
    return P.one_per_path_at_a_time(out, PATH, splits=tl.splits).select("policy", "path", "gap_idx")


@query("one_per_path_at_a_time_any_length", _placed_one_by_one(f"""{DEC}, an AS (SELECT policy, path, gap_idx, start_ns + 1000 AS
  start_ns, start_ns + 1000 + {NS} AS end_ns FROM dec)""", "an"))
def one_per_path_at_a_time_any_length(spark, sf):
    """Probes that were not made to fit their gaps, so that many run into later gaps."""
    tl, runs = decisions(spark, sf)
    out = P.outcomes(P.with_probe_ns(runs, D), tl.busy, PATH, splits=tl.splits)
    return P.one_per_path_at_a_time(out, PATH, splits=tl.splits).select("policy", "path", "gap_idx")


# --- policy metrics ---------------------------------------------------------

WINDOW_SQL = "(SELECT arg_max(end_ns, start_ns) - min(start_ns) FROM gaps)"
METRICS_SQL = f"""{FITTED}, pm AS (SELECT policy, count(*) AS total_probes, count(*) FILTER (probe_type = 3) AS bw_probes,
  count(*) FILTER (probe_type = 2) AS normal_probes, count(*) FILTER (probe_type = 1) AS tiny_probes, round(100.0 * count(*)
  FILTER (probe_type = 3) / count(*), 4) AS bw_ratio_pct, round(100.0 * sum(probe_ns) / {WINDOW_SQL}, 4) AS overhead_pct,
  round(100.0 * sum(utilisation) / count(*), 4) AS avg_gap_util_pct, count(*) FILTER (unsafe) AS unsafe_probes, round(100.0 *
  count(*) FILTER (unsafe) / count(*), 4) AS unsafe_rate_pct, count(DISTINCT path) AS paths_covered FROM fo GROUP BY
  policy)"""


def _metrics(spark, sf):
    tl, runs = decisions(spark, sf)
    return rounded(G.policy_metrics(P.fit_outcomes(runs, D), P.trace_window_ns(tl.gaps), key=PATH), 4)


@query("policy_metrics", with_(METRICS_SQL, "SELECT * FROM pm"))
def policy_metrics(spark, sf):
    return _metrics(spark, sf)


@query("policy_metrics_by_path", with_(FITTED, """SELECT policy, path, count(*) AS total, count(*) FILTER (probe_type = 3)
AS bw, count(*) FILTER (probe_type = 2) AS normal, count(*) FILTER (probe_type = 1) AS tiny, count(*) FILTER (unsafe) AS
unsafe FROM fo GROUP BY ALL"""))
def policy_metrics_by_path(spark, sf):
    return G.policy_metrics_by_path(P.fit_outcomes(decisions(spark, sf)[1], D), PATH)


@query("best_policies", with_(METRICS_SQL, """SELECT arg_max(policy, (bw_ratio_pct, policy)) AS best_bandwidth,
max(bw_ratio_pct) AS best_bw_ratio_pct, arg_min(policy, (unsafe_rate_pct, policy)) FILTER (total_probes > 100) AS safest,
min(unsafe_rate_pct) FILTER (total_probes > 100) AS lowest_unsafe_rate_pct FROM pm WHERE policy <> 'oracle'"""))
def best_policies(spark, sf):
    return pick_best(_metrics(spark, sf))


RUN_SQL = f"""{PLACED}, rs AS (SELECT policy, count(*) AS scheduled, count(*) AS executed, count(*) FILTER (busy_overlap_ns =
  0) AS safe_probes, count(*) FILTER (busy_overlap_ns > 0) AS unsafe_probes, 0 AS cancelled, count(*) FILTER (downgraded) AS
  downgraded, CAST(sum(end_ns - start_ns) AS BIGINT) AS total_probing_ns, sum(busy_overlap_ns) / sum(end_ns - start_ns) AS
  probe_overlap_ratio, count(*) FILTER (busy_overlap_ns = 0) / count(*) AS safe_probing_ratio FROM oc GROUP BY policy)"""


@query("run_summary", with_(RUN_SQL, """SELECT * REPLACE (round(probe_overlap_ratio, 9) AS probe_overlap_ratio,
round(safe_probing_ratio, 6) AS safe_probing_ratio) FROM rs"""))
def run_summary(spark, sf):
    out = G.run_summary(placed(spark, sf)[1])
    return out.withColumns({"probe_overlap_ratio": F.round("probe_overlap_ratio", 9),
                            "safe_probing_ratio": F.round("safe_probing_ratio", 6)})


@query("probe_overhead_and_rate", with_(RUN_SQL, f"""SELECT policy, round(total_probing_ns / w * 100, 3) AS overhead_pct,
round(executed / (w / 1e9), 2) AS probes_per_s FROM rs, (SELECT {WINDOW_SQL} AS w)"""))
def probe_overhead_and_rate(spark, sf):
    tl, out = placed(spark, sf)
    runs = G.run_summary(out).withColumn("total_time_ns", P.trace_window_ns(tl.gaps))
    return G.probe_rate(G.probe_overhead(runs)).select("policy", "overhead_pct", "probes_per_s")


@query("probe_type_counts", with_(PLACED, "SELECT policy, probe_type, count(*) AS probes FROM oc GROUP BY ALL"))
def probe_type_counts(spark, sf):
    return G.probe_type_counts(placed(spark, sf)[1])


@query("gap_coverage", with_(PLACED, """SELECT policy, count(*) AS gaps_probed, count(DISTINCT gap_during_probe_ns) FILTER
(busy_overlap_ns = 0) AS gaps_safe_probed, n AS total_gaps, round(100.0 * count(DISTINCT gap_during_probe_ns) FILTER
(busy_overlap_ns = 0) / n, 1) AS coverage_pct, round(100.0 * count(*) / n, 1) AS utilization_pct FROM oc, (SELECT count(*)
AS n FROM gaps) GROUP BY policy, n"""))
def gap_coverage(spark, sf):
    tl, out = placed(spark, sf)
    return G.gap_coverage(out, tl.gaps.agg(F.count(F.lit(1))).scalar())


@query("compare_policies", with_(RUN_SQL, f"""SELECT policy, executed, round(safe_probing_ratio * 100, 1) AS safe_pct,
round(probe_overlap_ratio * 100, 1) AS overlap_pct, unsafe_probes AS harmful, round(total_probing_ns * 100.0 / {WINDOW_SQL},
2) AS overhead_pct, downgraded FROM rs"""))
def compare_policies(spark, sf):
    tl, out = placed(spark, sf)
    return G.compare_policies(out, P.trace_window_ns(tl.gaps))


@query("prediction_feedback", with_(PLACED, """, lb AS (SELECT path, gap_idx, CASE WHEN count(*) OVER w >= 20 THEN
quantile_cont(duration_ns, 0.05) OVER w ELSE 0 END AS lb FROM gaps WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS
BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT path, gap_idx, probe_type, round(lb, 0) AS predicted_lower_ns, busy_overlap_ns > 0 AS overlap_flag, round(lb -
gap_during_probe_ns, 0) AS prediction_error FROM oc JOIN lb USING (path, gap_idx) WHERE policy = 'oracle'"""))
def prediction_feedback(spark, sf):
    tl = timeline(spark, sf)
    runs = P.apply_policy("oracle", tl.gaps, durations=D)
    out = P.outcomes(P.downgrade_to_fit(runs, D), tl.busy, PATH, splits=tl.splits)
    fb = B.prediction_feedback(lower_bound(tl.gaps, key=PATH, splits=tl.splits), out, PATH)
    return fb.select("path", "gap_idx", "probe_type", F.round("predicted_lower_ns", 0).alias("predicted_lower_ns"),
                     "overlap_flag", F.round("prediction_error", 0).alias("prediction_error"))


# --- triggers and severity --------------------------------------------------

BW = "CASE WHEN end_ns > start_ns THEN bytes_total / (end_ns - start_ns) ELSE 0 END"
TRIGGER_SQL = f"""{TB}, tr AS (SELECT *, {BW} AS bandwidth_gbps FROM busy WHERE {BW} * 1000 >= 0.5 AND {BW} * 1000 <= 2.0)"""


def _triggers(spark, sf):
    return V.trigger_windows(with_interval_metrics(timeline(spark, sf).busy), 0.5, 2.0)


@query("trigger_windows", with_(TRIGGER_SQL, "SELECT path, start_ns, end_ns, round(bandwidth_gbps, 9) AS bandwidth_gbps FROM tr"))
def trigger_windows(spark, sf):
    return rounded(_triggers(spark, sf).select("path", "start_ns", "end_ns", "bandwidth_gbps"), 9)


@query("cooldown", with_(TRIGGER_SQL, """SELECT path, start_ns, end_ns FROM tr QUALIFY row_number() OVER (PARTITION BY
start_ns // 3000000000000 ORDER BY start_ns, path) = 1"""))
def cooldown(spark, sf):
    return V.cooldown(_triggers(spark, sf), 3000 * 10**9).select("path", "start_ns", "end_ns")


@query("match_probe_window", with_(f"{TB}", f""", b AS (SELECT *, {BW} AS g FROM busy)
SELECT t.event_id, b.start_ns AS window_start_ns, b.end_ns AS window_end_ns, round(g, 9) AS window_gbps, round(g + k / 1e5,
9) AS merged_gbps, round((g + k / 1e5) / 0.002, 6) AS throughput_ratio FROM t JOIN b ON b.path = t.path AND b.start_ns <=
t.start_ns + 20000000000 AND b.end_ns > t.start_ns + 20000000000"""))
def match_probe_window(spark, sf):
    """A probe 20 s after each event starts meets the window that is open then."""
    tl = timeline(spark, sf)
    probes = tl.transfers.select("event_id", "path", (F.col("start_ns") + 20 * 10**9).alias("start_ns"),
                                 (F.col("k") / 1e5).alias("probe_gbps"))
    out = V.match_probe_window(probes, with_interval_metrics(tl.busy), PATH, 0.002, tl.splits)
    return out.select("event_id", "window_start_ns", "window_end_ns", F.round("window_gbps", 9).alias("window_gbps"),
                      F.round("merged_gbps", 9).alias("merged_gbps"),
                      F.round("throughput_ratio", 6).alias("throughput_ratio"))


@query("severity", with_(BW_SQL, """, l AS (SELECT path_id, avg(bandwidth_gbps) AS bw, avg(latency_us) AS lat,
coalesce(max(t) FILTER (bandwidth_gbps < 6) - min(t) FILTER (bandwidth_gbps < 6), 0) AS long_s, avg(CASE WHEN
bandwidth_gbps < 6 THEN 1.0 ELSE 0 END) AS often FROM bw GROUP BY path_id), s AS (SELECT avg(CASE WHEN often > 0 THEN 1.0
ELSE 0 END) AS share FROM l)
SELECT path_id, round(bw, 6) AS bandwidth_gbps, round(lat, 6) AS latency_us, round(often, 6) AS abnormal_ratio, CASE WHEN
slow AND spread THEN 'P0' WHEN slow THEN 'P1' WHEN NOT spread AND path_id % 2 = 0 THEN 'P2' ELSE 'none' END AS severity FROM
(SELECT *, bw < 11 OR lat > 60 AS slow, long_s > 1728000 OR often > 0.4 OR share > 0.99 AS spread FROM l, s)"""))
def severity(spark, sf):
    signs = V.link_signs(_bandwidth(spark, sf), F.col("bandwidth_gbps") < 6, ["path_id"])
    out = V.severity(signs.withColumn("throughput_drop", F.col("path_id") % 2 == 0), 11, 60, 1_728_000, 0.4, 0.99)
    return rounded(out.select("path_id", "bandwidth_gbps", "latency_us", "abnormal_ratio", "severity"))


def _chain(source: str, period: int) -> str:
    return f"""c AS (SELECT path, min(start_ns) AS t0 FROM {source} GROUP BY path UNION ALL SELECT c.path, min(g.start_ns) AS t0
  FROM c JOIN {source} g ON g.path = c.path AND g.start_ns >= c.t0 + {period} GROUP BY c.path)"""


@query("policy_minimum_spacing", f"""WITH RECURSIVE {TBG}, {_chain('gaps', PERIOD)} SELECT gaps.path, gap_idx, 1 AS probe_type
FROM gaps JOIN c ON gaps.path = c.path AND start_ns = c.t0""")
def policy_minimum_spacing(spark, sf):
    """Fixed interval with at least a period between neighbours on a path."""
    runs = P.apply_policy("fixed_interval", timeline(spark, sf).gaps, key=PATH, period=PERIOD, minimum=True)
    return runs.select(*OUT)


@query("cooldown_minimum", f"""WITH RECURSIVE {TRIGGER_SQL}, {_chain('tr', 3000 * 10**9)} SELECT path, t0 AS start_ns FROM c""")
def cooldown_minimum(spark, sf):
    """Triggers of a path at least 3 000 s apart."""
    return V.cooldown(_triggers(spark, sf), 3000 * 10**9, PATH, minimum=True).select("path", "start_ns")
