"""Trailing-window features, drift, labels, baselines, calibration and safe windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import calibration as B
from ..operators import labels as L
from ..operators import windows as W
from ..operators.aggregates import classification_metrics
from . import adapter as A
from .endpoints import traced
from .predictions import rounded, trailing_predictions
from .q_stats import LATE, late
from .registry import PATH, query, timeline
from .sql import CONFUSION, HZ, RATES, T, TBG, TBGP, TU, TX, edges, gapped, merged, with_

def whole_ns(df):
    """Nanosecond features rounded for comparison.

    Times are multiples of a microsecond, so quantiles and means fall on or far from half a nanosecond.
    Deviations and EWMA depend on the order of summation and are compared in coarser steps.
    """
    out = []
    for c, kind in df.dtypes:
        if kind != "double":
            out.append(F.col(c))
        elif c.endswith("std"):
            out.append(F.round(F.col(c) / 1e9, 1).alias(c))
        elif c == "ewma":
            out.append(F.round(F.col(c) / 1e9, 6).alias(c))
        elif c.endswith(("rate", "score", "change", "norm")):
            out.append(F.round(c, 9).alias(c))
        else:
            out.append(F.round(c, 0).alias(c))
    return df.select(*out)


def _q(p: float, frame: str, x: str = "duration_ns") -> str:
    return f"quantile_cont({x}, {p}) OVER {frame}"


GAP_FEATURES_SQL = f"""gf AS (SELECT path, gap_idx, duration_ns, {_q(.1, 'w')} AS f_gap_p10, {_q(.5, 'w')} AS f_gap_p50,
  {_q(.9, 'w')} AS f_gap_p90, avg(duration_ns) OVER w AS f_gap_mean, stddev_pop(duration_ns) OVER w AS f_gap_std,
  lag(duration_ns) OVER (PARTITION BY path ORDER BY gap_idx) AS f_gap_last, avg(duration_ns) OVER (PARTITION BY path
  ORDER BY gap_idx ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS f_gap_last5_mean FROM gaps
  WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 50 PRECEDING AND 1 PRECEDING))"""
GF_OUT = ", ".join(f"round({c} / 1e9, 1) AS {c}" if c.endswith("std") else f"round(CAST({c} AS DOUBLE), 0) AS {c}"
                   for c in K.GAP_FEATURES)

BURST_SQL = f"""bf AS (SELECT path, burst_idx, {_q(.5, 'w', 'b')} AS f_burst_p50, {_q(.9, 'w', 'b')} AS f_burst_p90,
  avg(b) OVER w AS f_burst_mean, count(*) OVER w / greatest((end_ns - first_ns) / 1e9, 0.001) AS f_burst_rate,
  b AS f_burst_last_duration FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY start_ns) - 1 AS burst_idx FROM
  (SELECT *, end_ns - start_ns AS b, min(start_ns) OVER (PARTITION BY path) AS first_ns FROM busy) WHERE b > 0)
  WINDOW w AS (PARTITION BY path ORDER BY burst_idx ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))"""
BF_OUT = ", ".join(f"round(CAST({c} AS DOUBLE), 0) AS {c}" for c in K.BURST_FEATURES if c != "f_burst_rate")


@query("gap_features", with_(f"{TBG}, {GAP_FEATURES_SQL}", f"SELECT path, gap_idx, {GF_OUT} FROM gf WHERE gap_idx >= 1"))
def gap_features(spark, sf):
    tl = timeline(spark, sf)
    return whole_ns(W.gap_features(tl.gaps, PATH, splits=tl.splits).select("path", "gap_idx", *K.GAP_FEATURES))


@query("burst_features", with_(f"{TBG}, {BURST_SQL}", f"""SELECT path, burst_idx, {BF_OUT}, round(f_burst_rate, 9) AS
f_burst_rate FROM bf"""))
def burst_features(spark, sf):
    tl = timeline(spark, sf)
    return whole_ns(W.burst_features(tl.busy, PATH, splits=tl.splits))


ROWS_SQL = f"""{TBG}, {GAP_FEATURES_SQL}, {BURST_SQL}, fr AS (SELECT gf.*, bf.* EXCLUDE (path, burst_idx) FROM gf LEFT JOIN
bf ON bf.path = gf.path AND bf.burst_idx = least(gf.gap_idx, (SELECT count(*) FROM busy b WHERE b.path = gf.path AND
b.end_ns > b.start_ns)) - 1)"""


@query("feature_rows", with_(ROWS_SQL, f"""SELECT path, gap_idx, {GF_OUT}, {BF_OUT}, CAST(2 AS DOUBLE) AS
f_direction_code, CAST(0 AS DOUBLE) AS f_burst_rate FROM fr WHERE gap_idx >= 50"""))
def feature_rows(spark, sf):
    tl = timeline(spark, sf)
    rows = W.feature_rows(tl.gaps, tl.busy, PATH, splits=tl.splits)
    return whole_ns(rows.select("path", "gap_idx", *K.GAP_FEATURES, *K.BURST_FEATURES, "f_direction_code"))


@query("feature_rows_many_paths", with_(f"{TU}, {merged()}, {gapped()}, {GAP_FEATURES_SQL}", f"""SELECT path, gap_idx,
{GF_OUT} FROM gf WHERE gap_idx >= 10"""))
def feature_rows_many_paths(spark, sf):
    """Window 50 over many small paths, skipping the short ones."""
    tl = timeline(spark, sf, "user_id")
    rows = W.feature_rows(tl.gaps, tl.busy, PATH, min_history=10, splits=tl.splits)
    return whole_ns(rows.select("path", "gap_idx", *K.GAP_FEATURES))


EWMA_SQL = """ew AS (SELECT path, gap_idx, duration_ns, start_ns, end_ns, list_reduce(list(CAST(duration_ns AS DOUBLE)) OVER
  (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 600 PRECEDING AND CURRENT ROW), lambda a, x: a * CAST(0.9 AS DOUBLE) + x
  * CAST(0.1 AS DOUBLE)) AS ewma FROM gaps)"""


@query("ewma", with_(f"{TBG}, {EWMA_SQL}", "SELECT path, gap_idx, round(ewma / 1e9, 6) AS ewma FROM ew"))
def ewma(spark, sf):
    return whole_ns(W.ewma(timeline(spark, sf).gaps, PATH).select("path", "gap_idx", "ewma"))


@query("trailing_survival", with_(TBGP, "SELECT path, gap_idx, horizon_ns, history, p FROM pred"))
def trailing_survival(spark, sf):
    return trailing_predictions(spark, sf)[1].select("path", "gap_idx", "horizon_ns", "history", "p")


@query("trailing_quantile", with_(TBG, f"""SELECT path, gap_idx, round(CASE WHEN count(*) OVER w >= 10 THEN {_q(.1, 'w')}
ELSE 0 END, 0) AS "quantile" FROM gaps WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 100 PRECEDING AND
1 PRECEDING)"""))
def trailing_quantile(spark, sf):
    tl = timeline(spark, sf)
    return whole_ns(W.trailing_quantile(tl.gaps, key=PATH, splits=tl.splits).select("path", "gap_idx", "quantile"))


@query("quantile_survival", with_(TBGP, f""", q AS (SELECT path, gap_idx, {_q(.1, 'w')} AS p10 FROM gaps WINDOW w AS
(PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING))
SELECT path, gap_idx, horizon_ns, CASE WHEN p10 < horizon_ns THEN p * 0.5 ELSE p END AS p FROM pred JOIN q USING (path,
gap_idx)"""))
def quantile_survival(spark, sf):
    tl = timeline(spark, sf)
    out = W.quantile_survival(tl.gaps, A.HORIZONS, PATH, splits=tl.splits)
    return out.select("path", "gap_idx", "horizon_ns", "p")


@query("lower_bound", with_(TBG, f"""SELECT path, gap_idx, round(CASE WHEN count(*) OVER w >= 20 THEN {_q(.05, 'w')} ELSE 0
END, 0) AS g_lower_bound FROM gaps WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 100 PRECEDING AND 1
PRECEDING)"""))
def lower_bound(spark, sf):
    tl = timeline(spark, sf)
    return whole_ns(W.lower_bound(tl.gaps, key=PATH, splits=tl.splits).select("path", "gap_idx", "g_lower_bound"))


@query("lower_bound_flat", with_(TBG, """SELECT path, count(*) AS n, round(quantile_cont(duration_ns, 0.05), 0) AS
g_lower_bound FROM gaps GROUP BY path"""))
def lower_bound_flat(spark, sf):
    return whole_ns(L.lower_bound_flat(timeline(spark, sf).gaps, key=PATH))


@query("rolling_stats", with_(TBG, """SELECT path, gap_idx, round(avg(duration_ns) OVER n, 0) AS roll_mean,
round(coalesce(stddev_samp(duration_ns) OVER n, 0) / 1e9, 1) AS roll_std, round(coalesce(abs(duration_ns -
avg(duration_ns) OVER p) / avg(duration_ns) OVER p, 0), 9) AS relative_change FROM gaps WINDOW n AS (PARTITION BY path
ORDER BY gap_idx ROWS BETWEEN 99 PRECEDING AND CURRENT ROW), p AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 100
PRECEDING AND 1 PRECEDING)"""))
def rolling_stats(spark, sf):
    tl = timeline(spark, sf)
    return whole_ns(W.rolling_stats(tl.gaps, PATH, splits=tl.splits)
                   .select("path", "gap_idx", "roll_mean", "roll_std", "relative_change"))


def _z(c: str) -> str:
    return (f"least(abs({c} - avg({c}) OVER w) / CASE WHEN stddev_pop({c}) OVER w < 1e-6 THEN 1 ELSE stddev_pop({c}) OVER w "
            "END / 3.0, 1.0)")


@query("drift_score", with_(f"{TBG}, {GAP_FEATURES_SQL}", f""", d AS (SELECT path, gap_idx, CASE WHEN count(*) OVER w >= 50
THEN ({_z('f_gap_p50')} + {_z('f_gap_mean')} + {_z('f_gap_last')}) / 3 ELSE 0 END AS s FROM gf WHERE gap_idx >= 1 WINDOW w
AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 200 PRECEDING AND 1 PRECEDING))
SELECT path, gap_idx, round(s, 6) AS drift_score, s > 0.3 AS drifted FROM d"""))
def drift_score(spark, sf):
    tl = timeline(spark, sf)
    features = W.gap_features(tl.gaps, PATH, splits=tl.splits)
    out = W.drift_score(features, ["f_gap_p50", "f_gap_mean", "f_gap_last"], PATH, splits=tl.splits)
    return out.select("path", "gap_idx", F.round("drift_score", 6).alias("drift_score"), "drifted")


@query("phase_shift", with_(TBG, """SELECT path, gap_idx, coalesce(gap_idx >= 99 AND abs(r - o) / o > 0.3, false) AS
phase_shift FROM (SELECT path, gap_idx, avg(duration_ns) OVER (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 49 PRECEDING
AND CURRENT ROW) AS r, avg(duration_ns) OVER (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 50
PRECEDING) AS o FROM gaps)"""))
def phase_shift(spark, sf):
    tl = timeline(spark, sf)
    return W.phase_shift(tl.gaps, PATH, splits=tl.splits).select("path", "gap_idx", "phase_shift")


@query("number_gaps", with_(TBG, "SELECT path, gap_idx, start_ns FROM gaps"))
def number_gaps(spark, sf):
    tl = timeline(spark, sf)
    return W.number_gaps(tl.gaps.drop("gap_idx"), PATH, splits=tl.splits).select("path", "gap_idx", "start_ns")


@query("history_snapshot", with_(TBG, """, b AS (SELECT path, row_number() OVER (PARTITION BY path ORDER BY start_ns) AS j,
row_number() OVER (PARTITION BY path ORDER BY start_ns) - 1 AS j0, end_ns - start_ns AS len FROM busy), h AS (SELECT path,
j, count(*) OVER w AS n, CAST(sum(len) OVER w AS BIGINT) AS s FROM b WINDOW w AS (PARTITION BY path ORDER BY j ROWS BETWEEN
63 PRECEDING AND CURRENT ROW))
SELECT g.path, g.gap_idx, least(gap_idx, 64) AS n_gaps, CAST(coalesce(sum(duration_ns) OVER (PARTITION BY g.path ORDER BY
gap_idx ROWS BETWEEN 64 PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS gap_sum, h.n AS n_busy, h.s AS busy_sum FROM gaps g
JOIN h ON h.path = g.path AND h.j = greatest(g.gap_idx, 1)"""))
def history_snapshot(spark, sf):
    tl = timeline(spark, sf)
    h = W.history_snapshot(tl.gaps, tl.busy, PATH, splits=tl.splits)
    zero = F.lit(0).cast("long")
    return h.select("path", "gap_idx", F.size("previous_gaps").alias("n_gaps"),
                    F.aggregate("previous_gaps", zero, lambda a, x: a + x).alias("gap_sum"),
                    F.size("previous_busy").alias("n_busy"),
                    F.aggregate("previous_busy", zero, lambda a, x: a + x["end_ns"] - x["start_ns"]).alias("busy_sum"))


# --- labels and baselines ---------------------------------------------------

@query("horizon_labels", with_(TBGP, "SELECT path, gap_idx, horizon_ns, label FROM pred"))
def horizon_labels(spark, sf):
    return L.horizon_labels(timeline(spark, sf).gaps, A.HORIZONS).select("path", "gap_idx", "horizon_ns", "label")


@query("training_set", with_(ROWS_SQL, f"""SELECT path, gap_idx, {GF_OUT}, {BF_OUT}, CAST(duration_ns >= 250000000000 AS
INTEGER) AS y_250000000000, CAST(duration_ns >= 1000000000000 AS INTEGER) AS y_1000000000000 FROM fr WHERE gap_idx >= 5"""))
def training_set(spark, sf):
    tl = timeline(spark, sf)
    rows = L.training_set(tl.gaps, tl.busy, PATH, A.HORIZONS, splits=tl.splits)
    burst = [c for c in K.BURST_FEATURES if c != "f_burst_rate"]
    return whole_ns(rows.select("path", "gap_idx", *K.GAP_FEATURES, *burst, "y_250000000000", "y_1000000000000"))


@query("last_gap_training_set", with_(ROWS_SQL, f"""SELECT path, gap_idx, {GF_OUT}, CAST(duration_ns >= 500000000000 AS
INTEGER) AS y_500000000000 FROM fr QUALIFY gap_idx = max(gap_idx) OVER (PARTITION BY path)"""))
def last_gap_training_set(spark, sf):
    tl = timeline(spark, sf)
    rows = L.last_gap_training_set(tl.gaps, tl.busy, PATH, A.HORIZONS, splits=tl.splits)
    return whole_ns(rows.select("path", "gap_idx", *K.GAP_FEATURES, "y_500000000000"))


TEST_METRICS = f"""SELECT horizon_ns, tp, fp, fn, tn, {RATES}, n FROM (SELECT horizon_ns, {CONFUSION} FROM scored GROUP BY 1)"""


def _scored(rate: str, train: str = f"gaps WHERE NOT {LATE}") -> str:
    return f""", {HZ}, r AS (SELECT horizon_ns, {rate} AS p FROM hz CROSS JOIN (SELECT * FROM {train}) g GROUP BY 1),
scored AS (SELECT horizon_ns, p, CAST(duration_ns >= horizon_ns AS INTEGER) AS label FROM gaps JOIN r ON {LATE})
{TEST_METRICS}"""


def _passes(spark, sf):
    gaps = timeline(spark, sf).gaps
    return gaps.filter(~late()), gaps.filter(late())


@query("base_rate_baseline", with_(TBG, _scored("avg(CASE WHEN duration_ns >= horizon_ns THEN CAST(1 AS DOUBLE) ELSE 0 END)")))
def base_rate_baseline(spark, sf):
    return rounded(classification_metrics(L.base_rate_baseline(*_passes(spark, sf), A.HORIZONS)))


@query("mean_threshold_baseline", with_(TBG, _scored("CAST(avg(duration_ns) >= horizon_ns AS DOUBLE)")))
def mean_threshold_baseline(spark, sf):
    return rounded(classification_metrics(L.mean_threshold_baseline(*_passes(spark, sf), A.HORIZONS)))


@query("ewma_eval", with_(TBG, _scored("avg(CASE WHEN duration_ns >= horizon_ns THEN CAST(1 AS DOUBLE) ELSE 0 END)",
                                      f"gaps WHERE NOT {LATE} ORDER BY start_ns DESC, path DESC LIMIT 100")))
def ewma_eval(spark, sf):
    return rounded(L.ewma_eval(*_passes(spark, sf), A.HORIZONS, ["start_ns", "path"]))


@query("constant_model", with_(TBG, """SELECT CAST(500000000000 AS BIGINT) AS horizon_ns, round(avg(CASE WHEN duration_ns
>= 500000000000 THEN CAST(1 AS DOUBLE) ELSE 0 END), 9) AS p FROM gaps"""))
def constant_model(spark, sf):
    return rounded(L.constant_model(timeline(spark, sf).gaps, A.HORIZONS[5]), 9)


# --- calibration and confidence --------------------------------------------

# Every p is put into its bin once, and everything after joins on the bin's number.
CALIBRATION_SQL = f"""{edges()}, binned AS MATERIALIZED (SELECT path, gap_idx, horizon_ns, start_ns, p, label, CASE
  {' '.join(f"WHEN p < (SELECT upper FROM bins WHERE bin = {i}) THEN {i}" for i in range(10))} END AS b FROM pred), hits AS (
  SELECT b, count(*) AS n, avg(CAST(label AS DOUBLE)) AS a FROM binned WHERE {LATE.replace('>=', '<')} GROUP BY b), cal AS
  (SELECT bin, lower, upper, coalesce(n, 0) AS "count", coalesce(a, 0) AS accuracy FROM bins LEFT JOIN hits ON bin = b)"""


@query("fit_calibration", with_(f"{TBGP}, {CALIBRATION_SQL}", """SELECT bin, round(lower, 6) AS lower, round(upper, 6) AS
upper, "count", round(accuracy, 6) AS accuracy FROM cal"""))
def fit_calibration(spark, sf):
    pred = trailing_predictions(spark, sf)[1]
    return rounded(B.fit_calibration(pred.filter(~late())))


@query("apply_calibration", with_(f"{TBGP}, {CALIBRATION_SQL}", f"""SELECT path, gap_idx, horizon_ns, round(CASE WHEN
"count" >= 5 THEN accuracy ELSE p END, 6) AS p_calibrated FROM binned LEFT JOIN cal ON b = bin WHERE {LATE}"""))
def apply_calibration(spark, sf):
    pred = trailing_predictions(spark, sf)[1]
    out = B.apply_calibration(pred.filter(late()), B.fit_calibration(pred.filter(~late())))
    return out.select("path", "gap_idx", "horizon_ns", F.round("p_calibrated", 6).alias("p_calibrated"))


@query("table_calibration_error", with_(f"{TBGP}, {CALIBRATION_SQL}", """SELECT round(sum("count" * abs(accuracy - (lower +
upper) / 2)) / sum("count"), 6) AS ece FROM cal"""))
def table_calibration_error(spark, sf):
    pred = trailing_predictions(spark, sf)[1]
    return rounded(B.table_calibration_error(B.fit_calibration(pred.filter(~late()))))


@query("merge_calibration", with_(f"{TBGP}, {edges()}", """SELECT bin, count(p) AS "count", round(coalesce(avg(CAST(label AS
DOUBLE)), 0), 6) AS accuracy FROM bins LEFT JOIN pred ON p >= lower AND p < upper GROUP BY bin"""))
def merge_calibration(spark, sf):
    """Tables of two passes together are the table of both."""
    pred = trailing_predictions(spark, sf)[1]
    out = B.merge_calibration(B.fit_calibration(pred.filter(~late())), B.fit_calibration(pred.filter(late())))
    return out.select("bin", "count", F.round("accuracy", 6).alias("accuracy"))


@query("quality_ratios", with_(TX, """SELECT path, round(u, 9) AS unknown_path_ratio, round(a, 9) AS
async_uncertainty_ratio, round(d, 9) AS drop_rate, n, round(greatest(0.0, 1 - (least(0.3, d * 3) + least(0.2, u * 2) +
least(0.5, a))), 9) AS data_confidence FROM (SELECT path, avg(CASE WHEN k % 50 = 0 THEN 1.0 ELSE 0 END) AS u, avg(CASE WHEN
k % 5 = 1 THEN 1.0 ELSE 0 END) AS a, avg(CASE WHEN k % 40 = 0 THEN 1.0 ELSE 0 END) AS d, count(*) AS n FROM tx GROUP BY
path)"""))
def quality_ratios(spark, sf):
    t, k = traced(spark, sf), F.col("k")
    for bit, when in ((K.FLAG_UNKNOWN_PATH, k % 50 == 0), (K.FLAG_ASYNC_UNCERTAINTY, k % 5 == 1),
                      (K.FLAG_RING_DROP, k % 40 == 0)):
        t = t.withColumn("quality_flags", C.set_flag("quality_flags", bit, when))
    return rounded(B.quality_ratios(t, PATH), 9)


@query("safe_windows", with_(TBG, f""", {HZ}, l AS (SELECT *, max(gap_idx) OVER (PARTITION BY path) AS m FROM gaps), r AS
(SELECT path, count(*) AS history, max(end_ns) AS t_publish, CAST(floor(quantile_cont(duration_ns, 0.05)) AS BIGINT) AS
g_lower_bound FROM l WHERE gap_idx > m - 100 GROUP BY path), s AS (SELECT path, horizon_ns, round(avg(CASE WHEN duration_ns
>= horizon_ns THEN CAST(1 AS DOUBLE) ELSE 0 END), 4) AS p FROM l, hz WHERE gap_idx > m - 100 GROUP BY ALL)
SELECT path, t_publish, g_lower_bound // 1000 AS g_lower_us, history, horizon_ns, p AS p_safe, p AS confidence, CASE WHEN p
>= 0.98 THEN 3 WHEN p >= 0.95 THEN 2 WHEN p >= 0.9 THEN 1 ELSE 0 END AS allowed_probe_type, CASE WHEN p >= 0.9 THEN 0 ELSE 1
END AS reason_code FROM r JOIN s USING (path)"""))
def safe_windows(spark, sf):
    tl = timeline(spark, sf)
    out = B.safe_windows(tl.gaps, A.HORIZONS, PATH, splits=tl.splits)
    return out.withColumn("g_lower_us", F.floor(F.col("g_lower_bound") / 1000)).drop("g_lower_bound")
