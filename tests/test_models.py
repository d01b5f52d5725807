"""Metrics, calibration, policies, model fits and severity."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan import constants as K
from idlespan.operators import aggregates as G
from idlespan.operators import calibration as B
from idlespan.operators import labels as L
from idlespan.operators import models as M
from idlespan.operators import policies as P
from idlespan.operators import severity as V
from idlespan.operators.ranking import best_policies

GAPS = "path string, gap_idx long, start_ns long, end_ns long, duration_ns long"


def gaps_of(frame, lengths, path="a", step=500):
    rows, at = [], 1000
    for i, x in enumerate(lengths):
        rows.append((path, i, at, at + x, x))
        at += x + step
    return frame(rows, GAPS)


def predictions(frame, pairs, h=500):
    return frame([(h, p, y) for p, y in pairs], "horizon_ns long, p double, label int")


def test_classification_metrics(frame):
    pred = predictions(frame, [(.9, 1), (.8, 0), (.5, 1), (.2, 1), (.1, 0), (.0, 0)])
    r = G.classification_metrics(pred).first()
    assert (r.tp, r.fp, r.fn, r.tn, r.n) == (2, 1, 1, 2, 6)
    assert (r.precision, r.recall, r.false_safe_rate) == pytest.approx((2 / 3, 2 / 3, 1 / 3))
    none = G.classification_metrics(predictions(frame, [(.1, 0)])).first()
    assert (none.precision, none.recall) == (0.0, 0.0)
    assert G.classification_metrics(predictions(frame, [(.1, 0)]), empty=None).first().precision is None


def test_calibration(frame):
    pred = predictions(frame, [(.9, 1)] * 100 + [(.1, 0)] * 100 + [(.35, 1)] * 4 + [(1.0, 1)])
    table = B.fit_calibration(pred)
    rows = {r.bin: r for r in table.collect()}
    assert len(rows) == 10 and rows[9]["count"] == 100 and rows[9].accuracy == 1.0 and rows[1].accuracy == 0.0
    assert sum(r["count"] for r in rows.values()) == 204          # p = 1 has no bin here
    raw = predictions(frame, [(.95, 1), (.12, 0), (.36, 1), (1.0, 1), (1.5, 1), (-.2, 0)])
    got = dict(rows_of(B.apply_calibration(raw, table), "p", "p_calibrated"))
    assert got == {.95: 1.0, .12: 0.0, .36: .36, 1.0: 1.0, 1.5: 1.0, -.2: 0.0}
    assert B.table_calibration_error(table).first().ece < 0.2


def test_reliability_bins_are_right_closed(frame):
    curve = {r.bin: r for r in B.reliability_curve(predictions(frame, [(0.0, 0), (.5, 1), (1.0, 1), (.55, 0)])).collect()}
    assert (curve[4]["count"], curve[5]["count"], curve[9]["count"]) == (1, 1, 1)
    assert sum(r.proportion for r in curve.values()) == pytest.approx(0.75)
    assert curve[0].confidence == pytest.approx(0.05)
    ece = B.expected_calibration_error(B.reliability_curve(predictions(frame, [(.9, 1)] * 9 + [(.9, 0)]))).first().ece
    assert ece == pytest.approx(0.0)


def test_merged_calibration_equals_fit_of_both(frame):
    a, b = predictions(frame, [(.31, 1), (.35, 0), (.8, 1)]), predictions(frame, [(.33, 1), (.1, 0)])
    both = rows_of(B.fit_calibration(a.unionByName(b)), "bin", "count", "accuracy")
    merged = rows_of(B.merge_calibration(B.fit_calibration(a), B.fit_calibration(b)), "bin", "count", "accuracy")
    assert [(x[0], x[1], pytest.approx(x[2])) for x in both] == merged


def test_slices_and_cohorts(frame):
    rows = [(500, i, "a", .9 if i % 3 else .1, i % 2, 100 + i) for i in range(23)]
    pred = frame(rows, "horizon_ns long, start_ns long, path string, p double, label int, duration_ns long")
    sizes = dict(rows_of(G.time_slice_metrics(pred, 10), "block", "n"))
    edges = [23 * i // 10 for i in range(11)]
    assert sizes == {i + 1: b - a for i, (a, b) in enumerate(zip(edges, edges[1:]))}
    el = G.early_late_metrics(pred).first()
    early = [r for r in rows[:18] if r[3] >= .5]
    assert el.precision_early == pytest.approx(sum(r[4] for r in early) / len(early))
    late = F.col("start_ns") >= 18
    assert G.shift_verdict(pred, late).first().verdict == "longer"
    assert [r.delta_pp for r in G.safe_fraction(pred, [100], late).collect()] == [0.0]
    assert G.path_safe_shift(pred, 110, late, ["path"]).first().n_late == 5


def test_eta_sweep_and_oracle(frame):
    pred = frame([(.99, 1, 6_000_000), (.93, 0, 100_000), (.2, 1, 600_000)], "p double, label int, duration_ns long")
    rows = {r.eta_bw: r for r in G.eta_sweep(pred, [.5, .95]).collect()}
    assert (rows[.95].bw_probes, rows[.95].precision, rows[.95].unsafe_count) == (1, 1.0, 1)
    assert rows[.5].unsafe_count == 1 and rows[.5].precision == .5 and rows[.95].eta_normal == .9
    o = G.oracle_gap(pred, 500_000, .95).first()
    assert (o.oracle_probes, o.predicted_probes, o.oracle_gap) == (2, 1, 0.0)


def kinds(df):
    return dict(rows_of(df, "duration_ns", "probe_type"))


def test_simple_policies(frame):
    gaps = gaps_of(frame, [10_000, 100_000, 600_000, 10_000_000])
    assert P.apply_policy("none", gaps).count() == 0
    assert kinds(P.apply_policy("threshold", gaps)) == {600_000: 2, 10_000_000: 3}
    assert kinds(P.apply_policy("oracle", gaps)) == {100_000: 1, 600_000: 2, 10_000_000: 3}
    assert P.apply_policy("random", gaps, key=["path"], probability=0.0).count() == 0
    every = P.apply_policy("random", gaps, key=["path"], probability=1.0)
    assert every.count() == 4 and every.filter("probe_type not in (1, 2, 3)").count() == 0
    assert P.apply_policy("fixed_interval", gaps, key=["path"], period=10**9).count() == 1
    with pytest.raises(ValueError):
        P.make_policy("nonexistent")
    assert all(callable(P.make_policy(n)) for n in P.POLICIES)


def test_ewma_policy_warm_up_and_history(frame):
    gaps = gaps_of(frame, [1_000_000] * 11 + [10_000])
    causal = kinds_by_index(P.apply_policy("ewma", gaps, key=["path"]))
    assert causal == {10: 2, 11: 2}                       # the short gap is not known beforehand
    shown = kinds_by_index(P.apply_policy("ewma", gaps, key=["path"], causal=False))
    assert min(shown) == 9 and shown[11] == 2             # 0.9 of the mean still leaves room for a normal probe


def kinds_by_index(df):
    return dict(rows_of(df, "gap_idx", "probe_type"))


def test_predictive_policy(frame):
    gaps = gaps_of(frame, [100_000, 600_000, 6_000_000]).withColumn("p", F.lit(.96))
    assert kinds(P.apply_policy("predictive", gaps, key=["path"])) == {100_000: 3, 600_000: 3, 6_000_000: 3}
    shown = P.apply_policy("predictive", gaps, key=["path"], causal=False)
    assert kinds(shown) == {100_000: 1, 600_000: 2, 6_000_000: 3}
    assert P.apply_policy("predictive", gaps.drop("p"), key=["path"]).count() == 0      # EWMA, still warming up


def test_user_policy(frame):
    P.register_policy("always_tiny", lambda gaps: gaps.withColumn("probe_type", F.lit(1)))
    assert P.apply_policy("always_tiny", gaps_of(frame, [1, 2])).count() == 2
    del P.POLICIES["always_tiny"]


def test_outcomes_and_summaries(frame):
    gaps = gaps_of(frame, [50_500, 600_000, 6_000_000])
    busy = frame([("a", 0, 1000)] + [("a", r.end_ns, r.end_ns + 500) for r in gaps.collect()],
                 "path string, start_ns long, end_ns long")
    runs = P.apply_policies(gaps, {"oracle": {}, "threshold": {"low": 0, "high": 500_000}})
    fitted = {(r.policy, r.duration_ns): r for r in P.downgrade_to_fit(runs).collect()}
    assert fitted["threshold", 600_000].downgraded and fitted["threshold", 600_000].probe_type == 2
    assert ("threshold", 50_500) not in fitted                     # a normal probe does not fit and is dropped
    out = P.outcomes(P.downgrade_to_fit(runs), busy, ["path"])
    r = {x.policy: x for x in G.run_summary(out).collect()}
    assert (r["oracle"].executed, r["oracle"].unsafe_probes, r["oracle"].downgraded) == (3, 1, 0)
    assert (r["threshold"].executed, r["threshold"].safe_probes, r["threshold"].downgraded) == (2, 2, 1)
    assert r["oracle"].probe_overlap_ratio == pytest.approx(500 / 5_650_000)
    assert P.one_per_path_at_a_time(out, ["path"]).count() == 5
    wide = {x.policy: x for x in G.compare_policies(out, F.lit(10**8)).collect()}
    assert wide["threshold"].safe_pct == 100.0 and wide["oracle"].harmful == 1
    m = {x.policy: x for x in G.policy_metrics(P.fit_outcomes(runs), 10**8, key=["path"]).collect()}
    assert (m["threshold"].unsafe_probes, m["threshold"].bw_probes, m["oracle"].unsafe_probes) == (2, 2, 0)
    assert best_policies(G.policy_metrics(P.fit_outcomes(runs), 10**8, key=["path"]), 0).first().safest == "threshold"
    cover = {x.policy: x for x in G.gap_coverage(out, F.lit(100)).collect()}
    assert (cover["threshold"].total_gaps, cover["threshold"].gaps_safe_probed) == (100, 2)
    assert G.run_summary(out.limit(0)).count() == 0


def test_rates(frame):
    df = frame([(1000, 10_000, 100), (0, 1000, 0), (5, 0, 5)], "total_probing_ns long, total_time_ns long, executed long")
    assert [r.overhead_pct for r in G.probe_overhead(df).collect()] == [10.0, 0.0, 0.0]
    one = frame([(100, 10**9)], "executed long, total_time_ns long")
    assert G.probe_rate(one).first().probes_per_s == 100.0


def test_limit_per_window(frame):
    gaps = gaps_of(frame, [100_000] * 30).withColumn("probe_type", F.lit(1)).withColumn("policy", F.lit("x"))
    out = P.limit_per_window(gaps, 3, 1_000_000)
    per = out.groupBy(F.floor(F.col("start_ns") / 1_000_000).alias("w")).count()
    assert rows_of(per, "w", "count") == [(0, 3), (1, 3), (2, 3)]
    assert rows_of(out, "gap_idx")[:3] == [(0,), (1,), (2,)]


def learnable(frame, n=400, seed=1):
    """Gaps whose length is decided by the previous one, so that a tree can learn it."""
    rnd = random.Random(seed)
    lengths = [300 if (i // 2) % 2 else 900 for i in range(n)]
    lengths = [x + rnd.randrange(40) for x in lengths]
    gaps = gaps_of(frame, lengths)
    busy = frame([("a", 0, 1000)] + [("a", r.end_ns, r.end_ns + 500) for r in gaps.collect()],
                 "path string, start_ns long, end_ns long")
    return L.training_set(gaps, busy, ["path"], [600], causal=True)


def test_models_learn_save_and_load(spark, frame, tmp_path):
    rows = learnable(frame).cache()
    train, test = rows.filter("gap_idx < 250"), rows.filter("gap_idx >= 250")
    small = {"maxIter": 8, "maxDepth": 3}
    fitted = M.fit_survival(train, [100, 600, 5000], params=small)
    assert fitted.constants == {100: 1.0, 5000: 0.0} and list(fitted.models) == [600]
    assert "f_cpu_usage_pct" not in fitted.features
    scored = M.labelled_scores(test, fitted, [100, 600, 700, 5000]).cache()
    m = {r.horizon_ns: r for r in G.classification_metrics(scored).collect()}
    assert m[600].precision > 0.85 and m[600].recall > 0.75 and m[100].brier == 0.0
    same = {r.horizon_ns: r.s for r in scored.groupBy("horizon_ns").agg(F.sum("p").alias("s")).collect()}
    assert same[600] == same[700]                                  # nearest trained horizon
    M.save_models(spark, fitted, str(tmp_path / "m"))
    again = M.labelled_scores(test, M.load_models(spark, str(tmp_path / "m")), [100, 600, 700, 5000])
    assert rows_of(again, "gap_idx", "horizon_ns", "p") == rows_of(scored, "gap_idx", "horizon_ns", "p")


def test_model_evaluations(frame):
    rows = learnable(frame).cache()
    train, test = rows.filter("gap_idx < 250"), rows.filter("gap_idx >= 250")
    small = {"maxIter": 4, "maxDepth": 3}
    cv = M.time_series_cv(rows, [600], 2, params=small).collect()
    assert [r.fold for r in cv] == [0, 1] and cv[1].precision > 0.9
    folds = M.with_stratified_fold(rows.withColumn("y", (F.col("duration_ns") >= 600).cast("int")), "y", ["gap_idx"], 5)
    sizes = [r["count"] for r in folds.groupBy("y", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 2
    logistic = M.cross_pass_eval(train, test, [600], fit=M.fit_logistic).first()
    assert logistic.precision > 0.8
    curve = {r.size: r for r in M.learning_curve(train, test, [3, 0.9], [600], params=small).collect()}
    assert curve[0.9].precision >= curve[3.0].precision
    ablated = {r.feature_group: r for r in M.ablate_groups(train, test, [600], ["gap", "time"], params=small).collect()}
    assert ablated["gap"].delta_precision < -0.1 and ablated["time"].delta_precision == 0.0
    assert M.evaluate_windows(train, test, [600], params=small).first().precision > 0.9


def test_time_series_cv_of_too_few_rows(frame):
    """A table of no rows or one has no fold, and its metrics have the columns that they have otherwise."""
    names = "start_ns long, duration_ns long, " + ", ".join(f"{c} double" for c in K.FEATURE_NAMES)
    some = [(i, 900 * (i % 2), *[float(i)] * len(K.FEATURE_NAMES)) for i in range(12)]
    full = M.time_series_cv(frame(some, names), [600], 2, params={"maxIter": 1, "maxDepth": 1})
    for rows in ([], some[:1]):
        cv = M.time_series_cv(frame(rows, names), [600], 2)
        assert cv.dtypes == full.dtypes and cv.count() == 0
        assert G.mean_over_folds(cv).count() == 0


def test_baselines(frame):
    train, test = gaps_of(frame, [100, 200, 900]), gaps_of(frame, [500, 50])
    p = dict(rows_of(L.base_rate_baseline(train, test, [150]), "gap_idx", "p"))
    assert p[0] == pytest.approx(2 / 3)
    assert {r.p for r in L.mean_threshold_baseline(train, test, [300]).collect()} == {1.0}
    assert {r.p for r in L.trailing_baseline(train, test, [150], ["start_ns"]).collect()} == {0.0}     # short history
    assert {r.p for r in L.trailing_baseline(train, test, [150], ["start_ns"], 2, 2).collect()} == {1.0}


def test_safe_windows_fallback(frame):
    out = B.safe_windows(gaps_of(frame, [1000] * 120), [500, 2000], ["path"]).collect()
    by = {r.horizon_ns: r for r in out}
    assert (by[500].p_safe, by[500].allowed_probe_type, by[500].reason_code, by[500].history) == (1.0, 3, 0, 100)
    assert (by[2000].allowed_probe_type, by[2000].reason_code, by[2000].g_lower_bound) == (0, 1, 1000)


def test_severity_and_triggers(frame):
    links = frame([(5.0, 10.0, 9.0, .1, .1, False), (5.0, 10.0, 0.0, .1, .1, False), (20.0, 10.0, 0.0, .1, .1, True),
                   (20.0, 10.0, 0.0, .1, .1, False)], "bandwidth_gbps double, latency_us double, abnormal_s double, "
                  "abnormal_ratio double, link_ratio double, throughput_drop boolean")
    assert [r.severity for r in V.severity(links, 10, 50, 5, .5, .5).collect()] == ["P0", "P1", "P2", "none"]
    busy = frame([("a", 0, 10, .5), ("a", 100, 200, 9.75), ("a", 300, 400, 26.5)], "path string, start_ns long, end_ns long, bandwidth_gbps double")
    assert rows_of(V.trigger_windows(busy), "start_ns") == [(100,)]
    probes = frame([("a", 150, 9.63), ("a", 250, 1.0)], "path string, start_ns long, probe_gbps double")
    hit = V.match_probe_window(probes, busy, ["path"]).collect()
    assert [(r.window_start_ns, round(r.merged_gbps, 2), round(r.throughput_ratio, 3)) for r in hit] == [(100, 19.38, .775)]
    assert V.cooldown(busy, 250).count() == 2


@pytest.mark.parametrize("name", ["model_cross_pass", "model_score", "model_save_load", "model_time_series_cv", "model_stratified_kfold",
                                  "model_learning_curve", "model_ablation", "model_single_groups", "model_evaluate_windows",
                                  "model_safe_windows", "model_policy", "stream_model_decisions"])
def test_registered_queries_fit_whole_models(spark, monkeypatch, name):
    """Every fit that a query asks for has the operator's own trees; none is carried out here."""
    import __spark_entry__ as entry
    asked = []

    def noted(train, horizons, features, estimator, parallelism):
        trees = estimator(horizons[0], 1000)
        asked.append((trees.getMaxIter(), trees.getMaxDepth(), trees.getStepSize(), trees.getSubsamplingRate()))
        return M.HorizonModels(list(features), {}, dict.fromkeys(horizons, 0.5))
    monkeypatch.setattr(M, "_fit_each", noted)
    entry.queries()[name](spark, "/root/testdata/sf0.001")
    assert asked and set(asked) == {(100, 4, 0.1, 0.8)}
