"""Trailing windows, rank picks and drift, plain and chunked, against numpy."""

import random

import numpy as np
import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan import constants as K
from idlespan.operators import intervals as I
from idlespan.operators import windows as W
from idlespan.operators.aggregates import gap_cdf, quantile_profile, sample_summary
from idlespan.operators.calibration import recent_gaps
from idlespan.operators.labels import (horizon_label_columns, horizon_labels, last_gap_training_set, lower_bound_flat,
                                       training_set)
from idlespan.operators.ranking import first_fraction, min_rows_per_key
from idlespan.scale import Splits, linear, nearest, order_statistics

GAPS = "path string, gap_idx long, start_ns long, end_ns long, duration_ns long"
FORCED = Splits((200_000.0, 900_000.0))


def gaps_of(frame, lengths, path="a"):
    rows, at = [], 1000
    for i, x in enumerate(lengths):
        rows.append((path, i, at, at + x, x))
        at += x + 500
    return frame(rows, GAPS)


@pytest.fixture(scope="module")
def lengths():
    rnd = random.Random(7)
    return [rnd.randrange(100, 20_000) for _ in range(330)]


@pytest.mark.parametrize("splits", [None, FORCED])
def test_gap_features_against_numpy(frame, lengths, splits, small_chunks):
    rows = {r.gap_idx: r for r in W.gap_features(gaps_of(frame, lengths), ["path"], splits=splits).collect()}
    assert len(rows) == len(lengths) - 1
    for i in (1, 2, 5, 49, 50, 51, 64, 127, 200, 329):
        past = np.array(lengths[max(0, i - 50):i], dtype=float)
        r = rows[i]
        assert np.allclose([r.f_gap_p10, r.f_gap_p50, r.f_gap_p90], np.percentile(past, [10, 50, 90]))
        assert np.allclose([r.f_gap_mean, r.f_gap_std, r.f_gap_last, r.f_gap_last5_mean],
                           [past.mean(), past.std(), past[-1], past[-5:].mean()])


def test_ewma_is_exact(frame, lengths):
    got = dict(rows_of(W.ewma(gaps_of(frame, lengths), ["path"], 0.2), "gap_idx", "ewma"))
    e = None
    for i, x in enumerate(lengths):
        e = x if e is None else 0.2 * x + 0.8 * e
        assert got[i] == pytest.approx(e, rel=1e-12)


@pytest.mark.parametrize("splits", [None, FORCED])
def test_trailing_survival_and_bounds(frame, lengths, splits, small_chunks):
    gaps = gaps_of(frame, lengths)
    rows = {(r.gap_idx, r.horizon_ns): r for r in
            W.trailing_survival(gaps, [5000, 15_000], ["path"], splits=splits).collect()}
    low = dict(rows_of(W.lower_bound(gaps, key=["path"], splits=splits), "gap_idx", "g_lower_bound"))
    for i in (0, 9, 10, 19, 20, 150, 329):
        past = lengths[max(0, i - 100):i]
        for h in (5000, 15_000):
            assert rows[i, h].p == pytest.approx(np.mean([x >= h for x in past]) if len(past) >= 10 else 0.0)
        assert low[i] == pytest.approx(np.percentile(past, 5) if len(past) >= 20 else 0.0)
        assert rows[i, 5000].p >= rows[i, 15_000].p


def test_quantile_survival_halves_short_gaps(frame):
    gaps = gaps_of(frame, [10_000, 20_000, 15_000, 12_000, 18_000, 1])
    out = W.quantile_survival(gaps, [11_000], ["path"], min_samples=5).filter("gap_idx = 5").first()
    assert out.p == pytest.approx(0.8 * 0.5)


def test_flat_lower_bound(frame):
    gaps = gaps_of(frame, [10_000 * i for i in range(1, 11)])
    assert lower_bound_flat(gaps, 0.1).first().g_lower_bound == pytest.approx(19_000)
    assert lower_bound_flat(gaps.filter("gap_idx < 9"), 0.1).first().g_lower_bound == 0.0


@pytest.mark.parametrize("splits", [None, FORCED])
def test_rolling_drift_and_phase(frame, lengths, splits, small_chunks):
    gaps = gaps_of(frame, lengths)
    roll = {r.gap_idx: r for r in W.rolling_stats(gaps, ["path"], splits=splits).collect()}
    i = 250
    assert roll[i].roll_mean == pytest.approx(np.mean(lengths[i - 99:i + 1]))
    assert roll[i].roll_std == pytest.approx(np.std(lengths[i - 99:i + 1], ddof=1))
    mu = np.mean(lengths[i - 100:i])
    assert roll[i].relative_change == pytest.approx(abs(lengths[i] - mu) / mu)
    score = dict(rows_of(W.drift_score(gaps, ["duration_ns"], ["path"], splits=splits), "gap_idx", "drift_score"))
    past = np.array(lengths[50:250], dtype=float)
    assert score[49] == 0.0
    assert score[250] == pytest.approx(min(abs(lengths[250] - past.mean()) / past.std() / 3, 1.0))
    shifted = gaps_of(frame, [50_000] * 100 + [150_000] * 60)
    flags = dict(rows_of(W.phase_shift(shifted, ["path"], splits=splits), "gap_idx", "phase_shift"))
    assert flags[159] is True and flags[99] is False and flags[40] is False


def test_drift_of_constant_history(frame):
    rows = [("a", i, i, i + 1, 0 if i < 60 else 10) for i in range(62)]
    out = dict(rows_of(W.drift_score(frame(rows, GAPS), ["duration_ns"], ["path"]), "gap_idx", "drift_score"))
    assert out[59] == 0.0 and out[60] == 1.0


def test_order_statistics_with_hot_value(frame):
    rnd = random.Random(3)
    rows = [("hot", 7)] * 500 + [("hot", rnd.randrange(1000)) for _ in range(500)] + [("b", 1), ("b", 2)]
    df = frame(rows, "k string, v long")
    picks = {"p25": linear(0.25), "p99": linear(0.99), "near": nearest(lambda n: F.floor(n * F.lit(0.9)))}
    for splits in (None, Splits((7.0, 300.0, 800.0))):
        got = {r.k: r for r in order_statistics(df, ["k"], "v", picks, splits).collect()}
        for k in ("hot", "b"):
            v = sorted(x for key, x in rows if key == k)
            assert got[k].n == len(v)
            assert np.allclose([got[k].p25, got[k].p99], np.percentile(v, [25, 99]))
            assert got[k].near == v[int(len(v) * 0.9)]


def test_profile_and_summary(frame):
    df = frame([(float(x),) for x in (1, 2, 3, 4)], "v double")
    p = quantile_profile(df, "v", (0.5,)).first()
    assert (p.n, p.mean, p.p50, p.min, p.max) == (4, 2.5, 2.5, 1.0, 4.0) and p.std == pytest.approx(np.std([1, 2, 3, 4]))
    s = sample_summary(df, "v").first()
    assert s.stdev == pytest.approx(np.std([1, 2, 3, 4], ddof=1)) and s.median == 2.5
    assert sample_summary(df.filter("v = 1"), "v").first().stdev == 0.0


def timeline(frame, n=80):
    rnd = random.Random(11)
    at, rows = 0, []
    for _ in range(n):
        length = 0 if rnd.random() < 0.1 else rnd.randrange(1, 400)
        rows.append(("a", at, at + length, 1))
        at += length + rnd.randrange(1000, 9000)
    return I.build_timeline(frame(rows, "path string, start_ns long, end_ns long, size long"), ["path"], 100, 100)


@pytest.mark.parametrize("splits", [None, FORCED])
def test_feature_rows(frame, splits, small_chunks):
    busy, gaps = timeline(frame)
    rows = {r.gap_idx: r for r in W.feature_rows(gaps, busy, ["path"], min_history=5, splits=splits).collect()}
    bursts = [e - s for s, e in rows_of(busy, "start_ns", "end_ns") if e > s]
    assert len(rows) == gaps.count() - 5
    for i in (5, 30, 60, 78):
        past = bursts[max(0, min(i, len(bursts)) - 50):min(i, len(bursts))]
        assert np.allclose([rows[i].f_burst_p50, rows[i].f_burst_p90, rows[i].f_burst_mean,
                            rows[i].f_burst_last_duration],
                           [*np.percentile(past, [50, 90]), np.mean(past), past[-1]])
        assert rows[i].f_burst_rate == 0.0 and rows[i].f_cpu_usage_pct == 50.0
    assert len(K.FEATURE_NAMES) == 30 == len(set(K.FEATURE_NAMES))


def test_labels(frame):
    gaps = gaps_of(frame, [10_000, 60_000, 200_000, 1_500_000])
    long = horizon_labels(gaps, [50_000, 500_000])
    assert rows_of(long, "horizon_ns", "gap_idx", "label") == [
        (50_000, 0, 0), (50_000, 1, 1), (50_000, 2, 1), (50_000, 3, 1),
        (500_000, 0, 0), (500_000, 1, 0), (500_000, 2, 0), (500_000, 3, 1)]
    assert rows_of(horizon_label_columns(gaps, [50_000]), "gap_idx", "y_50000") == [(0, 0), (1, 1), (2, 1), (3, 1)]


def test_training_sets(frame):
    busy, gaps = timeline(frame)
    full = training_set(gaps, busy, ["path"], [2000])
    assert full.agg(F.min("gap_idx")).first()[0] == 5
    last = last_gap_training_set(gaps, busy, ["path"], [2000]).collect()
    assert [r.gap_idx for r in last] == [gaps.count() - 1]


def test_consecutive_alarm(frame):
    readings = frame([(float(t), low) for t, low in enumerate([1, 1, 0, 1, 0, 1, 1, 1])], "t double, low int") \
        .withColumn("is_degraded", F.col("low") == 1)
    out = W.consecutive_alarm(readings, 2, 2.0).first()
    assert (out.detected_at, out.detection_latency) == (6.0, 4.0)
    assert W.consecutive_alarm(readings, 4, 2.0).first().detected_at is None


@pytest.mark.parametrize("splits", [None, FORCED])
def test_per_key_joins_and_slices(frame, lengths, splits):
    """Salted attachment and global numbering give what the plain plan gives."""
    gaps = gaps_of(frame, lengths).unionByName(gaps_of(frame, [500] * 7, "b"))
    assert rows_of(min_rows_per_key(gaps, 10, ["path"], splits=splits).select("path").distinct(), "path") == [("a",)]
    recent = recent_gaps(gaps, 3, ["path"], splits)
    assert rows_of(recent, "path", "gap_idx") == [("a", i) for i in (327, 328, 329)] + [("b", i) for i in (4, 5, 6)]
    assert first_fraction(gaps, 0.5, ["start_ns", "path"], splits).count() == 337 // 2
    cdf = gap_cdf(gaps, ["path"], splits).filter("path = 'b'").first()
    assert cdf.cdf == 1.0


def test_history_snapshot(frame):
    busy, gaps = timeline(frame, 12)
    rows = {r.gap_idx: r for r in W.history_snapshot(gaps, busy, ["path"], 3, 4).collect()}
    ordered = [d for _, d in rows_of(gaps, "gap_idx", "duration_ns")]
    assert rows[0].previous_gaps == [] and len(rows[0].previous_busy) == 1
    assert rows[6].previous_gaps == ordered[3:6] and len(rows[6].previous_busy) == 4


def test_minimum_spacing(frame):
    from idlespan.operators.chains import with_spacing
    rnd = random.Random(9)
    rows = [(rnd.choice("abc"), rnd.randrange(0, 5000)) for _ in range(400)]
    got = with_spacing(frame(rows, "path string, start_ns long"), 100, ["path"]).filter("chosen")
    want = []
    for path in "abc":
        last = None
        for at in sorted(t for p, t in rows if p == path):
            if last is None or at >= last + 100:
                want.append((path, at))
                last = at
    assert rows_of(got, "path", "start_ns") == sorted(want)
