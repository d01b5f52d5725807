"""Merging, gaps and overlap on literal intervals and against brute force."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan.operators import intervals as I
from idlespan.operators.aggregates import gap_stats, safe_availability
from idlespan.scale import Splits, plan_splits

EVENTS = "path string, start_ns long, end_ns long, size long"
SPANS = "path string, start_ns long, end_ns long"


def events(frame, spans):
    return frame([("a", s, e, 10) for s, e in spans], EVENTS)


CASES = {
    "one": ([(1000, 2000)], 500, [(1000, 2000, 1)]),
    "overlap": ([(1000, 3000), (2000, 4000)], 500, [(1000, 4000, 2)]),
    "small gap": ([(1000, 2000), (2100, 3000)], 500, [(1000, 3000, 2)]),
    "large gap": ([(1000, 2000), (3000, 4000)], 500, [(1000, 2000, 1), (3000, 4000, 1)]),
    "distance equals tolerance": ([(1000, 2000), (2500, 3000)], 500, [(1000, 3000, 2)]),
    "one past tolerance": ([(1000, 2000), (2501, 3000)], 500, [(1000, 2000, 1), (2501, 3000, 1)]),
    "nested": ([(0, 10_000), (1000, 2000), (10_400, 10_500)], 500, [(0, 10_500, 3)]),
    "reversed": ([(3000, 1000)], 500, []),
    "empty": ([], 500, []),
    "equal starts": ([(1000, 1500), (1000, 4000), (1000, 1000)], 0, [(1000, 4000, 3)]),
    "copies": ([(1000, 1500)] * 7, 0, [(1000, 1500, 7)]),
}


@pytest.mark.parametrize("name", CASES)
@pytest.mark.parametrize("splits", [None, Splits((1500.0, 2600.0))])
def test_merge_cases(frame, name, splits):
    spans, tolerance, expected = CASES[name]
    busy = I.merge_intervals(events(frame, spans), ["path"], tolerance=tolerance, splits=splits)
    assert rows_of(busy, "start_ns", "end_ns", "event_count") == expected
    assert all(r.merged == (r.event_count > 1) and r.bytes_total == 10 * r.event_count for r in busy.collect())


def test_probe_aware_tolerance(frame):
    near = events(frame, [(1_000_000, 2_000_000), (2_100_000, 3_000_000)])
    far = events(frame, [(1_000_000, 2_000_000), (2_200_000, 3_000_000)])
    assert I.merge_intervals_probe_aware(near, ["path"], 100_000, 50_000).count() == 1
    assert I.merge_intervals_probe_aware(far, ["path"], 100_000, 50_000).count() == 2


def test_timeline(frame):
    busy, gaps = I.build_timeline(events(frame, [(6500, 7000), (1000, 2000), (5000, 6000)]), ["path"], 1000, 500)
    assert rows_of(busy, "start_ns", "end_ns") == [(1000, 2000), (5000, 7000)]
    assert rows_of(gaps, "gap_idx", "start_ns", "end_ns", "duration_ns") == [(0, 2000, 5000, 3000)]
    assert rows_of(I.timeline_counts(busy, gaps, ["path"]), "num_busy", "num_gaps") == [(2, 1)]


def test_single_interval_has_no_gap(frame):
    busy, gaps = I.build_timeline(events(frame, [(1000, 2000)]), ["path"], 100, 0)
    assert gaps.count() == 0
    assert rows_of(I.timeline_counts(busy, gaps, ["path"]), "num_busy", "num_gaps") == [(1, 0)]


@pytest.mark.parametrize("splits", [None, Splits((2500.0, 5000.0))])
@pytest.mark.parametrize("probe, expected", [
    ((2000, 2500), (True, 0)), ((5500, 6000), (False, 0)), ((500, 1500), (True, 500)), ((3000, 4000), (False, 0)),
    ((2900, 6500), (True, 0)), ((3100, 8500), (True, 3900)), ((100, 900), (False, 0))])
def test_first_overlap(frame, probe, expected, splits):
    busy = frame([("a", 1000, 3000), ("a", 7000, 8000), ("b", 3000, 6000)], SPANS)
    probes = frame([("a", *probe)], SPANS)
    assert rows_of(I.first_overlap(probes, busy, ["path"], splits), "overlap", "idle_before_ns") == [expected]


def brute_merge(spans, tolerance):
    out = []
    for s, e in sorted((s, e) for s, e in spans if e >= s):
        if out and s <= out[-1][1] + tolerance:
            out[-1][1] = max(out[-1][1], e)
            out[-1][2] += 1
        else:
            out.append([s, e, 1])
    return [tuple(r) for r in out]


def skewed(seed, n=600):
    """One path holds most rows, one start holds many copies, one interval spans several segments."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        path = "hot" if rnd.random() < 0.7 else f"p{rnd.randrange(4)}"
        s = 5_000 if rnd.random() < 0.15 else rnd.randrange(50_000)
        rows.append((path, s, s + rnd.randrange(0, 60), 1))
    rows.append(("hot", 20_000, 31_000, 1))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_split_plan_equals_brute_force(frame, seed):
    rows = skewed(seed)
    df = frame(rows, EVENTS)
    splits = plan_splits(df, "start_ns", ["path"], target_rows=60)
    assert splits and len(splits.points) >= 4
    busy, gaps = I.build_timeline(df, ["path"], 20, 5, splits)
    got = {}
    for r in sorted(rows_of(busy, "path", "start_ns", "end_ns", "event_count")):
        got.setdefault(r[0], []).append(tuple(r[1:]))
    for path in {r[0] for r in rows}:
        want = brute_merge([(s, e) for p, s, e, _ in rows if p == path], 25)
        assert got[path] == want
        mine = rows_of(gaps.filter(F.col("path") == path), "gap_idx", "start_ns", "end_ns")
        assert mine == [(i, a[1], b[0]) for i, (a, b) in enumerate(zip(want, want[1:]))]


@pytest.mark.parametrize("scope", ["path", "all"])
def test_overlap_amount_equals_brute_force(frame, scope):
    rows = skewed(3, 300)
    df = frame(rows, EVENTS)
    busy = I.merge_intervals(df, ["path"], tolerance=0)
    intervals = rows_of(busy, "path", "start_ns", "end_ns")
    rnd = random.Random(4)
    probes = [(rnd.choice(["hot", "p1", "none"]), s, s + rnd.randrange(0, 9000), i)
              for i in range(60) for s in [rnd.randrange(52_000)]]
    pdf = frame(probes, SPANS + ", probe_id int")
    for splits in (None, Splits((5_000.0, 20_500.0, 40_000.0))):
        got = dict(rows_of(I.overlap_amount(pdf, busy, ["path"], scope=scope, splits=splits),
                           "probe_id", "busy_overlap_ns"))
        for path, s, e, i in probes:
            want = sum(max(0, min(e, b1) - max(s, b0)) for p, b0, b1 in intervals if scope == "all" or p == path)
            assert got[i] == want


@pytest.mark.parametrize("splits", [None, Splits((5_000.0, 20_500.0))])
def test_sessions_equal_merging(frame, splits):
    df = frame(skewed(8), EVENTS).withColumns({"ts": F.timestamp_micros("start_ns"),
                                               "us": F.col("end_ns") - F.col("start_ns")})
    sessions = I.merge_sessions(df, ["path"], "ts", "us", 25, splits=splits)
    merged = I.merge_intervals(df, ["path"], tolerance=25)
    assert rows_of(sessions, "path", "start_us", "end_us", "event_count") == \
        rows_of(merged, "path", "start_ns", "end_ns", "event_count")


@pytest.mark.parametrize("splits", [None, Splits((2500.0, 5000.0))])
def test_idle_age(frame, splits):
    busy = frame([("a", 1000, 3000), ("a", 7000, 8000)], SPANS)
    points = frame([("a", t) for t in (500, 2000, 3000, 5000, 5000, 9000)], "path string, now_ns long")
    assert rows_of(I.idle_age(points, busy, ["path"], splits=splits), "now_ns", "idle_age_ns") == [
        (500, 0), (2000, 0), (3000, 0), (5000, 2000), (5000, 2000), (9000, 1000)]


def test_grid_and_densest_window(frame):
    busy = frame([("a", i * 100, i * 100 + (60 if 20 <= i < 30 else 10)) for i in range(60)], SPANS)
    gaps = I.extract_gaps(busy, ["path"])
    best = I.densest_window(gaps, busy, ["path"], 1000, 1).first()
    assert (best.start_ns, best.end_ns, best.busy_ns) == (1910, 2910, 9 * 60 + 10)      # earliest of two equal ones
    hits = I.grid_collisions(frame([("a", 2000, 3000)], SPANS), busy, ["path"], 100, 10, 1000).first()
    assert (hits.probes, hits.unsafe) == (9, 9)


def test_gap_stats_and_availability(frame):
    gaps = frame([("a", 1000), ("a", 3000), ("a", 1000)], "path string, duration_ns long")
    row = gap_stats(gaps, ["path"]).first()
    assert (row["count"], row.min_ns, row.max_ns, row.p50_ns, row.total_ns) == (3, 1000, 3000, 1000, 5000)
    two = frame([("a", 1000), ("a", 5000)], "path string, duration_ns long")
    assert rows_of(safe_availability(two, [500, 1500, 6000], 0), "probe_duration_ns", "safe_count", "total_count",
                   "safe_ratio") == [(500, 2, 2, 1.0), (1500, 1, 2, 0.5), (6000, 0, 2, 0.0)]
    empty = gap_stats(gaps.filter("duration_ns < 0"), []).first()
    assert (empty["count"], empty.p90_ns) == (0, 0)


def test_partition_independence(spark, frame):
    rows = skewed(5)
    results = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.append(rows_of(I.build_timeline(frame(rows, EVENTS), ["path"], 20, 5)[1], "path", "start_ns", "end_ns"))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert results[0] == results[1]


def test_invariants(frame):
    rows = skewed(6)
    busy, gaps = I.build_timeline(frame(rows, EVENTS), ["path"], 20, 5)
    assert busy.agg(F.sum("event_count")).first()[0] == len(rows)
    per_path = busy.groupBy("path").agg(
        (F.max("end_ns") - F.min("start_ns")).alias("span"), F.sum(F.col("end_ns") - F.col("start_ns")).alias("b"))
    idle = gaps.groupBy("path").agg(F.sum("duration_ns").alias("g"), F.min("duration_ns").alias("least"))
    for r in per_path.join(idle, "path", "left").collect():
        assert r.span == r.b + (r.g or 0)
        assert r.least is None or r.least > 25
