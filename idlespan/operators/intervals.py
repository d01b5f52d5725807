"""Busy intervals, the gaps between them, and how probes meet them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import gbps, with_gap_duration
from ..scale import AUTO, SEG, TARGET_ROWS, attach, carried, numbered, resolve, running, with_segment
from ..session import cut

KEY = tuple(K.PATH_KEY)
CROWD = 2


def merge_intervals(df: DataFrame, key: Sequence[str] = KEY, t0: str = "start_ns", t1: str = "end_ns",
                    tolerance: int = 0, size: str = "size", splits=AUTO,
                    extra: Sequence[Column] = ()) -> DataFrame:
    """Union of the intervals of a key whose distance is at most ``tolerance`` (inclusive).

    One exchange on ``key``: both windows and the final aggregate share it.  With splits, bounded segments
    are merged side by side and joined at their edges; copies of a start that crowd a segment are combined first.
    ``extra`` are aggregates of input columns to add; with splits they are computed in two steps and so
    must be named min, max or sum aggregates of the same column (see ``merge_overlaps``).
    """
    key = list(key)
    splits = resolve(splits, df, t0, key)
    extra_names = [n for n, _, _ in extra]
    valid = df.filter(F.col(t1) >= F.col(t0)).select(
        *key, F.col(t0).alias("_t0"), F.col(t1).alias("_t1"), F.col(size).alias("_bytes"),
        F.lit(1).cast("long").alias("_events"), *[F.col(c).alias(n) for n, _, c in extra])
    combine = {"min": F.min, "max": F.max, "sum": F.sum}
    further = [combine[how](n).alias(n) for n, how, _ in extra]
    if splits is not None:
        runs = _merge_in_segments(valid, key, tolerance, splits, [F.sum("_bytes").alias("_bytes"), F.sum("_events").alias("_events"), *further])
    else:
        reach = running(valid, key, ["_t0"], {"_reach": ("max", F.col("_t1"))}, inclusive=False)
        opens = F.col("_reach").isNull() | (F.col("_t0") > F.col("_reach") + F.lit(tolerance))
        runs = running(reach.withColumn("_open", F.when(opens, F.col("_t0"))), key, ["_t0"], {"_run": ("max", F.col("_open"))})
    return (runs.groupBy(*key, "_run").agg(
        F.max("_t1").alias("end_ns"), F.sum("_bytes").alias("bytes_total"),
        F.sum("_events").alias("event_count"), *further)
        .select(*key, F.col("_run").alias("start_ns"), "end_ns", "bytes_total", "event_count",
                (F.col("event_count") > 1).alias("merged"), *extra_names))


def _merge_in_segments(rows: DataFrame, key: list[str], tolerance: int, splits, sums: Sequence[Column]) -> DataFrame:
    """Rows (``_run``, ``_t1`` and sums) that add up to the merged intervals, from one cut of the lineage.

    One pass over each segment knows the furthest end before it, and merges what it can: at most one row of a segment, the one that has not
    seen an interval open, goes on with the last interval opened before it.
    """
    base = cut(with_segment(rows, "_t0", splits))
    tops = cut(base.groupBy(*key, SEG).agg(F.max("_t1").alias("end"), F.count(F.lit(1)).alias("n")))
    if not tops.filter(F.col("n") > CROWD * TARGET_ROWS).isEmpty():
        # Cut points cannot part rows of one start: its copies are combined before anything is ordered.
        base = cut(base.groupBy(*key, SEG, "_t0").agg(F.max("_t1").alias("_t1"), *sums))
    ends = carried(tops, key, {"end": "max"})
    order = Window.partitionBy(*key, SEG).orderBy("_t0")
    reach = F.greatest(F.max("_t1").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry_end"))
    met = base.join(ends, [*key, SEG]).withColumn("_reach", reach)
    opens = F.col("_reach").isNull() | (F.col("_t0") > F.col("_reach") + F.lit(tolerance))
    met = met.withColumn("_run", F.max(F.when(opens, F.col("_t0"))).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    part = met.groupBy(*key, SEG, "_run").agg(F.max("_t1").alias("_t1"), *sums)
    last = carried(part.groupBy(*key, SEG).agg(F.max("_run").alias("run")), key, {"run": "max"})
    return part.join(last, [*key, SEG]).withColumn("_run", F.coalesce("_run", "_carry_run"))


def merge_intervals_probe_aware(df: DataFrame, key: Sequence[str] = KEY, min_probe: int = K.MIN_PROBE_NS,
                                margin: int = K.SAFETY_MARGIN_NS, **kw) -> DataFrame:
    """Merge over every gap that is too short for the smallest probe plus its margin."""
    return merge_intervals(df, key, tolerance=min_probe + margin, **kw)


def merge_overlaps(df: DataFrame, key: Sequence[str] = ("source", "destination"), wall0: str = "wall_start_ns",
                   wall1: str = "wall_end_ns", **kw) -> DataFrame:
    """Windows of touching copies per endpoint pair, with wall time, throughput and length."""
    merged = merge_intervals(df, key, tolerance=0, extra=[
        ("window_wall_start_ns", "min", wall0), ("window_wall_end_ns", "max", wall1)], **kw)
    length = F.col("end_ns") - F.col("start_ns")
    return merged.withColumns({"bytes_mb": F.col("bytes_total") / float(K.MIB),
                               "bandwidth_gbps": gbps(F.col("bytes_total"), length),
                               "duration_ms": length / 1e6}).drop("merged")


def merge_sessions(df: DataFrame, key: Sequence[str], ts: str, duration_us: str, tolerance_us: int,
                   size: str = "size", splits=AUTO) -> DataFrame:
    """Merging at microsecond resolution: ``key``, ``start_us``, ``end_us``, ``bytes_total``, ``event_count``, on batches and streams.

    Events of negative length are left out.  A batch is merged by ``merge_intervals`` at every size.  A stream takes the built-in session
    window, where an event keeps the session open for its own length plus the tolerance and sessions join when they touch at
    a microsecond, the inclusive edge of ``merge_intervals``.  A session cannot be empty, so on a stream an event of
    length 0 at tolerance 0 also joins one that starts a microsecond after it.
    """
    length = F.col(duration_us)
    df = df.filter(length >= 0)
    started, ended = F.unix_micros(ts), F.unix_micros(ts) + length
    if not df.isStreaming:
        timed = df.withColumns({"_us0": started, "_us1": ended})
        merged = merge_intervals(timed, key, "_us0", "_us1", tolerance_us, size, resolve(splits, timed, "_us0", key))
        return merged.select(*key, F.col("start_ns").alias("start_us"), F.col("end_ns").alias("end_us"),
                             "bytes_total", "event_count")
    hold = F.concat(F.greatest(length + tolerance_us, F.lit(1)).cast("string"), F.lit(" microseconds"))
    return (df.groupBy(*key, F.session_window(ts, hold).alias("session"))
            .agg(F.min(started).alias("start_us"), F.max(ended).alias("end_us"),
                 F.sum(size).alias("bytes_total"), F.count(F.lit(1)).alias("event_count")).drop("session"))


def extract_gaps(busy: DataFrame, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Idle time between consecutive busy intervals of a key, longer than zero, numbered from 0.

    The busy intervals must be merged, so that the previous end is the latest end so far.
    """
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    spans = busy.select(*key, "start_ns", "end_ns")
    if splits is None:
        before = running(spans, key, ["start_ns"], {"_prev": ("max", F.col("end_ns"))}, inclusive=False)
        return with_gap_duration(numbered(_between(before, key), key, ["start_ns"], "gap_idx"))
    # One cut: ends are carried over segments first, then the number of gaps found with them.
    base = cut(with_segment(spans, "start_ns", splits))
    ends = carried(base.groupBy(*key, SEG).agg(F.max("end_ns").alias("end")), key, {"end": "max"})
    order = Window.partitionBy(*key, SEG).orderBy("start_ns")
    reach = F.greatest(F.max("end_ns").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.col("_carry_end"))
    gaps = _between(base.join(ends, [*key, SEG]).withColumn("_prev", reach), [*key, SEG])
    local = gaps.withColumn("_at", F.row_number().over(order))
    counts = carried(gaps.groupBy(*key, SEG).agg(F.count(F.lit(1)).alias("n")), key, {"n": "sum"})
    return with_gap_duration(local.join(counts, [*key, SEG]).select(
        *key, "start_ns", "end_ns", (F.col("_at") - 1 + F.coalesce("_carry_n", F.lit(0))).alias("gap_idx")))


def _between(rows: DataFrame, kept: Sequence[str]) -> DataFrame:
    """Idle time before every interval that starts after all before it have ended (``_prev``)."""
    return rows.filter(F.col("start_ns") > F.col("_prev")).select(
        *kept, F.col("_prev").alias("start_ns"), F.col("start_ns").alias("end_ns"))


def build_timeline(df: DataFrame, key: Sequence[str] = KEY, min_probe: int = K.MIN_PROBE_NS,
                   margin: int = K.SAFETY_MARGIN_NS, splits=AUTO) -> tuple[DataFrame, DataFrame]:
    """Busy intervals and gaps of every path."""
    splits = resolve(splits, df, "start_ns", key)
    busy = merge_intervals_probe_aware(df, key, min_probe, margin, splits=splits)
    return busy, extract_gaps(busy, key, splits)


def timeline_counts(busy: DataFrame, gaps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    both = busy.select(*key, F.lit(1).alias("b"), F.lit(0).alias("g")).unionByName(
        gaps.select(*key, F.lit(0).alias("b"), F.lit(1).alias("g")))
    return both.groupBy(*key).agg(F.sum("b").alias("num_busy"), F.sum("g").alias("num_gaps"))


# --- probes against busy intervals -----------------------------------------

def _moments(times: Sequence[tuple[str, int]]) -> Column:
    return F.explode(F.array(*[F.struct(F.col(t).cast("long").alias("t"), F.lit(sign).alias("sign"))
                               for t, sign in times]))


def _points(probes: DataFrame, busy: DataFrame, key: list[str], at: Sequence[tuple[str, int]],
            edges: Sequence[tuple[str, int]]) -> DataFrame:
    """One frame of busy edges and probe positions; a probe sorts after the edges of its time.

    Several edges or positions of a row come from one explode, so both inputs are computed once.
    """
    probe = F.struct(*[F.col(c) for c in probes.columns])
    payload = probes.select(probe.alias("p")).schema["p"].dataType
    marks = busy.select(*key, F.lit(0).alias("rank"), F.col("start_ns").alias("b0"), F.col("end_ns").alias("b1"),
                        F.lit(None).cast(payload).alias("probe"), _moments(edges).alias("m"))
    asks = probes.select(*key, F.lit(1).alias("rank"), F.lit(None).cast("long").alias("b0"),
                         F.lit(None).cast("long").alias("b1"), probe.alias("probe"), _moments(at).alias("m"))
    both = marks.unionByName(asks)
    return both.select(*key, "m.t", "rank", "b0", "b1", "probe",
                       F.when(F.col("rank") == 0, F.col("m.sign")).otherwise(0).alias("step"),
                       F.when(F.col("rank") == 1, F.col("m.sign")).alias("side"))


def look_up(probes: DataFrame, busy: DataFrame, key: list[str], at: Sequence[tuple[str, int]],
            edges: Sequence[tuple[str, int]], splits, compute: Callable[[DataFrame], DataFrame],
            values: Sequence[str]) -> DataFrame:
    """Rows (probe, side, t, values): what the running aggregates of ``compute`` know at each probe position.

    While paths are small the probes travel through the ordered frame.  With splits only distinct positions
    do, and the probes are joined to them afterwards, so copies of one position are never ordered.
    """
    if splits is None:
        answered = compute(_points(probes, busy, key, at, edges)).filter(F.col("probe").isNotNull())
        return answered.select(*key, "t", "side", "probe", *values)
    asks = probes.select(*key, F.struct(*probes.columns).alias("probe"), _moments(at).alias("m")) \
        .select(*key, "m.t", F.col("m.sign").alias("side"), "probe")
    spots = asks.select(*key, "t").distinct()
    known = compute(_points(spots, busy, key, [("t", 0)], edges)).filter(F.col("probe").isNotNull())
    return asks.join(known.select(*key, "t", *values), [*key, "t"], "left")


def first_overlap(probes: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Whether a probe hits a busy interval of its path, and the idle time before the first one it hits.

    The first hit is either the interval already open at the probe start or the next one to start, so two
    as-of lookups on one ordering answer it, whatever the interval lengths are.
    """
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)

    def neighbours(frame: DataFrame) -> DataFrame:
        frame = running(frame, key, ["t", "rank"], {"_prev_end": ("max", F.col("b1"))}, splits=splits)
        return running(frame, key, ["t", "rank"], {"_next": ("last", F.col("b0"))}, reverse=True, splits=splits)
    found = look_up(probes, busy, key, [("start_ns", 0)], [("start_ns", 0)], splits, neighbours, ["_prev_end", "_next"])
    inside = F.col("_prev_end") > F.col("t")
    reached = F.col("_next") < F.col("probe.end_ns")
    return found.select(
        "probe.*",
        (F.coalesce(inside, F.lit(False)) | F.coalesce(reached, F.lit(False))).alias("overlap"),
        F.when(inside, F.lit(0).cast("long")).when(reached, F.col("_next") - F.col("t"))
        .otherwise(F.lit(0).cast("long")).alias("idle_before_ns"))


def overlap_amount(probes: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, probe_id: str = "probe_id",
                   scope: str = "path", splits=AUTO, out: str = "busy_overlap_ns") -> DataFrame:
    """Busy time that each probe ``[start_ns, end_ns)`` covers, on its path or over all paths.

    Busy time before t is a running sum over interval edges: open count * t + (closed ends - starts).
    A probe is the difference of two such values, so no pair of probe and interval is ever formed and a
    long interval costs no more than a short one.  ``probe_id`` must be unique.
    """
    key = [] if scope == "all" else list(key)
    splits = resolve(splits, busy, "start_ns", key)
    exact = F.col("t").cast("decimal(20,0)")

    def busy_before(frame: DataFrame) -> DataFrame:
        frame = running(frame, key, ["t", "rank"], {
            "_open": ("sum", F.col("step").cast("long")),
            "_offset": ("sum", F.when(F.col("step") == 1, -exact).when(F.col("step") == -1, exact)
                        .otherwise(F.lit(0).cast("decimal(20,0)")))}, splits=splits)
        return frame.withColumn("_before", F.col("_open") * exact + F.col("_offset"))
    asked = look_up(probes, busy, key, [("start_ns", -1), ("end_ns", 1)], [("start_ns", 1), ("end_ns", -1)], splits,
                    busy_before, ["_before"])
    return (asked.groupBy(F.col(f"probe.{probe_id}").alias("_id"))
            .agg(F.first("probe").alias("probe"), F.sum(F.col("side") * F.col("_before")).alias("_sum"))
            .select("probe.*", F.col("_sum").cast("long").alias(out)))


def densest_window(gaps: DataFrame, busy: DataFrame, key: Sequence[str], width: int, stride: int = 100,
                   splits=AUTO) -> DataFrame:
    """Per key, the window of ``width`` with most busy time among those that start at every n-th gap."""
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    last = gaps.groupBy(*key).agg(F.max("end_ns").alias("_last"), F.count(F.lit(1)).alias("_n"))
    every = (F.col("gap_idx") % stride == 0) | (F.col("_n") <= stride)
    windows = (attach(gaps, last, key, splits, how="inner").filter(every & (F.col("start_ns") + width <= F.col("_last")))
               .select(*key, "start_ns", (F.col("start_ns") + width).alias("end_ns"),
                       F.struct(*key, "start_ns").alias("probe_id")))
    filled = overlap_amount(windows, busy, key, "probe_id", splits=splits, out="busy_ns")
    best = F.max_by(F.struct("start_ns", "end_ns", "busy_ns"), F.struct("busy_ns", -F.col("start_ns")))
    return (filled.groupBy(*key).agg(best.alias("w"))
            .select(*key, "w.*", (F.col("w.busy_ns") / F.lit(float(width)) * 100).alias("busy_pct")))


def clip_to_window(df: DataFrame, start: int, end: int, kind: str = "gaps") -> DataFrame:
    """Gaps that start in the window, or busy intervals that touch it."""
    if kind == "gaps":
        return df.filter((F.col("start_ns") >= start) & (F.col("start_ns") < end))
    return df.filter((F.col("end_ns") > start) & (F.col("start_ns") < end))


def probe_grid(windows: DataFrame, key: Sequence[str], period: int, duration: int, width: int) -> DataFrame:
    """Evenly spaced probes inside each window; the count is fixed by the arguments, not by the data."""
    count = max(0, (width - duration) // period)
    return (windows.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(count - 1))) if count
                               else F.explode(F.array().cast("array<int>")))
            .select(*key, F.col("_i").alias("probe_no"), (F.col("start_ns") + F.col("_i") * period).alias("s"))
            .select(*key, "probe_no", F.col("s").alias("start_ns"), (F.col("s") + duration).alias("end_ns")))


def grid_collisions(windows: DataFrame, busy: DataFrame, key: Sequence[str], period: int, duration: int,
                    width: int, splits=AUTO) -> DataFrame:
    """Share of a regular probe grid that touches busy time, per key."""
    hits = first_overlap(probe_grid(windows, key, period, duration, width), busy, key, splits)
    unsafe = F.count_if(F.col("overlap"))
    return hits.groupBy(*key).agg(F.count(F.lit(1)).alias("probes"), unsafe.alias("unsafe"),
                                  (unsafe * 100.0 / F.count(F.lit(1))).alias("unsafe_pct"))


def idle_age(points: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, at: str = "now_ns",
             splits=AUTO) -> DataFrame:
    """Time since the last busy interval ended, at arbitrary moments; 0 inside an interval or before any."""
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    known = look_up(points, busy, key, [(at, 0)], [("start_ns", 0)], splits, lambda frame: running(
        frame, key, ["t", "rank"], {"_end": ("max", F.col("b1"))}, splits=splits), ["_end"])
    age = F.greatest(F.lit(0).cast("long"), F.col("t") - F.col("_end"))
    return known.select("probe.*", F.when(F.col("_end").isNotNull(), age).otherwise(F.lit(0).cast("long"))
                        .alias("idle_age_ns"))
