"""Interval operators: merging, gaps and how probes meet them."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import intervals as I
from ..operators.aggregates import gap_stats
from ..scale import plan_splits
from . import adapter as A
from .endpoints import traced
from .registry import PATH, query, timeline
from .sql import T, TB, TBG, TU, TX, gapped, merged, with_

BUSY_COLUMNS = "path, start_ns, end_ns, bytes_total, event_count, merged"
GAP_COLUMNS = "path, gap_idx, start_ns, end_ns, duration_ns"
WIDTH = 5_000_000_000_000
PROBE = 500_000_000_000

PROBES_SQL = f"""probes AS (SELECT path, gap_idx, start_ns + 1000 AS start_ns, start_ns + 1000 + {PROBE} AS end_ns
  FROM gaps)"""


def _probes(gaps):
    """A 500 s probe just after the start of every gap."""
    start = F.col("start_ns") + 1000
    return gaps.select("path", "gap_idx", start.alias("start_ns"), (start + PROBE).alias("end_ns"),
                       F.struct("path", "gap_idx").alias("probe_id"))


@query("merge_intervals", with_(f"{T}, {merged(tol=30 * 10**9)}", f"SELECT {BUSY_COLUMNS} FROM busy"))
def merge_intervals(spark, sf):
    return I.merge_intervals(A.transfers(spark, sf), PATH, tolerance=30 * 10**9)


@query("merge_intervals_many_paths", with_(f"{TU}, {merged()}", f"SELECT {BUSY_COLUMNS} FROM busy"))
def merge_intervals_many_paths(spark, sf):
    return I.merge_intervals(A.transfers(spark, sf, "user_id"), PATH, tolerance=A.TOLERANCE)


@query("merge_intervals_split", with_(TB, f"SELECT {BUSY_COLUMNS} FROM busy"))
def merge_intervals_split(spark, sf):
    """The plan for heavy paths, forced: about four segments."""
    t = A.transfers(spark, sf)
    n = t.count()
    return I.merge_intervals(t, PATH, tolerance=A.TOLERANCE,
                             splits=plan_splits(t, "start_ns", PATH, max(1, n // 20)))


@query("merge_probe_aware", with_(TB, f"SELECT {BUSY_COLUMNS} FROM busy"))
def merge_probe_aware(spark, sf):
    return I.merge_intervals_probe_aware(A.transfers(spark, sf), PATH, A.MIN_PROBE, A.MARGIN)


@query("merge_overlaps", with_(f"{TX}, {merged('tx', 'source, destination', 0)}", """
SELECT source, destination, start_ns, end_ns, start_ns AS window_wall_start_ns, end_ns AS window_wall_end_ns,
  bytes_total, event_count, round(bytes_total / 1048576.0, 6) AS bytes_mb,
  round(CASE WHEN end_ns > start_ns THEN bytes_total / (end_ns - start_ns) ELSE 0 END, 6) AS bandwidth_gbps,
  round((end_ns - start_ns) / 1e6, 6) AS duration_ms FROM busy"""))
def merge_overlaps(spark, sf):
    t = traced(spark, sf)
    out = I.merge_overlaps(t)
    return out.select("source", "destination", "start_ns", "end_ns", "window_wall_start_ns", "window_wall_end_ns",
                      "bytes_total", "event_count",
                      *[F.round(c, 6).alias(c) for c in ("bytes_mb", "bandwidth_gbps", "duration_ms")])


@query("merge_sessions", with_(TB, """SELECT path, start_ns // 1000 AS start_us, end_ns // 1000 AS end_us, bytes_total,
  event_count FROM busy"""))
def merge_sessions(spark, sf):
    t = A.transfers(spark, sf).withColumn("us", F.expr("(end_ns - start_ns) div 1000"))
    return I.merge_sessions(t, PATH, "ts", "us", A.TOLERANCE // 1000) \
        .select("path", "start_us", "end_us", "bytes_total", "event_count")


@query("extract_gaps", with_(TBG, f"SELECT {GAP_COLUMNS} FROM gaps"))
def extract_gaps(spark, sf):
    return timeline(spark, sf).gaps


@query("gaps_many_paths", with_(f"{TU}, {merged()}, {gapped()}", f"SELECT {GAP_COLUMNS} FROM gaps"))
def gaps_many_paths(spark, sf):
    return timeline(spark, sf, "user_id").gaps


@query("timeline_counts", with_(TBG, """SELECT b.path, num_busy, coalesce(num_gaps, 0) AS num_gaps
FROM (SELECT path, count(*) AS num_busy FROM busy GROUP BY path) b
LEFT JOIN (SELECT path, count(*) AS num_gaps FROM gaps GROUP BY path) g USING (path)"""))
def timeline_counts(spark, sf):
    tl = timeline(spark, sf)
    return I.timeline_counts(tl.busy, tl.gaps, PATH)


IDLE_WINDOWS_SQL = with_(TBG, """, d AS (SELECT unnest([50000000000, 500000000000, 5100000000000]) AS probe_duration_ns),
r AS (SELECT path, duration_ns, row_number() OVER (PARTITION BY path ORDER BY duration_ns) - 1 AS r,
  count(*) OVER (PARTITION BY path) AS n FROM gaps),
s AS (SELECT path, count(*) AS "count", min(duration_ns) AS min_ns, max(duration_ns) AS max_ns,
  max(CASE WHEN r = n // 2 THEN duration_ns END) AS p50_ns,
  max(CASE WHEN r = CAST(floor(n * CAST(0.9 AS DOUBLE)) AS BIGINT) THEN duration_ns END) AS p90_ns,
  CAST(sum(duration_ns) AS BIGINT) AS total_ns FROM r GROUP BY path)
SELECT path, "count", min_ns, max_ns, p50_ns, p90_ns, total_ns, probe_duration_ns, safe_count,
  round(safe_count / "count", 6) AS safe_ratio
FROM s JOIN (SELECT path, probe_duration_ns, count(*) FILTER (duration_ns >= probe_duration_ns + 100000000000)
  AS safe_count FROM gaps, d GROUP BY ALL) USING (path)""")


@query("idle_windows", IDLE_WINDOWS_SQL)
def idle_windows(spark, sf):
    """Per path: how many idle windows, how long, and what share can hold each probe class."""
    tl = timeline(spark, sf)
    sizes = {f"_{k}": A.DURATIONS[k] + A.MARGIN for k in (1, 2, 3)}
    stats = gap_stats(tl.gaps, PATH, at_least=sizes, splits=tl.splits)
    classes = F.array(*[F.struct(F.lit(A.DURATIONS[k]).alias("probe_duration_ns"), F.col(f"_{k}").alias("safe_count"))
                        for k in (1, 2, 3)])
    return (stats.withColumn("c", F.explode(classes)).select("*", "c.*").drop("c", *sizes)
            .withColumn("safe_ratio", F.round(F.col("safe_count") / F.col("count"), 6)))


@query("first_overlap", with_(f"{TBG}, {PROBES_SQL}", """, h AS (SELECT p.path, p.gap_idx, p.start_ns,
  min(b.start_ns) AS first_start FROM probes p JOIN busy b ON b.path = p.path AND p.start_ns < b.end_ns
  AND p.end_ns > b.start_ns GROUP BY ALL)
SELECT p.path, p.gap_idx, first_start IS NOT NULL AS overlap,
  coalesce(greatest(0, first_start - p.start_ns), 0) AS idle_before_ns FROM probes p LEFT JOIN h USING (path, gap_idx)"""))
def first_overlap(spark, sf):
    tl = timeline(spark, sf)
    return I.first_overlap(_probes(tl.gaps), tl.busy, PATH, tl.splits) \
        .select("path", "gap_idx", "overlap", "idle_before_ns")


def _overlap_sql(on: str) -> str:
    return with_(f"{TBG}, {PROBES_SQL}", f"""SELECT p.path, p.gap_idx,
  CAST(coalesce(sum(CASE WHEN b.path IS NOT NULL THEN least(p.end_ns, b.end_ns) - greatest(p.start_ns, b.start_ns)
  END), 0) AS BIGINT)
  AS busy_overlap_ns FROM probes p LEFT JOIN busy b ON {on} p.start_ns < b.end_ns AND p.end_ns > b.start_ns GROUP BY ALL""")


@query("overlap_amount", _overlap_sql("b.path = p.path AND"))
def overlap_amount(spark, sf):
    tl = timeline(spark, sf)
    return I.overlap_amount(_probes(tl.gaps), tl.busy, PATH, splits=tl.splits) \
        .select("path", "gap_idx", "busy_overlap_ns")


@query("overlap_amount_all_paths", _overlap_sql(""))
def overlap_amount_all_paths(spark, sf):
    tl = timeline(spark, sf)
    return I.overlap_amount(_probes(tl.gaps), tl.busy, PATH, scope="all",
                            splits=plan_splits(tl.transfers, "start_ns")).select("path", "gap_idx", "busy_overlap_ns")


DENSEST_SQL = f"""last AS (SELECT path, max(end_ns) AS last_ns, count(*) AS n FROM gaps GROUP BY path),
w AS (SELECT path, start_ns, start_ns + {WIDTH} AS end_ns FROM gaps JOIN last USING (path)
  WHERE (gap_idx % 100 = 0 OR n <= 100) AND start_ns + {WIDTH} <= last_ns),
f AS (SELECT w.path, w.start_ns, w.end_ns, CAST(coalesce(sum(CASE WHEN b.path IS NOT NULL THEN least(w.end_ns, b.end_ns)
  - greatest(w.start_ns, b.start_ns) END), 0) AS BIGINT) AS busy_ns FROM w LEFT JOIN busy b ON b.path = w.path
  AND b.start_ns < w.end_ns AND b.end_ns > w.start_ns GROUP BY ALL),
densest AS (SELECT path, start_ns, end_ns, busy_ns, round(busy_ns / {float(WIDTH)} * 100, 6) AS busy_pct FROM f
  QUALIFY row_number() OVER (PARTITION BY path ORDER BY busy_ns DESC, start_ns) = 1)"""


@query("densest_window", with_(f"{TBG}, {DENSEST_SQL}", "SELECT * FROM densest"))
def densest_window(spark, sf):
    tl = timeline(spark, sf)
    out = I.densest_window(tl.gaps, tl.busy, PATH, WIDTH, 100, tl.splits)
    return out.withColumn("busy_pct", F.round("busy_pct", 6))


@query("clip_to_window", with_(TBG, """SELECT 'gaps' AS kind, path, start_ns, end_ns FROM gaps
WHERE start_ns >= epoch_us(TIMESTAMP '2024-01-10 00:00:00') * 1000
  AND start_ns < epoch_us(TIMESTAMP '2024-01-12 00:00:00') * 1000
UNION ALL SELECT 'busy', path, start_ns, end_ns FROM busy
WHERE end_ns > epoch_us(TIMESTAMP '2024-01-10 00:00:00') * 1000
  AND start_ns < epoch_us(TIMESTAMP '2024-01-12 00:00:00') * 1000"""))
def clip_to_window(spark, sf):
    tl = timeline(spark, sf)
    a, b = 1_704_844_800_000_000_000, 1_705_017_600_000_000_000      # 2024-01-10 and 2024-01-12
    names = ["path", "start_ns", "end_ns"]
    return (I.clip_to_window(tl.gaps, a, b).select(F.lit("gaps").alias("kind"), *names)
            .unionByName(I.clip_to_window(tl.busy, a, b, "busy").select(F.lit("busy").alias("kind"), *names)))


@query("grid_collisions", with_(f"{TBG}, {DENSEST_SQL}", f"""
, g AS (SELECT path, start_ns + i * 100000000000 AS s FROM densest, range(0, ({WIDTH} - 50000000000) // 100000000000) r(i)),
h AS (SELECT g.path, g.s, bool_or(b.path IS NOT NULL) AS hit FROM g LEFT JOIN busy b ON b.path = g.path
  AND g.s < b.end_ns AND g.s + 50000000000 > b.start_ns GROUP BY ALL)
SELECT path, count(*) AS probes, count(*) FILTER (hit) AS unsafe,
  round(count(*) FILTER (hit) * 100.0 / count(*), 6) AS unsafe_pct FROM h GROUP BY path"""))
def grid_collisions(spark, sf):
    tl = timeline(spark, sf)
    windows = I.densest_window(tl.gaps, tl.busy, PATH, WIDTH, 100, tl.splits)
    return I.grid_collisions(windows, tl.busy, PATH, 100_000_000_000, 50_000_000_000, WIDTH, tl.splits) \
        .withColumn("unsafe_pct", F.round("unsafe_pct", 6))


@query("idle_age", with_(TB, """SELECT t.path, t.event_id,
  coalesce(greatest(0, t.start_ns + 60000000000 - max(b.end_ns)), 0) AS idle_age_ns
FROM t LEFT JOIN busy b ON b.path = t.path AND b.start_ns <= t.start_ns + 60000000000 GROUP BY t.path, t.event_id, t.start_ns"""))
def idle_age(spark, sf):
    tl = timeline(spark, sf)
    points = tl.transfers.select("path", "event_id", (F.col("start_ns") + 60_000_000_000).alias("now_ns"))
    return I.idle_age(points, tl.busy, PATH, splits=tl.splits).select("path", "event_id", "idle_age_ns")


@query("timeline_full_key", with_(f"{TX}, {merged('tx', 'src_dev, dst_dev, direction, src_numa, dst_numa')}", """
SELECT src_dev, dst_dev, direction, src_numa, dst_numa, start_ns, end_ns, bytes_total, event_count FROM busy"""))
def timeline_full_key(spark, sf):
    busy, _ = I.build_timeline(traced(spark, sf), min_probe=A.MIN_PROBE, margin=A.MARGIN)
    return busy.drop("merged")


@query("interval_metrics", with_(TB, """SELECT path, start_ns, greatest(0, end_ns - start_ns) AS duration_ns,
  round(CASE WHEN end_ns > start_ns THEN bytes_total / (end_ns - start_ns) ELSE 0 END, 9) AS bandwidth_gbps,
  round(bytes_total / 1048576.0, 6) AS size_mb FROM busy"""))
def interval_metrics(spark, sf):
    return C.with_interval_metrics(timeline(spark, sf).busy).select(
        "path", "start_ns", "duration_ns", F.round("bandwidth_gbps", 9).alias("bandwidth_gbps"),
        F.round("size_mb", 6).alias("size_mb"))
