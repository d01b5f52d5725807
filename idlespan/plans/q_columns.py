"""Projections, filters and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions import columns as C
from ..operators import ranking as R
from ..operators.windows import feature_rows
from . import adapter as A
from .endpoints import traced
from .registry import PATH, query, timeline
from .sql import T, TBG, TX, with_


@query("parse_endpoint", with_(TX, "SELECT event_id, src_dev, src_numa, dst_dev, dst_numa FROM tx"))
def parse_endpoint(spark, sf):
    return traced(spark, sf).select("event_id", "src_dev", "src_numa", "dst_dev", "dst_numa")


@query("infer_direction", with_(TX, """SELECT source, destination, CASE WHEN source LIKE 'NPU%' AND destination LIKE
'Host%' THEN 2 WHEN source LIKE 'NPU%' AND destination LIKE 'NPU%' THEN 3 WHEN source LIKE 'Host%' AND destination
LIKE 'Host%' THEN 0 ELSE 1 END AS code, count(*) AS n FROM tx GROUP BY ALL"""))
def infer_direction(spark, sf):
    code = C.infer_direction("source", "destination").alias("code")
    return traced(spark, sf).groupBy("source", "destination", code).agg(F.count(F.lit(1)).alias("n"))


@query("direction_labels", with_(T, """SELECT event_id, CASE WHEN k % 6 IN (0, 1, 2, 3) THEN k % 6 ELSE 1 END AS from_kind,
CASE direction WHEN 0 THEN 'H2H' WHEN 1 THEN 'H2D' WHEN 2 THEN 'D2H' ELSE 'D2D' END AS label, CASE upper(trim(' ' ||
['h2h', 'H2D', 'd2H', 'D2D', 'x2y'][1 + k % 5] || ' ')) WHEN 'H2H' THEN 0 WHEN 'H2D' THEN 1 WHEN 'D2H' THEN 2 WHEN 'D2D'
THEN 3 END AS from_label FROM t"""))
def direction_labels(spark, sf):
    t = A.transfers(spark, sf)
    text = F.concat(F.lit(" "), F.get(F.array(*[F.lit(x) for x in ("h2h", "H2D", "d2H", "D2D", "x2y")]),
                                      (F.col("k") % 5).cast("int")), F.lit(" "))
    return t.select("event_id", C.direction_from_kind(F.col("k") % 6).alias("from_kind"),
                    C.direction_label("direction").alias("label"), C.direction_from_label(text).alias("from_label"))


@query("transfer_metrics", with_(TX, """SELECT event_id, (end_ns - start_ns) / 1000.0 AS latency_us, size / 1048576.0 AS
size_mb, round(CASE WHEN end_ns > start_ns THEN size / (end_ns - start_ns) ELSE 0 END, 9) AS bw_gbps, k % 2 = 1 AS
is_async, false AS is_synthetic FROM tx"""))
def transfer_metrics(spark, sf):
    return C.with_transfer_metrics(traced(spark, sf)).select(
        "event_id", "latency_us", "size_mb", F.round("bw_gbps", 9).alias("bw_gbps"), "is_async", "is_synthetic")


@query("validate", with_(TX, """SELECT event_id, concat_ws('; ', CASE WHEN end_ns < start_ns + 5000000000 THEN
'end before start' END, CASE WHEN size - 10485760 <= 0 THEN 'size <= 0' END, CASE WHEN direction + k % 3 > 3 THEN
'invalid direction: ' || (direction + k % 3) END, CASE WHEN src_dev >= 4294967280 AND src_dev <> 4294967295 THEN
'invalid src_dev: ' || src_dev END, CASE WHEN dst_dev >= 4294967280 AND dst_dev <> 4294967295 THEN 'invalid dst_dev: '
|| dst_dev END) AS errors FROM tx"""))
def validate(spark, sf):
    broken = traced(spark, sf).withColumns({
        "start_ns": F.col("start_ns") + 5_000_000_000, "size": F.col("size") - 10_485_760,
        "direction": F.col("direction") + (F.col("k") % 3).cast("int")})
    return C.validate(broken).select("event_id", F.concat_ws("; ", "errors").alias("errors"))


@query("quality_flags", with_(TX, """SELECT event_id, flags | CASE WHEN k % 7 = 0 THEN 128 ELSE 0 END AS flags,
flags & 2 <> 0 AS unknown_device, k % 7 = 0 AS synthetic FROM tx"""))
def quality_flags(spark, sf):
    f = C.set_flag("quality_flags", K.FLAG_SYNTHETIC, F.col("k") % 7 == 0)
    t = traced(spark, sf).withColumn("flags", f)
    return t.select("event_id", "flags", C.has_flag("flags", K.FLAG_UNKNOWN_DEVICE).alias("unknown_device"),
                    C.has_flag("flags", K.FLAG_SYNTHETIC).alias("synthetic"))


@query("path_key_groups", with_(TX, """SELECT src_dev, dst_dev, direction, src_numa, dst_numa, count(*) AS events
FROM tx GROUP BY ALL"""))
def path_key_groups(spark, sf):
    return (C.with_path_key(traced(spark, sf)).groupBy("path_key").agg(F.count(F.lit(1)).alias("events"))
            .select("path_key.*", "events"))


@query("path_id")
def path_id(spark, sf):
    t = C.with_path_id(traced(spark, sf))
    return t.groupBy(*K.PATH_KEY, "path_id").agg(F.count(F.lit(1)).alias("events"))


@query("min_size", with_(T, "SELECT event_id, size FROM t WHERE size >= 52428800"))
def min_size(spark, sf):
    return C.min_size(A.transfers(spark, sf), 50 * K.MIB).select("event_id", "size")


@query("drop_injected", with_(T, """SELECT event_id FROM t WHERE size / 1048576.0 < 90 AND user_id NOT IN (3, 5)
AND user_id < 120"""))
def drop_injected(spark, sf):
    t = C.with_transfer_metrics(traced(spark, sf))
    return C.drop_large_and_pids(t, 90, (3, 5), 120).select("event_id")


@query("real_vs_synthetic", with_(T, """SELECT count(*) AS total, count(*) FILTER (k % 7 <> 0) AS real,
count(*) FILTER (k % 7 = 0) AS synthetic FROM t"""))
def real_vs_synthetic(spark, sf):
    flags = C.set_flag("quality_flags", K.FLAG_SYNTHETIC, F.col("k") % 7 == 0)
    return C.real_vs_synthetic(traced(spark, sf).withColumn("quality_flags", flags))


@query("fits", with_(TBG, "SELECT path, gap_idx, duration_ns >= 500000000000 + 100000000000 AS fits FROM gaps"))
def fits(spark, sf):
    return timeline(spark, sf).gaps.select("path", "gap_idx",
                                           C.fits("duration_ns", A.DURATIONS[2], A.MARGIN).alias("fits"))


@query("probe_duration", with_(T, """SELECT event_id, CASE WHEN k % 2 = 1 THEN CAST(trunc(base * CASE WHEN direction = 2
THEN CAST(1.24 AS DOUBLE) ELSE CAST(2.31 AS DOUBLE) END) AS BIGINT) ELSE base END AS probe_ns FROM (SELECT *, [50000,
50000, 500000, 5100000, 250000][1 + k % 5] AS base FROM t)"""))
def probe_duration(spark, sf):
    t = A.transfers(spark, sf)
    return t.select("event_id", C.probe_duration(F.col("k") % 5, F.col("k") % 2 == 1, F.col("direction"))
                    .alias("probe_ns"))


@query("time_slice", with_(T, """SELECT CASE WHEN start_ns < 1704844800000000000 THEN 'before' WHEN start_ns <=
1705017600000000000 THEN 'inside' ELSE 'after' END AS part, count(*) AS n FROM t GROUP BY ALL"""))
def time_slice(spark, sf):
    t, a, b = A.transfers(spark, sf), 1_704_844_800_000_000_000, 1_705_017_600_000_000_000
    parts = {"before": C.time_slice(t, end=a - 1), "inside": C.time_slice(t, a, b), "after": C.time_slice(t, b + 1)}
    return R.union_passes(*[df.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit(name))
                            for name, df in parts.items()])


@query("min_gaps_per_path", with_(TBG.replace("event_type AS path", "CAST(user_id AS VARCHAR) AS path"), """SELECT path,
gap_idx, duration_ns FROM gaps QUALIFY count(*) OVER (PARTITION BY path) >= 66"""))
def min_gaps_per_path(spark, sf):
    tl = timeline(spark, sf, "user_id")
    return R.min_rows_per_key(tl.gaps, 66, PATH, splits=tl.splits).select("path", "gap_idx", "duration_ns")


@query("every_nth", with_(TBG, "SELECT path, gap_idx, duration_ns FROM gaps WHERE gap_idx >= 50 AND gap_idx % 10 = 0"))
def every_nth(spark, sf):
    return R.every_nth(timeline(spark, sf).gaps, 10, start=50).select("path", "gap_idx", "duration_ns")


@query("feature_subset", with_(TBG, """SELECT path, gap_idx, CAST(0 AS DOUBLE) AS f_idle_age_ns, CAST(50 AS DOUBLE) AS
f_cpu_usage_pct, CAST(50 AS DOUBLE) AS f_npu_util_pct, round(count(*) OVER (PARTITION BY path) / greatest(0.001,
(max(end_ns) OVER (PARTITION BY path) - min(start_ns) OVER (PARTITION BY path)) / 1e9), 9) AS f_ebpf_event_rate FROM gaps
QUALIFY gap_idx >= 50"""))
def feature_subset(spark, sf):
    tl = timeline(spark, sf)
    rows = feature_rows(tl.gaps, tl.busy, PATH, splits=tl.splits)
    out = rows.select("path", "gap_idx", *C.feature_subset("idle", "resource"))
    return out.withColumn("f_ebpf_event_rate", F.round("f_ebpf_event_rate", 9))


@query("data_confidence", with_(T, """SELECT event_id, round(greatest(0.0, 1 - (least(0.3, k / 1000.0 * 3) + least(0.2,
k % 13 / 50.0 * 2) + least(0.5, k % 7 / 10.0))), 9) AS c_data, round(greatest(0.1, least(1.0, 1 - k / 80.0)), 9) AS
c_drift, round(least(k / 100.0, k % 10 / 10.0, 0.9), 9) AS c_final, CASE WHEN k / 100.0 >= 0.98 THEN 3 WHEN k / 100.0 >=
0.95 THEN 2 WHEN k / 100.0 >= 0.90 THEN 1 ELSE 0 END AS allowed FROM t"""))
def data_confidence(spark, sf):
    k = F.col("k")
    return A.transfers(spark, sf).select(
        "event_id", F.round(C.data_confidence(k / 1000.0, k % 13 / 50.0, k % 7 / 10.0), 9).alias("c_data"),
        F.round(C.drift_confidence(k / 80.0), 9).alias("c_drift"),
        F.round(C.compose_confidence(k / 100.0, k % 10 / 10.0, F.lit(0.9), F.lit(0.95)), 9).alias("c_final"),
        C.allowed_probe(k / 100.0).alias("allowed"))
