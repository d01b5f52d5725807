"""Sources and sinks.  The files read here are written from the events table first, so they grow with it."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import fixed_text, with_transfer_metrics
from ..operators import aggregates as G
from ..operators.labels import training_set
from ..sources import logs, tables, trace
from . import adapter as A
from .endpoints import traced, with_endpoints
from .registry import PATH, new_folder, query, timeline
from .sql import T, TB, TBG, TX, with_

TRANSFER_SQL = """src_dev, dst_dev, src_numa, dst_numa, start_ns, end_ns, size, direction"""
TRANSFER_COLUMNS = [c.strip() for c in TRANSFER_SQL.split(",")]


def legacy_rows(spark, sf):
    """Legacy layout under the tracer's own header spelling."""
    t = with_transfer_metrics(traced(spark, sf))
    return t.select(F.col("user_id").alias("PID"), F.col("event_id").alias("TID"), F.col("source").alias("Source"),
                    F.col("destination").alias("Destination"), fixed_text("size_mb").alias("Size_MB"),
                    fixed_text("latency_us").alias("Latency_us"),
                    fixed_text("bw_gbps").alias("Bandwidth_GBps"), F.col("start_ns").alias("Start_ns"),
                    F.col("end_ns").alias("End_ns"), F.col("wall_start_ns").alias("WallStart_ns"),
                    F.col("wall_end_ns").alias("WallEnd_ns"))


def extended_rows(spark, sf):
    """Transfers with every column of the extended layout."""
    return traced(spark, sf).withColumns({"tid": F.col("event_id"), "api_type": F.lit(0), "stream_id": F.lit(0),
                                          "path_id": F.lit(0), "link_bitmap": F.lit(0)})


@query("read_trace_legacy", with_(TX, f"SELECT user_id AS pid, event_id AS tid, {TRANSFER_SQL}, start_ns AS wall_start_ns, "
                                      "flags AS quality_flags FROM tx"))
def read_trace_legacy(spark, sf):
    path = new_folder(spark, "legacy")
    legacy_rows(spark, sf).write.option("header", True).csv(path)
    return trace.read_trace_legacy(spark, path).select("pid", "tid", *TRANSFER_COLUMNS, "wall_start_ns", "quality_flags")


@query("read_trace_extended", with_(TX, f"SELECT event_id AS tid, {TRANSFER_SQL}, CAST(k % 2 AS INTEGER) AS async_flag "
                                        "FROM tx"))
def read_trace_extended(spark, sf):
    path = new_folder(spark, "extended")
    trace.write_trace_csv(extended_rows(spark, sf), path)
    return trace.read_trace_extended(spark, path).select("tid", *TRANSFER_COLUMNS, "async_flag")


@query("read_trace_detect", with_(TX, """SELECT layout, count(*) AS events, CAST(sum(size) AS BIGINT) AS bytes FROM tx,
(SELECT unnest(['legacy', 'extended']) AS layout) GROUP BY layout"""))
def read_trace_detect(spark, sf):
    """The layout is found from the header of each folder."""
    a, b = new_folder(spark, "legacy"), new_folder(spark, "extended")
    legacy_rows(spark, sf).write.option("header", True).csv(a)
    trace.write_trace_csv(extended_rows(spark, sf), b)
    out = [trace.read_trace(spark, p).agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("bytes"))
           .withColumn("layout", F.lit(trace.detect_trace_format(trace.read_text_columns(spark, p).columns)))
           for p in (a, b)]
    return out[0].unionByName(out[1])


@query("split_rejects", with_(TX, """SELECT 'good' AS kind, count(*) AS n FROM tx WHERE k % 10 NOT IN (3, 4)
UNION ALL SELECT 'reject', count(*) FROM tx WHERE k % 10 = 3"""))
def split_rejects(spark, sf):
    """One row in ten gets a broken size, one is blank."""
    path = new_folder(spark, "dirty")
    rows = legacy_rows(spark, sf).withColumn("_k", F.col("Size_MB").cast("double").cast("int") - 1)
    blank = F.col("_k") % 10 == 4
    dirty = rows.withColumn("Size_MB", F.when(F.col("_k") % 10 == 3, "n/a").otherwise(F.col("Size_MB"))).select(
        *[F.when(blank, F.lit(" ")).otherwise(F.col(c).cast("string")).alias(c) for c in rows.columns if c != "_k"])
    dirty.write.option("header", True).csv(path)
    good, bad = trace.split_rejects(trace.read_text_columns(spark, path))
    count = F.count(F.lit(1)).alias("n")
    return good.agg(count).withColumn("kind", F.lit("good")).unionByName(
        bad.agg(count).withColumn("kind", F.lit("reject")))


@query("read_busy_csv", with_(TB, """SELECT start_ns AS window_start_ns, end_ns AS window_end_ns,
bytes_total / 1048576.0 AS bytes_mb, event_count AS packet_count FROM busy"""))
def read_busy_csv(spark, sf):
    path = new_folder(spark, "windows")
    tables.write_busy_csv(timeline(spark, sf).busy, path, PATH)
    return tables.read_busy_csv(spark, path).select("window_start_ns", "window_end_ns", "bytes_mb", "packet_count")


@query("read_busy_text_csv", with_(TX, """SELECT start_ns AS window_start_ns, source, destination, size / 1048576.0 AS
bytes_mb, start_ns AS wall_start_ns FROM tx"""))
def read_busy_text_csv(spark, sf):
    path = new_folder(spark, "windows")
    t = with_transfer_metrics(traced(spark, sf))
    t.select(F.col("start_ns").alias("WindowStart_ns"), F.col("end_ns").alias("WindowEnd_ns"),
             F.col("source").alias("Source"), F.col("destination").alias("Destination"),
             fixed_text("size_mb").alias("Bytes_MB"), fixed_text("bw_gbps").alias("Bandwidth_GBps"),
             F.col("start_ns").alias("WindowStartWall_ns"), F.col("end_ns").alias("WindowEndWall_ns"),
             F.lit("0.000").alias("Duration_ms"), F.lit(1).alias("Packet_Count")) \
        .write.option("header", True).csv(path)
    return tables.read_busy_csv(spark, path).select("window_start_ns", "source", "destination", "bytes_mb", "wall_start_ns")


def probe_lines(spark, sf, *keep):
    """Log lines whose numbers come from the events; every third line has no time, every ninth is noise."""
    t = A.transfers(spark, sf)
    seconds = (F.col("end_ns") - F.col("start_ns")) / 1e9
    line = F.concat(F.lit("["), F.when(F.col("k") % 2 == 0, "BW").otherwise("LAT"), F.lit("] Path "),
                    F.col("user_id").cast("string"), F.lit(": "), fixed_text(seconds), F.lit("µs ("),
                    fixed_text(F.col("k") / 4.0), F.lit("GB/s)"))
    stamp = F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("] "))
    return t.select(*keep, F.when(F.col("k") % 9 == 5, F.concat(F.lit("note: "), F.col("k").cast("string")))
                    .when(F.col("k") % 3 == 1, line).otherwise(F.concat(stamp, line)).alias("value"))


READINGS_SQL = """readings AS (SELECT event_id, CASE WHEN k % 3 = 1 THEN NULL ELSE epoch_us(ts) / 1e6 END AS t,
  CASE WHEN k % 2 = 0 THEN 'BW' ELSE 'LAT' END AS type, user_id AS path_id,
  (end_ns - start_ns) / 1e9 AS latency_us, k / 4.0 AS bandwidth_gbps FROM t WHERE k % 9 <> 5)"""


@query("read_probe_log", with_(f"{T}, {READINGS_SQL}", "SELECT t, type, path_id, latency_us, bandwidth_gbps FROM readings"))
def read_probe_log(spark, sf):
    path = new_folder(spark, "probelog")
    probe_lines(spark, sf).write.text(path)
    return logs.read_probe_log(spark, path)


@query("read_cpu_log", with_(T, """SELECT round(100 - (100 - k / 4.0), 6) AS busy_pct, count(*) AS n FROM t
WHERE k % 10 <> 0 GROUP BY ALL"""))
def read_cpu_log(spark, sf):
    """CPU monitor text: a header, data rows and averages, built from the events."""
    path = new_folder(spark, "cpu")
    k = F.col("k")
    row = F.concat(F.date_format("ts", "hh:mm:ss"), F.lit(" PM  all    "), fixed_text(k / 8.0), F.lit("    0.00    "),
                   fixed_text(k / 8.0), F.lit("    0.00    0.00    0.00    0.00    0.00    0.00   "), fixed_text(100 - k / 4.0))
    head = F.lit("09:52:39 PM  CPU    %usr   %nice    %sys %iowait    %irq   %soft  %steal  %guest  %gnice   %idle")
    mean = F.concat(F.lit("Average:     all    1.00    0.00    1.00    0.00    0.00    0.00    0.00    0.00    0.00   "),
                    fixed_text(100 - k / 4.0))
    A.transfers(spark, sf).select(F.when(k % 20 == 0, head).when(k % 20 == 10, mean).otherwise(row).alias("value")) \
        .write.text(path)
    out = logs.read_cpu_log(spark, path).withColumn("busy_pct", F.round("busy_pct", 6))
    return out.groupBy("busy_pct").agg(F.count(F.lit(1)).alias("n"))


@query("read_process_log", with_(T, "SELECT k / 4.0 AS cpu_pct, count(*) AS n FROM t WHERE k % 10 <> 0 GROUP BY ALL"))
def read_process_log(spark, sf):
    path = new_folder(spark, "process")
    k = F.col("k")
    row = F.concat(F.date_format("ts", "hh:mm:ss"), F.lit(" PM     0   1960295    0.00    0.00    0.00    0.00    "),
                   fixed_text(k / 4.0), F.lit("   "), k.cast("string"), F.lit("  python3"))
    head = F.lit("09:37:10 PM   UID       PID    %usr %system  %guest   %wait    %CPU   CPU  Command")
    mean = F.concat(F.lit("Average:        0   1960295    0.00    0.00    0.00    0.00    "), fixed_text(k / 4.0),
                    F.lit("     -  python3"))
    A.transfers(spark, sf).select(F.when(k % 20 == 0, head).when(k % 20 == 10, mean).otherwise(row).alias("value")) \
        .write.text(path)
    return logs.read_cpu_log(spark, path, "process").groupBy("cpu_pct").agg(F.count(F.lit(1)).alias("n"))


@query("read_key_values", with_(T, """SELECT 'user_' || user_id AS key, 'a=' || k AS value, count(*) AS n FROM t
WHERE k % 4 <> 0 GROUP BY ALL"""))
def read_key_values(spark, sf):
    path = new_folder(spark, "meta")
    line = F.concat(F.lit("user_"), F.col("user_id").cast("string"), F.lit(" = a="), F.col("k").cast("string"))
    A.transfers(spark, sf).select(F.when(F.col("k") % 4 == 0, F.lit("# note")).otherwise(line).alias("value")) \
        .write.text(path)
    return logs.read_key_values(spark, path).groupBy("key", "value").agg(F.count(F.lit(1)).alias("n"))


@query("feature_table", with_(TBG, """SELECT path, gap_idx, duration_ns, CAST(duration_ns >= 500000000000 AS INTEGER) AS
y_500000000000 FROM gaps WHERE gap_idx >= 5 AND start_ns >= epoch_us(TIMESTAMP '2024-01-16 00:00:00') * 1000"""))
def feature_table(spark, sf):
    """Write the feature table by pass and read one pass back."""
    tl = timeline(spark, sf)
    rows = training_set(tl.gaps, tl.busy, PATH, [A.HORIZONS[5]], splits=tl.splits)
    cut = 1_705_363_200_000_000_000                                        # 2024-01-16
    path = new_folder(spark, "features")
    rows = rows.withColumn("pass", F.when(F.col("start_ns") < cut, 1).otherwise(2))
    tables.write_features(rows, path)
    return tables.read_features(spark, path, 2, schema=rows.schema).select("path", "gap_idx", "duration_ns", "y_500000000000")


@query("write_trace_csv", with_(TX, """SELECT CAST(event_id AS VARCHAR) AS tid, printf('%.2f', size / 1048576.0) AS
size_mb, printf('%.2f', (end_ns - start_ns) / 1000.0) AS latency_us, CAST(start_ns AS VARCHAR) AS start_ns,
CAST(start_ns AS VARCHAR) AS wall_end_ns, CAST(direction AS VARCHAR) AS direction FROM tx"""))
def write_trace_csv(spark, sf):
    path = new_folder(spark, "trace")
    trace.write_trace_csv(extended_rows(spark, sf), path)
    return spark.read.option("header", True).csv(path).select("tid", "size_mb", "latency_us", "start_ns", "wall_end_ns",
                                                              "direction")


@query("write_busy_csv", with_(TB, """SELECT CAST(start_ns AS VARCHAR) AS window_start_ns, CAST(end_ns AS VARCHAR) AS
window_end_ns, printf('%.2f', bytes_total / 1048576.0) AS bytes_mb, printf('%.3f', (end_ns - start_ns) / 1e6) AS
duration_ms, CAST(event_count AS VARCHAR) AS packet_count FROM busy"""))
def write_busy_csv(spark, sf):
    path = new_folder(spark, "busy")
    tables.write_busy_csv(timeline(spark, sf).busy, path, PATH)
    return spark.read.option("header", True).csv(path).select(
        "window_start_ns", "window_end_ns", "bytes_mb", "duration_ms", "packet_count")


@query("write_gap_csv", with_(TBG, """SELECT start_ns AS gap_start_ns, end_ns AS gap_end_ns, duration_ns / 1000.0 AS
duration_us FROM gaps"""))
def write_gap_csv(spark, sf):
    path = new_folder(spark, "gaps")
    tables.write_gap_csv(timeline(spark, sf).gaps, path, PATH)
    return tables.read_gap_csv(spark, path).drop("path_id")


@query("write_report_tables", with_(T, """SELECT fmt, path, CAST(count(*) AS VARCHAR) AS events, CAST(sum(size) AS
VARCHAR) AS bytes_total FROM t, (SELECT unnest(['csv', 'json']) AS fmt) GROUP BY fmt, path"""))
def write_report_tables(spark, sf):
    totals = G.path_totals(A.transfers(spark, sf), PATH)
    path = new_folder(spark, "report")
    names = ["path", "events", "bytes_total"]
    for fmt in ("csv", "json"):
        tables.write_report_tables({"totals": totals}, f"{path}/{fmt}", fmt)
    csv = spark.read.option("header", True).csv(f"{path}/csv/totals").select(*names).withColumn("fmt", F.lit("csv"))
    json = spark.read.schema("path string, events string, bytes_total string").json(f"{path}/json/totals") \
        .select(*names).withColumn("fmt", F.lit("json"))
    return csv.unionByName(json)
