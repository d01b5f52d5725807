"""The live loop over a streamed events table.  Each query drains what is there and reads the result table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from ..operators.aggregates import flag_degraded
from ..operators.aggregates import gap_stats as stats_of
from ..operators.models import fit_survival, score
from ..sources.trace import EXTENDED, trace_csv_rows, write_trace_csv
from ..streaming import live as S
from . import adapter as A
from .q_policies import D
from .q_sources import extended_rows
from .q_stats import GAP_STATS_SQL
from .registry import PATH, new_folder, query
from .sql import TB, TU, T, gapped, merged, with_

TOL_US = A.TOLERANCE // 1000
DELAY = "10 seconds"

# A session closes when its last end plus the tolerance is behind the watermark, which counts milliseconds.
OPEN_CUT = f"""closed AS (SELECT * FROM busy WHERE end_ns // 1000 + {TOL_US} <=
  (SELECT max(epoch_us(ts)) // 1000 * 1000 - 10000000 FROM t))"""
CLOSED = f"{TB}, {OPEN_CUT}"
CLOSED_GAPS = f"{CLOSED}, {gapped(busy='closed')}"
CLOSED_GAPS_MANY = f"{TU}, {merged()}, {OPEN_CUT}, {gapped(busy='closed')}"
SLICES = 4


def polled(parts, write, follow, out):
    """The table of a stage that polls a folder each time a part has come: a part is written by as many tasks as it has, and all its
    files are one micro-batch.  ``write`` appends a part to the folder, ``follow`` makes the stage over it."""
    for part in parts:
        write(part)
        table = S.run_to_table(follow(), out)
    return table


def events_table(spark, sf, path, make, name):
    """The table of the stage that ``make`` builds over the streamed events; by user they come in slices of time, one per micro-batch, in order."""
    events, out = A.read_events(spark, sf), new_folder(spark, name)
    if path == "event_type":
        raw = spark.readStream.schema(events.schema).option("pathGlobFilter", "events.parquet").parquet(sf)
        return S.run_to_table(make(A.as_transfers(raw)), out)
    folder = new_folder(spark, "events")
    lo, hi = events.agg(F.min("ts"), F.max("ts")).first()
    edges = [lo + (hi - lo) * i / SLICES for i in range(SLICES)]
    parts = [events.filter(F.col("ts") >= F.lit(edge)) for edge in edges]
    parts = [part.filter(F.col("ts") < F.lit(edge)) for part, edge in zip(parts, edges[1:])] + parts[-1:]
    return polled(parts, lambda part: part.write.mode("append").parquet(folder),
                  lambda: make(A.as_transfers(spark.readStream.schema(events.schema).parquet(folder), path)), out)


SLICE_SQL = f"""sl AS (SELECT *, start_ns // 1000 AS us, (start_ns // 1000 - lo) * {SLICES} // (hi - lo + 1) AS slice FROM t,
  (SELECT min(start_ns) // 1000 AS lo, max(start_ns) // 1000 AS hi FROM t))"""


def with_slice(rows):
    """Which of ``SLICES`` equal parts of the time a row starts in."""
    us = F.floor(F.col("start_ns") / 1000)
    lo, hi = rows.agg(F.min(us), F.max(us)).first()
    return rows.withColumn("slice", F.floor((us - lo) * SLICES / (hi - lo + 1)).cast("int"))


def slices_table(spark, sf, make, out, order=range(SLICES), path=None, folder=None):
    """The table of the stage that ``make`` builds over the events as one path or by ``path``, a slice of time per micro-batch, delivered in
    the given order of slices."""
    rows = with_slice(A.transfers(spark, sf, path or "event_type"))
    rows = rows if path else rows.withColumn("path", F.lit("all"))
    folder = folder or new_folder(spark, "slices")
    return polled([rows.filter(F.col("slice") == i).drop("slice") for i in order], lambda part: part.write.mode("append").parquet(folder),
                  lambda: make(spark.readStream.schema(rows.drop("slice").schema).parquet(folder)), out)


def busy_table(spark, sf, path="event_type"):
    """Closed busy intervals, streamed to a table."""
    return events_table(spark, sf, path, lambda t: S.stream_busy(t, PATH, TOL_US, DELAY), "busy")


def gap_table(spark, sf, path="event_type"):
    """Gaps over the growing table of closed intervals."""
    return S.run_to_table(S.stream_gaps(busy_table(spark, sf, path).follow(), PATH), new_folder(spark, "gaps"))


@query("stream_trace", with_(T, "SELECT direction, count(*) AS events, CAST(sum(size) AS BIGINT) AS bytes FROM t GROUP BY ALL"))
def stream_trace(spark, sf):
    """Tail a folder of trace files written from the events table."""
    path = new_folder(spark, "trace")
    write_trace_csv(extended_rows(spark, sf), path)
    out = S.run_to_table(S.stream_transfers(spark, path), new_folder(spark, "transfers"))
    return out.rows.groupBy("direction").agg(F.count(F.lit(1)).alias("events"), F.sum("size").alias("bytes"))


@query("stream_rejects", with_(T, """SELECT k % 7 = 0 AS broken, count(*) AS events FROM t GROUP BY ALL"""))
def stream_rejects(spark, sf):
    """Every seventh row has a size that is no number; good rows and rejects go to tables of their own and add up."""
    path = new_folder(spark, "broken-trace")
    rows = extended_rows(spark, sf)
    write_trace_csv(rows.filter(F.col("k") % 7 != 0).drop("k"), path)
    bad = rows.filter(F.col("k") % 7 == 0).drop("k")
    folder = new_folder(spark, "rows")
    write_trace_csv(bad, folder)
    text = spark.read.option("header", True).csv(folder)
    text.withColumn("size_mb", F.concat(F.lit("x"), "size_mb")).write.mode("append").option("header", True).csv(path)
    good = S.run_to_table(S.stream_transfers(spark, path), new_folder(spark, "transfers")).rows
    rejects = S.run_to_table(S.stream_rejects(spark, path), new_folder(spark, "rejects")).rows
    count = F.count(F.lit(1)).alias("events")
    return good.agg(count).select(F.lit(False).alias("broken"), "events").unionByName(
        rejects.agg(count).select(F.lit(True).alias("broken"), "events"))


@query("stream_busy", with_(CLOSED, "SELECT path, start_ns, end_ns, bytes_total, event_count FROM closed"))
def stream_busy(spark, sf):
    return busy_table(spark, sf).rows.select("path", "start_ns", "end_ns", "bytes_total", "event_count")


@query("stream_gaps", with_(CLOSED_GAPS, "SELECT path, gap_idx, start_ns, end_ns, duration_ns FROM gaps"))
def stream_gaps(spark, sf):
    return gap_table(spark, sf).rows.select("path", "gap_idx", "start_ns", "end_ns", "duration_ns")


@query("stream_trailing", with_(CLOSED_GAPS, """SELECT path, gap_idx, count(*) OVER w AS history, round(CASE WHEN count(*)
OVER w >= 10 THEN quantile_cont(duration_ns, 0.1) OVER w ELSE 0 END, 0) AS trailing_p10, round(CASE WHEN count(*) OVER w >=
20 THEN quantile_cont(duration_ns, 0.05) OVER w ELSE 0 END, 0) AS g_lower_bound FROM gaps WINDOW w AS (PARTITION BY path
ORDER BY gap_idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"""))
def stream_trailing(spark, sf):
    out = S.run_to_table(S.stream_trailing(gap_table(spark, sf).follow()), new_folder(spark, "trailing"))
    return out.rows.select("path", "gap_idx", "history", F.round("trailing_p10", 0).alias("trailing_p10"),
                      F.round("g_lower_bound", 0).alias("g_lower_bound"))


def decision_stream(spark, sf, policy="oracle", path="event_type"):
    gaps = gap_table(spark, sf, path).follow()
    return S.stream_decisions(gaps, policy, 200_000 * A.SCALE, durations=D)


STREAM_FEATURES = ["ewma", "trailing_p10", "g_lower_bound", "history"]


@query("stream_model_decisions")
def stream_model_decisions(spark, sf):
    """A model of the streamed trailing columns, fitted on the table so far, scores the stream itself."""
    table = gap_table(spark, sf)
    fitted = fit_survival(table.rows, [A.HORIZONS[5]], STREAM_FEATURES)
    scored = score(table.follow(), fitted, [A.HORIZONS[5]])
    decided = S.stream_decisions(scored, "predictive", durations=D, eta_bandwidth=0.8, eta_normal=0.7)
    out = S.run_to_table(decided, new_folder(spark, "model-decisions"))
    return out.rows.groupBy("probe_type").agg(F.count(F.lit(1)).alias("probes"), F.count_if("fits").alias("fits"))


DEC = """dec AS (SELECT path, gap_idx, start_ns, end_ns, CASE WHEN duration_ns >= 5100000000000 THEN 3 WHEN
  duration_ns >= 500000000000 THEN 2 ELSE 1 END AS probe_type FROM gaps WHERE duration_ns >= 50000000000)"""
DECIDED, DECIDED_MANY = f"{CLOSED_GAPS}, {DEC}", f"{CLOSED_GAPS_MANY}, {DEC}"


@query("stream_decisions", with_(DECIDED, "SELECT path, gap_idx, probe_type, true AS fits FROM dec"))
def stream_decisions(spark, sf):
    out = S.run_to_table(decision_stream(spark, sf), new_folder(spark, "decisions"))
    return out.rows.select("path", "gap_idx", "probe_type", "fits")


# A window is decided when it lies behind the watermark of the decisions.
RATE_LIMIT = """SELECT path, gap_idx, probe_type FROM dec WHERE (end_ns // 3600000000000 + 1) * 3600000 < (SELECT max(end_ns) //
1000000 - 10000 FROM dec) QUALIFY row_number() OVER (PARTITION BY end_ns // 3600000000000 ORDER BY start_ns, gap_idx, path) <= 3"""
COUNTS = """SELECT epoch_us(time_bucket(INTERVAL 1 DAY, make_timestamp(end_ns // 1000))) AS window_us, count(*) AS probes,
count(*) AS safe, 0 AS "unsafe" FROM dec GROUP BY 1 HAVING window_us + 86400000000 <= (SELECT max(end_ns // 1000) // 1000 * 1000 -
10000000 FROM dec)"""
DEDUP = "SELECT path, start_ns, end_ns FROM gaps"
ALARM = """, f AS (SELECT path, start_ns / 1e9 AS t, event_id, k < 30 AS low FROM t), g AS (SELECT *, sum(CASE WHEN low THEN 0
ELSE 1 END) OVER (PARTITION BY path ORDER BY t, event_id) AS run FROM f), s AS (SELECT path, t, low, sum(CAST(low AS INTEGER))
OVER (PARTITION BY path, run ORDER BY t, event_id) AS streak FROM g)
SELECT path, t, CAST(3 AS BIGINT) AS streak FROM s WHERE low AND streak = 3"""


def rate_limit(spark, sf, path):
    out = S.run_to_table(S.stream_rate_limit(decision_stream(spark, sf, path=path), 3, 3600 * 10**9, tie=PATH),
                         new_folder(spark, "limited"))
    return out.rows.select("path", "gap_idx", "probe_type")


def counts(spark, sf, path):
    out = S.run_to_table(S.stream_counts(decision_stream(spark, sf, path=path), "1 day", DELAY), new_folder(spark, "counts"))
    return out.rows.select(F.unix_micros("window_start").alias("window_us"), "probes", "safe", "unsafe")


def dedup(spark, sf, path):
    """Every gap is delivered twice."""
    gaps = gap_table(spark, sf, path).follow().withColumn("_twice", F.explode(F.array(F.lit(0), F.lit(1))))
    out = S.run_to_table(S.stream_dedup(gaps.drop("_twice"), PATH, DELAY), new_folder(spark, "dedup"))
    return out.rows.select("path", "start_ns", "end_ns")


def alarm(spark, sf, path):
    """Three readings in a row below the limit; the reading is the k of the event."""
    def stage(t):
        return S.stream_alarm(flagged(t), 3, PATH, tie=["event_id"])
    return events_table(spark, sf, path, stage, "alarm").rows.select("path", "t", "streak")


def flagged(t):
    readings = t.select("path", "event_id", (F.col("start_ns") / 1e9).alias("t"), F.col("k").alias("bandwidth_gbps"))
    return flag_degraded(readings, 30.0, 1.0).select("path", "t", "is_degraded", "event_id")


for _name, _job, _one, _many in (("stream_rate_limit", rate_limit, with_(DECIDED, RATE_LIMIT), with_(DECIDED_MANY, RATE_LIMIT)),
                                 ("stream_counts", counts, with_(DECIDED, COUNTS), with_(DECIDED_MANY, COUNTS)),
                                 ("stream_dedup", dedup, with_(CLOSED_GAPS, DEDUP), with_(CLOSED_GAPS_MANY, DEDUP)),
                                 ("stream_alarm", alarm, with_(T, ALARM), with_(TU, ALARM))):
    query(_name, _one)(partial(_job, path="event_type"))
    query(f"{_name}_many_paths", _many)(partial(_job, path="user_id"))


# --- what comes late, and one path that holds everything ---------------------------------------------------------------------

LEDGER_SQL = with_(T, f""", {SLICE_SQL}, r AS (SELECT *, k % 7 = 0 AS broken, event_id % 97 = 0 AND slice < {SLICES - 1} AS planted FROM sl),
w AS (SELECT max(us) // 1000 * 1000 - 10000000 AS mark FROM r WHERE NOT broken AND NOT planted AND slice < {SLICES - 1}),
l AS (SELECT *, CASE WHEN broken THEN 'rejected' WHEN planted AND end_ns // 1000 + {TOL_US} <= mark THEN 'late' ELSE 'good' END AS kind FROM r, w)
SELECT kind, count(*) AS events FROM l GROUP BY kind UNION ALL SELECT 'read', count(*) FROM l""")
NODES = ["src_dev", "dst_dev", "src_numa", "dst_numa"]


@query("stream_late_ledger", LEDGER_SQL)
def stream_late_ledger(spark, sf):
    """Trace files in four slices of time.  Every seventh row is broken, and every 97th comes with the last file: what the watermark
    has passed is late.  Good, late and rejected rows add up to the rows read."""
    rows = with_slice(extended_rows(spark, sf))
    planted = (F.col("event_id") % 97 == 0) & (F.col("slice") < SLICES - 1)
    folder = new_folder(spark, "late-trace")
    text = trace_csv_rows(rows.withColumn("_with", F.when(planted, SLICES - 1).otherwise(F.col("slice"))), ["k", "_with"])
    text = text.withColumn("size_mb", F.when(F.col("k") % 7 == 0, F.concat(F.lit("x"), "size_mb")).otherwise(F.col("size_mb"))).drop("k")
    table = polled([text.filter(F.col("_with") == i).drop("_with") for i in range(SLICES)],
                   lambda part: part.write.mode("append").option("header", True).csv(folder),
                   lambda: S.stream_busy(S.stream_trace(spark, folder, EXTENDED), NODES, TOL_US, DELAY, layout=EXTENDED),
                   new_folder(spark, "late-busy"))
    kinds = {"good": "good", "late": "late", "rejected": "rejected", "read": "rows_in"}
    sums = table.ledger().agg(*[F.sum(c).alias(k) for k, c in kinds.items()])
    return sums.unpivot([], list(kinds), "kind", "events").filter("events > 0")


ONE = f"{T.replace('event_type AS path', chr(39) + 'all' + chr(39) + ' AS path')}, {merged()}, {OPEN_CUT}"
PART = 1500


def one_path_busy(spark, sf):
    return slices_table(spark, sf, lambda t: S.stream_busy(t, PATH, TOL_US, DELAY, most_rows=PART), new_folder(spark, "one-busy"))


@query("stream_busy_one_path", with_(ONE, "SELECT path, start_ns, end_ns, bytes_total, event_count FROM closed"))
def stream_busy_one_path(spark, sf):
    """All events on one path over several micro-batches, each merged in segments of about 1 500 rows."""
    return one_path_busy(spark, sf).rows.select("path", "start_ns", "end_ns", "bytes_total", "event_count")


@query("stream_gaps_one_path", with_(f"{ONE}, {gapped(busy='closed')}", """SELECT path, gap_idx, start_ns, end_ns, duration_ns, count(*)
OVER w AS history, round(CASE WHEN count(*) OVER w >= 10 THEN quantile_cont(duration_ns, 0.1) OVER w ELSE 0 END, 0) AS trailing_p10
FROM gaps WINDOW w AS (PARTITION BY path ORDER BY gap_idx ROWS BETWEEN 100 PRECEDING AND 1 PRECEDING)"""))
def stream_gaps_one_path(spark, sf):
    stage = S.stream_gaps(one_path_busy(spark, sf).follow(), PATH, most_rows=PART)
    rows = S.run_to_table(stage, new_folder(spark, "one-gaps")).rows
    return rows.select("path", "gap_idx", "start_ns", "end_ns", "duration_ns", "history", F.round("trailing_p10", 0).alias("trailing_p10"))


@query("stream_alarm_shuffled", with_(T.replace("event_type AS path", "'all' AS path"), f"""{ALARM.rstrip()} AND
t * 1e6 <= (SELECT max(t) * 1e6 - 16 * 86400000000 FROM s)"""))
def stream_alarm_shuffled(spark, sf):
    """Slices arrive out of order, and the alarms are those of the order of time, as far as the watermark has come."""
    def stage(t):
        return S.stream_alarm(flagged(t), 3, PATH, "16 days", ["event_id"], PART)
    return slices_table(spark, sf, stage, new_folder(spark, "shuffled-alarm"), (1, 0, 3, 2)).rows.select("path", "t", "streak")


@query("incremental_polls", with_(f"{CLOSED_GAPS}, {GAP_STATS_SQL}", "SELECT stats.*, (SELECT count(*) FROM t) AS rows_read FROM stats"))
def incremental_polls(spark, sf):
    """Two polls of a growing folder: the second reads only the files of its own, and the statistics are those of one batch over all."""
    source, busy, gaps, counts = (new_folder(spark, n) for n in ("polled", "polled-busy", "polled-gaps", "polled-counts"))
    for new in (range(SLICES // 2), range(SLICES // 2, SLICES)):
        closed = slices_table(spark, sf, lambda t: S.stream_busy(t, PATH, TOL_US, DELAY), busy, new, "event_type", source)
        found = S.run_to_table(S.stream_gaps(closed.follow(), PATH), gaps)
        stage = S.stream_histogram(found.follow(), PATH)
        table = S.run_to_table(stage, counts)
    read = closed.ledger().agg(F.sum("rows_in")).scalar()
    return stats_of(S.current(table, stage, "counts"), PATH, weight="n").withColumn("rows_read", read)
