"""Streams over several micro-batches must end where the batch operators end."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan.operators import intervals as I
from idlespan.operators import windows as W
from idlespan.streaming import live as S

TRANSFERS = "path string, start_ns long, end_ns long, size long"
SECOND = 10**9


def source(spark, folder, rows, batches):
    """Write time-ordered rows as several files and stream them one file per micro-batch."""
    rows = sorted(rows, key=lambda r: r[1])
    step = -(-len(rows) // batches)
    for i in range(batches):
        part = spark.createDataFrame(rows[i * step:(i + 1) * step], TRANSFERS)
        part.coalesce(1).write.mode("append").parquet(folder)
    schema = spark.read.parquet(folder).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return stream.withColumn("ts", S.event_time())


def traffic(seed=3, n=300):
    rnd = random.Random(seed)
    rows = []
    for path in ("a", "b"):
        at = 10**15
        for _ in range(n):
            at += rnd.randrange(1, 40) * SECOND
            rows.append((path, at, at + rnd.randrange(0, 6) * SECOND, 7))
    return rows


@pytest.mark.parametrize("batches", [1, 5])
def test_stream_equals_batch(spark, tmp_path, batches):
    rows = traffic()
    tolerance = 10 * SECOND
    stream = source(spark, str(tmp_path / "in"), rows, batches)
    busy = S.run_to_table(S.stream_busy(stream, ["path"], tolerance // 1000, "5 seconds"),
                          str(tmp_path / "busy"))
    batch = I.merge_intervals(spark.createDataFrame(rows, TRANSFERS), ["path"], tolerance=tolerance)
    names = ["path", "start_ns", "end_ns", "bytes_total", "event_count"]
    got, want = rows_of(busy.rows, *names), rows_of(batch, *names)
    assert set(got) <= set(want) and 0 <= len(want) - len(got) <= 4      # only open intervals are missing

    table = S.run_to_table(S.stream_gaps(busy.follow(), ["path"]), str(tmp_path / "gaps"))
    gaps = I.extract_gaps(busy.rows, ["path"])
    assert rows_of(table.rows, "path", "gap_idx", "start_ns", "end_ns") == rows_of(gaps, "path", "gap_idx", "start_ns", "end_ns")
    smooth = {(r.path, r.gap_idx + 1): r.ewma for r in W.ewma(gaps, ["path"]).collect()}
    low = {(r.path, r.gap_idx): r.g_lower_bound for r in W.lower_bound(gaps, key=["path"]).collect()}
    for r in table.rows.collect():
        assert r.ewma == pytest.approx(smooth.get((r.path, r.gap_idx), 0.0))
        assert r.g_lower_bound == pytest.approx(low[r.path, r.gap_idx])

    decided = S.stream_decisions(table.follow(), "threshold", low=5 * SECOND, high=20 * SECOND,
                                 durations={1: SECOND, 2: 5 * SECOND, 3: 20 * SECOND})
    limited = S.run_to_table(S.stream_rate_limit(decided, 2, 100 * SECOND, ["path"], "1000 seconds"),
                             str(tmp_path / "limited"))
    per = limited.rows.groupBy(F.floor(F.col("end_ns") / (100 * SECOND))).count()         # windows of the time a gap is known
    assert per.filter("count > 2").count() == 0 and limited.rows.count() > 0


def test_late_duplicates_and_alarm(spark, tmp_path):
    rows = [("a", i * SECOND, i * SECOND + 1, 1) for i in range(1, 9)]
    stream = source(spark, str(tmp_path / "in"), rows + rows, 2)
    once = S.run_to_table(S.stream_dedup(stream, ["path"], "1 hour"), str(tmp_path / "once"))
    assert once.rows.count() == 8
    low = [0, 1, 1, 1, 0, 1, 1, 1]
    readings = source(spark, str(tmp_path / "once_in"), rows, 4).select(
        "path", (F.col("start_ns") / SECOND).alias("t"))
    flags = F.array(*[F.lit(bool(x)) for x in low])
    flagged = readings.withColumn("is_degraded", F.get(flags, (F.col("t") - 1).cast("int")))
    alarm = S.run_to_table(S.stream_alarm(flagged, 3, ["path"]), str(tmp_path / "alarm"))
    assert rows_of(alarm.rows, "t", "streak") == [(4.0, 3), (8.0, 3)]      # streaks run across micro-batches


def test_counts_per_window(spark, tmp_path):
    rows = [("a", i * SECOND, i * SECOND + 1, 1) for i in range(40)]
    stream = source(spark, str(tmp_path / "in"), rows, 4).withColumn("fits", F.col("start_ns") % (2 * SECOND) == 0)
    out = S.run_to_table(S.stream_counts(stream, "10 seconds", "1 second"), str(tmp_path / "counts"))
    assert rows_of(out.rows, "probes", "safe", "unsafe") == [(10, 5, 5)] * 3


@pytest.mark.parametrize("files", [1, 8, 64])
def test_results_do_not_depend_on_files_per_batch(spark, tmp_path, files):
    """64 files in order of time, read 1, 8 or 64 at a time, give what the batch operators give."""
    rows = sorted(traffic(5, 120), key=lambda r: r[1])
    step = -(-len(rows) // 64)
    folder = str(tmp_path / "in")
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i:i + step], TRANSFERS).coalesce(1).write.mode("append").parquet(folder)
    stream = (spark.readStream.schema(TRANSFERS).option("maxFilesPerTrigger", files).parquet(folder).withColumn("ts", S.event_time()))
    busy = S.run_to_table(S.stream_busy(stream, ["path"], 10 * SECOND // 1000, "5 seconds"), str(tmp_path / "busy"))
    table = S.run_to_table(S.stream_gaps(busy.follow(), ["path"]), str(tmp_path / "gaps"))
    gaps = table.rows.collect()
    assert len(gaps) > 50
    once = S.run_to_table(S.stream_dedup(table.follow(), ["path"], "5 seconds"), str(tmp_path / "once"))
    assert once.rows.count() == len(gaps)
    lengths = {1: SECOND, 2: 5 * SECOND, 3: 20 * SECOND}
    decided = S.stream_decisions(table.follow(), "oracle", durations=lengths)
    kept = [g for g in gaps if g.duration_ns >= SECOND]
    mark = max(g.end_ns for g in kept) - 5 * SECOND
    width = 100 * SECOND
    limited = S.run_to_table(S.stream_rate_limit(decided, 2, width, ["path"], "5 seconds"), str(tmp_path / "limited"))
    want = []
    for w in {g.end_ns // width for g in kept}:
        if (w + 1) * width < mark:
            want += sorted((g.start_ns, g.gap_idx, g.path) for g in kept if g.end_ns // width == w)[:2]
    assert rows_of(limited.rows, "start_ns", "gap_idx", "path") == sorted(want)
    counted = S.run_to_table(S.stream_counts(decided, "100 seconds", "5 seconds"), str(tmp_path / "counted"))
    assert counted.rows.agg(F.sum("probes")).first()[0] == sum((g.end_ns // width + 1) * width <= mark for g in kept)
