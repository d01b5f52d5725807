"""Stages with table state: late rows, restarts, one hot path, order of arrival."""

import random

import pytest
from conftest import rows_of
from pyspark.sql import functions as F
from test_streaming import SECOND, TRANSFERS, source

from idlespan.operators import intervals as I
from idlespan.operators import windows as W
from idlespan.streaming import live as S
from idlespan.streaming import stages

SF_DIR = "/root/testdata/sf0.001"
NAMES = ["path", "start_ns", "end_ns", "bytes_total", "event_count"]


def in_files(spark, folder, parts, schema=TRANSFERS):
    """One file and micro-batch per list of rows, in the given order."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)


def busy_rows(n, at=10**6, step=30):
    return [("a", (at + step * i) * SECOND, (at + step * i + 3) * SECOND, 5) for i in range(n)]


def test_late_rows_are_kept_and_counted(spark, tmp_path):
    rows = busy_rows(30)
    late = [("a", rows[3][1] + 1, rows[3][1] + 2, 5), ("b", rows[0][1], rows[0][2], 5)]
    in_time = ("b", rows[0][1], rows[29][2], 5)                       # starts long ago, but has only just ended
    backwards = ("c", rows[29][1], rows[29][1] - 9, 5)
    stream = in_files(spark, str(tmp_path / "in"), [rows[:20], rows[20:25] + late[:1], rows[25:] + late[1:] + [in_time, backwards]])
    stage = S.stream_busy(stream, ["path"], 1_000_000, "5 seconds")
    table = S.run_to_table(stage, str(tmp_path / "busy"))
    assert rows_of(table.side("late"), "path", "start_ns") == sorted((r[0], r[1]) for r in late)
    assert rows_of(table.ledger(), "batch", "rows_in", "good", "late", "rejected") == [(0, 20, 20, 0, 0), (1, 6, 5, 1, 0), (2, 8, 7, 1, 0)]
    want = I.merge_intervals(spark.createDataFrame(rows, TRANSFERS), ["path"], tolerance=SECOND)
    assert rows_of(table.rows, *NAMES) == rows_of(want, *NAMES)[:29]     # the last one is open, and so is the long one


@pytest.mark.parametrize("fails_at", ["out", "open", "ledger"])
def test_a_batch_that_failed_is_counted_once(spark, tmp_path, monkeypatch, fails_at):
    stream = in_files(spark, str(tmp_path / "in"), [busy_rows(5), busy_rows(5, 2 * 10**6)])
    stage, real, calls = S.stream_busy(stream, ["path"], 1_000_000, "5 seconds"), stages.publish, []

    def breaks(df, folder, name):
        real(df, folder, name)
        if folder.endswith(fails_at) and name.endswith("1") and not calls:
            calls.append(name)
            raise OSError("lost")
    monkeypatch.setattr(stages, "publish", breaks)
    with pytest.raises(Exception, match="lost"):
        S.run_to_table(stage, str(tmp_path / "busy"))
    table = S.run_to_table(stage, str(tmp_path / "busy"))
    assert table.rows.count() == 9 and rows_of(table.ledger(), "batch", "rows_in") == [(0, 5), (1, 5)]


def test_one_path_in_segments(spark, tmp_path):
    """A micro-batch of one path over the bound gives what the batch operators give, over several batches."""
    rnd, rows, at = random.Random(7), [], 10**6
    for _ in range(1500):
        at += rnd.randrange(1, 30)
        rows.append(("a", at * SECOND, (at + rnd.randrange(0, 8)) * SECOND, 7))
    stream = source(spark, str(tmp_path / "in"), rows, 3)
    busy = S.run_to_table(S.stream_busy(stream, ["path"], 2_000_000, "5 seconds", most_rows=150), str(tmp_path / "busy"))
    whole = I.merge_intervals(spark.createDataFrame(rows, TRANSFERS), ["path"], tolerance=2 * SECOND)
    assert rows_of(busy.rows, *NAMES) == rows_of(whole, *NAMES)[:busy.rows.count()]
    assert whole.count() - busy.rows.count() <= 2
    first = S.run_to_table(S.stream_gaps(busy.follow(), ["path"], most_rows=150), str(tmp_path / "gaps")).rows
    gaps = I.extract_gaps(busy.rows, ["path"]).cache()
    assert rows_of(first, "gap_idx", "start_ns", "end_ns") == rows_of(gaps, "gap_idx", "start_ns", "end_ns")
    smooth = {r.gap_idx + 1: r.ewma for r in W.ewma(gaps, ["path"]).collect()}
    low = {r.gap_idx: r.g_lower_bound for r in W.lower_bound(gaps, key=["path"]).collect()}
    for r in first.collect():
        assert r.ewma == pytest.approx(smooth.get(r.gap_idx, 0.0)) and r.g_lower_bound == pytest.approx(low[r.gap_idx])
        assert r.history == min(r.gap_idx, 100)


def test_gaps_behind_the_last_end(spark, tmp_path, monkeypatch):
    """Intervals that end behind what was seen are late, partly new ones count from the last end; a path rests while state is compacted."""
    monkeypatch.setattr(stages, "COMPACT", 2)
    busy = "path string, start_ns long, end_ns long"
    parts = [[("b", 5, 6), ("a", 10, 14), ("a", 20, 24)], [("a", 30, 34)], [("a", 11, 13), ("a", 32, 39), ("a", 40, 44)],
             [("a", 50, 54)], [("a", 60, 64), ("b", 9, 12)]]
    table = S.run_to_table(S.stream_gaps(in_files(spark, str(tmp_path / "in"), parts, busy), ["path"]), str(tmp_path / "gaps"))
    assert rows_of(table.side("late"), "start_ns", "end_ns") == [(11, 13)]
    want = [("a", 0, 14, 20), ("a", 1, 24, 30), ("a", 2, 39, 40), ("a", 3, 44, 50), ("a", 4, 54, 60), ("b", 0, 6, 9)]
    assert rows_of(table.rows, "path", "gap_idx", "start_ns", "end_ns") == want
    assert rows_of(table.rows.filter("path = 'a'"), "history") == [(i,) for i in range(5)]


@pytest.mark.parametrize("most", [4_000_000, 40])
def test_alarms_in_order_of_time(spark, tmp_path, most):
    rnd = random.Random(most)
    rows = [(p, t + 0.5, rnd.random() < 0.6) for p in "ab" for t in range(150)]
    by_slice = [[r for r in rows if r[1] // 50 == i] for i in (1, 0, 2)]
    for part in by_slice:
        rnd.shuffle(part)
    by_slice[2].append(("a", 3.25, True))                              # long after its time, but not behind the watermark
    stream = in_files(spark, str(tmp_path / "in"), by_slice, "path string, t double, is_degraded boolean")
    table = S.run_to_table(S.stream_alarm(stream, 3, ["path"], "100 seconds", most_rows=most), str(tmp_path / "alarm"))
    want = []
    for p in "ab":
        run = 0
        for _, t, low in sorted(r for part in by_slice for r in part if r[0] == p):
            run = run + 1 if low else 0
            if run == 3 and t <= 149.5 - 100:
                want.append((p, t))
    assert rows_of(table.rows, "path", "t") == sorted(want)
    # Released in one go: everything up to the last reading.
    again = S.run_to_table(S.stream_alarm(stream, 3, ["path"], "1 second", most_rows=most), str(tmp_path / "again"))
    assert rows_of(again.side("late"), "t")[:2] == [(0.5,), (0.5,)] and again.ledger().agg(F.sum("late")).first()[0] == 101


@pytest.mark.parametrize("job, name", [(lambda Q, spark: Q.busy_table(spark, SF_DIR, "user_id"), "events"),
                                       (lambda Q, spark: Q.one_path_busy(spark, SF_DIR), "slices"),
                                       (lambda Q, spark: Q.stream_late_ledger(spark, SF_DIR), "late-trace")])
def test_slices_are_written_by_all_tasks(spark, monkeypatch, job, name):
    """A slice of time is as many files as its rows have tasks, and still one micro-batch."""
    from idlespan.plans import adapter, q_streaming
    folders, read, new = {}, adapter.read_events, q_streaming.new_folder

    def noted(session, kind):
        return folders.setdefault(kind, new(session, kind))
    monkeypatch.setattr(adapter, "read_events", lambda session, sf: read(session, sf).repartition(3))
    monkeypatch.setattr(q_streaming, "new_folder", noted)
    job(q_streaming, spark)
    assert len(spark.read.text(folders[name]).inputFiles()) == 3 * q_streaming.SLICES
    busy = {"events": "busy", "slices": "one-busy", "late-trace": "late-busy"}[name]
    assert spark.read.option("recursiveFileLookup", True).parquet(f"{folders[busy]}/ledger").count() == q_streaming.SLICES
