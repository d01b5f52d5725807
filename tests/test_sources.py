"""Readers, writers and column expressions."""

import pytest
from conftest import rows_of
from pyspark.sql import functions as F

from idlespan import constants as K
from idlespan import schemas
from idlespan.functions import columns as C
from idlespan.operators import aggregates as G
from idlespan.operators import ranking as R
from idlespan.sources import logs, tables, trace

LEGACY_HEAD = "PID,TID,Source,Destination,Size_MB,Latency_us,Bandwidth_GBps,Start_ns,End_ns,WallStart_ns,WallEnd_ns"
PLAIN_HEAD = "pid,tid,source,destination,size_mb,latency_us,bw_gbps,start_ns,end_ns,wall_start_ns,wall_end_ns"
LEGACY_ROWS = [
    "100,101,Host(NUMA 0),NPU 2,10.00,5000.00,2.10,1000000,6000000,1777455000000000000,1777455000005000000",
    "100,102,NPU 2,Host(NUMA 1),1.50,100.00,2.10,5000,105000.0,7,8",
    "100,103,Device ?,NPU 0,1.00,1.00,1.00,1,2,3,4"]
EXTENDED_HEAD = ",".join(schemas.EXTENDED_TRACE.names)


@pytest.fixture
def write(tmp_path):
    def put(name, *lines):
        (tmp_path / name).write_text("\n".join(lines) + "\n", encoding="utf-8")
        return str(tmp_path / name)
    return put


@pytest.mark.parametrize("head", [LEGACY_HEAD, PLAIN_HEAD])
def test_legacy_trace(spark, write, head):
    df = trace.read_trace(spark, write("t.csv", head, *LEGACY_ROWS))
    rows = {r.tid: r for r in df.collect()}
    assert df.schema.names == schemas.TRANSFERS.names
    a, b, c = rows[101], rows[102], rows[103]
    assert (a.src_dev, a.src_numa, a.dst_dev, a.dst_numa, a.direction) == (K.HOST_DEVICE, 0, 2, K.UNKNOWN_NUMA, K.H2D)
    assert (a.size, a.wall_start_ns, a.quality_flags) == (10 * K.MIB, 1777455000000000000, 0)
    assert (b.direction, b.end_ns, b.dst_numa, b.size) == (K.D2H, 105000, 1, int(1.5 * K.MIB))
    assert (c.src_dev, c.quality_flags, c.direction) == (K.UNKNOWN_DEVICE, K.FLAG_UNKNOWN_DEVICE, K.H2D)


def test_extended_trace_round_trip(spark, write, tmp_path):
    line = f"100,7,{K.HOST_DEVICE},0,0,255,10.00,100.00,100.00,5000,5100,5000,5100,1,1,1,3,9,6,{K.FLAG_SYNTHETIC}"
    df = trace.read_trace(spark, write("t.csv", EXTENDED_HEAD, line))
    r = df.first()
    assert (r.src_dev, r.async_flag, r.stream_id, r.link_bitmap, r.quality_flags) == (K.HOST_DEVICE, 1, 3, 6, 128)
    trace.write_trace_csv(df, str(tmp_path / "out"))
    back = trace.read_trace_extended(spark, str(tmp_path / "out"))
    assert back.drop("wall_end_ns").collect() == df.drop("wall_end_ns").collect()   # one wall time is written


def test_rejects(spark, write):
    path = write("t.csv", PLAIN_HEAD, LEGACY_ROWS[0], "x,1,NPU 0,NPU 1,1,1,1,1,2,3,4", ",,,,,,,,,,", " , ,,,,,,,,,",
                 "1,2,NPU 0,NPU 1,n/a,1,1,1,2,3,4", "1,2,NPU 0")
    good, bad = trace.split_rejects(trace.read_text_columns(spark, path))
    assert good.count() == 1
    assert sorted(r.raw.split(",")[0] for r in bad.collect()) == ["1", "1", "x"]


def test_format_detection():
    assert trace.detect_trace_format(LEGACY_HEAD.split(",")) == trace.LEGACY
    assert trace.detect_trace_format(EXTENDED_HEAD.upper().split(",")) == trace.EXTENDED
    assert trace.detect_trace_format(["size_mb", "bw_gbps", "start_ns", "end_ns"]) == trace.LEGACY
    with pytest.raises(ValueError):
        trace.detect_trace_format(["a", "b"])


def test_endpoints_and_directions(frame):
    cases = [("Host(NUMA 3)", K.HOST_DEVICE, 3), (" NPU 5 ", 5, 255), ("Host(NUMA x)", K.HOST_DEVICE, 255),
             ("NPU y", K.UNKNOWN_DEVICE, 255), ("Device ?", K.UNKNOWN_DEVICE, 255), ("?", K.UNKNOWN_DEVICE, 255)]
    df = frame([(c[0],) for c in cases], "e string").select("e", C.parse_endpoint("e").alias("p"))
    assert {r.e: (r.p.dev, r.p.numa) for r in df.collect()} == {e: (d, n) for e, d, n in cases}
    pairs = frame([("Host(NUMA 0)", "NPU 1", 1), ("NPU 1", "Host(NUMA 0)", 2), ("NPU 0", "NPU 1", 3),
                   ("Host(NUMA 0)", "Host(NUMA 1)", 0), ("?", "NPU 1", 1)], "s string, d string, want int")
    assert pairs.filter(C.infer_direction("s", "d") != F.col("want")).count() == 0
    labels = frame([(" h2d ", 1), ("D2D", 3), ("bad", None)], "t string, want int")
    assert labels.filter(~C.direction_from_label("t").eqNullSafe(F.col("want"))).count() == 0


def test_metrics_and_validation(frame):
    good = (1000, 3_000_000, 10 * K.MIB, 1, 0, K.FLAG_SYNTHETIC, K.HOST_DEVICE, 2)
    bad = (5000, 1000, 0, 7, 1, 0, 0xFFFFFFF3, K.UNKNOWN_DEVICE)
    df = frame([good, bad], "start_ns long, end_ns long, size long, direction int, async_flag int, quality_flags int, "
                            "src_dev long, dst_dev long")
    a, b = C.validate(C.with_transfer_metrics(df)).orderBy("start_ns").collect()
    assert a.latency_us == 2999.0 and a.size_mb == 10.0 and a.is_synthetic and not a.is_async and a.errors == []
    assert a.bw_gbps == pytest.approx(10 * K.MIB / 2_999_000)
    assert b.bw_gbps == 0.0 and len(b.errors) == 5
    flagged = C.flag_unknown_device(df).orderBy("start_ns").collect()
    assert [r.quality_flags for r in flagged] == [128, 2]


def test_probe_duration(frame):
    df = frame([(1, False, 2), (3, True, 2), (3, True, 1), (4, False, 1), (0, False, 2)], "k int, x boolean, d int")
    out = df.select(C.probe_duration("k", F.col("x"), F.col("d")).alias("n"))
    assert [r.n for r in out.collect()] == [50_000, int(5_100_000 * 1.24), int(5_100_000 * 2.31), 250_000, 50_000]


def test_confidence(frame):
    df = frame([(1,)], "x int")
    r = df.select(C.compose_confidence(*[F.lit(v) for v in (.95, .85, .90, .80)]).alias("c"),
                  C.data_confidence(F.lit(0.0), F.lit(0.0), F.lit(0.0)).alias("perfect"),
                  C.data_confidence(F.lit(0.5), F.lit(0.0), F.lit(0.0)).alias("drops"),
                  C.data_confidence(F.lit(9.0), F.lit(9.0), F.lit(9.0)).alias("worst"),
                  C.drift_confidence(F.lit(0.3)).alias("drift"), C.drift_confidence(F.lit(2.0)).alias("floor")).first()
    assert (r.c, r.perfect, r.drift, r.floor) == (0.80, 1.0, 0.7, 0.1)
    assert r.drops == pytest.approx(0.7) and r.worst == pytest.approx(0.0)
    kinds = frame([(.98,), (.97,), (.90,), (.89,)], "c double").select(C.allowed_probe(F.col("c")).alias("k"))
    assert [x.k for x in kinds.collect()] == [3, 2, 1, 0]


def test_probe_log(spark, write):
    path = write("p.log", "[2026-06-11 15:30:42.123] [BW] Path 39006: 6580.7µs (20.4GB/s)",
                 "[2026-06-11 15:30:43] [BW] Path 1: 5.0µs (2.5GB/s) tail", "[LAT] Path 61891: 33.8µs (0.1GB/s)",
                 "noise", "[BW] Path 1: 1.2.3µs (1GB/s)")
    rows = sorted(logs.read_probe_log(spark, path).collect(), key=lambda r: r.path_id)
    assert [(r.type, r.path_id, r.latency_us, r.bandwidth_gbps) for r in rows] == [
        ("BW", 1, 5.0, 2.5), ("BW", 39006, 6580.7, 20.4), ("LAT", 61891, 33.8, 0.1)]
    assert rows[1].t == pytest.approx(1781191842.123) and rows[2].t is None


def test_cpu_logs_and_key_values(spark, write):
    mp = write("mp.log", "Linux 4.19 (host) \t06/14/2026 \t_aarch64_\t(192 CPU)", "",
               "09:52:39 PM  CPU    %usr   %nice    %sys %iowait    %irq   %soft  %steal  %guest  %gnice   %idle",
               "09:52:41 PM  all    2.19    0.00    1.55    0.00    0.29    0.23    0.00    0.00    0.00   95.74",
               "Average:     all    0.30    0.00    0.40    0.00    0.10    0.10    0.00    0.00    0.00   98.93")
    assert [round(r.busy_pct, 2) for r in logs.read_cpu_log(spark, mp).collect()] == [4.26]
    ps = write("ps.log", "09:37:10 PM   UID       PID    %usr %system  %guest   %wait    %CPU   CPU  Command",
               "09:37:12 PM     0   1960295    0.00    0.00    0.00    0.00    1.50   172  python3",
               "Average:        0   1960295    0.00    0.00    0.00    0.00    0.40     -  python3")
    assert [r.cpu_pct for r in logs.read_cpu_log(spark, ps, "process").collect()] == [1.5]
    kv = write("m.txt", "ncpu=192", "train_cmd=a b=c", "plain")
    assert rows_of(logs.read_key_values(spark, kv), "key", "value") == [("ncpu", "192"), ("train_cmd", "a b=c")]


def test_busy_and_gap_tables(spark, frame, tmp_path):
    busy = frame([("a", 1_000_000, 3_000_000, 2 * K.MIB, 3)], "path string, start_ns long, end_ns long, bytes_total long, event_count long")
    tables.write_busy_csv(busy, str(tmp_path / "b"), ["path"])
    r = tables.read_busy_csv(spark, str(tmp_path / "b")).first()
    assert (r.bytes_mb, r.bw_gbps, r.duration_ms, r.packet_count, r.direction) == (2.0, 1.05, 2.0, 3, 1)
    gaps = frame([("a", 5, 1505, 1500)], "path string, start_ns long, end_ns long, duration_ns long")
    tables.write_gap_csv(gaps, str(tmp_path / "g"), ["path"])
    assert rows_of(tables.read_gap_csv(spark, str(tmp_path / "g")), "gap_start_ns", "gap_end_ns", "duration_us") == [(5, 1505, 1.5)]


def test_feature_table_prunes_by_pass(spark, frame, tmp_path):
    df = frame([(1, 10), (2, 20)], "pass int, x int")
    tables.write_features(df, str(tmp_path / "f"))
    assert rows_of(tables.read_features(spark, str(tmp_path / "f"), 2), "x") == [(20,)]
    tables.write_report_tables({"m": df}, str(tmp_path / "r"), "json")
    assert spark.read.json(str(tmp_path / "r/m")).count() == 2
    with pytest.raises(ValueError):
        tables.write_report_tables({"m": df}, str(tmp_path / "x"), "xml")


def test_feature_table_without_rows(spark, frame, tmp_path):
    df = frame([], "pass int, x int")
    tables.write_features(df, str(tmp_path / "f"))
    read = tables.read_features(spark, str(tmp_path / "f"), 2, schema=df.schema)
    assert sorted(read.columns) == ["pass", "x"] and read.count() == 0


def test_probe_cost_and_detection(frame):
    probes = frame([("LAT", 40.0, 0.1), ("BW", 6000.0, 20.0), ("BW", 8000.0, 10.0)], "type string, latency_us double, bandwidth_gbps double")
    c = G.probe_cost(probes, 100.0).first()
    assert (c.latency_probes, c.bandwidth_probes, c.avg_gbps, c.min_gbps, c.max_gbps) == (1, 2, 15.0, 10.0, 20.0)
    assert c.overhead_pct == pytest.approx(0.01404)
    readings = frame([(float(t), b) for t, b in enumerate([10.0, 10.0, 12.0, 6.0, 6.5, 11.0, 5.0, 12.0])], "t double, bandwidth_gbps double")
    base = G.baseline_median(readings, 3.0)
    assert base == 10.0
    r = G.degradation_report(G.flag_degraded(readings, base), 3.0, 5.0).first()
    assert (r.total, r.degraded, r.during_fault, r.hits) == (8, 3, 3, 2)
    assert r.recall == pytest.approx(2 / 3) and r.precision == pytest.approx(2 / 3)
    assert G.baseline_median(readings, None) == 10.0
    with pytest.raises(ValueError):
        G.baseline_median(readings, -1.0)


def test_smoothing_and_slices(frame):
    df = frame([(i, float(i)) for i in range(25)], "i int, v double")
    assert rows_of(R.smooth_by_n(df, ["i"], ["v"]), "block", "v", "n") == [(0, 4.5, 10), (1, 14.5, 10), (2, 22.0, 5)]
    assert R.first_k(df, 3, ["i"]).count() == 3
    assert R.first_fraction(df, 0.5, ["i"]).count() == 12
    assert rows_of(R.every_nth(df, 10, "i", 5), "i") == [(5,), (15,)]
