"""Fixed values of the data model, stated plainly.  They must equal the published ones for right results."""

# --- fixed values: devices -------------------------------------------------
HOST_DEVICE = 0xFFFFFFFF
UNKNOWN_DEVICE = 0xFFFFFFFE
RESERVED_DEVICE_FLOOR = 0xFFFFFFF0
UNKNOWN_NUMA = 0xFF
MIB = 1024 * 1024

# --- fixed values: enumerations -------------------------------------------
DIRECTIONS = {0: "H2H", 1: "H2D", 2: "D2H", 3: "D2D"}
H2H, H2D, D2H, D2D = 0, 1, 2, 3

FLAG_UNKNOWN_PATH = 1
FLAG_UNKNOWN_DEVICE = 2
FLAG_ASYNC_UNCERTAINTY = 4
FLAG_TIMESTAMP_JITTER = 8
FLAG_ADDRESS_UNMAPPED = 16
FLAG_RING_DROP = 32
FLAG_MERGED_GAP = 64
FLAG_SYNTHETIC = 128

PROBE_NONE, PROBE_TINY, PROBE_NORMAL, PROBE_BANDWIDTH, PROBE_CONFIRMATION = 0, 1, 2, 3, 4

REASON_SAFE, REASON_LOW_CONFIDENCE = 0, 1

# --- fixed values: probe classes (ns) and cross-node factors ---------------
PROBE_DURATIONS_NS = {PROBE_TINY: 50_000, PROBE_NORMAL: 500_000,
                      PROBE_BANDWIDTH: 5_100_000, PROBE_CONFIRMATION: 250_000}
CROSS_NUMA_D2H = 1.24
CROSS_NUMA_H2D = 2.31
MIN_PROBE_NS = 50_000
SAFETY_MARGIN_NS = 100_000

# --- fixed values: prediction horizons (ns) and confidence limits ----------
HORIZONS_NS = (10_000, 25_000, 50_000, 100_000, 250_000, 500_000, 1_000_000, 2_000_000)
ETA_BANDWIDTH, ETA_NORMAL, ETA_TINY = 0.98, 0.95, 0.90

# --- fixed values: column sets ---------------------------------------------
PATH_KEY = ["src_dev", "dst_dev", "direction", "src_numa", "dst_numa"]

GAP_FEATURES = ["f_gap_p10", "f_gap_p50", "f_gap_p90", "f_gap_mean", "f_gap_std", "f_gap_last",
                "f_gap_last5_mean"]
BURST_FEATURES = ["f_burst_p50", "f_burst_p90", "f_burst_mean", "f_burst_rate", "f_burst_last_duration"]
FEATURE_GROUPS = {
    "gap": GAP_FEATURES,
    "burst": BURST_FEATURES,
    "idle": ["f_idle_age_ns"],
    "path": ["f_path_id_norm", "f_direction_code", "f_cross_numa_flag"],
    "stream": ["f_stream_id_norm", "f_stream_pending", "f_time_since_last_sync"],
    "phase": ["f_phase_id", "f_sync_before_flag"],
    "resource": ["f_cpu_usage_pct", "f_npu_util_pct", "f_ebpf_event_rate"],
    "quality": ["f_drop_rate", "f_unknown_path_ratio", "f_async_uncertainty", "f_timestamp_jitter"],
    "time": ["f_hour_of_day", "f_workload_runtime"],
}
FEATURE_NAMES = [name for names in FEATURE_GROUPS.values() for name in names]
