"""Column expressions over transfers, busy intervals and gaps.  All of them are built-in functions."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import constants as K


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


# --- text endpoints and directions -----------------------------------------

def parse_endpoint(endpoint: Column | str) -> Column:
    """``Host(NUMA n)`` and ``NPU n`` to struct(dev, numa); anything else is an unknown device."""
    text = F.trim(_col(endpoint))
    numa = F.try_to_number(F.regexp_extract(text, r"^Host\(NUMA (\d{1,9})\)?$", 1), F.lit("999999999"))
    npu = F.try_to_number(F.regexp_extract(text, r"^NPU\s+(\d{1,9})$", 1), F.lit("999999999"))
    host = text.startswith("Host(NUMA ")
    return F.struct(
        F.when(host, F.lit(K.HOST_DEVICE)).otherwise(F.coalesce(npu.cast("long"), F.lit(K.UNKNOWN_DEVICE)))
        .alias("dev"),
        F.when(host, F.coalesce(numa.cast("int"), F.lit(K.UNKNOWN_NUMA))).otherwise(F.lit(K.UNKNOWN_NUMA))
        .alias("numa"))


def infer_direction(source: Column | str, destination: Column | str) -> Column:
    src, dst = _col(source), _col(destination)
    return (F.when(src.startswith("NPU") & dst.startswith("Host"), K.D2H)
            .when(src.startswith("NPU") & dst.startswith("NPU"), K.D2D)
            .when(src.startswith("Host") & dst.startswith("Host"), K.H2H)
            .otherwise(K.H2D))


def direction_from_kind(kind: Column | str) -> Column:
    """Enum code of a copy kind; codes outside 0..3 count as host-to-device."""
    k = _col(kind)
    return F.when(k.isin(*K.DIRECTIONS), k.cast("int")).otherwise(K.H2D)


def direction_from_label(label: Column | str) -> Column:
    """Code of a label such as ``" h2d "``; null when unknown."""
    clean = F.upper(F.trim(_col(label)))
    out = F.lit(None).cast("int")
    for code, name in K.DIRECTIONS.items():
        out = F.when(clean == name, code).otherwise(out)
    return out


def direction_label(code: Column | str) -> Column:
    c = _col(code)
    out = F.lit("?")
    for value, name in K.DIRECTIONS.items():
        out = F.when(c == value, name).otherwise(out)
    return out


# --- derived metrics --------------------------------------------------------

def gbps(size: Column, duration_ns: Column) -> Column:
    """Bytes per nanosecond is GB/s; 0 for an empty duration."""
    return F.when(duration_ns > 0, size.cast("double") / duration_ns).otherwise(0.0)


def with_transfer_metrics(df: DataFrame) -> DataFrame:
    duration = F.col("end_ns") - F.col("start_ns")
    return df.withColumns({
        "latency_us": duration / 1000.0,
        "size_mb": F.col("size") / float(K.MIB),
        "bw_gbps": gbps(F.col("size"), duration),
        "is_async": F.col("async_flag") == 1,
        "is_synthetic": has_flag("quality_flags", K.FLAG_SYNTHETIC)})


def with_interval_metrics(df: DataFrame) -> DataFrame:
    duration = F.greatest(F.lit(0).cast("long"), F.col("end_ns") - F.col("start_ns"))
    return df.withColumns({"duration_ns": duration,
                           "bandwidth_gbps": gbps(F.col("bytes_total"), duration),
                           "size_mb": F.col("bytes_total") / float(K.MIB)})


def with_gap_duration(df: DataFrame) -> DataFrame:
    return df.withColumn("duration_ns",
                         F.greatest(F.lit(0).cast("long"), F.col("end_ns") - F.col("start_ns")))


# --- quality ----------------------------------------------------------------

def set_flag(flags: Column | str, bit: int, when: Column | None = None) -> Column:
    f = _col(flags)
    raised = f.bitwiseOR(F.lit(bit))
    return raised if when is None else F.when(when, raised).otherwise(f)


def has_flag(flags: Column | str, bit: int) -> Column:
    return _col(flags).bitwiseAND(F.lit(bit)) != 0


def flag_unknown_device(df: DataFrame) -> DataFrame:
    unknown = (F.col("src_dev") == K.UNKNOWN_DEVICE) | (F.col("dst_dev") == K.UNKNOWN_DEVICE)
    return df.withColumn("quality_flags", set_flag("quality_flags", K.FLAG_UNKNOWN_DEVICE, unknown))


def validation_errors() -> Column:
    """Array of broken rules; empty means valid."""
    def bad_device(name: str) -> Column:
        dev = F.col(name)
        return F.when((dev >= K.RESERVED_DEVICE_FLOOR) & (dev != K.HOST_DEVICE),
                      F.concat(F.lit(f"invalid {name}: "), dev.cast("string")))
    return F.array_compact(F.array(
        F.when(F.col("end_ns") < F.col("start_ns"), F.lit("end before start")),
        F.when(F.col("size") <= 0, F.lit("size <= 0")),
        F.when(~F.col("direction").isin(*K.DIRECTIONS),
               F.concat(F.lit("invalid direction: "), F.col("direction").cast("string"))),
        bad_device("src_dev"), bad_device("dst_dev")))


def validate(df: DataFrame) -> DataFrame:
    return df.withColumn("errors", validation_errors())


# --- path identity ----------------------------------------------------------

def with_path_key(df: DataFrame, name: str = "path_key") -> DataFrame:
    return df.withColumn(name, F.struct(*K.PATH_KEY))


def path_label(key: Sequence[str] = tuple(K.PATH_KEY)) -> Column:
    """16-bit label of the key.  Labels can collide, so nothing is ever grouped by one."""
    return F.pmod(F.xxhash64(*key), F.lit(65536)).cast("int")


def with_path_id(df: DataFrame, key: Sequence[str] = tuple(K.PATH_KEY)) -> DataFrame:
    return df.withColumn("path_id", path_label(key))


# --- filters ----------------------------------------------------------------

def min_size(df: DataFrame, size: int = K.MIB) -> DataFrame:
    return df.filter(F.col("size") >= size)


def drop_large_and_pids(df: DataFrame, max_mb: float = 100.0, pids: Iterable[int] = (),
                        min_pid: int | None = None) -> DataFrame:
    """Remove injected traffic: large copies and the named or late processes."""
    keep = F.col("size_mb") < max_mb
    pids = list(pids)
    if pids:
        keep &= ~F.col("pid").isin(*pids)
    if min_pid is not None:
        keep &= F.col("pid") < min_pid
    return df.filter(keep)


def real_vs_synthetic(df: DataFrame) -> DataFrame:
    synthetic = has_flag("quality_flags", K.FLAG_SYNTHETIC)
    return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(~synthetic).alias("real"),
                  F.count_if(synthetic).alias("synthetic"))


def fits(duration: Column | str, probe_ns: Column | int, margin_ns: int = 0) -> Column:
    return _col(duration) >= probe_ns + F.lit(margin_ns)


def time_slice(df: DataFrame, start=None, end=None, on: str = "start_ns") -> DataFrame:
    """Rows with ``start <= on <= end``; leave one side out for before / after."""
    if start is not None:
        df = df.filter(F.col(on) >= start)
    return df if end is None else df.filter(F.col(on) <= end)


def probe_duration(probe_type: Column | str, cross_numa: Column | bool = False,
                   direction: Column | int = K.D2H, durations: dict[int, int] | None = None,
                   scale: int = 1) -> Column:
    """Expected probe time.  ``durations`` is the table of classes, ``scale`` converts its unit."""
    durations = durations or K.PROBE_DURATIONS_NS
    kind = _col(probe_type)
    base = F.lit(durations.get(K.PROBE_TINY, 50_000) * scale).cast("long")
    for code, value in durations.items():
        base = F.when(kind == code, F.lit(value * scale).cast("long")).otherwise(base)
    if cross_numa is False:
        return base
    direction = F.lit(direction) if isinstance(direction, int) else direction
    factor = F.when(direction == K.D2H, K.CROSS_NUMA_D2H).otherwise(K.CROSS_NUMA_H2D)
    crossed = (base * factor).cast("long")
    return crossed if cross_numa is True else F.when(cross_numa, crossed).otherwise(base)


# --- confidence -------------------------------------------------------------

def data_confidence(drop_rate: Column, unknown_ratio: Column, async_ratio: Column) -> Column:
    loss = (F.least(F.lit(0.3), drop_rate * 3) + F.least(F.lit(0.2), unknown_ratio * 2)
            + F.least(F.lit(0.5), async_ratio))
    return F.greatest(F.lit(0.0), 1.0 - loss)


def drift_confidence(score: Column) -> Column:
    return F.greatest(F.lit(0.1), F.least(F.lit(1.0), 1.0 - score))


def compose_confidence(model: Column, calibrated: Column, data: Column, drift: Column) -> Column:
    return F.least(model, calibrated, data, drift)


def allowed_probe(confidence: Column) -> Column:
    return (F.when(confidence >= K.ETA_BANDWIDTH, K.PROBE_BANDWIDTH)
            .when(confidence >= K.ETA_NORMAL, K.PROBE_NORMAL)
            .when(confidence >= K.ETA_TINY, K.PROBE_TINY).otherwise(K.PROBE_NONE))


def ratio(top: Column, bottom: Column, empty: float | None = 0.0) -> Column:
    """``top / bottom`` with a chosen value for an empty denominator."""
    return F.when(bottom != 0, top / bottom).otherwise(F.lit(empty).cast("double"))


def fixed_text(value: Column | str, places: int = 2) -> Column:
    """Number as text with a fixed number of decimals."""
    return F.format_string(f"%.{places}f", _col(value).cast("double"))


# --- column lists -----------------------------------------------------------

def feature_names() -> list[str]:
    return list(K.FEATURE_NAMES)


def feature_subset(*groups: str) -> list[str]:
    return [name for g in groups for name in K.FEATURE_GROUPS[g]]


def feature_complement(*groups: str) -> list[str]:
    dropped = set(feature_subset(*groups))
    return [name for name in K.FEATURE_NAMES if name not in dropped]
