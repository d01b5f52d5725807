"""Explicit schemas.  Nothing is inferred from data."""

from pyspark.sql.types import (DoubleType, IntegerType, LongType, StringType, StructField, StructType)


def _struct(**fields) -> StructType:
    return StructType([StructField(n, t()) for n, t in fields.items()])


LEGACY_TRACE = _struct(
    pid=LongType, tid=LongType, source=StringType, destination=StringType, size_mb=DoubleType,
    latency_us=DoubleType, bw_gbps=DoubleType, start_ns=LongType, end_ns=LongType, wall_start_ns=LongType,
    wall_end_ns=LongType)

EXTENDED_TRACE = _struct(
    pid=LongType, tid=LongType, src_dev=LongType, dst_dev=LongType, src_numa=IntegerType, dst_numa=IntegerType,
    size_mb=DoubleType, latency_us=DoubleType, bw_gbps=DoubleType, start_ns=LongType, end_ns=LongType,
    wall_start_ns=LongType, wall_end_ns=LongType, direction=IntegerType, async_flag=IntegerType,
    api_type=IntegerType, stream_id=LongType, path_id=IntegerType, link_bitmap=LongType,
    quality_flags=IntegerType)

# Normalised transfer, the input of every operator.
TRANSFERS = _struct(
    pid=LongType, tid=LongType, stream_id=LongType, src_dev=LongType, dst_dev=LongType, src_numa=IntegerType,
    dst_numa=IntegerType, start_ns=LongType, end_ns=LongType, wall_start_ns=LongType, wall_end_ns=LongType,
    size=LongType, direction=IntegerType, async_flag=IntegerType, api_type=IntegerType, path_id=IntegerType,
    link_bitmap=LongType, quality_flags=IntegerType)

BUSY_TEXT_WINDOWS = _struct(
    window_start_ns=LongType, window_end_ns=LongType, source=StringType, destination=StringType,
    bytes_mb=DoubleType, bandwidth_gbps=DoubleType, wall_start_ns=LongType, wall_end_ns=LongType,
    duration_ms=DoubleType, packet_count=LongType)

BUSY_WINDOWS = _struct(
    window_start_ns=LongType, window_end_ns=LongType, src_dev=LongType, dst_dev=LongType, src_numa=IntegerType,
    dst_numa=IntegerType, path_id=IntegerType, link_bitmap=LongType, bytes_mb=DoubleType, bw_gbps=DoubleType,
    wall_start_ns=LongType, wall_end_ns=LongType, duration_ms=DoubleType, packet_count=LongType,
    direction=IntegerType)

GAP_CSV = _struct(gap_start_ns=LongType, gap_end_ns=LongType, duration_us=DoubleType, path_id=IntegerType)

# fixed values: header spellings of the tracer, lower case, and the column they mean
HEADER_ALIASES = {
    "bandwidth_gbps": "bw_gbps", "wallstart_ns": "wall_start_ns", "wallend_ns": "wall_end_ns",
    "windowstart_ns": "window_start_ns", "windowend_ns": "window_end_ns",
    "windowstartwall_ns": "wall_start_ns", "windowendwall_ns": "wall_end_ns"}
