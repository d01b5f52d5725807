"""Trace files: two CSV layouts, told apart by their header, and one normalised frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from .. import constants as K
from .. import schemas
from ..functions.columns import fixed_text, flag_unknown_device, infer_direction, parse_endpoint, with_transfer_metrics

LEGACY, EXTENDED = "legacy", "extended"
# fixed values: columns that a row must parse to be kept
BASE_NUMBERS = ["pid", "tid", "size_mb", "start_ns", "end_ns", "wall_start_ns", "wall_end_ns"]
EXTENDED_NUMBERS = ["src_dev", "dst_dev", "src_numa", "dst_numa", "direction", "async_flag", "api_type",
                    "stream_id", "path_id", "link_bitmap", "quality_flags"]


def canonical_name(header: str) -> str:
    name = header.strip().lower()
    return schemas.HEADER_ALIASES.get(name, name)


def detect_trace_format(columns: Sequence[str]) -> str:
    """Layout from header names alone; raises when neither fits."""
    raw = {c.strip().lower() for c in columns}
    measured = "size_mb" in raw and bool(raw & {"bw_gbps", "bandwidth_gbps"})
    if measured and "quality_flags" in raw:
        return EXTENDED
    if {"source", "destination"} <= raw or (measured and {"start_ns", "end_ns"} <= raw):
        return LEGACY
    raise ValueError(f"unknown trace layout: {list(columns)[:5]}")


def read_text_columns(spark: SparkSession, path: str) -> DataFrame:
    """CSV with a header, every column a string under its canonical name.

    Only the header is read here: strings let a bad number become a reject instead of a failed job.
    """
    df = spark.read.option("header", True).option("enforceSchema", False).csv(path)
    return df.toDF(*[canonical_name(c) for c in df.columns])


def _number(name: str, kind: str) -> Column:
    """Counts and times may be written as ``12`` or ``12.0``; the integer form keeps all 64 bits."""
    text = F.trim(F.col(name))
    if kind == "double":
        return text.try_cast("double")
    return F.coalesce(text.try_cast("bigint"), text.try_cast("double").try_cast("bigint")).try_cast(kind)


def _typed(df: DataFrame, layout: str) -> DataFrame:
    schema = schemas.EXTENDED_TRACE if layout == EXTENDED else schemas.LEGACY_TRACE
    kinds = {f.name: f.dataType.simpleString() for f in schema}
    out = []
    for name, kind in kinds.items():
        if name not in df.columns:
            out.append(F.lit("?" if kind == "string" else None).cast(kind).alias(name))
        elif kind == "string":
            out.append(F.coalesce(F.col(name), F.lit("?")).alias(name))
        else:
            out.append(_number(name, kind).alias(name))
    return df.select(*out, F.concat_ws(",", *df.columns).alias("_raw"))


def split_rejects(df: DataFrame, layout: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Typed good rows, and the text of rows whose numbers do not parse.  Blank rows are in neither."""
    layout = layout or detect_trace_format(df.columns)
    typed = _typed(df, layout)
    needed = [c for c in BASE_NUMBERS if c in df.columns]
    if layout == EXTENDED:
        needed += [c for c in EXTENDED_NUMBERS if c in df.columns]
    good = F.lit(True)
    for c in needed:
        good = good & F.col(c).isNotNull()
    blank = F.length(F.regexp_replace("_raw", r"[,\s]", "")) == 0
    return typed.filter(good).drop("_raw"), typed.filter(~good & ~blank).select(F.col("_raw").alias("raw"))


def normalise(df: DataFrame, layout: str) -> DataFrame:
    """Typed rows of either layout to the transfer schema.  ``size_mb`` is MiB in both."""
    size = (F.col("size_mb") * K.MIB).cast("long")
    if layout == EXTENDED:
        full = df.withColumn("size", size)
    else:
        full = df.withColumns({
            "size": size, "_s": parse_endpoint("source"), "_d": parse_endpoint("destination"),
            "direction": infer_direction("source", "destination"), "async_flag": F.lit(0), "api_type": F.lit(0),
            "stream_id": F.lit(0), "path_id": F.lit(0), "link_bitmap": F.lit(0), "quality_flags": F.lit(0)})
        full = full.withColumns({"src_dev": F.col("_s.dev"), "dst_dev": F.col("_d.dev"),
                                 "src_numa": F.col("_s.numa"), "dst_numa": F.col("_d.numa")})
        full = flag_unknown_device(full)
    zero_when_absent = {"stream_id", "path_id", "link_bitmap", "quality_flags", "async_flag", "api_type"}
    return full.select(*[
        (F.coalesce(F.col(f.name), F.lit(0)) if f.name in zero_when_absent else F.col(f.name))
        .cast(f.dataType).alias(f.name) for f in schemas.TRANSFERS])


def _read(spark: SparkSession, path: str, layout: str) -> DataFrame:
    good, _ = split_rejects(read_text_columns(spark, path), layout)
    return normalise(good, layout)


def read_trace_legacy(spark: SparkSession, path: str) -> DataFrame:
    """11 columns with text endpoints."""
    return _read(spark, path, LEGACY)


def read_trace_extended(spark: SparkSession, path: str) -> DataFrame:
    """20 numeric columns."""
    return _read(spark, path, EXTENDED)


def read_trace(spark: SparkSession, path: str) -> DataFrame:
    """Either layout.  The rows come in no order: no operator needs one."""
    raw = read_text_columns(spark, path)
    layout = detect_trace_format(raw.columns)
    return normalise(split_rejects(raw, layout)[0], layout)


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    return split_rejects(read_text_columns(spark, path))[1]


def trace_csv_rows(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Extended layout with two-decimal size, latency and bandwidth, as text columns ready to write, and the columns ``keep``."""
    m = with_transfer_metrics(df)
    two = {c: fixed_text(c).alias(c) for c in ("size_mb", "latency_us", "bw_gbps")}
    start = F.col("wall_start_ns")
    return m.select(*[two.get(f.name, start.alias(f.name) if f.name == "wall_end_ns" else F.col(f.name))
                      for f in schemas.EXTENDED_TRACE], *keep)


def write_trace_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    trace_csv_rows(df).write.mode(mode).option("header", True).csv(path)


def text_schema(layout: str = EXTENDED) -> StructType:
    """All-string schema of a layout, for streams, where a header cannot be looked up."""
    schema = schemas.EXTENDED_TRACE if layout == EXTENDED else schemas.LEGACY_TRACE
    return StructType([StructField(f.name, StringType()) for f in schema])
