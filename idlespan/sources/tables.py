"""Busy-window, gap, feature and report tables in CSV, JSON and Parquet."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .. import constants as K
from .. import schemas
from ..functions.columns import fixed_text, path_label, with_interval_metrics
from .trace import _number, canonical_name

KEY = tuple(K.PATH_KEY)


def read_busy_csv(spark: SparkSession, path: str) -> DataFrame:
    """Aggregated windows, 10 columns with text endpoints or 15 numeric ones, by their header."""
    df = spark.read.option("header", True).csv(path)
    names = [canonical_name(c) for c in df.columns]
    text = "source" in names
    schema = schemas.BUSY_TEXT_WINDOWS if text else schemas.BUSY_WINDOWS
    alias = {"bw_gbps": "bandwidth_gbps"} if text else {}
    df = df.toDF(*[alias.get(n, n) for n in names])
    return df.select(*[(F.col(f.name) if f.dataType.simpleString() == "string"
                        else _number(f.name, f.dataType.simpleString())).alias(f.name) for f in schema])


def busy_csv_rows(busy: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    """15-column windows: MiB, GB/s, ms and count per busy interval; wall time equals interval time."""
    m = with_interval_metrics(busy)

    def given(name: str, default: int) -> Column:
        return F.col(name) if name in busy.columns else F.lit(default)
    start, end = F.col("start_ns"), F.col("end_ns")
    values = {
        "window_start_ns": start, "window_end_ns": end, "path_id": path_label(key),
        "link_bitmap": given("link_bitmap", 0), "bytes_mb": fixed_text(F.col("size_mb"), 2),
        "bw_gbps": fixed_text(F.col("bandwidth_gbps"), 2), "wall_start_ns": start, "wall_end_ns": end,
        "duration_ms": fixed_text(F.col("duration_ns") / 1e6, 3), "packet_count": F.col("event_count"),
        "direction": given("direction", K.H2D), "src_dev": given("src_dev", 0), "dst_dev": given("dst_dev", 0),
        "src_numa": given("src_numa", 0), "dst_numa": given("dst_numa", 0)}
    return m.select(*[values[f.name].alias(f.name) for f in schemas.BUSY_WINDOWS])


def gap_csv_rows(gaps: DataFrame, key: Sequence[str] = KEY) -> DataFrame:
    return gaps.select(F.col("start_ns").alias("gap_start_ns"), F.col("end_ns").alias("gap_end_ns"),
                       fixed_text(F.col("duration_ns") / 1000.0, 2).alias("duration_us"),
                       path_label(key).alias("path_id"))


def write_busy_csv(busy: DataFrame, path: str, key: Sequence[str] = KEY, mode: str = "error") -> None:
    busy_csv_rows(busy, key).write.mode(mode).option("header", True).csv(path)


def write_gap_csv(gaps: DataFrame, path: str, key: Sequence[str] = KEY, mode: str = "error") -> None:
    gap_csv_rows(gaps, key).write.mode(mode).option("header", True).csv(path)


def read_gap_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.GAP_CSV).option("header", True).csv(path)


def write_features(df: DataFrame, path: str, mode: str = "error", by: str = "pass") -> None:
    """Feature table with one directory per pass, so reading one pass prunes the other."""
    df.write.mode(mode).partitionBy(by).parquet(path)


def read_features(spark: SparkSession, path: str, only: object = None, by: str = "pass", schema: StructType | None = None) -> DataFrame:
    """The table, or one pass of it.  A table without rows has no file to take its columns from: give its ``schema`` where it may be empty."""
    df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    return df if only is None else df.filter(F.col(by) == only)


def write_report_tables(tables: dict[str, DataFrame], path: str, fmt: str = "json", mode: str = "error") -> None:
    """Named metric tables, each below its own directory."""
    for name, df in tables.items():
        writer = df.write.mode(mode)
        if fmt == "csv":
            writer.option("header", True).csv(f"{path}/{name}")
        elif fmt == "json":
            writer.json(f"{path}/{name}")
        else:
            raise ValueError(f"unknown format {fmt!r}")
