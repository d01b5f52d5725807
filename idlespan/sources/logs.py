"""Text logs: probe readings, CPU samples and key=value files.  Each line is parsed by built-in functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# fixed values: log line pattern (optional time, type, path, microseconds, GB/s)
PROBE_LINE = (r"^.*?(?:\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}(?:\.\d+)?)\]\s*)?"
              r"\[(\w+)\] Path (\d+): ([\d.]+)µs \(([\d.]+)GB/s\).*$")
MARK = "\u0001"


def parse_probe_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """``[time] [TYPE] Path n: x us (y GB/s)`` with an optional time; other lines are dropped.

    ``t`` is Unix seconds in the session time zone, null without a time.  The pattern runs once per line: its
    groups come out as one array, and the explode keeps later filters from repeating the match.
    """
    groups = F.split(F.regexp_replace(F.col(value), PROBE_LINE, MARK.join(f"${i}" for i in range(1, 6))), MARK)
    rest = [c for c in lines.columns if c != value]
    rows = lines.select(*rest, F.explode(F.array(groups)).alias("w")).filter(F.size("w") == 5)

    def part(i: int):
        return F.get("w", F.lit(i))
    return rows.select(
        *rest, (F.unix_micros(F.try_to_timestamp(F.nullif(part(0), F.lit("")))) / 1e6).alias("t"),
        part(1).alias("type"), part(2).try_cast("bigint").alias("path_id"),
        part(3).try_cast("double").alias("latency_us"), part(4).try_cast("double").alias("bandwidth_gbps")) \
        .filter(F.col("latency_us").isNotNull() & F.col("bandwidth_gbps").isNotNull())


def read_probe_log(spark: SparkSession, path: str) -> DataFrame:
    return parse_probe_lines(spark.read.text(path))


def parse_cpu_lines(lines: DataFrame, metric: str = "idle", value: str = "value") -> DataFrame:
    """``idle``: busy share (100 - %idle) of the all-CPU rows.  ``process``: %CPU of the watched process.

    Columns are taken from the right, where both tools keep them, so the time format does not matter.
    Header and average lines are dropped.
    """
    words = F.split(F.trim(F.col(value)), r"\s+")
    rows = lines.select(*[c for c in lines.columns if c != value], words.alias("w"))
    rows = rows.filter(F.lower(F.get("w", F.lit(0))) != "average:")
    if metric == "idle":
        kept = rows.filter(F.array_contains("w", "all"))
        out = (100.0 - F.element_at("w", -1).try_cast("double")).alias("busy_pct")
    elif metric == "process":
        kept = rows.filter(F.size("w") >= 9)
        out = F.element_at("w", -3).try_cast("double").alias("cpu_pct")
    else:
        raise ValueError(f"unknown metric {metric!r}")
    kept = kept.select(*[c for c in kept.columns if c != "w"], out)
    return kept.filter(F.col(kept.columns[-1]).isNotNull())


def read_cpu_log(spark: SparkSession, path: str, metric: str = "idle") -> DataFrame:
    return parse_cpu_lines(spark.read.text(path), metric)


def parse_key_values(lines: DataFrame, value: str = "value") -> DataFrame:
    pair = F.split(F.col(value), "=", 2)
    return (lines.filter(F.col(value).contains("="))
            .select(*[c for c in lines.columns if c != value], F.trim(F.get(pair, F.lit(0))).alias("key"),
                    F.trim(F.get(pair, F.lit(1))).alias("value")))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    return parse_key_values(spark.read.text(path))
