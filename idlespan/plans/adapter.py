"""Transfers derived from an ``events`` table: each event is busy for ``value`` seconds from ``ts``.

Times are nanoseconds.  The table moves in seconds where a copy trace moves in microseconds, so a constant
of n ns stands for n * SCALE here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K

SCALE = 1_000_000
MARGIN = K.SAFETY_MARGIN_NS * SCALE
MIN_PROBE = K.MIN_PROBE_NS * SCALE
TOLERANCE = MIN_PROBE + MARGIN
HORIZONS = tuple(h * SCALE for h in K.HORIZONS_NS)
DURATIONS = {code: ns * SCALE for code, ns in K.PROBE_DURATIONS_NS.items()}
PASS_CUT = "2024-01-16 00:00:00"
DIRECTION_OF = {"click": K.H2D, "view": K.D2H, "purchase": K.D2D, "error": K.H2H}


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def as_transfers(events: DataFrame, path: str = "event_type") -> DataFrame:
    """Event rows to transfer rows, as plain columns, so it also works on a stream."""
    start_us = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    direction = F.lit(K.H2D)
    for label, code in DIRECTION_OF.items():
        direction = F.when(F.col("event_type") == label, code).otherwise(direction)
    return events.select(
        "event_id", "user_id", "event_type", F.col(path).cast("string").alias("path"),
        F.col("ts").cast("timestamp").alias("ts"),
        (start_us * 1000).alias("start_ns"),
        (start_us * 1000 + F.round(F.col("value") * 1e6).cast("long") * 1000).alias("end_ns"),
        ((k + 1) * K.MIB).alias("size"), direction.alias("direction"), k.alias("k"),
        F.when(F.col("ts") < F.lit(PASS_CUT).cast("timestamp_ntz"), 1).otherwise(2).alias("pass"))


def transfers(spark: SparkSession, sf_dir: str, path: str = "event_type") -> DataFrame:
    return as_transfers(read_events(spark, sf_dir), path)
