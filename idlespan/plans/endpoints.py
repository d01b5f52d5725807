"""Transfers with text endpoints and the full path key, derived from the events table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import flag_unknown_device, parse_endpoint
from . import adapter as A


def with_endpoints(t: DataFrame) -> DataFrame:
    def host(n):
        return F.concat(F.lit("Host(NUMA "), (n % 4).cast("string"), F.lit(")"))

    def npu(n):
        return F.concat(F.lit("NPU "), (n % 8).cast("string"))
    kind, user = F.col("event_type"), F.col("user_id")
    source = (F.when(kind.isin("click", "error"), host(user)).when(kind.isin("view", "purchase"), npu(user))
              .otherwise("Device ?"))
    destination = (F.when(kind == "view", host(user)).when(kind == "purchase", npu(user + 1))
                   .when(kind == "error", host(user + 1)).otherwise(npu(user)))
    return t.withColumns({"source": source, "destination": destination,
                          "wall_start_ns": F.col("start_ns"), "wall_end_ns": F.col("end_ns")})


def traced(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = with_endpoints(A.transfers(spark, sf_dir)).withColumns({
        "_s": parse_endpoint("source"), "_d": parse_endpoint("destination"), "quality_flags": F.lit(0),
        "async_flag": (F.col("k") % 2).cast("int"), "pid": F.col("user_id"), "tid": F.col("user_id")})
    t = t.withColumns({"src_dev": F.col("_s.dev"), "dst_dev": F.col("_d.dev"), "src_numa": F.col("_s.numa"),
                       "dst_numa": F.col("_d.numa")}).drop("_s", "_d")
    return flag_unknown_device(t)
