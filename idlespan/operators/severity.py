"""Probe triggers and fault severity, as table jobs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scale import AUTO, resolve, running
from .chains import with_spacing
from .intervals import look_up


def trigger_windows(busy: DataFrame, low_mbps: float = 800, high_mbps: float = 26_000,
                    bandwidth: str = "bandwidth_gbps") -> DataFrame:
    """Busy windows whose throughput lies in the abnormal range."""
    mbps = F.col(bandwidth) * 1000
    return busy.filter((mbps >= low_mbps) & (mbps <= high_mbps))


def cooldown(triggers: DataFrame, period_ns: int = 3_000_000_000, key: Sequence[str] = (),
             at: str = "start_ns", minimum: bool = False) -> DataFrame:
    """At most one trigger per period: the first of each, or with ``minimum=True`` at least a period apart."""
    names = triggers.columns
    if minimum:
        return with_spacing(triggers, period_ns, key, at).filter("chosen").drop("chosen")
    return (triggers.withColumn("_b", F.floor(F.col(at) / period_ns)).groupBy(*key, "_b")
            .agg(F.min_by(F.struct(*names), F.struct(at, *[c for c in ("path", "end_ns") if c in names])).alias("r"))
            .select("r.*"))


def match_probe_window(probes: DataFrame, busy: DataFrame, key: Sequence[str], baseline_gbps: float = 25.0,
                       splits=AUTO) -> DataFrame:
    """The busy window that is open when a probe starts, and their joint throughput against the baseline."""
    key = list(key)
    splits = resolve(splits, busy, "start_ns", key)
    known = busy.select(*key, "start_ns", "end_ns", "bandwidth_gbps")
    opened = known.select(*key, F.col("start_ns").alias("b0"), F.col("bandwidth_gbps").alias("window_gbps"))
    found = look_up(probes, known, key, [("start_ns", 0)], [("start_ns", 0)], splits, lambda frame: running(
        frame, key, ["t", "rank"], {"_w": ("last", F.when(F.col("rank") == 0, F.struct("b0", "b1")))},
        splits=splits), ["_w"])
    hit = found.filter(F.col("_w.b1") > F.col("t")).select(
        *key, "probe", F.col("_w.b0").alias("b0"), F.col("_w.b1").alias("window_end_ns"))
    joined = hit.join(opened, [*key, "b0"])
    merged = F.col("window_gbps") + F.col("probe.probe_gbps")
    return joined.select("probe.*", F.col("b0").alias("window_start_ns"), "window_end_ns", "window_gbps",
                         merged.alias("merged_gbps"), (merged / baseline_gbps).alias("throughput_ratio"))


def severity(links: DataFrame, low_gbps: float, high_latency_us: float, long_s: float, frequent: float,
             widespread: float, throughput_drop: str = "throughput_drop") -> DataFrame:
    """P0: slow or late, and long, frequent or widespread.  P1: slow or late only.  P2: only the job slowed.

    The last two classes follow the published order: P2 needs none of the five link signs.
    """
    slow = (F.col("bandwidth_gbps") < low_gbps) | (F.col("latency_us") > high_latency_us)
    spread = ((F.col("abnormal_s") > long_s) | (F.col("abnormal_ratio") > frequent)
              | (F.col("link_ratio") > widespread))
    return links.withColumn("severity", F.when(slow & spread, "P0").when(slow, "P1")
                            .when(~spread & F.col(throughput_drop), "P2").otherwise("none"))


def link_signs(readings: DataFrame, slow: Column, key: Sequence[str], at: str = "t",
               bandwidth: str = "bandwidth_gbps", latency: str = "latency_us") -> DataFrame:
    """Per link: mean bandwidth and latency, how long and how often it was abnormal, and which share of all
    links ever was."""
    links = readings.groupBy(*key).agg(
        F.avg(bandwidth).alias("bandwidth_gbps"), F.avg(latency).alias("latency_us"),
        F.coalesce(F.max(F.when(slow, F.col(at))) - F.min(F.when(slow, F.col(at))), F.lit(0.0)).alias("abnormal_s"),
        F.avg(slow.cast("double")).alias("abnormal_ratio"))
    share = links.agg(F.avg((F.col("abnormal_ratio") > 0).cast("double")).alias("s")).scalar()
    return links.withColumn("link_ratio", share)
