"""Headline queries on the driver tables; prints one JSON line.

``*_98k`` jobs use one path per user, about 98 000 gaps at scale 0.1, the size nearest to the published
per-policy and evaluation timings.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

from pyspark import StorageLevel
from pyspark.sql import functions as F

from idlespan.operators import aggregates as G
from idlespan.operators import models as M
from idlespan.operators import policies as P
from idlespan.operators.labels import training_set
from idlespan.operators.windows import trailing_survival
from idlespan.plans import adapter as A
from idlespan.plans import catalog
from idlespan.plans.q_policies import EWMA_MARGIN, HIGH, LOW, PERIOD, D
from idlespan.plans.q_stats import late
from idlespan.plans.registry import PATH, timeline
from idlespan.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

NAMED = ["idle_windows", "merge_intervals_many_paths", "gaps_many_paths", "merge_intervals_split", "path_summary",
         "overlap_amount", "first_overlap", "feature_rows", "trailing_survival", "classification_metrics",
         "reliability_curve", "time_slice_metrics", "quantile_profile", "policy_metrics", "run_summary",
         "safe_windows", "degradation_report", "stream_gaps"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def policy_jobs(spark):
    """One policy over all gaps of the many-path layout, timeline included, as the published passes."""
    options = {"fixed_interval": {"key": PATH, "period": PERIOD}, "random": {"key": PATH},
               "threshold": {"low": LOW, "high": HIGH}, "oracle": {"durations": D},
               "ewma": {"key": PATH, "margin": EWMA_MARGIN, "durations": D}}

    def job(name):
        tl = timeline(spark, SF_DIR, "user_id")
        kw = dict(options[name], splits=tl.splits) if name == "ewma" else options[name]
        return G.policy_metrics(P.fit_outcomes(P.apply_policy(name, tl.gaps, **kw), D),
                                P.trace_window_ns(tl.gaps), key=PATH)
    return {f"policy_{name}_98k": (lambda n=name: drain(job(n))) for name in options}


def walk_forward(spark):
    """Every gap scored from its own past at eight horizons, then counted."""
    tl = timeline(spark, SF_DIR, "user_id")
    p = trailing_survival(tl.gaps, A.HORIZONS, PATH, splits=tl.splits)
    drain(G.classification_metrics(p.withColumn("label", (F.col("duration_ns") >= F.col("horizon_ns")).cast("int"))))


def model_jobs(spark, times: dict[str, float]) -> None:
    """Feature table, one 50-tree fit and the predictive policy with that model."""
    tl = timeline(spark, SF_DIR, "user_id")
    start = time.time()
    rows = training_set(tl.gaps, tl.busy, PATH, [A.HORIZONS[5]], causal=True, splits=tl.splits)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    rows.count()
    times["feature_table_98k"] = time.time() - start
    start = time.time()
    fitted = M.fit_survival(rows.filter(~late()), [A.HORIZONS[5]], params={"maxIter": 50})
    times["fit_500us_50_trees"] = time.time() - start
    start = time.time()
    p = M.score(rows, fitted, [A.HORIZONS[5]])
    runs = P.apply_policy("predictive", p, key=PATH, eta_bandwidth=0.8, eta_normal=0.7, durations=D)
    drain(G.policy_metrics(P.fit_outcomes(runs, D), P.trace_window_ns(tl.gaps), key=PATH))
    times["policy_predictive_98k"] = time.time() - start
    rows.unpersist()


def main() -> None:
    spark = build_session("idlespan-bench", CPUS, int(CPUS))
    spark.sparkContext.setLogLevel("ERROR")
    drain(catalog.QUERIES["idle_windows"](spark, SF_DIR))          # start the JVM and the code cache
    times: dict[str, float] = {}
    jobs = {name: (lambda n=name: drain(catalog.QUERIES[n](spark, SF_DIR))) for name in NAMED}
    jobs |= policy_jobs(spark)
    jobs["walk_forward_98k"] = lambda: walk_forward(spark)
    for name, job in jobs.items():
        start = time.time()
        job()
        times[name] = time.time() - start
    model_jobs(spark, times)
    times = {k: round(v, 3) for k, v in times.items()}
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(SF_DIR).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    sys.exit(main())
