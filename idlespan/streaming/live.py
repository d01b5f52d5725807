"""The live loop as Structured Streaming: tail the trace, close busy intervals, emit gaps, decide, limit, count.

Order of stages and what each keeps between micro-batches:

    stream_transfers   nothing
    stream_busy        intervals that can still grow (table)
    stream_gaps        per path: end of the last interval, last gap lengths, EWMA, count (table)
    stream_rate_limit  per time window: its first probes so far
    stream_counts      per time window: totals
    stream_alarm       readings ahead of the watermark; per path: length of the running streak (tables)

Stages meet in append-only tables.  The three with table state are ``stages.Stage``: each micro-batch is a batch job of the library's own operators,
so one path may hold all of its rows.  They count what comes too late and keep it.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .. import constants as K
from ..functions.columns import gbps
from ..operators.intervals import extract_gaps, merge_intervals
from ..operators.policies import largest_fit
from ..operators.sliding import sliding_quantiles
from ..operators.windows import ewma
from ..scale import TARGET_ROWS, attach, numbered, plan_splits, running
from ..session import cut
from ..sources.trace import EXTENDED, normalise, split_rejects, text_schema
from .stages import Micro, Stage, State, StreamTable, current, delay_us, fields, run_stage  # noqa: F401

KEY = tuple(K.PATH_KEY)
TRAIL = 100


def event_time(ns: str = "start_ns"):
    """Event time for watermarks; it holds microseconds, so comparisons stay on the long column."""
    return F.timestamp_micros(F.floor(F.col(ns) / 1000).cast("long"))


def stream_trace(spark: SparkSession, directory: str, layout: str = EXTENDED,
                 max_files: int | None = None) -> DataFrame:
    """Tail a directory of trace CSV files as text columns."""
    reader = spark.readStream.schema(text_schema(layout)).option("header", True)
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.csv(directory)


def stream_transfers(spark: SparkSession, directory: str, layout: str = EXTENDED,
                     max_files: int | None = None) -> DataFrame:
    good, _ = split_rejects(stream_trace(spark, directory, layout, max_files), layout)
    return normalise(good, layout).withColumn("ts", event_time())


def stream_rejects(spark: SparkSession, directory: str, layout: str = EXTENDED, max_files: int | None = None) -> DataFrame:
    """The rows that ``stream_transfers`` leaves out because a number does not parse, as text.  Good rows and rejects add up to the
    rows that are not blank."""
    return split_rejects(stream_trace(spark, directory, layout, max_files), layout)[1]


def _hold_us(tolerance_us: int):
    """When an interval can no longer touch a later one, in microseconds."""
    return F.ceil(F.col("end_ns") / 1000).cast("long") + max(tolerance_us, 1)


def stream_busy(df: DataFrame, key: Sequence[str] = KEY, tolerance_us: int = 150, delay: str = "10 seconds",
                size: str = "size", layout: str | None = None, most_rows: int = TARGET_ROWS) -> Stage:
    """Closed busy intervals of a transfer stream with ``start_ns``, ``end_ns``; of raw trace text if its ``layout`` is given.

    A micro-batch merges its transfers with the intervals still open, by the batch operator; what the watermark has passed by the tolerance is
    closed.  A transfer that ended so long ago when it came is late: it goes to the stage's ``late`` table.  Transfers of negative length
    are good rows that make no interval.  Every row of a micro-batch is good, late or rejected, and the ledger counts them.  A path with over
    ``most_rows`` rows in a micro-batch is merged in segments of time.
    """
    key = list(key)
    names = [*key, "start_ns", "end_ns"]
    if layout is None:
        df = sample = df.select(*names, size)
    else:
        sample = normalise(split_rejects(df, layout)[0], layout)
    opened = fields(sample, key) + ", start_ns long, end_ns long, bytes long, events long"

    def parse(text: DataFrame) -> tuple[DataFrame, DataFrame]:
        good, rejects = split_rejects(text, layout)
        return normalise(good, layout), rejects

    def step(m: Micro) -> dict[str, DataFrame]:
        gone = F.lit(False) if m.before is None else F.coalesce(_hold_us(tolerance_us) <= m.before, F.lit(False))
        new = m.rows.filter(~gone & (F.col("end_ns") >= F.col("start_ns"))).select(
            *names, F.col(size).cast("long").alias("bytes"), F.lit(1).cast("long").alias("events"))
        both = new.unionByName(m.state["open"])
        merged = cut(merge_intervals(both, key, tolerance=tolerance_us * 1000, size="bytes", extra=[("events", "sum", "events")],
                                     splits=plan_splits(both, "start_ns", key, most_rows)))
        closed = F.lit(False) if m.now is None else _hold_us(tolerance_us) <= m.now
        return {"out": merged.filter(closed).select(*names, "bytes_total", F.col("events").alias("event_count"),
                                                    gbps(F.col("bytes_total"), F.col("end_ns") - F.col("start_ns")).alias("bandwidth_gbps")),
                "open": merged.filter(~closed).select(*names, F.col("bytes_total").alias("bytes"), "events"),
                "late": m.rows.filter(gone)}
    out = fields(sample, key) + ", start_ns long, end_ns long, bytes_total long, event_count long, bandwidth_gbps double"
    event = F.floor(F.col("start_ns") / 1000).cast("long")
    return Stage(df, step, out, {"open": State(opened)}, event, delay_us(delay), 1000, None if layout is None else parse)


def stream_gaps(busy: DataFrame, key: Sequence[str] = KEY, alpha: float = 0.1, bound_q: float = 0.05, bound_min: int = 20,
                min_samples: int = 10, most_rows: int = TARGET_ROWS) -> Stage:
    """One row per gap when the next busy interval closes, with what was known before it.

    ``history``, ``ewma``, ``trailing_p10`` and ``g_lower_bound`` describe the gaps before this one.  State per path is one row: the last end, the
    number of gaps, their mean and the last 100 lengths, which the batch operators see as rows before the new ones.  An interval that
    ends behind the last end seen before its micro-batch adds nothing and goes to the ``late`` table; one that only starts there counts from it.
    """
    key = list(key)
    kept = fields(busy, key) + ", last_end long, gaps long, smooth double, recent array<long>"

    def step(m: Micro) -> dict[str, DataFrame]:
        splits = plan_splits(m.rows, "start_ns", key, most_rows)
        known = attach(m.rows.select(*key, "start_ns", "end_ns"), m.state["paths"].select(*key, "last_end"), key, splits)
        known = cut(known.withColumn("late", F.coalesce(F.col("end_ns") <= F.col("last_end"), F.lit(False))))
        fresh = known.filter("not late").select(*key, F.greatest("start_ns", "last_end").alias("start_ns"), "end_ns")
        met = cut(m.state["paths"].join(known.select(*key).distinct(), key, "left_semi"))
        seeds = met.select(*key, F.col("last_end").alias("start_ns"), F.col("last_end").alias("end_ns"))
        gaps = extract_gaps(fresh.unionByName(seeds), key, splits)
        gaps = attach(gaps, met.select(*key, F.col("gaps").alias("_gaps")), key, splits) \
            .withColumn("gap_idx", F.col("gap_idx") + F.coalesce("_gaps", F.lit(0))).drop("_gaps")
        gaps = cut(gaps.select(*key, "gap_idx", "start_ns", "end_ns", F.col("duration_ns").cast("long").alias("duration_ns")))
        old = met.filter("gaps > 0")
        first = old.select(*key, F.lit(0).cast("long").alias("gap_idx"), F.col("smooth").alias("value"), F.lit(None).cast("long").alias("own"))
        # EWMA goes on from its last value as if that were the first gap.
        offset = attach(gaps, old.select(*key, F.col("gaps").alias("_gaps")), key, splits)
        since = offset.select(*key, F.when(F.col("_gaps").isNull(), F.col("gap_idx")).otherwise(F.col("gap_idx") - F.col("_gaps") + 1).alias("gap_idx"),
                              F.col("duration_ns").cast("double").alias("value"), F.col("gap_idx").alias("own"))
        smooth = ewma(first.unionByName(since), key, alpha, "value")
        after = smooth.filter("own is not null").select(*key, F.col("own").alias("gap_idx"), F.col("ewma").alias("_after"))
        before = after.select(*key, (F.col("gap_idx") + 1).alias("gap_idx"), F.col("_after").alias("ewma")).unionByName(
            old.select(*key, F.col("gaps").alias("gap_idx"), F.col("smooth").alias("ewma")))
        carried = old.select(*key, (F.col("gaps") - F.size("recent")).alias("_first"), F.posexplode("recent").alias("_at", "duration_ns")) \
            .select(*key, (F.col("_first") + F.col("_at")).alias("gap_idx"), F.lit(None).cast("long").alias("start_ns"),
                    F.lit(None).cast("long").alias("end_ns"), "duration_ns", F.lit(None).cast("double").alias("ewma"))
        rows = gaps.join(before, [*key, "gap_idx"], "left").unionByName(carried)
        full = cut(sliding_quantiles(rows, key, "gap_idx", "duration_ns", {"_low": 0.10, "_bound": bound_q}, TRAIL, True, splits, count="history"))

        def bound(quantile: str, least: int):
            return F.when(F.col("history") >= max(least, 1), F.col(quantile)).otherwise(0.0)
        out = full.filter("start_ns is not null").select(
            *key, "gap_idx", "start_ns", "end_ns", "duration_ns", "history", F.coalesce("ewma", F.lit(0.0)).alias("ewma"),
            bound("_low", min_samples).alias("trailing_p10"), bound("_bound", bound_min).alias("g_lower_bound"), event_time("end_ns").alias("ts"))
        total = full.groupBy(*key).agg((F.max("gap_idx") + 1).alias("gaps"))
        mean = after.groupBy(*key).agg(F.max_by("_after", "gap_idx").alias("_mean")).join(met.select(*key, "smooth"), key, "full")
        mean = mean.select(*key, F.coalesce("_mean", "smooth").alias("smooth"))
        latest = attach(full, total.select(*key, "gaps"), key, splits).filter(F.col("gap_idx") >= F.col("gaps") - TRAIL).groupBy(*key).agg(
            F.sort_array(F.collect_list(F.struct("gap_idx", "duration_ns"))).alias("recent"))
        reach = fresh.unionByName(seeds).groupBy(*key).agg(F.max("end_ns").alias("last_end"))
        paths = reach.join(total, key, "left").join(mean, key, "left").join(latest, key, "left").select(
            *key, "last_end", F.coalesce("gaps", F.lit(0)).alias("gaps"), F.coalesce("smooth", F.lit(0.0)).alias("smooth"),
            F.coalesce(F.col("recent.duration_ns"), F.array().cast("array<long>")).alias("recent"))
        return {"out": out, "paths": paths, "late": known.filter("late").drop("late", "last_end")}
    out = fields(busy, key) + ", gap_idx long, start_ns long, end_ns long, duration_ns long, history long, ewma double, " \
        "trailing_p10 double, g_lower_bound double, ts timestamp"
    return Stage(busy.select(*key, "start_ns", "end_ns"), step, out, {"paths": State(kept, tuple(key))})


def stream_histogram(gaps: DataFrame, key: Sequence[str] = KEY, value: str = "duration_ns") -> Stage:
    """How often each length occurred per path, kept up to date by every poll from its own rows alone: the state ``counts`` has one row per
    path and length (``n``), and ``out`` the rows that a poll changed.  ``gap_stats(..., weight="n")`` reads it as it would the gaps."""
    names = [*key, value]

    def step(m: Micro) -> dict[str, DataFrame]:
        new = m.rows.filter(F.col(value).isNotNull()).groupBy(*names).agg(F.count(F.lit(1)).alias("_new"))
        total = cut(new.join(m.state["counts"], names, "left").select(*names, (F.coalesce("n", F.lit(0)) + F.col("_new")).alias("n")))
        return {"out": total, "counts": total}
    out = fields(gaps, names) + ", n long"
    return Stage(gaps.select(*names), step, out, {"counts": State(out, tuple(names))})


def stream_trailing(gaps: DataFrame) -> DataFrame:
    """The trailing columns of ``stream_gaps`` alone."""
    names = [c for c in gaps.columns if c not in ("end_ns", "ts")]
    return gaps.select(*names)


def stream_decisions(gaps: DataFrame, policy: str = "ewma", margin: int = 200_000, low: int = 500_000,
                     high: int = 5_000_000, min_history: int = 10, durations: dict[int, int] | None = None,
                     eta_bandwidth: float = 0.95, eta_normal: float = 0.90) -> DataFrame:
    """Class per new gap and whether it fits; every policy here is a column of the gap row.

    ``predictive`` reads a ``p`` column, which ``models.score`` adds to a stream as to a batch.
    """
    d = durations or K.PROBE_DURATIONS_NS
    x = F.col("duration_ns")
    if policy == "ewma":
        kind = F.when(F.col("history") >= min_history,
                      largest_fit(F.greatest("ewma", "trailing_p10") - margin, d)).otherwise(K.PROBE_NONE)
    elif policy == "threshold":
        kind = F.when(x >= high, K.PROBE_BANDWIDTH).when(x >= low, K.PROBE_NORMAL).otherwise(K.PROBE_NONE)
    elif policy == "oracle":
        kind = largest_fit(x, d)
    elif policy == "predictive":
        kind = (F.when(F.col("p") >= eta_bandwidth, K.PROBE_BANDWIDTH)
                .when(F.col("p") >= eta_normal, K.PROBE_NORMAL).otherwise(K.PROBE_TINY))
    else:
        raise ValueError(f"unknown policy {policy!r}")
    need = F.when(F.col("probe_type") == K.PROBE_BANDWIDTH, d[K.PROBE_BANDWIDTH]) \
        .when(F.col("probe_type") == K.PROBE_NORMAL, d[K.PROBE_NORMAL]).otherwise(d[K.PROBE_TINY])
    return (gaps.withColumn("probe_type", kind.cast("int")).filter("probe_type > 0")
            .withColumn("fits", x >= need))


def stream_rate_limit(decisions: DataFrame, n: int = 10, width_ns: int = 1_000_000_000,
                      tie: Sequence[str] = (), delay: str = "10 seconds") -> DataFrame:
    """First ``n`` probes of each time window, over all paths.  State per window: its best ``n`` rows so far.

    A window is one of ``end_ns``, the time at which a gap is known.  It is decided when the watermark has passed it, so the answer
    does not depend on how rows arrive in micro-batches.  Tasks cut every window to ``n`` rows before rows of other tasks
    meet them, so a window's group holds at most ``n`` rows per Arrow batch.
    """
    columns = list(decisions.columns)
    output = ", ".join(f"{c} {t}" for c, t in decisions.dtypes)
    order = ["start_ns", "gap_idx", *tie]

    def first(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            yield part.sort_values(order, kind="stable").groupby(part["end_ns"] // width_ns, sort=False).head(n)

    def step(group: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = pickle.loads(state.get[0]) if state.exists else None
        if state.hasTimedOut:
            state.remove()
            yield held[columns]
            return
        for part in parts:
            held = pd.concat([held, part], ignore_index=True) if held is not None else part
            held = held.sort_values(order, kind="stable").head(n)
        state.update((pickle.dumps(held[columns]),))
        end_ms = (int(group[0]) + 1) * width_ns // 1_000_000
        state.setTimeoutTimestamp(max(end_ms, state.getCurrentWatermarkMs() + 1))
    windowed = decisions.mapInPandas(first, output).withWatermark("ts", delay).withColumn("_window", F.floor(F.col("end_ns") / width_ns))
    return windowed.groupBy("_window").applyInPandasWithState(step, output, "held binary", "append",
                                                              GroupStateTimeout.EventTimeTimeout)


def stream_counts(decisions: DataFrame, width: str = "1 second", delay: str = "10 seconds") -> DataFrame:
    """Probes and how many of them fitted, per tumbling window."""
    return (decisions.withWatermark("ts", delay).groupBy(F.window("ts", width).alias("w"))
            .agg(F.count(F.lit(1)).alias("probes"), F.count_if("fits").alias("safe"),
                 F.count_if(~F.col("fits")).alias("unsafe"))
            .select(F.col("w.start").alias("window_start"), "probes", "safe", "unsafe"))


def stream_dedup(gaps: DataFrame, key: Sequence[str] = KEY, delay: str = "10 seconds") -> DataFrame:
    """Each gap once, although a trace may be delivered again within the delay."""
    return gaps.withWatermark("ts", delay).dropDuplicatesWithinWatermark([*key, "start_ns", "end_ns"])


def stream_alarm(readings: DataFrame, n: int = 2, key: Sequence[str] = ("path_id",), delay: str = "0 seconds", tie: Sequence[str] = (),
                 most_rows: int = TARGET_ROWS) -> Stage:
    """An alarm row for the ``n``-th degraded reading in a row of a path, in order of ``t`` (seconds) whatever the order of arrival.

    Readings wait until the watermark (the latest ``t`` less ``delay``) has reached them and are then judged in order, after those judged
    before.  A reading that comes behind the watermark is late and goes to the ``late`` table.  Readings of one time go in the order of ``tie``.
    """
    key = list(key)
    names = [*key, "t", "is_degraded", *tie]
    at = F.round(F.col("t") * 1e6).cast("long")

    def step(m: Micro) -> dict[str, DataFrame]:
        gone = F.lit(False) if m.before is None else F.coalesce(at <= m.before, F.lit(False))
        held = cut(m.rows.filter(~gone).select(*names).unionByName(m.state["waiting"]))
        due = F.lit(False) if m.now is None else at <= m.now
        ready = held.filter(due)
        splits = plan_splits(ready, "t", key, most_rows)
        rows = cut(numbered(ready, key, ["t", *tie], "_at", splits))
        rows = running(rows, key, ["_at"], {"_good": ("max", F.when(~F.col("is_degraded"), F.col("_at")))}, splits=plan_splits(rows, "_at", key, most_rows))
        rows = attach(rows, m.state["streaks"].withColumnRenamed("streak", "_before"), key, splits, "t")
        streak = F.when(F.col("_good").isNull(), F.col("_at") + 1 + F.coalesce("_before", F.lit(0))).otherwise(F.col("_at") - F.col("_good"))
        rows = cut(rows.withColumn("streak", streak))
        return {"out": rows.filter((F.col("streak") == n) & F.col("is_degraded")).select(*key, "t", "streak"),
                "waiting": held.filter(~due), "late": m.rows.filter(gone).select(*names),
                "streaks": rows.groupBy(*key).agg(F.max_by("streak", "_at").alias("streak"))}
    states = {"waiting": State(fields(readings, names)), "streaks": State(fields(readings, key) + ", streak long", tuple(key))}
    return Stage(readings.select(*names), step, fields(readings, key) + ", t double, streak long", states, at, delay_us(delay))


def run_to_table(stream: DataFrame | Stage, folder: str, mode: str = "append") -> StreamTable:
    """Process what is there and append it below ``folder`` on shared storage.

    The table is the boundary between two stages: each query keeps one kind of state and restarts on its own.
    """
    if isinstance(stream, Stage):
        return run_stage(stream, folder)
    query = (stream.writeStream.format("parquet").outputMode(mode).option("path", f"{folder}/out")
             .option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start())
    query.awaitTermination()
    return StreamTable(folder, stream.sparkSession.read.schema(stream.schema).parquet(f"{folder}/out"))
