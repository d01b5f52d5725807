"""Placement policies: which probe class for which gap, was it safe, what did it cost.

A policy takes gaps and adds ``probe_type`` (0 = no probe).  User policies are plain functions of the same
shape, registered by name.  Several policies are chained over one pass of the gaps and unfolded at the end, so
the timeline is computed once however many are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import probe_duration
from ..scale import AUTO, resolve, trailing
from .chains import greedy_chain, with_spacing
from .intervals import overlap_amount
from .windows import ewma

KEY = tuple(K.PATH_KEY)
Durations = dict[int, int]


def _kind(gaps: DataFrame, kind: Column) -> DataFrame:
    return gaps.withColumn("probe_type", kind.cast("int"))


def largest_fit(room: Column, durations: Durations | None = None) -> Column:
    """Largest of bandwidth, normal and tiny that fits the room."""
    d = durations or K.PROBE_DURATIONS_NS
    return (F.when(room >= d[K.PROBE_BANDWIDTH], K.PROBE_BANDWIDTH).when(room >= d[K.PROBE_NORMAL], K.PROBE_NORMAL)
            .when(room >= d[K.PROBE_TINY], K.PROBE_TINY).otherwise(K.PROBE_NONE))


def policy_none(gaps: DataFrame) -> DataFrame:
    return _kind(gaps, F.lit(K.PROBE_NONE))


def policy_fixed_interval(gaps: DataFrame, key: Sequence[str] = KEY, period: int = 100_000_000,
                          minimum: bool = False, splits=AUTO) -> DataFrame:
    """One tiny probe per path and period, in the first gap that starts in it.

    ``minimum=True`` asks instead for at least ``period`` between two probes of a path, which buckets cannot promise.

    The window holds the gaps of one period of one path; gaps are longer than the merge tolerance, so their
    number is bounded by period / tolerance.
    """
    if minimum:
        return _kind(with_spacing(gaps, period, key, splits=splits), F.col("chosen").cast("int") * K.PROBE_TINY).drop("chosen")
    order = Window.partitionBy(*key, F.floor(F.col("start_ns") / period)).orderBy("start_ns")
    return _kind(gaps, F.when(F.row_number().over(order) == 1, K.PROBE_TINY).otherwise(K.PROBE_NONE))


def policy_random(gaps: DataFrame, key: Sequence[str] = KEY, probability: float = 0.01, seed: int = 42) -> DataFrame:
    """A random class with the given probability, blind to gap length; a hash of the gap, so repeatable."""
    def draw(salt: int, n: int) -> Column:
        return F.pmod(F.xxhash64(*key, "gap_idx", F.lit(seed + salt)), F.lit(n))
    kind = draw(1, 3) + K.PROBE_TINY
    return _kind(gaps, F.when(draw(0, 1_000_000) < int(probability * 1_000_000), kind).otherwise(K.PROBE_NONE))


def policy_threshold(gaps: DataFrame, low: int = 500_000, high: int = 5_000_000) -> DataFrame:
    x = F.col("duration_ns")
    return _kind(gaps, F.when(x >= high, K.PROBE_BANDWIDTH).when(x >= low, K.PROBE_NORMAL).otherwise(K.PROBE_NONE))


def policy_ewma(gaps: DataFrame, key: Sequence[str] = KEY, alpha: float = 0.1, margin: int = 200_000,
                win: int = 100, min_history: int = 10, durations: Durations | None = None, causal: bool = True,
                splits=AUTO) -> DataFrame:
    """Class by max(EWMA, trailing p10) less a margin.  ``causal`` ends the history before the gap; the
    published runs included the gap being decided (``causal=False``)."""
    splits = resolve(splits, gaps, "start_ns", key)
    smooth = ewma(gaps, key, alpha, name="_ewma")

    def columns(w):
        frame = w.rowsBetween(-win, -1) if causal else w.rowsBetween(-(win - 1), 0)
        return {"_e": F.lag("_ewma", 1).over(w) if causal else F.col("_ewma"),
                "_q": F.percentile("duration_ns", 0.1).over(frame), "_n": F.count(F.lit(1)).over(frame)}
    rows = trailing(smooth, key, "gap_idx", win, columns, splits)
    room = F.greatest("_e", "_q") - margin
    kind = F.when(F.col("_n") >= min_history, largest_fit(room, durations)).otherwise(K.PROBE_NONE)
    return _kind(rows, kind).select(*gaps.columns, "probe_type")


def policy_predictive(gaps: DataFrame, key: Sequence[str] = KEY, predictions: DataFrame | None = None,
                      eta_bandwidth: float = 0.95, eta_normal: float = 0.90, durations: Durations | None = None,
                      causal: bool = True, splits=AUTO, **ewma_options) -> DataFrame:
    """Class by P(gap >= 500 us), from a ``p`` column of the gaps or from ``predictions`` (key, gap_idx, p).

    Without either the EWMA policy decides.  A gap without a prediction is not probed.  ``causal=False``
    reproduces the published mode, which also tested the real length of the gap.
    """
    if predictions is None and "p" not in gaps.columns:
        return policy_ewma(gaps, key, durations=durations, causal=causal, splits=splits, **ewma_options)
    d = durations or K.PROBE_DURATIONS_NS
    rows = gaps
    if predictions is not None:
        rows = gaps.drop("p").join(predictions.select(*key, "gap_idx", "p"), [*key, "gap_idx"], "left")
    x, p = F.col("duration_ns"), F.col("p")

    def room(kind: int) -> Column:
        return F.lit(True) if causal else x >= d[kind]
    kind = (F.when(p.isNull(), K.PROBE_NONE)
            .when((p >= eta_bandwidth) & room(K.PROBE_BANDWIDTH), K.PROBE_BANDWIDTH)
            .when((p >= eta_normal) & room(K.PROBE_NORMAL), K.PROBE_NORMAL)
            .when(room(K.PROBE_TINY), K.PROBE_TINY).otherwise(K.PROBE_NONE))
    return _kind(rows, kind).select(*gaps.columns, "probe_type")


def policy_oracle(gaps: DataFrame, durations: Durations | None = None) -> DataFrame:
    return _kind(gaps, largest_fit(F.col("duration_ns"), durations))


POLICIES: dict[str, Callable[..., DataFrame]] = {
    "none": policy_none, "fixed_interval": policy_fixed_interval, "random": policy_random,
    "threshold": policy_threshold, "ewma": policy_ewma, "predictive": policy_predictive, "oracle": policy_oracle}


def register_policy(name: str, policy: Callable[..., DataFrame]) -> None:
    POLICIES[name] = policy


def make_policy(name: str) -> Callable[..., DataFrame]:
    if name not in POLICIES:
        raise ValueError(f"unknown policy {name!r}; known: {', '.join(sorted(POLICIES))}")
    return POLICIES[name]


def apply_policy(name: str, gaps: DataFrame, **options) -> DataFrame:
    """The gaps that one policy probes."""
    return (make_policy(name)(gaps, **options).withColumn("policy", F.lit(name))
            .filter(F.col("probe_type") > K.PROBE_NONE))


def apply_policies(gaps: DataFrame, options: dict[str, dict]) -> DataFrame:
    """Decisions of several policies in long form, from one pass over the gaps."""
    rows = gaps
    for i, (name, kw) in enumerate(options.items()):
        rows = make_policy(name)(rows, **kw).withColumnRenamed("probe_type", f"_k{i}")
    kinds = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(f"_k{i}").alias("probe_type"))
                      for i, n in enumerate(options)])
    chosen = F.filter(kinds, lambda k: k["probe_type"] > K.PROBE_NONE)
    return rows.withColumn("_d", F.explode(chosen)).select(*gaps.columns, "_d.policy", "_d.probe_type")


# --- from decisions to outcomes --------------------------------------------

def with_probe_ns(decisions: DataFrame, durations: Durations | None = None) -> DataFrame:
    return decisions.withColumn("probe_ns", probe_duration("probe_type", durations=durations))


def downgrade_to_fit(decisions: DataFrame, durations: Durations | None = None) -> DataFrame:
    """A bandwidth probe that does not fit becomes a normal one if that fits; what does not fit is dropped."""
    d = durations or K.PROBE_DURATIONS_NS
    x, kind = F.col("duration_ns"), F.col("probe_type")
    lower = (kind == K.PROBE_BANDWIDTH) & (x < d[K.PROBE_BANDWIDTH]) & (x >= d[K.PROBE_NORMAL])
    out = decisions.withColumn("downgraded", lower).withColumn(
        "probe_type", F.when(F.col("downgraded"), K.PROBE_NORMAL).otherwise(kind))
    return with_probe_ns(out, d).filter(x >= F.col("probe_ns"))


def limit_per_window(decisions: DataFrame, n: int = 10, width: int = 1_000_000_000, key: Sequence[str] = (),
                     by: Sequence[str] = ("policy",)) -> DataFrame:
    """At most ``n`` probes per time window, over all paths or per path of ``key``.

    The rank filter becomes a group limit on the map side: a task ships at most ``n`` rows per window.
    """
    order = Window.partitionBy(*by, *key, F.floor(F.col("start_ns") / width)).orderBy("start_ns", *[
        c for c in decisions.columns if c in ("path", *KEY, "gap_idx")])
    return (decisions.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= n).drop("_rank"))


def fit_outcomes(decisions: DataFrame, durations: Durations | None = None) -> DataFrame:
    """Unsafe when the class takes longer than the gap; utilisation is their ratio."""
    x = F.col("duration_ns")
    return with_probe_ns(decisions, durations).withColumns({
        "unsafe": F.col("probe_ns") > x,
        "utilisation": F.when(x > 0, F.col("probe_ns") / x).otherwise(0.0)})


def outcomes(decisions: DataFrame, busy: DataFrame, key: Sequence[str] = KEY, offset: int = 1_000,
             scope: str = "path", splits=AUTO) -> DataFrame:
    """Placed probes with the busy time they overlap.  They start ``offset`` after the gap starts, so a gap
    less than that longer than its probe is unsafe."""
    placed = decisions if "downgraded" in decisions.columns else decisions.withColumn("downgraded", F.lit(False))
    start = F.col("start_ns") + offset
    probes = placed.select(
        *key, "policy", "gap_idx", "probe_type", "downgraded", F.col("start_ns").alias("scheduled_ns"),
        F.col("duration_ns").alias("gap_during_probe_ns"), start.alias("start_ns"),
        (start + F.col("probe_ns")).alias("end_ns"), F.struct("policy", *key, "gap_idx").alias("probe_id"))
    met = overlap_amount(probes, busy, key, "probe_id", scope, splits)
    return met.drop("probe_id").withColumns({"safe": F.col("busy_overlap_ns") == 0, "cancelled": F.lit(False)})


def one_per_path_at_a_time(placed: DataFrame, key: Sequence[str] = KEY, splits=AUTO) -> DataFrame:
    """Drop a probe whose gap starts while an earlier probe of its path and policy still runs.  Only probes that were placed run: one that
    was dropped does not stop a later one."""
    chain = greedy_chain(placed, ["policy", *key], "scheduled_ns", F.col("end_ns"), "_placed", splits=splits)
    return chain.filter("_placed").drop("_placed")


def trace_window_ns(gaps: DataFrame) -> Column:
    """From the start of the first gap to the end of the last one to start, as a scalar."""
    return gaps.agg((F.max_by("end_ns", F.struct("start_ns", "end_ns")) - F.min("start_ns")).alias("w")).scalar()
