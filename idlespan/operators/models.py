"""Per-horizon models with Spark ML: fit, score, save, and the evaluations built on them.

Fits are loops over horizons on the driver; each fit is distributed.  The assembled features of one run are
kept once and shared by its fits.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from multiprocessing.pool import ThreadPool

from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassificationModel, GBTClassifier, LogisticRegression)
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import constants as K
from ..functions.columns import feature_complement, feature_subset
from ..scale import AUTO, numbered, resolve
from ..session import cut, shared_dir
from .aggregates import classification_metrics, mean_over_folds
from .calibration import apply_calibration, fit_calibration
from .joins import compare_runs
from .labels import horizon_labels
from .ranking import first_fraction, first_k

# fixed values: default tree parameters
TREE_PARAMS = {"maxIter": 100, "maxDepth": 4, "stepSize": 0.1, "subsamplingRate": 0.8, "seed": 42}


@dataclass
class HorizonModels:
    """One fitted model, or one constant where the training labels had a single class, per horizon."""
    features: list[str]
    models: dict[int, object] = field(default_factory=dict)
    constants: dict[int, float] = field(default_factory=dict)

    @property
    def horizons(self) -> list[int]:
        return sorted([*self.models, *self.constants])

    def nearest(self, horizon: int) -> int | None:
        return min(self.horizons, key=lambda h: abs(h - horizon), default=None)


def _assembled(df: DataFrame, features: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol="_x").transform(df)


ROWS_PER_FIT_TASK = 12_500


def _survey(data: DataFrame, features: Sequence[str], horizons: Sequence[int]):
    """One pass: row count, share of positives per horizon, and which features vary at all."""
    return data.agg(F.count(F.lit(1)).alias("n"),
                    *[F.avg((F.col("duration_ns") >= h).cast("double")).alias(f"r{i}") for i, h in enumerate(horizons)],
                    *[(F.min(c) < F.max(c)).alias(f"v{i}") for i, c in enumerate(features)]).first()


def _fit_each(train: DataFrame, horizons: Sequence[int], features: Sequence[str],
              estimator: Callable[[int, int], object], parallelism: int) -> HorizonModels:
    """Fit every horizon on one kept copy of the training columns.

    Constant columns cannot split or weigh anything and are left out.  A small set is put into few partitions,
    because a tree level is one job and its task overhead would exceed its work.  Up to ``parallelism`` fits
    are submitted at once, as in Spark's own cross validator.
    """
    shared_dir(train.sparkSession)          # long boosting chains are cut there
    data = train.select(*features, "duration_ns").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        seen = _survey(data, features, horizons)
        varying = [c for i, c in enumerate(features) if seen[f"v{i}"]] or list(features[:1])
        fitted = HorizonModels(varying)
        rates = {h: seen[f"r{i}"] for i, h in enumerate(horizons) if seen[f"r{i}"] is not None}
        fitted.constants = {h: r for h, r in rates.items() if r in (0.0, 1.0)}
        ready = _assembled(data, varying).select("_x", "duration_ns").coalesce(
            max(1, math.ceil(seen.n / ROWS_PER_FIT_TASK)))

        def one(h: int):
            labelled = ready.select("_x", (F.col("duration_ns") >= h).cast("double").alias("label"))
            return h, estimator(h, seen.n).fit(labelled)
        todo = [h for h in rates if h not in fitted.constants]
        with ThreadPool(max(1, min(parallelism, len(todo)))) as pool:
            fitted.models = dict(pool.map(inheritable_thread_target(train.sparkSession)(one), todo))
    finally:
        data.unpersist()
    return fitted


def fit_survival(train: DataFrame, horizons: Sequence[int] = K.HORIZONS_NS,
                 features: Sequence[str] = tuple(K.FEATURE_NAMES), params: dict | None = None,
                 parallelism: int = 4) -> HorizonModels:
    """One boosted-tree classifier of P(gap >= h) per horizon."""
    base = {**TREE_PARAMS, **(params or {})}

    def trees(h: int, _n: int):
        return GBTClassifier(featuresCol="_x", labelCol="label", **{**base, "seed": base["seed"] + h % 1000})
    return _fit_each(train, horizons, features, trees, parallelism)


def fit_logistic(train: DataFrame, horizons: Sequence[int], features: Sequence[str] = tuple(K.FEATURE_NAMES),
                 c: float = 1.0, max_iter: int = 1000, parallelism: int = 4) -> HorizonModels:
    """Logistic regression on standardised features with an inverse penalty ``c`` on the summed loss."""
    def scaled(_h: int, n: int):
        return Pipeline(stages=[
            StandardScaler(inputCol="_x", outputCol="_z", withMean=True, withStd=True),
            LogisticRegression(featuresCol="_z", labelCol="label", regParam=1.0 / (c * max(n, 1)),
                               standardization=False, maxIter=max_iter)])
    return _fit_each(train, horizons, features, scaled, parallelism)


def score(df: DataFrame, fitted: HorizonModels, horizons: Sequence[int]) -> DataFrame:
    """Long form P(gap >= h); a horizon without a model uses the nearest trained one, none at all gives 0.5."""
    out, kept = _assembled(df, fitted.features), list(df.columns)
    pairs = []
    for i, h in enumerate(horizons):
        source = fitted.nearest(h)
        if source in fitted.models:
            out = fitted.models[source].transform(out).withColumn(f"_p{i}", vector_to_array("probability")[1])
            out = out.select(*kept, "_x", *[f"_p{j}" for j in range(i + 1) if f"_p{j}" in out.columns])
            p = F.col(f"_p{i}")
        else:
            p = F.lit(0.5 if source is None else float(fitted.constants[source]))
        pairs.append(F.struct(F.lit(h).cast("long").alias("horizon_ns"), p.alias("p")))
    return out.withColumn("_h", F.explode(F.array(*pairs))).select(*kept, "_h.*")


def labelled_scores(df: DataFrame, fitted: HorizonModels, horizons: Sequence[int]) -> DataFrame:
    return score(df, fitted, horizons).withColumn(
        "label", (F.col("duration_ns") >= F.col("horizon_ns")).cast("int"))


def save_models(spark: SparkSession, fitted: HorizonModels, path: str) -> None:
    """One directory per horizon plus a small index, all written through Spark to shared storage."""
    for h, model in fitted.models.items():
        model.write().overwrite().save(f"{path}/horizon={h}")
    index = json.dumps({"features": fitted.features, "models": sorted(fitted.models),
                        "pipelines": [h for h, m in fitted.models.items() if isinstance(m, PipelineModel)],
                        "constants": fitted.constants})
    spark.createDataFrame([(index,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/index")


def load_models(spark: SparkSession, path: str) -> HorizonModels:
    index = json.loads(spark.read.text(f"{path}/index").first().value)
    kinds = {h: PipelineModel if h in index["pipelines"] else GBTClassificationModel for h in index["models"]}
    return HorizonModels(index["features"], {h: kind.load(f"{path}/horizon={h}") for h, kind in kinds.items()},
                         {int(h): v for h, v in index["constants"].items()})


# --- evaluations ------------------------------------------------------------

Fit = Callable[..., HorizonModels]


def cross_pass_eval(train: DataFrame, test: DataFrame, horizons: Sequence[int], fit: Fit = fit_survival,
                    **options) -> DataFrame:
    """Fit on one pass, score the other, metrics per horizon."""
    return classification_metrics(labelled_scores(test, fit(train, horizons, **options), horizons))


def _stack(frames: list[DataFrame], held: DataFrame | None = None) -> DataFrame:
    """All metric rows; with ``held``, they are written first and the rows they came from are released."""
    out = frames[0]
    for more in frames[1:]:
        out = out.unionByName(more)
    if held is not None:
        out = cut(out)
        held.unpersist()
    return out


def time_series_cv(df: DataFrame, horizons: Sequence[int], n_splits: int = 5,
                   order: Sequence[str] = ("start_ns",), fit: Fit = fit_survival, splits=AUTO,
                   **options) -> DataFrame:
    """Train on a chronological prefix, test on the next block; metrics per fold and horizon.  Too few rows for any fold give no metrics."""
    rows = numbered(df, [], list(order), "_row", resolve(splits, df, order[0], []))
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    n = rows.count()
    folds = []
    for s in range(n_splits):
        a, b = int(n * (s + 1) / (n_splits + 1)), int(n * (s + 2) / (n_splits + 1))
        if a == 0 or b <= a:
            continue
        fitted = fit(rows.filter(F.col("_row") < a), horizons, **options)
        block = rows.filter((F.col("_row") >= a) & (F.col("_row") < b)).drop("_row")
        folds.append(classification_metrics(labelled_scores(block, fitted, horizons)).withColumn("fold", F.lit(s)))
    if not folds:
        none = horizon_labels(rows.drop("_row").limit(0), horizons).withColumn("p", F.lit(0.5))
        folds.append(classification_metrics(none).withColumn("fold", F.lit(0)))
    return _stack(folds, rows)


def with_stratified_fold(df: DataFrame, label: str, ids: Sequence[str], k: int = 5, seed: int = 42,
                         splits=AUTO) -> DataFrame:
    """Fold 0..k-1, even within each class, in an order that a hash of the row decides."""
    rows = df.withColumn("_hash", F.xxhash64(*ids, F.lit(seed)))
    splits = resolve(splits, rows, "_hash", [label])
    return numbered(rows, [label], ["_hash", *ids], "_row", splits) \
        .withColumn("fold", (F.col("_row") % k).cast("int")).drop("_hash", "_row")


def stratified_kfold(df: DataFrame, horizon: int, ids: Sequence[str], k: int = 5, fit: Fit = fit_survival,
                     **options) -> DataFrame:
    """Metrics of each held-out fold, one row per fold."""
    rows = with_stratified_fold(df.withColumn("_y", (F.col("duration_ns") >= horizon).cast("int")), "_y", ids, k)
    rows = rows.persist(StorageLevel.MEMORY_AND_DISK)
    out = []
    for i in range(k):
        fitted = fit(rows.filter(F.col("fold") != i), [horizon], **options)
        held = rows.filter(F.col("fold") == i).drop("fold", "_y")
        out.append(classification_metrics(labelled_scores(held, fitted, [horizon])).withColumn("fold", F.lit(i)))
    return _stack(out, rows)


def learning_curve(train: DataFrame, test: DataFrame, sizes: Sequence[float], horizons: Sequence[int],
                   order: Sequence[str] = ("start_ns",), fit: Fit = fit_survival, splits=AUTO,
                   **options) -> DataFrame:
    """Cold start: metrics when only the first k rows (int) or the first share (float) are known."""
    out = []
    for size in sizes:
        part = first_k(train, size, order) if isinstance(size, int) else first_fraction(train, size, order, splits)
        fitted = fit(part, horizons, **options)
        out.append(classification_metrics(labelled_scores(test, fitted, horizons))
                   .withColumn("size", F.lit(float(size))))
    return _stack(out)


def ablate_groups(train: DataFrame, test: DataFrame, horizons: Sequence[int], groups: Sequence[str] | None = None,
                  mode: str = "leave_one_out", fit: Fit = fit_survival, **options) -> DataFrame:
    """Metrics without one feature group, or with only one, and the difference from all features."""
    groups = list(groups or K.FEATURE_GROUPS)
    train = train.persist(StorageLevel.MEMORY_AND_DISK)
    full = cross_pass_eval(train, test, horizons, fit, features=K.FEATURE_NAMES, **options)
    metrics = ["precision", "recall", "false_safe_rate", "brier"]
    runs = []
    for g in groups:
        names = feature_complement(g) if mode == "leave_one_out" else feature_subset(g)
        run = cross_pass_eval(train, test, horizons, fit, features=names, **options)
        runs.append(compare_runs(full, run, ["horizon_ns"], metrics).withColumn("feature_group", F.lit(g)))
    return _stack(runs, train)


def evaluate_windows(train: DataFrame, test: DataFrame, horizons: Sequence[int], n_bins: int = 10,
                     fit: Fit = fit_survival, **options) -> DataFrame:
    """Walk-forward: every test gap is scored from its own past, calibrated on the training pass, then counted."""
    fitted = fit(train, horizons, **options)
    table = fit_calibration(labelled_scores(train, fitted, horizons), n_bins)
    calibrated = apply_calibration(labelled_scores(test, fitted, horizons), table, n_bins)
    return classification_metrics(calibrated.drop("p").withColumnRenamed("p_calibrated", "p"))
