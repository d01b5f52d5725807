"""Model jobs.  Tree fits have no SQL twin; the driver checks their rows, the tests their quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import constants as K
from ..operators import calibration as B
from ..operators import models as M
from ..operators import policies as P
from ..operators import windows as W
from ..operators.aggregates import classification_metrics, mean_over_folds
from ..operators.labels import training_set
from ..session import cut
from . import adapter as A
from .q_policies import D, PATH
from .q_stats import late
from .registry import new_folder, query, timeline

H250, H500, H1000 = A.HORIZONS[4], A.HORIZONS[5], A.HORIZONS[6]
ORDER = ["start_ns", "path"]


def feature_table(spark, sf):
    """Features of every gap, written once: each model job reads them several times."""
    tl = timeline(spark, sf)
    rows = training_set(tl.gaps, tl.busy, PATH, [H500], causal=True, splits=tl.splits)
    return cut(rows.drop(f"y_{H500}"))


def passes(spark, sf):
    rows = feature_table(spark, sf)
    return rows.filter(~late()), rows.filter(late())


@query("model_cross_pass")
def model_cross_pass(spark, sf):
    return M.cross_pass_eval(*passes(spark, sf), [H250, H500])


@query("model_score")
def model_score(spark, sf):
    """One fitted horizon; the others use the nearest model."""
    train, test = passes(spark, sf)
    scored = M.score(test, M.fit_survival(train, [H500]), A.HORIZONS)
    return scored.select("path", "gap_idx", "horizon_ns", "p")


@query("model_save_load")
def model_save_load(spark, sf):
    train, test = passes(spark, sf)
    folder = new_folder(spark, "models")
    M.save_models(spark, M.fit_survival(train, [A.HORIZONS[0], H500]), folder)
    return M.labelled_scores(test, M.load_models(spark, folder), [A.HORIZONS[0], H500]) \
        .select("path", "gap_idx", "horizon_ns", "p", "label")


@query("model_time_series_cv")
def model_time_series_cv(spark, sf):
    return mean_over_folds(M.time_series_cv(feature_table(spark, sf), [H500], 5, ORDER))


@query("model_stratified_kfold")
def model_stratified_kfold(spark, sf):
    return M.stratified_kfold(feature_table(spark, sf), H500, ["path", "gap_idx"], 5)


@query("model_logistic")
def model_logistic(spark, sf):
    return M.cross_pass_eval(*passes(spark, sf), [H250, H500, H1000], fit=M.fit_logistic)


@query("model_learning_curve")
def model_learning_curve(spark, sf):
    train, test = passes(spark, sf)
    return M.learning_curve(train, test, [200, 0.5], [H500], ORDER)


@query("model_ablation")
def model_ablation(spark, sf):
    train, test = passes(spark, sf)
    return M.ablate_groups(train, test, [H500])


@query("model_single_groups")
def model_single_groups(spark, sf):
    train, test = passes(spark, sf)
    return M.ablate_groups(train, test, [H500], mode="only")


@query("model_evaluate_windows")
def model_evaluate_windows(spark, sf):
    return M.evaluate_windows(*passes(spark, sf), [H250, H500])


@query("model_safe_windows")
def model_safe_windows(spark, sf):
    """Published windows from a model: calibrated, lowered by drift, with a lower bound."""
    rows = feature_table(spark, sf)
    fitted = M.fit_survival(rows.filter(~late()), [H500])
    table = B.fit_calibration(M.labelled_scores(rows.filter(~late()), fitted, [H500]))
    drifting = W.drift_score(rows, K.GAP_FEATURES, PATH)
    scored = M.score(drifting.filter(late()), fitted, [H500])
    return B.model_safe_windows(scored, table, W.lower_bound(rows, key=PATH), PATH)


@query("model_policy")
def model_policy(spark, sf):
    """The predictive policy with a fitted model, counted by class."""
    train, test = passes(spark, sf)
    p = M.score(test, M.fit_survival(train, [H500]), [H500])
    runs = P.apply_policy("predictive", p, key=PATH, eta_bandwidth=0.8, eta_normal=0.7, durations=D)
    return P.fit_outcomes(runs, D).groupBy("probe_type").agg(
        F.count(F.lit(1)).alias("probes"), F.count_if("unsafe").alias("unsafe"))
