"""Prepare, search, baselines, backtest, metrics and importance as one job."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import metrics as m
from demandgrid.operators.backtest import Windows, baseline_backtest
from demandgrid.operators.boosting import split_importance, tweedie_backtest
from demandgrid.operators.features import zero_small
from demandgrid.operators.joins import combine_predictions
from demandgrid.operators.regression import (
    LagSpec, fold_names, importance_summary, ridge_backtest, ridge_importance,
)
from demandgrid.operators.search import best_trial, chosen, random_search
from demandgrid.sources.files import save_fitted, write_json
from demandgrid.session import cut_lineage

BASELINES = ("Naive", "SeasonalNaive", "ZeroModel")


@dataclass
class TrainingResult:
    predictions: DataFrame
    metrics: DataFrame
    metrics_by_cutoff: DataFrame
    comparison: DataFrame
    importance: DataFrame
    trials: dict[str, DataFrame] = field(default_factory=dict)
    best: dict[str, dict | None] = field(default_factory=dict)


def train_and_evaluate(panel: DataFrame, windows: Windows, models: Sequence[str] = ("Ridge", "TweedieGBT"),
                       spec: LagSpec = LagSpec(), n_trials: int = 0, seed: int = 42, score: str = "mae",
                       zero_below: float = 0.1, search_options: Mapping[str, dict] | None = None,
                       params: Mapping[str, dict] | None = None, save_to: str | None = None) -> TrainingResult:
    """Search (``n_trials`` > 0), refit per window, add baselines, score.

    The panel is written once to the checkpoint folder: every model, window and trial reads it, and
    a lost executor cannot force it to be rebuilt from the sources.
    """
    panel = cut_lineage(panel.select(ID, DS, Y, *spec.known))
    preds = baseline_backtest(panel, windows)
    folds = fold_names(panel, windows)
    trials, best, importance, models_fitted = {}, {}, None, {}
    for model in models:
        if n_trials:
            trials[model] = random_search(panel, windows, model, n_trials, seed, score, spec,
                                          **(search_options or {}).get(model, {}))
            best[model] = best_trial(trials[model])
        used, values = chosen(model, best.get(model), spec)
        values |= (params or {}).get(model, {})
        if model == "Ridge":
            out, fitted = ridge_backtest(panel, used, windows, **values)
            imp = ridge_importance(panel, used, fitted, folds)
        else:
            out, fitted = tweedie_backtest(panel, used, windows, **values)
            imp = split_importance(panel, used, fitted, folds)
        models_fitted[model] = (used, fitted)
        preds = combine_predictions(cut_lineage(out), preds.withColumn(Y, F.col(Y).cast("double")), check=True)
        imp = importance_summary(imp).select(F.lit(model).alias("model"), "*")
        importance = imp if importance is None else importance.unionByName(imp)
    names = [*models, *BASELINES]
    preds = cut_lineage(zero_small(preds, list(models), zero_below))
    result = TrainingResult(
        preds, m.evaluate(preds, names), m.evaluate(preds, names, ["cutoff"]),
        m.against_baselines(m.evaluate(preds, names), BASELINES), importance, trials, best)
    if save_to:
        base = save_to.rstrip("/")
        preds.write.mode("overwrite").parquet(f"{base}/predictions.parquet")
        write_json(result.metrics, f"{base}/metrics.json")
        write_json(result.importance, f"{base}/importance.json")
        for name, (used, fitted) in models_fitted.items():
            save_fitted(panel.sparkSession, fitted, used, f"{base}/model_{name}.json")
        for name, t in trials.items():
            write_json(t, f"{base}/trials_{name}.json")
    return result
