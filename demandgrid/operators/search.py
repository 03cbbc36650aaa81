"""Seeded random search.  Trials are drawn on the driver; every trial is scored on Spark."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import Y, ratio, stack
from demandgrid.session import cut_lineage
from demandgrid.operators.backtest import Windows
from demandgrid.operators.boosting import Setting, ensemble_predictor, fit_many, prepared_frame
from demandgrid.operators.regression import (
    LagSpec, fit_ridge_windows, lag_frame, linear_predictor, products, recursive_backtest,
)

# The search space.
LAG_CHOICES = ((1, 7), (1, 7, 30))
ROLLING_CHOICES = ((7,), (7, 28))
ALPHA_RANGE = (1e-6, 1e3)
RATE_RANGE, TREES_RANGE, DEPTH_RANGE, POWER_RANGE = (0.01, 0.3), (100, 1000), (3, 8), (1.4, 1.9)
TRIAL_SCHEMA = "trial int, model string, lags string, rolling string, params string"


def draw(model: str, n_trials: int, seed: int = 42, lag_choices: Sequence[Sequence[int]] = LAG_CHOICES,
         rolling_choices: Sequence[Sequence[int]] = ROLLING_CHOICES, space: Mapping[str, tuple] | None = None) -> list[dict]:
    """Trial settings.  ``space`` narrows a range, e.g. {'n_rounds': (5, 10)}."""
    rng = np.random.default_rng(seed)
    space = dict(space or {})
    log_uniform = lambda lo, hi: float(np.exp(rng.uniform(np.log(lo), np.log(hi))))
    out = []
    for t in range(n_trials):
        one = {"trial": t, "model": model, "lags": tuple(lag_choices[rng.integers(len(lag_choices))]),
               "rolling": tuple(rolling_choices[rng.integers(len(rolling_choices))])}
        if model == "Ridge":
            one["params"] = {"alpha": log_uniform(*space.get("alpha", ALPHA_RANGE))}
        elif model == "TweedieGBT":
            trees, depth = space.get("n_rounds", TREES_RANGE), space.get("depth", DEPTH_RANGE)
            one["params"] = {
                "rate": log_uniform(*space.get("rate", RATE_RANGE)),
                "n_rounds": int(rng.integers(trees[0], trees[1] + 1)), "depth": int(rng.integers(depth[0], depth[1] + 1)),
                "power": float(rng.uniform(*space.get("power", POWER_RANGE)))}
        else:
            raise ValueError("model must be Ridge or TweedieGBT")
        out.append(one)
    return out


def _scores(pred: DataFrame, names: Sequence[str]) -> DataFrame:
    """MAE, RMSE and symmetric MAPE per prediction column, long form."""
    a = F.col(Y).cast("double")
    p = F.col("p")
    long = stack(pred, [Y], names, "name", "p", "double").where(a.isNotNull() & p.isNotNull())
    e = F.abs(a - p)
    return long.groupBy("name").agg(
        F.avg(e).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"),
        F.avg(F.coalesce(ratio(e, F.abs(a) + F.abs(p)), F.lit(0.0))).alias("smape"))


def random_search(panel: DataFrame, windows: Windows, model: str = "Ridge", n_trials: int = 20, seed: int = 42,
                  score: str = "mae", base: LagSpec = LagSpec(), log: str | None = None, **options) -> DataFrame:
    """One row per trial: settings and scores, best first (``score`` names the ranking column).

    Trials that share lags share one training frame and one forecasting pass.  Ridge trials are all solved from one
    frame's sums of products; trees of all trials and windows grow side by side, one job per level for all of them.
    ``log``: a folder finished trees are appended to, for a search that was killed to go on from.
    """
    spark = panel.sparkSession
    trials = draw(model, n_trials, seed, **options)
    groups: dict[tuple, list[dict]] = {}
    for t in trials:
        groups.setdefault((t["lags"], t["rolling"]), []).append(t)
    specs = {key: replace(base, lags=key[0], rolling=key[1]) for key in groups}
    makers: dict[tuple, dict] = {key: {} for key in groups}
    if model == "Ridge":
        for key, some in groups.items():
            prod = products(lag_frame(panel, specs[key], windows), specs[key])
            makers[key] = {f"t{t['trial']}": linear_predictor(fit_ridge_windows(prod, windows, **t["params"])) for t in some}
    elif groups:
        frames = [prepared_frame(panel, specs[key], windows) for key in groups]
        work = [(key, t, i, w) for i, (key, some) in enumerate(groups.items()) for t in some for w in range(windows.n_windows)]
        names = [json.dumps([key, t["params"], str(specs[key]), w, str(windows)]) for key, t, _, w in work]
        fitted = fit_many(frames, [Setting(i, w, **t["params"]) for _, t, i, w in work], windows, log=log, names=names)
        for t in trials:
            key = (t["lags"], t["rolling"])
            makers[key][f"t{t['trial']}"] = ensemble_predictor({w: e for (_, u, _, w), e in zip(work, fitted) if u is t})
    scored: DataFrame | None = None
    for key in groups:
        part = _scores(recursive_backtest(panel, specs[key], windows, makers[key]), list(makers[key]))
        scored = part if scored is None else scored.unionByName(part)
    rows = [(t["trial"], t["model"], json.dumps(t["lags"]), json.dumps(t["rolling"]), json.dumps(t["params"])) for t in trials]
    table = spark.createDataFrame(rows, TRIAL_SCHEMA)
    ranked = (table.join(scored.withColumn("trial", F.substring("name", 2, 9).cast("int")).drop("name"), "trial")
              .withColumn("score_name", F.lit(score)).withColumn("score", F.col(score)).orderBy("score", "trial"))
    # written once: picking the best trial and saving the table must not forecast again
    return cut_lineage(ranked)


def best_trial(results: DataFrame) -> dict | None:
    """Settings of the best row, or None when there is none."""
    r = results.orderBy("score", "trial").first()
    if r is None:
        return None
    return {"lags": tuple(json.loads(r["lags"])), "rolling": tuple(json.loads(r["rolling"])),
            "params": json.loads(r["params"]), "score": r["score"], "score_name": r["score_name"]}


# Parameters used when no search ran.
DEFAULT_PARAMS = {"Ridge": {"alpha": 1.0}, "TweedieGBT": {"rate": 0.1, "n_rounds": 100, "depth": 5, "power": 1.5}}


def chosen(model: str, best: Mapping | None, base: LagSpec) -> tuple[LagSpec, dict]:
    """Spec and parameters for the refit: the best trial's, or the defaults."""
    if best is None:
        return base, dict(DEFAULT_PARAMS[model])
    return replace(base, lags=tuple(best["lags"]), rolling=tuple(best["rolling"])), dict(best["params"])
