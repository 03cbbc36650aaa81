"""Model queries.  One-lag models have a closed-form SQL twin; the others are checked by tests."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import query, with_panel
from demandgrid.catalog.dataset_queries import scratch
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import boosting, ranking, search
from demandgrid.operators import regression as r
from demandgrid.operators.backtest import Windows
from demandgrid.plans.training import train_and_evaluate
from demandgrid.sources import files

WINDOWS = Windows(28, 3)
SURVEYED = Windows(28, 5)  # searches and the whole training job, as surveyed
ONE_LAG = r.LagSpec(lags=(1,), rolling=(), weekday=False, month=False)
FULL = r.LagSpec(lags=(1, 7, 14), rolling=(7, 28), counters=True, exog=("snap",))


def with_snap(spark, sf):
    """Region panel with the state's benefit flag as a column known ahead."""
    from demandgrid.operators.calendars import benefit_flags_long
    flags = benefit_flags_long(b.calendar(spark, sf)).withColumnRenamed("date", DS)
    panel = b.panel(spark, sf).withColumn("state_id", F.split(ID, "_")[0])
    return panel.join(flags, ["state_id", DS]).select(ID, DS, Y, "snap")


@query("lag_training_frame", with_panel("""
SELECT unique_id, ds, y::DOUBLE AS y, l1::DOUBLE AS lag1, l7::DOUBLE AS lag7, round(m, 6) AS rolling_mean_lag1_window_size7,
  round(s, 6) AS rolling_std_lag1_window_size7, least(floor((n - 28 - p) / 28.0), 2)::INTEGER AS segment FROM (
  SELECT unique_id, ds, y, lag(y, 1) OVER w AS l1, lag(y, 7) OVER w AS l7, avg(y) OVER f AS m, stddev_samp(y) OVER f AS s,
    row_number() OVER w AS p, count(*) OVER (PARTITION BY unique_id) AS n FROM panel
  WINDOW w AS (PARTITION BY unique_id ORDER BY ds), f AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))
WHERE l7 IS NOT NULL AND p <= n - 28"""))
def lag_training_frame(spark, sf):
    spec = r.LagSpec(lags=(1, 7), rolling=(7,), weekday=False, month=False)
    return r.lag_frame(b.panel(spark, sf), spec, WINDOWS)


def _ar1(group: str, alpha: float, name: str) -> str:
    """Slope and intercept by window from sums, then the closed form of the recursion."""
    on = f"AND f.{group} = k.{group}" if group else ""
    g = f"k.{group}, " if group else ""
    return f"""
SELECT t.unique_id, t.ds, k.cutoff, t.y::DOUBLE AS y, round(pow(fit.b, t.p - k.c) * k.last_y + fit.a * (1 - pow(fit.b, t.p - k.c)) / (1 - fit.b), 6) AS "{name}"
FROM pos t JOIN cuts k ON t.unique_id = k.unique_id AND t.p BETWEEN k.c + 1 AND k.c + 28
JOIN (SELECT {f'{group}, ' if group else ''}i, b, my - b * mx AS a FROM (
  SELECT {g}k.i, (count(*) * covar_pop(f.y, f.x)) / (count(*) * var_pop(f.x) + {alpha}) AS b, avg(f.y) AS my, avg(f.x) AS mx
  FROM cuts k JOIN (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM pos) f
    ON f.unique_id = k.unique_id AND f.p <= k.c AND f.x IS NOT NULL {on} GROUP BY {g}k.i)) fit
ON fit.i = k.i {f'AND fit.{group} = k.{group}' if group else ''}"""


POS_CTE = """
pos AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS p, count(*) OVER (PARTITION BY unique_id) AS n FROM panel),
cuts AS (SELECT unique_id, i, n - 28 - i * 28 AS c, ds AS cutoff, y AS last_y FROM pos, (SELECT unnest(range(0, 3)) AS i) WHERE p = n - 28 - i * 28)"""


@query("global_linear_one_lag", with_panel(_ar1("", 0.0, "Linear"), more=POS_CTE))
def global_linear_one_lag(spark, sf):
    return r.ridge_backtest(b.panel(spark, sf), ONE_LAG, WINDOWS, 0.0, "Linear")[0]


@query("global_ridge_one_lag", with_panel(_ar1("", 5000.0, "Ridge"), more=POS_CTE))
def global_ridge_one_lag(spark, sf):
    return r.ridge_backtest(b.panel(spark, sf), ONE_LAG, WINDOWS, 5000.0)[0]


@query("local_linear_one_lag", with_panel(_ar1("unique_id", 0.0, "Local"), more=POS_CTE))
def local_linear_one_lag(spark, sf):
    return r.local_backtest(b.panel(spark, sf), ONE_LAG, WINDOWS)


def _fits(alpha: float) -> str:
    return f"""(SELECT k.i, min(k.cutoff) AS cutoff, (count(*) * covar_pop(f.y, f.x)) / (count(*) * var_pop(f.x) + {alpha}) AS b,
  avg(f.y) - (count(*) * covar_pop(f.y, f.x)) / (count(*) * var_pop(f.x) + {alpha}) * avg(f.x) AS a
  FROM cuts k JOIN (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM pos) f
    ON f.unique_id = k.unique_id AND f.p <= k.c AND f.x IS NOT NULL GROUP BY k.i)"""


IMPORTANCE_CTE = POS_CTE + f""",
fits AS {_fits(5000.0)},
imp AS (SELECT 'intercept' AS feature, a AS value FROM fits UNION ALL SELECT 'lag1', b FROM fits)"""


def _one_lag_importance(spark, sf):
    panel = b.panel(spark, sf)
    fitted = r.fit_ridge_windows(r.products(r.lag_frame(panel, ONE_LAG, WINDOWS), ONE_LAG), WINDOWS, 5000.0)
    return r.ridge_importance(panel, ONE_LAG, fitted, r.fold_names(panel, WINDOWS))


@query("importance_by_fold", with_panel("""
SELECT 'lag1' AS feature, (cutoff + 1)||'_'||(cutoff + 28) AS fold, round(b, 6) AS value FROM fits
UNION ALL SELECT 'intercept', (cutoff + 1)||'_'||(cutoff + 28), round(a, 6) FROM fits""", more=IMPORTANCE_CTE))
def importance_by_fold(spark, sf):
    return _one_lag_importance(spark, sf)


@query("importance_over_folds", with_panel("""
SELECT feature, round(avg(value), 6) AS importance, round(stddev_samp(value), 6) AS spread, count(*) AS n_folds FROM imp GROUP BY 1""",
                                          more=IMPORTANCE_CTE))
def importance_over_folds(spark, sf):
    return r.importance_summary(_one_lag_importance(spark, sf))


@query("importance_first_fold", with_panel("""
SELECT 'lag1' AS feature, round(b, 6) AS importance FROM fits WHERE i = 2 UNION ALL SELECT 'intercept', round(a, 6) FROM fits WHERE i = 2""",
                                          more=IMPORTANCE_CTE))
def importance_first_fold(spark, sf):
    return r.first_fold_importance(_one_lag_importance(spark, sf))


@query("top_features", with_panel("""
SELECT feature, round(avg(value), 6) AS importance, round(stddev_samp(value), 6) AS spread, count(*) AS n_folds FROM imp GROUP BY 1
ORDER BY abs(avg(value)) DESC LIMIT 1""", more=IMPORTANCE_CTE))
def top_features(spark, sf):
    return ranking.top_features(r.importance_summary(_one_lag_importance(spark, sf)), 1)


@query("saved_model_predictions", with_panel("""
SELECT unique_id, ds, y::DOUBLE AS y, x::DOUBLE AS lag1, round(a + b * x, 6) AS prediction FROM (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM panel) l,
  (SELECT b, my - b * mx AS a FROM (SELECT count(*) * covar_pop(y, x) / (count(*) * var_pop(x) + 5000) AS b, avg(y) AS my, avg(x) AS mx
    FROM (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM panel) WHERE x IS NOT NULL)) WHERE x IS NOT NULL"""))
def saved_model_predictions(spark, sf):
    """Pooled ridge as a library pipeline, saved, loaded and applied."""
    frame = r.lag_frame(b.panel(spark, sf), ONE_LAG)
    path = scratch(spark)
    files.save_model(r.fit_ridge(frame, ONE_LAG, 5000.0), path)
    return files.load_model(path).transform(frame).drop("features")


def _search_sql() -> str:
    parts = []
    for t in search.draw("Ridge", 20, 42, lag_choices=((1,),), rolling_choices=((),)):
        parts.append(f"""
SELECT {t['trial']} AS trial, 'Ridge' AS model, '[1]' AS lags, '[]' AS rolling, '{json.dumps(t["params"])}' AS params, 'mae' AS score_name, round(avg(e), 6) AS mae,
  round(sqrt(avg(e * e)), 6) AS rmse, round(avg(coalesce(e / nullif(abs(y) + abs(hat), 0), 0)), 6) AS smape, round(avg(e), 6) AS score
FROM (SELECT t.y, hat, abs(t.y - hat) AS e FROM (
  SELECT t.y, pow(f.b, t.p - k.c) * k.last_y + f.a * (1 - pow(f.b, t.p - k.c)) / (1 - f.b) AS hat
  FROM pos t JOIN cuts k ON t.unique_id = k.unique_id AND t.p BETWEEN k.c + 1 AND k.c + 28 JOIN {_fits(t['params']['alpha'])} f ON f.i = k.i) t)""")
    return " UNION ALL ".join(parts)


@query("one_lag_search", with_panel(_search_sql(), more=POS_CTE))
def one_lag_search(spark, sf):
    return search.random_search(b.panel(spark, sf), WINDOWS, "Ridge", 20, base=ONE_LAG, lag_choices=((1,),),
                                rolling_choices=((),))


@query("ridge_backtest")
def ridge_backtest(spark, sf):
    return r.ridge_backtest(with_snap(spark, sf), FULL, WINDOWS, 1.0)[0]


_AHEAD = """
SELECT unique_id, CAST(ds + CAST(k AS INTEGER) AS DATE) AS ds, ds AS cutoff, round(pow(b, k) * y + a * (1 - pow(b, k)) / (1 - b), 6) AS "Ridge"
FROM pos, fit, (SELECT unnest(range(1, 15)) AS k) WHERE p = n"""
_FIT_ALL = POS_CTE + """,
fit AS (SELECT b, my - b * mx AS a FROM (SELECT count(*) * covar_pop(y, x) / (count(*) * var_pop(x) + 5000) AS b, avg(y) AS my, avg(x) AS mx
  FROM (SELECT *, lag(y) OVER (PARTITION BY unique_id ORDER BY ds) AS x FROM panel) WHERE x IS NOT NULL))"""


@query("ridge_forecast_one_lag", with_panel(_AHEAD, more=_FIT_ALL))
def ridge_forecast_one_lag(spark, sf):
    """Fourteen days past the end of every series."""
    return r.ridge_forecast(b.panel(spark, sf), ONE_LAG, 14, 5000.0)[0]


@query("saved_forecaster", with_panel(_AHEAD, more=_FIT_ALL))
def saved_forecaster(spark, sf):
    """The same by a model that was saved and loaded."""
    panel, path = b.panel(spark, sf), scratch(spark)
    model = r.solve_ridge(r.products(r.lag_frame(panel, ONE_LAG), ONE_LAG).by_segment[0], ONE_LAG, 5000.0)
    files.save_fitted(spark, {0: model}, ONE_LAG, path)
    models, spec = files.load_fitted(spark, path)
    return r.forecast(panel, spec, 14, {"Ridge": r.linear_predictor(models)})


WIDE = r.LagSpec(lags=(1, 7), rolling=(7,))


def _zeros(columns: list[str]) -> str:
    """Optimality conditions hold: zero for each window and feature."""
    return " UNION ALL ".join(f"SELECT {i} AS \"window\", '{c}' AS feature, 0.0::DOUBLE AS residual" for i in range(3) for c in columns)


def _residuals(frame, spec, models, penalty, digits):
    """Per window and feature the mean of (y - prediction) x feature, less the penalty's share."""
    out = None
    for i, m in models.items():
        eta = F.lit(float(m.intercept))
        for c, w in zip(spec.features(), m.raw):
            eta = eta + F.lit(float(w)) * F.col(c)
        gap = F.col(Y) - (F.exp(eta) if m.link == "log" else eta)
        names = ["intercept", *spec.features()]
        parts = [F.avg(gap)] + [F.avg(gap * F.col(c)) - F.lit(penalty * float(w)) / F.count(F.lit(1))
                                for c, w in zip(spec.features(), m.raw)]
        cells = F.array(*[F.struct(F.lit(i).alias("window"), F.lit(n).alias("feature"),
                                   (F.round(x, digits) + 0.0).alias("residual")) for n, x in zip(names, parts)])
        one = frame.where(F.col("segment") >= i).agg(cells.alias("c")).select(F.inline("c"))
        out = one if out is None else out.unionByName(one)
    return out


@query("ridge_normal_equations", _zeros(["intercept", *WIDE.features()]))
def ridge_normal_equations(spark, sf):
    """The fitted ridge solves its normal equations, recomputed from the rows, in every window."""
    frame = r.lag_frame(b.panel(spark, sf), WIDE, WINDOWS)
    models = r.fit_ridge_windows(r.products(frame, WIDE), WINDOWS, 10.0)
    return _residuals(frame, WIDE, models, 10.0, 6)


@query("poisson_score_equations", _zeros(["intercept", *WIDE.features()]))
def poisson_score_equations(spark, sf):
    """The fitted Poisson regression solves its score equations in every window."""
    panel = b.panel(spark, sf)
    return _residuals(r.lag_frame(panel, WIDE, WINDOWS), WIDE, r.poisson_backtest(panel, WIDE, WINDOWS)[1], 0.0, 3)


@query("per_series_function", with_panel("""
SELECT unique_id, count(*) AS n, CAST(max(y) - min(y) AS DOUBLE) AS span FROM panel GROUP BY 1"""))
def per_series_function(spark, sf):
    """A user's pandas function over one series at a time."""
    import pandas as pd
    return r.apply_per_series(b.panel(spark, sf), lambda pdf: pd.DataFrame(
        {ID: [pdf[ID].iloc[0]], "n": [len(pdf)], "span": [float(pdf[Y].max() - pdf[Y].min())]}),
        f"{ID} string, n bigint, span double")


@query("local_poisson_backtest")
def local_poisson_backtest(spark, sf):
    return r.local_backtest(b.panel(spark, sf), WIDE, WINDOWS, "poisson", 1.0)


@query("global_poisson_backtest")
def global_poisson_backtest(spark, sf):
    return r.poisson_backtest(b.panel(spark, sf), WIDE, WINDOWS)[0]


TREES = r.LagSpec(lags=(1, 7), rolling=(7, 28))


@query("tweedie_trees_backtest")
def tweedie_trees_backtest(spark, sf):
    """Default settings: up to 100 rounds, all windows."""
    return boosting.tweedie_backtest(b.panel(spark, sf), TREES, WINDOWS)[0]


@query("tweedie_trees_forecast")
def tweedie_trees_forecast(spark, sf):
    return boosting.tweedie_forecast(b.panel(spark, sf), TREES, 14)[0]


@query("tree_importance_by_fold")
def tree_importance_by_fold(spark, sf):
    """Split counts by fold."""
    panel = b.panel(spark, sf)
    fitted = boosting.tweedie_backtest(panel, TREES, WINDOWS)[1]
    return boosting.split_importance(panel, TREES, fitted, r.fold_names(panel, WINDOWS))


CALENDAR_ONLY = r.LagSpec(lags=(), rolling=())


def _first_tree_sql() -> str:
    """Gradient sums of every indicator at the mean, the split of largest gain and its Newton leaves (power 1.5)."""
    flags = [(f"weekday_{d}", f"isodow(ds) = {i + 1}") for i, d in enumerate(r.WEEKDAYS) if i]
    flags += [(f"month_{m}", f"month(ds) = {m}") for m in r.MONTHS[1:]]
    sides = " UNION ALL ".join(f"""
SELECT i, '{n}' AS feature, coalesce(sum(g) FILTER (NOT ({c})), 0) AS gl, coalesce(sum(h) FILTER (NOT ({c})), 0) AS hl,
  coalesce(sum(g) FILTER ({c}), 0) AS gr, coalesce(sum(h) FILTER ({c}), 0) AS hr FROM gh GROUP BY i""" for n, c in flags)
    return with_panel("""
SELECT i AS "window", feature, round(-gl / hl, 6) AS left_value, round(-gr / hr, 6) AS right_value FROM s
QUALIFY row_number() OVER (PARTITION BY i ORDER BY gl * gl / hl + gr * gr / hr DESC) = 1""", more=f"""
pos AS MATERIALIZED (SELECT unique_id, ds, y, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS p,
  count(*) OVER (PARTITION BY unique_id) AS n FROM panel),
w AS (SELECT i, ds, y::DOUBLE AS y, avg(y) OVER (PARTITION BY i) AS m FROM pos, (SELECT unnest(range(3))::INTEGER AS i) WHERE p <= n - 28 - 28 * i),
gh AS MATERIALIZED (SELECT i, ds, sqrt(m) - y / sqrt(m) AS g, 0.5 * y / sqrt(m) + 0.5 * sqrt(m) AS h FROM w),
s AS (SELECT * FROM ({sides}) WHERE hl > 0 AND hr > 0)""")


@query("first_newton_tree", _first_tree_sql())
def first_newton_tree(spark, sf):
    """The first split of boosted trees on the calendar alone, and its two leaves, in every window."""
    frame = boosting.prepared_frame(b.panel(spark, sf), CALENDAR_ONLY, WINDOWS)
    fitted = boosting.fit_many([frame], [boosting.Setting(0, i, n_rounds=1, depth=1) for i in range(3)], WINDOWS)
    rows = [(i, frame.features[t.feature[0]], float(t.value[t.left[0]]), float(t.value[t.right[0]]))
            for i, t in enumerate(e.trees[0] for e in fitted)]
    return spark.createDataFrame(rows, "window int, feature string, left_value double, right_value double")


@query("tree_random_search")
def tree_random_search(spark, sf):
    return search.random_search(b.panel(spark, sf), SURVEYED, "TweedieGBT")


@query("ridge_importance_by_fold")
def ridge_importance_by_fold(spark, sf):
    panel = with_snap(spark, sf)
    prod = r.products(r.lag_frame(panel, FULL, WINDOWS), FULL)
    fitted = r.fit_ridge_windows(prod, WINDOWS, 1.0)
    return r.importance_summary(r.ridge_importance(panel, FULL, fitted, r.fold_names(panel, WINDOWS)))


@query("ridge_random_search")
def ridge_random_search(spark, sf):
    return search.random_search(b.panel(spark, sf), SURVEYED, "Ridge")


@query("train_and_evaluate")
def train_and_evaluate_query(spark, sf):
    """Search, refit, baselines and all metrics of the pooled ridge and the boosted trees."""
    return train_and_evaluate(b.panel(spark, sf), SURVEYED, n_trials=20).metrics
