"""Baselines, validation windows, metrics and forecast reports with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import query, with_panel
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import backtest as bt
from demandgrid.operators import joins, profile, ranking
from demandgrid.operators import metrics as m

H, N = 28, 3
MODELS = ["Naive", "SeasonalNaive", "ZeroModel"]


def _windows_sql(cut: str, many: str) -> str:
    """Predictions of the first ``many`` windows; ``cut`` gives the training rows of window i of a series of n rows."""
    return f"""
seq AS (SELECT unique_id, list(ds ORDER BY ds) AS dss, list(y::DOUBLE ORDER BY ds) AS ys, count(*) AS n FROM panel GROUP BY 1),
cuts AS (SELECT *, {cut} AS c FROM (SELECT *, unnest(range(0, {many})) AS i FROM seq) WHERE {cut} > 0 AND {cut} + {H} <= n),
pred AS (SELECT unique_id, dss[c + k] AS ds, dss[c] AS cutoff, ys[c + k]::BIGINT AS y, ys[c] AS "Naive",
  ys[c - 6 + (k - 1) % 7] AS "SeasonalNaive", 0::DOUBLE AS "ZeroModel" FROM (SELECT *, unnest(range(1, {H} + 1)) AS k FROM cuts))"""


PRED_CTE = _windows_sql(f"n - {H} - i * {H}", str(N))
FIT_CTE = """
fit AS (SELECT unique_id, ds, y, lag(y) OVER w ::DOUBLE AS "Naive", lag(y, 7) OVER w ::DOUBLE AS "SeasonalNaive", 0::DOUBLE AS "ZeroModel"
  FROM panel WINDOW w AS (PARTITION BY unique_id ORDER BY ds))"""


def predictions(spark, sf):
    return bt.baseline_backtest(b.panel(spark, sf), bt.Windows(H, N))


@query("baseline_backtest", with_panel("SELECT * FROM pred", more=PRED_CTE))
def baseline_backtest(spark, sf):
    return predictions(spark, sf)


@query("expanding_windows", with_panel("SELECT * FROM pred", more=_windows_sql("730 + 30 * i", f"(n - {H} - 730) // 30 + 1")))
def expanding_windows(spark, sf):
    return bt.baseline_backtest(b.panel(spark, sf), bt.Windows(H, None, step=30, initial=730))


@query("overlapping_windows", with_panel("SELECT * FROM pred", more=_windows_sql(f"n - {H} - i * 7", "5")))
def overlapping_windows(spark, sf):
    return bt.baseline_backtest(b.panel(spark, sf), bt.Windows(H, 5, step=7))


@query("baseline_forecast", with_panel("""
SELECT unique_id, CAST(dss[n] + CAST(k + 1 AS INTEGER) AS DATE) AS ds, ys[n] AS "Naive", ys[n - 6 + k % 7] AS "SeasonalNaive", 0::DOUBLE AS "ZeroModel"
FROM (SELECT *, unnest(range(0, 31)) AS k FROM seq)""", more=PRED_CTE))
def baseline_forecast(spark, sf):
    return bt.forecast_baselines(b.panel(spark, sf), 31)


@query("baseline_fitted", with_panel("SELECT * FROM fit", more=FIT_CTE))
def baseline_fitted(spark, sf):
    return bt.fitted_baselines(b.panel(spark, sf))


# ---------------------------------------------------------------- metrics

def _metric_cols(p: str, ae_nz: str = "y > 0 AND p > 0", mrae_else: str = "NULL") -> str:
    f1 = "2.0::DOUBLE * count(*) FILTER (y = 0 AND p = 0) / nullif(2 * count(*) FILTER (y = 0 AND p = 0) + count(*) FILTER (y <> 0 AND p = 0) + count(*) FILTER (y = 0 AND p <> 0), 0)"
    return f"""round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(avg(abs(y - p)) / nullif(avg(abs(y - "SeasonalNaive")), 0), 6) AS mase,
  round(sqrt(avg((y - p) * (y - p))) / nullif(sqrt(avg((y - "SeasonalNaive") * (y - "SeasonalNaive"))), 0), 6) AS rmsse,
  round(coalesce(avg(abs(y - p)) / nullif(avg(abs(y)), 0), {mrae_else}), 6) AS mrae, round(coalesce({f1}, 0), 6) AS f1_zero,
  round(avg(abs(y - p)) FILTER ({ae_nz}), 6) AS non_zero_mae"""


LONG = "long AS (SELECT unique_id, ds, cutoff, y, \"SeasonalNaive\", model, p FROM (" + " UNION ALL ".join(
    f"SELECT *, '{x}' AS model, \"{x}\" AS p FROM pred" for x in MODELS) + "))"
MORE = f"{PRED_CTE},\n{LONG}"


def _eval(by: str = "", **kw) -> str:
    keys = f"{by}, " if by else ""
    return f"SELECT {keys}model, {_metric_cols('p', **kw)} FROM long GROUP BY {keys}model"


@query("evaluate_overall", with_panel(_eval(), more=MORE))
def evaluate_overall(spark, sf):
    return m.evaluate(predictions(spark, sf), MODELS)


@query("evaluate_notebook_rules", with_panel(
    _eval(ae_nz="y > 0", mrae_else="avg(abs(y - p))").replace(" AS non_zero_mae", " AS non_zero_mae, round(avg(abs(y - p) / nullif(abs(y), 0)), 6) AS mape"), more=MORE))
def evaluate_notebook_rules(spark, sf):
    return m.evaluate(predictions(spark, sf), MODELS, non_zero="actual", mrae_fallback=True, mape=True)


for _name, _by in (("series", "unique_id"), ("cutoff", "cutoff"), ("series_and_cutoff", "unique_id, cutoff")):
    @query(f"evaluate_by_{_name}", with_panel(_eval(_by), more=MORE))
    def _evaluate(spark, sf, by=tuple(_by.split(", "))):
        return m.evaluate(predictions(spark, sf), MODELS, by)


@query("evaluate_all_grains", with_panel(" UNION ALL ".join(
    f"SELECT '{g}' AS grain, {i} AS unique_id, {c} AS cutoff, model, {_metric_cols('p')} FROM long GROUP BY ALL"
    for g, i, c in (("all", "NULL", "NULL::DATE"), ("series", "unique_id", "NULL::DATE"), ("cutoff", "NULL", "cutoff"),
                    ("series_cutoff", "unique_id", "cutoff"))), more=MORE))
def evaluate_all_grains(spark, sf):
    return m.evaluate_grid(predictions(spark, sf), MODELS)


@query("metrics_wide", with_panel("SELECT cutoff, " + ", ".join(
    f"max({x}) FILTER (model = '{mo}') AS \"{mo}_{x}\"" for mo in MODELS for x in m.METRICS)
    + f" FROM ({_eval('cutoff')}) GROUP BY 1", more=MORE))
def metrics_wide(spark, sf):
    return m.metrics_wide(m.evaluate(predictions(spark, sf), MODELS, ["cutoff"]), MODELS, ["cutoff"])


def _scaled_sql(keys: str) -> str:
    k = f"{keys}, " if keys else ""
    return f"""
SELECT {k}model, round(mae / sm, 6) AS mase, round(rmse / sr, 6) AS rmsse FROM (
  SELECT {k}model, max(cutoff) AS mc, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse FROM long GROUP BY {k}model) g
JOIN (SELECT c, avg(abs(y - "SeasonalNaive")) AS sm, sqrt(avg((y - "SeasonalNaive") * (y - "SeasonalNaive"))) AS sr
  FROM (SELECT DISTINCT cutoff AS c FROM pred) JOIN fit ON ds <= c WHERE "SeasonalNaive" IS NOT NULL GROUP BY 1) ON c = mc"""


for _name, _by in (("", []), ("_by_cutoff", ["cutoff"]), ("_by_series", [ID])):
    @query(f"in_sample_scaled{_name}", with_panel(_scaled_sql(", ".join(_by)), more=f"{MORE},{FIT_CTE}"))
    def _scaled(spark, sf, by=tuple(_by)):
        panel = b.panel(spark, sf)
        return m.in_sample_scaled(predictions(spark, sf), bt.fitted_baselines(panel), MODELS, by)


@query("against_baselines", with_panel(f"""
SELECT model, mae, rmse, """ + ", ".join(
    f"round(CASE WHEN (SELECT {x} FROM e WHERE model = '{mo}') > 0 THEN {x}_raw / (SELECT {x}_raw FROM e WHERE model = '{mo}') ELSE {x}_raw END, 6) AS \"{x}_vs_{mo}\""
    for mo in MODELS for x in ("mae", "rmse")) + " FROM e", more=MORE + """,
e AS (SELECT model, avg(abs(y - p)) AS mae_raw, sqrt(avg((y - p) * (y - p))) AS rmse_raw, round(avg(abs(y - p)), 6) AS mae,
  round(sqrt(avg((y - p) * (y - p))), 6) AS rmse FROM long GROUP BY 1)"""))
def against_baselines(spark, sf):
    return m.against_baselines(m.evaluate(predictions(spark, sf), MODELS), MODELS)


@query("change_scaled_comparison", with_panel("""
SELECT model, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse, round(avg(abs(y - p)) / a, 6) AS mase,
  round(sqrt(avg((y - p) * (y - p))) / s, 6) AS rmsse, round(avg(abs(y - p)) / avg(y), 6) AS mrae
FROM long, (SELECT avg(d) AS a, sqrt(avg(d * d)) AS s FROM (
  SELECT abs(y - lag(y) OVER (PARTITION BY unique_id, cutoff ORDER BY ds)) AS d FROM pred)) GROUP BY model, a, s""", more=MORE))
def change_scaled_comparison(spark, sf):
    return m.change_scaled(predictions(spark, sf), MODELS)


@query("best_metrics", with_panel(f"""
SELECT min(mae) AS best_mae, min(rmse) AS best_rmse, min(mase) AS best_mase, arg_min(model, mae) AS best_model FROM ({_eval()})""", more=MORE))
def best_metrics(spark, sf):
    return m.best_metrics(m.evaluate(predictions(spark, sf), MODELS))


@query("model_comparison", with_panel("SELECT model, " + ", ".join(f"round(avg({x}), 6) AS {x}" for x in m.METRICS)
                                      + f" FROM ({_eval('cutoff').replace('round(', '(').replace(', 6)', ')')}) GROUP BY 1", more=MORE))
def model_comparison(spark, sf):
    return m.comparison_table(m.evaluate(predictions(spark, sf), MODELS, ["cutoff"]))


@query("top_series_by_error", with_panel(
    f"SELECT unique_id, model, mae FROM ({_eval('unique_id')}) WHERE model = 'SeasonalNaive' ORDER BY mae, unique_id LIMIT 10", more=MORE))
def top_series_by_error(spark, sf):
    return ranking.top_k(m.evaluate(predictions(spark, sf), MODELS, [ID]), "SeasonalNaive", [ID], "mean_absolute_error", 10)


@query("best_and_worst_series", with_panel(" UNION ALL ".join(f"""
SELECT '{end}' AS "end", model, unique_id, mae, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY model ORDER BY mae {o}, unique_id) AS r
FROM ({_eval('unique_id')})) WHERE r <= 5""" for end, o in (("best", "ASC"), ("worst", "DESC"))), more=MORE))
def best_and_worst_series(spark, sf):
    return ranking.top_k_both_ends(m.evaluate(predictions(spark, sf), MODELS, [ID]), [ID], "mae", 5)


@query("top_series_by_mean_metric", with_panel(f"""
SELECT unique_id, round(avg(v), 6) AS mean_value FROM (UNPIVOT (SELECT * EXCLUDE (f1_zero) FROM ({
    _eval('unique_id').replace('round(', '(').replace(', 6)', ')')}) WHERE model = 'Naive')
  ON mae, rmse, mase, rmsse, mrae, non_zero_mae INTO NAME metric VALUE v) GROUP BY 1 ORDER BY avg(v), unique_id LIMIT 3""", more=MORE))
def top_series_by_mean_metric(spark, sf):
    long = m.metrics_long(m.evaluate(predictions(spark, sf), MODELS, [ID]), [ID])
    return ranking.top_k_by_mean(long, "Naive", [ID], 3)


# ---------------------------------------------------------------- joins and reports on predictions

@query("predictions_combined", with_panel("""
SELECT unique_id, ds, cutoff, y::DOUBLE AS y, "Naive" + 1 AS "Shifted", "Naive", "SeasonalNaive", "ZeroModel" FROM pred""", more=PRED_CTE))
def predictions_combined(spark, sf):
    base = predictions(spark, sf)
    model = base.select(ID, DS, "cutoff", Y, (F.col("Naive") + 1).alias("Shifted"))
    return joins.combine_predictions(model, base, check=True)


@query("models_joined", with_panel("SELECT * FROM pred", more=PRED_CTE))
def models_joined(spark, sf):
    base = predictions(spark, sf)
    return joins.join_models({x: base.select(ID, DS, "cutoff", Y, x) for x in MODELS})


def _period(freq: str) -> str:
    return {"D": "ds", "W": "CAST(ds + CAST((7 - isodow(ds)) AS INTEGER) AS DATE)", "M": "last_day(ds)"}[freq]


for _f in "DWM":
    for _h, _fn in (("sum", "sum({c})"), ("mean", "avg({c})"), ("median", "quantile_cont({c}, 0.5)")):
        if (_f, _h) not in (("D", "sum"), ("W", "mean"), ("M", "sum"), ("W", "median")):
            continue

        @query(f"forecast_by_period_{_f}_{_h}", with_panel(f"""
SELECT period, round(a, 6) AS actual, round(p, 6) AS predicted, round(a - p, 6) AS error, round(abs(a - p), 6) AS abs_error FROM (
  SELECT {_period(_f)} AS period, {_fn.format(c='y')}::DOUBLE AS a, {_fn.format(c='"SeasonalNaive"')} AS p FROM pred GROUP BY 1)""", more=PRED_CTE))
        def _by_period(spark, sf, freq=_f, how=_h):
            return profile.aggregate_forecast(predictions(spark, sf), "SeasonalNaive", freq, how)


@query("forecast_by_cutoff", with_panel("""
SELECT cutoff, ds AS period, round(a, 6) AS actual, round(p, 6) AS predicted, round(a - p, 6) AS error, round(abs(a - p), 6) AS abs_error FROM (
  SELECT cutoff, ds, avg(y) AS a, avg("Naive") AS p FROM pred GROUP BY 1, 2)""", more=PRED_CTE))
def forecast_by_cutoff(spark, sf):
    return profile.aggregate_forecast(predictions(spark, sf), "Naive", "D", "mean", ["cutoff"])


@query("forecast_fit_weekly", with_panel(f"""
SELECT round(avg(abs(a - p)), 6) AS mae, round(sqrt(avg((a - p) * (a - p))), 6) AS rmse, round(corr(a, p), 6) AS correlation,
  round((sum(p) - sum(a)) * 100 / sum(a), 6) AS bias_pct FROM (
  SELECT {_period('W')} AS period, sum(y)::DOUBLE AS a, sum("SeasonalNaive") AS p FROM pred GROUP BY 1)""", more=PRED_CTE))
def forecast_fit_weekly(spark, sf):
    return profile.forecast_fit(profile.aggregate_forecast(predictions(spark, sf), "SeasonalNaive", "W", "sum"))


@query("residual_statistics", with_panel("""
SELECT unique_id, model, round(avg(abs(y - p)), 6) AS mae, round(sqrt(avg((y - p) * (y - p))), 6) AS rmse,
  round(CASE WHEN stddev_pop(p) > 0 AND stddev_pop(y) > 0 THEN corr(y, p) END, 6) AS correlation, round(avg(y - p), 6) AS mean_residual,
  round(stddev_samp(y - p), 6) AS std_residual, round(avg(CASE WHEN y > p THEN 100.0::DOUBLE ELSE 0 END), 6) AS positive_pct,
  max(abs(y - p)) AS max_abs_residual, count(*) AS n FROM long GROUP BY 1, 2""", more=MORE))
def residual_statistics(spark, sf):
    from demandgrid.functions.core import stack
    return profile.residual_stats(stack(predictions(spark, sf), [ID, DS, "cutoff", Y], MODELS, "model", "y_hat"))


BOX_CTE = """,
e AS (SELECT unique_id, model, avg(abs(y - p)) AS mae FROM long GROUP BY 1, 2),
qs AS (SELECT model, quantile_cont(mae, [0.25, 0.5, 0.75]) AS e FROM e GROUP BY 1),
f AS (SELECT e.model, mae, qs.e[1] AS q1, qs.e[2] AS median, qs.e[3] AS q3,
  mae BETWEEN qs.e[1] - 1.5 * (qs.e[3] - qs.e[1]) AND qs.e[3] + 1.5 * (qs.e[3] - qs.e[1]) AS ok FROM e JOIN qs USING (model))"""


@query("metric_boxes", with_panel("""
SELECT model, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3, round(min(mae) FILTER (ok), 6) AS whisker_low,
  round(max(mae) FILTER (ok), 6) AS whisker_high, count(*) FILTER (NOT ok) AS outliers FROM f GROUP BY 1, 2, 3, 4""", more=MORE + BOX_CTE))
def metric_boxes(spark, sf):
    return profile.box_stats(m.evaluate(predictions(spark, sf), MODELS, [ID]), "mae", ["model"])
