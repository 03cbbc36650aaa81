"""Cases on both sides of what used to be limits, forecasts ahead, saved models."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from demandgrid.functions.core import correlation
from demandgrid.operators import boosting, event_effects, features, intervals, joins, profile, regression
from demandgrid.operators.backtest import Windows
from demandgrid.operators.panel import to_panel
from demandgrid.sources import files

from conftest import values


# ------------------------------------------------------------------ both sides of former limits

def test_correlation_of_large_values_with_small_spread(spark):
    rows = [(float(i), float(2 * i), 1e9 + i * 1e-3, 5.0) for i in range(300)] + [(float("nan"), 1.0, 1.0, 5.0), (None, 2.0, 1.0, 5.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double, flat double").repartition(3)
    for cols in (["a", "b"], ["a", "b", "c", "flat"]):
        got = {(r["a"], r["b"]): r["r"] for r in profile.correlation_matrix(df, cols).collect()}
        assert abs(got["a", "b"] - 1) < 1e-9 and all(v is None or -1 <= v <= 1 for v in got.values())
    near = df.where("c > 1e8")
    assert abs(profile.correlation_matrix(near, ["a", "c"]).first()["r"] - 1) < 1e-6
    assert abs(near.agg(correlation(F.col("a"), F.col("c"))).first()[0] - 1) < 1e-6
    assert abs(df.agg(correlation(F.col("a"), F.col("b"))).first()[0] - 1) < 1e-9
    assert {v for k, v in got.items() if "flat" in k} == {None}


def test_correlated_series_of_any_number(series):
    data = {f"s{i:03d}": [(i * k * k + k) % 11 for k in range(40)] for i in range(230)} | {"flat": [3] * 40}
    got = profile.correlated_series(series(data, 3), 2).collect()
    assert len({r["unique_id"] for r in got} & set(data)) == 230 - sum(len(set(v)) == 1 for k, v in data.items() if k != "flat")
    m = np.corrcoef([data[k] for k in sorted(data) if k != "flat"])
    np.fill_diagonal(m, -2)
    best = {k: m[i].max() for i, k in enumerate(k for k in sorted(data) if k != "flat")}
    assert all(abs(r["r"] - best[r["unique_id"]]) < 1e-9 for r in got if r["rank"] == 1)


def test_histogram_loses_no_row(spark):
    df = spark.createDataFrame([(10.0,), (2e6,), (0.5,), (0.0,), (-3.0,), (None,)], "v double")
    got = {r["bin"]: r["n"] for r in profile.log_histogram(df, "v").collect()}
    assert sum(got.values()) == 5 and got[-1] == 3 and got[99] == 1
    assert {r["bin"]: r["n"] for r in profile.histogram(df, "v", 2, 0.0, 1.0).collect()} == {-1: 1, 0: 1, 1: 1, 2: 2}


def test_more_levels_than_a_thousand(spark):
    df = spark.range(1200).select(F.format_string("l%04d", "id").alias("c"), F.format_string("e%04d", "id").alias("event"))
    assert len(features.OneHotBaseline("c", "l0000").fit(df).levels) == 1200
    assert len(features.BaselineEncoder({"c": "l0000"}).fit(df).encoders["c"].levels) == 1200
    assert len(features.EventFlags().fit(df).events) == 1200


def test_ewm_forgets_nothing(series):
    y = {"a": [1e300, *[0.0] * 80], "b": [2.0]}
    got = values(intervals.ewm_mean(series(y), 0.5), "ewm_lag1_alpha0.5")
    assert got[80] == 1e300 * 0.5 ** 79 and got[81] is None
    assert values(intervals.ewm_mean(series({"a": [1, 2, 3]}), 1.0), "ewm_lag1_alpha1.0") == [None, 1.0, 2.0]
    with pytest.raises(ValueError):
        intervals.ewm_mean(series({"a": [1]}), 0.0)


def test_few_prices_are_said(spark):
    df = spark.createDataFrame([(1.0, 2), (2.0, 4), (0.0, 9)], "sell_price double, y int")
    assert [tuple(r) for r in profile.price_bins(df).collect()] == [(profile.FEW_PRICES, 3.0, 2)]


def test_one_row_panel_and_large_means(series):
    assert profile.panel_summary(series({"a": [7]})).first()["std"] is None
    big = profile.panel_summary(series({"a": [1e9 + (i % 2) * 1e-3 for i in range(200)]}, 3)).first()
    assert abs(big["std"] - np.std([(i % 2) * 1e-3 for i in range(200)], ddof=1)) < 1e-7


def test_event_statistics_of_large_means(spark):
    rows = [(1 if i % 4 == 0 else 0, 1e9 + ((i * 7) % 3) * 1e-3) for i in range(200)]
    got = event_effects.event_tests(spark.createDataFrame(rows, "e int, y double").repartition(4), ["e"]).first()
    on, off = ([v for f, v in rows if f == k] for k in (1, 0))
    pooled = np.sqrt((np.var(on) * len(on) + np.var(off) * len(off)) / 198)
    want = (np.mean(np.array(on) - 1e9) - np.mean(np.array(off) - 1e9)) / (pooled * np.sqrt(1 / len(on) + 1 / len(off)))
    assert abs(got["t_stat"] - want) < 0.02


def test_source_with_the_panels_own_names(spark):
    df = spark.createDataFrame([("x", "2020-01-01", "a"), ("x", "2020-01-01", "b")], "k string, ds string, unique_id string")
    got = [tuple(map(str, r)) for r in to_panel(df, F.col("k"), F.to_date("ds")).collect()]
    assert got == [("x", "2020-01-01", "2")]


def test_forecast_ahead_and_saved_models(series, spark, tmp_path):
    panel = series({"a": [float(i % 7) for i in range(60)], "b": [float((i * 3) % 5) for i in range(60)], "short": [1.0, 2.0]})
    spec = regression.LagSpec(lags=(1, 7), rolling=(7,), month=False, counters=True, exog=("x",))
    known = panel.withColumn("x", F.dayofmonth("ds").cast("double"))
    future = spark.sql("SELECT explode(sequence(DATE '2020-01-01', DATE '2020-04-01')) AS ds").withColumn("x", F.dayofmonth("ds").cast("double"))
    got, model = regression.ridge_forecast(known, spec, 5, 1.0, future)
    rows = {(r["unique_id"], str(r["ds"])): r["Ridge"] for r in got.collect()}
    assert len(rows) == 15 and all((v is None) == (k[0] == "short") for k, v in rows.items())
    files.save_fitted(spark, {0: model}, spec, str(tmp_path / "m"))
    models, spec2 = files.load_fitted(spark, str(tmp_path / "m"))
    assert spec2 == spec
    again = regression.forecast(known, spec2, 5, {"Ridge": regression.linear_predictor(models)}, future).collect()
    assert {(r["unique_id"], str(r["ds"])): r["Ridge"] for r in again} == rows
    with pytest.raises(ValueError):
        regression.forecast(known, spec, 5, {})
    trees = boosting.TweedieEnsemble(0.5, 0.1, [boosting.Tree(*map(np.array, ([0, -1, -1], [1.5, 0, 0], [1, -1, -1], [2, -1, -1], [0.0, 1.0, 2.0])))], [1.0])
    files.save_fitted(spark, {1: trees}, spec, str(tmp_path / "t"))
    back = files.load_fitted(spark, str(tmp_path / "t"))[0][1]
    x = np.array([[1.0], [2.0]])
    assert np.array_equal(back.predict(x), trees.predict(x))


def test_local_models_name_what_they_cannot_do(series):
    spec = regression.LagSpec(lags=(1, 7), rolling=(7,), weekday=False, month=False)
    got = regression.local_backtest(series({"a": [float(i % 5 + 1) for i in range(60)], "b": [1.0] * 8}), spec, Windows(5, 1), "poisson", 0.1).collect()
    assert {r["unique_id"]: (r["Local"] is None, r["converged"]) for r in got} == {"a": (False, True), "b": (True, False)}


def test_predictions_of_other_cutoffs_are_refused(spark):
    cols = "unique_id string, ds date, cutoff date, y double"
    a = spark.sql("SELECT 'a' AS unique_id, DATE '2020-01-02' AS ds, DATE '2020-01-01' AS cutoff, 1.0D AS y, 2.0D AS M")
    b = a.selectExpr("unique_id", "ds", "cutoff", "y + 1e-12 AS y", "3.0D AS N")
    assert joins.combine_predictions(a, b, check=True).count() == 1, cols
    with pytest.raises(ValueError):
        joins.combine_predictions(a, b.withColumn("cutoff", F.date_add("cutoff", 1)), check=True)


def test_a_day_outside_the_calendar(spark):
    from demandgrid.plans import dataset
    cal = spark.sql("SELECT DATE '2020-01-01' AS date, 'd_1' AS d")
    sales = spark.sql("SELECT 'i' AS item_id, 's' AS store_id, 'D' AS dept_id, 1 AS d_1")
    with pytest.raises(ValueError, match="2020-01-05"):
        dataset.prepare_sales(sales, cal, None, None, "2020-01-01", "2020-01-05", "2020-01-01")


def test_files_with_another_column_order_are_refused(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p/a.csv").write_text("store_id,item_id,wm_yr_wk,sell_price\ns,i,1,2.5\n")
    (tmp_path / "p/b.csv").write_text("item_id,store_id,wm_yr_wk,sell_price\ni,s,1,2.5\n")
    with pytest.raises(Exception, match="header"):
        files.read_prices(spark, str(tmp_path / "p")).collect()
