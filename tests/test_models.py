"""Models against NumPy, a step-by-step loop, and the properties their losses must have."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import boosting, metrics, search
from demandgrid.operators import regression as r
from demandgrid.operators.backtest import Windows, baseline_backtest, windowed
from demandgrid.plans.training import train_and_evaluate
from demandgrid.sources import files

H = 7


@pytest.fixture(scope="module")
def panel(spark):
    """Seasonal panel: trend 10 to 20, weekly wave, noise; a price column with off-sale days."""
    rng = np.random.default_rng(42)
    rows = []
    for s in range(5):
        for j in range(100):
            y = max(0.0, 10 + j / 10 + 5 * np.sin(2 * np.pi * j / 7) + rng.normal()) * (rng.random() > 0.1)
            price = 0.0 if rng.random() < 0.2 else float(np.round(2 + rng.random(), 2))
            rows.append((f"series_{s}", dt.date(2023, 1, 1) + dt.timedelta(j), float(y), price, int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, price double, snap int").repartition(6)


SPEC = r.LagSpec(lags=(1, 7), rolling=(7,), month=False, counters=True, price="price", exog=("snap",))
WIN = Windows(H, 2)


def plain_ridge(x, y, alpha):
    xm, ym = x.mean(0), y.mean()
    xc = x - xm
    coef = np.linalg.solve(xc.T @ xc + alpha * np.eye(x.shape[1]), xc.T @ (y - ym))
    return ym - coef @ xm, coef


def scaled(x, train, names):
    z = x.copy()
    for j, n in enumerate(names):
        if n == "price":
            on = train[:, j] > 0
            m, s = train[on, j].mean(), train[on, j].std()
            z[:, j] = np.where(x[:, j] > 0, (x[:, j] - m) / s, x[:, j])
        elif n in (r.SINCE_SALE, r.SINCE_ZERO):
            z[:, j] = (x[:, j] - train[:, j].mean()) / train[:, j].std()
    return z


def test_ridge_from_products_equals_numpy(panel):
    frame = r.lag_frame(panel, SPEC, WIN)
    fitted = r.fit_ridge_windows(r.products(frame, SPEC), WIN, 2.5)
    pdf = frame.toPandas()
    names = SPEC.features()
    for i in range(2):
        part = pdf[pdf.segment >= i]
        x, y = part[names].to_numpy(float), part[Y].to_numpy(float)
        b0, b = plain_ridge(scaled(x, x, names), y, 2.5)
        assert fitted[i].scaled_intercept == pytest.approx(b0, rel=1e-6)
        assert fitted[i].scaled == pytest.approx(b, rel=1e-6, abs=1e-8)
        on = (x[:, names.index("price")] > 0).astype(float)
        assert fitted[i].predict(x, on) == pytest.approx(b0 + scaled(x, x, names) @ b, rel=1e-6)


def test_library_ridge_agrees_and_reloads(panel, tmp_path):
    spec = r.LagSpec(lags=(1, 7), rolling=(7,), month=False)
    frame = r.lag_frame(panel, spec)
    model = r.fit_ridge(frame, spec, 3.0)
    own = r.solve_ridge(r.products(frame, spec).by_segment[0], spec, 3.0, scale=False)
    assert model.stages[-1].coefficients.toArray() == pytest.approx(own.scaled, rel=1e-6, abs=1e-8)
    files.save_model(model, str(tmp_path / "ridge"))
    again = files.load_model(str(tmp_path / "ridge"))
    assert again.stages[-1].intercept == model.stages[-1].intercept


def test_recursion_equals_a_loop(panel):
    """Each step of the backtest recomputed row by row from the growing history."""
    pred, fitted = r.ridge_backtest(panel, SPEC, WIN, 2.5)
    got = pred.toPandas().set_index([ID, "cutoff", DS])["Ridge"]
    pdf = panel.toPandas().sort_values([ID, DS])
    names = SPEC.features()
    for name, one in pdf.groupby(ID):
        one = one.reset_index(drop=True)
        for i in range(2):
            cut = len(one) - H - i * H
            hist = one.y[:cut].tolist()
            for s in range(H):
                row = one.loc[cut + s]
                a = b = 0
                for v in hist:
                    a, b = (0, b + 1) if v > 0 else (a + 1, 0)
                last7 = np.array(hist[-7:])
                known = {"lag1": hist[-1], "lag7": hist[-7], "rolling_mean_lag1_window_size7": last7.mean(),
                         "rolling_std_lag1_window_size7": last7.std(ddof=1), r.SINCE_SALE: a, r.SINCE_ZERO: b,
                         "price": row.price, "snap": row.snap,
                         **{f"weekday_{d}": float(row.ds.weekday() == k) for k, d in enumerate(r.WEEKDAYS)}}
                x = np.array([[known[n] for n in names]])
                hat = fitted[i].predict(x, np.array([float(row.price > 0)]))[0]
                assert got[(name, one.ds[cut - 1], row.ds)] == pytest.approx(hat, rel=1e-8)
                hist.append(hat)


def test_future_target_never_reaches_the_model(panel):
    cut = dt.date(2023, 1, 1) + dt.timedelta(99 - H)
    other = panel.withColumn(Y, F.when(F.col(DS) > cut, F.lit(999.0)).otherwise(F.col(Y)))
    one = Windows(H, 1)
    a = r.ridge_backtest(panel, SPEC, one)[0].orderBy(ID, DS).select("Ridge").collect()
    b = r.ridge_backtest(other, SPEC, one)[0].orderBy(ID, DS).select("Ridge").collect()
    assert a == b


def test_expanding_windows(panel):
    win = windowed(panel, Windows(H, None, step=10, initial=50), 7).groupBy(ID).agg(
        F.sort_array(F.collect_list("n_train")).alias("n")).collect()
    assert all(x.n == [50, 60, 70, 80, 90] for x in win)


def test_expanding_training_segments(panel):
    win = Windows(H, 3, step=10, initial=50)
    frame = r.lag_frame(panel, r.LagSpec(lags=(1,), rolling=(), weekday=False, month=False), win)
    n = {s: c for s, c in frame.groupBy("segment").count().collect()}
    assert (n[0], n[1], n[2]) == (49 * 5, 50, 50)
    pred, _ = r.ridge_backtest(panel, r.LagSpec(lags=(1,), rolling=(), weekday=False, month=False), win)
    assert pred.count() == 5 * 3 * H


def test_local_models(panel):
    spec = r.LagSpec(lags=(1, 7), rolling=(7,), month=False)
    lin = r.local_backtest(panel, spec, WIN, "linear", 0.5)
    assert lin.count() == 5 * 2 * H and lin.where(F.col("Local").isNull()).isEmpty()
    poi = r.local_backtest(panel, spec, Windows(H, 1), "poisson", 1.0)
    assert poi.where(F.col("Local") <= 0).isEmpty()


def test_local_linear_equals_numpy(panel):
    spec = r.LagSpec(lags=(1,), rolling=(), weekday=False, month=False)
    got = r.local_backtest(panel, spec, Windows(1, 1)).orderBy(ID).collect()
    for row in got:
        y = panel.where(F.col(ID) == row.unique_id).orderBy(DS).toPandas().y.to_numpy()[:-1]
        slope, icpt = np.polyfit(y[:-1], y[1:], 1)
        assert row.Local == pytest.approx(icpt + slope * y[-1], rel=1e-6)


def test_global_poisson_beats_zero(panel):
    pred, _ = r.poisson_backtest(panel, r.LagSpec(lags=(1, 7), rolling=(7,), month=False), Windows(H, 1))
    both = metrics.evaluate(pred.withColumn("Zero", F.lit(0.0)), ["Poisson", "Zero"]).toPandas().set_index("model")
    assert both.mae["Poisson"] < both.mae["Zero"] / 2


def test_tweedie_trees(panel):
    spec = r.LagSpec(lags=(1, 7), rolling=(7,), month=False)
    win = Windows(H, 1)
    pred, fitted = boosting.tweedie_backtest(panel, spec, win, n_rounds=8, rate=0.4, depth=3, checkpoint_every=3)
    losses = fitted[0].losses
    assert all(b < a for a, b in zip(losses, losses[1:]))
    base = baseline_backtest(panel, win)
    out = metrics.evaluate(pred.join(base.drop(Y), [ID, DS, "cutoff"]), ["TweedieGBT", "ZeroModel"]).toPandas().set_index("model")
    assert out.mae["TweedieGBT"] < out.mae["ZeroModel"] / 2
    rows = boosting.split_importance(panel, spec, fitted, r.fold_names(panel, win))
    assert rows.agg(F.sum("value")).first()[0] > 0


def test_tree_arrays_equal_library_predictions(panel):
    spec = r.LagSpec(lags=(1, 7), rolling=(), weekday=False, month=False)
    rows = VectorAssembler(inputCols=spec.features(), outputCol="features").transform(r.lag_frame(panel, spec))
    from pyspark.ml.regression import DecisionTreeRegressor
    model = DecisionTreeRegressor(labelCol=Y, maxDepth=4).fit(rows)
    pdf = model.transform(rows).select("lag1", "lag7", "prediction").toPandas()
    assert boosting.Tree.of(model).predict(pdf[["lag1", "lag7"]].to_numpy()) == pytest.approx(pdf.prediction.to_numpy())


def test_first_newton_tree_is_minus_g_over_h(panel):
    """A depth-0 boost from the mean moves nowhere: the mean already balances the gradient."""
    spec = r.LagSpec(lags=(1,), rolling=(), weekday=False, month=False)
    rows = VectorAssembler(inputCols=spec.features(), outputCol="features").transform(r.lag_frame(panel, spec))
    fit = boosting.fit_tweedie(rows.select(Y, "features"), n_rounds=1, depth=0, rate=1.0)
    assert fit.trees[0].value[0] == pytest.approx(0.0, abs=1e-9)


def test_random_search_is_repeatable_and_ranked(panel):
    a = search.random_search(panel, WIN, "Ridge", 4, seed=7)
    rows = a.collect()
    assert [x.score for x in rows] == sorted(x.score for x in rows) and rows[0].score_name == "mae"
    again = search.random_search(panel, WIN, "Ridge", 4, seed=7).collect()
    assert [x.params for x in rows] == [x.params for x in again]
    best = search.best_trial(a)
    spec, params = search.chosen("Ridge", best, r.LagSpec())
    pred, _ = r.ridge_backtest(panel, spec, WIN, **params)
    assert metrics.evaluate(pred, ["Ridge"]).first().mae == pytest.approx(best["score"])
    assert search.chosen("Ridge", None, SPEC) == (SPEC, {"alpha": 1.0})


def test_search_space_bounds():
    for t in search.draw("TweedieGBT", 50, 1):
        p = t["params"]
        assert 0.01 <= p["rate"] <= 0.3 and 100 <= p["n_rounds"] <= 1000 and 3 <= p["depth"] <= 8 and 1.4 <= p["power"] <= 1.9


def test_train_and_evaluate(panel, tmp_path):
    out = train_and_evaluate(panel, Windows(H, 2), ["Ridge", "TweedieGBT"], r.LagSpec(lags=(1, 7), rolling=(7,), month=False),
                             params={"TweedieGBT": {"n_rounds": 3, "depth": 2, "rate": 0.5}}, save_to=str(tmp_path / "run"))
    m = out.metrics.toPandas().set_index("model")
    assert set(m.index) == {"Ridge", "TweedieGBT", "Naive", "SeasonalNaive", "ZeroModel"}
    assert m.mae["Ridge"] < m.mae["ZeroModel"] and m.mase["SeasonalNaive"] == 1
    assert out.predictions.count() == 5 * 2 * H
    assert panel.sparkSession.read.json(str(tmp_path / "run" / "metrics.json")).count() == 5
    table = r.importance_table(r.ridge_importance(panel, SPEC, r.fit_ridge_windows(
        r.products(r.lag_frame(panel, SPEC, WIN), SPEC), WIN, 1.0), r.fold_names(panel, WIN)), sorted(r.fold_names(panel, WIN).values()))
    assert table.count() == len(SPEC.features()) + 1 and len(table.columns) == 3


def test_apply_per_series(panel):
    got = r.apply_per_series(panel.select(ID, Y), lambda p: pd.DataFrame({"id": [p[ID].iloc[0]], "n": [len(p)]}), "id string, n long")
    assert {x.n for x in got.collect()} == {100}
