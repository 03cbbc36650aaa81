"""Local models with price and counters against plain least squares, series by series."""

import datetime as dt

import numpy as np
import pytest

from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import regression as r
from demandgrid.operators.backtest import Windows

SPEC = r.LagSpec(lags=(1, 2), rolling=(3,), weekday=False, month=False, counters=True, price="price", exog=("snap",))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(9)
    rows = []
    for s, days in enumerate([60, 45, 80, 12, 3]):
        for j in range(days):
            price = 0.0 if rng.random() < 0.2 else float(np.round(2 + rng.random(), 2))
            rows.append((f"s{s}", dt.date(2023, 1, 1) + dt.timedelta(j), float(rng.poisson(2)), price, int(rng.random() < 0.3)))
    return spark.createDataFrame(rows, "unique_id string, ds date, y double, price double, snap int").repartition(3)


def prepared(train, x):
    """Columns as the models see them: price and counters scaled by the training rows."""
    out = x.copy()
    for i, c in enumerate(SPEC.features()):
        v = train[:, i]
        if c == "price":
            v = v[v > 0]
            out[:, i] = np.where(x[:, i] > 0, (x[:, i] - v.mean()) / (v.std() or 1.0), x[:, i])
        elif c in (r.SINCE_SALE, r.SINCE_ZERO):
            out[:, i] = (x[:, i] - v.mean()) / (v.std() or 1.0)
    return np.column_stack([np.ones(len(x)), out])


@pytest.mark.parametrize("stacked", [1 << 23, 1])
def test_local_models_equal_plain_fits(panel, monkeypatch, stacked):
    monkeypatch.setattr(r, "STACKED", stacked)
    alpha, win = 0.7, Windows(1, 3)
    frame = r.lag_frame(panel, SPEC).toPandas().sort_values([ID, DS])
    lin = {(x[ID], x[DS]): x for x in r.local_backtest(panel, SPEC, win, "linear", alpha).collect()}
    poi = {(x[ID], x[DS]): x for x in r.local_backtest(panel, SPEC, win, "poisson", alpha).collect()}
    seen = 0
    for name, part in frame.groupby(ID):
        x, y, days = part[SPEC.features()].to_numpy(float), part[Y].to_numpy(), part[DS].tolist()
        for i in range(3):
            if len(part) < 10:
                continue
            cut = len(part) - 1 - i
            z = prepared(x[:cut], x)
            pen = alpha * np.diag([0.0] + [1.0] * x.shape[1])
            beta = np.linalg.solve(z[:cut].T @ z[:cut] + pen, z[:cut].T @ y[:cut])
            key = (name, days[cut])
            assert lin[key]["Local"] == pytest.approx(float(z[cut] @ beta), abs=1e-8)
            if poi[key]["converged"]:   # a Newton step from the solution stays there
                eta = np.log(poi[key]["Local"])
                mu, beta = np.maximum(y[:cut], 0.1), np.zeros(z.shape[1])
                for _ in range(200):
                    work = np.log(mu) + (y[:cut] - mu) / mu
                    beta = np.linalg.solve(z[:cut].T @ (z[:cut] * mu[:, None]) + pen, z[:cut].T @ (mu * work))
                    mu = np.exp(np.clip(z[:cut] @ beta, -30, 30))
                assert eta == pytest.approx(float(z[cut] @ beta), abs=1e-6)
                score = z[:cut].T @ (y[:cut] - mu) - pen @ beta
                assert np.abs(score).max() < 1e-6
            seen += 1
    assert seen >= 9 and all(x["Local"] is None for x in lin.values() if x[ID] == "s4")


def test_price_needs_no_future_of_its_own(panel):
    out = r.local_backtest(panel, SPEC, Windows(7, 2)).where("unique_id = 's0'").collect()
    assert len(out) == 14 and all(x["Local"] is not None and np.isfinite(x["Local"]) for x in out)
