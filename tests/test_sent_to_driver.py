"""What the driver takes in of the sums of a fit: no more than one budget, however many steps the trees take."""

import datetime as dt

import numpy as np
import pytest

from demandgrid.operators import boosting
from demandgrid.operators import regression as r
from demandgrid.operators.backtest import Windows
from demandgrid.operators.boosting import Setting
from demandgrid.plans.training import train_and_evaluate

WIN = Windows(7, 2)
SPEC = r.LagSpec(lags=(1, 7), rolling=(7,), month=False)
BUDGET = 100_000


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(5)
    rows = [(f"s{s}", dt.date(2022, 1, 1) + dt.timedelta(j), float(rng.poisson(2 + s + j % 7))) for s in range(4) for j in range(120)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double").cache()


@pytest.fixture
def sums(spark, monkeypatch):
    """Sizes of the tables of sums the driver takes in; a list that grows."""
    taken, kind = [], type(spark.range(0))
    real = kind.toArrow

    def counted(self):
        out = real(self)
        if out.column_names == ["m", "v"]:
            taken.append(out.nbytes)
        return out

    monkeypatch.setattr(kind, "toArrow", counted)
    return taken


def test_sums_of_a_fit_stay_in_one_budget(panel, sums, monkeypatch):
    frame = boosting.prepared_frame(panel, SPEC, WIN)
    settings = [Setting(0, w, depth=4, n_rounds=6, rate=0.3) for w in range(2)]
    whole = boosting.fit_many([frame], settings, WIN, tolerance=0.0)
    assert sum(sums) > 3 * BUDGET   # what there is to add
    sums.clear()
    monkeypatch.setattr(boosting, "GATHERED", BUDGET)
    fitted = boosting.fit_many([frame], settings, WIN, tolerance=0.0)
    assert 0 < sum(sums) <= 1.1 * BUDGET
    for a, b in zip(whole, fitted):   # added in the same order either way
        assert len(a.trees) == len(b.trees) == 6 and a.losses == b.losses
        assert all(np.array_equal(getattr(x, n), getattr(y, n)) for x, y in zip(a.trees, b.trees) for n in ("feature", "threshold", "left", "right", "value"))


def test_search_and_refit_take_a_budget_each(panel, sums, monkeypatch):
    monkeypatch.setattr(boosting, "GATHERED", BUDGET)
    options = {"TweedieGBT": {"lag_choices": ((1, 7),), "rolling_choices": ((7,),), "space": {"n_rounds": (8, 8), "depth": (3, 3), "rate": (0.2, 0.3)}}}
    out = train_and_evaluate(panel, WIN, ["TweedieGBT"], SPEC, n_trials=2, search_options=options)
    assert 0 < sum(sums) <= 2.2 * BUDGET   # the search's fit and the refit
    assert out.trials["TweedieGBT"].count() == 2
    assert {r["model"] for r in out.metrics.collect()} >= {"TweedieGBT"}
