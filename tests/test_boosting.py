"""Trees grown side by side: against library trees, alone or together, after a kill, and by either way of adding sums."""

import datetime as dt

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import DecisionTreeRegressor
from pyspark.sql import functions as F

from demandgrid.functions.core import Y
from demandgrid.operators import boosting
from demandgrid.operators import regression as r
from demandgrid.operators.backtest import Windows
from demandgrid.operators.boosting import Setting

WIN = Windows(7, 2)
SPEC = r.LagSpec(lags=(1, 7), rolling=(7,))


@pytest.fixture(scope="module")
def panel(spark):
    rng = np.random.default_rng(3)
    rows = [(f"s{s}", dt.date(2022, 1, 1) + dt.timedelta(j), float(rng.poisson(2 + s + 2 * np.sin(2 * np.pi * j / 7) ** 2)))
            for s in range(5) for j in range(150)]
    return spark.createDataFrame(rows, "unique_id string, ds date, y double").cache()


@pytest.fixture(scope="module")
def frame(panel):
    return boosting.prepared_frame(panel, SPEC, WIN)


def same(a, b):
    return len(a.trees) == len(b.trees) and all(np.array_equal(getattr(x, n), getattr(y, n)) if n != "value" else np.allclose(x.value, y.value)
                                               for x, y in zip(a.trees, b.trees) for n in ("feature", "threshold", "value"))


def library_loss(rows, features, rate, n_rounds, depth, power):
    """The same boosting with one library tree a round; mean loss at its end."""
    state = VectorAssembler(inputCols=features, outputCol="features").transform(rows).select("features", Y)
    start = float(np.log(state.agg(F.avg(Y)).first()[0]))
    state, f, y = state.withColumn("f", F.lit(start)), F.col("f"), F.col(Y)
    a, b = F.exp((1 - power) * f), F.exp((2 - power) * f)
    g, h = -y * a + b, (power - 1) * y * a + (2 - power) * b
    for _ in range(n_rounds):
        step = state.withColumn("target", -g / h).withColumn("weight", h)
        tree = DecisionTreeRegressor(labelCol="target", weightCol="weight", maxDepth=depth, predictionCol="leaf").fit(step)
        state = tree.transform(state).select("features", Y, (f + rate * F.col("leaf")).alias("f")).checkpoint()
    return state.agg(F.avg(b / (2 - power) - y * a / (1 - power))).first()[0]


def test_loss_equals_the_librarys(spark, frame, tmp_path):
    from demandgrid.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    setting = Setting(0, 1, rate=0.3, n_rounds=6, depth=4, power=1.6)
    got = boosting.fit_many([frame], [setting], WIN, every=2, tolerance=0.0)[0]
    want = library_loss(frame.rows.where("segment >= 1"), frame.features, 0.3, 6, 4, 1.6)
    assert len(got.trees) == 6 and got.losses[-1] == pytest.approx(want, rel=0.01)
    assert all(b < a for a, b in zip(got.losses, got.losses[1:]))


def test_leaves_are_newton_steps(frame):
    e = boosting.fit_many([frame], [Setting(0, 0, rate=0.5, n_rounds=3, depth=3, power=1.4)], WIN)[0]
    pdf = frame.rows.where("segment >= 0").toPandas()
    x, y, score = pdf[frame.features].to_numpy(), pdf[Y].to_numpy(), np.full(len(pdf), e.start)
    for t in e.trees:
        g = np.exp(0.6 * score) - y * np.exp(-0.4 * score)
        h = 0.4 * y * np.exp(-0.4 * score) + 0.6 * np.exp(0.6 * score)
        leaf = t.predict(x)
        for v in np.unique(leaf):
            assert v == pytest.approx(-g[leaf == v].sum() / h[leaf == v].sum())
        score += 0.5 * leaf
    assert np.allclose(e.predict(x), np.exp(score))


def test_side_by_side_is_the_same_as_alone(panel, frame, monkeypatch):
    other = boosting.prepared_frame(panel, r.LagSpec(lags=(1,), rolling=(), month=False), WIN)
    settings = [Setting(0, 0, depth=3, n_rounds=7), Setting(1, 1, depth=2, n_rounds=12, rate=0.3), Setting(0, 1, depth=4, n_rounds=5, power=1.8),
                Setting(1, 0, depth=0, n_rounds=2), Setting(1, 0, depth=1, n_rounds=30, rate=0.3)]
    monkeypatch.setattr(boosting, "FOLD_EVERY", 3)
    monkeypatch.setattr(boosting, "CUT_EVERY", 2)
    steps = []
    real = boosting._Trainer._step
    monkeypatch.setattr(boosting._Trainer, "_step", lambda self, active: steps.append(len(active)) or real(self, active))
    together = boosting.fit_many([frame, other], settings, WIN)
    most = len(steps)
    alone = []
    for s in settings:
        steps.clear()
        alone += boosting.fit_many([frame, other], [s], WIN)
        assert len(steps) <= most   # the models with fewer levels cost no further jobs
    assert all(same(a, b) for a, b in zip(together, alone))
    monkeypatch.setattr(boosting, "GATHERED", 0)
    assert all(same(a, b) for a, b in zip(together, boosting.fit_many([frame, other], settings, WIN)))


def test_killed_fit_goes_on(frame, monkeypatch, tmp_path):
    log = str(tmp_path / "log")
    settings = [Setting(0, 0, depth=1, n_rounds=2), Setting(0, 1, depth=2, n_rounds=9, rate=0.3)]
    real = boosting._Trainer._step
    calls = []

    def killed(self, active):
        calls.append(list(active))
        if len(calls) == 8:
            raise KeyboardInterrupt
        return real(self, active)

    monkeypatch.setattr(boosting._Trainer, "_step", killed)
    with pytest.raises(KeyboardInterrupt):
        boosting.fit_many([frame], settings, WIN, tolerance=0.0, log=log)
    kept = boosting.read_log(frame.rows.sparkSession, log)
    assert len(kept) == 1
    trained = []
    monkeypatch.setattr(boosting._Trainer, "_step", lambda self, active: trained.append(len(self.work)) or real(self, active))
    out = boosting.fit_many([frame], settings, WIN, tolerance=0.0, log=log)
    assert set(trained) == {1} and len(out[1].trees) == 9 and same(out[0], next(iter(kept.values())))
    trained.clear()
    assert same(boosting.fit_many([frame], settings, WIN, tolerance=0.0, log=log)[1], out[1]) and not trained


def test_odd_frames(spark, frame):
    with pytest.raises(ValueError):
        boosting.fit_many([boosting.Frame(frame.rows.limit(0), frame.features, frame.groups)], [Setting()], WIN)
    with pytest.raises(ValueError):
        boosting.fit_many([frame], [Setting(power=2.0)], WIN)
    flat = boosting.Frame(spark.createDataFrame([(0, 3.0, 1.0)] * 9, "segment int, y double, x double"), ["x"])
    e = boosting.fit_many([flat], [Setting(n_rounds=2, depth=3)], Windows(1, 1))[0]
    assert np.allclose(e.predict(np.array([[1.0], [5.0]])), 3.0)
