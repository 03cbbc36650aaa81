"""Registered searches run at full size; tree trials share their training frames."""

from demandgrid.catalog import forecast_queries as q
from demandgrid.operators import search
from demandgrid.operators.backtest import Windows


def test_registered_searches_are_whole(monkeypatch):
    calls = []
    monkeypatch.setattr(q.b, "panel", lambda spark, sf: None)
    monkeypatch.setattr(q.search, "random_search", lambda panel, windows, model, n_trials=20: calls.append((windows, n_trials)))

    class Result:
        metrics = None

    monkeypatch.setattr(q, "train_and_evaluate", lambda panel, windows, n_trials: calls.append((windows, n_trials)) or Result)
    q.tree_random_search(None, "")
    q.ridge_random_search(None, "")
    q.train_and_evaluate_query(None, "")
    assert calls == [(Windows(28, 5), 20)] * 3


def test_tree_trials_share_frames(series, monkeypatch):
    made = []
    real = search.prepared_frame
    monkeypatch.setattr(search, "prepared_frame", lambda *a: made.append(a) or real(*a))
    panel = series({"a": [(i * 7) % 5 for i in range(40)], "b": [i % 3 for i in range(40)]})
    out = search.random_search(panel, Windows(2, 1), "TweedieGBT", 2, lag_choices=((1,),), rolling_choices=((),),
                               space={"n_rounds": (1, 1), "depth": (1, 1)})
    assert len(made) == 1 and out.count() == 2
