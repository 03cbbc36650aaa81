"""Known answers of hand-made series (FIXTURES.md, part 3)."""

import math

import pytest
from pyspark.sql import functions as F

from conftest import values
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import backtest, calendars, intervals, metrics, profile, reshape
from demandgrid.operators import features as f


def test_periods_since(series):
    p = series({"a": [0, 0, 3, 0, 0, 0, 1]})
    assert values(intervals.periods_since_last_sale(p), "periods since last sales") == [1, 2, 0, 1, 2, 3, 0]
    assert values(intervals.periods_since_last_zero(p), "periods since last 0 sales") == [0, 0, 1, 0, 0, 0, 1]


def test_adi_cv2(series):
    rows = {r.unique_id: r for r in profile.adi_cv2(series({"a": [2, 0, 4, 0, 0, 6], "b": [5], "c": [0, 0]})).collect()}
    assert rows["a"].adi == 2.5 and rows["a"].cv2 == pytest.approx(1 / 6) and rows["a"].cluster == "Intermittent"
    assert (rows["b"].adi, rows["b"].cv2, rows["b"].cluster) == (1.0, 0.0, "Smooth")
    assert (rows["c"].adi, rows["c"].mean_demand, rows["c"].zero_percentage) == (1.0, 0.0, 100.0)


def test_interval_stats_counts_long_gaps_only(series):
    r = profile.interval_stats(series({"a": [1, 1, 0, 0, 1]})).first()
    assert (r.mean_interval, r.median_interval) == (3.0, 3.0)


def test_zero_run_mean_starts(series):
    p = series({"a": [0, 5, 0, 0, 1, 0, 2, 0]})
    assert profile.zero_run_mean(p).first().mean_interval == 1.5
    assert profile.zero_run_mean(p, start="smallest_sale").first().mean_interval == 1.0


def test_momentum(series):
    assert values(intervals.momentum(series({"a": [1, 2, 3, 4]}), 2), "y_momentum") == [None, None, 1.5, 1.5]


def test_quantile_filter(series):
    p = series({"a": [1, 2, 3, 4], "b": [0, 0, 0, 1]})
    kept = profile.filter_quantile_positive(p, "2020-01-01", "2020-01-04", 0.5)
    assert {r[0] for r in kept.select(ID).distinct().collect()} == {"a"}
    from demandgrid.functions.quantiles import series_quantile
    assert p.groupBy(ID).agg(series_quantile(F.col(Y), 0.85).alias("q")).orderBy(ID).first().q == pytest.approx(3.55)


@pytest.fixture
def pred(spark):
    rows = [("s", f"2020-01-0{i + 1}", "2019-12-31", y, p, 1.0, 0.0)
            for i, (y, p) in enumerate(zip([0.0, 2.0, 0.0, 4.0], [0.0, 1.0, 1.0, 4.0]))]
    return spark.createDataFrame(rows, "unique_id string, ds string, cutoff string, y double, M double, "
                                       "SeasonalNaive double, ZeroModel double")


def test_metrics(pred):
    r = metrics.evaluate(pred, ["M"]).first()
    assert r.mae == 0.5 and r.rmse == pytest.approx(math.sqrt(0.5)) and r.f1_zero == pytest.approx(2 / 3)
    assert r.non_zero_mae == 0.5 and r.mase == pytest.approx(0.5 / 1.5) and r.mrae == pytest.approx(0.5 / 1.5)


def test_perfect_forecast_has_no_error(pred):
    r = metrics.evaluate(pred.withColumn("P", F.col("y")), ["P"]).first()
    assert (r.mae, r.rmse, r.mase, r.rmsse, r.mrae, r.f1_zero) == (0, 0, 0, 0, 0, 1)


def test_undefined_ratios_are_null(pred):
    flat = pred.withColumn("y", F.lit(0.0)).withColumn("SeasonalNaive", F.lit(0.0))
    r = metrics.evaluate(flat, ["M"]).first()
    assert r.mase is None and r.mrae is None and r.non_zero_mae is None
    assert metrics.evaluate(flat, ["M"], mrae_fallback=True).first().mrae == r.mae


def test_seasonal_naive_repeats_last_week(series):
    out = backtest.forecast_baselines(series({"a": [9, 9, 1, 2, 3, 4, 5, 6, 7]}), 9)
    assert values(out, "SeasonalNaive") == [1, 2, 3, 4, 5, 6, 7, 1, 2]
    assert values(out, "Naive") == [7.0] * 9


def test_zero_small(spark):
    df = spark.createDataFrame([(-0.3,), (0.05,), (0.1,), (0.2,)], "p double")
    assert [r.p for r in f.zero_small(df, ["p"]).collect()] == [0, 0, 0, 0.2]
    assert [r.p for r in f.zero_small(df, ["p"], close=True).collect()] == [0, 0.05, 0.1, 0.2]


def test_threshold_scaler(spark):
    df = spark.createDataFrame([(0.0,), (2.0,), (4.0,)], "x double")
    assert [r.x for r in f.ThresholdScaler(["x"]).fit_transform(df).collect()] == [0, -1, 1]


def test_one_hot_baseline(spark):
    df = spark.createDataFrame([("Monday",), ("Friday",), ("Sunday",)], "weekday string")
    enc = f.OneHotBaseline("weekday", "Monday")
    out = enc.fit_transform(df)
    assert out.columns == ["weekday_Friday", "weekday_Sunday"]
    assert [tuple(r) for r in out.collect()] == [(0, 0), (1, 0), (0, 1)]
    assert [r.weekday for r in enc.inverse_transform(out).collect()] == ["Monday", "Friday", "Sunday"]
    with pytest.raises(Exception, match="unknown level"):
        enc.transform(spark.createDataFrame([("Never",)], "weekday string")).collect()
    one = spark.createDataFrame([("Monday",)], "weekday string")
    assert f.OneHotBaseline("weekday", "Monday").fit_transform(one).columns == ["weekday_Monday"]


def test_integer_baseline_moves_first(spark):
    df = spark.createDataFrame([(1,), (2,), (3,)], "month int")
    enc = f.OneHotBaseline("month", "2").fit(df)
    assert enc.names() == ["month_1", "month_3"]


def test_event_indicators_and_back(spark):
    cal = spark.createDataFrame([("2020-01-01", "Easter", "Purim"), ("2020-01-02", None, None), ("2020-01-03", None, "Easter")],
                                "date string, e1 string, e2 string")
    wide = calendars.event_indicators(cal, ["e1", "e2"], drop_baseline=True, drop_event_cols=True)
    assert [tuple(r) for r in wide.orderBy("date").collect()] == [
        ("2020-01-01", 1, 1), ("2020-01-02", 0, 0), ("2020-01-03", 1, 0)]
    back = calendars.event_indicators_inverse(wide, ["Easter", "Purim"], ["e1", "e2"])
    assert [tuple(r) for r in back.orderBy("date").collect()] == [
        ("2020-01-01", "Easter", "Purim"), ("2020-01-02", "No Event", "No Event"), ("2020-01-03", "Easter", "No Event")]


def test_hierarchy_key(spark):
    parts = profile.store_parts(F.lit("CA_1__FOODS_3_001"))
    r = spark.range(1).select(*[v.alias(k) for k, v in parts.items()]).first()
    assert tuple(r) == ("CA", "CA_1", "FOODS_3")


def test_key_round_trip_and_null(spark):
    df = spark.createDataFrame([("x", "S", "i"), ("y", None, "i")], "a string, store string, item string")
    made = reshape.make_id(df, ["store", "item"], drop=True)
    assert [r.unique_id for r in made.orderBy("a").collect()] == ["S__i", None]
    back = reshape.split_id(made, reshape.id_positions(df, ["store", "item"]))
    assert back.columns == df.columns and tuple(back.orderBy("a").first()) == ("x", "S", "i")


def test_period_ends(spark):
    from demandgrid.functions.core import period_end
    df = spark.createDataFrame([("2024-02-04",), ("2024-02-05",)], "ds string").withColumn(DS, F.to_date(DS))
    got = [tuple(str(x) for x in r) for r in df.select(period_end("D"), period_end("W"), period_end("M")).collect()]
    assert got == [("2024-02-04", "2024-02-04", "2024-02-29"), ("2024-02-05", "2024-02-11", "2024-02-29")]
