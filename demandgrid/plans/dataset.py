"""Raw sales, calendar and prices to the features and targets panels."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, Y, day
from demandgrid.operators import calendars as cal_ops
from demandgrid.operators import intervals, joins, reshape

SERIES_KEYS = ("store_id", "item_id")


def prepare_calendar(calendar: DataFrame, state: str, start: date | str, end: date | str, max_lag: int = 30,
                     event_cols: Sequence[str] = ("event_name_1", "event_name_2"),
                     events: Sequence[str] | None = None, drop: Sequence[str] = ()) -> DataFrame:
    """Date range (padded for lags), the state's benefit flag, event indicators."""
    cal = calendar.drop(*drop).where(
        F.col("date").between(cal_ops.lag_padded_start(start, max_lag), day(end)))
    cal = cal_ops.keep_state_flag(cal, state)
    return cal_ops.event_indicators(cal, event_cols, events, drop_baseline=True)


def prepare_sales(sales: DataFrame, calendar: DataFrame, dept: str | None, store: str | None,
                  start: date | str, end: date | str, test_from: date | str, max_lag: int = 30,
                  mean_band: tuple[float, float] = (0.15, 0.5), quantile: float = 0.85,
                  keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Filtered long sales with interval columns; ``date`` and ``sales`` columns.

    Both series filters look at one wide row each, so they run before anything is shuffled or
    exploded, and the exchange on the series key moves compact arrays instead of day rows.
    Intervals run over the whole history before the date cut, so counts carry in.
    """
    if dept is not None:
        sales = sales.where(F.col("dept_id") == dept)
    if store is not None:
        sales = sales.where(F.col("store_id") == store)
    arrays, codes = reshape.day_arrays(sales, keys)
    arrays = reshape.where_mean_between(arrays, *mean_band)
    bounds = {r["date"]: r["d"] for r in calendar.where(
        F.col("date").isin(str(test_from), str(end))).select(F.col("date").cast("string"), "d").collect()}
    if missing := sorted({str(test_from), str(end)} - bounds.keys()):
        raise ValueError(f"the calendar has no day {', '.join(missing)}; test_from and end have to be in it")
    arrays = reshape.where_quantile_positive(arrays, codes, bounds[str(test_from)], bounds[str(end)], quantile)
    arrays = reshape.make_id(arrays, keys).repartition(F.col("unique_id"))
    long = cal_ops.code_to_date(reshape.explode_days(arrays, codes), calendar).withColumnRenamed("date", DS)
    long = intervals.periods_since_last_zero(intervals.periods_since_last_sale(long))
    return (long.where(F.col(DS).between(cal_ops.lag_padded_start(start, max_lag), day(end)))
            .select("unique_id", *keys, DS, Y, reshape.SINCE_SALE, reshape.SINCE_ZERO))


def build_features(series: DataFrame, calendar: DataFrame, prices: DataFrame,
                   keys: Sequence[str] = SERIES_KEYS) -> DataFrame:
    """Calendar and price columns for each series day, keyed by unique_id and ds."""
    cal = calendar.withColumnRenamed("date", DS).drop("d")
    rows = joins.with_calendar(series.select("unique_id", *keys, DS), cal, DS)
    return joins.with_prices(rows, prices, [*keys, "wm_yr_wk"]).drop(*keys)


def build_dataset(calendar: DataFrame, sales: DataFrame, prices: DataFrame, *, dept: str | None,
                  store: str | None, start: date | str, end: date | str, test_from: date | str,
                  max_lag: int = 30, mean_band: tuple[float, float] = (0.15, 0.5), quantile: float = 0.85,
                  state: str | None = None, events: Sequence[str] | None = None,
                  keys: Sequence[str] = SERIES_KEYS) -> tuple[DataFrame, DataFrame]:
    """(features, targets).  ``store=None`` or ``dept=None`` processes all of them in the same plan."""
    state = state or (cal_ops.state_of(store) if store else "")
    series = prepare_sales(sales, calendar, dept, store, start, end, test_from, max_lag, mean_band, quantile, keys)
    cal = prepare_calendar(calendar, state, start, end, max_lag, events=events)
    return build_features(series, cal, prices, keys), series.drop(*keys)
