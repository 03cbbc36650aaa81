"""Order-dependent operators.  All share one window spec, so a chain needs one exchange and sort."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, q, running, series_window


def _with_since(panel: DataFrame, key: str, y: str, name: str, sale_resets: bool) -> DataFrame:
    """Counted rows since the last event row: running count minus its value at that event."""
    sale, zero = F.col(y) > 0, F.col(y) == 0
    event, counted = (sale, zero) if sale_resets else (zero, sale)
    w = series_window(key)
    step = panel.withColumn("__c", F.sum(F.when(counted, 1).otherwise(0)).over(running(w)))
    last = F.last(F.when(event, F.col("__c")), ignorenulls=True).over(running(w))
    value = F.when(counted, F.col("__c") - F.coalesce(last, F.lit(0))).otherwise(0)
    return step.withColumn(name, value.cast("bigint")).drop("__c")


def periods_since_last_sale(panel: DataFrame, key: str = ID, y: str = Y,
                            name: str = "periods since last sales") -> DataFrame:
    """0 on a sale, else zeros counted since the last sale (or the start of the series)."""
    return _with_since(panel, key, y, name, sale_resets=True)


def periods_since_last_zero(panel: DataFrame, key: str = ID, y: str = Y,
                            name: str = "periods since last 0 sales") -> DataFrame:
    return _with_since(panel, key, y, name, sale_resets=False)


def trailing(value: Column, fn, size: int, key: str = ID, shift: int = 1, full: bool = True) -> Column:
    """``fn`` over ``size`` rows ending ``shift`` rows back; NULL until that many rows exist."""
    w = series_window(key).rowsBetween(-(shift + size - 1), -shift)
    out = fn(value).over(w)
    return F.when(F.count(value).over(w) == size, out) if full else out


def momentum(panel: DataFrame, window: int, closed: str = "left", key: str = ID, y: str = Y) -> DataFrame:
    """y minus the mean of the neighbouring rows; NULL until ``window`` values exist."""
    frames = {"left": (-window, -1), "right": (-(window - 1), 0), "both": (-window, 0),
              "neither": (-(window - 1), -1)}
    w = series_window(key).rowsBetween(*frames[closed])
    mean = F.when(F.count(y).over(w) >= window, F.avg(y).over(w))
    return panel.withColumn(f"{y}_momentum", F.col(y) - mean)


def lags(panel: DataFrame, sizes: Sequence[int] = (1, 7, 14), key: str = ID, y: str = Y) -> DataFrame:
    w = series_window(key)
    return panel.withColumns({f"lag{k}": F.lag(y, k).over(w) for k in sizes})


def rolling_stats(panel: DataFrame, windows: Sequence[int] = (7, 14, 28), lag: int = 1,
                  stats: Sequence[str] = ("mean", "std"), key: str = ID, y: str = Y) -> DataFrame:
    """Rolling mean and sample deviation of the lagged series, full windows only."""
    fns = {"mean": F.avg, "std": F.stddev_samp}
    return panel.withColumns({
        f"rolling_{s}_lag{lag}_window_size{n}": trailing(F.col(y), fns[s], n, key, lag)
        for n in windows for s in stats})


def ewm_mean(panel: DataFrame, alpha: float, lag: int = 1, key: str = ID, y: str = Y) -> DataFrame:
    """Exponentially weighted mean of the lagged series, started at its first value (0 < alpha <= 1).

    m(t) = alpha y(t) + (1 - alpha) m(t - 1) over the whole history; missing values are skipped.  Each step is an
    affine map of m, and maps compose: within chunks of values, short enough that the weights (1 - alpha)^-i stay
    small, a running sum of weighted values does; the maps of whole chunks, a few per series, are composed in
    an array.  All of it uses the one exchange on the series key.
    """
    if not 0 < alpha <= 1:
        raise ValueError("alpha lies in (0, 1]")
    name, w, left = f"ewm_lag{lag}_alpha{alpha}", series_window(key), 1 - alpha
    value = q(y).cast("double")
    if alpha == 1:
        last = F.last(value, ignorenulls=True).over(running(w))
        return panel.withColumn("__m", last).withColumn(name, F.lag("__m", lag).over(w)).drop("__m")
    size = max(1, int(18 / -math.log(left))) if left < 1 else 1
    power = lambda n: F.pow(F.lit(left), n)
    rows = panel.withColumn("__k", F.count(value).over(running(w)))   # values so far
    rows = rows.withColumns({"__chunk": F.floor((F.col("__k") - 1) / size).cast("int"), "__i": F.pmod(F.col("__k") - 1, F.lit(size))})
    share = value * F.when(F.col("__k") == 1, 1.0).otherwise(alpha) * power(-F.col("__i"))
    inside = Window.partitionBy(key, "__chunk").orderBy(DS).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("__s", F.sum(share).over(inside) * power(F.col("__i")))
    whole = rows.where((F.col("__i") == size - 1) & value.isNotNull()).groupBy(q(key).alias("__key")).agg(
        F.sort_array(F.collect_list(F.struct("__chunk", "__s"))).alias("__ends"))
    # the mean at the end of every whole chunk, oldest first
    means = F.aggregate("__ends", F.array().cast("array<double>"), lambda done, e: F.concat(done, F.array(
        e["__s"] + left ** size * F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(0.0)))))
    rows = rows.join(whole.select("__key", means.alias("__means")), rows[key].eqNullSafe(F.col("__key")), "left")
    before = F.when(F.col("__chunk") > 0, F.try_element_at("__means", F.col("__chunk")) * power(F.col("__i") + 1)).otherwise(0.0)
    mean = F.when(F.col("__k") > 0, F.col("__s") + before)
    return rows.withColumn("__m", mean).withColumn(name, F.lag("__m", lag).over(w)).select(*map(q, [*panel.columns, name]))


def naive_errors(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    """Absolute one-step change of each series."""
    return panel.withColumn("naive_error", F.abs(F.col(y) - F.lag(y).over(series_window(key))))


def top_per_group(df: DataFrame, by: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First n rows of each group.  Spark limits ranks before the shuffle, so a hot group ships
    at most n rows per task."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)

