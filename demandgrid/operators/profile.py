"""Demand profiles: filters on level and predictability, intermittency classes, aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import (
    DS, ID, Y, avg_if, correlation, count_if, day, is_number, numeric_columns, percent, period_end, q, ratio,
    series_window, stack, text_columns,
)
from demandgrid.functions.moments import pair_correlations
from demandgrid.functions.quantiles import before_each, exact_quantiles, in_ranges, series_quantile
from demandgrid.operators.similarity import top_similar
from demandgrid.session import cut_lineage

# Class borders of the ADI / CV-squared scheme.
ADI_BORDER, CV2_BORDER = 1.32, 0.49
# Labels of the five price quantile bins, cheapest first.
FEW_PRICES = "Fewer than five prices"
PRICE_LABELS = ("Very Low", "Low", "Medium", "High", "Very High")


# ---------------------------------------------------------------- series filters

def filter_mean_band(panel: DataFrame, lb: float = 0.15, ub: float = 0.5, key: str = ID,
                     y: str = Y) -> DataFrame:
    """Series whose mean over all days lies in [lb, ub].

    A window over the series instead of a join back to its own aggregate: the input is read once
    and the exchange serves later windows.
    """
    mean = F.avg(y).over(Window.partitionBy(key))
    return panel.withColumn("__m", mean).where(F.col("__m").between(lb, ub)).drop("__m")


def filter_quantile_positive(panel: DataFrame, start: date | str | Column, end: date | str | Column,
                             p: float = 0.85, key: str = ID, y: str = Y) -> DataFrame:
    """Series whose exact p-quantile over [start, end] is above zero."""
    recent = F.when(F.col(DS).between(day(start), day(end)), F.col(y))
    return (panel.withColumn("__q", series_quantile(recent, p).over(Window.partitionBy(key)))
            .where(F.col("__q") > 0).drop("__q"))


def tail_stats(panel: DataFrame, last_day: date | Column, n_days: int, key: str = ID,
               y: str = Y) -> DataFrame:
    """Zero share and upper quantiles over the last ``n_days`` + 1 days."""
    qs = series_quantile(F.col(y), [0.85, 0.9, 0.95])
    return (panel.where(F.col(DS).between(F.date_sub(day(last_day), n_days), day(last_day)))
            .groupBy(key).agg(F.avg(F.when(F.col(y) == 0, 1.0).otherwise(0.0)).alias("mean_zeros"),
                              qs.alias("__q"))
            .select(key, "mean_zeros", F.col("__q")[0].alias("q85"), F.col("__q")[1].alias("q90"),
                    F.col("__q")[2].alias("q95")))


def drop_quiet_tail(panel: DataFrame, stats: DataFrame, key: str = ID) -> DataFrame:
    """Remove series whose recent 85 % quantile is zero."""
    return panel.join(stats.where(F.col("q85") == 0).select(key), key, "left_anti")


# ---------------------------------------------------------------- per-series statistics

def demand_stats(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    return (panel.groupBy(key)
            .agg(F.avg(y).alias("y_mean"), F.stddev_samp(y).alias("y_std"), F.min(y).alias("y_min"),
                 F.max(y).alias("y_max"), F.count(y).alias("y_count"),
                 count_if(F.col(y) == 0).alias("__z"))
            .withColumn("cv", ratio(F.col("y_std"), F.col("y_mean")))
            .withColumn("zero_percentage", ratio(F.col("__z") * 100, F.col("y_count")))
            .drop("__z"))


def zero_share(panel: DataFrame, key: str = ID, y: str = Y, border: float = 50.0) -> DataFrame:
    z = panel.groupBy(key).agg(percent(F.col(y) == 0).alias("zero_percentage"))
    hit = F.col("zero_percentage") > border
    return z.select(key, "zero_percentage", hit.alias("is_intermittent"),
                    F.when(hit, "Intermittent").otherwise("Regular").alias("demand_type"))


def zero_share_summary(panel: DataFrame) -> DataFrame:
    """Across series: number, mean, spread and the count of intermittent ones."""
    return zero_share(panel).agg(
        F.count(F.lit(1)).alias("n_series"), F.avg("zero_percentage").alias("mean_zero"),
        F.min("zero_percentage").alias("min_zero"), F.max("zero_percentage").alias("max_zero"),
        count_if(F.col("is_intermittent")).alias("n_intermittent"))


def _positioned_sales(panel: DataFrame, key: str, y: str) -> DataFrame:
    """Row position of every day; sizes differ only by day count, so one window does."""
    return panel.withColumn("__pos", F.row_number().over(series_window(key)))


def adi_cv2(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    """Mean gap in rows between sales (all gaps) and squared variation of sale sizes, with class."""
    sale = F.col(y) > 0
    pos = F.when(sale, F.col("__pos"))
    size = F.when(sale, F.col(y))
    base = (_positioned_sales(panel, key, y).groupBy(key)
            .agg(count_if(sale).alias("__n"), F.min(pos).alias("__first"), F.max(pos).alias("__last"),
                 F.avg(size).alias("__mean"), F.stddev_pop(size).alias("__std"),
                 percent(F.col(y) == 0).alias("zero_percentage")))
    many = F.col("__n") > 1
    scored = base.select(
        key,
        F.when(many, ratio(F.col("__last") - F.col("__first"), F.col("__n") - 1)).otherwise(1.0).alias("adi"),
        F.when(many, F.pow(ratio(F.col("__std"), F.col("__mean")), 2)).otherwise(0.0).alias("cv2"),
        "zero_percentage",
        F.coalesce("__mean", F.lit(0.0)).alias("mean_demand"),
        F.when(many, F.col("__std")).otherwise(0.0).alias("std_demand"))
    often, even = F.col("adi") < ADI_BORDER, F.col("cv2") < CV2_BORDER
    return scored.withColumn(
        "cluster", F.when(often & even, "Smooth").when(even, "Intermittent")
        .when(often, "Erratic").otherwise("Lumpy"))


def class_shares(classes: DataFrame, col: str = "cluster") -> DataFrame:
    """Series per class with percentage of all."""
    counts = classes.groupBy(col).agg(F.count(F.lit(1)).alias("n_series"))
    total = classes.agg(F.count(F.lit(1)).alias("t")).scalar()
    return counts.withColumn("share", ratio(F.col("n_series") * 100, total))


def interval_stats(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    """Sale sizes (sample CV squared) and gaps longer than one row only."""
    sales = _positioned_sales(panel, key, y).where(F.col(y) > 0)
    step = F.col("__pos") - F.lag("__pos").over(series_window(key))
    gap = F.when(F.col("__gap") > 1, F.col("__gap"))
    return (sales.withColumn("__gap", step).groupBy(key)
            .agg(F.avg(y).alias("mean_nonzero_demand"),
                 series_quantile(F.col(y), 0.5).alias("median_nonzero_demand"),
                 F.pow(ratio(F.stddev_samp(y), F.avg(y)), 2).alias("cv_squared"),
                 F.avg(gap).alias("mean_interval"), series_quantile(gap, [0.5, 0.9, 0.95]).alias("__q"))
            .select("*", F.col("__q")[0].alias("median_interval"), F.col("__q")[1].alias("q_90_interval"),
                    F.col("__q")[2].alias("q_95_interval")).drop("__q"))


def zero_run_mean(panel: DataFrame, key: str = ID, y: str = Y, start: str = "first_sale") -> DataFrame:
    """Zeros per zero run between the first and the last sale.

    ``start='smallest_sale'`` begins at the first occurrence of the smallest sale instead.
    """
    w = series_window(key)
    whole = Window.partitionBy(key)
    sale_day = F.when(F.col(y) > 0, F.col(DS))
    if start == "first_sale":
        begin = F.min(sale_day).over(whole)
    elif start == "smallest_sale":
        begin = F.min(F.when(F.col(y) > 0, F.struct(F.col(y), F.col(DS)))).over(whole)[DS]
    else:
        raise ValueError("start must be first_sale or smallest_sale")
    run_start = (F.col(y) == 0) & (F.lag(y).over(w) > 0) & (F.col(DS) > F.col("__from"))
    return (panel.withColumn("__from", begin).withColumn("__to", F.max(sale_day).over(whole))
            .withColumn("__start", run_start)
            .where(F.col(DS).between(F.col("__from"), F.col("__to")))
            .groupBy(key).agg(count_if(F.col(y) == 0).alias("zeros"),
                              count_if(F.col("__start")).alias("zero_runs"))
            .withColumn("mean_interval", ratio(F.col("zeros"), F.col("zero_runs"))))


def mean_demand_distribution(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    """Quantiles, extremes and spread of the per-series means."""
    means = cut_lineage(panel.groupBy(key).agg(F.avg(y).alias("m")))   # a row per series, read twice
    qs = exact_quantiles(means, "m", [0.05, 0.1, 0.5, 0.9, 0.95])
    names = ["q_05", "q_10", "q_50", "q_90", "q_95"]
    agg = means.agg(F.min("m").alias("min"), F.avg("m").alias("mean"), F.max("m").alias("max"),
                    F.stddev_samp("m").alias("sd"))
    vec = qs.select("q").scalar()
    return agg.select(*[vec[i].alias(n) for i, n in enumerate(names)], "*")


def series_summary(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    return panel.groupBy(key).agg(
        F.sum(y).alias("total"), F.avg(y).alias("mean"), F.stddev_samp(y).alias("std"),
        percent(F.col(y) == 0).alias("zero_percentage"), F.count(F.lit(1)).alias("n"),
        F.min(DS).alias("first_day"), F.max(DS).alias("last_day"))


def panel_summary(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    """One row over all series.  Partial aggregation runs per series first, with mergeable moments, so a hot
    series ships one row per task and large means do not cancel in the deviation."""
    v, days = q(y), F.datediff(F.max(DS), F.min(DS))
    return panel.agg(
        F.countDistinct(q(key)).alias("n_series"), F.count(F.lit(1)).alias("n_rows"), F.sum(v).alias("total"),
        F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"), percent(v == 0).alias("zero_percentage"),
        F.min(DS).alias("first_day"), F.max(DS).alias("last_day"), days.alias("span_days"))


def monthly_mean(panel: DataFrame, key: str = ID, y: str = Y) -> DataFrame:
    return panel.groupBy(key, F.last_day(DS).alias("month_end")).agg(F.avg(y).alias("mean_y"))


def monthly_changes(panel: DataFrame, n_splits: int = 8, key: str = ID, y: str = Y) -> DataFrame:
    """Rises and falls of the monthly mean, in total and in n consecutive parts."""
    w = Window.partitionBy(key).orderBy("month_end")
    diffs = (monthly_mean(panel, key, y)
             .withColumn("__d", F.col("mean_y") - F.lag("mean_y").over(w))
             .withColumn("__part", F.ntile(n_splits).over(w)))
    up, down = F.col("__d") > 0, F.col("__d") < 0
    parts = []
    for i in range(n_splits):
        here = F.col("__part") == i + 1
        parts += [count_if(up & here).alias(f"pos_changes_{i}"), count_if(down & here).alias(f"neg_changes_{i}")]
    total = diffs.groupBy(key).agg(count_if(up).alias("pos_changes_total"),
                                   count_if(down).alias("neg_changes_total"), *parts)
    hi = F.greatest("pos_changes_total", "neg_changes_total")
    lo = F.least("pos_changes_total", "neg_changes_total")
    return total.withColumn("sign_pct_change", ratio(hi - lo, lo))


# ---------------------------------------------------------------- time and hierarchy aggregates

def store_parts(key: Column) -> dict[str, Column]:
    """State, store and department read from ``ST_1__DEPT_x_001``."""
    halves = F.split(key, "__")
    left, right = F.split(halves[0], "_"), F.split(halves[1], "_")
    return {"state": left[0], "store": halves[0],
            "department": F.concat_ws("_", right[0], right[1])}


def daily_total(panel: DataFrame, by: Sequence[Column] = (), y: str = Y) -> DataFrame:
    return panel.groupBy(*by, DS).agg(F.sum(y).alias("total_y"))


def low_days(daily: DataFrame, threshold: float, total: str = "total_y") -> DataFrame:
    return daily.where(F.col(total) < threshold)


def month_by_year(daily: DataFrame, years: Sequence[int], total: str = "total_y") -> DataFrame:
    """Mean daily total per month name, one column per year."""
    out = (daily.withColumn("month", F.date_format(DS, "MMM")).withColumn("__yr", F.year(DS))
           .groupBy("month").pivot("__yr", list(years)).agg(F.avg(total)))
    return out.withColumnsRenamed({str(v): f"y{v}" for v in years})


def aggregate_hierarchy(panel: DataFrame, level: str, y: str = Y) -> DataFrame:
    """Daily totals of one hierarchy level."""
    parts = store_parts(F.col(ID))
    return daily_total(panel, [parts[level].alias("group_key")], y)


def hierarchy_stats(panel: DataFrame, level: str, y: str = Y) -> DataFrame:
    """Sum, mean, std and row count of each group, over its raw rows."""
    key = store_parts(F.col(ID))[level].alias("group_key")
    return panel.groupBy(key).agg(F.sum(y).alias("sum_y"), F.avg(y).alias("mean_y"),
                                  F.stddev_samp(y).alias("std_y"), F.count(y).alias("count_y"))


def hierarchy_totals(panel: DataFrame, level: str, y: str = Y) -> DataFrame:
    """Grand total, number of groups and average total per group."""
    stats = hierarchy_stats(panel, level, y)
    return stats.agg(F.sum("sum_y").alias("total_y"), F.count(F.lit(1)).alias("n_groups"),
                     F.avg("sum_y").alias("avg_per_group"))


def hierarchy_rollup(panel: DataFrame, y: str = Y) -> DataFrame:
    """All levels in one pass: series collapse first, then state / store / department roll up."""
    per = panel.groupBy(ID).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    parts = store_parts(F.col(ID))
    return (per.select(*[c.alias(n) for n, c in parts.items()], "s", "n")
            .rollup("state", "store", "department")
            .agg(F.sum("s").alias("sum_y"), F.sum("n").alias("count_y"),
                 F.grouping_id().cast("bigint").alias("level_id")))


def seasonal_profile(panel: DataFrame, y: str = Y) -> DataFrame:
    """Mean demand by weekday, month and day of year: collapse to dates, then grouping sets."""
    per_day = (panel.groupBy(DS).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
               .select(F.date_format(DS, "EEEE").alias("weekday"), F.month(DS).alias("month"),
                       F.dayofyear(DS).alias("day_of_year"), "s", "n"))
    wd, mo, dy = F.col("weekday"), F.col("month"), F.col("day_of_year")
    sets = per_day.groupingSets([[wd], [mo], [dy]], wd, mo, dy)
    return (sets.agg(ratio(F.sum("s"), F.sum("n")).alias("mean_y"), F.sum("n").alias("n_rows"))
            .select(F.when(wd.isNotNull(), "weekday").when(mo.isNotNull(), "month")
                    .otherwise("day_of_year").alias("season"),
                    F.coalesce(wd, mo.cast("string"), dy.cast("string")).alias("bucket"),
                    "mean_y", "n_rows"))


def daily_mean(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Feature trend: mean of each column by date."""
    return df.groupBy(DS).agg(*[F.avg(q(c)).alias(c) for c in cols])


# ---------------------------------------------------------------- prices

def price_stats(df: DataFrame, price: str = "sell_price") -> DataFrame:
    """On-sale and off-sale rows with shares; mean, median, min and max of prices on sale.

    Rows collapse to distinct prices; every figure is read off those.
    """
    p, n = F.col("__p"), F.col("n")
    counts = cut_lineage(df.groupBy(q(price).cast("double").alias("__p")).agg(F.count(F.lit(1)).alias("n")))
    on, off = p > 0, p == 0
    n_on = F.coalesce(F.sum(F.when(on, n)), F.lit(0))
    n_off = F.coalesce(F.sum(F.when(off, n)), F.lit(0))
    vec = exact_quantiles(counts.where(on), "__p", [0.5], weight="n").select("q").scalar()
    return counts.agg(
        n_on.alias("available"), n_off.alias("unavailable"),
        ratio(n_on * 100, F.sum(n)).alias("available_pct"), ratio(n_off * 100, F.sum(n)).alias("unavailable_pct"),
        ratio(F.sum(F.when(on, p * n)), n_on).alias("mean_price"), F.min(F.when(on, p)).alias("min_price"),
        F.max(F.when(on, p)).alias("max_price"),
    ).select("*", vec[0].alias("median_price"))


def price_correlation(df: DataFrame, y: str = Y, available_only: bool = False) -> DataFrame:
    """Correlation of y with every column whose name holds 'price'."""
    cols = [c for c in df.columns if "price" in c.lower()]
    if not cols:
        raise ValueError("no price column")
    long = stack(df, [y], cols, "price_column", "price", "double")
    if available_only:
        long = long.where(F.col("price") > 0)
    return long.groupBy("price_column").agg(correlation(F.col("price"), F.col(y)).alias("correlation"))


def price_bins(df: DataFrame, price: str = "sell_price", y: str = Y) -> DataFrame:
    """Mean demand per price fifth (right-closed quantile bins over rows on sale).

    Fewer than five distinct prices have no fifths: all rows are then one bin that says so.
    """
    # demand collapses by price first, and ranks tell the bin: a price lies up to a quantile if the first of its
    # rows does
    by_price = (df.where(q(price) > 0).groupBy(q(price).cast("double").alias("__p"), F.lit(0).alias("__all"))
                .agg(F.sum(y).alias("s"), F.count(y).alias("n"), F.count(F.lit(1)).alias("rows")))
    ranged = in_ranges(by_price, ["__all"], "__p", "rows")
    ranked = ranged.withColumn("__first", before_each(ranged, ["__all"], "__p", "rows"))
    label = F.lit(PRICE_LABELS[4])
    for i, p in reversed(list(enumerate((0.2, 0.4, 0.6, 0.8)))):
        label = F.when(F.col("__first") <= F.floor(F.lit(p) * (F.col("__total") - 1)), PRICE_LABELS[i]).otherwise(label)
    label = F.when(F.col("__distinct") < len(PRICE_LABELS), FEW_PRICES).otherwise(label)
    return (ranked.groupBy(label.alias("price_bin"))
            .agg(ratio(F.sum("s"), F.sum("n")).alias("mean_y"), F.sum("n").alias("n_rows")))


def price_by_day(df: DataFrame, price: str = "sell_price", y: str = Y) -> DataFrame:
    """Mean price over rows on sale and total demand, by date."""
    return (df.where(q(price) > 0).groupBy(DS)
            .agg(F.avg(q(price)).alias("mean_price"), F.sum(y).alias("total_y")))


def availability_by(df: DataFrame, by: str, price: str = "sell_price") -> DataFrame:
    return df.groupBy(by).agg(percent(q(price) > 0).alias("availability"))


def availability_summary(df: DataFrame, price: str = "sell_price", key: str = ID) -> DataFrame:
    return availability_by(df, key, price).agg(
        F.avg("availability").alias("avg_availability"), F.min("availability").alias("min_availability"),
        F.max("availability").alias("max_availability"))


# ---------------------------------------------------------------- forecasts against actuals

def aggregate_forecast(pred: DataFrame, model: str, freq: str = "D", how: str = "sum",
                       by: Sequence[str] = (), y: str = Y) -> DataFrame:
    """Actual and predicted per period, with error and absolute error."""
    both = pred.where(F.col(y).isNotNull() & q(model).isNotNull())
    fn = {"sum": F.sum, "mean": F.avg, "median": None}[how]
    keys = [*by, "period"]
    both = both.withColumn("period", period_end(freq)).select(
        *keys, F.col(y).cast("double").alias("a"), q(model).cast("double").alias("p"))
    if fn is not None:
        out = both.groupBy(*keys).agg(fn("a").alias("actual"), fn("p").alias("predicted"))
    else:
        long = both.unpivot([F.col(k) for k in keys], ["a", "p"], "side", "v")
        med = exact_quantiles(long, "v", [0.5], [*keys, "side"])
        out = (med.groupBy(*keys).pivot("side", ["a", "p"]).agg(F.first(F.col("q")[0]))
               .withColumnsRenamed({"a": "actual", "p": "predicted"}))
    return (out.withColumn("error", F.col("actual") - F.col("predicted"))
            .withColumn("abs_error", F.abs("error")))


def forecast_fit(periods: DataFrame) -> DataFrame:
    """MAE, RMSE, correlation and bias % of :func:`aggregate_forecast` rows."""
    return periods.agg(
        F.avg("abs_error").alias("mae"), F.sqrt(F.avg(F.col("error") * F.col("error"))).alias("rmse"),
        correlation(F.col("actual"), F.col("predicted")).alias("correlation"),
        ratio((F.sum("predicted") - F.sum("actual")) * 100, F.sum("actual")).alias("bias_pct"))


def residual_stats(long: DataFrame, y: str = Y, y_hat: str = "y_hat") -> DataFrame:
    """Per series and model: error size, correlation and shape of the residuals y - y_hat."""
    r = F.col(y).cast("double") - F.col(y_hat)
    return (long.withColumn("__r", r).groupBy(ID, "model")
            .agg(F.avg(F.abs("__r")).alias("mae"), F.sqrt(F.avg(F.col("__r") * F.col("__r"))).alias("rmse"),
                 correlation(F.col(y), F.col(y_hat)).alias("correlation"),
                 F.avg("__r").alias("mean_residual"), F.stddev_samp("__r").alias("std_residual"),
                 percent(F.col("__r") > 0).alias("positive_pct"), F.max(F.abs("__r")).alias("max_abs_residual"),
                 F.count("__r").alias("n")))


# ---------------------------------------------------------------- distributions and columns

def histogram(df: DataFrame, col: str, bins: int = 30, lo: float | None = None,
              hi: float | None = None) -> DataFrame:
    """Equal-width bins, the last one closed on the right.  Bounds default to the data's, fetched in one aggregate.

    No value is lost: those under given bounds are bin -1, those over them (NaN too) bin ``bins``, each with
    one open side (NULL).
    """
    v = q(col).cast("double")
    src = df.where(v.isNotNull())
    if lo is None or hi is None:
        ends = src.agg(F.struct(F.min(v).alias("lo"), F.max(v).alias("hi")).alias("ends")).scalar()
    lo_c = F.lit(float(lo)) if lo is not None else ends["lo"]
    hi_c = F.lit(float(hi)) if hi is not None else ends["hi"]
    width = (hi_c - lo_c) / bins
    place = (F.when(v < lo_c, -1).when(v > hi_c, bins).when(width == 0, 0)
             .otherwise(F.least(F.floor(F.try_divide(v - lo_c, width)), F.lit(bins - 1))))
    at = F.col("bin")
    return (src.groupBy(place.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
            .select("bin", F.when(at >= 0, lo_c + at * width).alias("bin_from"),
                    F.when(at < bins, lo_c + (at + 1) * width).alias("bin_to"), "n"))


def log_histogram(df: DataFrame, col: str, bins: int = 99, lo_exp: float = 0.0,
                  hi_exp: float = 6.0) -> DataFrame:
    """Bins equally wide in log10 between 10^lo_exp and 10^hi_exp; what lies outside has the bins -1 (zero and
    negative values as well) and ``bins``."""
    v = q(col).cast("double")
    logged = df.select(F.when(v > 0, F.log10(v)).when(v <= 0, float("-inf")).alias("__l"))
    h = histogram(logged, "__l", bins, lo_exp, hi_exp)
    return h.select("bin", F.pow(F.lit(10.0), "bin_from").alias("bin_from"),
                    F.pow(F.lit(10.0), "bin_to").alias("bin_to"), "n")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Mean, std, min and max per column, long form."""
    long = stack(df, [], cols, "column", "v", "double")
    return long.groupBy("column").agg(F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
                                      F.min("v").alias("min"), F.max("v").alias("max"))


def missing_values(df: DataFrame) -> DataFrame:
    """Columns with missing cells: count and percentage."""
    one = df.agg(*[count_if(q(c).isNull()).alias(c) for c in df.columns])
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    return (stack(one, [], df.columns, "column", "missing")
            .where(F.col("missing") > 0).withColumn("missing_pct", ratio(F.col("missing") * 100, total)))


def value_shares(df: DataFrame, col: str) -> DataFrame:
    total = df.where(q(col).isNotNull()).agg(F.count(F.lit(1)).alias("n")).scalar()
    return (df.where(q(col).isNotNull()).groupBy(q(col).cast("string").alias("value"))
            .agg(F.count(F.lit(1)).alias("n")).withColumn("share", ratio(F.col("n"), total)))


def describe(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """count, mean, std, min, exact quartiles, max per numeric column."""
    cols = list(cols or numeric_columns(df))
    long = stack(df, [], cols, "column", "v", "double")
    basic = long.groupBy("column").agg(
        F.count("v").alias("count"), F.avg("v").alias("mean"), F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"), F.max("v").alias("max"))
    qs = exact_quantiles(long, "v", [0.25, 0.5, 0.75], ["column"])
    return (basic.join(qs.select("column", "q"), "column", "left")
            .select("column", "count", "mean", "std", "min", F.col("q")[0].alias("q25"),
                    F.col("q")[1].alias("q50"), F.col("q")[2].alias("q75"), "max"))


def box_stats(df: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """Quartiles, whiskers (last value within 1.5 IQR) and outlier count per group."""
    by = list(by)
    qs = exact_quantiles(df, value, [0.25, 0.5, 0.75], by).select(
        *by, F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"))
    iqr = F.col("q3") - F.col("q1")
    # group rows collapse by value before the join, so hot groups stay small
    counts = df.where(q(value).isNotNull()).groupBy(*by, q(value).cast("double").alias("__v")).agg(
        F.count(F.lit(1)).alias("__n"))
    inside = F.col("__v").between(F.col("q1") - 1.5 * iqr, F.col("q3") + 1.5 * iqr)
    return (counts.join(qs, by).groupBy(*by, "q1", "median", "q3")
            .agg(F.min(F.when(inside, F.col("__v"))).alias("whisker_low"),
                 F.max(F.when(inside, F.col("__v"))).alias("whisker_high"),
                 F.coalesce(F.sum(F.when(~inside, F.col("__n"))), F.lit(0)).alias("outliers")))


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson correlation of every column pair, long form (a, b, r) with a before b.

    Sums of products are gathered as small matrices in one scan, for any number of columns.
    """
    return pair_correlations(df, cols)


def correlated_series(panel: DataFrame, n: int = 5, key: str = ID, y: str = Y) -> DataFrame:
    """The n most correlated other series of each series: the key, other_id, r, rank.

    On a gap-free panel Pearson's r is the cosine of the centred series, so the block products of
    :func:`top_similar` give it for any number of series without a column or a row per pair.
    Constant series have no correlation and are left out.
    """
    whole = Window.partitionBy(key)
    centred = (panel.where(q(y).isNotNull()).withColumn("__c", q(y).cast("double") - F.avg(q(y).cast("double")).over(whole))
               .withColumn("__v", F.max(F.abs("__c")).over(whole)).where(F.col("__v") > 0))
    near = top_similar(centred.select(q(key).alias(ID), DS, F.col("__c").alias(Y)), n)
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("similarity")))
    return near.select(F.col(ID).alias(key), F.col("similar_id").alias("other_id"), r.alias("r"), "rank")


def strong_pairs(corr: DataFrame, border: float = 0.7) -> DataFrame:
    return corr.where(F.abs("r") > border)


def variances(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    cols = list(cols or numeric_columns(df))
    return (stack(df, [], cols, "column", "v", "double").groupBy("column")
            .agg(F.var_samp("v").alias("variance")))


def most_variable(df: DataFrame, k: int, cols: Sequence[str] | None = None) -> DataFrame:
    """The k columns of largest variance (a plot input)."""
    return variances(df, cols).orderBy(F.desc_nulls_last("variance"), "column").limit(k)


def feature_report(df: DataFrame) -> DataFrame:
    """Per column: kind, missing cells and variance of numeric ones."""
    kinds = {f.name: "numeric" if is_number(f.dataType) else
             "categorical" if f.name in text_columns(df) else "other" for f in df.schema.fields}
    one = df.agg(*[F.struct(
        F.lit(c).alias("column"), F.lit(kinds[c]).alias("kind"), count_if(q(c).isNull()).alias("missing"),
        (F.var_samp(q(c).cast("double")) if kinds[c] == "numeric" else F.lit(None).cast("double")
         ).alias("variance")).alias(f"c{i}") for i, c in enumerate(df.columns)])
    cells = F.array(*[F.col(f"c{i}") for i in range(len(df.columns))])
    return one.select(F.explode(cells).alias("c")).select("c.column", "c.kind", "c.missing", "c.variance")

