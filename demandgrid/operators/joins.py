"""Joins between series, calendar, prices and predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, flag, q


def with_calendar(series: DataFrame, cal: DataFrame, on: str | Sequence[str] = "date") -> DataFrame:
    """Inner join on the date (or state and date); the calendar's statistics decide how."""
    return series.join(cal, on)


def with_prices(rows: DataFrame, prices: DataFrame,
                keys: Sequence[str] = ("store_id", "item_id", "wm_yr_wk")) -> DataFrame:
    """Weekly price beside each row; no price means 0 and the item is not on sale."""
    joined = rows.join(prices, list(keys), "left")
    return (joined.withColumn("sell_price", F.coalesce("sell_price", F.lit(0.0)))
            .withColumn("is_item_exists", flag(F.col("sell_price") > 0)))


def daily_prices(prices: DataFrame, cal: DataFrame) -> DataFrame:
    """Weekly prices on each day of their week."""
    return prices.join(cal.select("wm_yr_wk", "date"), "wm_yr_wk").drop("wm_yr_wk")


def sales_beside_price(sales: DataFrame, daily: DataFrame,
                       on: Sequence[str] = ("store_id", "item_id", "date")) -> DataFrame:
    return sales.join(daily, list(on), "left")


def checked_join(left: DataFrame, right: DataFrame, on: str | Sequence[str], how: str = "inner") -> DataFrame:
    """Join that refuses an empty result (one short job to look for a first row)."""
    out = left.join(right, on, how)
    if out.isEmpty():
        raise ValueError(f"join on {on} matched no row")
    return out


def combine_predictions(model: DataFrame, baseline: DataFrame, check: bool = False) -> DataFrame:
    """Model and baseline predictions side by side, matched on series, day and cutoff (those both have).

    The actual value is no key: it comes from the model's side.  ``check`` refuses a result whose rows are not
    those of the model, one for one, as when cutoffs differ.
    """
    shared = [c for c in model.columns if c in baseline.columns and c in (ID, DS, "cutoff")]

    def tidy(df: DataFrame) -> DataFrame:
        dates = [c for c in (DS, "cutoff") if c in df.columns]
        df = df.withColumns({c: q(c).try_cast("date") for c in dates})
        if ID in df.columns:
            df = df.withColumn(ID, q(ID).cast("string"))
        if Y in df.columns:
            df = df.withColumn(Y, q(Y).try_cast("double"))
        return df.dropna(subset=[c for c in (*dates, Y) if c in df.columns])

    a, b = tidy(model), tidy(baseline)
    out = a.join(b.drop(*[c for c in b.columns if c in a.columns and c not in shared]), shared)
    if check:
        have, want = out.count(), a.count()
        if not have:
            raise ValueError(f"join on {shared} matched no row")
        if have != want:
            raise ValueError(f"{want} predictions met baselines on {shared} in {have} rows")
    return out


def join_models(parts: Mapping[str, DataFrame], keys: Sequence[str] = (ID, DS, "cutoff", Y)) -> DataFrame:
    """Predictions of many models as columns: stacked long, then one pivot and one shuffle.

    Rows lacking one of the models are left out, as an inner join would.
    """
    names = list(parts)
    long = None
    for name, df in parts.items():
        one = df.select(*keys, F.lit(name).alias("model"), q(name).cast("double").alias("y_hat"))
        long = one if long is None else long.unionByName(one)
    return (long.groupBy(*keys).pivot("model", names).agg(F.first("y_hat"))
            .dropna(subset=names))


def same_ids(a: DataFrame, b: DataFrame, key: str = ID) -> DataFrame:
    """Keys present on one side only, with that side's name; empty when both sets agree."""
    ids_a, ids_b = a.select(key).distinct(), b.select(key).distinct()
    return (ids_a.join(ids_b, key, "left_anti").withColumn("only_in", F.lit("left"))
            .unionByName(ids_b.join(ids_a, key, "left_anti").withColumn("only_in", F.lit("right"))))


def concat_panels(first: DataFrame, second: DataFrame) -> DataFrame:
    """Rows of both, matched by column name."""
    return first.unionByName(second)
