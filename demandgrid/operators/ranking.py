"""Top-k reports over metric, event, feature and value tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import q, stack
from demandgrid.operators.intervals import top_per_group

# Metrics tried in this order when the wanted one is absent.
FALLBACK_METRICS = ("mae", "rmse", "mse", "mape")


def _metric_name(metrics: DataFrame, wanted: str) -> str:
    for name in (wanted, *FALLBACK_METRICS):
        if name in metrics.columns:
            return name
    raise ValueError(f"no column {wanted} or one of {FALLBACK_METRICS} in {metrics.columns}")


def top_k(metrics: DataFrame, model: str, group: Sequence[str], metric: str = "mae", k: int = 10,
          best: bool = True) -> DataFrame:
    """The k groups with the lowest (best) or highest error of one model."""
    name = _metric_name(metrics, metric)
    order = F.asc_nulls_last(name) if best else F.desc_nulls_last(name)
    return (metrics.where(F.col("model") == model).orderBy(order, *group).limit(k)
            .select(*group, "model", name))


def top_k_both_ends(metrics: DataFrame, group: Sequence[str], metric: str = "mae", k: int = 10) -> DataFrame:
    """Best and worst k groups of every model."""
    name = _metric_name(metrics, metric)
    best = top_per_group(metrics, ["model"], [F.asc_nulls_last(name), *[F.col(g) for g in group]], k)
    worst = top_per_group(metrics, ["model"], [F.desc_nulls_last(name), *[F.col(g) for g in group]], k)
    cols = ["model", *group, name, "rank"]
    return (best.select(F.lit("best").alias("end"), *cols)
            .unionByName(worst.select(F.lit("worst").alias("end"), *cols)))


def top_k_by_mean(long: DataFrame, model: str, group: Sequence[str], k: int = 3, best: bool = True) -> DataFrame:
    """Groups ranked by the mean of all their metrics except f1_zero (long form: metric, value)."""
    mean = (long.where((F.col("model") == model) & (F.col("metric") != "f1_zero"))
            .groupBy(*group).agg(F.avg("value").alias("mean_value")))
    return mean.orderBy(F.asc_nulls_last("mean_value") if best else F.desc_nulls_last("mean_value"), *group).limit(k)


def strongest_events(impact: DataFrame, k: int = 5) -> DataFrame:
    """The k events lifting and the k events lowering demand most."""
    up = impact.where(F.col("impact_pct") > 0).orderBy(F.desc("impact_pct"), "event").limit(k)
    down = impact.where(F.col("impact_pct") < 0).orderBy(F.asc("impact_pct"), "event").limit(k)
    return (up.select(F.lit("positive").alias("side"), "event", "impact_pct")
            .unionByName(down.select(F.lit("negative").alias("side"), "event", "impact_pct")))


def top_features(importance: DataFrame, k: int, absolute: bool = True, value: str = "importance") -> DataFrame:
    """Features of largest (absolute) mean importance."""
    strength = F.abs(q(value)) if absolute else q(value)
    return importance.orderBy(F.desc(strength), "feature").limit(k)


def top_values(df: DataFrame, cols: Sequence[str], k: int = 5) -> DataFrame:
    """Most frequent values of each text column."""
    counts = (stack(df, [], cols, "column", "value", "string").where(F.col("value").isNotNull())
              .groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")))
    return top_per_group(counts, ["column"], [F.desc("n"), F.col("value")], k)
