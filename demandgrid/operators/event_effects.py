"""Demand on event days against other days."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, Y, q, ratio
from demandgrid.functions.tdist import t_pvalue


def _by_event(df: DataFrame, flags: Sequence[str], y: str) -> DataFrame:
    """Count, sum and sum of squares of y on and off each event.

    Rows first collapse to distinct flag combinations; only those few are unpivoted, so the
    table is not multiplied by the number of events.  Sums are taken about the overall mean, ``centre``, from
    moments that merge without cancelling.
    """
    v = q(y).cast("double")
    combos = (df.groupBy(*[q(f).cast("int").alias(f) for f in flags])
              .agg(F.count(F.lit(1)).alias("__rows"), F.count(v).alias("__n"), F.avg(v).alias("__m"),
                   F.var_pop(v).alias("__var")))
    everything = Window.partitionBy()  # a row per combination of flags, at most one per day
    off = F.col("__m") - F.col("__centre")
    combos = (combos.withColumn("__centre", F.try_divide(F.sum(F.col("__n") * F.col("__m")).over(everything),
                                                         F.sum("__n").over(everything)))
              .withColumn("__s", F.col("__n") * off).withColumn("__ss", F.col("__n") * (F.col("__var") + off * off))
              .drop("__m", "__var"))
    long = combos.unpivot(["__rows", "__n", "__s", "__ss", "__centre"], list(flags), "event", "on")

    def side(col: str, value: int):
        return F.coalesce(F.sum(F.when(F.col("on") == value, F.col(col))), F.lit(0))

    return long.groupBy("event").agg(
        F.max("__centre").alias("centre"), side("__rows", 1).alias("event_count"), F.sum("__rows").alias("n_rows"),
        side("__n", 1).alias("n1"), side("__s", 1).alias("s1"), side("__ss", 1).alias("ss1"),
        side("__n", 0).alias("n0"), side("__s", 0).alias("s0"), side("__ss", 0).alias("ss0"))


def event_impact(df: DataFrame, flags: Sequence[str], y: str = Y) -> DataFrame:
    """Mean demand on and off each event, lift in %, frequency in %, family."""
    on, off = (F.col("centre") + ratio(F.col(f"s{i}"), F.col(f"n{i}")) for i in (1, 0))
    return (_by_event(df, flags, y)
            .select("event",
                    F.when(F.lower("event").startswith("snap"), "SNAP").otherwise("Other").alias("family"),
                    on.alias("event_sales"), off.alias("non_event_sales"),
                    F.when(off > 0, (on - off) * 100 / F.nullif(off, F.lit(0.0))).otherwise(0.0).alias("impact_pct"),
                    ratio(F.col("event_count") * 100, F.col("n_rows")).alias("event_frequency_pct"),
                    "event_count"))


def event_tests(df: DataFrame, flags: Sequence[str], y: str = Y) -> DataFrame:
    """Pooled two-sample t statistic, its degrees of freedom, and Cohen's d with its size class."""
    m1, m0 = ratio(F.col("s1"), F.col("n1")), ratio(F.col("s0"), F.col("n0"))
    dof = F.col("n1") + F.col("n0") - 2
    # squared deviations from the side means, without a second pass
    dev = (F.col("ss1") - F.col("n1") * m1 * m1) + (F.col("ss0") - F.col("n0") * m0 * m0)
    pooled = F.sqrt(ratio(dev, dof))
    spread = pooled * F.sqrt(F.try_divide(F.lit(1.0), F.col("n1")) + F.try_divide(F.lit(1.0), F.col("n0")))
    d = F.abs("cohens_d")
    return (_by_event(df, flags, y)
            .select("event", dof.alias("dof"), F.try_divide(m1 - m0, spread).alias("t_stat"),
                    F.try_divide(m1 - m0, pooled).alias("cohens_d"))
            .withColumn("effect_size", F.when(d < 0.2, "Small").when(d < 0.5, "Medium").otherwise("Large")))


def with_significance(tests: DataFrame, level: float = 0.05) -> DataFrame:
    """Two-sided p-value per event row and whether it is below the level."""
    return (tests.withColumn("p_value", t_pvalue(F.col("t_stat"), F.col("dof").cast("double")))
            .withColumn("significance", F.when(F.col("p_value") < level, "Significant")
                        .otherwise("Not Significant")))


def event_timeline(df: DataFrame, flag: str, y: str = Y) -> DataFrame:
    """Daily demand with the day's event flag."""
    return df.groupBy(DS).agg(F.sum(y).alias("total_y"), F.max(q(flag)).alias("is_event"))
