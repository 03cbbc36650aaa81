"""Building gap-free daily panels from raw rows."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, day


def to_panel(rows: DataFrame, unique_id: Column, ds: Column, y: Column | None = None) -> DataFrame:
    """One row per (unique_id, ds) with ``y`` the given aggregate (default: row count).

    Raw rows collapse map-side, so a key with a third of all rows ships at most one row per
    day and task.  Afterwards no series is longer than the calendar.
    """
    y = F.count(F.lit(1)) if y is None else y
    # the source may have columns of these names itself
    return (rows.select("*", unique_id.alias("__id"), ds.cast("date").alias("__ds")).groupBy("__id", "__ds")
            .agg(y.alias(Y)).withColumnsRenamed({"__id": ID, "__ds": DS}))


def date_bounds(rows: DataFrame, ds: Column) -> tuple[date, date]:
    """First and last date: one aggregate row to the driver."""
    r = rows.agg(F.min(ds.cast("date")), F.max(ds.cast("date"))).first()
    return r[0], r[1]


def daily_dates(spark: SparkSession, start: date, end: date) -> DataFrame:
    """One row per day.  Built from ``range``, so its size is known to the optimizer."""
    n = (end - start).days + 1
    return spark.range(n).select(F.date_add(day(start), F.col("id").cast("int")).alias(DS))


def fill_gaps(panel: DataFrame, start: Column | date | str, end: Column | date | str,
              key: str = ID, ds: str = DS, y: str = Y) -> DataFrame:
    """Every series on every day of [start, end]; absent days get y = 0.

    Each row is stretched up to the day before its successor, so the only exchange is the one
    on the series key that later windows reuse: no skeleton table and no join.  That exchange
    names its partition count: rows multiply right after it, so merging partitions by their size
    before the stretch would leave too few tasks.
    """
    parts = int(panel.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    w = Window.partitionBy(key).orderBy(ds)
    lo, hi = day(start), day(end)
    inside = panel.where(F.col(ds).between(lo, hi)).repartition(parts, F.col(key))
    nxt = F.lead(ds).over(w)
    stretched = inside.select(
        key, F.col(ds).alias("__at"), F.col(y).alias("__y"),
        F.when(F.row_number().over(w) == 1, lo).otherwise(F.col(ds)).alias("__from"),
        F.coalesce(F.date_sub(nxt, 1), hi).alias("__to"))
    zero = F.lit(0).cast(panel.schema[y].dataType)
    return (stretched
            .withColumn(ds, F.explode(F.sequence("__from", "__to")))
            .select(key, ds, F.when(F.col(ds) == F.col("__at"), F.col("__y")).otherwise(zero).alias(y)))
