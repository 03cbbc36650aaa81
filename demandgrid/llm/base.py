"""Registry of the text queries, and helpers that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from demandgrid.session import ensure_checkpoint_dir

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable:
    """Register a query; unlike the library's own registry, results are left as they are."""

    def add(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the shared checkpoint folder and read it back.

    It cuts the lineage as a checkpoint does, but computes the rows once: an eager checkpoint runs a narrow plan
    twice.  The files survive lost executors; they go when the folder is cleaned."""
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it."""
    return F.transform(F.array(value), body)[0]


def fingerprint128(*parts: Column) -> Column:
    """Two independently seeded 64-bit hashes as one struct: a key for long strings that stays 16 bytes wide."""
    return F.struct(F.xxhash64(F.lit(17), *parts).alias("a"), F.xxhash64(F.lit(91), *parts).alias("b"))


def spread_rank(df: DataFrame, group: list[str], order: list[str], *, start: str = "position",
                size: str | None = None) -> DataFrame:
    """Gapless position of each row in its group (or, with ``size``, the sum of the sizes before it), from 0.

    No group meets in one task: ``order[0]`` is a hexadecimal hash whose first four digits cut every group into up to
    65,536 cells.  Rows are ordered inside a cell, and only the cells' totals are summed along a group.  The rows move
    once, for both the join with the totals and the window.  Group columns are never null.  Rows that agree in every
    column of ``order`` take their places in any order."""
    n = F.lit(1).cast("long") if size is None else F.col(size)
    cut = df.withColumn("__cell", F.substring(order[0], 1, 4))
    cell = [*group, "__cell"]
    totals = cut.groupBy(*cell).agg(F.sum(n).alias("__sum"))
    along = Window.partitionBy(*group).orderBy("__cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(*cell, F.coalesce(F.sum("__sum").over(along), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*cell).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(n).over(inside), F.lit(0))
    return cut.join(starts, cell).select(*df.columns, (F.col("__start") + before).cast("long").alias(start))
