"""Exact quantiles with linear interpolation for groups of any size.

``percentile`` keeps a value-to-count map of each group in one task.  That is right for a series
(bounded by its days) but not for one group holding a third of a 100 TB table, so
:func:`exact_quantiles` finds the wanted ranks by counting instead:

1. rows collapse to (group, value, count) with map-side combining;
2. one range exchange sorts these, and they are written with the number of their range, so that all that
   follows reads them back instead of the input;
3. the ranges' totals give every range the ranks it begins with, and only ranges that hold a wanted rank are read.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.session import cut_lineage


def series_quantile(value: Column, p: float | Sequence[float]) -> Column:
    """Exact interpolated quantile of one bounded group, e.g. a series."""
    if isinstance(p, (int, float)):
        return F.percentile(value, F.lit(float(p)))
    return F.percentile(value, F.array(*[F.lit(float(x)) for x in p]))


def in_ranges(df: DataFrame, keys: Sequence[str], value: str, rows: str, parts: int | None = None) -> DataFrame:
    """Distinct ``value``s per ``keys``, range by range: written once with ``__range`` and, from the totals of the
    ranges, the rows of smaller ranges (``__before``), and the group's rows and distinct values (``__total``,
    ``__distinct``).  ``rows`` is the column of row counts; a hot group is spread over as many ranges as it needs."""
    order = [*keys, value]
    dealt = df.repartitionByRange(parts, *order) if parts else df.repartitionByRange(*order)
    placed = cut_lineage(dealt.sortWithinPartitions(*order).withColumn("__range", F.spark_partition_id()))
    totals = placed.groupBy(*keys, "__range").agg(F.sum(rows).alias("__rows"), F.count(F.lit(1)).alias("__values"))
    group = Window.partitionBy(*keys)   # at most a row per range
    smaller = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*keys, "__range", "__rows", F.coalesce(F.sum("__rows").over(smaller), F.lit(0)).alias("__before"),
                           F.sum("__rows").over(group).alias("__total"), F.sum("__values").over(group).alias("__distinct"))
    return null_safe_join(placed, totals, [*keys, "__range"])


def before_each(ranged: DataFrame, keys: Sequence[str], value: str, rows: str) -> Column:
    """Rows of the group with smaller values, for rows of :func:`in_ranges`."""
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    return F.col("__before") + F.coalesce(F.sum(rows).over(inside), F.lit(0))


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    parts: int | None = None, weight: str | None = None) -> DataFrame:
    """One row per group: ``by`` columns, ``n`` (non-null values), ``n_distinct`` and ``q``
    (array, one per prob).

    ``weight`` names a column of row counts when the input is already collapsed; ``parts`` is the number of ranges,
    by default that of shuffle partitions.
    """
    by = list(by)
    keys = by or ["__all"]
    src = df if by else df.withColumn("__all", F.lit(0))
    counts = (src.where(F.col(value).isNotNull())
              .groupBy(*keys, F.col(value).cast("double").alias("__v"))
              .agg((F.sum(weight) if weight else F.count(F.lit(1))).alias("__n")))
    ranged = in_ranges(counts, keys, "__v", "__n", parts)
    # a wanted position lies between two neighbouring ranks, each with a share of the result
    pos = [F.lit(float(p)) * (F.col("__total") - 1) for p in probs]
    ranks = F.array(*[
        F.struct(F.lit(i).alias("i"), rank.alias("k"), share.alias("w"))
        for i, x in enumerate(pos)
        for rank, share in ((F.floor(x), 1 - (x - F.floor(x))), (F.ceil(x), x - F.floor(x)))])

    def held(first: Column, n: Column) -> Column:
        return F.filter(ranks, lambda r: (r["k"] >= first) & (r["k"] < first + n))

    wanted = ranged.where(F.size(held(F.col("__before"), F.col("__rows"))) > 0)
    hit = (wanted.withColumn("__first", before_each(wanted, keys, "__v", "__n"))
           .withColumn("__r", F.explode(held(F.col("__first"), F.col("__n")))))
    out = hit.groupBy(*keys, F.col("__total").alias("n"), F.col("__distinct").alias("n_distinct")).agg(*[
        F.sum(F.when(F.col("__r.i") == i, F.col("__v") * F.col("__r.w"))).alias(f"__q{i}") for i in range(len(probs))])
    return out.select(*by, "n", "n_distinct", F.array(*[F.col(f"__q{i}") for i in range(len(probs))]).alias("q"))


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner equi-join in which NULL keys match each other."""
    r = right.select(*[F.col(k).alias(f"__k_{k}") for k in keys],
                     *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(r[f"__k_{k}"])
        cond = c if cond is None else cond & c
    return left.join(r, cond).drop(*[f"__k_{k}" for k in keys])
