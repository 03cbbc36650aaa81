"""Sums of products of many columns, gathered as small matrices in one distributed pass."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import q


def _added(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Element-wise sum of the ``m`` arrays per key: (keys, pos, total), combined map-side."""
    return (rows.select(*keys, F.posexplode("m").alias("pos", "v"))
            .groupBy(*keys, "pos").agg(F.sum("v").alias("total")))


def pair_correlations(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Pearson r of every column pair over the rows where both are present (a, b, r).

    Values are shifted by their column means first, so the sums do not cancel.
    """
    cols, p = list(cols), len(cols)
    present = {c: F.nanvl(q(c).cast("double"), F.lit(None).cast("double")) for c in cols}
    means = df.agg(*[F.avg(v) for v in present.values()]).first()
    shift = np.array([m if m is not None else 0.0 for m in means])

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc = np.zeros((4, p, p))
        for pdf in batches:
            x = pdf.to_numpy(dtype=float) - shift
            there = ~np.isnan(x)
            x, m = np.where(there, x, 0.0), there.astype(float)
            acc += np.stack([m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x])
        yield pd.DataFrame({"m": [acc.ravel()]})

    parts = df.select(*[v.alias(c) for c, v in present.items()]).mapInPandas(sums, "m array<double>")
    kind, at = F.floor(F.col("pos") / (p * p)), F.col("pos") % (p * p)
    i, j = F.floor(at / p).cast("int"), (at % p).cast("int")
    lo, hi = F.least("i", "j"), F.greatest("i", "j")

    def pick(k: int, turned: bool | None = None):
        side = F.lit(True) if turned is None else (F.col("i") > F.col("j")) == F.lit(turned)
        return F.max(F.when((F.col("k") == k) & side, F.col("total")))

    cell = (_added(parts, []).select(kind.alias("k"), i.alias("i"), j.alias("j"), "total")
            .where(F.col("i") != F.col("j")).groupBy(lo.alias("lo"), hi.alias("hi"))
            .agg(pick(0).alias("n"), pick(1, False).alias("sa"), pick(1, True).alias("sb"),
                 pick(2, False).alias("saa"), pick(2, True).alias("sbb"), pick(3).alias("sab")))
    n = F.col("n")
    va = F.col("saa") - F.try_divide(F.col("sa") * F.col("sa"), n)
    vb = F.col("sbb") - F.try_divide(F.col("sb") * F.col("sb"), n)
    cov = F.col("sab") - F.try_divide(F.col("sa") * F.col("sb"), n)
    # a constant column leaves only rounding noise: no correlation
    flat = (va <= 1e-12 * F.col("saa")) | (vb <= 1e-12 * F.col("sbb"))
    r = F.when(~flat, F.try_divide(cov, F.sqrt(va) * F.sqrt(vb)))
    r = F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))
    names = F.array(*[F.lit(c) for c in cols])
    return cell.select(F.element_at(names, F.col("lo") + 1).alias("a"), F.element_at(names, F.col("hi") + 1).alias("b"),
                       r.alias("r"))
