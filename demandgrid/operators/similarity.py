"""Cosine similarity of whole series, nearest neighbours only.

The result keeps n rows per series, so no table of pairs is ever written: series are cut into
hash blocks of bounded size, each pair of blocks is one task-sized matrix product, and every
product sends on just the n best partners of each of its series.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators.intervals import top_per_group


def _matrix(rows: pd.DataFrame, first: int, n_days: int) -> np.ndarray:
    m = np.zeros((len(rows), n_days))
    for i, (days, vals) in enumerate(zip(rows["days"], rows["vals"])):
        m[i, days - first] = vals
    norm = np.sqrt((m * m).sum(axis=1))
    norm[norm == 0] = 1.0
    return m / norm[:, None]


def _best(sim: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> pd.DataFrame:
    """n best partners of each left series; ties go to the smaller key."""
    order = np.argsort(right, kind="stable")
    sim, right = sim[:, order], right[order]
    sim = np.where(left[:, None] == right[None, :], -np.inf, sim)
    top = np.argsort(-sim, axis=1, kind="stable")[:, :n]
    picked = np.take_along_axis(sim, top, axis=1)
    keep = np.isfinite(picked)
    who = np.repeat(left, top.shape[1]).reshape(top.shape)
    return pd.DataFrame({ID: who[keep], "similar_id": right[top][keep], "similarity": picked[keep]})


def top_similar(panel: DataFrame, n: int = 5, within: Column | None = None, block: int = 512) -> DataFrame:
    """The n most similar other series of each series: unique_id, similar_id, similarity, rank.

    ``within`` restricts partners to the same group, e.g. the same store.  A group of any size is
    split into blocks, so a large one spreads over many tasks.
    """
    group = F.lit("") if within is None else within.cast("string")
    # one row per series, bounded by its days; all-zero series keep empty arrays
    vectors = (panel.groupBy(group.alias("__g"), ID)
               .agg(F.collect_list(F.when(F.col(Y) != 0, F.struct(
                   F.unix_date(DS).alias("d"), F.col(Y).cast("double").alias("v")))).alias("__c"))
               .select("__g", ID, F.transform("__c", lambda c: c["d"]).alias("days"),
                       F.transform("__c", lambda c: c["v"]).alias("vals")))
    n_blocks = F.ceil(F.count(F.lit(1)) / block).cast("int").alias("__nb")
    # series are counted on their ids, before gaps are filled; a single group is no join
    ids = panel.select(group.alias("__g"), ID).distinct()
    sized = (vectors.withColumn("__nb", ids.agg(n_blocks).scalar()) if within is None
             else vectors.join(ids.groupBy("__g").agg(n_blocks), "__g"))
    sized = sized.withColumn("__b", F.pmod(F.xxhash64(ID), F.col("__nb")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("__nb") - 1))
    placed = (sized.withColumn("__o", other)
              .select("__g", F.least("__b", "__o").alias("__p"), F.greatest("__b", "__o").alias("__q"),
                      "__b", ID, "days", "vals"))

    def product(pdf: pd.DataFrame) -> pd.DataFrame:
        p, q_ = pdf["__p"].iloc[0], pdf["__q"].iloc[0]
        sold = [d for d in pdf["days"] if len(d)]
        first = min((int(d.min()) for d in sold), default=0)
        n_days = max((int(d.max()) for d in sold), default=0) - first + 1
        a = pdf[pdf["__b"] == p]
        ma, ka = _matrix(a, first, n_days), a[ID].to_numpy()
        if p == q_:
            return _best(ma @ ma.T, ka, ka, n)
        b = pdf[pdf["__b"] == q_]
        sim, kb = ma @ _matrix(b, first, n_days).T, b[ID].to_numpy()
        return pd.concat([_best(sim, ka, kb, n), _best(sim.T, kb, ka, n)], ignore_index=True)

    found = placed.groupBy("__g", "__p", "__q").applyInPandas(
        product, f"{ID} string, similar_id string, similarity double")
    return top_per_group(found, [ID], [F.desc("similarity"), F.col("similar_id")], n)
