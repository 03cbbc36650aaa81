"""Exactness on awkward inputs: hot groups, ties, gaps, shuffled rows, many partitions."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import values
from demandgrid.functions.core import DS, ID, Y, round_doubles
from demandgrid.functions.moments import pair_correlations
from demandgrid.functions.quantiles import exact_quantiles
from demandgrid.functions.tdist import two_sided_p
from demandgrid.operators import intervals, joins, profile, reshape, similarity
from demandgrid.operators.panel import fill_gaps, to_panel


@pytest.mark.parametrize("halvings", [1, 4])
def test_exact_quantiles_with_a_hot_group_and_ties(spark, halvings):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": ["hot"] * 3000 + ["small"] * 7 + [None] * 50,
                        "v": np.concatenate([rng.integers(0, 40, 1500), rng.normal(0, 1e6, 1500), np.arange(7), rng.normal(size=50)])})
    probs = [0.0, 0.1, 0.25, 0.5, 0.85, 1.0]
    got = {r.g: r for r in exact_quantiles(spark.createDataFrame(pdf, "g string, v double"), "v", probs, ["g"], halvings).collect()}
    for g, part in pdf.groupby("g", dropna=False):
        key = None if pd.isna(g) else g
        assert got[key].n == len(part)
        assert got[key].q == pytest.approx(np.quantile(part.v, probs), rel=1e-12, abs=1e-12)


def test_exact_quantiles_weighted_and_single_value(spark):
    df = spark.createDataFrame([(1.0, 3), (2.0, 1)], "v double, n bigint")
    assert exact_quantiles(df, "v", [0.5, 0.9], weight="n").first().q == pytest.approx(np.quantile([1, 1, 1, 2], [0.5, 0.9]))
    one = spark.createDataFrame([(5.0,), (None,)], "v double")
    r = exact_quantiles(one, "v", [0.3]).first()
    assert (r.n, r.q) == (1, [5.0])


def test_pair_correlations_match_pandas(spark):
    rng = np.random.default_rng(2)
    pdf = pd.DataFrame(rng.normal(1e6, 1, (500, 8)), columns=list("abcdefgh"))
    pdf["b"] = pdf["a"] * 2 + rng.normal(size=500)
    pdf.loc[::7, "c"] = np.nan
    pdf["h"] = 3.0
    want = pdf.corr()
    got = pair_correlations(spark.createDataFrame(pdf).repartition(5), list(pdf.columns)).collect()
    assert len(got) == 28
    for r in got:
        w = want.loc[r.a, r.b]
        assert (r.r is None) if np.isnan(w) else r.r == pytest.approx(w, abs=1e-8)


def brute_similar(y, n):
    names = sorted(y)
    m = np.array([y[k] for k in names], dtype=float)
    norm = np.sqrt((m * m).sum(1))
    norm[norm == 0] = 1
    sim = (m / norm[:, None]) @ (m / norm[:, None]).T
    out = {}
    for i, k in enumerate(names):
        order = sorted((j for j in range(len(names)) if j != i), key=lambda j: (-round(sim[i, j], 12), names[j]))
        out[k] = [names[j] for j in order[:n]], [sim[i, j] for j in order[:n]]
    return out


@pytest.mark.parametrize("block", [3, 1000])
def test_similarity_blocks_are_exact(series, block):
    rng = np.random.default_rng(3)
    y = {f"s{i:02d}": (rng.integers(0, 5, 30) * (rng.random(30) < 0.3)).tolist() for i in range(20)}
    y["s05"] = [0] * 30
    want = brute_similar(y, 4)
    got = similarity.top_similar(series(y, 7), 4, block=block).orderBy(ID, "rank").collect()
    assert len(got) == 20 * 4
    for k in y:
        mine = [r for r in got if r.unique_id == k]
        assert [r.similarity for r in mine] == pytest.approx(want[k][1], abs=1e-9)


def test_similarity_within_groups(series):
    y = {"A__1": [1, 0, 2], "A__2": [1, 0, 2], "B__1": [1, 0, 2], "B__2": [0, 3, 0]}
    got = {r.unique_id: r.similar_id for r in similarity.top_similar(series(y), 1, F.split(ID, "__")[0]).collect()}
    assert got == {"A__1": "A__2", "A__2": "A__1", "B__1": "B__2", "B__2": "B__1"}


def reference_since(y, sale):
    out, n = [], 0
    for v in y:
        counted = v == 0 if sale else v > 0
        n = n + 1 if counted else 0
        out.append(n)
    return out


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.sampled_from(["a", "b", "c"]), st.lists(st.integers(0, 2), min_size=1, max_size=25), min_size=1))
def test_periods_since_property(series, y):
    p = series(y, 6)
    for name, fn, sale in (("periods since last sales", intervals.periods_since_last_sale, True),
                           ("periods since last 0 sales", intervals.periods_since_last_zero, False)):
        want = [v for k in sorted(y) for v in reference_since(y[k], sale)]
        assert values(fn(p), name) == want


def test_order_and_partitioning_do_not_matter(series):
    rng = np.random.default_rng(4)
    y = {f"s{i}": rng.integers(0, 3, 40).tolist() for i in range(5)}
    ops = [profile.adi_cv2, profile.interval_stats, profile.monthly_changes, profile.demand_stats, intervals.rolling_stats]
    for op in ops:
        # sums merge in another order, so the last bits may differ
        a = sorted(map(str, round_doubles(op(series(y, 1)), 9).collect()))
        b = sorted(map(str, round_doubles(op(series(y, 64).orderBy(F.rand(1))), 9).collect()))
        assert a == b, op.__name__


def test_fill_gaps_and_hot_key(spark):
    day = dt.date(2020, 1, 1)
    rows = [("hot", day + dt.timedelta(i % 3)) for i in range(3000)] + [("cold", day + dt.timedelta(4))]
    raw = spark.createDataFrame(rows, "k string, d date")
    p = to_panel(raw, F.col("k"), F.col("d"))
    assert p.groupBy(ID, DS).count().where("count > 1").isEmpty()
    full = fill_gaps(p, day, day + dt.timedelta(5))
    assert values(full, Y) == [0, 0, 0, 0, 1, 0, 1000, 1000, 1000, 0, 0, 0]


def test_ewm_matches_pandas(series):
    y = {"a": [1, 0, 4, 2, 0, 0, 9], "b": [3]}
    got = values(intervals.ewm_mean(series(y), 0.4), "ewm_lag1_alpha0.4")
    want = pd.Series(y["a"]).ewm(alpha=0.4, adjust=False).mean().shift(1).tolist() + [None]
    assert got[0] is None and got[-1] is None and got[1:-1] == pytest.approx(want[1:-1])


def test_two_sided_p_against_table_values():
    # Two-sided 5 % and 1 % points of Student's t.
    for dof, t5, t1 in ((1, 12.7062, 63.6567), (10, 2.22814, 3.16927), (30, 2.04227, 2.75), (1000, 1.96234, 2.58076)):
        assert two_sided_p(t5, dof) == pytest.approx(0.05, abs=2e-5)
        assert two_sided_p(-t1, dof) == pytest.approx(0.01, abs=2e-5)
    assert two_sided_p(0.0, 5) == pytest.approx(1.0) and two_sided_p(None, 5) is None


def test_constant_columns_have_no_correlation(series):
    r = profile.residual_stats(series({"a": [1, 1, 1]}).withColumn("model", F.lit("m")).withColumn("y_hat", F.lit(0.5))).first()
    assert r.correlation is None and r.mae == 0.5


def test_combine_needs_matching_rows(series):
    a = series({"a": [1, 2]}).withColumn("M", F.lit(1.0))
    b = series({"z": [1, 2]}).withColumn("N", F.lit(1.0))
    with pytest.raises(ValueError, match="matched no row"):
        joins.combine_predictions(a, b, check=True)


def test_wide_row_filters_agree_with_the_panel_filters(spark):
    rows = [("s", "a", 0, 1, 0, 2, None), ("s", "b", 0, 0, 0, 1, 0), ("s", "c", 9, 9, 9, 9, 9)]
    wide = spark.createDataFrame(rows, "store string, item string, d_1 int, d_2 int, d_3 int, d_4 int, d_5 int")
    arrays, codes = reshape.day_arrays(wide, ["store", "item"])
    assert [r.item for r in reshape.where_mean_between(arrays, 0.1, 0.8).collect()] == ["a", "b"]
    assert [r.item for r in reshape.where_quantile_positive(arrays, codes, "d_2", "d_5", 0.5).collect()] == ["a", "c"]
    assert reshape.explode_days(arrays, codes).count() == 15


def test_binary_columns(spark):
    df = spark.createDataFrame([(0, True, 2, None), (1, False, 1, None)], "a int, b boolean, c int, d int")
    assert reshape.binary_columns(df) == ["a", "b", "d"]
