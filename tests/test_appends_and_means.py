"""Runs appended twice or cut short are read once or not at all; exponential means over many chunks, without Python."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import intervals
from demandgrid.sources import files

from conftest import values


def test_runs_are_read_once(spark, tmp_path):
    path, schema = str(tmp_path / "history"), "name string, score double"
    rows = lambda *x: spark.createDataFrame(list(x), schema)
    files.append_run(rows(("a", 1.0), ("b", 2.0)), path, "monday")
    files.append_run(rows(("a", 3.0)), path, "tuesday")
    files.append_run(rows(("a", 1.0), ("b", 2.0)), path, "monday")
    rows(("a", 9.0)).withColumn("run", F.lit("wednesday")).write.mode("append").partitionBy("run").parquet(f"{path}/rows")   # killed before its commit
    read = lambda: sorted(map(tuple, files.read_runs(spark, path, schema).collect()))
    assert read() == [("a", 1.0, "monday"), ("a", 3.0, "tuesday"), ("b", 2.0, "monday")]
    files.append_run(rows(("a", 4.0)), path, "wednesday")
    files.append_run(rows(), path, "monday")
    assert read() == [("a", 3.0, "tuesday"), ("a", 4.0, "wednesday")]
    with pytest.raises(ValueError):
        files.append_run(rows().withColumn("run", F.lit(1)), path, "x")


@pytest.mark.parametrize("alpha", [0.01, 0.3, 0.97, 1.0])
def test_exponential_mean_over_chunks(series, alpha):
    rng = np.random.default_rng(5)
    y = {"a": [float(v) if rng.random() > 0.1 else None for v in rng.normal(5, 3, 400)], "b": [None, None, 2.0, None, 4.0], "c": [None] * 3}
    df = intervals.ewm_mean(series(y, 3), alpha, lag=2)
    assert "Arrow" not in df._jdf.queryExecution().executedPlan().toString() and df.columns == [ID, DS, Y, f"ewm_lag2_alpha{alpha}"]
    got, want = values(df, f"ewm_lag2_alpha{alpha}"), []
    for ys in y.values():
        m = pd.Series(ys, dtype=float).ewm(alpha=alpha, adjust=False, ignore_na=True).mean().ffill().shift(2)
        want += [None if np.isnan(v) else v for v in m]
    assert [v is None for v in got] == [v is None for v in want]
    assert [v for v in got if v is not None] == pytest.approx([v for v in want if v is not None], rel=1e-9)
