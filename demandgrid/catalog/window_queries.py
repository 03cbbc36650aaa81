"""Order-dependent operators and their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import query, with_panel
from demandgrid.functions.core import ID, Y
from demandgrid.operators import intervals as w
from demandgrid.operators import similarity

RUN_CTE = """
run AS (SELECT *, sum((y > 0)::INTEGER) OVER s AS g, sum((y = 0)::INTEGER) OVER s AS z
  FROM panel WINDOW s AS (PARTITION BY unique_id ORDER BY ds))"""
WIN = "WINDOW w AS (PARTITION BY unique_id ORDER BY ds)"


@query("periods_since_last_sale", with_panel("""
SELECT unique_id, ds, y, CASE WHEN y = 0 THEN sum((y = 0)::INTEGER) OVER (PARTITION BY unique_id, g ORDER BY ds)
  ELSE 0 END::BIGINT AS "periods since last sales" FROM run""", "nation", RUN_CTE))
def periods_since_last_sale(spark, sf):
    return w.periods_since_last_sale(b.panel(spark, sf, "nation"))


@query("periods_since_last_zero", with_panel("""
SELECT unique_id, ds, y, CASE WHEN y > 0 THEN sum((y > 0)::INTEGER) OVER (PARTITION BY unique_id, z ORDER BY ds)
  ELSE 0 END::BIGINT AS "periods since last 0 sales" FROM run""", "nation", RUN_CTE))
def periods_since_last_zero(spark, sf):
    return w.periods_since_last_zero(b.panel(spark, sf, "nation"))


@query("momentum", with_panel("""
SELECT unique_id, ds, y, round(CASE WHEN count(y) OVER p = 7 THEN y - avg(y) OVER p END, 6) AS y_momentum FROM panel
WINDOW p AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)"""))
def momentum(spark, sf):
    return w.momentum(b.panel(spark, sf), 7)


@query("lags", with_panel(f"""
SELECT unique_id, ds, y, lag(y, 1) OVER w AS lag1, lag(y, 7) OVER w AS lag7, lag(y, 14) OVER w AS lag14 FROM panel {WIN}"""))
def lags(spark, sf):
    return w.lags(b.panel(spark, sf))


_ROLL = ", ".join(
    f"round(CASE WHEN count(y) OVER r{n} = {n} THEN {fn}(y) OVER r{n} END, 6) AS rolling_{s}_lag1_window_size{n}"
    for n in (7, 14, 28) for s, fn in (("mean", "avg"), ("std", "stddev_samp")))
_ROLL_WIN = ", ".join(f"r{n} AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"
                      for n in (7, 14, 28))


@query("rolling_stats", with_panel(f"SELECT unique_id, ds, y, {_ROLL} FROM panel WINDOW {_ROLL_WIN}"))
def rolling_stats(spark, sf):
    return w.rolling_stats(b.panel(spark, sf))


_DEPTH = math.ceil(math.log(1e-18) / math.log(1 - 0.3))


@query("exponential_mean", with_panel(f"""
SELECT unique_id, ds, y, round(list_reduce(list(y::DOUBLE) OVER r, lambda a, x: 0.7::DOUBLE * a + 0.3::DOUBLE * x), 6) AS "ewm_lag1_alpha0.3"
FROM panel WINDOW r AS (PARTITION BY unique_id ORDER BY ds ROWS BETWEEN {_DEPTH} PRECEDING AND 1 PRECEDING)"""))
def exponential_mean(spark, sf):
    return w.ewm_mean(b.panel(spark, sf), 0.3)


@query("naive_step_errors", with_panel(f"SELECT unique_id, ds, y, abs(y - lag(y) OVER w) AS naive_error FROM panel {WIN}", "nation"))
def naive_step_errors(spark, sf):
    return w.naive_errors(b.panel(spark, sf, "nation"))


@query("busiest_days_per_series", with_panel("""
SELECT unique_id, ds, y, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY y DESC, ds) AS r FROM panel) WHERE r <= 5"""))
def busiest_days_per_series(spark, sf):
    return w.top_per_group(b.panel(spark, sf), [ID], [F.desc(Y), F.col("ds")], 5)


def _similar_sql(n: int, same: str) -> str:
    return f"""
SELECT unique_id, similar_id, round(similarity, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY similarity DESC, similar_id) AS r FROM (
    SELECT a.unique_id, c.unique_id AS similar_id, sum(a.y * c.y) / (any_value(na.n) * any_value(nc.n)) AS similarity
    FROM panel a JOIN panel c ON a.ds = c.ds AND a.unique_id <> c.unique_id {same}
    JOIN norm na ON na.unique_id = a.unique_id JOIN norm nc ON nc.unique_id = c.unique_id GROUP BY 1, 2)) WHERE r <= {n}"""


NORM_CTE = "\nnorm AS (SELECT unique_id, sqrt(sum(y * y)::DOUBLE) AS n FROM panel GROUP BY 1)"


@query("similar_series", with_panel(_similar_sql(5, ""), "region", NORM_CTE))
def similar_series(spark, sf):
    return similarity.top_similar(b.panel(spark, sf), 5)


@query("similar_series_in_store", with_panel(_similar_sql(
    1, "AND split_part(a.unique_id, '__', 1) = split_part(c.unique_id, '__', 1)"), "nation", NORM_CTE))
def similar_series_in_store(spark, sf):
    return similarity.top_similar(b.panel(spark, sf, "nation"), 1, F.split(ID, "__")[0])
