"""Feature transformers and event effects with their SQL twins."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import CALENDAR_CTE, query, with_panel
from demandgrid.catalog.dataset_queries import CAL, EVENTS, FEATURES, features_frame
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import calendars, event_effects, intervals, ranking
from demandgrid.operators import features as f

PI2 = repr(2 * math.pi)
FLAGS = [f"snap_R{r}" for r in range(5)] + [e for e in EVENTS if e != "No Event"]


def dated(spark, sf):
    return calendars.date_parts(b.panel(spark, sf))


_PARTS = "dayofyear(ds)::INTEGER AS day_of_year, weekofyear(ds)::INTEGER AS week_of_year"


def _terms(col: str, period: float, orders, sin_name, cos_name) -> str:
    return ", ".join(f"round(sin({2 * math.pi * i / period!r} * {col}), 6) AS {sin_name(i)}, "
                     f"round(cos({2 * math.pi * i / period!r} * {col}), 6) AS {cos_name(i)}" for i in orders)


@query("fourier_terms", with_panel(f"""SELECT unique_id, ds, y, {_terms('dayofyear(ds)', 365.25, (1, 2, 3),
       lambda i: f'fourier_sin_{i}', lambda i: f'fourier_cos_{i}')} FROM panel"""))
def fourier_terms(spark, sf):
    return f.fourier(dated(spark, sf).select(ID, DS, Y, "day_of_year"), k=3, drop_time_col=True)


@query("year_fourier_terms", with_panel(f"""SELECT unique_id, ds, y, dayofyear(ds)::INTEGER AS day_of_year, {_terms(
    'dayofyear(ds)', 365.25, (1, 2), lambda i: f'year_fourier_sin_{i}', lambda i: f'year_fourier_cos_{i}')} FROM panel"""))
def year_fourier_terms(spark, sf):
    return f.fourier(dated(spark, sf).select(ID, DS, Y, "day_of_year"), k=2, prefix="year_")


def _multi(col: str, pre: str) -> str:
    return ", ".join(_terms(col, p, range(1, o + 1), lambda h, i=i: f"{pre}fourier_sin_p{i}_h{h}",
                            lambda h, i=i: f"{pre}fourier_cos_p{i}_h{h}") for i, (p, o) in enumerate(((365.25, 2), (30.5, 1)), 1))


@query("multi_season_fourier", with_panel(f"""SELECT unique_id, ds, y, {_PARTS}, {_multi('dayofyear(ds)', 'day_of_year_')},
  {_multi('weekofyear(ds)', 'week_of_year_')} FROM panel"""))
def multi_season_fourier(spark, sf):
    df = dated(spark, sf).select(ID, DS, Y, "day_of_year", "week_of_year")
    return f.multi_fourier(df, ["day_of_year", "week_of_year"], [365.25, 30.5], [2, 1])


DAYS = ["Friday", "Saturday", "Sunday", "Thursday", "Tuesday", "Wednesday"]
_OHE = ", ".join(f"CASE WHEN dayname(ds) = '{d}' THEN 1.0::DOUBLE ELSE 0 END AS \"weekday_{d}\"" for d in DAYS)
_OHM = ", ".join(f"CASE WHEN month(ds) = {m} THEN 1.0::DOUBLE ELSE 0 END AS month_{m}" for m in range(2, 13))


@query("one_hot_weekday", with_panel(f"SELECT unique_id, ds, y, {_OHE} FROM panel"))
def one_hot_weekday(spark, sf):
    return f.OneHotBaseline("weekday", "Monday").fit_transform(dated(spark, sf).select(ID, DS, Y, "weekday"))


@query("one_hot_inverse", with_panel("SELECT unique_id, ds, y, dayname(ds) AS weekday FROM panel"))
def one_hot_inverse(spark, sf):
    enc = f.OneHotBaseline("weekday", "Monday")
    return enc.inverse_transform(enc.fit_transform(dated(spark, sf).select(ID, DS, Y, "weekday")))


@query("one_hot_weekday_and_month", with_panel(f"SELECT unique_id, ds, y, {_OHE}, {_OHM} FROM panel"))
def one_hot_weekday_and_month(spark, sf):
    enc = f.BaselineEncoder({"weekday": "Monday", "month": 1})
    return enc.fit_transform(dated(spark, sf).select(ID, DS, Y, "weekday", "month"))


# frames that a twin reads more than once are worked out once
ONCE = FEATURES.replace("feats AS (", "feats AS MATERIALIZED (").replace("panel AS (", "panel AS MATERIALIZED (")


@query("price_scaled_above_zero", ONCE.rstrip() + """,
st AS MATERIALIZED (SELECT avg(sell_price) AS m, stddev_pop(sell_price) AS s FROM feats WHERE sell_price > 0)
SELECT unique_id, ds, round(CASE WHEN sell_price > 0 THEN (sell_price - (SELECT m FROM st)) / (SELECT s FROM st) ELSE sell_price END, 6)
  AS sell_price FROM feats""")
def price_scaled_above_zero(spark, sf):
    return f.ThresholdScaler(["sell_price"]).fit_transform(features_frame(spark, sf).select(ID, DS, "sell_price"))


_Q = {"standard": ("avg({c})", "stddev_pop({c})"), "minmax": ("min({c})", "max({c}) - min({c})"),
      "robust": ("quantile_cont({c}, 0.5)", "quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25)")}
for _m, (_a, _s) in _Q.items():
    _cols = ("l_quantity", "l_extendedprice", "l_discount")

    @query(f"scaled_{_m}", "SELECT l_orderkey, " + ", ".join(
        f"round(({c} - (SELECT {_a.format(c=c)} FROM lineitem)) / (SELECT {_s.format(c=c)} FROM lineitem), 6) AS {c}"
        for c in _cols) + " FROM lineitem")
    def _scaled(spark, sf, method=_m, cols=_cols):
        return f.Scaler(cols, method).fit_transform(b.table(spark, sf, "lineitem").select("l_orderkey", *cols))


@query("high_variance_columns", "SELECT l_orderkey, l_extendedprice, l_quantity FROM lineitem")
def high_variance_columns(spark, sf):
    df = b.table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return f.variance_filter(df, 0.5, keep=["l_orderkey"])


@query("event_flags", CAL + """
SELECT date, coalesce(event_name_1, 'No Event') AS event, CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END AS is_event,
""" + ", ".join(f"CASE WHEN event_name_1 = '{e}' THEN 1 ELSE 0 END AS event_{e.lower()}"
                for e in ("Christmas", "IndependenceDay", "NewYear", "ValentinesDay")) + " FROM cal")
def event_flags(spark, sf):
    df = b.calendar(spark, sf).select("date", F.coalesce("event_name_1", F.lit("No Event")).alias("event"))
    return f.EventFlags().fit_transform(df)


@query("benefit_day_flags", CAL + """
SELECT date, day(date)::INTEGER AS day, snap_R1 AS snap, snap_R1 AS is_snap, """ + ", ".join(
    f"CASE WHEN day(date) = {k} AND snap_R1 = 1 THEN 1 ELSE 0 END AS snap_day_{k}" for k in (1, 2, 3)) + " FROM cal")
def benefit_day_flags(spark, sf):
    df = b.calendar(spark, sf).select("date", F.dayofmonth("date").alias("day"), F.col("snap_R1").alias("snap"))
    return f.benefit_flags(df)


@query("feature_chain", with_panel(f"""
SELECT ds, dayofyear(ds)::INTEGER AS day_of_year, event_name_1 IS NOT NULL AS ev, is_event, snap_R1 AS snap, snap_R1 AS is_snap,
  round((y - (SELECT avg(y) FROM panel)) / (SELECT stddev_pop(y) FROM panel), 6) AS y, unique_id, {_OHE},
  {_terms('dayofyear(ds)', 365.25, (1,), lambda i: f'fourier_sin_{i}', lambda i: f'fourier_cos_{i}')}
FROM (SELECT *, CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END AS is_event FROM panel JOIN cal ON date = ds)""",
                                   more=CALENDAR_CTE))
def feature_chain(spark, sf):
    """Fourier, event and benefit flags, encoding and scaling as one plan."""
    cal = b.calendar(spark, sf).select(
        F.col("date").alias(DS), "weekday", F.coalesce("event_name_1", F.lit("No Event")).alias("event"),
        F.col("snap_R1").alias("snap"), F.dayofyear("date").alias("day_of_year"))
    df = b.panel(spark, sf).join(cal, DS)
    plan = f.FeaturePlan(lambda d: f.fourier(d, k=1), calendar=True, encoding={"weekday": "Monday"},
                         scaling=f.Scaler([Y]))
    out = plan.fit_transform(df)
    names = [c for c in out.columns if not c.startswith("event")]
    return out.select(*names, (F.col("event") != "No Event").alias("ev"))


INTERVAL_CTE = """, run AS (SELECT *, sum((y > 0)::INTEGER) OVER s AS g, sum((y = 0)::INTEGER) OVER s AS z
  FROM feats WINDOW s AS (PARTITION BY unique_id ORDER BY ds)),
mf AS (SELECT *, CASE WHEN y = 0 THEN sum((y = 0)::INTEGER) OVER (PARTITION BY unique_id, g ORDER BY ds) ELSE 0 END AS a,
  CASE WHEN y > 0 THEN sum((y > 0)::INTEGER) OVER (PARTITION BY unique_id, z ORDER BY ds) ELSE 0 END AS b FROM run)"""
_KEEP = "unique_id, ds, y, is_item_exists"


def _model_frame(spark, sf):
    df = features_frame(spark, sf).select(ID, DS, Y, "is_item_exists", "weekday", "month", "sell_price")
    return intervals.periods_since_last_zero(intervals.periods_since_last_sale(df))


@query("model_columns_linear", ONCE + INTERVAL_CTE.replace("mf AS (", "mf AS MATERIALIZED (") + f""",
st AS MATERIALIZED (SELECT avg(sell_price) FILTER (sell_price > 0) AS pm,
  stddev_pop(sell_price) FILTER (sell_price > 0) AS ps, avg(a) AS am, stddev_pop(a) AS sa, avg(b) AS bm, stddev_pop(b) AS sb FROM mf)
SELECT {_KEEP}, round(CASE WHEN sell_price > 0 THEN (sell_price - (SELECT pm FROM st)) / (SELECT ps FROM st) ELSE sell_price END, 6)
  AS sell_price, round((a - (SELECT am FROM st)) / (SELECT sa FROM st), 6) AS "periods since last sales",
  round((b - (SELECT bm FROM st)) / (SELECT sb FROM st), 6) AS "periods since last 0 sales", {_OHE}, {_OHM} FROM mf""")
def model_columns_linear(spark, sf):
    return f.ModelColumns().fit_transform(_model_frame(spark, sf))


@query("model_columns_trees", FEATURES + INTERVAL_CTE + f"""
SELECT {_KEEP}, sell_price, a::BIGINT AS "periods since last sales", b::BIGINT AS "periods since last 0 sales", {_OHE}, {_OHM} FROM mf""")
def model_columns_trees(spark, sf):
    return f.ModelColumns(scale=False).fit_transform(_model_frame(spark, sf))


@query("small_predictions_zeroed", """
SELECT event_id, round(CASE WHEN v <= 0.1 THEN 0 ELSE v END, 6) AS strict,
  round(CASE WHEN w < 0 OR abs(w) <= 1e-8 THEN 0 ELSE w END, 6) AS close FROM (
SELECT event_id, value / 10 - 1 AS v, value / 10 - 1 AS w FROM events)""")
def small_predictions_zeroed(spark, sf):
    df = b.table(spark, sf, "events").select("event_id", (F.col("value") / 10 - 1).alias("strict"),
                                             (F.col("value") / 10 - 1).alias("close"))
    return f.zero_small(f.zero_small(df, ["strict"]), ["close"], close=True)


# ---------------------------------------------------------------- event effects

def _impact_sql() -> str:
    return " UNION ALL ".join(f"""
SELECT '{e}' AS event, '{"SNAP" if e.startswith("snap") else "Other"}' AS family, round(avg(y) FILTER ("{e}" = 1), 6) AS event_sales,
  round(avg(y) FILTER ("{e}" = 0), 6) AS non_event_sales,
  round(CASE WHEN avg(y) FILTER ("{e}" = 0) > 0 THEN (avg(y) FILTER ("{e}" = 1) - avg(y) FILTER ("{e}" = 0)) * 100
    / avg(y) FILTER ("{e}" = 0) ELSE 0 END, 6) AS impact_pct,
  round(count(*) FILTER ("{e}" = 1) * 100.0 / count(*), 6) AS event_frequency_pct, count(*) FILTER ("{e}" = 1) AS event_count
FROM feats""" for e in FLAGS)


@query("event_impact", FEATURES + _impact_sql())
def event_impact(spark, sf):
    return event_effects.event_impact(features_frame(spark, sf), FLAGS)


@query("strongest_events", FEATURES + f""", imp AS ({_impact_sql()})
SELECT * FROM (SELECT 'positive' AS side, event, impact_pct FROM imp WHERE impact_pct > 0 ORDER BY impact_pct DESC, event LIMIT 5)
UNION ALL SELECT * FROM (SELECT 'negative', event, impact_pct FROM imp WHERE impact_pct < 0 ORDER BY impact_pct, event LIMIT 5)""")
def strongest_events(spark, sf):
    return ranking.strongest_events(event_effects.event_impact(features_frame(spark, sf), FLAGS))


_T = " UNION ALL ".join(f"""
SELECT '{e}' AS event, count(y) FILTER ("{e}" = 1) AS n1, count(y) FILTER ("{e}" = 0) AS n0, avg(y) FILTER ("{e}" = 1) AS m1,
  avg(y) FILTER ("{e}" = 0) AS m0, var_samp(y) FILTER ("{e}" = 1) AS v1, var_samp(y) FILTER ("{e}" = 0) AS v0 FROM feats"""
                        for e in FLAGS)


@query("event_significance", FEATURES + f""", st AS ({_T}),
pl AS (SELECT *, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS s FROM st)
SELECT event, n1 + n0 - 2 AS dof, round((m1 - m0) / (s * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)), 6) AS t_stat,
  round((m1 - m0) / s, 6) AS cohens_d,
  CASE WHEN abs((m1 - m0) / s) < 0.2 THEN 'Small' WHEN abs((m1 - m0) / s) < 0.5 THEN 'Medium' ELSE 'Large' END AS effect_size
FROM pl""")
def event_significance(spark, sf):
    return event_effects.event_tests(features_frame(spark, sf), FLAGS)


# for whole degrees of freedom the t distribution is a finite sum over powers of the cosine of atan(t / sqrt(dof))
@query("event_p_values", ONCE.rstrip() + f""", st AS ({_T}),
pl AS (SELECT *, n1 + n0 - 2 AS dof, sqrt(((n1 - 1) * v1 + (n0 - 1) * v0) / (n1 + n0 - 2)) AS s FROM st),
tt AS MATERIALIZED (SELECT event, dof, (m1 - m0) / (s * sqrt(1.0::DOUBLE / n1 + 1.0::DOUBLE / n0)) AS t, (m1 - m0) / s AS d FROM pl),
an AS (SELECT *, atan(abs(t) / sqrt(dof)) AS angle, dof % 2 AS odd FROM tt),
terms AS (SELECT event, angle, odd, unnest(range(0, (dof - odd) // 2)) AS k FROM an),
steps AS (SELECT event, angle, odd, k, CASE WHEN k = 0 THEN 0.0 ELSE ln((2.0 * k - 1 + odd) / (2.0 * k + odd)) + 2 * ln(cos(angle)) END AS step FROM terms),
powers AS (SELECT event, angle, odd, k, exp(sum(step) OVER (PARTITION BY event ORDER BY k)) AS term FROM steps),
sums AS (SELECT event, sum(term) AS total FROM powers GROUP BY event),
pv AS (SELECT an.*, 1 - CASE WHEN odd = 1 THEN 2 / pi() * (angle + sin(angle) * cos(angle) * coalesce(total, 0))
  ELSE sin(angle) * coalesce(total, 0) END AS p FROM an LEFT JOIN sums USING (event))
SELECT event, dof, round(t, 6) AS t_stat, round(d, 6) AS cohens_d,
  CASE WHEN abs(d) < 0.2 THEN 'Small' WHEN abs(d) < 0.5 THEN 'Medium' ELSE 'Large' END AS effect_size, round(abs(p), 6) AS p_value,
  CASE WHEN p < 0.05 THEN 'Significant' ELSE 'Not Significant' END AS significance FROM pv""")
def event_p_values(spark, sf):
    return event_effects.with_significance(event_effects.event_tests(features_frame(spark, sf), FLAGS))


@query("event_timeline", FEATURES + """SELECT ds, sum(y)::BIGINT AS total_y, max("Christmas") AS is_event FROM feats GROUP BY 1""")
def event_timeline(spark, sf):
    return event_effects.event_timeline(features_frame(spark, sf), "Christmas")


@query("event_correlations", FEATURES + " UNION ALL ".join(
    f"""SELECT '{x}' AS a, '{y}' AS b, round(corr("{x}", "{y}"), 6) AS r FROM feats"""
    for i, x in enumerate(FLAGS) for y in FLAGS[i + 1:]))
def event_correlations(spark, sf):
    from demandgrid.operators.profile import correlation_matrix
    return correlation_matrix(features_frame(spark, sf).select(*FLAGS), FLAGS)
