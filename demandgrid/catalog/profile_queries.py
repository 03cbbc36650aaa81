"""Demand profile queries (filters, classes, aggregates, distributions) and their SQL twins."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import query, with_panel
from demandgrid.catalog.dataset_queries import FEATURES_CTE, features_frame
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import profile as p


@query("mean_band_filter", with_panel("""
SELECT unique_id, ds, y FROM panel WHERE unique_id IN (
  SELECT unique_id FROM panel GROUP BY 1 HAVING avg(y) BETWEEN 0.15 AND 0.5)""", "nation"))
def mean_band_filter(spark, sf):
    return p.filter_mean_band(b.panel(spark, sf, "nation"))


def _once(sql: str) -> str:
    """Work the panel out once where a twin reads it twice."""
    return sql.replace("panel AS (", "panel AS MATERIALIZED (").replace("rng AS (", "rng AS MATERIALIZED (")


@query("quantile_positive_filter", _once(with_panel("""
SELECT unique_id, ds, y FROM panel JOIN (
  SELECT unique_id FROM panel WHERE ds >= (SELECT hi - 183 FROM rng) GROUP BY 1
  HAVING quantile_cont(y, 0.85) > 0) USING (unique_id)""", "nation")))
def quantile_positive_filter(spark, sf):
    _, hi = b.span(spark, sf)
    return p.filter_quantile_positive(b.panel(spark, sf, "nation"), hi - timedelta(183), hi)


@query("demand_statistics", with_panel("""
SELECT unique_id, round(avg(y), 6) AS y_mean, round(stddev_samp(y), 6) AS y_std, min(y) AS y_min,
  max(y) AS y_max, count(y) AS y_count, round(stddev_samp(y) / avg(y), 6) AS cv,
  round(count(*) FILTER (y = 0) * 100.0 / count(y), 6) AS zero_percentage FROM panel GROUP BY 1""", "nation"))
def demand_statistics(spark, sf):
    return p.demand_stats(b.panel(spark, sf, "nation"))


@query("zero_shares", with_panel("""
SELECT unique_id, round(z, 6) AS zero_percentage, z > 50 AS is_intermittent,
  CASE WHEN z > 50 THEN 'Intermittent' ELSE 'Regular' END AS demand_type
FROM (SELECT unique_id, avg(CASE WHEN y = 0 THEN 100.0::DOUBLE ELSE 0 END) AS z FROM panel GROUP BY 1)""", "nation"))
def zero_shares(spark, sf):
    return p.zero_share(b.panel(spark, sf, "nation"))


@query("zero_share_overview", with_panel("""
SELECT count(*) AS n_series, round(avg(z), 6) AS mean_zero, round(min(z), 6) AS min_zero,
  round(max(z), 6) AS max_zero, count(*) FILTER (z > 50) AS n_intermittent
FROM (SELECT unique_id, avg(CASE WHEN y = 0 THEN 100.0::DOUBLE ELSE 0 END) AS z FROM panel GROUP BY 1)""", "nation"))
def zero_share_overview(spark, sf):
    return p.zero_share_summary(b.panel(spark, sf, "nation"))


ADI_CTE = """
pos AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM panel),
st AS (SELECT unique_id, count(*) FILTER (y > 0) AS n, min(rn) FILTER (y > 0) AS f, max(rn) FILTER (y > 0) AS l,
  avg(y) FILTER (y > 0) AS m, stddev_pop(y) FILTER (y > 0) AS s,
  avg(CASE WHEN y = 0 THEN 100.0::DOUBLE ELSE 0 END) AS z FROM pos GROUP BY 1),
sc AS (SELECT unique_id, CASE WHEN n > 1 THEN (l - f)::DOUBLE / (n - 1) ELSE 1.0::DOUBLE END AS adi,
  CASE WHEN n > 1 THEN (s / m) * (s / m) ELSE 0.0::DOUBLE END AS cv2, z, coalesce(m, 0) AS m,
  CASE WHEN n > 1 THEN s ELSE 0.0::DOUBLE END AS s FROM st),
classes AS (SELECT unique_id, round(adi, 6) AS adi, round(cv2, 6) AS cv2, round(z, 6) AS zero_percentage,
  round(m, 6) AS mean_demand, round(s, 6) AS std_demand,
  CASE WHEN adi < 1.32 AND cv2 < 0.49 THEN 'Smooth' WHEN cv2 < 0.49 THEN 'Intermittent'
    WHEN adi < 1.32 THEN 'Erratic' ELSE 'Lumpy' END AS cluster FROM sc)"""


@query("adi_cv2_classes", with_panel("SELECT * FROM classes", "region", ADI_CTE))
def adi_cv2_classes(spark, sf):
    return p.adi_cv2(b.panel(spark, sf))


@query("adi_cv2_class_shares", with_panel("""
SELECT cluster, count(*) AS n_series, round(count(*) * 100.0 / (SELECT count(*) FROM classes), 6) AS share
FROM classes GROUP BY 1""", "nation", ADI_CTE))
def adi_cv2_class_shares(spark, sf):
    return p.class_shares(p.adi_cv2(b.panel(spark, sf, "nation")))


@query("sale_interval_stats", with_panel("""
SELECT unique_id, round(avg(y), 6) AS mean_nonzero_demand, round(quantile_cont(y, 0.5), 6) AS median_nonzero_demand,
  round(power(stddev_samp(y) / avg(y), 2), 6) AS cv_squared, round(avg(g) FILTER (g > 1), 6) AS mean_interval,
  round(quantile_cont(g, 0.5) FILTER (g > 1), 6) AS median_interval,
  round(quantile_cont(g, 0.9) FILTER (g > 1), 6) AS q_90_interval,
  round(quantile_cont(g, 0.95) FILTER (g > 1), 6) AS q_95_interval
FROM (SELECT unique_id, y, rn - lag(rn) OVER (PARTITION BY unique_id ORDER BY rn) AS g FROM pos WHERE y > 0)
GROUP BY 1""", "nation", """
pos AS (SELECT *, row_number() OVER (PARTITION BY unique_id ORDER BY ds) AS rn FROM panel)"""))
def sale_interval_stats(spark, sf):
    return p.interval_stats(b.panel(spark, sf, "nation"))


@query("zero_run_means", with_panel("""
SELECT unique_id, count(*) FILTER (y = 0) AS zeros, count(*) FILTER (y = 0 AND prev > 0) AS zero_runs,
  round(count(*) FILTER (y = 0) / nullif(count(*) FILTER (y = 0 AND prev > 0), 0), 6) AS mean_interval
FROM (SELECT p.*, lag(y) OVER (PARTITION BY p.unique_id ORDER BY ds) AS prev FROM panel p JOIN (
  SELECT unique_id, min(ds) AS f, max(ds) AS l FROM panel WHERE y > 0 GROUP BY 1) s
  ON s.unique_id = p.unique_id AND ds BETWEEN f AND l) GROUP BY 1""", "nation"))
def zero_run_means(spark, sf):
    return p.zero_run_mean(b.panel(spark, sf, "nation"))


@query("mean_demand_quantiles", with_panel("""
SELECT round(quantile_cont(m, 0.05), 6) AS q_05, round(quantile_cont(m, 0.1), 6) AS q_10,
  round(quantile_cont(m, 0.5), 6) AS q_50, round(quantile_cont(m, 0.9), 6) AS q_90,
  round(quantile_cont(m, 0.95), 6) AS q_95, round(min(m), 6) AS min, round(avg(m), 6) AS mean,
  round(max(m), 6) AS max, round(stddev_samp(m), 6) AS sd
FROM (SELECT unique_id, avg(y) AS m FROM panel GROUP BY 1)""", "nation"))
def mean_demand_quantiles(spark, sf):
    return p.mean_demand_distribution(b.panel(spark, sf, "nation"))


TAIL_CTE = """
tail AS (SELECT unique_id, avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS mean_zeros,
  quantile_cont(y, 0.85) AS q85, quantile_cont(y, 0.9) AS q90, quantile_cont(y, 0.95) AS q95
  FROM panel, rng WHERE ds BETWEEN hi - 244 AND hi GROUP BY 1)"""


@query("series_end_stats", with_panel("""
SELECT unique_id, round(mean_zeros, 6) AS mean_zeros, round(q85, 6) AS q85, round(q90, 6) AS q90,
  round(q95, 6) AS q95 FROM tail""", "nation", TAIL_CTE))
def series_end_stats(spark, sf):
    return p.tail_stats(b.panel(spark, sf, "nation"), b.span(spark, sf)[1], 244)


@query("quiet_tail_dropped", _once(with_panel("""
SELECT p.unique_id, p.ds, p.y FROM panel p LEFT JOIN tail t ON t.unique_id = p.unique_id AND q85 = 0 WHERE t.unique_id IS NULL""",
       "nation", TAIL_CTE.replace("FROM panel, rng WHERE ds BETWEEN hi - 244 AND hi", "FROM panel WHERE ds >= (SELECT hi - 244 FROM rng)"))))
def quiet_tail_dropped(spark, sf):
    panel = b.panel(spark, sf, "nation")
    return p.drop_quiet_tail(panel, p.tail_stats(panel, b.span(spark, sf)[1], 244))


@query("daily_totals", with_panel("SELECT ds, sum(y)::BIGINT AS total_y FROM panel GROUP BY 1"))
def daily_totals(spark, sf):
    return p.daily_total(b.panel(spark, sf))


@query("daily_totals_by_state", with_panel("""
SELECT split_part(unique_id, '_', 1) AS state, ds, sum(y)::BIGINT AS total_y FROM panel GROUP BY 1, 2"""))
def daily_totals_by_state(spark, sf):
    return p.daily_total(b.panel(spark, sf), [p.store_parts(F.col(ID))["state"].alias("state")])


@query("month_by_year_totals", with_panel("""
SELECT strftime(ds, '%b') AS month, """ + ", ".join(
    f"round(avg(t) FILTER (year(ds) = {v}), 6) AS y{v}" for v in range(1995, 2002)) + """
FROM (SELECT ds, sum(y) AS t FROM panel GROUP BY 1) GROUP BY 1"""))
def month_by_year_totals(spark, sf):
    lo, hi = b.span(spark, sf)
    return p.month_by_year(p.daily_total(b.panel(spark, sf)), range(lo.year, hi.year + 1))


@query("low_sales_days", with_panel("""
SELECT ds, t::BIGINT AS total_y FROM (SELECT ds, sum(y) AS t FROM panel GROUP BY 1) WHERE t < 20"""))
def low_sales_days(spark, sf):
    return p.low_days(p.daily_total(b.panel(spark, sf)), 20)


@query("low_sales_days_with_events", with_panel("""
SELECT date AS ds, coalesce(event_name_1, 'No Event') AS event_name, t::BIGINT AS total_y
FROM cal JOIN (SELECT ds, sum(y) AS t FROM panel GROUP BY 1) ON ds = date WHERE t < 20""", more=b.CALENDAR_CTE))
def low_sales_days_with_events(spark, sf):
    low = p.low_days(p.daily_total(b.panel(spark, sf)), 20)
    cal = b.calendar(spark, sf).select(
        F.col("date").alias(DS), F.coalesce("event_name_1", F.lit("No Event")).alias("event_name"))
    return cal.join(low, DS)


LEVEL_SQL = {"state": "split_part(unique_id, '_', 1)", "store": "split_part(unique_id, '__', 1)",
             "department": "split_part(unique_id, '__', 2)"}
for _level in LEVEL_SQL:
    @query(f"hierarchy_daily_{_level}", with_panel(f"""
SELECT {LEVEL_SQL[_level]} AS group_key, ds, sum(y)::BIGINT AS total_y FROM panel GROUP BY 1, 2""", "nation"))
    def _daily(spark, sf, level=_level):
        return p.aggregate_hierarchy(b.panel(spark, sf, "nation"), level)

    @query(f"hierarchy_stats_{_level}", with_panel(f"""
SELECT {LEVEL_SQL[_level]} AS group_key, sum(y)::BIGINT AS sum_y, round(avg(y), 6) AS mean_y,
  round(stddev_samp(y), 6) AS std_y, count(y) AS count_y FROM panel GROUP BY 1""", "nation"))
    def _stats(spark, sf, level=_level):
        return p.hierarchy_stats(b.panel(spark, sf, "nation"), level)


@query("hierarchy_grand_totals", with_panel("""
SELECT sum(s)::BIGINT AS total_y, count(*) AS n_groups, round(avg(s), 6) AS avg_per_group
FROM (SELECT split_part(unique_id, '__', 1) AS k, sum(y) AS s FROM panel GROUP BY 1)""", "nation"))
def hierarchy_grand_totals(spark, sf):
    return p.hierarchy_totals(b.panel(spark, sf, "nation"), "store")


@query("hierarchy_rollup", with_panel("""
SELECT state, store, department, sum(y)::BIGINT AS sum_y, count(y) AS count_y,
  grouping(state, store, department) AS level_id
FROM (SELECT split_part(unique_id, '_', 1) AS state, split_part(unique_id, '__', 1) AS store,
  split_part(unique_id, '__', 2) AS department, y FROM panel)
GROUP BY ROLLUP (state, store, department)""", "nation"))
def hierarchy_rollup(spark, sf):
    return p.hierarchy_rollup(b.panel(spark, sf, "nation"))


@query("seasonal_profiles", with_panel("""
SELECT season, bucket, round(avg(y), 6) AS mean_y, count(*) AS n_rows FROM (
  SELECT 'weekday' AS season, dayname(ds) AS bucket, y FROM panel
  UNION ALL SELECT 'month', month(ds)::VARCHAR, y FROM panel
  UNION ALL SELECT 'day_of_year', dayofyear(ds)::VARCHAR, y FROM panel) GROUP BY 1, 2"""))
def seasonal_profiles(spark, sf):
    return p.seasonal_profile(b.panel(spark, sf))


@query("monthly_means", with_panel("""
SELECT unique_id, last_day(ds) AS month_end, round(avg(y), 6) AS mean_y FROM panel GROUP BY 1, 2"""))
def monthly_means(spark, sf):
    return p.monthly_mean(b.panel(spark, sf))


_PARTS = ", ".join(f"count(*) FILTER (d > 0 AND k = {i + 1}) AS pos_changes_{i}, "
                   f"count(*) FILTER (d < 0 AND k = {i + 1}) AS neg_changes_{i}" for i in range(8))


@query("monthly_change_signs", with_panel(f"""
SELECT *, round((greatest(pos_changes_total, neg_changes_total) - least(pos_changes_total, neg_changes_total))
  / nullif(least(pos_changes_total, neg_changes_total), 0), 6) AS sign_pct_change FROM (
SELECT unique_id, count(*) FILTER (d > 0) AS pos_changes_total, count(*) FILTER (d < 0) AS neg_changes_total, {_PARTS}
FROM (SELECT unique_id, m - lag(m) OVER w AS d, ntile(8) OVER w AS k FROM (
  SELECT unique_id, last_day(ds) AS me, avg(y) AS m FROM panel GROUP BY 1, 2)
  WINDOW w AS (PARTITION BY unique_id ORDER BY me)) GROUP BY 1)"""))
def monthly_change_signs(spark, sf):
    return p.monthly_changes(b.panel(spark, sf))


@query("series_overview", with_panel("""
SELECT unique_id, sum(y)::BIGINT AS total, round(avg(y), 6) AS mean, round(stddev_samp(y), 6) AS std,
  round(avg(CASE WHEN y = 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS zero_percentage, count(*) AS n,
  min(ds) AS first_day, max(ds) AS last_day FROM panel GROUP BY 1"""))
def series_overview(spark, sf):
    return p.series_summary(b.panel(spark, sf))


@query("panel_overview", with_panel("""
SELECT count(DISTINCT unique_id) AS n_series, count(*) AS n_rows, sum(y)::BIGINT AS total, round(avg(y), 6) AS mean,
  round(stddev_samp(y), 6) AS std, round(avg(CASE WHEN y = 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS zero_percentage,
  min(ds) AS first_day, max(ds) AS last_day, CAST(date_diff('day', min(ds), max(ds)) AS INTEGER) AS span_days
FROM panel""", "nation"))
def panel_overview(spark, sf):
    return p.panel_summary(b.panel(spark, sf, "nation"))


# ---------------------------------------------------------------- prices

def feat(body: str) -> str:
    return f"WITH {FEATURES_CTE}\n{body}"


@query("price_statistics", feat("""
SELECT count(*) FILTER (sell_price > 0) AS available, count(*) FILTER (sell_price = 0) AS unavailable,
  round(avg(CASE WHEN sell_price > 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS available_pct,
  round(avg(CASE WHEN sell_price = 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS unavailable_pct,
  round(avg(sell_price) FILTER (sell_price > 0), 6) AS mean_price, min(sell_price) FILTER (sell_price > 0) AS min_price,
  max(sell_price) AS max_price, round(quantile_cont(sell_price, 0.5) FILTER (sell_price > 0), 6) AS median_price
FROM feats"""))
def price_statistics(spark, sf):
    return p.price_stats(features_frame(spark, sf))


@query("price_demand_correlation", feat(
    "SELECT 'sell_price' AS price_column, round(corr(sell_price, y), 6) AS correlation FROM feats"))
def price_demand_correlation(spark, sf):
    return p.price_correlation(features_frame(spark, sf))


@query("price_demand_correlation_on_sale", feat("""
SELECT 'sell_price' AS price_column, round(corr(sell_price, y), 6) AS correlation FROM feats WHERE sell_price > 0"""))
def price_demand_correlation_on_sale(spark, sf):
    return p.price_correlation(features_frame(spark, sf), available_only=True)


@query("price_level_demand", feat("""
SELECT price_bin, round(avg(y), 6) AS mean_y, count(*) AS n_rows FROM (
  SELECT y, CASE WHEN sell_price <= e[1] THEN 'Very Low' WHEN sell_price <= e[2] THEN 'Low'
    WHEN sell_price <= e[3] THEN 'Medium' WHEN sell_price <= e[4] THEN 'High' ELSE 'Very High' END AS price_bin
  FROM feats, (SELECT quantile_cont(sell_price, [0.2, 0.4, 0.6, 0.8]) AS e FROM feats WHERE sell_price > 0)
  WHERE sell_price > 0) GROUP BY 1"""))
def price_level_demand(spark, sf):
    return p.price_bins(features_frame(spark, sf))


@query("price_and_sales_by_day", feat("""
SELECT ds, round(avg(sell_price), 6) AS mean_price, sum(y)::BIGINT AS total_y FROM feats WHERE sell_price > 0 GROUP BY 1"""))
def price_and_sales_by_day(spark, sf):
    return p.price_by_day(features_frame(spark, sf))


for _by in ("ds", "unique_id"):
    @query(f"availability_by_{'day' if _by == 'ds' else 'item'}", feat(f"""
SELECT {_by}, round(avg(CASE WHEN sell_price > 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS availability
FROM feats GROUP BY 1"""))
    def _avail(spark, sf, by=_by):
        return p.availability_by(features_frame(spark, sf), by)


@query("availability_overview", feat("""
SELECT round(avg(a), 6) AS avg_availability, round(min(a), 6) AS min_availability, round(max(a), 6) AS max_availability
FROM (SELECT unique_id, avg(CASE WHEN sell_price > 0 THEN 100.0::DOUBLE ELSE 0 END) AS a FROM feats GROUP BY 1)"""))
def availability_overview(spark, sf):
    return p.availability_summary(features_frame(spark, sf))


@query("feature_trend", feat("""
SELECT ds, round(avg(sell_price), 6) AS sell_price, round(avg(is_item_exists), 6) AS is_item_exists
FROM feats GROUP BY 1"""))
def feature_trend(spark, sf):
    return p.daily_mean(features_frame(spark, sf), ["sell_price", "is_item_exists"])


# ---------------------------------------------------------------- distributions and columns

def _hist_sql(source: str, col: str, bins: int) -> str:
    return f"""SELECT least(floor(({col} - lo) / w), {bins - 1})::INTEGER AS bin,
  round(lo + least(floor(({col} - lo) / w), {bins - 1}) * w, 6) AS bin_from,
  round(lo + (least(floor(({col} - lo) / w), {bins - 1}) + 1) * w, 6) AS bin_to, count(*) AS n
FROM {source}, (SELECT min({col})::DOUBLE AS lo, (max({col})::DOUBLE - min({col})::DOUBLE) / {bins} AS w FROM {source})
GROUP BY 1, 2, 3"""


@query("price_histogram", _hist_sql("lineitem", "l_extendedprice", 100))
def price_histogram(spark, sf):
    return p.histogram(b.table(spark, sf, "lineitem"), "l_extendedprice", 100)


@query("total_demand_log_histogram", with_panel("""
SELECT bin, CASE WHEN bin >= 0 THEN round(pow(10, bin * (6.0::DOUBLE / 99)), 6) END AS bin_from,
  CASE WHEN bin < 99 THEN round(pow(10, (bin + 1) * (6.0::DOUBLE / 99)), 6) END AS bin_to, count(*) AS n
FROM (SELECT (CASE WHEN t < 1 THEN -1 WHEN t > 1000000 THEN 99 ELSE least(floor(log10(t) / (6.0::DOUBLE / 99)), 98) END)::INTEGER AS bin
  FROM (SELECT unique_id, sum(y) AS t FROM panel GROUP BY 1)) GROUP BY 1""", "nation"))
def total_demand_log_histogram(spark, sf):
    totals = b.panel(spark, sf, "nation").groupBy(ID).agg(F.sum(Y).alias("t"))
    return p.log_histogram(totals, "t")


@query("column_moments", """
SELECT c AS "column", round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS std, min(v) AS min, max(v) AS max FROM (
SELECT 'l_quantity' AS c, l_quantity AS v FROM lineitem UNION ALL SELECT 'l_extendedprice', l_extendedprice FROM lineitem
UNION ALL SELECT 'l_discount', l_discount FROM lineitem UNION ALL SELECT 'l_tax', l_tax FROM lineitem) GROUP BY 1""")
def column_moments(spark, sf):
    return p.moments(b.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def with_holes(spark, sf):
    """events with a NULL value in every 17th row and no user in every 23rd (FIXTURES 2.7)."""
    return b.table(spark, sf, "events").select(
        "event_id", F.col("ts").cast("date").alias("day"),
        F.when(F.col("event_id") % 23 != 0, F.col("user_id")).alias("user_id"), "event_type",
        F.when(F.col("event_id") % 17 != 0, F.col("value")).alias("value"))


HOLES_CTE = """holes AS (SELECT event_id, CAST(ts AS DATE) AS day,
  CASE WHEN event_id % 23 <> 0 THEN user_id END AS user_id, event_type,
  CASE WHEN event_id % 17 <> 0 THEN value END AS value FROM events)"""


@query("missing_cells", f"""WITH {HOLES_CTE}
SELECT 'user_id' AS "column", count(*) FILTER (user_id IS NULL) AS missing,
  round(count(*) FILTER (user_id IS NULL) * 100.0 / count(*), 6) AS missing_pct FROM holes
UNION ALL SELECT 'value', count(*) FILTER (value IS NULL),
  round(count(*) FILTER (value IS NULL) * 100.0 / count(*), 6) FROM holes""")
def missing_cells(spark, sf):
    return p.missing_values(with_holes(spark, sf))


@query("event_type_shares", """SELECT event_type AS value, count(*) AS n,
  round(count(*)::DOUBLE / (SELECT count(*) FROM events), 6) AS share FROM events GROUP BY 1""")
def event_type_shares(spark, sf):
    return p.value_shares(b.table(spark, sf, "events"), "event_type")


_DESC = " UNION ALL ".join(f"""SELECT '{c}' AS "column", count({c}) AS count, round(avg({c}), 6) AS mean,
  round(stddev_samp({c}), 6) AS std, min({c}) AS min, round(quantile_cont({c}, 0.25), 6) AS q25,
  round(quantile_cont({c}, 0.5), 6) AS q50, round(quantile_cont({c}, 0.75), 6) AS q75, max({c}) AS max FROM lineitem"""
                           for c in ("l_quantity", "l_extendedprice", "l_discount"))


@query("numeric_description", _DESC)
def numeric_description(spark, sf):
    return p.describe(b.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice", "l_discount"])


@query("price_boxes", """
WITH qs AS (SELECT l_returnflag, l_linestatus, quantile_cont(l_extendedprice, [0.25, 0.5, 0.75]) AS e FROM lineitem GROUP BY 1, 2),
f AS (SELECT l.*, e[1] AS q1, e[2] AS median, e[3] AS q3, l_extendedprice BETWEEN e[1] - 1.5 * (e[3] - e[1])
  AND e[3] + 1.5 * (e[3] - e[1]) AS ok FROM lineitem l JOIN qs USING (l_returnflag, l_linestatus))
SELECT l_returnflag, l_linestatus, round(q1, 6) AS q1, round(median, 6) AS median, round(q3, 6) AS q3,
  min(l_extendedprice) FILTER (ok) AS whisker_low, max(l_extendedprice) FILTER (ok) AS whisker_high,
  count(*) FILTER (NOT ok) AS outliers FROM f GROUP BY 1, 2, 3, 4, 5""")
def price_boxes(spark, sf):
    return p.box_stats(b.table(spark, sf, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"])


_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_CORR = " UNION ALL ".join(
    f"SELECT '{x}' AS a, '{y}' AS b, round(corr({x}, {y}), 6) AS r FROM lineitem"
    for i, x in enumerate(_COLS) for y in _COLS[i + 1:])


@query("correlations", _CORR)
def correlations(spark, sf):
    return p.correlation_matrix(b.table(spark, sf, "lineitem"), _COLS)


@query("strong_correlations", f"SELECT * FROM ({_CORR}) WHERE abs(r) > 0.001")
def strong_correlations(spark, sf):
    return p.strong_pairs(p.correlation_matrix(b.table(spark, sf, "lineitem"), _COLS), 0.001)


@query("series_correlations", with_panel("""
SELECT a AS unique_id, b AS other_id, r, CAST(rank AS INTEGER) AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY a ORDER BY r DESC, b) AS rank FROM (
    SELECT x.unique_id AS a, z.unique_id AS b, round(corr(x.y, z.y), 6) AS r FROM panel x JOIN panel z
      ON x.ds = z.ds AND x.unique_id <> z.unique_id GROUP BY 1, 2)) WHERE rank <= 3"""))
def series_correlations(spark, sf):
    """The three most correlated other series of each region-by-type series."""
    return p.correlated_series(b.panel(spark, sf), 3)


@query("most_variable_columns", "SELECT * FROM (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", round(var_samp({c}), 6) AS variance FROM lineitem""" for c in _COLS)
       + ") ORDER BY variance DESC LIMIT 2")
def most_variable_columns(spark, sf):
    return p.most_variable(b.table(spark, sf, "lineitem"), 2, _COLS)


@query("feature_columns_report", f"""WITH {HOLES_CTE}
SELECT 'event_id' AS "column", 'numeric' AS kind, count(*) FILTER (event_id IS NULL) AS missing, round(var_samp(event_id), 6) AS variance FROM holes
UNION ALL SELECT 'day', 'other', count(*) FILTER (day IS NULL), NULL FROM holes
UNION ALL SELECT 'user_id', 'numeric', count(*) FILTER (user_id IS NULL), round(var_samp(user_id), 6) FROM holes
UNION ALL SELECT 'event_type', 'categorical', count(*) FILTER (event_type IS NULL), NULL FROM holes
UNION ALL SELECT 'value', 'numeric', count(*) FILTER (value IS NULL), round(var_samp(value), 6) FROM holes""")
def feature_columns_report(spark, sf):
    return p.feature_report(with_holes(spark, sf))
