"""Source, reshape and join queries and their SQL twins."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import CALENDAR_CTE, panel_cte, prices_cte, query, with_panel
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import calendars as c
from demandgrid.operators import intervals, joins, profile, quality, ranking, reshape
from demandgrid.plans import dataset
from demandgrid.session import ensure_checkpoint_dir
from demandgrid.sources import checks, files

# Event names of the fixture calendar, sorted.
EVENTS = ["Christmas", "IndependenceDay", "NewYear", "No Event", "QuarterEnd", "Religious", "ValentinesDay"]
EVENT_COLS = ["event_name_1", "event_name_2"]
CAL = f"WITH {panel_cte()},{CALENDAR_CTE}\n"
STORE = "split_part(unique_id, '__', 1)"
ITEM = "split_part(unique_id, '__', 2)"


def keyed_panel(spark, sf, level="nation"):
    return reshape.split_id(b.panel(spark, sf, level), {"store_id": 0, "item_id": 1})


def scratch(spark) -> str:
    """A new folder inside the shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}"


def features_frame(spark, sf):
    """Panel B with calendar and price columns and y: the input of the price and event analyses."""
    lo, hi = b.span(spark, sf)
    series = reshape.make_id(keyed_panel(spark, sf), ["store_id", "item_id"])
    cal = c.event_indicators(b.calendar_between(spark, lo, hi), EVENT_COLS, EVENTS, drop_baseline=True)
    cal = cal.withColumnRenamed("date", DS).drop("d")
    rows = joins.with_calendar(series, cal, DS)
    return joins.with_prices(rows, b.prices(spark, sf), ["store_id", "item_id", "wm_yr_wk"])


def _hits(name):
    own = f"(coalesce((event_name_1 = '{name}')::INTEGER, 0) + coalesce((event_name_2 = '{name}')::INTEGER, 0))"
    return f"(event_name_1 IS NULL AND event_name_2 IS NULL)::INTEGER" if name == "No Event" else own


INDICATORS = ", ".join(f'{_hits(e)} AS "{e}"' for e in EVENTS if e != "No Event")
FEATURES_CTE = f"""{panel_cte("nation")},{CALENDAR_CTE},{prices_cte()},
feats AS (SELECT unique_id, store_id, item_id, ds, y, wm_yr_wk, weekday, wday, month, year, event_name_1,
  event_type_1, event_name_2, event_type_2, snap_R0, snap_R1, snap_R2, snap_R3, snap_R4, {INDICATORS},
  coalesce(sell_price, 0) AS sell_price, CASE WHEN sell_price > 0 THEN 1 ELSE 0 END AS is_item_exists
  FROM (SELECT *, {STORE} AS store_id, {ITEM} AS item_id FROM panel) JOIN cal ON date = ds
  LEFT JOIN prices USING (store_id, item_id, wm_yr_wk))"""
FEATURES = f"WITH {FEATURES_CTE}\n"


# ---------------------------------------------------------------- sources, sinks, checks

@query("panel_csv_round_trip", with_panel("SELECT unique_id, ds, y FROM panel"))
def panel_csv_round_trip(spark, sf):
    path = files.write_panel(b.panel(spark, sf), scratch(spark), "target_features", *b.span(spark, sf), fmt="csv")
    return files.read_panel(spark, path, "unique_id string, ds date, y bigint")


@query("panel_parquet_round_trip", with_panel("SELECT unique_id, ds, y FROM panel", "nation"))
def panel_parquet_round_trip(spark, sf):
    path = files.write_panel(b.panel(spark, sf, "nation"), scratch(spark), "targets", *b.span(spark, sf))
    return files.read_panel(spark, path)


@query("processed_files_found", with_panel("SELECT unique_id, ds, y FROM panel"))
def processed_files_found(spark, sf):
    """Falls back to any CSV file because the folder holds no match for the first pattern."""
    folder = scratch(spark)
    files.write_panel(b.panel(spark, sf), folder, "features", *b.span(spark, sf), fmt="csv")
    return files.read_matching(spark, folder, "target_*.csv", "unique_id string, ds date, y bigint")


@query("calendar_file", CAL + "SELECT * FROM cal")
def calendar_file(spark, sf):
    path = files.write_panel(b.calendar(spark, sf), scratch(spark), "calendar", *b.span(spark, sf), fmt="csv")
    return files.read_calendar(spark, path)


@query("prices_file", f"WITH {prices_cte()} SELECT * FROM prices")
def prices_file(spark, sf):
    path = files.write_panel(b.prices(spark, sf), scratch(spark), "prices", *b.span(spark, sf), fmt="csv")
    return files.read_prices(spark, path)


_WIDE: dict[tuple[str, str], str] = {}


def wide_sales(spark, sf):
    """Panel B as a file with one column per day, all days of the range; written once per session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _WIDE:
        _WIDE[key] = files.write_panel(_wide_rows(spark, sf), scratch(spark), "sales", *b.span(spark, sf))
    return files.read_sales_wide(spark, _WIDE[key])


def _wide_rows(spark, sf):
    lo, hi = b.span(spark, sf)
    days = F.transform(F.sort_array(F.collect_list(F.struct(DS, Y))), lambda s: s[Y])
    rows = keyed_panel(spark, sf).groupBy("store_id", "item_id").agg(days.alias("days"))
    return rows.selectExpr("store_id", "item_id", "item_id AS dept_id", "split(store_id, '_')[0] AS state_id",
                           *[f"days[{i}] AS d_{i + 1}" for i in range((hi - lo).days + 1)])


WIDE_LONG = f"""SELECT {STORE} AS store_id, {ITEM} AS item_id, 'd_'||(date_diff('day', lo, ds) + 1) AS d, y
FROM panel, rng"""


@query("wide_to_long", with_panel(WIDE_LONG, "nation"))
def wide_to_long(spark, sf):
    return reshape.wide_to_long(wide_sales(spark, sf), ["store_id", "item_id"])


@query("wide_sales_file", with_panel(f"""
SELECT {STORE} AS store_id, {ITEM} AS item_id, sum(y)::BIGINT AS total_y, count(*) AS n_days FROM panel GROUP BY 1, 2""",
                                     "nation"))
def wide_sales_file(spark, sf):
    folder = scratch(spark)
    path = files.write_panel(_wide_rows(spark, sf), folder, "sales", *b.span(spark, sf), fmt="csv")
    long = reshape.wide_to_long(files.read_sales_wide(spark, path), ["store_id", "item_id"])
    return long.groupBy("store_id", "item_id").agg(F.sum(Y).alias("total_y"), F.count(F.lit(1)).alias("n_days"))


@query("source_checks", CAL + """
SELECT 'calendar not empty' AS "check", count(*) > 0 AS ok, count(*)::VARCHAR AS detail FROM cal
UNION ALL SELECT 'calendar covers range', min(date) <= min(lo) AND max(date) >= max(hi), min(date)||'..'||max(date) FROM cal, rng
UNION ALL SELECT 'sales not empty', count(*) > 0, count(*)::VARCHAR FROM panel
UNION ALL SELECT 'store present', bool_or(unique_id LIKE 'R1\\_1\\_\\_%' ESCAPE '\\'), 'R1_1' FROM panel
UNION ALL SELECT 'department present', bool_or(unique_id LIKE '%NO SUCH%'), 'NO SUCH' FROM panel
UNION ALL SELECT 'prices not empty', count(*) > 0, count(*)::VARCHAR FROM (
  SELECT DISTINCT n_regionkey, p_type, floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) FROM lineitem
  JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)""")
def source_checks(spark, sf):
    sales = keyed_panel(spark, sf, "region").withColumn("dept_id", F.col("item_id"))
    return checks.check_sources(b.calendar(spark, sf), sales, b.prices(spark, sf, "region"),
                                *b.span(spark, sf), store="R1_1", dept="NO SUCH")


@query("panel_checks", FEATURES + """
SELECT 'features columns' AS "check", true AS ok, '' AS detail
UNION ALL SELECT 'features ds is a date', true, 'date' UNION ALL SELECT 'targets columns', true, ''
UNION ALL SELECT 'targets ds is a date', true, 'date'
UNION ALL SELECT 'features without NULL', count(*) = 0, count(*)::VARCHAR FROM feats WHERE event_name_1 IS NULL
UNION ALL SELECT 'targets without NULL', true, '0' UNION ALL SELECT 'same series on both sides', true, '0'""")
def panel_checks(spark, sf):
    return checks.check_panel(features_frame(spark, sf).select(ID, DS, "event_name_1", "sell_price"),
                              b.panel(spark, sf, "nation"))


@query("panel_information", with_panel("""
SELECT 'targets' AS name, count(*) AS n_rows, 3 AS n_columns, count(DISTINCT unique_id) AS n_series,
  min(ds) AS first_day, max(ds) AS last_day FROM panel""", "nation"))
def panel_information(spark, sf):
    return checks.panel_info(b.panel(spark, sf, "nation"), "targets")


@query("metrics_json_round_trip", with_panel("""
SELECT unique_id, avg(CASE WHEN y = 0 THEN 1 ELSE 0 END) > 0.5 AS is_intermittent FROM panel GROUP BY 1""", "nation"))
def metrics_json_round_trip(spark, sf):
    path = scratch(spark)
    files.write_json(profile.zero_share(b.panel(spark, sf, "nation")).select(ID, "is_intermittent"), path)
    return spark.read.schema("unique_id string, is_intermittent boolean").json(path)


@query("experiment_log", with_panel("""
SELECT unique_id AS name, 'mean '||CAST(floor(avg(y) * 100) AS BIGINT) AS description, 'completed' AS status
FROM panel GROUP BY 1"""))
def experiment_log(spark, sf):
    """One experiment per series appended to the log table, read back."""
    path = scratch(spark)
    runs = b.panel(spark, sf).groupBy(ID).agg(F.avg(Y).alias("m"))
    entries = runs.select(F.col(ID).alias("name"),
                          F.concat(F.lit("mean "), F.floor(F.col("m") * 100).cast("string")).alias("description"))
    files.log_experiments(entries, path)
    return files.read_experiments(spark, path).drop("logged_at")


@query("repeated_runs", with_panel("""
SELECT year::VARCHAR AS run, unique_id, y::BIGINT AS total_y FROM (SELECT year(ds) AS year, unique_id, sum(y) AS y FROM panel GROUP BY 1, 2)
WHERE year BETWEEN 1996 AND 1999"""))
def repeated_runs(spark, sf):
    """Yearly totals appended as runs, two of them twice and one never finished; each is read once."""
    path = scratch(spark)
    totals = b.panel(spark, sf).groupBy(F.year(DS).alias("year"), ID).agg(F.sum(Y).alias("total_y"))
    for year in (1996, 1997, 1996, 1998, 1999, 1999):
        files.append_run(totals.where(F.col("year") == year).drop("year"), path, str(year))
    totals.where("year = 2000").select(ID, "total_y", F.lit("2000").alias("run")).write.mode("append").partitionBy("run").parquet(f"{path}/rows")
    return files.read_runs(spark, path, "unique_id string, total_y bigint")


# ---------------------------------------------------------------- projection, filter, reshape

@query("filter_store_department", with_panel(f"""
SELECT {STORE} AS store_id, {ITEM} AS item_id, ds, y FROM panel WHERE {STORE} = 'R1_1' AND {ITEM} = 'PROMO_1'""", "nation"))
def filter_store_department(spark, sf):
    return reshape.where_equal(keyed_panel(spark, sf), store_id="R1_1", item_id="PROMO_1")


@query("filter_dates", with_panel("SELECT * FROM panel WHERE ds BETWEEN DATE '1997-01-01' AND DATE '1998-12-31'"))
def filter_dates(spark, sf):
    return c.between_dates(b.panel(spark, sf), "1997-01-01", "1998-12-31")


@query("filter_dates_open_end", with_panel("SELECT * FROM panel WHERE ds >= DATE '2000-01-01'"))
def filter_dates_open_end(spark, sf):
    return c.between_dates(b.panel(spark, sf), start="2000-01-01")


@query("lag_padded_range", with_panel("""
SELECT * FROM panel WHERE ds BETWEEN DATE '1997-01-01' - 30 AND DATE '1998-12-31'"""))
def lag_padded_range(spark, sf):
    return b.panel(spark, sf).where(
        F.col(DS).between(c.lag_padded_start("1997-01-01", 30), F.lit("1998-12-31").cast("date")))


@query("calendar_cleaned", CAL + "SELECT * EXCLUDE (wday, year, snap_R0, snap_R2, snap_R3, snap_R4) FROM cal WHERE date >= DATE '1996-01-01'")
def calendar_cleaned(spark, sf):
    """Columns dropped (one of them absent), dates cut, one state's benefit flag kept."""
    cal = c.clean_calendar(b.calendar(spark, sf), start="1996-01-01", drop=["wday", "year", "no_such_column"])
    return c.keep_state_flag(cal, c.state_of("R1_7"))


@query("benefit_flags_long", CAL + " UNION ALL ".join(
    f"SELECT date, 'R{r}' AS state_id, snap_R{r} AS snap FROM cal" for r in range(5)))
def benefit_flags_long(spark, sf):
    return c.benefit_flags_long(b.calendar(spark, sf))


@query("event_indicators", CAL + "SELECT date, event_name_1, event_name_2, " + ", ".join(
    f'{_hits(e)} AS "{e}"' for e in EVENTS) + " FROM cal")
def event_indicators(spark, sf):
    return c.event_indicators(b.calendar(spark, sf).select("date", *EVENT_COLS), EVENT_COLS)


@query("event_indicators_inverse", CAL + """
SELECT date, coalesce(least(event_name_1, event_name_2), event_name_1, event_name_2, 'No Event') AS event_name_1,
  CASE WHEN event_name_1 IS NOT NULL AND event_name_2 IS NOT NULL THEN greatest(event_name_1, event_name_2) ELSE 'No Event' END AS event_name_2
FROM cal""")
def event_indicators_inverse(spark, sf):
    """Indicators and back: each day's events in name order, padded with the baseline."""
    wide = c.event_indicators(b.calendar(spark, sf).select("date", *EVENT_COLS), EVENT_COLS, EVENTS,
                              drop_baseline=True, drop_event_cols=True)
    return c.event_indicators_inverse(wide, [e for e in EVENTS if e != c.NO_EVENT], EVENT_COLS)


@query("series_key", with_panel("SELECT unique_id, ds, y FROM panel", "nation"))
def series_key(spark, sf):
    return reshape.make_id(keyed_panel(spark, sf), ["store_id", "item_id"], drop=True)


@query("series_key_parts", with_panel(f"SELECT {STORE} AS store_id, {ITEM} AS item_id, ds, y FROM panel", "nation"))
def series_key_parts(spark, sf):
    return keyed_panel(spark, sf)


@query("hierarchy_keys", with_panel(f"""
SELECT DISTINCT unique_id, split_part(unique_id, '_', 1) AS state, {STORE} AS store, {ITEM} AS department FROM panel""", "nation"))
def hierarchy_keys(spark, sf):
    parts = profile.store_parts(F.col(ID))
    return b.panel(spark, sf, "nation").select(ID).distinct().select(ID, *[v.alias(k) for k, v in parts.items()])


@query("renamed_targets", with_panel("SELECT unique_id, ds, y FROM panel"))
def renamed_targets(spark, sf):
    return b.panel(spark, sf).withColumnsRenamed({DS: "date", Y: "sales"}).withColumnsRenamed({"date": DS, "sales": Y})


MODEL_COLS = """unique_id, ds, y, weekday, month, snap_R0, snap_R1, snap_R2, snap_R3, snap_R4, "Christmas",
"IndependenceDay", "NewYear", "QuarterEnd", "Religious", "ValentinesDay" """


@query("model_frame", FEATURES + f"""SELECT {MODEL_COLS}, sell_price, is_item_exists::DOUBLE AS is_item_exists,
  0::DOUBLE AS "periods since last sales", 0::DOUBLE AS "periods since last 0 sales" FROM feats""")
def model_frame(spark, sf):
    feats = features_frame(spark, sf)
    return reshape.prepare_model_frame(feats.drop(Y, "store_id", "item_id"), feats.select(ID, DS, Y), snap_cols=())


@query("cross_validation_frame", FEATURES + """
SELECT unique_id, ds, y, weekday, month::VARCHAR AS month, sell_price, is_item_exists FROM feats""")
def cross_validation_frame(spark, sf):
    return reshape.cv_frame(features_frame(spark, sf).select(ID, DS, Y, "weekday", "month", "sell_price", "is_item_exists"))


@query("date_parts", with_panel("""
SELECT unique_id, ds, y, CAST(dayofyear(ds) AS INTEGER) AS day_of_year, CAST(weekofyear(ds) AS INTEGER) AS week_of_year,
  dayname(ds) AS weekday, CAST(month(ds) AS INTEGER) AS month, CAST(year(ds) AS INTEGER) AS year FROM panel"""))
def date_parts(spark, sf):
    return c.date_parts(b.panel(spark, sf))


@query("calendar_event_flag", CAL + """
SELECT date, coalesce(event_name_1, 'No Event') AS event_name, CASE WHEN event_name_1 IS NULL THEN 0 ELSE 1 END AS event FROM cal""")
def calendar_event_flag(spark, sf):
    return c.date_parts(b.calendar(spark, sf), "date", "event_name_1").select("date", "event_name", "event")


@query("series_as_columns", with_panel("""
SELECT ds, """ + ", ".join(f"avg(y) FILTER (unique_id = 'R{r}_1__PROMO_1') AS \"R{r}_1__PROMO_1\"" for r in range(5)) + """
FROM panel WHERE unique_id LIKE '%PROMO%' GROUP BY 1"""))
def series_as_columns(spark, sf):
    return reshape.series_to_columns(b.panel(spark, sf), [f"R{r}_1__PROMO_1" for r in range(5)])


@query("binary_columns", """SELECT 'snap_R1' AS name UNION ALL SELECT 'snap_R0' UNION ALL SELECT 'snap_R2'
UNION ALL SELECT 'snap_R3' UNION ALL SELECT 'snap_R4' UNION ALL SELECT unnest(['Christmas', 'IndependenceDay',
'NewYear', 'QuarterEnd', 'Religious', 'ValentinesDay'])""")
def binary_columns(spark, sf):
    names = reshape.binary_columns(features_frame(spark, sf))
    return spark.createDataFrame([(n,) for n in names], "name string")


@query("temporal_split", with_panel("""
SELECT 'train' AS part, count(*) AS n, min(ds) AS first_day, max(ds) AS last_day FROM panel WHERE ds < DATE '2000-06-01'
UNION ALL SELECT 'test', count(*), min(ds), max(ds) FROM panel WHERE ds >= DATE '2000-06-01'"""))
def temporal_split(spark, sf):
    parts = zip(("train", "test"), reshape.split_at(b.panel(spark, sf), "2000-06-01"))
    one = [df.agg(F.count(F.lit(1)).alias("n"), F.min(DS).alias("first_day"), F.max(DS).alias("last_day"))
           .select(F.lit(n).alias("part"), "*") for n, df in parts]
    return one[0].unionByName(one[1])


@query("last_steps_as_test", with_panel("""
SELECT unique_id, ds, y FROM panel QUALIFY row_number() OVER (PARTITION BY unique_id ORDER BY ds DESC) <= 28"""))
def last_steps_as_test(spark, sf):
    return reshape.split_last(b.panel(spark, sf), 28)[1]


@query("series_sample", with_panel("""
SELECT unique_id FROM (SELECT DISTINCT unique_id FROM panel) ORDER BY md5(unique_id||':42'), unique_id LIMIT 10""", "nation"))
def series_sample(spark, sf):
    return reshape.sample_ids(b.panel(spark, sf, "nation"), 10)


@query("series_sample_in_band", with_panel("""
SELECT unique_id FROM (SELECT unique_id FROM panel GROUP BY 1 HAVING avg(y) BETWEEN 0.1 AND 0.2)
ORDER BY md5(unique_id||':42'), unique_id LIMIT 5""", "nation"))
def series_sample_in_band(spark, sf):
    return reshape.mean_band_ids(b.panel(spark, sf, "nation"), 0.1, 0.2, 5)


@query("row_sample", """SELECT event_id, event_type, value FROM events
ORDER BY md5(concat_ws('|', event_id::VARCHAR, event_type)||':42'), event_id LIMIT 1000""")
def row_sample(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "event_type", "value")
    return reshape.sample_rows(rows, 1000, ["event_id", "event_type"])


@query("prefix_and_membership", with_panel("""
SELECT unique_id, ds, y FROM panel WHERE unique_id LIKE 'R1%' AND unique_id IN ('R1_1__PROMO_1', 'R1_1__ECONOMY_1', 'R2_1__PROMO_1')"""))
def prefix_and_membership(spark, sf):
    keep = ["R1_1__PROMO_1", "R1_1__ECONOMY_1", "R2_1__PROMO_1"]
    return reshape.where_member(reshape.where_prefix(b.panel(spark, sf), ID, "R1"), ID, keep)


@query("chosen_series", with_panel("""
SELECT unique_id, ds, y, y = 0 AS is_zero FROM panel WHERE unique_id IN ('R0_1__PROMO_1', 'R3_1__ECONOMY_1')"""))
def chosen_series(spark, sf):
    return reshape.select_series(b.panel(spark, sf), ["R0_1__PROMO_1", "R3_1__ECONOMY_1"])


# ---------------------------------------------------------------- joins

@query("features_with_calendar_and_prices", FEATURES + "SELECT * FROM feats")
def features_with_calendar_and_prices(spark, sf):
    return features_frame(spark, sf)


@query("state_calendar_join", with_panel("""
SELECT unique_id, state_id, ds, y, snap FROM (SELECT *, split_part(unique_id, '_', 1) AS state_id FROM panel)
JOIN (""" + " UNION ALL ".join(f"SELECT date, 'R{r}' AS st, snap_R{r} AS snap FROM cal" for r in range(5)) + """)
ON date = ds AND st = state_id""", more=CALENDAR_CTE))
def state_calendar_join(spark, sf):
    series = b.panel(spark, sf).withColumn("state_id", profile.store_parts(F.col(ID))["state"])
    flags = c.benefit_flags_long(b.calendar(spark, sf)).withColumnRenamed("date", DS)
    return joins.with_calendar(series, flags, ["state_id", DS])


@query("daily_prices", f"WITH {panel_cte('nation')},{CALENDAR_CTE},{prices_cte()} SELECT store_id, item_id, date, sell_price FROM prices JOIN cal USING (wm_yr_wk)")
def daily_prices(spark, sf):
    return joins.daily_prices(b.prices(spark, sf), b.calendar(spark, sf))


@query("sales_beside_daily_price", FEATURES + """
SELECT store_id, item_id, ds AS date, y, nullif(sell_price, 0) AS sell_price FROM feats""")
def sales_beside_daily_price(spark, sf):
    sales = keyed_panel(spark, sf).withColumnRenamed(DS, "date")
    return joins.sales_beside_price(sales, joins.daily_prices(b.prices(spark, sf), b.calendar(spark, sf)))


@query("features_joined_to_targets", FEATURES + "SELECT unique_id, ds, sell_price, y FROM feats")
def features_joined_to_targets(spark, sf):
    return joins.checked_join(features_frame(spark, sf).select(ID, DS, "sell_price"), b.panel(spark, sf, "nation"), [ID, DS])


@query("series_key_differences", with_panel("""
SELECT unique_id, 'left' AS only_in FROM ids WHERE unique_id LIKE 'R0%'
UNION ALL SELECT unique_id, 'right' FROM ids WHERE unique_id LIKE 'R4%'"""))
def series_key_differences(spark, sf):
    panel = b.panel(spark, sf)
    return joins.same_ids(panel.where(~F.col(ID).startswith("R4")), panel.where(~F.col(ID).startswith("R0")))


@query("train_and_test_together", with_panel("SELECT unique_id, ds, y FROM panel"))
def train_and_test_together(spark, sf):
    return joins.concat_panels(*reshape.split_at(b.panel(spark, sf), "2000-06-01"))


@query("canonical_order", with_panel("SELECT unique_id, ds, y FROM panel"))
def canonical_order(spark, sf):
    return reshape.sorted_panel(b.panel(spark, sf))


@query("top_values", """
SELECT c AS "column", v AS value, n, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, v) AS r FROM (
  SELECT 'p_type' AS c, p_type AS v, count(*) AS n FROM part GROUP BY 2
  UNION ALL SELECT 'p_brand', p_brand, count(*) FROM part GROUP BY 2
  UNION ALL SELECT 'p_name', p_name, count(*) FROM part GROUP BY 2)) WHERE r <= 5""")
def top_values(spark, sf):
    return ranking.top_values(b.table(spark, sf, "part"), ["p_type", "p_brand", "p_name"])


@query("duplicate_rows", """
SELECT sum(n)::BIGINT AS n_rows, sum(n - 1)::BIGINT AS duplicates, round(sum(n - 1) * 100.0 / sum(n), 6) AS duplicate_pct FROM (
  SELECT count(*) AS n FROM (SELECT event_id, event_type, value FROM events
  UNION ALL SELECT event_id, event_type, value FROM events WHERE event_id % 50 = 0) GROUP BY event_id, event_type, value)""")
def duplicate_rows(spark, sf):
    rows = b.table(spark, sf, "events").select("event_id", "event_type", "value")
    return quality.duplicates(rows.unionByName(rows.where(F.col("event_id") % 50 == 0)))


# ---------------------------------------------------------------- the whole dataset job

DATASET_CTE = f"""{FEATURES_CTE},
kept AS (SELECT unique_id FROM panel GROUP BY 1 HAVING avg(y) BETWEEN 0.15 AND 0.5 INTERSECT
  SELECT unique_id FROM panel WHERE ds BETWEEN DATE '2001-01-01' AND DATE '2001-10-31' GROUP BY 1 HAVING quantile_cont(y, 0.85) > 0),
run AS (SELECT *, sum((y > 0)::INTEGER) OVER (PARTITION BY unique_id ORDER BY ds) AS g,
  sum((y = 0)::INTEGER) OVER (PARTITION BY unique_id ORDER BY ds) AS z FROM panel),
iv AS (SELECT unique_id, ds, y,
  CASE WHEN y = 0 THEN sum((y = 0)::INTEGER) OVER (PARTITION BY unique_id, g ORDER BY ds) ELSE 0 END::BIGINT AS "periods since last sales",
  CASE WHEN y > 0 THEN sum((y > 0)::INTEGER) OVER (PARTITION BY unique_id, z ORDER BY ds) ELSE 0 END::BIGINT AS "periods since last 0 sales" FROM run)"""


def _dataset(spark, sf):
    lo, hi = b.span(spark, sf)
    return dataset.build_dataset(
        b.calendar(spark, sf), wide_sales(spark, sf), b.prices(spark, sf), dept=None, store=None,
        start="1996-02-01", end="2001-10-31", test_from="2001-01-01", state="R1", events=EVENTS)


@query("dataset_targets", f"WITH {DATASET_CTE} SELECT iv.* FROM iv JOIN kept USING (unique_id) WHERE ds BETWEEN DATE '1996-02-01' - 30 AND DATE '2001-10-31'")
def dataset_targets(spark, sf):
    return _dataset(spark, sf)[1]


@query("dataset_features", f"""WITH {DATASET_CTE} SELECT feats.* EXCLUDE (y, store_id, item_id, snap_R0, snap_R2, snap_R3, snap_R4)
FROM feats JOIN kept USING (unique_id) WHERE ds BETWEEN DATE '1996-02-01' - 30 AND DATE '2001-10-31'""")
def dataset_features(spark, sf):
    return _dataset(spark, sf)[0]
