"""Data quality queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from demandgrid.catalog import base as b
from demandgrid.catalog.base import query, with_panel
from demandgrid.catalog.metric_queries import MODELS, MORE, _eval, predictions
from demandgrid.catalog.profile_queries import HOLES_CTE, with_holes
from demandgrid.functions.core import DS, ID, Y
from demandgrid.operators import metrics as m
from demandgrid.operators import quality as ql

COLS = {"event_id": "numeric", "day": "date", "user_id": "numeric", "event_type": "text", "value": "numeric"}


def _profile_row(c: str, kind: str) -> str:
    num, dat, txt = kind == "numeric", kind == "date", kind == "text"
    return f"""SELECT '{c}' AS "column", '{kind}' AS kind, count(DISTINCT {c}) AS distinct_count, count(*) FILTER ({c} IS NULL) AS missing,
  {f"min({c})::DOUBLE" if num else "NULL::DOUBLE"} AS min, {f"max({c})::DOUBLE" if num else "NULL::DOUBLE"} AS max,
  {f"round(avg({c}), 6)" if num else "NULL::DOUBLE"} AS mean, {f"round(stddev_samp({c}), 6)" if num else "NULL::DOUBLE"} AS std,
  {f"count(*) FILTER ({c} = 0)" if num else "NULL::BIGINT"} AS zeros, {f"count(*) FILTER ({c} < 0)" if num else "NULL::BIGINT"} AS negative,
  {f"min({c})::VARCHAR" if dat else "NULL::VARCHAR"} AS min_date, {f"max({c})::VARCHAR" if dat else "NULL::VARCHAR"} AS max_date,
  {f"date_diff('day', min({c}), max({c}))" if dat else "NULL::BIGINT"} AS span_days,
  {f"round(avg(length({c})), 6)" if txt else "NULL::DOUBLE"} AS mean_length,
  round(count(DISTINCT {c}) * 100.0 / count(*), 6) AS distinct_pct, round(count(*) FILTER ({c} IS NULL) * 100.0 / count(*), 6) AS missing_pct
FROM holes"""


PROFILE = " UNION ALL ".join(_profile_row(c, k) for c, k in COLS.items())
DUPS = "(SELECT sum(n - 1) * 100.0 / sum(n) FROM (SELECT count(*) AS n FROM holes GROUP BY ALL))"
NULLS = " + ".join(f"count(*) FILTER ({c} IS NULL)" for c in COLS)


def doubled(spark, sf):
    """events with holes, every 50th row twice."""
    df = with_holes(spark, sf)
    return df.unionByName(df.where(F.col("event_id") % 50 == 0))


DOUBLED_CTE = f"""{HOLES_CTE.replace('holes AS', 'base AS')},
holes AS (SELECT * FROM base UNION ALL SELECT * FROM base WHERE event_id % 50 = 0)"""


@query("column_profile", f"WITH {HOLES_CTE} {PROFILE}")
def column_profile(spark, sf):
    return ql.column_profile(with_holes(spark, sf))


@query("quality_report", f"""WITH {DOUBLED_CTE}
SELECT count(*) AS n_rows, 5 AS n_columns, {NULLS} AS missing_cells, round(({NULLS}) * 100.0 / (count(*) * 5), 6) AS missing_pct,
  (SELECT sum(n - 1) FROM (SELECT count(*) AS n FROM holes GROUP BY event_id, day, user_id, event_type, value))::BIGINT AS duplicates,
  round((SELECT sum(n - 1) * 100.0 / sum(n) FROM (SELECT count(*) AS n FROM holes GROUP BY event_id, day, user_id, event_type, value)), 6) AS duplicate_pct
FROM holes""")
def quality_report(spark, sf):
    return ql.quality_report(doubled(spark, sf))


def _score_sql(missing: str) -> str:
    return f"""WITH {DOUBLED_CTE}, prof AS ({PROFILE}),
dup AS (SELECT sum(n - 1) * 100.0 / sum(n) AS d FROM (SELECT count(*) AS n FROM holes GROUP BY event_id, day, user_id, event_type, value))
SELECT round(greatest(0.0::DOUBLE, 100 - avg({missing}) * 0.5 - (SELECT d FROM dup) * 0.3
  - sum(CASE WHEN distinct_pct < 1 THEN 5 WHEN distinct_pct < 5 THEN 2 ELSE 0 END)), 6) AS score FROM prof"""


@query("quality_score", _score_sql("missing_pct"))
def quality_score(spark, sf):
    df = doubled(spark, sf)
    return ql.quality_score(ql.column_profile(df), ql.duplicates(df))


@query("quality_score_by_counts", _score_sql("missing"))
def quality_score_by_counts(spark, sf):
    df = doubled(spark, sf)
    return ql.quality_score(ql.column_profile(df), ql.duplicates(df), counts=True)


QUALITY_CTE = f"""{DOUBLED_CTE},
tg AS (SELECT event_id, CASE WHEN event_id % 17 <> 0 THEN value - 5 END AS y FROM events),
fd AS (SELECT sum(n - 1) AS d, sum(n) AS n FROM (SELECT count(*) AS n FROM holes GROUP BY event_id, day, user_id, event_type, value)),
ql AS (SELECT round((n * 5 + t * 2 - fm - tm) * 100.0 / (n * 5 + t * 2), 6) AS completeness, round((n + t - d) * 100.0 / (n + t), 6) AS consistency,
  round(acc, 6) AS accuracy, round(((n * 5 + t * 2 - fm - tm) * 100.0 / (n * 5 + t * 2) + (n + t - d) * 100.0 / (n + t) + acc) / 3, 6) AS overall
  FROM fd, (SELECT {NULLS} AS fm FROM holes), (SELECT count(*) AS t, count(*) FILTER (y IS NULL) AS tm,
    avg(CASE WHEN y < 0 THEN 0.0::DOUBLE ELSE 100 END) AS acc FROM tg))"""


def _dataset_quality(spark, sf):
    targets = b.table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 17 != 0, F.col("value") - 5).alias(Y))
    return ql.dataset_quality(doubled(spark, sf), targets)


@query("dataset_quality", f"WITH {QUALITY_CTE} SELECT * FROM ql")
def dataset_quality(spark, sf):
    return _dataset_quality(spark, sf)


@query("quality_alerts", f"""WITH {QUALITY_CTE}
SELECT 'completeness' AS metric, CASE WHEN completeness < 80 THEN 'high' ELSE 'medium' END AS severity, 'Low data completeness' AS message, completeness AS value FROM ql WHERE completeness < 90
UNION ALL SELECT 'consistency', 'medium', 'Data consistency issues', consistency FROM ql WHERE consistency < 95
UNION ALL SELECT 'accuracy', CASE WHEN accuracy < 95 THEN 'high' ELSE 'medium' END, 'Data accuracy issues', accuracy FROM ql WHERE accuracy < 100
UNION ALL SELECT 'overall', CASE WHEN overall < 75 THEN 'high' ELSE 'medium' END, 'Overall data quality is low', overall FROM ql WHERE overall < 85""")
def quality_alerts(spark, sf):
    return ql.alerts(_dataset_quality(spark, sf), ql.QUALITY_RULES)


@query("error_alerts", with_panel("""
SELECT metric, CASE WHEN value > severe THEN 'high' ELSE 'medium' END AS severity, message, value FROM (
  SELECT 'best_mae' AS metric, 'High MAE' AS message, mae AS value, 2.0 AS border, 5.0 AS severe FROM zero
  UNION ALL SELECT 'best_rmse', 'High RMSE', rmse, 3.0, 7.0 FROM zero
  UNION ALL SELECT 'best_mase', 'High MASE', mase, 1.5, 2.0 FROM zero) WHERE value > border""",
                                  more=f"{MORE}, zero AS (SELECT * FROM ({_eval('unique_id, cutoff')}) WHERE model = 'ZeroModel')"))
def error_alerts(spark, sf):
    zero = m.evaluate(predictions(spark, sf), ["ZeroModel"], [ID, "cutoff"])
    return ql.alerts(zero.withColumnsRenamed({k: f"best_{k}" for k in ("mae", "rmse", "mase")}), ql.ERROR_RULES)


def _history(spark, sf):
    """A quality history: one check per store and month of the panel, scored by its share of sale days."""
    zero = F.avg(F.when(F.col(Y) == 0, 1.0).otherwise(0.0))
    return (b.panel(spark, sf).groupBy(F.split(ID, "__")[0].alias("dataset"), F.last_day(DS).alias("checked_at"))
            .agg((100 - 100 * zero).alias("score"), zero.alias("mean_missing")))


HISTORY_CTE = """
hist AS (SELECT split_part(unique_id, '__', 1) AS dataset, last_day(ds) AS checked_at,
  100 - 100 * avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS score, avg(CASE WHEN y = 0 THEN 1.0::DOUBLE ELSE 0 END) AS mean_missing
  FROM panel GROUP BY 1, 2)"""


@query("quality_trends", with_panel("""
SELECT dataset, count(*) AS n_checks, min(checked_at) AS first_check, max(checked_at) AS last_check, round(avg(score), 6) AS mean_score,
  round(stddev_pop(score), 6) AS std_score, round(avg(mean_missing), 6) AS mean_missing,
  CASE WHEN arg_max(score, checked_at) > arg_min(score, checked_at) THEN 'improving' ELSE 'declining' END AS trend FROM hist GROUP BY 1""",
                                    more=HISTORY_CTE))
def quality_trends(spark, sf):
    return ql.score_trends(_history(spark, sf))


@query("quality_dashboard", with_panel("""
SELECT count(*) AS n_checks, count(DISTINCT dataset) AS n_datasets, round(avg(score), 6) AS avg_score, round(min(score), 6) AS min_score,
  round(max(score), 6) AS max_score FROM hist""", more=HISTORY_CTE))
def quality_dashboard(spark, sf):
    return ql.score_dashboard(_history(spark, sf))


@query("schema_rule_violations", with_panel("""
SELECT 'unique_id' AS "column", 'type string' AS rule, 0::BIGINT AS violations FROM rng UNION ALL SELECT 'unique_id', 'not null', 0 FROM rng
UNION ALL SELECT 'ds', 'type date', 0 FROM rng UNION ALL SELECT 'ds', 'not null', 0 FROM rng
UNION ALL SELECT 'sales', 'type double', 0 FROM rng UNION ALL SELECT 'sales', '>= 0', count(*) FILTER (y - 1 < 0) FROM panel
UNION ALL SELECT 'weekday', 'type int', 0 FROM rng UNION ALL SELECT 'weekday', '>= 0', 0 FROM rng
UNION ALL SELECT 'weekday', '<= 6', count(*) FILTER (isodow(ds) > 6) FROM panel
UNION ALL SELECT 'month', 'type int', 0 FROM rng UNION ALL SELECT 'month', '>= 1', 0 FROM rng UNION ALL SELECT 'month', '<= 12', 0 FROM rng
UNION ALL SELECT 'year', 'column present', 1 FROM rng UNION ALL SELECT 'extra', 'no other columns', 1 FROM rng"""))
def schema_rule_violations(spark, sf):
    df = b.panel(spark, sf).select(
        ID, DS, (F.col(Y) - 1).alias("sales"), (F.weekday(DS) + 1).cast("string").alias("weekday"),
        F.month(DS).alias("month"), F.lit(0).alias("extra"))
    return ql.schema_violations(df, ql.SALES_RULES)


RULES = [{"kind": "not_null", "column": "value"}, {"kind": "between", "column": "value", "min": 0, "max": 50},
         {"kind": "in_set", "column": "event_type", "values": ["click", "view", "purchase"]},
         {"kind": "row_count", "min": 1}, {"kind": "unique", "column": "event_id"},
         {"kind": "unique", "column": ["day", "user_id"]}]
EXPECT_SQL = """ex AS (
SELECT 'not_null' AS expectation, 'value' AS "column", count(*) FILTER (value IS NULL) AS unexpected FROM holes
UNION ALL SELECT 'between', 'value', count(*) FILTER (value < 0 OR value > 50) FROM holes
UNION ALL SELECT 'in_set', 'event_type', count(*) FILTER (event_type NOT IN ('click', 'view', 'purchase')) FROM holes
UNION ALL SELECT 'row_count', '', CASE WHEN count(*) >= 1 THEN 0 ELSE 1 END FROM holes
UNION ALL SELECT 'unique', 'event_id', (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM holes GROUP BY event_id)
UNION ALL SELECT 'unique', 'day,user_id', (sum(n) - count(*))::BIGINT FROM (SELECT count(*) AS n FROM holes GROUP BY day, user_id))"""


@query("expectations", f"WITH {DOUBLED_CTE}, {EXPECT_SQL} SELECT *, unexpected = 0 AS success FROM ex")
def expectations(spark, sf):
    return ql.expectations(doubled(spark, sf), RULES)


@query("expectation_statistics", f"""WITH {DOUBLED_CTE}, {EXPECT_SQL} SELECT count(*) AS evaluated, count(*) FILTER (unexpected = 0) AS successful,
  count(*) FILTER (unexpected <> 0) AS failed, round(avg(CASE WHEN unexpected = 0 THEN 100.0::DOUBLE ELSE 0 END), 6) AS success_pct FROM ex""")
def expectation_statistics(spark, sf):
    return ql.expectation_statistics(ql.expectations(doubled(spark, sf), RULES))
