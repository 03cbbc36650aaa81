"""Registry of queries and the shared inputs they start from (see FIXTURES.md, part 2)."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, round_doubles
from demandgrid.operators.panel import daily_dates, date_bounds, fill_gaps, to_panel

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None) -> Callable[[Query], Query]:
    """Register a query; doubles are rounded to six digits on both sides of the comparison."""

    def add(fn: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            # the benchmark timestamps carry no zone; dates must not shift with the session
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return round_doubles(fn(spark, sf_dir))

        run.__name__, run.__doc__ = name, fn.__doc__
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = run
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return add


def load_all() -> None:
    from demandgrid.catalog import (  # noqa: F401
        dataset_queries, feature_queries, forecast_queries, metric_queries, profile_queries,
        quality_queries, window_queries)


# ---------------------------------------------------------------- inputs

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


STORE_OF = {"region": ("'R'||n_regionkey||'_1'", lambda: F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("_1"))),
            "nation": ("'R'||n_regionkey||'_'||n_nationkey",
                       lambda: F.concat(F.lit("R"), F.col("n_regionkey").cast("string"), F.lit("_"),
                                        F.col("n_nationkey").cast("string")))}


def sales_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with its store and item attributes; the dimension sides are left to Spark to size."""
    t = lambda n: table(spark, sf_dir, n)
    line = t("lineitem").select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
                                F.col("l_shipdate").cast("date").alias("ship_date"))
    return (line
            .join(t("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
            .join(t("nation").select("n_nationkey", "n_regionkey"), F.col("s_nationkey") == F.col("n_nationkey"))
            .join(t("part").select("p_partkey", "p_type"), F.col("l_partkey") == F.col("p_partkey")))


def span(spark: SparkSession, sf_dir: str) -> tuple[date, date]:
    return date_bounds(table(spark, sf_dir, "lineitem"), F.col("l_shipdate"))


def observed(spark: SparkSession, sf_dir: str, level: str) -> DataFrame:
    store = STORE_OF[level][1]()
    uid = F.concat(store, F.lit("__"), F.col("p_type"), F.lit("_1"))
    return to_panel(sales_rows(spark, sf_dir), uid, F.col("ship_date"))


def panel(spark: SparkSession, sf_dir: str, level: str = "region") -> DataFrame:
    """Gap-free daily panel: unique_id, ds, y (bigint)."""
    lo, hi = span(spark, sf_dir)
    return fill_gaps(observed(spark, sf_dir, level), lo, hi)


def calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every day between the first and the last shipment, read off the table within the same plan."""
    shipped = F.col("l_shipdate").cast("date")
    ends = table(spark, sf_dir, "lineitem").agg(F.min(shipped).alias("__lo"), F.max(shipped).alias("__hi"))
    return _calendar(ends.select("__lo", F.explode(F.sequence("__lo", "__hi")).alias(DS)), F.col("__lo"))


def calendar_between(spark: SparkSession, lo: date, hi: date) -> DataFrame:
    return _calendar(daily_dates(spark, lo, hi), F.lit(str(lo)).cast("date"))


def _calendar(cal: DataFrame, first: Column) -> DataFrame:
    monday = F.lit("1995-01-02").cast("date")
    md = F.date_format(DS, "MM-dd")
    named = F.when(md == "12-25", "Christmas").when(md == "01-01", "NewYear") \
        .when(md == "07-04", "IndependenceDay").when(md == "02-14", "ValentinesDay")
    second = F.when(md == "12-25", "Religious").when(
        (F.month(DS) % 3 == 0) & (F.col(DS) == F.last_day(DS)), "QuarterEnd")
    dom = F.dayofmonth(DS)
    return cal.select(
        F.col(DS).alias("date"),
        F.floor(F.datediff(F.col(DS), monday) / 7).cast("int").alias("wm_yr_wk"),
        F.date_format(DS, "EEEE").alias("weekday"),
        (F.weekday(DS) + 1).cast("int").alias("wday"),
        F.month(DS).alias("month"), F.year(DS).alias("year"),
        F.concat(F.lit("d_"), (F.datediff(F.col(DS), first) + 1).cast("string")).alias("d"),
        named.alias("event_name_1"),
        F.when(named.isNotNull(), F.lit("National")).alias("event_type_1"),
        second.alias("event_name_2"),
        F.when(second.isNotNull(), F.lit("Other")).alias("event_type_2"),
        *[F.when(dom.between(1 + r, 10 + r), 1).otherwise(0).alias(f"snap_R{r}") for r in range(5)])


def prices(spark: SparkSession, sf_dir: str, level: str = "nation") -> DataFrame:
    """Mean unit price per store, item and week; weeks without a sale are absent."""
    monday = F.lit("1995-01-02").cast("date")
    rows = sales_rows(spark, sf_dir)
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    return (rows.groupBy(STORE_OF[level][1]().alias("store_id"),
                         F.concat("p_type", F.lit("_1")).alias("item_id"),
                         F.floor(F.datediff("ship_date", monday) / 7).cast("int").alias("wm_yr_wk"))
            .agg((F.floor(F.avg(unit) * 100 + 0.5) / 100).alias("sell_price")))


# ---------------------------------------------------------------- the same inputs in SQL

def panel_cte(level: str = "region") -> str:
    store = STORE_OF[level][0]
    return f"""
rng AS (SELECT min(CAST(l_shipdate AS DATE)) AS lo, max(CAST(l_shipdate AS DATE)) AS hi FROM lineitem),
days AS (SELECT CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS ds FROM rng),
obs AS (SELECT {store}||'__'||p_type||'_1' AS unique_id, CAST(l_shipdate AS DATE) AS ds, count(*) AS y
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
ids AS (SELECT DISTINCT unique_id FROM obs),
panel AS (SELECT i.unique_id, d.ds, coalesce(o.y, 0) AS y FROM ids i CROSS JOIN days d
          LEFT JOIN obs o ON o.unique_id = i.unique_id AND o.ds = d.ds)"""


CALENDAR_CTE = """
cal AS (SELECT ds AS date, CAST(floor(date_diff('day', DATE '1995-01-02', ds) / 7.0) AS INTEGER) AS wm_yr_wk,
  dayname(ds) AS weekday, CAST(isodow(ds) AS INTEGER) AS wday, CAST(month(ds) AS INTEGER) AS month,
  CAST(year(ds) AS INTEGER) AS year, 'd_'||(date_diff('day', lo, ds) + 1) AS d,
  CASE strftime(ds, '%m-%d') WHEN '12-25' THEN 'Christmas' WHEN '01-01' THEN 'NewYear'
    WHEN '07-04' THEN 'IndependenceDay' WHEN '02-14' THEN 'ValentinesDay' END AS event_name_1,
  CASE WHEN strftime(ds, '%m-%d') IN ('12-25', '01-01', '07-04', '02-14') THEN 'National' END AS event_type_1,
  CASE WHEN strftime(ds, '%m-%d') = '12-25' THEN 'Religious'
    WHEN month(ds) % 3 = 0 AND ds = last_day(ds) THEN 'QuarterEnd' END AS event_name_2,
  CASE WHEN strftime(ds, '%m-%d') = '12-25' OR (month(ds) % 3 = 0 AND ds = last_day(ds)) THEN 'Other' END AS event_type_2,
""" + ",\n".join(
    f"  CASE WHEN day(ds) BETWEEN {1 + r} AND {10 + r} THEN 1 ELSE 0 END AS snap_R{r}" for r in range(5)) + """
  FROM days, rng)"""


def prices_cte(level: str = "nation") -> str:
    return f"""
prices AS (SELECT {STORE_OF[level][0]} AS store_id, p_type||'_1' AS item_id,
  CAST(floor(date_diff('day', DATE '1995-01-02', CAST(l_shipdate AS DATE)) / 7.0) AS INTEGER) AS wm_yr_wk,
  floor(avg(l_extendedprice / l_quantity) * 100 + 0.5) / 100 AS sell_price
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
  JOIN part ON l_partkey = p_partkey GROUP BY 1, 2, 3)"""


def with_panel(body: str, level: str = "region", more: str = "") -> str:
    return f"WITH {panel_cte(level)}{',' + more if more else ''}\n{body}"


__all__ = ["DS", "ID", "Y", "query", "table", "panel", "observed", "calendar", "prices", "span",
           "with_panel", "panel_cte", "CALENDAR_CTE", "prices_cte"]
