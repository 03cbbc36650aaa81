"""Readers, writers, checks and the dataset job."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from demandgrid.functions.core import ID
from demandgrid.operators import quality
from demandgrid.plans.dataset import build_dataset
from demandgrid.sources import checks, files


@pytest.fixture
def raw(spark, tmp_path):
    """Five items in one store over 60 days, as CSV files."""
    days = [dt.date(2015, 1, 1) + dt.timedelta(i) for i in range(60)]
    cal = tmp_path / "calendar.csv"
    cal.write_text("date,wm_yr_wk,weekday,wday,month,year,d,event_name_1,event_type_1,event_name_2,event_type_2,snap_CA,snap_TX\n" + "".join(
        f"{d},{i // 7},{d:%A},{d.isoweekday()},{d.month},{d.year},d_{i + 1},{'NewYear' if i == 0 else ''},{'National' if i == 0 else ''},,,{int(d.day < 11)},0\n"
        for i, d in enumerate(days)))
    sales = tmp_path / "sales.csv"
    ys = {"A": [1 if i % 3 == 0 else 0 for i in range(60)], "B": [5] * 60, "C": [0] * 60, "D": [1] * 20 + [0] * 40,
          "E": [1 if i % 4 == 0 else 0 for i in range(60)]}
    sales.write_text("id,item_id,dept_id,cat_id,store_id,state_id," + ",".join(f"d_{i + 1}" for i in range(60)) + "\n" + "".join(
        f"{k}_CA_1,{k},{'FOODS_3' if k != 'E' else 'HOBBIES_1'},FOODS,CA_1,CA," + ",".join(map(str, v)) + "\n" for k, v in ys.items()))
    prices = tmp_path / "prices.csv"
    prices.write_text("store_id,item_id,wm_yr_wk,sell_price\n" + "".join(f"CA_1,A,{w},2.5\n" for w in range(2, 9)))
    return str(cal), str(sales), str(prices)


def test_dataset_job(spark, raw):
    cal, sales, prices = files.read_calendar(spark, raw[0]), files.read_sales_wide(spark, raw[1]), files.read_prices(spark, raw[2])
    assert dict(sales.dtypes)["d_1"] == "int" and dict(cal.dtypes)["date"] == "date"
    checks.require_ok(checks.check_sources(cal, sales, prices, "2015-01-05", "2015-02-20", "CA_1", "FOODS_3"))
    feats, targets = build_dataset(cal, sales, prices, dept="FOODS_3", store="CA_1", start="2015-01-05", end="2015-02-20",
                                   test_from="2015-02-01", max_lag=3, mean_band=(0.15, 0.5))
    assert {r[0] for r in targets.select(ID).distinct().collect()} == {"CA_1__A"}
    t = targets.orderBy("ds").collect()
    assert (str(t[0].ds), str(t[-1].ds), len(t)) == ("2015-01-02", "2015-02-20", 50)
    # the counter carries in from before the range: 01-02 is the first day after a sale
    assert t[0]["periods since last sales"] == 1 and targets.columns == [
        ID, "ds", "y", "periods since last sales", "periods since last 0 sales"]
    f = feats.orderBy("ds").collect()
    assert len(f) == 50 and "snap_TX" not in feats.columns and "snap_CA" in feats.columns and "d" not in feats.columns
    assert (f[0].sell_price, f[0].is_item_exists) == (0.0, 0) and (f[-1].sell_price, f[-1].is_item_exists) == (2.5, 1)


def test_failed_checks_are_named(spark, raw):
    cal, sales, prices = (files.read_calendar(spark, raw[0]), files.read_sales_wide(spark, raw[1]), files.read_prices(spark, raw[2]))
    with pytest.raises(ValueError, match="store present") as e:
        checks.require_ok(checks.check_sources(cal, sales, prices.limit(0), "2014-01-05", "2015-02-20", "TX_9", "FOODS_3"))
    assert "covers range" in str(e.value) and "prices not empty" in str(e.value) and "department" not in str(e.value)


def test_missing_columns(spark, tmp_path):
    p = tmp_path / "c.csv"
    p.write_text("date,x\n2015-01-01,1\n")
    with pytest.raises(ValueError, match="lacks columns"):
        files.read_calendar(spark, str(p))


def test_date_column_names(spark, tmp_path):
    p = tmp_path / "x.csv"
    p.write_text("unique_id,timestamp,y\na,2015-01-01 00:00:00,1\n")
    assert dict(files.read_panel(spark, str(p)).dtypes)["timestamp"] == "date"


def test_dated_names_and_partitioned_write(spark, series, tmp_path):
    path = files.write_panel(series({"a": [1, 2]}), str(tmp_path), "features", "2012-01-01", "2015-12-31", partition_by=[ID])
    assert path.endswith("features_2012-01-01_2015-12-31.parquet")
    assert files.read_panel(spark, path).count() == 2


def test_find_files(spark, series, tmp_path):
    folder = str(tmp_path / "processed")
    with pytest.raises(Exception):
        files.read_matching(spark, folder, "features_*.csv")
    series({"a": [1, 2]}).coalesce(1).write.option("header", "true").csv(folder)
    assert files.read_matching(spark, folder, "no_such_*.csv").count() == 2


def test_experiment_log_appends(spark, tmp_path):
    path = str(tmp_path / "log")
    for n in ("one", "two"):
        files.log_experiments(spark.createDataFrame([(n, "first try")], "name string, description string"), path)
    rows = files.read_experiments(spark, path).orderBy("name").collect()
    assert [r.name for r in rows] == ["one", "two"] and rows[0].status == "completed"


def test_schema_rules_and_coercion(spark):
    df = spark.createDataFrame([("a", "2015-01-01", "-1", 7), (None, "bad", "x", 3)],
                               "unique_id string, ds string, sales string, weekday int")
    got = {(r.column, r.rule): r.violations for r in quality.schema_violations(df, quality.SALES_RULES).collect()}
    assert got[("unique_id", "not null")] == 1 and got[("ds", "type date")] == 1 and got[("sales", ">= 0")] == 1
    assert got[("sales", "type double")] == 1 and got[("weekday", "<= 6")] == 1 and got[("month", "column present")] == 1
    assert [r.sales for r in quality.coerce(df, quality.SALES_RULES).collect()] == [-1.0, None]


def test_alert_levels(spark):
    df = spark.createDataFrame([(79.0, 94.0, 100.0, 84.0)], "completeness double, consistency double, accuracy double, overall double")
    got = [(r.metric, r.severity) for r in quality.alerts(df, quality.QUALITY_RULES).collect()]
    assert got == [("completeness", "high"), ("consistency", "medium"), ("overall", "medium")]
    err = spark.createDataFrame([(6.0, 3.5, 1.0)], "best_mae double, best_rmse double, best_mase double")
    assert [(r.metric, r.severity) for r in quality.alerts(err, quality.ERROR_RULES).collect()] == [("best_mae", "high"), ("best_rmse", "medium")]


def test_row_features_run_on_a_stream(spark, tmp_path):
    """Operators that are plain row expressions accept a streaming frame unchanged."""
    from demandgrid.operators import calendars
    from demandgrid.operators import features as ft
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).select(F.date_add(F.lit("2020-01-01").cast("date"), F.col("id").cast("int")).alias("ds"),
                          F.lit(0.05).alias("p")).write.parquet(src)
    stream = spark.readStream.schema("ds date, p double").parquet(src)
    rows = ft.zero_small(ft.fourier(calendars.date_parts(stream), k=1), ["p"])
    run = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(
        availableNow=True).start()
    run.awaitTermination(120)
    back = spark.read.parquet(out)
    assert back.count() == 5 and back.agg(F.max("p")).first()[0] == 0.0 and "fourier_sin_1" in back.columns
