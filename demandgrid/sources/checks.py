"""Contract checks on inputs.  Each returns rows (check, ok, detail) from a few aggregates."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.core import DS, ID, Y, count_if, day, q
from demandgrid.operators.joins import same_ids


def _rows(agg: DataFrame, checks: dict[str, tuple]) -> DataFrame:
    """Turn one aggregate row into one row per named check."""
    cells = F.array(*[
        F.struct(F.lit(n).alias("check"), ok.alias("ok"), detail.cast("string").alias("detail"))
        for n, (ok, detail) in checks.items()])
    return agg.select(F.explode(cells).alias("c")).select("c.*")


def check_sources(calendar: DataFrame, sales: DataFrame, prices: DataFrame, start: date | str,
                  end: date | str, store: str, dept: str) -> DataFrame:
    """Tables not empty, calendar covers the range, store and department occur."""
    c = calendar.agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"))
    s = sales.agg(F.count(F.lit(1)).alias("n"),
                  F.coalesce(F.max(q("store_id") == store), F.lit(False)).alias("has_store"),
                  F.coalesce(F.max(q("dept_id") == dept), F.lit(False)).alias("has_dept"))
    p = prices.agg(F.count(F.lit(1)).alias("n"))
    n = F.col("n")
    return (_rows(c, {
        "calendar not empty": (n > 0, n),
        "calendar covers range": (F.coalesce((F.col("lo") <= day(start)) & (F.col("hi") >= day(end)), F.lit(False)),
                                  F.concat_ws("..", F.col("lo").cast("string"), F.col("hi").cast("string")))})
        .unionByName(_rows(s, {
            "sales not empty": (n > 0, n),
            "store present": (F.col("has_store"), F.lit(store)),
            "department present": (F.col("has_dept"), F.lit(dept))}))
        .unionByName(_rows(p, {"prices not empty": (n > 0, n)})))


def check_panel(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Required columns, date type, NULL cells, same keys on both sides."""
    static = []
    for what, df, want in (("features", features, [ID, DS]), ("targets", targets, [ID, DS, Y])):
        missing = [c for c in want if c not in df.columns]
        static.append((f"{what} columns", not missing, ",".join(missing)))
        is_date = DS in df.columns and isinstance(df.schema[DS].dataType,
                                                  (T.DateType, T.TimestampType, T.TimestampNTZType))
        static.append((f"{what} ds is a date", is_date, df.schema[DS].dataType.simpleString() if DS in df.columns else ""))
    spark = features.sparkSession
    out = spark.createDataFrame(static, "check string, ok boolean, detail string")
    for what, df in (("features", features), ("targets", targets)):
        one = df.agg(sum((count_if(q(c).isNull()) for c in df.columns), F.lit(0)).alias("n"))
        out = out.unionByName(_rows(one, {f"{what} without NULL": (F.col("n") == 0, F.col("n"))}))
    diff = same_ids(features, targets).agg(F.count(F.lit(1)).alias("n"))
    return out.unionByName(_rows(diff, {"same series on both sides": (F.col("n") == 0, F.col("n"))}))


def panel_info(df: DataFrame, name: str) -> DataFrame:
    """Rows, columns, distinct series and date range; series counted after collapsing each one."""
    per = df.groupBy(ID).agg(F.count(F.lit(1)).alias("n"), F.min(DS).alias("lo"), F.max(DS).alias("hi"))
    return per.agg(F.sum("n").alias("n_rows"), F.count(F.lit(1)).alias("n_series"),
                   F.min("lo").alias("first_day"), F.max("hi").alias("last_day")).select(
        F.lit(name).alias("name"), "n_rows", F.lit(len(df.columns)).alias("n_columns"), "n_series",
        "first_day", "last_day")


def require_ok(checks: DataFrame) -> None:
    """Raise when a check failed (the rows are few: one per check)."""
    bad = [f"{r.check} ({r.detail})" for r in checks.where(~F.col("ok")).collect()]
    if bad:
        raise ValueError("input checks failed: " + "; ".join(bad))
