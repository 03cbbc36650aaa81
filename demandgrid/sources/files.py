"""Readers and writers of the files the pipelines exchange.  CSV and Parquet by extension."""

from __future__ import annotations

import json
import re
from collections.abc import Mapping, Sequence
from datetime import date

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.core import DS, q, require

# Calendar columns and price columns of the source files.
CALENDAR_TYPES = {
    "date": T.DateType(), "wm_yr_wk": T.IntegerType(), "weekday": T.StringType(), "wday": T.IntegerType(),
    "month": T.IntegerType(), "year": T.IntegerType(), "d": T.StringType(),
    "event_name_1": T.StringType(), "event_type_1": T.StringType(),
    "event_name_2": T.StringType(), "event_type_2": T.StringType()}
PRICE_SCHEMA = "store_id string, item_id string, wm_yr_wk int, sell_price double"
DATE_NAMES = ("date", "ds", "timestamp")


def _is_parquet(path: str) -> bool:
    return path.rstrip("/").endswith(".parquet")


def _header(spark: SparkSession, path: str) -> list[str]:
    """Column names of a CSV file: reads its first line only."""
    return spark.read.csv(path, header=True, inferSchema=False).columns


def _csv(spark: SparkSession, path: str, typed: Mapping[str, T.DataType],
         other: T.DataType, prefixes: Mapping[str, T.DataType] | None = None, mode: str = "PERMISSIVE") -> DataFrame:
    """Columns are checked against every file's header, so files with another order are refused, not misread;
    ``mode='FAILFAST'`` also refuses cells that don't parse, which are NULL otherwise."""

    def of(name: str) -> T.DataType:
        for p, t in (prefixes or {}).items():
            if name.startswith(p):
                return t
        return typed.get(name, other)

    schema = T.StructType([T.StructField(c, of(c)) for c in _header(spark, path)])
    # wide sales rows hold a day per column; the parser's default stops at 20,480
    return spark.read.csv(path, header=True, schema=schema, dateFormat="yyyy-MM-dd", enforceSchema=False, mode=mode,
                          maxColumns=max(20480, len(schema) + 1))


def read_calendar(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    df = (spark.read.parquet(path) if _is_parquet(path) else
          _csv(spark, path, CALENDAR_TYPES, T.StringType(), {"snap_": T.IntegerType()}, mode))
    require(df, ["d", "date"], "calendar")
    return df.withColumn("date", F.to_date("date"))


def read_sales_wide(spark: SparkSession, path: str, ids: Sequence[str] = ("store_id", "item_id"),
                    prefix: str = "d_", mode: str = "PERMISSIVE") -> DataFrame:
    df = (spark.read.parquet(path) if _is_parquet(path) else
          _csv(spark, path, {}, T.StringType(), {prefix: T.IntegerType()}, mode))
    require(df, ["dept_id", "store_id", *ids], "sales")
    return df


def read_prices(spark: SparkSession, path: str) -> DataFrame:
    want = ["store_id", "item_id", "wm_yr_wk", "sell_price"]
    if _is_parquet(path):
        df = spark.read.parquet(path)
    else:
        types = {f.name: f.dataType for f in T.StructType.fromDDL(PRICE_SCHEMA).fields}
        df = _csv(spark, path, types, T.StringType())
    require(df, want, "prices")
    return df


def read_panel(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Features or targets; the first of date / ds / timestamp becomes a date.

    Give a schema for CSV at scale: without one Spark reads the file twice to infer it.
    """
    if _is_parquet(path):
        df = spark.read.parquet(path)
    elif schema is not None:
        df = spark.read.csv(path, header=True, schema=schema, enforceSchema=False)
    else:
        df = spark.read.csv(path, header=True, inferSchema=True)
    for name in DATE_NAMES:
        if name in df.columns:
            return df.withColumn(name, F.to_date(q(name)))
    return df


def read_matching(spark: SparkSession, folder: str, pattern: str, schema: T.StructType | str | None = None,
                  fallback: str = "*.csv") -> DataFrame:
    """Files of a folder whose names match the pattern; any CSV file when none does."""
    for glob in (pattern, fallback):
        fmt = "parquet" if glob.endswith("parquet") else "csv"
        reader = spark.read.option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        if schema is not None:
            reader = reader.schema(schema)
        elif fmt == "csv":
            reader = reader.option("inferSchema", "true")
        try:
            df = reader.option("header", "true").format(fmt).load(folder)
        except Exception as e:  # nothing to infer a schema from: no file matched
            if "UNABLE_TO_INFER_SCHEMA" in str(e):
                continue
            raise
        if df.columns and not df.isEmpty():
            return df
    raise FileNotFoundError(f"no {pattern} or {fallback} in {folder}")


def panel_name(kind: str, start: date | str, end: date | str) -> str:
    """File name that carries the date range, e.g. features_2012-01-01_2015-12-31."""
    return f"{kind}_{start}_{end}"


def write_panel(df: DataFrame, folder: str, kind: str, start: date | str, end: date | str,
                fmt: str = "parquet", partition_by: Sequence[str] = ()) -> str:
    """Write a panel under its dated name; returns the path.  Never one file: every task writes its own."""
    path = f"{folder.rstrip('/')}/{panel_name(kind, start, end)}.{fmt}"
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(*partition_by)
    if fmt == "parquet":
        w.parquet(path)
    elif fmt == "csv":
        w.option("header", "true").option("dateFormat", "yyyy-MM-dd").csv(path)
    else:
        raise ValueError("fmt must be parquet or csv")
    return path


def write_json(df: DataFrame, path: str) -> None:
    """Metrics or parameters as JSON lines."""
    df.write.mode("overwrite").json(path)


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def save_fitted(spark: SparkSession, models: Mapping[int, object], spec: object, path: str) -> None:
    """Fitted forecasters (linear models or boosted trees, by window) with their column spec, as JSON lines."""
    def plain(v):
        return v.tolist() if hasattr(v, "tolist") else dict(vars(v)) if hasattr(v, "__dict__") else str(v)

    rows = [(int(i), type(m).__name__, json.dumps(m, default=plain), json.dumps(spec, default=plain)) for i, m in models.items()]
    spark.createDataFrame(rows, FITTED_SCHEMA).coalesce(1).write.mode("overwrite").json(path)


def load_fitted(spark: SparkSession, path: str) -> tuple[dict[int, object], object]:
    """What :func:`save_fitted` wrote: models by window, and the spec."""
    from demandgrid.operators.boosting import Tree, TweedieEnsemble
    from demandgrid.operators.regression import LagSpec, Linear
    models, spec = {}, None
    for r in spark.read.schema(FITTED_SCHEMA).json(path).collect():  # a row per window
        m, spec = json.loads(r["model"]), json.loads(r["spec"])
        if r["kind"] == "Linear":
            models[r["window"]] = Linear(**{k: np.array(v) if isinstance(v, list) else v for k, v in m.items()})
        else:
            trees = [Tree(**{k: np.array(v) for k, v in t.items()}) for t in m.pop("trees")]
            models[r["window"]] = TweedieEnsemble(**m, trees=trees)
    return models, LagSpec(**{k: tuple(v) if isinstance(v, list) else v for k, v in (spec or {}).items()})


FITTED_SCHEMA = "window int, kind string, model string, spec string"
LOG_SCHEMA = "name string, description string, logged_at timestamp, status string"


def log_experiments(entries: DataFrame, path: str, status: str = "completed") -> None:
    """Append experiments (name, description) to the log table with time and status."""
    entries.select("name", "description", F.current_timestamp().alias("logged_at"),
                   F.lit(status).alias("status")).write.mode("append").parquet(path)


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LOG_SCHEMA).parquet(path)


# ---------------------------------------------------------------- appends that can be repeated

COMMIT_SCHEMA = "n_rows bigint, committed_at timestamp, run string"


def append_run(df: DataFrame, path: str, run: str) -> None:
    """Append the rows of one run; the same run again replaces them.

    A run is a folder of its own, overwritten as a whole.  Its commit row is taken back first and written last, with
    the number of rows stored, so that a run that was killed in between isn't read and can simply be repeated."""
    if "run" in df.columns or not re.fullmatch(r"[A-Za-z0-9_.-]+", run):
        raise ValueError("a run is named by letters, digits, _, . and -, and no column")
    spark, base = df.sparkSession, path.rstrip("/")

    def put(rows: DataFrame, folder: str) -> None:
        rows.write.mode("overwrite").parquet(f"{base}/{folder}/run={run}")

    def commit(n: int | None) -> None:
        put(spark.range(1).select(F.lit(n).cast("long").alias("n_rows"), F.current_timestamp().alias("committed_at")), "commits")

    commit(None)
    put(df, "rows")
    commit(spark.read.schema(df.schema).parquet(f"{base}/rows/run={run}").count())


def read_runs(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of all committed runs, with ``run``; ``schema`` is that of the rows appended."""
    base = path.rstrip("/")
    rows = spark.read.schema(f"{schema}, run string").parquet(f"{base}/rows")
    commits = spark.read.schema(COMMIT_SCHEMA).parquet(f"{base}/commits")
    return rows.join(commits.where(F.col("n_rows").isNotNull()), "run", "left_semi").select(*[c for c in rows.columns if c != "run"], "run")
