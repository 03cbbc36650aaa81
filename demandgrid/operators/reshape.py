"""Projection, filtering and reshaping of panels."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import date

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.core import DS, ID, Y, day, is_number, numeric_columns, q, require

# Columns a model frame drops, and the numeric columns it guarantees with the
# default for an absent column and for an unreadable cell.
UNUSED_COLUMNS = ("wm_yr_wk", "wday", "year", "event_name_1", "event_type_1", "event_name_2",
                  "event_type_2")
SINCE_SALE, SINCE_ZERO = "periods since last sales", "periods since last 0 sales"
MODEL_DEFAULTS: dict[str, tuple[float, float]] = {
    "sell_price": (1.0, 0.0), SINCE_SALE: (0, 0), SINCE_ZERO: (0, 0), "is_item_exists": (0, 0)}


def where_equal(df: DataFrame, **values: object) -> DataFrame:
    """Equality filter per column; reaches the scan."""
    for col, v in values.items():
        df = df.where(q(col) == F.lit(v))
    return df


def where_prefix(df: DataFrame, col: str, prefix: str) -> DataFrame:
    return df.where(q(col).startswith(prefix))


def where_member(df: DataFrame, col: str, values: Sequence[object] | DataFrame) -> DataFrame:
    """Membership in a short list, or in another table by semi join."""
    if isinstance(values, DataFrame):
        return df.join(values.select(col), col, "left_semi")
    return df.where(q(col).isin(list(values)))


def day_columns(df: DataFrame, prefix: str = "d_") -> list[str]:
    return [c for c in df.columns if c.startswith(prefix)]


def wide_to_long(df: DataFrame, ids: Sequence[str], prefix: str = "d_", code: str = "d",
                 y: str = Y) -> DataFrame:
    """Day columns to rows; other text columns are dropped.

    One array per row instead of one projection per day column, so a table of 2,000 day columns
    needs a single pass and a short plan.
    """
    return explode_days(*day_arrays(df, ids, prefix), code, y)


def day_arrays(df: DataFrame, ids: Sequence[str], prefix: str = "d_") -> tuple[DataFrame, list[str]]:
    """One row per series with its day columns as the array ``days``, and the day codes in order."""
    require(df, ids, "wide table")
    codes = day_columns(df, prefix)
    days, text = set(codes), {f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)}
    keep = [c for c in df.columns if c in ids or (c not in days and c not in text)]
    # one parsed expression: thousands of separate column objects would cost seconds to build
    listed = F.expr("array(" + ",".join(f"`{c}`" for c in codes) + ")")
    return df.select(*[q(c) for c in keep], listed.alias("days")), codes


def explode_days(arrays: DataFrame, codes: Sequence[str], code: str = "d", y: str = Y) -> DataFrame:
    rest = [q(c) for c in arrays.columns if c != "days"]
    names = F.split(F.lit(",".join(codes)), ",")
    rows = arrays.select(*rest, F.posexplode("days").alias("__i", y))
    return rows.select(*rest, F.element_at(names, F.col("__i") + 1).alias(code), y)


def where_mean_between(arrays: DataFrame, lb: float, ub: float) -> DataFrame:
    """Series (day arrays) whose mean lies in [lb, ub]: a row filter, no shuffle."""
    known = F.filter("days", lambda v: v.isNotNull())
    total = F.aggregate(known, F.lit(0.0), lambda a, v: a + v.cast("double"))
    return arrays.where(F.try_divide(total, F.size(known)).between(lb, ub))


def where_quantile_positive(arrays: DataFrame, codes: Sequence[str], first: str, last: str, p: float) -> DataFrame:
    """Series whose interpolated p-quantile between two day codes is above zero: a row filter."""
    at, to = codes.index(first), codes.index(last)
    part = F.sort_array(F.filter(F.slice("days", at + 1, to - at + 1), lambda v: v.isNotNull()))
    pos = F.lit(p) * (F.size(part) - 1)
    lo = F.get(part, F.floor(pos).cast("int")).cast("double")
    up = F.get(part, F.ceil(pos).cast("int")).cast("double")
    frac = pos - F.floor(pos)
    return arrays.where(lo * (1 - frac) + up * frac > 0)


def make_id(df: DataFrame, cols: Sequence[str], sep: str = "__", drop: bool = False,
            name: str = ID) -> DataFrame:
    """Joined key as first column; NULL when any part is NULL."""
    parts: list = []
    for c in cols:
        parts += [F.lit(sep), q(c)]
    rest = [q(c) for c in df.columns if not (drop and c in cols)]
    return df.select(F.concat(*parts[1:]).alias(name), *rest)


def split_id(df: DataFrame, positions: Mapping[str, int], sep: str = "__", name: str = ID) -> DataFrame:
    """Key parts back as columns at their recorded positions (in the order of the mapping)."""
    parts = F.split(q(name), sep)
    order: list = [q(c) for c in df.columns if c != name]
    for i, (col, at) in enumerate(positions.items()):
        order.insert(at, F.get(parts, i).alias(col))
    return df.select(*order)


def id_positions(df: DataFrame, cols: Sequence[str]) -> dict[str, int]:
    return {c: df.columns.index(c) for c in cols}


def series_to_columns(panel: DataFrame, names: Sequence[str], key: str = ID, y: str = Y) -> DataFrame:
    """One row per date, one column per listed series (mean of y)."""
    return (panel.where(q(key).isin(list(names))).groupBy(DS)
            .pivot(key, list(names)).agg(F.avg(y)))


def select_series(panel: DataFrame, names: Sequence[str], key: str = ID, y: str = Y) -> DataFrame:
    """Chosen series for comparison, zero days marked."""
    return panel.where(q(key).isin(list(names))).withColumn("is_zero", F.col(y) == 0)


def binary_columns(df: DataFrame, skip: Sequence[str] = (ID, DS, Y, "is_item_exists")) -> list[str]:
    """Columns whose non-null values are all 0/1 (or boolean): one aggregate row to the driver."""
    cand = [f for f in df.schema.fields if f.name not in skip
            and (is_number(f.dataType) or isinstance(f.dataType, T.BooleanType))]
    odd = df.agg(*[F.max((~q(f.name).cast("double").isin(0.0, 1.0)).cast("int")).alias(f"c{i}")
                   for i, f in enumerate(cand)]).first() if cand else []
    return [f.name for f, hit in zip(cand, odd) if not hit]


def split_at(df: DataFrame, when: date | str, col: str = DS) -> tuple[DataFrame, DataFrame]:
    """Rows before a date, and rows from it on."""
    return df.where(q(col) < day(when)), df.where(q(col) >= day(when))


def split_last(panel: DataFrame, n: int, key: str = ID) -> tuple[DataFrame, DataFrame]:
    """Each series' last n rows as test, the rest as train."""
    back = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(DS)))
    ranked = panel.withColumn("__back", back)
    return (ranked.where(F.col("__back") > n).drop("__back"),
            ranked.where(F.col("__back") <= n).drop("__back"))


def sample_ids(panel: DataFrame, n: int, seed: int = 42, key: str = ID) -> DataFrame:
    """A repeatable random sample of n series: order by a seeded digest, take the first n."""
    digest = F.md5(F.concat(q(key), F.lit(f":{seed}")))
    return panel.select(key).distinct().orderBy(digest, key).limit(n)


def sample_rows(df: DataFrame, n: int, cols: Sequence[str], seed: int = 42) -> DataFrame:
    """At most n rows, chosen by a seeded digest of the given columns."""
    text = F.concat_ws("|", *[q(c).cast("string") for c in cols])
    digest = F.md5(F.concat(text, F.lit(f":{seed}")))
    return df.orderBy(digest, *cols).limit(n)


def mean_band_ids(panel: DataFrame, lo: float, hi: float, n: int, seed: int = 42) -> DataFrame:
    """n random series whose mean demand lies in [lo, hi]."""
    means = panel.groupBy(ID).agg(F.avg(Y).alias("m")).where(F.col("m").between(lo, hi))
    return sample_ids(means, n, seed)


def prepare_model_frame(features: DataFrame, targets: DataFrame, snap_cols: Sequence[str] = ("snap_CA",)
                        ) -> DataFrame:
    """Features joined to targets, unused columns dropped, expected ones added and made numeric."""
    require(features, [ID, DS], "features")
    require(targets, [ID, DS, Y], "targets")
    both = features.withColumn(DS, F.to_date(DS)).join(targets.withColumn(DS, F.to_date(DS)), [ID, DS])
    df = both.drop(*UNUSED_COLUMNS)
    if "weekday" not in df.columns:
        df = df.withColumn("weekday", F.date_format(DS, "EEEE"))
    if "month" not in df.columns:
        df = df.withColumn("month", F.month(DS))
    defaults = {**MODEL_DEFAULTS, **{c: (0, 0) for c in snap_cols}}
    cells = {}
    for col, (absent, unreadable) in defaults.items():
        cells[col] = (F.coalesce(q(col).try_cast("double"), F.lit(float(unreadable)))
                      if col in df.columns else F.lit(float(absent)))
    return df.withColumns(cells).where(F.col(Y).isNotNull())


def cv_frame(df: DataFrame, text: Sequence[str] = ("weekday", "month")) -> DataFrame:
    """Key, date, y, weekday and month as text, and the numeric columns; rows with NULL dropped."""
    nums = numeric_columns(df, skip=[ID, DS, Y, *text])
    return df.select(ID, DS, Y, *[q(c).cast("string").alias(c) for c in text if c in df.columns],
                     *[q(c) for c in nums]).dropna("any")


def sorted_panel(panel: DataFrame, key: str = ID) -> DataFrame:
    """Series together and in date order, without a global sort."""
    return panel.repartition(q(key)).sortWithinPartitions(key, DS)
