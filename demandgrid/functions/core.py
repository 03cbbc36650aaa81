"""Column-level building blocks shared by all operators."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID, DS, Y = "unique_id", "ds", "y"


def series_window(keys: str | Sequence[str] = ID, order: str = DS) -> WindowSpec:
    """Rows of one series in date order.

    A panel holds one row per series and day (see :func:`to_panel`), so a window partition is
    bounded by the number of calendar days, however many raw rows the series had.
    """
    return Window.partitionBy(*_as_list(keys)).orderBy(order)


def running(spec: WindowSpec) -> WindowSpec:
    return spec.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def _as_list(x: str | Sequence[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def ratio(num: Column, den: Column) -> Column:
    """num / den, NULL for a zero denominator (ANSI mode would raise)."""
    return F.try_divide(num.cast("double"), den.cast("double"))


def flag(cond: Column) -> Column:
    """0/1 int; a NULL condition counts as 0."""
    return F.when(cond, F.lit(1)).otherwise(F.lit(0))


def count_if(cond: Column) -> Column:
    return F.coalesce(F.sum(F.when(cond, F.lit(1).cast("bigint")).otherwise(F.lit(0))), F.lit(0))


def avg_if(cond: Column, value: Column) -> Column:
    return F.avg(F.when(cond, value))


def percent(cond: Column) -> Column:
    """Share of rows meeting the condition, in percent of all rows."""
    return F.avg(F.when(cond, F.lit(100.0)).otherwise(F.lit(0.0)))


def correlation(x: Column, y: Column) -> Column:
    """Pearson correlation over rows with both values (NaN counts as missing); NULL when one side is constant.

    The moments are updated and merged around running means, so large values with a small spread do not
    cancel; rounding cannot push the result out of [-1, 1].  (The built-in ``corr`` raises a division error
    for constant input in ANSI mode.)
    """
    x, y = (F.nanvl(v.cast("double"), F.lit(None).cast("double")) for v in (x, y))
    both = x.isNotNull() & y.isNotNull()
    x, y = F.when(both, x), F.when(both, y)
    r = F.try_divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y))
    return F.when(r.isNotNull(), F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r)))


def period_end(freq: str, col: str | Column = DS) -> Column:
    """Closing date of the day (D), Sunday-ending week (W) or calendar month (M)."""
    c = F.col(col) if isinstance(col, str) else col
    if freq == "D":
        return c
    if freq == "W":
        return F.next_day(F.date_sub(c, 1), "Sun")
    if freq == "M":
        return F.last_day(c)
    raise ValueError(f"freq must be D, W or M, got {freq!r}")


def slug(name: str) -> str:
    """Column-name form of a category: lower case, blanks to underscores."""
    return name.lower().replace(" ", "_")


def require(df: DataFrame, cols: Iterable[str], what: str = "input") -> None:
    missing = [c for c in cols if c not in df.columns]
    if missing:
        raise ValueError(f"{what} lacks columns {missing}; it has {df.columns}")


def is_number(dt: T.DataType) -> bool:
    return isinstance(dt, T.NumericType)


def numeric_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema.fields if is_number(f.dataType) and f.name not in skip]


def text_columns(df: DataFrame, skip: Iterable[str] = ()) -> list[str]:
    skip = set(skip)
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.StringType) and f.name not in skip]


def q(name: str) -> Column:
    """Column by its literal name (names may hold dots or blanks)."""
    return F.col("`" + name.replace("`", "``") + "`")


def day(value: date | str | Column) -> Column:
    return value if isinstance(value, Column) else F.to_date(F.lit(str(value)))


def stack(df: DataFrame, keep: Sequence[str], cols: Sequence[str], name: str, value: str,
          cast: str | None = None) -> DataFrame:
    """Long form of ``cols``: one row per kept row and column, NULL values kept."""
    picked = [*[q(c) for c in keep], *[q(c).cast(cast).alias(c) if cast else q(c) for c in cols]]
    return df.select(*picked).unpivot([q(c) for c in keep], [q(c) for c in cols], name, value)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    """Presentation rounding of every floating-point column (operators never round)."""
    return df.select(*[
        F.round(q(f.name), digits).alias(f.name)
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else q(f.name)
        for f in df.schema.fields])
