"""Calendar operators: event indicators, benefit flags, derived date parts."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, day, q, require

NO_EVENT = "No Event"


def between_dates(df: DataFrame, start: date | str | None = None, end: date | str | None = None,
                  col: str = DS) -> DataFrame:
    """Inclusive date range, either end optional."""
    if start is not None:
        df = df.where(q(col) >= day(start))
    if end is not None:
        df = df.where(q(col) <= day(end))
    return df


def clean_calendar(cal: DataFrame, start: date | str | None = None, end: date | str | None = None,
                   drop: Sequence[str] = (), col: str = "date") -> DataFrame:
    return between_dates(cal.drop(*drop), start, end, col)


def lag_padded_start(start: date | str, max_lag: int) -> Column:
    """Earliest day to keep so that every lag is defined at ``start``."""
    return F.date_sub(day(start), max_lag)


def state_of(store_id: str) -> str:
    return store_id.split("_")[0]


def keep_state_flag(cal: DataFrame, state: str) -> DataFrame:
    """Drop the benefit flags of every other state."""
    return cal.drop(*[c for c in cal.columns if c.startswith("snap_") and not c.endswith(state)])


def benefit_flags_long(cal: DataFrame, date_col: str = "date") -> DataFrame:
    """snap_XX columns to one row per (date, state)."""
    flags = [c for c in cal.columns if c.startswith("snap_")]
    long = cal.select(date_col, *flags).unpivot([date_col], flags, "state_id", "snap")
    return long.withColumn("state_id", F.regexp_replace("state_id", "^snap_", ""))


def event_names(cal: DataFrame, event_cols: Sequence[str], baseline: str = NO_EVENT) -> list[str]:
    """Distinct event names of a calendar in sorted order (baseline included when some day has none)."""
    listed = F.array_compact(F.array(*[q(c) for c in event_cols]))
    named = cal.select(F.explode(F.when(F.size(listed) == 0, F.array(F.lit(baseline))).otherwise(listed)).alias("e"))
    return sorted(r.e for r in named.distinct().collect())


def event_indicators(cal: DataFrame, event_cols: Sequence[str], events: Sequence[str] | None = None,
                     baseline: str = NO_EVENT, drop_baseline: bool = False,
                     drop_event_cols: bool = False) -> DataFrame:
    """One count column per event.  Row-local: no explode, pivot or join back is needed."""
    require(cal, event_cols, "calendar")
    names = list(events) if events is not None else event_names(cal, event_cols, baseline)
    if drop_baseline:
        names = [n for n in names if n != baseline]
    listed = F.array_compact(F.array(*[q(c) for c in event_cols]))
    listed = F.when(F.size(listed) == 0, F.array(F.lit(baseline))).otherwise(listed)

    def hits(name: str) -> Column:
        return F.size(F.filter(listed, lambda e: e == F.lit(name))).alias(name)

    kept = [c for c in cal.columns if not (drop_event_cols and c in event_cols)]
    return cal.select(*[q(c) for c in kept], *[hits(n) for n in names])


def event_indicators_inverse(df: DataFrame, events: Sequence[str], event_cols: Sequence[str],
                             baseline: str = NO_EVENT) -> DataFrame:
    """Names of the active indicator columns back in ``event_cols``, padded with the baseline."""
    active = F.array_compact(F.array(*[F.when(q(e) == 1, F.lit(e)) for e in events]))
    rest = [q(c) for c in df.columns if c not in events and c not in event_cols]
    back = [F.coalesce(F.get(active, i), F.lit(baseline)).alias(c) for i, c in enumerate(event_cols)]
    return df.select(*rest, *back)


def date_parts(df: DataFrame, col: str = DS, event_col: str | None = None) -> DataFrame:
    """Day of year, ISO week, weekday name, month, year; event name and flag when asked."""
    out = df.withColumns({
        "day_of_year": F.dayofyear(q(col)), "week_of_year": F.weekofyear(q(col)),
        "weekday": F.date_format(q(col), "EEEE"), "month": F.month(q(col)), "year": F.year(q(col))})
    if event_col:
        name = F.coalesce(q(event_col), F.lit(NO_EVENT))
        out = out.withColumns({"event_name": name, "event": F.when(name != NO_EVENT, 1).otherwise(0)})
    return out


def code_to_date(long: DataFrame, cal: DataFrame, code: str = "d", date_col: str = "date") -> DataFrame:
    """Replace day codes by dates.  The calendar side is one small row per day; its statistics
    let Spark choose a broadcast join."""
    return long.join(cal.select(q(code), q(date_col)), code).drop(code)
