"""Feature transformers: fit learns a small table of parameters, transform is a row expression."""

from __future__ import annotations

import logging
import math
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandgrid.functions.core import flag, numeric_columns, q, require, slug, stack
from demandgrid.functions.quantiles import exact_quantiles

log = logging.getLogger(__name__)
NO_EVENT = "No Event"


class FeatureStep:
    """fit -> transform protocol.  Subclasses fill ``_fit`` (may run one bounded job) and
    ``_transform`` (must stay a lazy row expression)."""

    needs: Sequence[str] = ()

    def __init__(self) -> None:
        self.fitted = False

    def fit(self, df: DataFrame) -> FeatureStep:
        if not isinstance(df, DataFrame):
            raise TypeError("fit expects a Spark DataFrame")
        require(df, self.needs, type(self).__name__)
        self._fit(df)
        self.fitted = True
        return self

    def transform(self, df: DataFrame) -> DataFrame:
        if not self.fitted:
            raise ValueError(f"{type(self).__name__} is not fitted; call fit first")
        require(df, self.needs, type(self).__name__)
        out = self._transform(df)
        if not out.columns:
            log.warning("%s produced no columns", type(self).__name__)
        return out

    def fit_transform(self, df: DataFrame) -> DataFrame:
        return self.fit(df).transform(df)

    def _fit(self, df: DataFrame) -> None:
        """Nothing to learn by default."""

    def _transform(self, df: DataFrame) -> DataFrame:
        raise NotImplementedError


# ---------------------------------------------------------------- Fourier terms

def _waves(col: str, period: float, order: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi * order / period) * q(col)
    return F.sin(angle), F.cos(angle)


def fourier(df: DataFrame, time_col: str = "day_of_year", period: float = 365.25, k: int = 1,
            prefix: str = "", drop_time_col: bool = False) -> DataFrame:
    """sin and cos of k harmonics of one period."""
    terms: dict[str, Column] = {}
    for i in range(1, k + 1):
        s, c = _waves(time_col, period, i)
        terms[f"{prefix}fourier_sin_{i}"], terms[f"{prefix}fourier_cos_{i}"] = s, c
    out = df.withColumns(terms)
    return out.drop(time_col) if drop_time_col else out


def multi_fourier(df: DataFrame, time_cols: str | Sequence[str], periods: Sequence[float],
                  orders: Sequence[int], drop_time_cols: bool = False) -> DataFrame:
    """Several periods over one or more time columns; with more than one, names carry the column."""
    if len(periods) != len(orders):
        raise ValueError("periods and orders must have the same length")
    cols = [time_cols] if isinstance(time_cols, str) else list(time_cols)
    terms: dict[str, Column] = {}
    for col in cols:
        if col not in df.columns:
            log.warning("time column %s is absent", col)
            continue
        pre = "" if len(cols) == 1 else f"{col}_"
        for i, (period, order) in enumerate(zip(periods, orders), start=1):
            for h in range(1, order + 1):
                s, c = _waves(col, period, h)
                terms[f"{pre}fourier_sin_p{i}_h{h}"], terms[f"{pre}fourier_cos_p{i}_h{h}"] = s, c
    out = df.withColumns(terms)
    return out.drop(*cols) if drop_time_cols else out


# ---------------------------------------------------------------- encoders

class OneHotBaseline(FeatureStep):
    """One column per level, the baseline level first; ``drop_first`` leaves the baseline out.

    A single level is kept even with ``drop_first``.  Unseen levels raise an error unless
    ``unseen='zero'``.  The driver learns one value per column it is going to make, however many.
    """

    def __init__(self, col: str, baseline: object, drop_first: bool = True, unseen: str = "error") -> None:
        super().__init__()
        self.col, self.baseline, self.drop_first = col, baseline, drop_first
        self.unseen, self.needs = unseen, [col]
        self.levels: list = []

    def learn(self, levels: Sequence[object]) -> None:
        values = sorted(levels)
        if values and type(self.baseline) is not type(values[0]):
            try:
                self.baseline = type(values[0])(self.baseline)
            except (TypeError, ValueError):
                pass
        if self.baseline in values:
            values.remove(self.baseline)
            values.insert(0, self.baseline)
        self.levels = values

    def _fit(self, df: DataFrame) -> None:
        self.learn([r[0] for r in df.select(q(self.col)).where(q(self.col).isNotNull()).distinct().collect()])

    @property
    def kept(self) -> list:
        return self.levels[1:] if self.drop_first and len(self.levels) > 1 else self.levels

    def names(self) -> list[str]:
        return [f"{self.col}_{v}" for v in self.kept]

    def columns(self) -> list[Column]:
        known = q(self.col).isin(self.levels)
        out = []
        for level, name in zip(self.kept, self.names()):
            c = F.when(q(self.col) == F.lit(level), 1.0).otherwise(0.0)
            if self.unseen == "error":
                c = F.when(known, c).otherwise(F.raise_error(F.concat(
                    F.lit(f"unknown level in {self.col}: "), F.coalesce(q(self.col).cast("string"), F.lit("NULL")))).cast("double"))
            out.append(c.alias(name))
        return out

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.select(*[q(c) for c in df.columns if c != self.col], *self.columns())

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        """Level names back from the indicator columns."""
        hit = [F.when(q(n) == 1, F.lit(v)) for n, v in zip(self.names(), self.kept)]
        rest = F.lit(self.levels[0]) if len(self.kept) < len(self.levels) else F.lit(None)
        return df.select(*[q(c) for c in df.columns if c not in self.names()],
                         F.coalesce(*hit, rest).alias(self.col))


class BaselineEncoder(FeatureStep):
    """Several :class:`OneHotBaseline` columns, fitted one after the other on the distinct levels of each."""

    def __init__(self, baselines: Mapping[str, object], drop_first: bool = True, unseen: str = "error") -> None:
        super().__init__()
        self.baselines, self.drop_first, self.unseen = dict(baselines), drop_first, unseen
        self.encoders: dict[str, OneHotBaseline] = {}

    def _fit(self, df: DataFrame) -> None:
        for c in self.baselines:
            if c in df.columns:
                self.encoders[c] = OneHotBaseline(c, self.baselines[c], self.drop_first, self.unseen)
                self.encoders[c].fit(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        made = [c for e in self.encoders.values() for c in e.columns()]
        return df.select(*[q(c) for c in df.columns if c not in self.encoders], *made)

    def inverse_transform(self, df: DataFrame) -> DataFrame:
        for enc in self.encoders.values():
            df = enc.inverse_transform(df)
        return df


# ---------------------------------------------------------------- scalers

class ThresholdScaler(FeatureStep):
    """Standard scaling of values above a threshold; the others stay as they are."""

    def __init__(self, cols: Sequence[str], threshold: float = 0.0, with_mean: bool = True,
                 with_std: bool = True) -> None:
        super().__init__()
        self.cols, self.threshold, self.needs = list(cols), threshold, list(cols)
        self.with_mean, self.with_std = with_mean, with_std
        self.params: dict[str, tuple[float, float]] = {}

    def _fit(self, df: DataFrame) -> None:
        above = {c: F.when(q(c) > self.threshold, q(c).cast("double")) for c in self.cols}
        row = df.agg(*[f(v) for v in above.values() for f in (F.avg, F.stddev_pop)]).first()
        for i, c in enumerate(self.cols):
            mean, std = row[2 * i], row[2 * i + 1]
            if mean is not None:
                self.params[c] = (mean if self.with_mean else 0.0, (std or 1.0) if self.with_std else 1.0)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            c: F.when(q(c) > self.threshold, (q(c) - m) / s).otherwise(q(c).cast("double"))
            for c, (m, s) in self.params.items()})


class Scaler(FeatureStep):
    """standard, robust (median and quartile range) or minmax scaling of numeric columns.

    Columns with variance up to ``min_variance`` are dropped first when it is positive.  Zero
    spread divides by one.
    """

    def __init__(self, cols: Sequence[str] | None = None, method: str = "standard", min_variance: float = 0.0,
                 keep: Sequence[str] = ("unique_id", "ds", "y")) -> None:
        super().__init__()
        if method not in ("standard", "robust", "minmax"):
            raise ValueError("method must be standard, robust or minmax")
        self.cols, self.method, self.min_variance, self.keep = cols, method, min_variance, list(keep)
        self.params: dict[str, tuple[float, float]] = {}
        self.dropped: list[str] = []

    def _fit(self, df: DataFrame) -> None:
        cols = list(self.cols or numeric_columns(df, self.keep))
        if self.min_variance > 0:
            high = high_variance(df, self.min_variance, cols)
            self.dropped, cols = [c for c in cols if c not in high], high
        if not cols:
            return
        v = {c: q(c).cast("double") for c in cols}
        if self.method == "robust":
            rows = exact_quantiles(stack(df, [], cols, "column", "v", "double"), "v", [0.25, 0.5, 0.75],
                                   ["column"]).collect()
            self.params = {r["column"]: (r["q"][1], (r["q"][2] - r["q"][0]) or 1.0) for r in rows}
            return
        pair = (F.avg, F.stddev_pop) if self.method == "standard" else (F.min, F.max)
        row = df.agg(*[f(x) for x in v.values() for f in pair]).first()
        for i, c in enumerate(cols):
            a, b = row[2 * i], row[2 * i + 1]
            if a is not None:
                self.params[c] = (a, (b if self.method == "standard" else b - a) or 1.0)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.drop(*self.dropped).withColumns({c: (q(c) - a) / s for c, (a, s) in self.params.items()})


def high_variance(df: DataFrame, threshold: float, cols: Sequence[str] | None = None) -> list[str]:
    """Numeric columns with sample variance above the threshold."""
    cols = list(cols or numeric_columns(df))
    row = df.agg(*[F.var_samp(q(c).cast("double")) for c in cols]).first()
    return [c for c, v in zip(cols, row) if v is not None and v > threshold]


def variance_filter(df: DataFrame, threshold: float, keep: Sequence[str] = ("unique_id", "ds", "y")) -> DataFrame:
    cols = numeric_columns(df, keep)
    high = set(high_variance(df, threshold, cols))
    return df.drop(*[c for c in cols if c not in high])


# ---------------------------------------------------------------- flags and clean-up

class EventFlags(FeatureStep):
    """``is_event`` and one ``event_<name>`` column per event seen at fit."""

    def __init__(self, col: str = "event") -> None:
        super().__init__()
        self.col, self.needs = col, [col]
        self.events: list[str] = []

    def _fit(self, df: DataFrame) -> None:
        rows = df.select(q(self.col)).where(q(self.col).isNotNull()).distinct().collect()
        self.events = sorted(r[0] for r in rows if r[0] != NO_EVENT)

    def _transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({
            "is_event": flag(q(self.col) != NO_EVENT),
            **{f"event_{slug(e)}": flag(q(self.col) == e) for e in self.events}})


def benefit_flags(df: DataFrame, snap: str = "snap", day: str = "day") -> DataFrame:
    """``is_snap`` and, when the day of month is known, its first three days."""
    require(df, [snap], "benefit flags")
    out = df.withColumn("is_snap", q(snap).cast("int"))
    if day in df.columns:
        out = out.withColumns({f"snap_day_{k}": flag((q(day) == k) & (q(snap) == 1)) for k in (1, 2, 3)})
    return out


def zero_small(df: DataFrame, cols: Sequence[str] | None = None, threshold: float = 0.1, negative: bool = True,
               close: bool = False, tolerance: float = 1e-8,
               keep: Sequence[str] = ("unique_id", "ds", "cutoff", "y")) -> DataFrame:
    """Predictions that are negative or at most the threshold become 0.

    ``close=True`` zeroes only negatives and values within ``tolerance`` of 0.
    """
    cols = list(cols or numeric_columns(df, keep))

    def rule(c: str) -> Column:
        v = q(c)
        small = F.abs(v) <= tolerance if close else (v >= 0) & (v <= threshold)
        return F.when(((v < 0) if negative else F.lit(False)) | small, F.lit(0.0)).otherwise(v.cast("double"))

    return df.withColumns({c: rule(c) for c in cols})


class ModelColumns(FeatureStep):
    """Column-wise preparation of a model frame: indicators, price scaled above zero, counters
    standard-scaled, every other column passed through.  Trees take ``scale=False``."""

    def __init__(self, baselines: Mapping[str, object] | None = None, price: str | None = "sell_price",
                 counters: Sequence[str] = ("periods since last sales", "periods since last 0 sales"),
                 scale: bool = True, unseen: str = "error") -> None:
        super().__init__()
        self.steps: list[FeatureStep] = [
            BaselineEncoder(baselines if baselines is not None else {"weekday": "Monday", "month": 1}, unseen=unseen)]
        if scale and price:
            self.steps.append(ThresholdScaler([price]))
        if scale and counters:
            self.steps.append(Scaler(list(counters)))

    def _fit(self, df: DataFrame) -> None:
        for step in self.steps:  # each step touches its own columns, so all fit on the input
            step.fit(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        for step in self.steps:
            df = step.transform(df)
        return df


class FeaturePlan(FeatureStep):
    """Fourier -> event and benefit flags -> encoding -> scaling, each optional, one lazy plan."""

    def __init__(self, fourier_terms: Callable[[DataFrame], DataFrame] | None = None, calendar: bool = False,
                 encoding: Mapping[str, object] | None = None, scaling: Scaler | None = None) -> None:
        super().__init__()
        self.steps: list[FeatureStep] = []
        self.fourier_terms, self.calendar = fourier_terms, calendar
        self.encoding = BaselineEncoder(encoding) if encoding else None
        self.events: EventFlags | None = None
        self.scaling = scaling

    def _base(self, df: DataFrame) -> DataFrame:
        if self.fourier_terms:
            df = self.fourier_terms(df)
        if self.events:
            df = self.events.transform(df)
        if self.calendar and "snap" in df.columns:
            df = benefit_flags(df)
        return df

    def _fit(self, df: DataFrame) -> None:
        if self.calendar and "event" in df.columns:
            self.events = EventFlags()
            self.events.fit(df)
        df = self._base(df)
        if self.encoding:
            df = self.encoding.fit(df).transform(df)
        if self.scaling:
            self.scaling.fit(df)

    def _transform(self, df: DataFrame) -> DataFrame:
        df = self._base(df)
        if self.encoding:
            df = self.encoding.transform(df)
        return self.scaling.transform(df) if self.scaling else df
