"""Lag-feature models over all series: training frame, ridge by sums of products, recursive forecasts.

Training never leaves Spark: each task reduces its rows to one small matrix of products per
training segment, the matrices add up, and every window of a backtest and every penalty of a search
is solved from the same sums.  One pass over the data therefore serves all windows and all trials.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, q, series_window
from demandgrid.functions.moments import _added
from demandgrid.operators import intervals
from demandgrid.operators.backtest import Windows, windowed

# Level order of the calendar indicators; the first is the baseline.
WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = tuple(range(1, 13))
SINCE_SALE, SINCE_ZERO = "since_sale_lag1", "since_zero_lag1"
PRICE_ON = "__price_on"


@dataclass(frozen=True)
class LagSpec:
    """Which columns a model sees.

    ``exog`` are numeric columns known ahead; ``price`` is one more, scaled over values above zero.
    Interval counters enter lagged by one row and are carried forward from the predictions.
    """

    lags: tuple[int, ...] = (1, 7, 14)
    rolling: tuple[int, ...] = (7, 28)
    stats: tuple[str, ...] = ("mean", "std")
    weekday: bool = True
    month: bool = True
    counters: bool = False
    price: str | None = None
    exog: tuple[str, ...] = ()

    @property
    def tail(self) -> int:
        return max([1, *self.lags, *self.rolling])

    @property
    def known(self) -> list[str]:
        return [*([self.price] if self.price else []), *self.exog]

    def features(self) -> list[str]:
        out = [f"lag{k}" for k in self.lags]
        out += [f"rolling_{s}_lag1_window_size{n}" for n in self.rolling for s in self.stats]
        if self.weekday:
            out += [f"weekday_{d}" for d in WEEKDAYS[1:]]
        if self.month:
            out += [f"month_{m}" for m in MONTHS[1:]]
        if self.counters:
            out += [SINCE_SALE, SINCE_ZERO]
        return out + self.known


def lag_frame(panel: DataFrame, spec: LagSpec, windows: Windows | None = None, y: str = Y) -> DataFrame:
    """Training frame: key, date, y, the spec's features, rows with a NULL feature dropped.

    With windows, ``segment`` tells which windows train on the row; unused rows are dropped.
    All columns come from one window specification over the series.
    """
    df = intervals.lags(panel, spec.lags, y=y) if spec.lags else panel
    if spec.rolling:
        df = intervals.rolling_stats(df, spec.rolling, 1, spec.stats, y=y)
    w = series_window()
    if spec.counters:
        df = intervals.periods_since_last_zero(intervals.periods_since_last_sale(df, y=y, name="__a"), y=y, name="__b")
        df = df.withColumns({SINCE_SALE: F.lag("__a").over(w), SINCE_ZERO: F.lag("__b").over(w)})
    made: dict[str, Column] = {}
    if spec.weekday:
        name = F.weekday(DS)
        made |= {f"weekday_{d}": F.when(name == i, 1.0).otherwise(0.0) for i, d in enumerate(WEEKDAYS) if i}
    if spec.month:
        made |= {f"month_{m}": F.when(F.month(DS) == m, 1.0).otherwise(0.0) for m in MONTHS[1:]}
    if windows:
        pos, n = F.row_number().over(w), F.count(F.lit(1)).over(Window.partitionBy(ID))
        made["segment"] = windows.segment(pos, n)
    df = df.withColumns(made) if made else df
    cols = [ID, DS, q(y).cast("double").alias(Y), *[q(c).cast("double").alias(c) for c in spec.features()]]
    out = df.select(*cols, *(["segment"] if windows else [])).dropna("any")
    return out


# ---------------------------------------------------------------- sums of products

@dataclass
class Products:
    """Z'Z per training segment for Z = [1, features, price-on flag, y]."""

    spec: LagSpec
    by_segment: dict[int, np.ndarray]
    columns: list[str] = field(default_factory=list)

    def up_to(self, windows: Windows, window: int) -> np.ndarray:
        parts = [g for s, g in self.by_segment.items() if windows.trains_on(window, s)]
        if not parts:
            raise ValueError(f"window {window} has no training rows")
        return np.sum(parts, axis=0)


def products(frame: DataFrame, spec: LagSpec) -> Products:
    """One pass over the training frame.  The driver receives segments x features^2 numbers."""
    feats = spec.features()
    at_price = feats.index(spec.price) if spec.price else None
    size = len(feats) + 3
    has_segment = "segment" in frame.columns

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        acc: dict[int, np.ndarray] = {}
        for pdf in batches:
            x = pdf[feats].to_numpy(dtype=float)
            on = (x[:, at_price] > 0).astype(float) if at_price is not None else np.zeros(len(x))
            z = np.column_stack([np.ones(len(x)), x, on, pdf[Y].to_numpy(dtype=float)])
            seg = pdf["segment"].to_numpy()
            for s in np.unique(seg):
                part = z[seg == s]
                acc[int(s)] = acc.get(int(s), np.zeros((size, size))) + part.T @ part
        if acc:
            yield pd.DataFrame({"segment": list(acc), "m": [g.ravel() for g in acc.values()]})

    src = frame if has_segment else frame.withColumn("segment", F.lit(0))
    parts = src.select("segment", Y, *[q(c) for c in feats]).mapInPandas(sums, "segment int, m array<double>")
    out: dict[int, np.ndarray] = {}
    for r in _added(parts, ["segment"]).collect():
        out.setdefault(r["segment"], np.zeros(size * size))[r["pos"]] = r["total"]
    return Products(spec, {s: g.reshape(size, size) for s, g in out.items()}, ["1", *feats, PRICE_ON, Y])


@dataclass
class Linear:
    """Coefficients on raw columns for prediction, on scaled columns for reporting."""

    intercept: float
    raw: np.ndarray            # one per feature
    price_on: float            # weight of the price-on flag
    scaled_intercept: float
    scaled: np.ndarray
    link: str = "identity"
    converged: bool = True

    def predict(self, x: np.ndarray, price_on: np.ndarray) -> np.ndarray:
        eta = self.intercept + x @ self.raw + self.price_on * price_on
        return np.exp(np.minimum(eta, 700.0)) if self.link == "log" else eta


def _scaling(gram: np.ndarray, spec: LagSpec) -> np.ndarray:
    """Matrix from raw columns [1, features, price-on] to model features (the column-wise preparation).

    Price: standard scaling over rows above zero.  Counters: standard scaling.  The rest passes.
    """
    feats = spec.features()
    p = len(feats)
    a = np.zeros((p, p + 2))
    n = gram[0, 0]
    for i, name in enumerate(feats):
        j = i + 1
        a[i, j] = 1.0
        if name == spec.price:
            on = gram[0, p + 1]
            if on > 0:
                mean = gram[0, j] / on
                std = np.sqrt(max(gram[j, j] / on - mean * mean, 0.0)) or 1.0
                a[i, j], a[i, p + 1] = 1 / std, -mean / std
        elif name in (SINCE_SALE, SINCE_ZERO):
            mean = gram[0, j] / n
            std = np.sqrt(max(gram[j, j] / n - mean * mean, 0.0)) or 1.0
            a[i, j], a[i, 0] = 1 / std, -mean / std
    return a


def solve_ridge(gram: np.ndarray, spec: LagSpec, alpha: float, scale: bool = True) -> Linear:
    """Ridge with a free intercept from sums of products."""
    p = len(spec.features())
    a = _scaling(gram, spec) if scale else np.column_stack([np.zeros(p), np.eye(p), np.zeros(p)])
    raw, xy, n = gram[:p + 2, :p + 2], gram[:p + 2, p + 2], gram[0, 0]
    mean_z, mean_y = a @ raw[:, 0] / n, xy[0] / n
    s = a @ raw @ a.T - n * np.outer(mean_z, mean_z)
    b = a @ xy - n * mean_z * mean_y
    coef = np.linalg.lstsq(s + alpha * np.eye(p), b, rcond=None)[0]
    icpt = mean_y - coef @ mean_z
    back = a.T @ coef
    return Linear(float(icpt + back[0]), back[1:p + 1], float(back[p + 1]), float(icpt), coef)


def fit_ridge_windows(prod: Products, windows: Windows, alpha: float) -> dict[int, Linear]:
    return {i: solve_ridge(prod.up_to(windows, i), prod.spec, alpha) for i in range(windows.n_windows)}


def fit_ridge(frame: DataFrame, spec: LagSpec, alpha: float = 1.0) -> PipelineModel:
    """The same model as a saved-and-loaded ML pipeline (no scaling).

    The library's penalty is relative to rows and to the target's spread, hence the conversion.
    """
    stat = frame.agg(F.count(F.lit(1)), F.stddev_pop(Y)).first()
    reg = alpha / stat[0] * (stat[1] or 1.0)
    lr = LinearRegression(featuresCol="features", labelCol=Y, regParam=reg, elasticNetParam=0.0,
                          standardization=False, solver="normal")
    return Pipeline(stages=[VectorAssembler(inputCols=spec.features(), outputCol="features"), lr]).fit(frame)


# ---------------------------------------------------------------- recursive forecasts

Predictor = Callable[[int, np.ndarray, np.ndarray], np.ndarray]
"""(window, feature rows, price-on flags) -> predictions."""


def _calendar_block(dates: np.ndarray, spec: LagSpec) -> np.ndarray:
    idx = pd.DatetimeIndex(dates)
    cols = []
    if spec.weekday:
        cols += [(idx.dayofweek == k).astype(float) for k in range(1, 7)]
    if spec.month:
        cols += [(idx.month == m).astype(float) for m in MONTHS[1:]]
    return np.column_stack(cols) if cols else np.empty((len(idx), 0))


def roll_forward(tail: np.ndarray, since: np.ndarray, cal: np.ndarray, known: np.ndarray, spec: LagSpec,
                 predict: Callable[[np.ndarray, np.ndarray], np.ndarray], zero_at: float = 0.0) -> np.ndarray:
    """h recursive steps for a batch of series at once.

    tail: (series, tail) last values; since: (series, 2) counters at the cutoff; cal: (series, h, c);
    known: (series, h, k).  Each prediction becomes the newest value of the next step.
    """
    b, t = tail.shape
    h = cal.shape[1]
    path = np.concatenate([tail, np.full((b, h), np.nan)], axis=1)
    since = since.astype(float).copy()
    stat = {"mean": lambda v: v.mean(axis=1), "std": lambda v: v.std(axis=1, ddof=1)}
    for s in range(h):
        now = t + s
        cols = [path[:, now - k] for k in spec.lags]
        cols += [stat[name](path[:, now - n:now]) for n in spec.rolling for name in spec.stats]
        blocks = [np.column_stack(cols) if cols else np.empty((b, 0)), cal[:, s]]
        if spec.counters:
            blocks.append(since)
        blocks.append(known[:, s])
        on = (known[:, s, 0] > 0).astype(float) if spec.price else np.zeros(b)
        path[:, now] = predict(np.column_stack(blocks), on)
        sold = path[:, now] > zero_at
        since = np.column_stack([np.where(sold, 0, since[:, 0] + 1), np.where(sold, since[:, 1] + 1, 0)])
    return path[:, t:]


def forecast_windows(panel: DataFrame, spec: LagSpec, windows: Windows) -> DataFrame:
    """Bounded inputs of the recursion: one row per (series, window)."""
    df, last = panel, []
    if spec.counters:
        df = intervals.periods_since_last_zero(intervals.periods_since_last_sale(df, name="__a"), name="__b")
        last = ["__a", "__b"]
    return windowed(df, windows, spec.tail, spec.known, last)


def _batch_inputs(pdf: pd.DataFrame, spec: LagSpec) -> tuple[np.ndarray, ...]:
    """Arrays of one Arrow batch: tail, counters, calendar, known columns, test dates, test y."""
    b, t = len(pdf), spec.tail
    h = len(pdf["test_ds"].iloc[0])
    tail = np.full((b, t), np.nan)
    for i, v in enumerate(pdf["tail"]):
        tail[i, t - len(v):] = v
    dates = np.array([np.asarray(v, dtype="datetime64[D]") for v in pdf["test_ds"]])
    cal = _calendar_block(dates.ravel(), spec).reshape(b, h, -1)
    k = len(spec.known)
    known = np.stack([np.vstack(pdf[f"known_{j}"]).astype(float) for j in range(k)], axis=2) if k else np.empty((b, h, 0))
    since = pdf[["last_0", "last_1"]].to_numpy(dtype=float) if spec.counters else np.zeros((b, 2))
    return tail, since, cal, known, dates, np.vstack(pdf["test_y"]).astype(float)


def _flat(win: DataFrame, spec: LagSpec) -> DataFrame:
    keep = [ID, "window", "cutoff", "tail", *(["last_0", "last_1"] if spec.counters else [])]
    def column(name: str) -> Column:
        return F.transform("test", lambda s: s[name].cast("double"))

    return win.select(*keep, F.transform("test", lambda s: s[DS]).alias("test_ds"), column(Y).alias("test_y"),
                      *[column(c).alias(f"known_{j}") for j, c in enumerate(spec.known)])


def recursive_backtest(panel: DataFrame, spec: LagSpec, windows: Windows, models: Mapping[str, Predictor]) -> DataFrame:
    """Predictions of each model over all windows: unique_id, ds, cutoff, y, one column per model."""
    return _rolled(_flat(forecast_windows(panel, spec, windows), spec), spec, models)


def _rolled(flat: DataFrame, spec: LagSpec, models: Mapping[str, Predictor]) -> DataFrame:
    """The recursion over prepared rows, Arrow batch by Arrow batch."""
    names = list(models)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if pdf.empty:
                continue
            tail, since, cal, known, dates, y = _batch_inputs(pdf, spec)
            wins = pdf["window"].to_numpy()
            b, h = y.shape
            out = {ID: np.repeat(pdf[ID].to_numpy(), h), DS: dates.ravel().astype("datetime64[ns]"),
                   "cutoff": np.repeat(pdf["cutoff"].to_numpy(), h), Y: y.ravel()}
            for name in names:
                hat = np.empty((b, h))
                for wi in np.unique(wins):
                    m = wins == wi
                    hat[m] = roll_forward(tail[m], since[m], cal[m], known[m], spec,
                                          lambda x, on, wi=wi, name=name: models[name](int(wi), x, on))
                out[name] = hat.ravel()
            frame = pd.DataFrame(out)
            frame[DS] = frame[DS].dt.date
            yield frame

    schema = f"{ID} string, {DS} date, cutoff date, {Y} double, " + ", ".join(f"`{n}` double" for n in names)
    out = flat.mapInPandas(run, schema)
    return out.withColumns({n: F.when(~F.isnan(q(n)), q(n)) for n in names})


def forecast(panel: DataFrame, spec: LagSpec, h: int, models: Mapping[str, Predictor],
             future: DataFrame | None = None) -> DataFrame:
    """The h days after each series' end: unique_id, ds, cutoff, one column per model.

    ``future`` holds the columns known ahead (``spec.known``) by date, or by series and date.  The recursion is the
    one of the backtests; models are asked for window 0.  A day whose known columns are missing, and what follows
    it, is NULL, as are series shorter than the features need.
    """
    if spec.known and future is None:
        raise ValueError(f"the model needs the future of {spec.known}")
    df, last = panel, []
    if spec.counters:
        df = intervals.periods_since_last_zero(intervals.periods_since_last_sale(df, name="__a"), name="__b")
        last = ["__a", "__b"]
    back = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc(DS)))
    ends = (df.withColumn("__back", back).where(F.col("__back") <= spec.tail).groupBy(ID)
            .agg(F.max(DS).alias("cutoff"), *[F.max_by(q(c), DS).alias(f"last_{i}") for i, c in enumerate(last)],
                 F.sort_array(F.collect_list(F.struct(F.col(DS), q(Y).cast("double").alias(Y)))).alias("__past")))
    ends = ends.select(ID, "cutoff", *[f"last_{i}" for i in range(len(last))],
                       F.transform("__past", lambda s: s[Y]).alias("tail"))
    days = ends.withColumn(DS, F.explode(F.sequence(F.date_add("cutoff", 1), F.date_add("cutoff", h))))
    if spec.known:
        keys = [c for c in (ID, DS) if c in future.columns]
        days = days.join(future.select(*keys, *[q(c).cast("double").alias(c) for c in spec.known]), keys, "left")
    cell = F.struct(F.col(DS), F.lit(None).cast("double").alias(Y), *[q(c) for c in spec.known])
    same = ["cutoff", "tail", *[f"last_{i}" for i in range(len(last))]]
    win = (days.groupBy(ID).agg(*[F.first(c).alias(c) for c in same], F.sort_array(F.collect_list(cell)).alias("test"))
           .withColumn("window", F.lit(0)))
    return _rolled(_flat(win, spec), spec, models).drop(Y)


def linear_predictor(models: Mapping[int, Linear]) -> Predictor:
    return lambda window, x, on: models[window].predict(x, on)


def ridge_backtest(panel: DataFrame, spec: LagSpec, windows: Windows, alpha: float = 1.0,
                   name: str = "Ridge") -> tuple[DataFrame, dict[int, Linear]]:
    """Pooled ridge: predictions of every window, and the fitted model per window."""
    models = fit_ridge_windows(products(lag_frame(panel, spec, windows), spec), windows, alpha)
    return recursive_backtest(panel, spec, windows, {name: linear_predictor(models)}), models


def ridge_forecast(panel: DataFrame, spec: LagSpec, h: int, alpha: float = 1.0, future: DataFrame | None = None,
                   name: str = "Ridge") -> tuple[DataFrame, Linear]:
    """Pooled ridge on the whole panel: the next h days, and the fitted model."""
    model = solve_ridge(products(lag_frame(panel, spec), spec).by_segment[0], spec, alpha)
    return forecast(panel, spec, h, {name: linear_predictor({0: model})}, future), model


def poisson_forecast(panel: DataFrame, spec: LagSpec, h: int, reg: float = 0.0, future: DataFrame | None = None,
                     name: str = "Poisson") -> tuple[DataFrame, Linear]:
    """Pooled Poisson regression on the whole panel: the next h days, and the fitted model."""
    frame = VectorAssembler(inputCols=spec.features(), outputCol="features").transform(lag_frame(panel, spec))
    model = _glm(frame.select(Y, "features"), reg)
    return forecast(panel, spec, h, {name: linear_predictor({0: model})}, future), model


def _glm(rows: DataFrame, reg: float) -> Linear:
    from pyspark.ml.regression import GeneralizedLinearRegression
    fit = GeneralizedLinearRegression(family="poisson", link="log", featuresCol="features", labelCol=Y,
                                      regParam=reg).fit(rows)
    coef = fit.coefficients.toArray()
    return Linear(fit.intercept, coef, 0.0, fit.intercept, coef, link="log")


def poisson_backtest(panel: DataFrame, spec: LagSpec, windows: Windows, reg: float = 0.0,
                     name: str = "Poisson") -> tuple[DataFrame, dict[int, Linear]]:
    """Pooled Poisson regression (log link) by the ML library, one fit per window."""
    frame = VectorAssembler(inputCols=spec.features(), outputCol="features").transform(
        lag_frame(panel, spec, windows)).select("segment", Y, "features").persist()
    models = {}
    try:
        for i in range(windows.n_windows):
            rows = frame.where(F.col("segment") >= i if windows.initial is None else F.col("segment") <= i)
            models[i] = _glm(rows, reg)
    finally:
        frame.unpersist()
    return recursive_backtest(panel, spec, windows, {name: linear_predictor(models)}), models


# ---------------------------------------------------------------- one model per series

STACKED = 1 << 23   # numbers of a stack of feature rows, which bounds the series fitted at once


def _stacked_design(y: np.ndarray, cal: np.ndarray, since: np.ndarray, known: np.ndarray, spec: LagSpec) -> np.ndarray:
    """Feature rows of many series, (series, days, features); NaN where history is short."""
    b, t = y.shape

    def back(v: np.ndarray, k: int) -> np.ndarray:
        out = np.full_like(v, np.nan)
        out[:, k:] = v[:, :t - k]
        return out

    cols = [back(y, k) for k in spec.lags]
    for n in spec.rolling:
        runs = np.lib.stride_tricks.sliding_window_view(y, n, axis=1) if t >= n else np.empty((b, 0, n))
        for stat in spec.stats:
            v = np.full((b, t), np.nan)
            with np.errstate(all="ignore"):
                v[:, n - 1:] = runs.mean(axis=2) if stat == "mean" else runs.std(axis=2, ddof=1)
            cols.append(back(v, 1))
    parts = [np.stack(cols, axis=2) if cols else np.empty((b, t, 0)), cal]
    if spec.counters:
        parts.append(np.stack([back(since[:, :, k], 1) for k in range(2)], axis=2))
    return np.concatenate([*parts, known], axis=2)


@dataclass
class _Scales:
    """Per series the preparation of the pooled form: price over values above zero, counters over all rows."""

    mean: np.ndarray    # (series, features)
    spread: np.ndarray
    only_on: np.ndarray     # features scaled only where above zero

    @classmethod
    def of(cls, x: np.ndarray, rows: np.ndarray, spec: LagSpec) -> _Scales:
        names = spec.features()
        mean, spread = np.zeros((len(x), len(names))), np.ones((len(x), len(names)))
        only_on = np.array([n == spec.price for n in names])
        for i, n in enumerate(names):
            if only_on[i] or n in (SINCE_SALE, SINCE_ZERO):
                v = np.where(rows, x[:, :, i], 0.0)
                use = rows & ((v > 0) | (not only_on[i]))
                count = np.maximum(use.sum(axis=1), 1)
                mean[:, i] = (v * use).sum(axis=1) / count
                std = np.sqrt((((v - mean[:, i, None]) ** 2) * use).sum(axis=1) / count)
                spread[:, i] = np.where(std > 0, std, 1.0)
        return cls(mean, spread, only_on)

    def apply(self, x: np.ndarray) -> np.ndarray:
        mean, spread = (v if x.ndim == 2 else v[:, None] for v in (self.mean, self.spread))
        return np.where(self.only_on & ~(x > 0), x, (x - mean) / spread)


def _stacked_fit(z: np.ndarray, y: np.ndarray, rows: np.ndarray, family: str, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients of every series from its own normal equations, and whether the fit converged."""
    z = np.where(rows[:, :, None], np.concatenate([np.ones((*z.shape[:2], 1)), z], axis=2), 0.0)
    y, p = np.where(rows, y, 0.0), z.shape[2]
    penalty = alpha * np.diag([0.0] + [1.0] * (p - 1))

    def solve(weight: np.ndarray, target: np.ndarray) -> np.ndarray:
        left = (z * weight[:, :, None]).transpose(0, 2, 1)
        gram = left @ z + penalty
        return (np.linalg.pinv(gram, rcond=p * np.finfo(float).eps, hermitian=True) @ (left @ target[:, :, None]))[:, :, 0]

    if family == "linear":
        return solve(rows.astype(float), y), np.ones(len(y), bool)
    mu = np.maximum(y, 0.1)
    eta, beta, done = np.log(mu), np.zeros((len(y), p)), np.zeros(len(y), bool)
    for _ in range(50):  # iteratively reweighted least squares, side by side
        new = solve(mu * rows, eta + (y - mu) / mu)
        now = np.abs(new - beta).max(axis=1) < 1e-9
        beta = np.where(done[:, None], beta, new)
        done |= now
        if done.all():
            break
        eta = np.clip((z @ beta[:, :, None])[:, :, 0], -30, 30)
        mu = np.exp(eta)
    return beta, done


def local_backtest(panel: DataFrame, spec: LagSpec, windows: Windows, family: str = "linear", alpha: float = 0.0,
                   name: str = "Local") -> DataFrame:
    """A separate linear or Poisson regression per series and window.

    A series is one row of arrays, bounded by its days; the series of an Arrow batch are fitted side by side as stacked
    matrices.  Price and counters are scaled as in the pooled form, by each series' own training rows.  Windows with
    a full test part but too little history for the features get NULL predictions, as in the pooled form; Poisson adds
    ``converged``.
    """
    h, tail = windows.h, spec.tail
    df = panel
    if spec.counters:
        df = intervals.periods_since_last_zero(intervals.periods_since_last_sale(df, name="__a"), name="__b")
    fields = {"y": q(Y), **{f"k{j}": q(c) for j, c in enumerate(spec.known)},
              **({"a": F.col("__a"), "b": F.col("__b")} if spec.counters else {})}
    cell = F.struct(F.col(DS).alias("ds"), *[v.cast("double").alias(c) for c, v in fields.items()])
    whole = df.groupBy(ID).agg(F.sort_array(F.collect_list(cell)).alias("__days"))

    def column(c: str) -> Column:
        return F.transform("__days", lambda d: d[c]).alias(c)

    flat = whole.select(ID, *map(column, ("ds", *fields)))

    def fitted(pdf: pd.DataFrame) -> Iterator[pd.DataFrame]:
        n = pdf["ds"].map(len).to_numpy()
        b, t = len(pdf), int(n.max())

        def padded(c: str, fill, kind) -> np.ndarray:
            out = np.full((b, t), fill, dtype=kind)
            for i, v in enumerate(pdf[c]):
                out[i, :len(v)] = np.asarray(v, dtype=kind)
            return out

        dates = padded("ds", np.datetime64("1970-01-01"), "datetime64[D]")
        y = padded("y", np.nan, float)
        cal = _calendar_block(dates.ravel(), spec).reshape(b, t, -1)
        known = np.stack([padded(f"k{j}", np.nan, float) for j in range(len(spec.known))], axis=2) if spec.known else np.empty((b, t, 0))
        since = np.stack([padded(c, np.nan, float) for c in "ab"], axis=2) if spec.counters else np.zeros((b, t, 2))
        x = _stacked_design(y, cal, since, known, spec)
        usable, place = np.isfinite(x).all(axis=2) & np.isfinite(y), np.arange(t)
        for i in range(windows.n_windows):
            cut = n - h - i * windows.stride if windows.initial is None else np.full(b, windows.initial + i * windows.stride)
            at = np.flatnonzero((cut >= 1) & (cut + h <= n))
            if not len(at):
                continue
            cut = cut[at]
            rows = usable[at] & (place < cut[:, None])
            hat, done = np.full((len(at), h), np.nan), np.zeros(len(at), bool)
            good = np.flatnonzero(rows.any(axis=1) & (cut >= tail))
            test = cut[:, None] + np.arange(h)
            if len(good):
                own, ends = at[good], cut[good]
                scales = _Scales.of(x[own], rows[good], spec)
                beta, done[good] = _stacked_fit(scales.apply(x[own]), y[own], rows[good], family, alpha)

                def predict(rows_: np.ndarray, on: np.ndarray) -> np.ndarray:
                    eta = beta[:, 0] + (scales.apply(rows_) * beta[:, 1:]).sum(axis=1)
                    return np.exp(np.minimum(eta, 700.0)) if family == "poisson" else eta

                side = own[:, None]
                hat[good] = roll_forward(y[side, ends[:, None] - tail + np.arange(tail)], since[own, ends - 1], cal[side, test[good]],
                                         known[side, test[good]], spec, predict)
            ids = pdf[ID].to_numpy()[at]
            yield pd.DataFrame({
                ID: np.repeat(ids, h), DS: dates[at[:, None], test].ravel().astype(object),
                "cutoff": np.repeat(dates[at, cut - 1].astype(object), h), Y: y[at[:, None], test].ravel(),
                name: hat.ravel(), "converged": np.repeat(done, h)})[cols]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            size = len(spec.features()) + max([1, *spec.rolling])
            longest = max(map(len, pdf["ds"]), default=1)
            step = max(1, STACKED // (size * max(longest, 1)))
            for a in range(0, len(pdf), step):
                yield from fitted(pdf.iloc[a:a + step])

    cols = [ID, DS, "cutoff", Y, name, *(["converged"] if family == "poisson" else [])]
    kinds = f"{ID} string, {DS} date, cutoff date, {Y} double, `{name}` double"
    found = flat.mapInPandas(run, kinds + (", converged boolean" if family == "poisson" else ""))
    return found.withColumn(name, F.when(~F.isnan(q(name)), q(name)))


def apply_per_series(panel: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str,
                     key: str = ID) -> DataFrame:
    """Extension point: any pandas function over one series at a time."""
    return panel.groupBy(key).applyInPandas(fn, schema)


# ---------------------------------------------------------------- importance

def ridge_importance(panel: DataFrame, spec: LagSpec, models: Mapping[int, Linear],
                     folds: Mapping[int, str]) -> DataFrame:
    """Intercept and scaled coefficients per fold: (feature, fold, value).  Features x folds rows."""
    names = ["intercept", *spec.features()]
    rows = [(n, folds[i], float(v)) for i, m in models.items()
            for n, v in zip(names, [m.scaled_intercept, *m.scaled])]
    return panel.sparkSession.createDataFrame(rows, "feature string, fold string, value double")


def importance_summary(by_fold: DataFrame) -> DataFrame:
    """Mean and spread over folds."""
    return by_fold.groupBy("feature").agg(F.avg("value").alias("importance"), F.stddev_samp("value").alias("spread"),
                                          F.count(F.lit(1)).alias("n_folds"))


def importance_table(by_fold: DataFrame, folds: Sequence[str]) -> DataFrame:
    """One column per fold."""
    return by_fold.groupBy("feature").pivot("fold", list(folds)).agg(F.first("value"))


def first_fold_importance(by_fold: DataFrame) -> DataFrame:
    first = by_fold.agg(F.min("fold").alias("f")).scalar()
    return by_fold.where(F.col("fold") == first).select("feature", F.col("value").alias("importance"))


def fold_names(panel: DataFrame, windows: Windows) -> dict[int, str]:
    """``start_end`` of each window's test part, from the panel's distinct dates (a few rows)."""
    dates = panel.select(DS).distinct()
    pos, n = F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(DS)), F.count(F.lit(1)).over(Window.partitionBy(F.lit(0)))
    cut = windows.cut(F.col("n"), F.col("i"))
    rows = (dates.withColumn("p", pos).withColumn("n", n)
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(windows.n_windows - 1))))
            .where((F.col("p") == cut + 1) | (F.col("p") == cut + windows.h))
            .groupBy("i").agg(F.min(DS).alias("a"), F.max(DS).alias("b")).collect())
    return {r["i"]: f"{r['a']}_{r['b']}" for r in rows}
