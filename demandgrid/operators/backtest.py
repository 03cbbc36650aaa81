"""Rolling-origin and expanding windows, and the seasonal baselines.

Window membership is arithmetic on a row's position in its series, so no cutoff table is joined
and all windows of all series are built in one job behind one exchange on the series key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, q, series_window


@dataclass(frozen=True)
class Windows:
    """Validation windows.  Without ``initial`` they count back from the last row, newest first;
    with it the training part starts at ``initial`` rows and grows by ``step``."""

    h: int
    n_windows: int | None = 1
    step: int | None = None
    initial: int | None = None

    @property
    def stride(self) -> int:
        return self.step or self.h

    def cut_span(self, pos: Column, n: Column, tail: int) -> tuple[Column, Column]:
        """First and last window index whose tail or test part holds the row at ``pos`` (from 1)."""
        s = F.lit(self.stride)
        if self.initial is None:
            lo = F.ceil((n - self.h - pos - tail + 1) / s)
            hi = F.floor((n - pos) / s)
            last = F.lit(self.n_windows - 1)
        else:
            lo = F.ceil((pos - self.h - self.initial) / s)
            hi = F.floor((pos + tail - 1 - self.initial) / s)
            last = F.floor((n - self.h - self.initial) / s)
            if self.n_windows is not None:
                last = F.least(last, F.lit(self.n_windows - 1))
        return F.greatest(lo, F.lit(0)).cast("int"), F.least(hi, last).cast("int")

    def segment(self, pos: Column, n: Column) -> Column:
        """Training segment of a row, such that window i trains on the segments :meth:`trains_on` it.

        NULL for rows no window trains on.
        """
        if self.n_windows is None:
            raise ValueError("training windows need a number")
        last = F.lit(self.n_windows - 1)
        if self.initial is None:
            m = F.least(F.floor((n - self.h - pos) / F.lit(self.stride)), last)
            return F.when(m >= 0, m).cast("int")
        m = F.greatest(F.ceil((pos - self.initial) / F.lit(self.stride)), F.lit(0))
        return F.when(m <= last, m).cast("int")

    def trains_on(self, window: int, segment: int) -> bool:
        return segment >= window if self.initial is None else segment <= window

    def cut(self, n: Column, i: Column) -> Column:
        """Number of training rows of window i."""
        return n - self.h - i * self.stride if self.initial is None else i * self.stride + self.initial


def windowed(panel: DataFrame, windows: Windows, tail: int, extra: Sequence[str] = (), last: Sequence[str] = (),
             y: str = Y) -> DataFrame:
    """One row per (series, window): cutoff, the last ``tail`` training values, the test rows.

    Both arrays are bounded by ``tail`` and ``h``.  Windows without a full test part or any
    training row are left out.  ``extra`` columns ride along in the test rows, ``last`` columns keep
    their value at the cutoff.
    """
    w = series_window()
    pos, n = F.col("__pos"), F.col("__n")
    ranked = (panel.withColumn("__pos", F.row_number().over(w))
              .withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy(ID))))
    lo, hi = windows.cut_span(pos, n, tail)
    rows = (ranked.withColumn("__lo", lo).withColumn("__hi", hi).where(F.col("__lo") <= F.col("__hi"))
            .withColumn("window", F.explode(F.sequence("__lo", "__hi")))
            .withColumn("__cut", windows.cut(n, F.col("window")))
            .where(F.col("__cut") > 0))
    is_test = pos > F.col("__cut")
    cell = F.struct(pos.alias("pos"), F.col(DS), q(y).alias(Y), *[q(c) for c in extra])
    past = F.struct(pos.alias("pos"), q(y).cast("double").alias(Y))
    return (rows.groupBy(ID, "window")
            .agg(F.max(F.when(~is_test, F.col(DS))).alias("cutoff"), F.first("__cut").alias("n_train"),
                 *[F.max_by(F.when(~is_test, q(c)), F.when(~is_test, pos)).alias(f"last_{i}")
                   for i, c in enumerate(last)],
                 F.sort_array(F.collect_list(F.when(~is_test, past))).alias("__past"),
                 F.sort_array(F.collect_list(F.when(is_test, cell))).alias("test"))
            .where((F.size("test") == windows.h) & F.col("cutoff").isNotNull())
            .withColumn("tail", F.transform("__past", lambda s: s[Y])).drop("__past"))


def _season_value(season: int) -> Column:
    """Value one season back, from the last (up to) ``season`` training values."""
    at = F.size("tail") - season + F.col("step") % season
    return F.when(at >= 0, F.get("tail", at))


def baseline_backtest(panel: DataFrame, windows: Windows, season: int = 7) -> DataFrame:
    """Naive, SeasonalNaive and ZeroModel predictions for every window."""
    win = windowed(panel, windows, season)
    rows = (win.select(ID, "cutoff", "tail", F.posexplode("test").alias("step", "t")))
    return rows.select(
        ID, F.col(f"t.{DS}").alias(DS), "cutoff", F.col(f"t.{Y}").alias(Y),
        F.element_at("tail", -1).alias("Naive"), _season_value(season).alias("SeasonalNaive"),
        F.lit(0.0).alias("ZeroModel"))


def forecast_baselines(panel: DataFrame, h: int, season: int = 7, y: str = Y) -> DataFrame:
    """The three baselines for the h days after each series' end."""
    back = F.row_number().over(Window.partitionBy(ID).orderBy(F.desc(DS)))
    tail = (panel.withColumn("__b", back).where(F.col("__b") <= season).groupBy(ID)
            .agg(F.max(DS).alias("__last"),
                 F.sort_array(F.collect_list(F.struct(F.col(DS), q(y).cast("double").alias(Y)))).alias("__p")))
    rows = (tail.withColumn("tail", F.transform("__p", lambda s: s[Y]))
            .withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(h - 1)))))
    return rows.select(ID, F.date_add("__last", F.col("step") + 1).alias(DS),
                       F.element_at("tail", -1).alias("Naive"),
                       _season_value(season).alias("SeasonalNaive"), F.lit(0.0).alias("ZeroModel"))


def fitted_baselines(panel: DataFrame, season: int = 7, y: str = Y) -> DataFrame:
    """In-sample one-step predictions of the baselines."""
    w = series_window()
    v = q(y).cast("double")
    return panel.select(ID, DS, q(y).alias(Y), F.lag(v, 1).over(w).alias("Naive"),
                        F.lag(v, season).over(w).alias("SeasonalNaive"), F.lit(0.0).alias("ZeroModel"))
