"""Forecast metrics.  One pass sums what every metric needs; coarser groups add up those sums."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from demandgrid.functions.core import DS, ID, Y, q, ratio
from demandgrid.operators.intervals import naive_errors

KEYS = (ID, DS, "cutoff", Y)
SEASONAL, ZERO = "SeasonalNaive", "ZeroModel"
METRICS = ("mae", "rmse", "mase", "rmsse", "mrae", "f1_zero", "non_zero_mae")
_SUMS = ("n", "ae", "se", "base_n", "base_ae", "base_se", "zero_n", "zero_ae", "tp", "fp", "fn", "nz_n",
         "nz_ae", "ape_n", "ape", "y_sum")


def model_columns(pred: DataFrame, skip: Sequence[str] = ()) -> list[str]:
    return [c for c in pred.columns if c not in (*KEYS, *skip)]


def error_sums(pred: DataFrame, models: Sequence[str], by: Sequence[str] = (), seasonal: str | None = SEASONAL,
               zero: str | None = ZERO, y: str = Y, non_zero: str = "both") -> DataFrame:
    """Per group and model, the sums behind the metrics.

    All models are summed side by side in one aggregate and turned into rows afterwards, so the
    predictions are not multiplied by the number of models.  ``non_zero='both'`` wants y and the
    prediction above zero, ``'actual'`` only y.
    """
    a = q(y).cast("double")

    def sums(m: str) -> Column:
        p = q(m).cast("double")
        ok = a.isNotNull() & p.isNotNull()
        err = F.abs(a - p)

        def total(cond: Column, v: Column) -> Column:
            return F.coalesce(F.sum(F.when(cond, v)), F.lit(0.0))

        def n(cond: Column) -> Column:
            return F.sum(F.when(cond, F.lit(1).cast("bigint")).otherwise(F.lit(0)))

        def against(base: str | None) -> tuple[Column, Column, Column]:
            if base is None or base not in pred.columns:
                return F.lit(0).cast("bigint"), F.lit(0.0), F.lit(0.0)
            b = q(base).cast("double")
            both = ok & b.isNotNull()
            return n(both), total(both, F.abs(a - b)), total(both, (a - b) * (a - b))

        bn, bae, bse = against(seasonal)
        zn, zae, _ = against(zero)
        nz = ok & (a > 0) & (p > 0) if non_zero == "both" else ok & (a > 0)
        parts = [n(ok), total(ok, err), total(ok, err * err), bn, bae, bse, zn, zae,
                 n(ok & (a == 0) & (p == 0)), n(ok & (a != 0) & (p == 0)), n(ok & (a == 0) & (p != 0)),
                 n(nz), total(nz, err), n(ok & (a != 0)), total(ok & (a != 0), err / F.nullif(F.abs(a), F.lit(0.0))),
                 total(ok, a)]
        return F.struct(F.lit(m).alias("model"), *[c.alias(s) for s, c in zip(_SUMS, parts)])

    wide = pred.groupBy(*by).agg(*[sums(m).alias(f"m{i}") for i, m in enumerate(models)])
    cells = F.array(*[F.col(f"m{i}") for i in range(len(models))])
    return wide.select(*by, F.explode(cells).alias("s")).select(*by, "s.*")


def metrics_of(sums: DataFrame, by: Sequence[str] = (), mrae_fallback: bool = False, mape: bool = False) -> DataFrame:
    """Metric columns from error sums.  Undefined ratios are NULL; f1_zero is then 0.

    ``mrae_fallback`` gives the plain MAE when the zero model makes no error.
    """
    mae, rmse = ratio(F.col("ae"), F.col("n")), F.sqrt(ratio(F.col("se"), F.col("n")))
    base_mae = ratio(F.col("base_ae"), F.col("base_n"))
    base_rmse = F.sqrt(ratio(F.col("base_se"), F.col("base_n")))
    zero_mae = ratio(F.col("zero_ae"), F.col("zero_n"))
    mrae = ratio(mae, zero_mae)
    if mrae_fallback:
        mrae = F.coalesce(mrae, mae)
    f1 = F.coalesce(ratio(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")), F.lit(0.0))
    cols = {"mae": mae, "rmse": rmse, "mase": ratio(mae, base_mae), "rmsse": ratio(rmse, base_rmse),
            "mrae": mrae, "f1_zero": f1, "non_zero_mae": ratio(F.col("nz_ae"), F.col("nz_n"))}
    if mape:
        cols["mape"] = ratio(F.col("ape"), F.col("ape_n"))
    return sums.select(*by, "model", *[v.alias(k) for k, v in cols.items()])


def evaluate(pred: DataFrame, models: Sequence[str] | None = None, by: Sequence[str] = (), **options) -> DataFrame:
    """All metrics of all models per group (no group: over everything)."""
    mrae_fallback, mape = options.pop("mrae_fallback", False), options.pop("mape", False)
    models = list(models or model_columns(pred, (SEASONAL, ZERO)))
    return metrics_of(error_sums(pred, models, by, **options), by, mrae_fallback, mape)


def evaluate_grid(pred: DataFrame, models: Sequence[str] | None = None, **options) -> DataFrame:
    """Overall, by series, by cutoff and by both, from one pass over the predictions.

    Sums per (series, cutoff) are far fewer than the predictions; grouping sets run on those.
    """
    models = list(models or model_columns(pred, (SEASONAL, ZERO)))
    fine = error_sums(pred, models, [ID, "cutoff"], **options)
    m, i, c = F.col("model"), F.col(ID), F.col("cutoff")
    sets = fine.groupingSets([[m], [m, i], [m, c], [m, i, c]], m, i, c)
    coarse = sets.agg(*[F.sum(s).alias(s) for s in _SUMS], F.grouping(i).alias("gi"), F.grouping(c).alias("gc"))
    grain = (F.when((F.col("gi") == 1) & (F.col("gc") == 1), "all").when(F.col("gi") == 1, "cutoff")
             .when(F.col("gc") == 1, "series").otherwise("series_cutoff"))
    return metrics_of(coarse.withColumn("grain", grain), ["grain", ID, "cutoff"])


def metrics_long(metrics: DataFrame, by: Sequence[str] = (), names: Sequence[str] = METRICS) -> DataFrame:
    return metrics.unpivot([*by, "model"], list(names), "metric", "value")


def metrics_wide(metrics: DataFrame, models: Sequence[str], by: Sequence[str] = (),
                 names: Sequence[str] = METRICS) -> DataFrame:
    """One column per {model}_{metric}."""
    aggs = [F.max(F.when(F.col("model") == m, q(n))).alias(f"{m}_{n}") for m in models for n in names]
    return metrics.groupBy(*by).agg(*aggs)


def comparison_table(metrics: DataFrame, names: Sequence[str] = METRICS) -> DataFrame:
    """Model rows, metric columns (means when several groups exist)."""
    return metrics.groupBy("model").agg(*[F.avg(q(n)).alias(n) for n in names])


def best_metrics(metrics: DataFrame) -> DataFrame:
    """Lowest mean MAE, RMSE and MASE over models, and the model of the lowest MAE."""
    t = comparison_table(metrics, ["mae", "rmse", "mase"])
    return t.agg(F.min("mae").alias("best_mae"), F.min("rmse").alias("best_rmse"),
                 F.min("mase").alias("best_mase"), F.min_by("model", "mae").alias("best_model"))


def against_baselines(metrics: DataFrame, baselines: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """MAE and RMSE of each model divided by each baseline's; the plain value for a perfect baseline."""
    grp = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))  # rows: models per group
    out = metrics
    for b in baselines:
        for name in ("mae", "rmse"):
            base = F.max(F.when(F.col("model") == b, q(name))).over(grp)
            out = out.withColumn(f"{name}_vs_{b}", F.when(base > 0, ratio(q(name), base)).otherwise(q(name)))
    return out.select(*by, "model", "mae", "rmse", *[f"{n}_vs_{b}" for b in baselines for n in ("mae", "rmse")])


def in_sample_scaled(pred: DataFrame, fitted: DataFrame, models: Sequence[str], by: Sequence[str] = ("cutoff",),
                     seasonal: str = SEASONAL) -> DataFrame:
    """MASE and RMSSE scaled by the in-sample seasonal errors of all series up to the group's last cutoff.

    Fitted errors collapse to one row per date and are added up once per distinct cutoff, of
    which there are as many as validation windows.
    """
    err = F.col(Y).cast("double") - q(seasonal)
    daily = (fitted.where(q(seasonal).isNotNull() & F.col(Y).isNotNull()).groupBy(DS)
             .agg(F.count(F.lit(1)).alias("n"), F.sum(F.abs(err)).alias("ae"), F.sum(err * err).alias("se")))
    cutoffs = pred.agg(F.collect_set("cutoff").alias("c")).scalar()
    scale = (daily.withColumn("__cut", F.explode(cutoffs)).where(F.col(DS) <= F.col("__cut"))
             .groupBy("__cut").agg((F.sum("ae") / F.sum("n")).alias("scale_mae"),
                                   F.sqrt(F.sum("se") / F.sum("n")).alias("scale_rmse")))
    by = list(by)
    sums = error_sums(pred, models, by, seasonal=None, zero=None)
    if by == ["cutoff"]:
        keyed = sums.withColumn("__cut", F.col("cutoff"))
    elif by:
        last = pred.groupBy(*by).agg(F.max("cutoff").alias("__cut"))
        keyed = sums.join(last, by)
    else:
        keyed = sums.withColumn("__cut", pred.agg(F.max("cutoff").alias("m")).scalar())
    mae, rmse = ratio(F.col("ae"), F.col("n")), F.sqrt(ratio(F.col("se"), F.col("n")))
    return keyed.join(scale, "__cut").select(
        *by, "model", ratio(mae, F.col("scale_mae")).alias("mase"), ratio(rmse, F.col("scale_rmse")).alias("rmsse"))


def change_scaled(pred: DataFrame, models: Sequence[str]) -> DataFrame:
    """Comparison scaled by one-step changes of the actuals within each series (and cutoff); mrae by
    the mean actual."""
    part = [ID, "cutoff"] if "cutoff" in pred.columns else [ID]
    moves = naive_errors(pred.select(*part, DS, Y), key=part)
    e = F.col("naive_error").cast("double")
    scale = moves.agg(F.avg(e).alias("a"), F.sqrt(F.avg(e * e)).alias("b"))
    one, two = scale.select("a").scalar(), scale.select("b").scalar()
    sums = error_sums(pred, models, seasonal=None, zero=None)
    mae, rmse = ratio(F.col("ae"), F.col("n")), F.sqrt(ratio(F.col("se"), F.col("n")))
    return sums.select("model", mae.alias("mae"), rmse.alias("rmse"), ratio(mae, one).alias("mase"),
                       ratio(rmse, two).alias("rmsse"), ratio(F.col("ae"), F.col("y_sum")).alias("mrae"))
