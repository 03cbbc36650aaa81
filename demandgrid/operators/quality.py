"""Data quality: profiles, duplicates, scores, rules, alerts, history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from demandgrid.functions.core import Y, count_if, is_number, percent, q, ratio

_DATES = (T.DateType, T.TimestampType, T.TimestampNTZType)


def row_facts(df: DataFrame, good: Column | None = None) -> DataFrame:
    """One row: rows, repeats of earlier rows, missing cells, and rows that ``good`` holds for.

    Rows collapse by their full content map-side, so a row copied a million times ships once per task, and every figure
    is read off the collapsed rows: one scan and one exchange for all of them.
    """
    cells = [q(c) for c in df.columns]
    n = F.col("__n")
    missing = sum((c.isNull().cast("long") for c in cells), F.lit(0).cast("long"))
    per = df.groupBy(*cells).agg(F.count(F.lit(1)).alias("__n"))
    return per.agg(*[F.coalesce(F.sum(x), F.lit(0)).alias(name) for name, x in (
        ("n_rows", n), ("duplicates", n - 1), ("missing", n * missing),
        ("good", F.when(F.lit(True) if good is None else good, n).otherwise(0)))])


def duplicates(df: DataFrame) -> DataFrame:
    """Rows that repeat an earlier row: count and percentage."""
    return row_facts(df).select("n_rows", "duplicates", ratio(F.col("duplicates") * 100, F.col("n_rows")).alias("duplicate_pct"))


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: distinct and missing values, and what its type allows.

    One scan computes all columns; the exact distinct counts share it too.
    """
    def kind(f: T.StructField) -> str:
        if is_number(f.dataType):
            return "numeric"
        return "date" if isinstance(f.dataType, _DATES) else \
            "text" if isinstance(f.dataType, T.StringType) else "other"

    none_d, none_l, none_s = (F.lit(None).cast(t) for t in ("double", "bigint", "string"))

    def cell(f: T.StructField) -> Column:
        c, k = q(f.name), kind(f)
        num, dat, txt = k == "numeric", k == "date", k == "text"
        v = c.cast("double")
        stats = {
            "distinct_count": F.countDistinct(c), "n_rows": F.count(F.lit(1)),
            "missing": count_if(c.isNull()),
            "min": F.min(v) if num else none_d, "max": F.max(v) if num else none_d,
            "mean": F.avg(v) if num else none_d, "std": F.stddev_samp(v) if num else none_d,
            "zeros": count_if(c == 0) if num else none_l, "negative": count_if(c < 0) if num else none_l,
            "min_date": F.min(c).cast("string") if dat else none_s,
            "max_date": F.max(c).cast("string") if dat else none_s,
            "span_days": F.datediff(F.max(c), F.min(c)).cast("bigint") if dat else none_l,
            "mean_length": F.avg(F.length(c)) if txt else none_d}
        return F.struct(F.lit(f.name).alias("column"), F.lit(k).alias("kind"),
                        *[s.alias(n) for n, s in stats.items()])

    fields = df.schema.fields
    one = df.agg(*[cell(f).alias(f"c{i}") for i, f in enumerate(fields)])
    rows = one.select(F.explode(F.array(*[F.col(f"c{i}") for i in range(len(fields))])).alias("c")).select("c.*")
    return (rows.withColumn("distinct_pct", ratio(F.col("distinct_count") * 100, F.col("n_rows")))
            .withColumn("missing_pct", ratio(F.col("missing") * 100, F.col("n_rows"))).drop("n_rows"))


def quality_report(df: DataFrame) -> DataFrame:
    """One row: rows, columns, missing cells and %, duplicates and %."""
    n, cells = F.col("n_rows"), F.col("n_rows") * len(df.columns)
    return row_facts(df).select(
        n, F.lit(len(df.columns)).alias("n_columns"), F.col("missing").alias("missing_cells"),
        ratio(F.col("missing") * 100, cells).alias("missing_pct"), "duplicates",
        ratio(F.col("duplicates") * 100, n).alias("duplicate_pct"))


def quality_score(profile: DataFrame, dup: DataFrame, counts: bool = False) -> DataFrame:
    """100 less .5 per mean missing %, .3 per duplicate %, and 5 or 2 per low-variety column.

    ``counts=True`` penalises missing counts instead of percentages.
    """
    variety = F.when(F.col("distinct_pct") < 1, 5.0).when(F.col("distinct_pct") < 5, 2.0).otherwise(0.0)
    missing = F.avg("missing" if counts else "missing_pct")
    share = dup.select("duplicate_pct").scalar()
    score = F.lit(100.0) - missing * 0.5 - F.coalesce(share, F.lit(0.0)) * 0.3 - F.sum(variety)
    return profile.agg(F.greatest(F.lit(0.0), score).alias("score"))


def dataset_quality(features: DataFrame, targets: DataFrame) -> DataFrame:
    """Completeness, consistency, accuracy (y not negative) and their mean, in percent."""
    f = row_facts(features).select("n_rows", "duplicates", "missing", F.lit(len(features.columns)).alias("width"),
                                   F.lit(None).cast("long").alias("judged"), F.lit(None).cast("long").alias("good"))
    t = row_facts(targets, F.coalesce(F.col(Y) >= 0, F.lit(True))).select(
        "n_rows", "duplicates", "missing", F.lit(len(targets.columns)).alias("width"), F.col("n_rows").alias("judged"), "good")
    cells, n = F.sum(F.col("n_rows") * F.col("width")), F.sum("n_rows")
    out = f.unionByName(t).agg(
        ratio((cells - F.sum("missing")) * 100, cells).alias("completeness"),
        ratio((n - F.sum("duplicates")) * 100, n).alias("consistency"),
        ratio(F.sum("good") * 100, F.sum("judged")).alias("accuracy"))
    return out.withColumn("overall", (F.col("completeness") + F.col("consistency") + F.col("accuracy")) / 3)


@dataclass(frozen=True)
class AlertRule:
    """Raise when the value passes ``border``; severity is high past ``severe``."""

    metric: str
    text: str
    border: float
    severe: float | None
    above: bool = False

    def column(self) -> Column:
        v = F.col(self.metric)
        hit = v > self.border if self.above else v < self.border
        if self.severe is None:
            level = F.lit("medium")
        else:
            level = F.when(v > self.severe if self.above else v < self.severe, "high").otherwise("medium")
        return F.when(hit, F.struct(F.lit(self.metric).alias("metric"), level.alias("severity"),
                                    F.lit(self.text).alias("message"), v.cast("double").alias("value")))


# Thresholds of the quality and the forecast-error alerts.
QUALITY_RULES = (
    AlertRule("completeness", "Low data completeness", 90, 80),
    AlertRule("consistency", "Data consistency issues", 95, None),
    AlertRule("accuracy", "Data accuracy issues", 100, 95),
    AlertRule("overall", "Overall data quality is low", 85, 75))
ERROR_RULES = (
    AlertRule("best_mae", "High MAE", 2.0, 5.0, above=True),
    AlertRule("best_rmse", "High RMSE", 3.0, 7.0, above=True),
    AlertRule("best_mase", "High MASE", 1.5, 2.0, above=True))


def alerts(metrics: DataFrame, rules: Sequence[AlertRule]) -> DataFrame:
    """One row per rule that fires on each metrics row."""
    fired = F.array_compact(F.array(*[r.column() for r in rules]))
    return metrics.select(F.explode(fired).alias("a")).select("a.*")


def score_trends(history: DataFrame) -> DataFrame:
    """Per dataset: number of checks, first and last time, mean and spread, direction.

    History rows hold dataset, checked_at, score, mean_missing.
    """
    return (history.groupBy("dataset")
            .agg(F.count(F.lit(1)).alias("n_checks"), F.min("checked_at").alias("first_check"),
                 F.max("checked_at").alias("last_check"), F.avg("score").alias("mean_score"),
                 F.stddev_pop("score").alias("std_score"), F.avg("mean_missing").alias("mean_missing"),
                 F.min_by("score", "checked_at").alias("__a"), F.max_by("score", "checked_at").alias("__b"))
            .withColumn("trend", F.when(F.col("__b") > F.col("__a"), "improving").otherwise("declining"))
            .drop("__a", "__b"))


def score_dashboard(history: DataFrame) -> DataFrame:
    return history.agg(
        F.count(F.lit(1)).alias("n_checks"), F.countDistinct("dataset").alias("n_datasets"),
        F.avg("score").alias("avg_score"), F.min("score").alias("min_score"), F.max("score").alias("max_score"))


# ---------------------------------------------------------------- rules

@dataclass(frozen=True)
class ColumnRule:
    type: str
    nullable: bool = True
    ge: float | None = None
    le: float | None = None


# Typed rules of the sales and the features panel.
SALES_RULES = {
    "unique_id": ColumnRule("string", False), "ds": ColumnRule("date", False),
    "sales": ColumnRule("double", ge=0), "weekday": ColumnRule("int", ge=0, le=6),
    "month": ColumnRule("int", ge=1, le=12), "year": ColumnRule("int", ge=2010, le=2030)}
FEATURE_RULES = {
    "unique_id": ColumnRule("string", False), "ds": ColumnRule("date", False),
    "feature_1": ColumnRule("double"), "feature_2": ColumnRule("double"), "feature_3": ColumnRule("double"),
    "weekday": ColumnRule("int", ge=0, le=6), "month": ColumnRule("int", ge=1, le=12),
    "year": ColumnRule("int", ge=2010, le=2030)}


def schema_violations(df: DataFrame, rules: Mapping[str, ColumnRule], strict: bool = True) -> DataFrame:
    """Violation counts per (column, rule) in one pass; cells are coerced to the rule's type first."""
    static: list[tuple[str, str]] = [(c, "column present") for c in rules if c not in df.columns]
    if strict:
        static += [(c, "no other columns") for c in df.columns if c not in rules]
    checks: list[tuple[str, str, Column]] = []
    for c, r in rules.items():
        if c not in df.columns:
            continue
        v = q(c).try_cast(r.type)
        checks.append((c, f"type {r.type}", count_if(q(c).isNotNull() & v.isNull())))
        if not r.nullable:
            checks.append((c, "not null", count_if(q(c).isNull())))
        if r.ge is not None:
            checks.append((c, f">= {r.ge:g}", count_if(v < r.ge)))
        if r.le is not None:
            checks.append((c, f"<= {r.le:g}", count_if(v > r.le)))
    fixed = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.lit(1).cast("bigint").alias("violations"))
             for c, n in static]
    counted = [F.struct(F.lit(c).alias("column"), F.lit(n).alias("rule"), F.col(f"c{i}").alias("violations"))
               for i, (c, n, _) in enumerate(checks)]
    one = df.agg(F.count(F.lit(1)).alias("__n"), *[a.alias(f"c{i}") for i, (_, _, a) in enumerate(checks)])
    return one.select(F.explode(F.array(*fixed, *counted)).alias("v")).select("v.*")


def coerce(df: DataFrame, rules: Mapping[str, ColumnRule]) -> DataFrame:
    """Columns cast to their rule's type, unreadable cells NULL."""
    return df.withColumns({c: q(c).try_cast(r.type) for c, r in rules.items() if c in df.columns})


def expectations(df: DataFrame, rules: Sequence[Mapping[str, object]]) -> DataFrame:
    """Named expectations, each to (expectation, column, success, unexpected).

    Kinds: not_null, unique, between (min, max), in_set (values), row_count (min, max).
    ``unique`` takes one column or several and counts surplus rows after collapsing equal keys.
    """
    simple: list[tuple[str, str, Column, Column]] = []
    extra: list[DataFrame] = []
    for r in rules:
        kind, col = str(r["kind"]), r.get("column")
        label = ",".join(col) if isinstance(col, (list, tuple)) else str(col or "")
        if kind == "not_null":
            n = count_if(q(label).isNull())
        elif kind == "between":
            n = count_if((q(label) < r["min"]) | (q(label) > r["max"]))
        elif kind == "in_set":
            n = count_if(~q(label).isin(list(r["values"])))
        elif kind == "row_count":
            n = F.when(F.count(F.lit(1)).between(r.get("min", 0), r.get("max", 2**62)), 0).otherwise(1).cast("bigint")
        elif kind == "unique":
            cols = [q(c) for c in (col if isinstance(col, (list, tuple)) else [col])]
            per = df.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n"))
            n_dup = F.coalesce(F.sum(F.col("__n") - 1), F.lit(0))
            extra.append(per.agg(n_dup.alias("unexpected")).select(
                F.lit(kind).alias("expectation"), F.lit(label).alias("column"),
                (F.col("unexpected") == 0).alias("success"), "unexpected"))
            continue
        else:
            raise ValueError(f"unknown expectation {kind}")
        simple.append((kind, label, n, n == 0))
    out: DataFrame | None = None
    if simple:
        one = df.agg(*[n.alias(f"c{i}") for i, (_, _, n, _) in enumerate(simple)])
        cells = F.array(*[
            F.struct(F.lit(k).alias("expectation"), F.lit(lab).alias("column"),
                     (F.col(f"c{i}") == 0).alias("success"), F.col(f"c{i}").alias("unexpected"))
            for i, (k, lab, _, _) in enumerate(simple)])
        out = one.select(F.explode(cells).alias("e")).select("e.*")
    for e in extra:
        out = e if out is None else out.unionByName(e)
    if out is None:
        raise ValueError("no expectations given")
    return out


def expectation_statistics(results: DataFrame) -> DataFrame:
    return results.agg(
        F.count(F.lit(1)).alias("evaluated"), count_if(F.col("success")).alias("successful"),
        count_if(~F.col("success")).alias("failed"), percent(F.col("success")).alias("success_pct"))
