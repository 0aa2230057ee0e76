"""Row filters, null handling and table checks."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.functions.values import apply_rule, is_missing, nan_to_null, null_sentinel, qc_mask


def mask_quality(df: DataFrame, value: str, flag: str, good: str = "G") -> DataFrame:
    return df.withColumn(value, qc_mask(F.col(value), F.col(flag), good))


def nulls_for_nan(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """NaN becomes null in the given columns, or in all floating columns."""
    chosen = [c for c, kind in df.dtypes if kind in ("double", "float")] if cols is None else cols
    return df.withColumns({c: nan_to_null(F.col(c)) for c in chosen})


def between_time(df: DataFrame, time: str, start: str | datetime, end: str | datetime) -> DataFrame:
    return df.where(F.col(time).between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz")))


def sel_period(df: DataFrame, time: str, year: int, month: int | None = None) -> DataFrame:
    """One calendar year or month as a half-open range, so the filter reaches the scan."""
    start = date(year, month or 1, 1)
    if month is None:
        stop = date(year + 1, 1, 1)
    else:
        stop = date(year + month // 12, month % 12 + 1, 1)
    kind = dict(df.dtypes)[time]
    return df.where((F.col(time) >= F.lit(start).cast(kind)) & (F.col(time) < F.lit(stop).cast(kind)))


def sel_day(df: DataFrame, time: str, day: date) -> DataFrame:
    return df.where(F.col(time) == F.lit(day).cast(dict(df.dtypes)[time]))


def null_sentinels(df: DataFrame, rules: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: null_sentinel(F.col(c), s) for c, s in rules.items()})


def apply_validity(df: DataFrame, rules: Mapping[str, Mapping]) -> DataFrame:
    return df.withColumns({c: apply_rule(F.col(c), rule) for c, rule in rules.items()})


def scale(df: DataFrame, factors: Mapping[str, float]) -> DataFrame:
    return df.withColumns({c: F.col(c) * F.lit(f) for c, f in factors.items()})


def drop_any(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("any", subset=list(cols) if cols else None)


def drop_all(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return df.na.drop("all", subset=list(cols) if cols else None)


def null_safe_score(
    df: DataFrame, features: Sequence[str], score: Callable[[DataFrame], DataFrame], pred: str = "pred"
) -> DataFrame:
    """Score every row with missing features as 0, then null the scores of incomplete rows."""
    incomplete, kinds = F.lit(False), dict(df.dtypes)
    for f in features:
        incomplete = incomplete | is_missing(f, kinds[f])
    marked = df.withColumn("_incomplete", incomplete).withColumns({f"_raw_{f}": F.col(f) for f in features})
    filled = marked.withColumns({f: F.when(is_missing(f, kinds[f]), 0.0).otherwise(F.col(f).cast("double")) for f in features})
    scored = score(filled).withColumn(pred, F.when(~F.col("_incomplete"), F.col(pred)))
    return scored.select(*[F.col(f"_raw_{c}").alias(c) if c in features else F.col(c) for c in df.columns], pred)


def null_audit(df: DataFrame) -> DataFrame:
    """Column and number of missing values (nulls and NaN), one row per column."""
    counts = df.agg(*[F.count(F.when(is_missing(c, kind), 1)).alias(c) for c, kind in df.dtypes])
    return counts.unpivot([], list(df.columns), "column", "n_null").select("column", "n_null")


def check_rows(left: DataFrame, right: DataFrame, by: Sequence[str]) -> DataFrame:
    """Keys whose row counts differ between two tables."""
    a = left.groupBy(*by).agg(F.count(F.lit(1)).alias("_a"))
    b = right.groupBy(*by).agg(F.count(F.lit(1)).alias("_b"))
    joined = a.join(b, list(by), "full_outer")
    return joined.select(
        *by, F.coalesce("_a", F.lit(0)).alias("left_rows"), F.coalesce("_b", F.lit(0)).alias("right_rows")
    ).where(F.col("left_rows") != F.col("right_rows"))
