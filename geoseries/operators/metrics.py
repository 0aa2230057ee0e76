"""Scores of predictions against observations, and tables built from them."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geoseries.operators.quantiles import exact_percentiles
from geoseries.session import stable

METRICS = ("rmse", "r", "ubrmse")
LARGER_IS_BETTER = {"r": True, "r2": True, "rmse": False, "ubrmse": False}


def rmse(true: str, pred: str) -> Column:
    return F.sqrt(F.avg((F.col(true) - F.col(pred)) * (F.col(true) - F.col(pred))))


def ubrmse(true: str, pred: str) -> Column:
    return F.stddev_pop(F.col(true) - F.col(pred))


def correlation(true: str, pred: str) -> Column:
    """Pearson r; null when either side is constant."""
    both = F.col(true).isNotNull() & F.col(pred).isNotNull()
    spread = F.stddev_pop(F.when(both, F.col(true))) * F.stddev_pop(F.when(both, F.col(pred)))
    return F.covar_pop(true, pred) / F.nullif(spread, F.lit(0.0))


def r2(true: str, pred: str) -> Column:
    """Share of variance explained (not the squared correlation) over rows that have both; null for constant truth."""
    error = F.sum((F.col(true) - F.col(pred)) * (F.col(true) - F.col(pred)))
    paired = F.when(F.col(pred).isNotNull(), F.col(true))
    return F.lit(1.0) - error / F.nullif(F.var_pop(paired) * F.count(paired), F.lit(0.0))


def _pairs(df: DataFrame, true: str, pred: str) -> DataFrame:
    return df.where(F.col(true).isNotNull() & F.col(pred).isNotNull())


def pooled_metrics(df: DataFrame, by: Sequence[str] = (), true: str = "true", pred: str = "pred") -> DataFrame:
    return _pairs(df, true, pred).groupBy(*by).agg(
        r2(true, pred).alias("r2_total"),
        correlation(true, pred).alias("r_total"),
        rmse(true, pred).alias("rmse_total"),
        ubrmse(true, pred).alias("ubrmse_total"),
    )


def station_metrics(
    df: DataFrame, by: Sequence[str] = ("station_idx",), true: str = "true", pred: str = "pred"
) -> DataFrame:
    return _pairs(df, true, pred).groupBy(*by).agg(
        rmse(true, pred).alias("rmse"),
        correlation(true, pred).alias("r"),
        ubrmse(true, pred).alias("ubrmse"),
        F.count(F.lit(1)).alias("count"),
        r2(true, pred).alias("r2"),
    )


def wide_station_metrics(df: DataFrame, names: Sequence[str], by: Sequence[str], true: str = "true") -> DataFrame:
    """`<name>_<metric>` of prediction columns side by side, one row for each station that every one of them scores.

    As `pivot_metrics` of `station_metrics` of the unpivoted table, but no row is repeated for a column and there is one group
    for each station, in one aggregate.
    """
    paired = [F.count(F.when(F.col(true).isNotNull() & F.col(n).isNotNull(), 1)) for n in names]
    values = [(n, m, f(true, n)) for n in names for m, f in (("rmse", rmse), ("r", correlation), ("ubrmse", ubrmse))]
    both = df.groupBy(*by).agg(F.least(*paired).alias("_least") if len(paired) > 1 else paired[0].alias("_least"), *[c.alias(f"{n}_{m}") for n, m, c in values])
    return both.where(F.col("_least") > 0).drop("_least")


def macro_metrics(stations: DataFrame, by: Sequence[str] = (), cols: Sequence[str] = METRICS) -> DataFrame:
    """Mean over stations; undefined values are left out."""
    return stations.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def run_metrics(
    df: DataFrame, labels: Mapping[str, str], true: str = "true", pred: str = "pred", origin: str | None = None
) -> DataFrame:
    """One record per run: errors, fit, and fit against the label before moment matching."""
    pairs = _pairs(df, true, pred)
    columns = [
        F.avg((F.col(true) - F.col(pred)) * (F.col(true) - F.col(pred))).alias("mse"),
        rmse(true, pred).alias("rmse"),
        F.avg(F.abs(F.col(true) - F.col(pred))).alias("mae"),
        r2(true, pred).alias("r2"),
        correlation(true, pred).alias("r"),
        ubrmse(true, pred).alias("ubrmse"),
    ]
    if origin:
        columns.append(r2(origin, pred).alias("origin_r2"))
    return pairs.agg(*columns).withColumns({k: F.lit(v) for k, v in labels.items()})


def metric_levels(
    df: DataFrame, by: Sequence[str], station: str = "station_idx", true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Station mean and pooled metrics side by side, per key.

    Stations and totals come from one grouping-sets aggregate over one scan.
    """
    keys = list(by)
    pairs = _pairs(df, true, pred)
    sets = [[*keys, station], keys]
    levels = pairs.groupingSets([[F.col(c) for c in s] for s in sets], *keys, station).agg(
        F.grouping_id().alias("_level"),
        r2(true, pred).alias("r2"),
        correlation(true, pred).alias("r"),
        rmse(true, pred).alias("rmse"),
        ubrmse(true, pred).alias("ubrmse"),
    )
    total = F.col("_level") != 0
    names = ("r2", "r", "rmse", "ubrmse")
    return levels.groupBy(*keys).agg(
        *[F.avg(F.when(~total, F.col(m))).alias(m) for m in names],
        *[F.max(F.when(total, F.col(m))).alias(f"{m}_total") for m in names],
    )


def combined_metrics(
    df: DataFrame, station: str = "station_idx", valid: str = "Is_valid", true: str = "true", pred: str = "pred"
) -> DataFrame:
    """Station means and global metrics of the valid rows, in one row."""
    levels = metric_levels(df.where(F.col(valid) == 1), [], station, true, pred)
    return levels.select(
        *["r2", "rmse", "r", "ubrmse"],
        *[F.col(f"{m}_total").alias(f"global_{m}") for m in ("r2", "rmse", "r", "ubrmse")],
    )


def metric_medians(df: DataFrame, by: Sequence[str], cols: Sequence[str] = METRICS) -> DataFrame:
    """Exact median of each metric per key; `df` has one row per station and run."""
    long = stable(df.select(*by, *cols)).unpivot(list(by), list(cols), "_metric", "_value")
    medians = exact_percentiles(long, [*by, "_metric"], "_value", [0.5], "_mid")
    return medians.groupBy(*by).agg(
        *[F.max(F.when(F.col("_metric") == c, F.col("_mid")[0])).alias(c) for c in cols]
    )


def merge_metrics(tables: Mapping[str, DataFrame], on: Sequence[str] = ("station_idx",), cols: Sequence[str] = METRICS) -> DataFrame:
    """Wide table `<name>_<metric>` of the stations every table has.

    Stacked and pivoted in one shuffle; a station missing from one table drops out.
    """
    stacked = reduce(
        DataFrame.unionByName, [t.select(*on, *cols).withColumn("exp", F.lit(name)) for name, t in tables.items()]
    )
    return pivot_metrics(stacked, list(tables), on, cols)


def pivot_metrics(
    long: DataFrame, names: Sequence[str], on: Sequence[str] = ("station_idx",), cols: Sequence[str] = METRICS
) -> DataFrame:
    """`merge_metrics` of one long table with the names in `exp`: its source is read once."""
    wide = long.where(F.col("exp").isin(list(names))).groupBy(*on).agg(
        sum((F.max((F.col("exp") == n).cast("int")) for n in names), F.lit(0)).alias("_have"),
        *[F.max(F.when(F.col("exp") == n, F.col(c))).alias(f"{n}_{c}") for n in names for c in cols],
    )
    return wide.where(F.col("_have") == len(names)).drop("_have")


def best_estimator(wide: DataFrame, names: Sequence[str], metric: str, out: str = "best") -> DataFrame:
    """Name with the best value of `metric` in each row; nulls skipped, first name on a tie."""
    cols = [F.col(f"{n}_{metric}") for n in names]
    top = (F.greatest if LARGER_IS_BETTER[metric] else F.least)(*cols)
    return wide.withColumn(out, F.coalesce(*[F.when(c == top, F.lit(n)) for n, c in zip(names, cols)]))


def winner_table(best: DataFrame, by: Sequence[str], names: Sequence[str], col: str = "best") -> DataFrame:
    """Wins per name as columns: a row of counts and a row of shares per key."""
    counts = best.where(F.col(col).isNotNull()).groupBy(*by).agg(
        F.count(F.lit(1)).cast("double").alias("_all"),
        *[F.count(F.when(F.col(col) == n, 1)).cast("double").alias(n) for n in names],
    )
    both = counts.withColumn("kind", F.explode(F.array(F.lit("count"), F.lit("share"))))
    return both.select(
        *by, "kind", *[F.when(F.col("kind") == "count", F.col(n)).otherwise(F.col(n) / F.col("_all")).alias(n) for n in names]
    )


def best_per_layer(best: DataFrame, by: Sequence[str] = ("layer",), col: str = "best") -> DataFrame:
    """Most frequent winner per key, the first name on a tie."""
    counts = best.where(F.col(col).isNotNull()).groupBy(*by, col).agg(F.count(F.lit(1)).alias("wins"))
    return counts.groupBy(*by).agg(F.min(F.struct((-F.col("wins")).alias("w"), F.col(col))).alias("_top")).select(
        *by, F.col(f"_top.{col}").alias(col), (-F.col("_top.w")).alias("wins")
    )


def corr_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Lower triangle of the pairwise-complete correlation matrix, from one aggregate."""
    pairs = [(i, j) for i in range(len(cols)) for j in range(i)]
    one = df.agg(*[correlation(cols[i], cols[j]).alias(f"_{i}_{j}") for i, j in pairs])
    cells = [F.struct(F.lit(cols[i]).alias("a"), F.lit(cols[j]).alias("b"), F.col(f"_{i}_{j}").alias("r")) for i, j in pairs]
    return one.select(F.inline(F.array(*cells)))


def box_stats(df: DataFrame, by: Sequence[str], col: str, whis: float = 1.5) -> DataFrame:
    """Quartiles and whiskers (furthest value within `whis` quartile ranges of the box)."""
    box = exact_percentiles(df, by, col, [0.25, 0.5, 0.75], "_q").select(
        *by, F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3")
    )
    reach = F.lit(float(whis)) * (F.col("q3") - F.col("q1"))
    low, high = F.col("q1") - reach, F.col("q3") + reach
    joined = df.where(F.col(col).isNotNull()).select(*by, col)
    joined = joined.join(box, list(by)) if by else joined.withColumn("_b", box.select(F.struct("*")).scalar()).select(col, "_b.*")
    inside = F.when(F.col(col).between(low, high), F.col(col))
    return joined.groupBy(*by, "q1", "median", "q3").agg(
        F.min(inside).alias("_lo"), F.max(inside).alias("_hi"), F.count(F.lit(1)).alias("n"),
        (F.count(F.lit(1)) - F.count(inside)).alias("n_outliers"),
    ).select(
        *by, F.least("_lo", "q1").alias("whisker_low"), "q1", "median", "q3",
        F.greatest("_hi", "q3").alias("whisker_high"), "n", "n_outliers",
    )


def masked_mse(df: DataFrame, by: Sequence[str] = (), true: str = "true", pred: str = "pred", valid: str = "Is_valid") -> DataFrame:
    error = (F.col(true) - F.col(pred)) * (F.col(true) - F.col(pred)) * F.col(valid)
    return df.groupBy(*by).agg((F.sum(error) / F.nullif(F.sum(valid).cast("double"), F.lit(0.0))).alias("masked_mse"))


def standardize(df: DataFrame, cols: Sequence[str], ddof: int = 0, fit_on: DataFrame | None = None) -> DataFrame:
    """Column z-scores with population (ddof=0) or sample (ddof=1) deviation of `fit_on`."""
    deviation = {0: F.stddev_pop, 1: F.stddev_samp}[ddof]
    source = fit_on if fit_on is not None else df
    moments = source.agg(
        F.struct(*[F.avg(c).alias(f"m_{c}") for c in cols], *[deviation(c).alias(f"s_{c}") for c in cols]).alias("_fit")
    ).scalar()
    fitted = df.withColumn("_fit", moments)
    return fitted.withColumns(
        {c: (F.col(c) - F.col(f"_fit.m_{c}")) / F.nullif(F.col(f"_fit.s_{c}"), F.lit(0.0)) for c in cols}
    ).drop("_fit")


def accuracy(df: DataFrame, label: str, pred: str, fold: str | None = None) -> DataFrame:
    """Share of right labels; with folds, the mean of the fold accuracies."""
    right = F.avg(F.when(F.col(label) == F.col(pred), 1.0).otherwise(0.0))
    if fold is None:
        return df.agg(right.alias("accuracy"))
    return df.groupBy(fold).agg(right.alias("accuracy")).agg(F.avg("accuracy").alias("accuracy"))


def ensemble_mean(df: DataFrame, cols: Sequence[str], name: str = "pred") -> DataFrame:
    """Row-wise mean of the estimator columns, nulls skipped."""
    total = sum((F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in cols), F.lit(0.0))
    number = sum((F.col(c).isNotNull().cast("int") for c in cols), F.lit(0))
    return df.withColumn(name, total / F.nullif(number.cast("double"), F.lit(0.0)))


def sweep_metrics(
    wide: DataFrame, estimators: Sequence[str], by: Sequence[str], station: str = "station_idx", true: str = "true",
    not_in_ensemble: Sequence[str] = (), base: DataFrame | None = None,
) -> DataFrame:
    """Station-mean and pooled metrics of every estimator and of their ensemble, per key.

    `base` adds the finished rows of earlier runs; metrics they lack are null.
    """
    members = [e for e in estimators if e not in not_in_ensemble]
    with_mean = ensemble_mean(wide, members, "ensemble")
    long = with_mean.select(*by, station, true, *estimators, "ensemble").unpivot(
        [*by, station, true], [*estimators, "ensemble"], "exp", "pred"
    )
    levels = metric_levels(long, ["exp", *by], station, true, "pred")
    return levels if base is None else levels.unionByName(base, allowMissingColumns=True)


def with_labels(df: DataFrame, labels: Mapping[str, object]) -> DataFrame:
    return df.withColumns({k: F.lit(v) for k, v in labels.items()})


def beside(df: DataFrame, *others: DataFrame) -> DataFrame:
    """One-row tables side by side; each is read as a scalar subquery."""
    for i, other in enumerate(others):
        df = df.withColumn(f"_o{i}", other.select(F.struct("*").alias("_s")).scalar()).select(
            *[c for c in df.columns], f"_o{i}.*"
        )
    return df


def align_preds(tables: Mapping[str, DataFrame], key: Sequence[str], true: str = "true", pred: str = "pred") -> DataFrame:
    """Predictions of several estimators as columns, matched on a key instead of by position."""
    stacked = reduce(
        DataFrame.unionByName, [t.select(*key, true, pred).withColumn("_exp", F.lit(n)) for n, t in tables.items()]
    )
    return stacked.groupBy(*key).agg(
        F.max(true).alias(true), *[F.max(F.when(F.col("_exp") == n, F.col(pred))).alias(n) for n in tables]
    )


def rank_features(importance: DataFrame, by: Sequence[str] = (), value: str = "value") -> DataFrame:
    """Features by mean importance (ascending positions), month indicators left out.

    The table holds features x repeats, so the sorted group is as long as the feature list.
    """
    means = importance.where(~F.col("feature").startswith("month")).groupBy(*by, "feature").agg(F.avg(value).alias("importance"))
    order = Window.partitionBy(*by).orderBy("importance", "feature")
    return means.withColumn("position", F.row_number().over(order))


# Features never reported as a station's main driver.
LOCATION_FEATURES = ["lon", "lat"]


def top_feature(importance: DataFrame, by: Sequence[str], value: str = "importance") -> DataFrame:
    """Feature with the largest value per key, location and month features left out."""
    usable = importance.where(
        ~F.col("feature").isin(LOCATION_FEATURES) & ~F.col("feature").startswith("month") & F.col(value).isNotNull()
    )
    picked = usable.groupBy(*by).agg(F.min(F.struct((-F.col(value)).alias("v"), F.col("feature"))).alias("_t"))
    return picked.select(*by, F.col("_t.feature").alias("variable"), (-F.col("_t.v")).alias("value"))


def select_seed(log: DataFrame, by: Sequence[str] = ("layer",), accuracy: str = "accuracy") -> DataFrame:
    """Seed whose train/test parts are hardest to tell apart: accuracy closest to one half, lowest seed on a tie."""
    gap = F.abs(F.col(accuracy) - F.lit(0.5))
    best = log.groupBy(*by).agg(F.min(F.struct(gap.alias("gap"), F.col("seed"), F.col(accuracy))).alias("_t"))
    return best.select(*by, F.col("_t.seed").alias("seed"), F.col(f"_t.{accuracy}").alias(accuracy))


def importance_table(arrays: DataFrame, keys: Sequence[str], features: str, values: str) -> DataFrame:
    """importances[feature][repeat] plus feature names to (feature, repeat, value) rows."""
    zipped = arrays.select(*keys, F.explode(F.arrays_zip(F.col(features).alias("f"), F.col(values).alias("v"))).alias("_z"))
    return zipped.select(*keys, F.col("_z.f").alias("feature"), F.posexplode("_z.v").alias("repeat", "value"))


def importance_wide(rows: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """One row per repeat, one column per feature."""
    return rows.groupBy(*keys, "repeat").pivot("feature", list(features)).agg(F.max("value"))


def importance_arrays(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(feature, repeat, value) rows back to one array of repeats per feature."""
    per = rows.groupBy(*keys, "feature").agg(F.array_sort(F.collect_list(F.struct("repeat", "value"))).alias("_a"))
    return per.groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("feature", F.col("_a.value").alias("v")))).alias("_f")
    ).select(*keys, F.col("_f.feature").alias("features"), F.col("_f.v").alias("importances"))
