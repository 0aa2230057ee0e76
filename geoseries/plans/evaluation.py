"""Metric collections over all experiments, layers and splits at once."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.functions.values import recode
from geoseries.operators.metrics import (
    METRICS,
    best_estimator,
    ensemble_mean,
    metric_levels,
    station_metrics,
    wide_station_metrics,
    winner_table,
)

RUN = ["exp", "split_method", "layer"]


def _available(scores: DataFrame, missing_layers: Mapping[str, Sequence[str]]) -> DataFrame:
    gone = F.lit(False)
    for exp, layers in missing_layers.items():
        gone = gone | ((F.col("exp") == exp) & F.col("layer").isin(list(layers)))
    return scores.where(~gone)


def metric_collection(scores: DataFrame, missing_layers: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """Station-mean and pooled metrics of every run."""
    levels = metric_levels(_available(scores, missing_layers or {}), RUN)
    return levels.drop("r2")


def insitu_collection(
    scores: DataFrame, names: Mapping[str, str] | None = None, missing_layers: Mapping[str, Sequence[str]] | None = None
) -> DataFrame:
    """Per-station metrics of every run, experiments relabelled for publication."""
    stations = station_metrics(_available(scores, missing_layers or {}), [*RUN, "station_idx"]).drop("r2")
    return stations.withColumn("exp", recode(F.col("exp"), names)) if names else stations


def discussion_summary(
    wide: DataFrame, estimators: Sequence[str], members: Sequence[str], by: Sequence[str] = ("split_method", "layer"), report: str = "layer",
    base: Sequence[str] = (),
) -> DataFrame:
    """Who wins how often: sweep, per-station merge, best by each metric, counts and shares per layer.

    `base` names prediction columns of earlier runs: they compete, ahead of the estimators on a tie, but are not part of the ensemble.
    """
    names = [*base, *estimators, "ensemble"]
    with_mean = ensemble_mean(wide, members, "ensemble")
    keys = [*by, "station_idx"]
    merged = wide_station_metrics(with_mean, names, keys)
    picks: list[Column] = []
    for metric in METRICS:
        merged = best_estimator(merged, names, metric, f"_best_{metric}")
        picks.append(F.col(f"_best_{metric}"))
    best = merged.select(report, F.explode(F.array(*picks)).alias("best"))
    return winner_table(best, [report], names)
