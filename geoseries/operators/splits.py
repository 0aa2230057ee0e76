"""Hold-out splits, station numbering, moment matching, group de-duplication."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.operators.ranking import CHUNK_ROWS, chunked_rank, hash_rank, row_hash


def temporal_split(
    df: DataFrame, station: str, time: str, ties: Sequence[str] = (), test: float = 0.2, rows: int = CHUNK_ROWS
) -> DataFrame:
    """First int(n * (1 - test)) rows of each station in time order are `train`."""
    ranked = chunked_rank(df, [station], [time, *ties], None, "_rn", "_n", rows)
    cut = F.floor(F.col("_n") * F.lit(1 - test))
    return ranked.withColumn("status", F.when(F.col("_rn") <= cut, "train").otherwise("test")).drop("_rn", "_n")


def temporal_split3(
    df: DataFrame,
    station: str,
    time: str,
    ties: Sequence[str] = (),
    test: float = 0.2,
    val: float = 0.1,
    rows: int = CHUNK_ROWS,
) -> DataFrame:
    ranked = chunked_rank(df, [station], [time, *ties], None, "_rn", "_n", rows)
    first = F.floor(F.col("_n") * F.lit(1 - (test + val)))
    second = first + F.floor(F.col("_n") * F.lit(val))
    status = F.when(F.col("_rn") <= first, "train").when(F.col("_rn") <= second, "val").otherwise("test")
    return ranked.withColumn("status", status).drop("_rn", "_n")


def hash_threshold(stations: DataFrame, station: str, seed: object, share: float) -> Column:
    """Hash of the last station inside the first ceil(share * n) of the seeded order.

    A scalar subquery: rows are then split by comparing their own hash, with no join.
    """
    hashed = stations.select(station).distinct().select(row_hash(seed, station).alias("_h"))
    ranked = chunked_rank(hashed, [], ["_h"], None, "_rn", "_n")
    return ranked.where(F.col("_rn") == F.ceil(F.col("_n") * F.lit(share))).agg(F.max("_h")).scalar()


def spatial_split(df: DataFrame, station: str, seed: object, test: float = 0.2) -> DataFrame:
    """Whole stations held out: ceil(test * n) of them, in seeded hash order."""
    held = row_hash(seed, station) <= hash_threshold(df, station, seed, test)
    return df.withColumn("status", F.when(held, "test").otherwise("train"))


def spatial_split3(df: DataFrame, station: str, seed: object, test: float = 0.2, val_of_rest: float = 0.125) -> DataFrame:
    """Test stations first, then a validation share of the remaining stations."""
    first = spatial_split(df, station, seed, test)
    rest = first.where(F.col("status") == "train")
    again = f"{seed}:val"
    val = (F.col("status") == "train") & (row_hash(again, station) <= hash_threshold(rest, station, again, val_of_rest))
    return first.withColumn("status", F.when(val, "val").otherwise(F.col("status")))


# Layers that do not split each source by its own seed.
LAYER_SPLIT_RULES = {"layer4": "pooled", "layer1": "first source only"}


def spatial_split_by_source(
    df: DataFrame, station: str, source: str, seeds: Mapping[str, object], layer: str, test: float = 0.2
) -> DataFrame:
    """Hold-out per source, each with its own seed; the first source's seed is the fixed one.

    Some layers pool the sources (second seed) or keep only the first source.
    """
    first, second = list(seeds)
    rule = LAYER_SPLIT_RULES.get(layer)
    keyed = df.withColumn("_station", F.concat_ws(":", source, F.col(station).cast("string")))
    if rule == "pooled":
        return spatial_split(keyed, "_station", seeds[second], test).drop("_station")
    names = [first] if rule else [first, second]
    keyed = keyed.where(F.col(source).isin(names))
    held = F.lit(False)
    for name in names:
        limit = hash_threshold(keyed.where(F.col(source) == name), "_station", seeds[name], test)
        held = F.when(F.col(source) == name, row_hash(seeds[name], "_station") <= limit).otherwise(held)
    return keyed.withColumn("status", F.when(held, "test").otherwise("train")).drop("_station")


def station_index(df: DataFrame, station: str, name: str = "station_idx", rows: int = CHUNK_ROWS) -> DataFrame:
    """0-based numbers, training stations first, in the order of their keys.

    A station present in both parts gets one number per part.
    """
    train_first = F.when(F.col("status") == "train", 0).otherwise(1)
    pairs = df.select("status", station).distinct().withColumn("_part", train_first)
    numbered = chunked_rank(pairs, [], ["_part", station], None, name, rows=rows).drop("_part")
    return df.join(numbered.withColumn(name, F.col(name) - 1), ["status", station])


def first_per_station(df: DataFrame, station: str, order: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Values of the earliest row of each station, by partial aggregation instead of a sort."""
    picked = df.groupBy(station).agg(F.min(F.struct(*order, *cols)).alias("_first"))
    names = [c for c in [*order, *cols]]
    return picked.select(station, *[F.col(f"_first.{c}").alias(c) for c in names])


def match_moments(df: DataFrame, by: Sequence[str], y: str, ref: str) -> DataFrame:
    """Rescale `y` per station to the mean and sample deviation of `ref`; the original is kept."""
    stats = df.groupBy(*by).agg(
        F.avg(y).alias("_m"), F.stddev_samp(y).alias("_s"), F.avg(ref).alias("_tm"), F.stddev_samp(ref).alias("_ts")
    )
    return (
        df.join(stats, list(by))
        .withColumn(f"{y}_origin", F.col(y))
        .withColumn(y, (F.col(y) - F.col("_m")) / F.nullif(F.col("_s"), F.lit(0.0)) * F.col("_ts") + F.col("_tm"))
        .drop("_m", "_s", "_tm", "_ts")
    )


def dedup_groups(
    stations: DataFrame, group: str, station: str, source: str, rows: str, check_empty: Sequence[str]
) -> DataFrame:
    """Lowest station of each group and source. Empty stations are passed over in `check_empty` sources only."""
    usable = (~F.col(source).isin(list(check_empty))) | (F.col(rows) > 0)
    return stations.where(usable).groupBy(source, group).agg(F.min(station).alias(station))


def stratified_folds(
    df: DataFrame, label: str, keys: Sequence[str], k: int = 5, seed: object = 0, ties: Sequence[str] = ()
) -> DataFrame:
    """Fold number 0..k-1, balanced within each label, in seeded hash order."""
    ranked = hash_rank(df, [label], seed, list(keys), "_rn", ties=ties)
    return ranked.withColumn("fold", ((F.col("_rn") - 1) % k).cast("int")).drop("_rn")
