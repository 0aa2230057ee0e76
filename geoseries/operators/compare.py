"""Raw-versus-stored checks, product look-ups and baselines."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geoseries.schema import LAYER_DEPTHS


def reconcile(
    extracted: DataFrame, stored: DataFrame, on: Sequence[str], col: str, stored_col: str | None = None, tol: float = 1e-6
) -> DataFrame:
    """Raw grid value beside the stored table value, with a verdict per key."""
    stored_col = stored_col or col
    left = extracted.select(*on, F.col(col).alias("raw"), F.lit(True).alias("_l"))
    right = stored.select(*on, F.col(stored_col).alias("stored"), F.lit(True).alias("_r"))
    both = left.join(right, list(on), "full_outer")
    gap = F.abs(F.col("raw") - F.col("stored"))
    status = (
        F.when(F.col("_r").isNull(), "not stored")
        .when(F.col("_l").isNull(), "not in raw")
        .when(F.col("raw").isNull() & F.col("stored").isNull(), "match")
        .when(gap <= tol, "match")
        .otherwise("differs")
    )
    return both.select(*on, "raw", "stored", (F.col("raw") - F.col("stored")).alias("diff"), status.alias("status"))


def profile_position(depth: Column) -> tuple[Column, Column]:
    """File number and 0-based level of a soil profile depth 1..8 stored as two files of four.

    Depths divisible by four sit on the last level; depth 4 is in the first file.
    """
    file = F.when(F.floor(depth / 5) >= 1, 2).otherwise(1)
    return file, F.pmod(depth - 1, F.lit(4)).cast("int")


def assign_layer(low: Column, high: Column, layers: Mapping[str, tuple[float, float]] = LAYER_DEPTHS) -> Column:
    """Layer whose interval contains [low, high]; null if none does."""
    eps = 1e-9
    return F.coalesce(
        *[F.when((low >= a - eps) & (high <= b + eps), F.lit(name)) for name, (a, b) in layers.items()]
    )


def pick_layer_var(layer: Column, names: Mapping[str, str]) -> Column:
    """Value of the product variable that stands for the row's layer."""
    return F.coalesce(*[F.when(layer == name, F.col(var)) for name, var in names.items()])


def compare_group(members: DataFrame, groups: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """Each member series beside its group mean."""
    mean = groups.select(*on, F.col(value).alias("averaged"))
    return members.join(mean, list(on)).withColumn("diff", F.col(value) - F.col("averaged"))


def semi_available(stations: DataFrame, product: DataFrame, on: Sequence[str]) -> DataFrame:
    return stations.join(product.select(*on), list(on), "left_semi")


def missing_from(stations: DataFrame, product: DataFrame, on: Sequence[str]) -> DataFrame:
    return stations.join(product.select(*on), list(on), "left_anti")


def swap_source(stations: DataFrame, product: DataFrame, on: Sequence[str], value: str) -> DataFrame:
    """The same keys with `value` read from the other product."""
    return stations.drop(value).join(product.select(*on, value), list(on))


def product_baseline(
    test: DataFrame, pred: Column, station: str, time: str, true: str
) -> DataFrame:
    """Score rows that use a product column as the prediction; incomplete pairs drop out."""
    rows = test.select(
        F.col(station).alias("station_idx"), F.col(time).alias("date_time"), pred.alias("pred"), F.col(true).alias("true")
    )
    return rows.na.drop("any", subset=["pred", "true"])
