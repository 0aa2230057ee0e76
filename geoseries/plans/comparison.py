"""Comparison maps of predictions and products."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.operators.grid import apply_mask, climatology, merge_products

CELL = ("lat_i", "lon_i")


def layer_means(
    product: DataFrame, time: str, variables: Mapping[str, str], part: str, scale: float = 1.0, on: Sequence[str] = CELL
) -> DataFrame:
    """Calendar means of a product, one row per layer, cell and month or year.

    Each variable is averaged once, also where several layers share it.
    """
    wide = climatology(product, time, sorted(set(variables.values())), on, part)
    rows = [
        F.struct(F.lit(layer).alias("layer"), (F.col(v) * F.lit(float(scale))).alias("value")) for layer, v in variables.items()
    ]
    return wide.select(*on, part, F.inline(F.array(*rows)))


def _merged(tables: Mapping[str, DataFrame], part: str, periods: Sequence[int] | None, on: Sequence[str]) -> DataFrame:
    kept = {n: (t if periods is None else t.where(F.col(part).isin(list(periods)))) for n, t in tables.items()}
    return merge_products(kept, ["layer", *on, part], {n: "value" for n in kept})


def difference_maps(
    pred: DataFrame,
    products: Mapping[str, DataFrame],
    mask: DataFrame,
    part: str,
    periods: Sequence[int] | None = None,
    on: Sequence[str] = CELL,
) -> DataFrame:
    """Product minus prediction for every product, and the prediction, inside the region."""
    merged = _merged({"pred": pred, **products}, part, periods, on)
    diffs = merged.select(
        "layer", *on, part, "pred", *[(F.col(n) - F.col("pred")).alias(f"{n}_diff") for n in products]
    )
    return apply_mask(diffs, mask, ["pred", *[f"{n}_diff" for n in products]], on)


def difference_maps_of(maps: DataFrame, products: Sequence[str], mask: DataFrame, on: Sequence[str] = CELL) -> DataFrame:
    """As `difference_maps`, from one table that holds the prediction (`pred`) and the products side by side."""
    kept = [c for c in maps.columns if c not in products]
    diffs = maps.select(*kept, *[(F.col(n) - F.col("pred")).alias(f"{n}_diff") for n in products])
    return apply_mask(diffs, mask, ["pred", *[f"{n}_diff" for n in products]], on)


def side_by_side_maps(
    maps: Mapping[str, DataFrame], mask: DataFrame, part: str, periods: Sequence[int] | None = None, on: Sequence[str] = CELL
) -> DataFrame:
    """Several predictions of the same layers beside each other, inside the region."""
    return apply_mask(_merged(maps, part, periods, on), mask, list(maps), on)
