"""Table schemas, configuration values and column checks."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

STATION_DAILY = T.StructType([
    T.StructField("date_time", T.DateType()),
    T.StructField("soil_moisture", T.DoubleType()),
])

# Soil layer depth intervals in metres.
LAYER_DEPTHS = {
    "layer1": (0.0, 0.1),
    "layer2": (0.1, 0.3),
    "layer3": (0.3, 0.5),
    "layer4": (0.5, 0.8),
    "layer5": (0.8, 1.1),
}

# Product variable that stands for each soil layer.
ERA5_LAYER_VARS = {
    "layer1": "swvl1",
    "layer2": "swvl2",
    "layer3": "swvl3",
    "layer4": "swvl3",
    "layer5": "swvl3",
}
GLDAS_LAYER_VARS = {
    "layer1": "SoilMoi0_10cm_inst",
    "layer2": "SoilMoi10_40cm_inst",
    "layer3": "SoilMoi10_40cm_inst",
    "layer4": "SoilMoi40_100cm_inst",
    "layer5": "SoilMoi40_100cm_inst",
}
# Depths in centimetres pooled for each layer of the multi-depth product.
SMCI_LAYER_DEPTHS = {
    "layer2": (10, 20),
    "layer3": (30, 40),
    "layer4": (50, 60, 70),
    "layer5": (80, 90, 100),
}
# Divisors turning kg/m2 of a soil column into m3/m3, and the map scale.
GLDAS_SCALES = {
    "SoilMoi0_10cm_inst": 1 / 100,
    "SoilMoi10_40cm_inst": 1 / 300,
    "SoilMoi40_100cm_inst": 1 / 600,
}
SMCI_SCALE = 0.001

# Validity rules per variable.
VALIDITY_RULES = {
    "BD": {"missing_value": -999.0, "scale": 0.01},
    "CLAY": {"missing_value": -100.0},
    "GRAV": {"missing_value": -100.0},
    "SAND": {"missing_value": -100.0},
    "SILT": {"missing_value": -100.0},
    "LAND_COVER": {"valid_list": list(range(1, 25))},
    "MODIS_LAI": {"value_range": (0.0, 10.0)},
    "ERA5_LAND_lai_lv": {"min_val": 0.0},
    "ERA5_LAND_lai_hv": {"min_val": 0.0},
    "DEM": {"value_range": (-407.0, 8752.0), "missing_value": 9999.0},
}

# Recorded split seeds.
SPLIT_SEEDS = {
    ("spatial", "layer1"): 8126,
    ("spatial", "layer2"): 2390,
    ("spatial", "layer3"): 1078,
    ("spatial", "layer4"): 6457,
    ("spatial", "layer5"): 4894,
    ("temporal", "layer1"): 2834,
    ("temporal", "layer2"): 94,
    ("temporal", "layer3"): 4516,
    ("temporal", "layer4"): 2676,
    ("temporal", "layer5"): 8673,
}
ADVERSARIAL_SEEDS = {"layer1": 286, "layer2": 301, "layer3": 318, "layer4": 330, "layer5": 321}
CORRECTED_SEEDS = {"layer1": 97, "layer2": 335, "layer3": 53, "layer4": 184, "layer5": 197}


def config_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """The configuration as small tables (a few rows each, all fixed in this module)."""
    layers = spark.createDataFrame(
        [(name, low, high) for name, (low, high) in LAYER_DEPTHS.items()],
        "layer string, depth_from double, depth_to double",
    )
    products = spark.createDataFrame(
        [("ERA5", layer, name) for layer, name in ERA5_LAYER_VARS.items()]
        + [("GLDAS", layer, name) for layer, name in GLDAS_LAYER_VARS.items()],
        "product string, layer string, variable string",
    )
    depths = spark.createDataFrame(
        [(layer, depth) for layer, group in SMCI_LAYER_DEPTHS.items() for depth in group],
        "layer string, depth_cm int",
    )
    seeds = spark.createDataFrame(
        [("random", split, layer, seed) for (split, layer), seed in SPLIT_SEEDS.items()]
        + [("adversarial", None, layer, seed) for layer, seed in ADVERSARIAL_SEEDS.items()]
        + [("corrected", None, layer, seed) for layer, seed in CORRECTED_SEEDS.items()],
        "table string, split_method string, layer string, seed int",
    )
    rules = spark.createDataFrame(
        [
            (name, rule.get("missing_value"), rule.get("scale"), rule.get("valid_list"), *rule.get("value_range", (None, None)), rule.get("min_val"))
            for name, rule in VALIDITY_RULES.items()
        ],
        "variable string, missing_value double, scale double, valid_list array<int>, low double, high double, min_val double",
    )
    return {"layers": layers, "products": products, "depths": depths, "seeds": seeds, "rules": rules}


def require_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Same column set as `names`, or an error; columns come back in that order."""
    missing = [name for name in names if name not in df.columns]
    extra = [name for name in df.columns if name not in names]
    if missing or extra:
        raise ValueError(f"columns differ: missing {missing}, unexpected {extra}")
    return df.select(*names)


def drop_features(df: DataFrame, patterns: Iterable[str]) -> DataFrame:
    """Drop every column whose name contains one of `patterns`; order is kept."""
    wanted = list(patterns)
    return df.select(*[c for c in df.columns if not any(p in c for p in wanted)])


def rename(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))
