"""Value rules on single columns: quality masks, sentinels, ranges, scaling, recoding."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def nan_to_null(value: Column) -> Column:
    return F.when(~F.isnan(value), value)


def is_missing(name: str, kind: str) -> Column:
    """Null, or NaN in a floating column."""
    missing = F.col(name).isNull()
    return missing | F.isnan(name) if kind in ("double", "float") else missing


def qc_mask(value: Column, flag: Column, good: str = "G") -> Column:
    """Null unless flagged good; a missing flag also masks."""
    return F.when(flag == good, value)


def null_sentinel(value: Column, sentinel: float) -> Column:
    return F.nullif(value, F.lit(sentinel))


def apply_rule(value: Column, rule: Mapping) -> Column:
    """One validity rule: missing marker, allowed list, closed range, lower bound, then scale."""
    keep = F.lit(True)
    if "missing_value" in rule:
        keep = keep & (value != rule["missing_value"])
    if "valid_list" in rule:
        keep = keep & value.isin(list(rule["valid_list"]))
    if "value_range" in rule:
        low, high = rule["value_range"]
        keep = keep & value.between(low, high)
    if "min_val" in rule:
        keep = keep & (value >= rule["min_val"])
    scaled = value * F.lit(rule["scale"]) if "scale" in rule else value
    return F.when(keep, scaled)


def clip(value: Column, low: float, high: float) -> Column:
    return F.when(value.isNotNull(), F.least(F.greatest(value, F.lit(low)), F.lit(high)))


def recode(value: Column, names: Mapping) -> Column:
    """Dictionary lookup; a value outside the dictionary becomes null."""
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), value)


def wrap_longitude(lon: Column) -> Column:
    return F.when(lon >= 180.0, lon - F.lit(360.0)).otherwise(lon)


def path_part(path: Column, position: int, separator: str) -> Column:
    """Part of a path or name; negative positions count from the end."""
    return F.try_element_at(F.split(path, separator), F.lit(position))
