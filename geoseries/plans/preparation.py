"""Covariate and station preparation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoseries.functions.calendar import day_number, month_indicators, previous_day, year_doy_date
from geoseries.functions.values import null_sentinel
from geoseries.operators.clean import mask_quality, scale
from geoseries.operators.grid import Axis, climatology_depths, depth_mean, extract_points, grid_average, one_slice_each, regrid_bilinear
from geoseries.operators.metrics import standardize
from geoseries.operators.series import fill_days, interpolate_linear, resample_daily, rolling_sum, sequence_windows, upsample_daily
from geoseries.operators.splits import dedup_groups

CELL = ["lat_i", "lon_i"]


def station_series(raw: DataFrame, meta: DataFrame, lat_axis: Axis, lon_axis: Axis) -> DataFrame:
    """Raw samples to daily series, averaged over the stations of a grid cell."""
    masked = mask_quality(raw, "soil_moisture", "soil_moisture_flag")
    daily = resample_daily(masked, ["station_id"], "ts", ["soil_moisture"])
    return grid_average(daily, meta, "station_id", "date_time", "soil_moisture", lat_axis, lon_axis)


def one_per_group(series: DataFrame, stations: DataFrame, check_empty: Sequence[str]) -> DataFrame:
    """Keeps one station per group and source. `stations`: station_id, group_id, source."""
    rows = series.groupBy("station_id").agg(F.count(F.lit(1)).alias("n_rows"))
    counted = stations.join(rows, "station_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    kept = dedup_groups(counted, "group_id", "station_id", "source", "n_rows", check_empty)
    return series.join(kept.select("station_id", "source"), "station_id")


def accumulations(daily: DataFrame, col: str = "tp", by: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Totals stamped at the end of their day move back one day; 7 and 28 day sums are added."""
    shifted = daily.withColumn(time, previous_day(F.col(time)))
    week = rolling_sum(shifted, by, time, col, 7)
    return rolling_sum(week, by, time, col, 28)


def instantaneous(hourly: DataFrame, cols: Sequence[str], by: Sequence[str] = CELL, time: str = "time") -> DataFrame:
    """Daily means in which midnight closes the previous day."""
    return resample_daily(hourly, by, time, cols, closed="right", drop_empty=False, name="time")


def land_surface(
    hourly: DataFrame, factors: Mapping[str, float], source: tuple[Axis, Axis], target: tuple[Axis, Axis], time: str = "time", order: str = "ref"
) -> DataFrame:
    """Daily means on the target grid, scaled to volumetric units.

    `order="ref"` regrids every moment and averages days after it, so an hour in which a corner is missing is left out of the
    day's mean. `order="days"` averages first and regrids one field a day instead of one an hour: the same where no sample is missing.
    """
    cols = list(factors)
    if order == "days":
        daily = resample_daily(hourly, CELL, time, cols, drop_empty=False, name="time")
        return scale(regrid_bilinear(daily, *source, *target, cols), factors)
    if order != "ref":
        raise ValueError("order must be 'ref' or 'days'")
    regridded = regrid_bilinear(hourly, *source, *target, cols, by=[time])
    return scale(resample_daily(regridded, CELL, time, cols, drop_empty=False, name="time"), factors)


def regridded_depths(
    product: DataFrame, col: str, layers: Mapping[str, Sequence[int]], source: tuple[Axis, Axis], target: tuple[Axis, Axis], part: str, time: str = "time"
) -> DataFrame:
    """Calendar means per layer of a product with many depths, brought to the target grid depth by depth first.

    A target cell that no slice of a mean has a value for is null in it, so one slice of each mean holds every cell.
    """
    whole = one_slice_each(product, time, "depth", layers, part)
    regridded = regrid_bilinear(product, *source, *target, [col], by=[time, "depth"], whole=whole)
    return climatology_depths(regridded, time, col, "depth", layers, CELL, part)


def leaf_area(
    composites: DataFrame, source: tuple[Axis, Axis], target: tuple[Axis, Axis], year: str = "year", doy: str = "doy", col: str = "lai"
) -> DataFrame:
    """Eight-day composites on the target grid, interpolated to days across all years."""
    dated = composites.withColumn("time", year_doy_date(F.col(year), F.col(doy)))
    regridded = regrid_bilinear(dated, *source, *target, [col]).where(F.col(col).isNotNull())
    return upsample_daily(regridded, CELL, "time", [col])


def soil_profile_mean(
    profile: DataFrame,
    sentinels: Mapping[str, float],
    source: tuple[Axis, Axis],
    target: tuple[Axis, Axis],
    order: str = "ref",
) -> DataFrame:
    """Depth means of soil properties on the target grid.

    `order="ref"` removes the missing markers after interpolating, so that cells blended from a marker and a value survive;
    `order="clean"` before it.
    """
    cols = list(sentinels)
    if order == "clean":
        profile = profile.withColumns({c: null_sentinel(F.col(c), s) for c, s in sentinels.items()})
    elif order != "ref":
        raise ValueError("order must be 'clean' or 'ref'")
    regridded = regrid_bilinear(profile, *source, *target, cols, by=["depth"])
    return depth_mean(regridded, sentinels, CELL)


def station_features(
    series: DataFrame, meta: DataFrame, static: DataFrame, dynamic: DataFrame, lat_axis: Axis, lon_axis: Axis, cols: Sequence[str]
) -> DataFrame:
    """Daily station values beside the covariates of their grid cell."""
    at_station = extract_points(meta, dynamic.join(static, CELL), "station_id", "latitude", "longitude", lat_axis, lon_axis)
    covariates = at_station.select("station_id", F.col("time").alias("date_time"), *cols)
    return series.join(covariates, ["station_id", "date_time"])


def sequence_samples(
    stations: DataFrame, features: Sequence[str], label: str, length: int, station: str = "station_id", time: str = "date_time"
) -> DataFrame:
    """Training sequences: missing days filled and marked, features standardized, month columns, sliding windows.

    Each step holds the date, the scaled features, the twelve month indicators, `Is_valid` and the label.
    """
    cols = [*features, label]
    filled = fill_days(stations.select(station, time, *cols), [station], time, cols)
    whole = interpolate_linear(filled, [station], day_number(F.col(time)), cols)
    months = month_indicators(F.col(time))
    scaled = standardize(whole, features).withColumns(months)
    steps = [time, *features, *months, "Is_valid", label]
    return sequence_windows(scaled, [station], day_number(F.col(time)), steps, length)
