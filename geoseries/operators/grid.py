"""Grid axes, nearest-cell lookup, bilinear regridding, dense forms, climatologies."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.operators.ranking import chunked_rank
from geoseries.session import stable

#: Source cells of a block along a latitude circle, and target cells dealt to a task at a time.
SIDE, CELLS = 64, 256
#: Calendar parts that means are taken over.
CALENDAR = {"month": F.month, "year": F.year}

@dataclass(frozen=True)
class Axis:
    """Regularly spaced coordinate axis; `step` may be negative."""

    start: float
    step: float
    n: int

    @property
    def low(self) -> float:
        return min(self.start, self.start + self.step * (self.n - 1))

    @property
    def high(self) -> float:
        return max(self.start, self.start + self.step * (self.n - 1))

    def value(self, index: Column) -> Column:
        return F.lit(float(self.start)) + F.lit(float(self.step)) * index

    def table(self, spark: SparkSession, index: str, value: str) -> DataFrame:
        return spark.range(self.n).select(F.col("id").alias(index), self.value(F.col("id")).alias(value))

    def nearest(self, x: Column) -> Column:
        """Index of the closest point, lowest index on a tie, null beyond half a cell."""
        half = abs(self.step) / 2
        place = (x - F.lit(float(self.start))) / F.lit(float(self.step))
        index = F.ceil(place - F.lit(0.5))
        inside = x.between(self.low - half, self.high + half)
        return F.when(inside, F.greatest(F.least(index, F.lit(self.n - 1)), F.lit(0)).cast("long"))

    def lower(self, x: Column) -> Column:
        """Index of the cell [lower, lower + 1] holding x (clamped to the axis)."""
        place = F.floor((x - F.lit(float(self.start))) / F.lit(float(self.step)))
        return F.greatest(F.least(place, F.lit(self.n - 2)), F.lit(0)).cast("long")

    def inside(self, x: Column) -> Column:
        return x.between(self.low, self.high)


def nearest_in_list(values: Sequence[float], x: Column) -> Column:
    """Nearest index on an irregular axis (edge cells as wide as the first spacing)."""
    half = abs(values[1] - values[0]) / 2
    axis = F.array(*[F.lit(float(v)) for v in values])
    gaps = F.transform(axis, lambda v, i: F.struct(F.abs(v - x).alias("gap"), i.cast("long").alias("i")))
    return F.when(x.between(min(values) - half, max(values) + half), F.array_min(gaps)["i"])


def nearest_cell(points: DataFrame, lat: str, lon: str, lat_axis: Axis, lon_axis: Axis) -> DataFrame:
    """Adds `lat_i`, `lon_i`; both are null for a point off the grid on that axis."""
    return points.withColumns({"lat_i": lat_axis.nearest(F.col(lat)), "lon_i": lon_axis.nearest(F.col(lon))})


def extract_points(
    stations: DataFrame, grid: DataFrame, station: str, lat: str, lon: str, lat_axis: Axis, lon_axis: Axis
) -> DataFrame:
    """All times of the grid cell nearest to each station; stations off the grid drop out."""
    placed = nearest_cell(stations.select(station, lat, lon), lat, lon, lat_axis, lon_axis).where(
        F.col("lat_i").isNotNull() & F.col("lon_i").isNotNull()
    )
    return grid.join(placed.select(station, "lat_i", "lon_i"), ["lat_i", "lon_i"])


def _corner_of(source: Axis, target: Axis, index: str) -> Column:
    """Targets that the source point `index` is a corner of: array of (target index, weight), by arithmetic alone."""
    here = F.col(index)

    def place(x: Column) -> Column:
        return (x - F.lit(float(target.start))) / F.lit(float(target.step))

    # Targets between the two neighbours of the source point, one more on either side against rounding.
    ends = [place(source.value(here - 1)), place(source.value(here + 1))]
    low = F.greatest(F.floor(F.least(*ends)) - 1, F.lit(0))
    high = F.least(F.ceil(F.greatest(*ends)) + 1, F.lit(target.n - 1))
    near = F.when(low <= high, F.sequence(low.cast("long"), high.cast("long"))).otherwise(F.array().cast("array<bigint>"))

    def weigh(i: Column) -> Column:
        x = target.value(i)
        lower = source.lower(x)
        share = F.when(source.inside(x), (x - source.value(lower)) / F.lit(float(source.step)))
        weight = F.when(lower == here, F.lit(1.0) - share).when(lower + 1 == here, share)
        return F.struct(i.alias("i"), weight.alias("w"))

    return F.filter(F.transform(near, weigh), lambda c: c["w"].isNotNull())


def target_cells(slices: DataFrame, lat: Axis, lon: Axis) -> DataFrame:
    """Every cell of the axes for every row of `slices`. Blocks of `CELLS` cells are dealt to the tasks, however few the slices are."""
    n = lat.n * lon.n
    starts = F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"), F.lit(CELLS).cast("long"))
    blocks = slices.select("*", F.explode(starts).alias("_start")).repartition(max(1, min(-(-n // CELLS), 4096)))
    cells = blocks.select(*slices.columns, F.explode(F.sequence("_start", F.least(F.col("_start") + CELLS, F.lit(n)) - 1)).alias("_cell"))
    return cells.select(*slices.columns, F.expr(f"_cell div {lon.n}").alias("lat_i"), (F.col("_cell") % lon.n).alias("lon_i"))


def regrid_bilinear(
    src: DataFrame,
    lat_axis: Axis,
    lon_axis: Axis,
    new_lat: Axis,
    new_lon: Axis,
    cols: Sequence[str],
    by: Sequence[str] = ("time",),
    whole: DataFrame | None = None,
) -> DataFrame:
    """Bilinear values on new axes for every slice of `by` and every target cell; null outside the source or where any
    corner is missing.

    With `whole`, some slices of `by`, only these have every target cell, the others the cells that a source cell reaches.

    The targets a source cell is a corner of are an index range found by arithmetic. Each cell sends its weighted values to
    them, and the sums are shuffled by slice and target cell, so a slice is spread over all tasks. Source cells meet in blocks
    of neighbours first, where most of the four corners of a target are summed before the shuffle. Rows of the empty
    target grid join the sums, so that no target is left out. `src` holds `lat_i`, `lon_i`.
    """
    near = src.select(*by, *cols, "lat_i", "lon_i").repartition(*by, F.floor(F.col("lon_i") / SIDE))
    sent = (
        near.select(*by, *cols, F.explode(_corner_of(lat_axis, new_lat, "lat_i")).alias("_lat"), "lon_i")
        .select(*by, *cols, "_lat", F.explode(_corner_of(lon_axis, new_lon, "lon_i")).alias("_lon"))
        .select(*by, F.col("_lat.i").alias("lat_i"), F.col("_lon.i").alias("lon_i"), *[(F.col("_lat.w") * F.col("_lon.w") * F.col(c)).alias(c) for c in cols])
    )
    slices = whole
    if slices is None:
        slices = src.select(*by).distinct() if by else src.sparkSession.range(1).select()
    empty = target_cells(slices, new_lat, new_lon).select("*", *[F.lit(None).cast("double").alias(c) for c in cols])
    summed = (
        sent.unionByName(empty)
        .groupBy(*by, "lat_i", "lon_i")
        .agg(*[F.sum(c).alias(c) for c in cols], *[F.count(c).alias(f"_n_{c}") for c in cols])
    )
    return summed.select(
        *by,
        "lat_i",
        "lon_i",
        new_lat.value(F.col("lat_i")).alias("lat"),
        new_lon.value(F.col("lon_i")).alias("lon"),
        *[F.when(F.col(f"_n_{c}") == 4, F.col(c)).alias(c) for c in cols],
    )


def global_grid(spark: SparkSession, n_lat: int = 1801, n_lon: int = 3600) -> DataFrame:
    """Regular global grid; longitudes from 180 on are wrapped to the west."""
    lon = F.col("lon_i") * F.lit(360.0 / n_lon)
    return (
        spark.range(n_lat * n_lon)
        .select(F.floor(F.col("id") / n_lon).alias("lat_i"), (F.col("id") % n_lon).alias("lon_i"))
        .select(
            "lat_i",
            "lon_i",
            (F.lit(-90.0) + F.col("lat_i") * F.lit(180.0 / (n_lat - 1))).alias("lat"),
            F.when(lon >= 180.0, lon - F.lit(360.0)).otherwise(lon).alias("lon"),
        )
    )


def rows_to_grid(df: DataFrame, value: str, n_lat: int, n_lon: int, by: Sequence[str] = ("time",)) -> DataFrame:
    """Dense latitude rows: one array of `n_lon` values per key and latitude, absent cells null.

    An array holds one latitude circle, so its size is the length of the longitude axis.
    """
    # Cells outside the axes only tell that their slice exists; slices come from the lines, so the input is read once.
    inside = F.col("lon_i").between(0, n_lon - 1) & F.col("lat_i").between(0, n_lat - 1)
    cell = F.when(inside, F.struct(F.col("lon_i").cast("long").alias("i"), F.col(value).alias("v")))
    lines = df.groupBy(*by, F.when(inside, F.col("lat_i").cast("long")).alias("lat_i")).agg(F.collect_list(cell).alias("_cells"))
    slices = lines.select(*by).distinct() if by else df.sparkSession.range(1).select()
    every = slices.select(*by, F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_lat - 1).cast("long"))).alias("lat_i"))
    kind = dict(df.dtypes)[value]
    axis = F.sequence(F.lit(0).cast("long"), F.lit(n_lon - 1).cast("long"))
    present = F.coalesce("_cells", F.array().cast(f"array<struct<i:bigint,v:{kind}>>"))
    absent = F.transform(
        F.array_except(axis, F.transform(present, lambda c: c["i"])),
        lambda i: F.struct(i.alias("i"), F.lit(None).cast(kind).alias("v")),
    )
    dense = F.transform(F.sort_array(F.concat(present, absent)), lambda c: c["v"])
    return every.join(lines, [*by, "lat_i"], "left").select(*by, "lat_i", dense.alias("cells"))


def grid_to_rows(df: DataFrame, cells: str, value: str, keep: Sequence[str]) -> DataFrame:
    """One row per cell of a latitude array; null cells are kept."""
    return df.select(*keep, F.posexplode(cells).alias("lon_i", value))


def join_static(grids: Sequence[DataFrame], on: Sequence[str] = ("lat_i", "lon_i")) -> DataFrame:
    return reduce(lambda left, right: left.join(right, list(on)), grids)


def assemble_features(
    static: Sequence[DataFrame], dynamic: Sequence[DataFrame], on: Sequence[str] = ("lat_i", "lon_i"), time: str = "time"
) -> DataFrame:
    """Inner join of all covariates for every day at once.

    Dynamic tables meet on (time, cell) first, so each is shuffled once; the static table
    joins last and is broadcast by size.
    """
    moving = reduce(lambda left, right: left.join(right, [time, *on]), dynamic)
    return moving.join(join_static(static, on), list(on))


def merge_products(products: Mapping[str, DataFrame], on: Sequence[str], cols: Mapping[str, str]) -> DataFrame:
    """Outer merge of products on coordinates, one row per coordinate.

    `cols` names each product's value column. Products are stacked and pivoted in one
    shuffle instead of a chain of full outer joins; coordinates are unique per product.
    """
    names = list(products)
    stacked = [
        df.select(*on, *[(F.col(cols[n]).cast("double") if n == name else F.lit(None).cast("double")).alias(n) for n in names])
        for name, df in products.items()
    ]
    return reduce(DataFrame.unionByName, stacked).groupBy(*on).agg(*[F.max(n).alias(n) for n in names])


def same_coordinates(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Coordinates found on one side only; empty when the grids agree."""
    a = left.select(*cols).withColumn("_side", F.lit(1))
    b = right.select(*cols).withColumn("_side", F.lit(2))
    sides = a.unionByName(b).groupBy(*cols).agg(F.max(F.col("_side") == 1).alias("_l"), F.max(F.col("_side") == 2).alias("_r"))
    return sides.where(F.col("_l") != F.col("_r")).select(
        *cols, F.when(F.col("_l"), "left").otherwise("right").alias("only_in")
    )


def climatology(df: DataFrame, time: str, cols: Sequence[str], by: Sequence[str], part: str) -> DataFrame:
    """Mean over all days of a calendar month of every year, or over all days of a year."""
    return df.groupBy(*by, CALENDAR[part](time).alias(part)).agg(*[F.avg(c).alias(c) for c in cols])


def climatology_depths(
    df: DataFrame, time: str, col: str, depth: str, layers: Mapping[str, Sequence[int]], by: Sequence[str], part: str
) -> DataFrame:
    """Depths of a layer pooled with time. A depth may belong to one layer only."""
    placed = df.withColumn("layer", layer_of_depth(depth, layers)).where(F.col("layer").isNotNull())
    return climatology(placed, time, [col], ["layer", *by], part)


def layer_of_depth(depth: str, layers: Mapping[str, Sequence[int]]) -> Column:
    return F.coalesce(*[F.when(F.col(depth).isin(list(group)), F.lit(name)) for name, group in layers.items()])


def one_slice_each(df: DataFrame, time: str, depth: str, layers: Mapping[str, Sequence[int]], part: str) -> DataFrame:
    """`time`, `depth` of one slice for each layer and calendar part that `climatology_depths` gives."""
    keys = [layer_of_depth(depth, layers).alias("_layer"), CALENDAR[part](time).alias("_part")]
    first = df.select(time, depth).distinct().groupBy(*keys).agg(F.min(F.struct(time, depth)).alias("_s"))
    return first.where(F.col("_layer").isNotNull()).select(f"_s.{time}", f"_s.{depth}")


def time_mean(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(c).alias(c) for c in cols])


def depth_mean(df: DataFrame, cols: Mapping[str, float], by: Sequence[str]) -> DataFrame:
    """Mean over depth per cell after turning each column's sentinel into null."""
    return df.groupBy(*by).agg(*[F.avg(F.nullif(F.col(c), F.lit(s))).alias(c) for c, s in cols.items()])


def cell_groups(meta: DataFrame, station: str, lat: str, lon: str, lat_axis: Axis, lon_axis: Axis) -> DataFrame:
    """Station, cell, 0-based group number (cells by latitude, longitude) and group size."""
    placed = nearest_cell(meta.select(station, lat, lon), lat, lon, lat_axis, lon_axis).where(
        F.col("lat_i").isNotNull() & F.col("lon_i").isNotNull()
    )
    cells = stable(placed.groupBy("lat_i", "lon_i").agg(F.count(F.lit(1)).alias("members")))
    lat_order = F.col("lat_i") if lat_axis.step > 0 else -F.col("lat_i")
    lon_order = F.col("lon_i") if lon_axis.step > 0 else -F.col("lon_i")
    numbered = chunked_rank(cells, [], [lat_order, lon_order], None, "group_id")
    return placed.select(station, "lat_i", "lon_i").join(
        numbered.withColumn("group_id", F.col("group_id") - 1), ["lat_i", "lon_i"]
    )


def grid_average(
    daily: DataFrame,
    meta: DataFrame,
    station: str,
    time: str,
    value: str,
    lat_axis: Axis,
    lon_axis: Axis,
    start: str = "2000-01-01",
    end: str = "2022-12-31",
    lat: str = "latitude",
    lon: str = "longitude",
) -> DataFrame:
    """Stations sharing a cell get the mean of their daily series.

    A station alone in its cell keeps its rows inside [start, end]; shared cells drop
    empty days but are not limited in time. `daily` has one row per station and day; it is
    joined and aggregated once, and the mean is given to all stations of the cell at the end.
    """
    groups = cell_groups(meta, station, lat, lon, lat_axis, lon_axis).select(station, "group_id", "members")
    cells = groups.groupBy("group_id", "members").agg(F.sort_array(F.collect_set(station)).alias("_stations"))
    members = cells.select("*", F.explode("_stations").alias(station))
    means = daily.select(station, time, value).join(members, station).groupBy("group_id", "members", time).agg(
        F.avg(value).alias(value), F.first("_stations").alias("_stations")
    )
    alone = F.col("members") == 1
    kept = means.where((alone & F.col(time).between(start, end)) | (~alone & F.col(value).isNotNull()))
    return kept.select(F.explode("_stations").alias(station), "group_id", time, value)


def apply_mask(df: DataFrame, mask: DataFrame, cols: Sequence[str], on: Sequence[str] = ("lat_i", "lon_i"), band: str = "band1") -> DataFrame:
    """Multiply by the mask value of the cell; null where the mask is null or has no cell."""
    joined = df.join(mask.select(*on, band), list(on), "left")
    return joined.withColumns({c: F.col(c) * F.col(band) for c in cols}).drop(band)


def lat_window(df: DataFrame, lat: str, low: float = 25.0, high: float = 42.5) -> DataFrame:
    return df.where(F.col(lat).between(low, high))
