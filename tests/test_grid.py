import numpy as np
import pytest
from pyspark.sql import functions as F

from geoseries import schema
from geoseries.operators import compare, grid
from geoseries.operators.grid import Axis
from geoseries.plans import preparation
from geoseries.sources import grids as grid_files


def brute_nearest(values, x):
    half = abs(values[1] - values[0]) / 2
    if not min(values) - half <= x <= max(values) + half:
        return None
    return int(np.argmin([abs(v - x) for v in values]))


@pytest.mark.parametrize("axis", [Axis(25.0, 0.5, 5), Axis(27.0, -0.5, 5)])
def test_nearest_on_edges_and_ties(spark, axis):
    values = [axis.start + axis.step * i for i in range(axis.n)]
    points = [24.74, 24.75, 25.0, 25.25, 26.1, 26.75, 27.0, 27.25, 27.26]
    df = spark.createDataFrame([(p,) for p in points], "x double")
    got = df.select(axis.nearest(F.col("x")).alias("i"), grid.nearest_in_list(values, F.col("x")).alias("j")).collect()
    want = [brute_nearest(values, p) for p in points]
    assert [r.i for r in got] == want and [r.j for r in got] == want


def plane(spark, nulls=()):
    data = [(0, i, j, None if (i, j) in nulls else 1.0 + 2 * i + 3 * j + 0.5 * i * j) for i in range(4) for j in range(5)]
    return spark.createDataFrame(data, "time int, lat_i long, lon_i long, v double")


def test_bilinear_reproduces_a_plane(spark):
    src = (Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 5))
    new = (Axis(-0.5, 0.5, 9), Axis(0.25, 0.75, 7))
    for by in (["time"], []):
        got = grid.regrid_bilinear(plane(spark), *src, *new, ["v"], by=by).collect()
        assert len(got) == 63
        for r in got:
            inside = 0 <= r.lat <= 3 and 0 <= r.lon <= 4
            want = 1 + 2 * r.lat + 3 * r.lon + 0.5 * r.lat * r.lon
            assert (r.v == pytest.approx(want)) if inside else r.v is None


def test_bilinear_on_own_points_and_null_corners(spark):
    axes = (Axis(0.0, 1.0, 4), Axis(0.0, 1.0, 5))
    same = grid.regrid_bilinear(plane(spark), *axes, *axes, ["v"]).collect()
    assert all(r.v == pytest.approx(1 + 2 * r.lat + 3 * r.lon + 0.5 * r.lat * r.lon) for r in same)
    holed = grid.regrid_bilinear(plane(spark, {(1, 1)}), *axes, Axis(0.5, 1.0, 3), Axis(0.5, 1.0, 4), ["v"]).collect()
    assert {(r.lat_i, r.lon_i) for r in holed if r.v is None} == {(0, 0), (0, 1), (1, 0), (1, 1)}


def test_regrid_returns_every_target_and_splits_one_slice(spark):
    axes = (Axis(0.0, 1.0, 60), Axis(3.0, -0.05, 60))
    part = spark.range(2).select(F.lit(0).alias("time"), F.col("id").alias("lat_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(59).cast("long"))).alias("lon_i"), F.lit(1.0).alias("v"))
    got = grid.regrid_bilinear(part, *axes, Axis(-1.0, 0.5, 100), Axis(0.0, 0.1, 50), ["v"])
    assert got.count() == 100 * 50
    known = got.where("v is not null")
    assert known.agg(F.min("lat"), F.max("lat"), F.min("v"), F.max("v")).first() == (0.0, 0.5, pytest.approx(1.0), pytest.approx(1.0))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(time#" in plan and "lat_i#" in plan.split("hashpartitioning(time#")[-1].split(")")[0]
    assert "Join" not in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        tasks = got.select(F.spark_partition_id().alias("p")).distinct().count()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert tasks > 1


def test_dense_round_trip(spark):
    df = spark.createDataFrame([(0, 0, 1, 5.0), (0, 2, 0, 6.0), (1, 1, 1, None)], "time int, lat_i long, lon_i long, v double")
    dense = grid.rows_to_grid(df, "v", 3, 2)
    assert dense.count() == 6
    back = grid.grid_to_rows(dense, "cells", "v", ["time", "lat_i"])
    assert back.count() == 12
    assert {(r.time, r.lat_i, r.lon_i, r.v) for r in back.where("v is not null").collect()} == {(0, 0, 1, 5.0), (0, 2, 0, 6.0)}


def test_global_grid(spark):
    g = grid.global_grid(spark, 181, 360)
    got = g.agg(F.count("*"), F.min("lat"), F.max("lat"), F.min("lon"), F.max("lon")).first()
    assert tuple(got) == (181 * 360, -90.0, 90.0, -180.0, 179.0)
    assert g.where("lon_i = 180 and lat_i = 0").first().lon == -180.0


def test_group_average_single_and_shared(spark, rows):
    meta = spark.createDataFrame([(1, 25.0, 75.0), (2, 25.1, 75.1), (3, 26.0, 75.0), (4, 99.0, 75.0)], "station_id long, latitude double, longitude double")
    obs = spark.createDataFrame(
        [(1, "2000-01-01", 1.0), (2, "2000-01-01", 3.0), (1, "1999-01-01", 5.0), (2, "2000-01-02", None),
         (3, "1999-12-31", 7.0), (3, "2000-01-01", 8.0), (3, "2000-01-02", None), (4, "2000-01-01", 9.0)],
        "station_id long, d string, sm double",
    ).withColumn("d", F.to_date("d"))
    axes = (Axis(25.0, 0.5, 4), Axis(75.0, 0.5, 2))
    got = grid.grid_average(obs, meta, "station_id", "d", "sm", *axes).withColumn("d", F.col("d").cast("string"))
    assert rows(got, "station_id", "group_id", "d", "sm") == [
        (1, 0, "1999-01-01", 5.0), (1, 0, "2000-01-01", 2.0), (2, 0, "1999-01-01", 5.0), (2, 0, "2000-01-01", 2.0),
        (3, 1, "2000-01-01", 8.0), (3, 1, "2000-01-02", None),
    ]


def test_merge_mask_and_equality(spark, rows):
    a = spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "lat_i int, lon_i int, v double")
    c = spark.createDataFrame([(0, 1, 20.0), (1, 1, 30.0)], "lat_i int, lon_i int, w double")
    merged = grid.merge_products({"a": a, "c": c}, ["lat_i", "lon_i"], {"a": "v", "c": "w"})
    assert rows(merged) == [(0, 0, 1.0, None), (0, 1, 2.0, 20.0), (1, 1, None, 30.0)]
    mask = spark.createDataFrame([(0, 0, 1.0), (0, 1, None)], "lat_i int, lon_i int, band1 double")
    assert rows(grid.apply_mask(a, mask, ["v"])) == [(0, 0, 1.0), (0, 1, None)]
    assert rows(grid.same_coordinates(a, c, ["lat_i", "lon_i"])) == [(0, 0, "left"), (1, 1, "right")]
    assert grid.same_coordinates(a, a, ["lat_i", "lon_i"]).count() == 0


def test_soil_profile_orders_differ(spark):
    data = [(d, i, j, -999.0 if (i, j) == (0, 0) else 2.0) for d in range(2) for i in range(2) for j in range(2)]
    soil = spark.createDataFrame(data, "depth int, lat_i long, lon_i long, BD double")
    src = (Axis(0.0, 1.0, 2), Axis(0.0, 1.0, 2))
    new = (Axis(0.5, 1.0, 1), Axis(0.5, 1.0, 1))
    clean = preparation.soil_profile_mean(soil, {"BD": -999.0}, src, new, order="clean").first()
    ref = preparation.soil_profile_mean(soil, {"BD": -999.0}, src, new, order="ref").first()
    assert clean.BD is None and ref.BD == pytest.approx((-999 + 6) / 4)


def test_layers_and_profile(spark):
    df = spark.createDataFrame([(0.0, 0.1), (0.05, 0.2), (0.8, 1.1), (1.0, 2.0)], "a double, b double")
    assert [r[0] for r in df.select(compare.assign_layer(F.col("a"), F.col("b"))).collect()] == ["layer1", None, "layer5", None]
    file, level = compare.profile_position(F.col("id"))
    got = [tuple(r) for r in spark.range(1, 9).select(file, level).collect()]
    assert got == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1), (2, 2), (2, 3)]


def test_reconcile(spark):
    raw = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, None), (4, 1.0)], "k int, v double")
    stored = spark.createDataFrame([(1, 1.0), (2, 2.5), (3, None), (5, 1.0)], "k int, v double")
    got = {r.k: r.status for r in compare.reconcile(raw, stored, ["k"], "v").collect()}
    assert got == {1: "match", 2: "differs", 3: "match", 4: "not stored", 5: "not in raw"}


def test_grid_files_are_pruned(spark, tmp_path):
    df = spark.createDataFrame([(0, 0, f"200{y}-0{m}-01", 1.0) for y in range(3) for m in range(1, 5)], "lat_i int, lon_i int, time string, v double")
    path = str(tmp_path / "g")
    grid_files.write_grid(df.withColumn("time", F.to_date("time")), path)
    read = grid_files.read_grid(spark, path, years=[2001], months=[2, 3])
    assert read.count() == 2
    plan = read._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [(year" in plan or "PartitionFilters: [isnotnull(year" in plan or "PartitionFilters: [year" in plan


def test_accumulation_covariates(spark):
    df = spark.range(40).select(
        F.lit(0).alias("lat_i"), F.lit(0).alias("lon_i"), F.date_add(F.lit("2000-01-01").cast("date"), F.col("id").cast("int")).alias("time"),
        F.lit(1.0).alias("tp"),
    )
    got = {str(r.time): (r.tp_sum7, r.tp_sum28) for r in preparation.accumulations(df).collect()}
    assert min(got) == "1999-12-31"
    assert got["2000-01-05"] == (None, None) and got["2000-01-06"] == (7.0, None) and got["2000-01-27"] == (7.0, 28.0)


def test_leaf_area_and_land_surface(spark):
    lai = spark.createDataFrame(
        [(2000, doy, i, j, float(doy)) for doy in (1, 9) for i in range(2) for j in range(2)], "year int, doy int, lat_i long, lon_i long, lai double"
    )
    src = (Axis(0.0, 1.0, 2), Axis(0.0, 1.0, 2))
    got = preparation.leaf_area(lai, src, (Axis(0.5, 1.0, 1), Axis(0.5, 1.0, 1))).sort("time").collect()
    assert [r.lai for r in got] == [float(x) for x in range(1, 10)]
    hourly = spark.createDataFrame(
        [(f"2000-01-01 {h:02d}:00:00", i, j, 30.0) for h in (0, 3) for i in range(2) for j in range(2)], "time string, lat_i long, lon_i long, SoilMoi0_10cm_inst double"
    ).withColumn("time", F.col("time").cast("timestamp_ntz"))
    out = preparation.land_surface(hourly, {"SoilMoi0_10cm_inst": schema.GLDAS_SCALES["SoilMoi0_10cm_inst"]}, src, (Axis(0.5, 1.0, 1), Axis(0.5, 1.0, 1))).collect()
    assert len(out) == 1 and out[0].SoilMoi0_10cm_inst == pytest.approx(0.3)


def test_target_cells_are_filled_in_many_tasks(spark):
    """A table of few slices lies in one task; the cells of the target grid must not."""
    slices = spark.createDataFrame([(1,), (None,)], "time int").coalesce(1)
    cells = grid.target_cells(slices, Axis(0.0, 1.0, 5), Axis(0.0, 1.0, 700))
    assert cells.distinct().count() == 2 * 5 * 700
    tasks = [r["count"] for r in cells.groupBy(F.spark_partition_id()).count().collect()]
    assert max(tasks) <= 2 * grid.CELLS


def test_blocks_of_neighbours_meet_at_their_edges(spark):
    n = 3 * grid.SIDE
    cell = [F.lit(0).alias("time"), (F.col("id") % 2).alias("lat_i"), F.expr("id div 2").alias("lon_i"), (F.col("id") * 1.0).alias("v")]
    src, new = (Axis(0.0, 1.0, 2), Axis(0.0, 1.0, n)), (Axis(0.5, 1.0, 1), Axis(0.5, 1.0, n - 1))
    got = grid.regrid_bilinear(spark.range(n * 2).repartition(16).select(*cell), *src, *new, ["v"])
    assert [r.v for r in got.sort("lon_i").collect()] == [2.0 * j + 1.5 for j in range(n - 1)]


def test_monthly_depths_regrid_every_day(spark, tmp_path, monkeypatch):
    """A cell with a gap on one day takes only the other days; quarters would mix the days of all corners first."""
    from geoseries.suite import bindings, jobs

    days = [("2020-01-01", {0: 1.0, 1: 1.0, 5: 1.0, 6: 1.0}), ("2020-01-02", {0: 9.0, 1: 9.0, 5: 9.0}), ("2020-02-01", {6: 5.0})]
    lines = [(c, 1, d, v / 5000, 1, 1.0, 1.0, 1.0) for d, cells in days for c, v in cells.items()]
    kinds = "l_suppkey long, l_partkey long, l_shipdate string, l_tax double, l_linenumber int, l_quantity double, l_discount double, l_extendedprice double"
    tables = {"lineitem": spark.createDataFrame(lines, kinds), "part": spark.createDataFrame([(1, 10)], "p_partkey long, p_size int")}
    monkeypatch.setattr(bindings, "table", lambda spark, sf, name: tables[name])
    got = {(r["lat_i"], r["lon_i"], r["month"]): r["SMCI"] for r in jobs.depths_monthly(spark, "").collect()}
    assert len(got) == 5 * 2 * 2 and got[0, 0, 1] == pytest.approx(1.0)
    assert {k for k, v in got.items() if v is not None} == {(0, 0, 1)}
