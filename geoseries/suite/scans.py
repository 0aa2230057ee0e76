"""Sources, sinks, projections and filters."""

from __future__ import annotations

import os
import re
from datetime import date

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import functions as F

from geoseries import schema
from geoseries.functions.values import clip, recode, wrap_longitude
from geoseries.operators import clean, grid, metrics, series
from geoseries.operators.compare import assign_layer
from geoseries.session import scratch_path, stable
from geoseries.sources import grids, stations
from geoseries.suite import bindings as b
from geoseries.suite.registry import query


@query("s01_station_scan", """SELECT station_id, 'layer' || (1 + station_id % 5) AS layer, date_time, soil_moisture
    FROM station_daily""", floats="soil_moisture", dates="date_time")
def station_scan(spark, sf):
    path = scratch_path(spark, "stations")
    layered = b.station_daily(spark, sf).withColumn(
        "layer", F.concat(F.lit("layer"), (1 + F.col("station_id") % 5).cast("string"))
    )
    stations.write_table(layered, path, ["layer"])
    return stations.read_station_table(spark, path, list(schema.LAYER_DEPTHS)).select(
        "station_id", "layer", "date_time", "soil_moisture"
    )


def _named_files(spark, rows, path):
    """Writes each station's file under its name, in the task that holds the station; every seventh is cut short.

    `rows`: layer, s (station), g (group), date_time, soil_moisture.
    """
    local = "://" not in path and not path.startswith("file:")
    uri = f"file://{os.path.abspath(path)}" if local else re.sub("^file:/+", "file:///", path)
    kind = pa.schema([("date_time", pa.date32()), ("soil_moisture", pa.float64())])

    def write(batches):
        store, folder = fs.FileSystem.from_uri(uri)
        own, sink = None, None
        for batch in batches:
            names = list(zip(*(batch.column(c).to_pylist() for c in ("layer", "s", "g"))))
            cuts = [i for i in range(len(names)) if i == 0 or names[i] != names[i - 1]]
            for start, end in zip(cuts, [*cuts[1:], len(names)]):
                layer, station, group = names[start]
                if names[start] != own:
                    if sink is not None:
                        sink.close()
                    own, sink, name = names[start], None, f"{folder}/{layer}/{station}_group_{group}.parquet"
                    store.create_dir(f"{folder}/{layer}")
                    if station % 7 == 0:
                        with store.open_output_stream(name) as out:
                            out.write(b"PAR1 cut short")
                    else:
                        sink = pq.ParquetWriter(name, kind, filesystem=store)
                if sink is not None:
                    part = batch.slice(start, end - start).select(["date_time", "soil_moisture"])
                    sink.write_batch(part.cast(kind))
            yield pa.RecordBatch.from_arrays([pa.array([len(cuts)], pa.int64())], names=["files"])
        if sink is not None:
            sink.close()

    together = rows.repartition("layer", "s", "g").sortWithinPartitions("layer", "s", "g")
    together.mapInArrow(write, "files long").agg(F.sum("files")).collect()  # one row; runs the writing tasks
    return path


@query("s06_station_files", """SELECT station_id, station_id % 4 AS group_id, 'layer' || (1 + station_id % 5) AS layer, station_id % 7 = 0 AS skipped,
    CASE WHEN station_id % 7 = 0 THEN 0 ELSE count(*) END AS n, CASE WHEN station_id % 7 <> 0 THEN sum(soil_moisture) END AS total
    FROM station_daily GROUP BY station_id""", floats="total", ints="group_id n")
def station_files(spark, sf):
    """Station files are written one each, some are cut short, and all are scanned by their names, with a list of what was skipped."""
    path = scratch_path(spark, "files")
    keyed = b.station_daily(spark, sf).withColumns(
        {"g": F.col("station_id") % 4, "s": F.col("station_id"), "layer": F.concat(F.lit("layer"), (1 + F.col("station_id") % 5).cast("string"))}
    )
    named = _named_files(spark, keyed.select("layer", "s", "g", "date_time", "soil_moisture"), path)
    rows = stations.read_stations(spark, named, fmt="parquet", skip_unreadable=True, file="file")
    each = stable(rows.groupBy("station_id", "group_id", "layer", "file").agg(F.count(F.lit(1)).alias("n"), F.sum("soil_moisture").alias("total")))
    skipped = stations.skipped_files(spark, named, each, "file")
    read = each.groupBy("station_id", "group_id", "layer").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    lost = skipped.select("station_id", "group_id", "layer", F.lit(0).cast("long").alias("n"), F.lit(None).cast("double").alias("total"))
    return read.withColumn("skipped", F.lit(False)).unionByName(lost.withColumn("skipped", F.lit(True)))


@query("s02_path_fields", """SELECT layer, CAST(l_suppkey AS VARCHAR) AS station, CAST(lat_i AS VARCHAR) AS grp,
    count(*) AS n FROM li_cell GROUP BY ALL""")
def path_fields(spark, sf):
    li = b.table(spark, sf, "lineitem").select(
        F.concat(
            F.lit("/data/layer"), 1 + (F.col("l_linenumber") - 1) % 5, F.lit("/"), "l_suppkey", F.lit("_group_"),
            F.col("l_suppkey") % 5, F.lit(".csv"),
        ).alias("path")
    )
    parsed = stations.path_fields(li, "path", r"([^/]+)/(\d+)_group_(\d+)\.csv$", ["layer", "station", "grp"])
    return parsed.groupBy("layer", "station", "grp").agg(F.count(F.lit(1)).alias("n"))


@query("s03_grid_scan", """SELECT lat_i, lon_i, time, sm, year(time) AS year, month(time) AS month FROM grid_daily
    WHERE year(time) BETWEEN 1996 AND 2000 AND month(time) IN (1, 4, 7, 10)""", floats="sm", ints="year month", dates="time")
def grid_scan(spark, sf):
    path = scratch_path(spark, "grid")
    grids.write_grid(b.grid_daily(spark, sf), path)
    read = grids.read_grid(spark, path, years=range(1996, 2001), months=[1, 4, 7, 10])
    return read.select("lat_i", "lon_i", "time", "sm", "year", "month")


DENSE = """SELECT t.time, la.lat_i, lo.lon_i, g.sm FROM (SELECT DISTINCT time FROM grid_daily) t
    CROSS JOIN (SELECT unnest(range(5)) AS lat_i) la
    CROSS JOIN (SELECT unnest(range(max(lon_i) + 1)) AS lon_i FROM grid_daily) lo
    LEFT JOIN grid_daily g ON g.time = t.time AND g.lat_i = la.lat_i AND g.lon_i = lo.lon_i"""


def _dense(spark, sf):
    n_lon = b.table(spark, sf, "lineitem").agg(F.max("l_suppkey")).first()[0] // 5 + 1
    return grid.rows_to_grid(b.grid_daily(spark, sf), "sm", 5, n_lon)


@query("s04_grid_to_rows", DENSE, floats="sm", ints="lat_i lon_i", dates="time")
def grid_to_rows(spark, sf):
    return grid.grid_to_rows(_dense(spark, sf), "cells", "sm", ["time", "lat_i"])


@query("s05_rows_to_grid", f"""SELECT time, lat_i, count(*) AS n_cells, count(sm) AS n_present, sum(sm) AS total
    FROM ({DENSE}) GROUP BY ALL""", floats="total", ints="lat_i", dates="time")
def rows_to_grid(spark, sf):
    return _dense(spark, sf).select(
        "time", "lat_i", F.size("cells").cast("long").alias("n_cells"),
        F.size(F.filter("cells", lambda v: v.isNotNull())).cast("long").alias("n_present"),
        F.when(
            F.exists("cells", lambda v: v.isNotNull()),
            F.aggregate("cells", F.lit(0.0), lambda a, v: a + F.coalesce(v, F.lit(0.0))),
        ).alias("total"),
    )


@query("s07_truncate_at_gap", """, days AS (SELECT station_id, CAST(ts AS DATE) AS dt, count(*) AS n FROM station_raw GROUP BY ALL),
    months AS (SELECT DISTINCT station_id, date_trunc('month', dt) AS m FROM days),
    expected AS (SELECT station_id, m, CAST(unnest(generate_series(m, m + INTERVAL 1 MONTH - INTERVAL 1 DAY, INTERVAL 1 DAY)) AS DATE) AS dt
        FROM months),
    stops AS (SELECT station_id, m, min(e.dt) AS stop FROM expected e ANTI JOIN station_daily d
        ON e.station_id = d.station_id AND e.dt = d.date_time GROUP BY ALL)
    SELECT d.station_id, d.dt, d.n FROM days d LEFT JOIN stops s ON d.station_id = s.station_id
        AND date_trunc('month', d.dt) = s.m WHERE s.stop IS NULL OR d.dt < s.stop""", dates="dt")
def truncate_at_gap(spark, sf):
    days = b.station_raw(spark, sf).groupBy("station_id", F.to_date("ts").alias("dt")).agg(F.count(F.lit(1)).alias("n"))
    required = b.station_daily(spark, sf).withColumnRenamed("date_time", "dt")
    return series.truncate_at_gap(days, required, ["station_id"], "dt")


@query("s10_append_log", """SELECT layer, count(*) AS runs, sum(accuracy) AS total FROM seed_log GROUP BY layer""", floats="total")
def append_log(spark, sf):
    path = scratch_path(spark, "seed-log")
    log = b.seed_log(spark, sf)
    stations.append_log(log.where(F.col("layer") <= "layer3"), path)
    stations.append_log(log.where(F.col("layer") > "layer3"), path)
    return spark.read.parquet(path).groupBy("layer").agg(F.count(F.lit(1)).alias("runs"), F.sum("accuracy").alias("total"))


@query("s11_global_grid", """, st AS (SELECT CAST(ceil(latitude + 89.5e0) AS BIGINT) AS lat_i, CAST(ceil(x - 0.5e0) AS BIGINT) AS lon_i, count(*) AS n
    FROM (SELECT latitude, (longitude + 37 * (station_id % 7)) AS x FROM station_meta) GROUP BY ALL),
    cells AS (SELECT i AS lat_i, j AS lon_i FROM (SELECT unnest(range(181)) AS i), (SELECT unnest(range(360)) AS j))
    SELECT lat_i, lon_i, coalesce(n, 0) AS n, lat_i - 90e0 AS lat, CASE WHEN lon_i >= 180 THEN lon_i - 360e0 ELSE lon_i END AS lon
    FROM cells LEFT JOIN st USING (lat_i, lon_i)""", floats="lat lon")
def global_grid(spark, sf):
    meta = b.station_meta(spark, sf).withColumn("east", F.col("longitude") + F.col("station_id") % 7 * 37)
    placed = grid.nearest_cell(meta, "latitude", "east", grid.Axis(-90.0, 1.0, 181), grid.Axis(0.0, 1.0, 360))
    counts = placed.groupBy("lat_i", "lon_i").agg(F.count(F.lit(1)).alias("n"))
    return grid.global_grid(spark, 181, 360).join(counts, ["lat_i", "lon_i"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


@query("s12_config_layers", """, layers(layer, a, z) AS (VALUES ('layer1', 0e0, 0.1e0), ('layer2', 0.1e0, 0.3e0), ('layer3', 0.3e0, 0.5e0),
    ('layer4', 0.5e0, 0.8e0), ('layer5', 0.8e0, 1.1e0))
    SELECT layer, a AS depth_from, z AS depth_to, count(station_id) AS stations FROM layers LEFT JOIN station_meta m
    ON m.depth_from >= a - 1e-9 AND m.depth_to <= z + 1e-9 GROUP BY ALL""", floats="depth_from depth_to")
def config_layers(spark, sf):
    found = b.station_meta(spark, sf).groupBy(assign_layer(F.col("depth_from"), F.col("depth_to")).alias("layer")).agg(
        F.count(F.lit(1)).alias("_n")
    )
    layers = schema.config_tables(spark)["layers"]
    return layers.join(found, "layer", "left").select("layer", "depth_from", "depth_to", F.coalesce("_n", F.lit(0)).alias("stations"))


@query("s12_config_tables", """, kinds AS (SELECT l_linenumber % 4 AS k, count(*) AS n FROM lineitem GROUP BY ALL),
    cfg(k, a, c, v) AS (VALUES """ + ", ".join(
    [f"(0, '{n}', '{layer}', NULL::DOUBLE)" for layer, n in [*schema.ERA5_LAYER_VARS.items(), *schema.GLDAS_LAYER_VARS.items()]]
    + [f"(1, '{layer}', NULL, {d}::DOUBLE)" for layer, group in schema.SMCI_LAYER_DEPTHS.items() for d in group]
    + [f"(2, 'random', '{split} {layer}', {seed}::DOUBLE)" for (split, layer), seed in schema.SPLIT_SEEDS.items()]
    + [f"(2, '{t}', '{layer}', {seed}::DOUBLE)" for t, seeds in (("adversarial", schema.ADVERSARIAL_SEEDS), ("corrected", schema.CORRECTED_SEEDS)) for layer, seed in seeds.items()]
    + [f"(3, '{n}', NULL, {'NULL' if 'missing_value' not in r else r['missing_value']}::DOUBLE)" for n, r in schema.VALIDITY_RULES.items()]
) + """) SELECT k, a, c, v, n FROM cfg JOIN kinds USING (k)""", floats="v", ints="k")
def config_all(spark, sf):
    """Every configuration table, beside a count of the rows that it would be used for."""
    tables = schema.config_tables(spark)
    parts = [
        tables["products"].select(F.lit(0).alias("k"), F.col("variable").alias("a"), F.col("layer").alias("c"), F.lit(None).cast("double").alias("v")),
        tables["depths"].select(F.lit(1).alias("k"), F.col("layer").alias("a"), F.lit(None).cast("string").alias("c"), F.col("depth_cm").cast("double").alias("v")),
        tables["seeds"].select(F.lit(2).alias("k"), F.col("table").alias("a"), F.concat_ws(" ", "split_method", "layer").alias("c"), F.col("seed").cast("double").alias("v")),
        tables["rules"].select(F.lit(3).alias("k"), F.col("variable").alias("a"), F.lit(None).cast("string").alias("c"), F.col("missing_value").alias("v")),
    ]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])
    kinds = b.table(spark, sf, "lineitem").groupBy((F.col("l_linenumber") % 4).alias("k")).agg(F.count(F.lit(1)).alias("n"))
    return every.join(kinds, "k")


def _importance(spark, sf):
    return (
        b.table(spark, sf, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % 5).alias("station"),
            F.concat(F.lit("f_"), "l_returnflag", "l_linestatus").alias("feature"),
            (F.col("l_linenumber") - 1).alias("repeat"),
        )
        .agg(F.avg("l_tax").alias("value"))
    )


IMPORTANCE_SQL = """SELECT l_suppkey % 5 AS station, 'f_' || l_returnflag || l_linestatus AS feature, l_linenumber - 1 AS repeat,
    avg(l_tax) AS value FROM lineitem GROUP BY ALL"""


@query("s13_importance_rows", IMPORTANCE_SQL, floats="value", ints="repeat")
def importance_rows(spark, sf):
    arrays = metrics.importance_arrays(_importance(spark, sf), ["station"])
    return metrics.importance_table(arrays, ["station"], "features", "importances")


@query("s13_importance_wide", f"""SELECT station, repeat, max(value) FILTER (feature = 'f_AF') AS f_AF,
    max(value) FILTER (feature = 'f_AO') AS f_AO, max(value) FILTER (feature = 'f_NO') AS f_NO,
    max(value) FILTER (feature = 'f_RF') AS f_RF FROM ({IMPORTANCE_SQL}) GROUP BY ALL""",
       floats="f_AF f_AO f_NO f_RF", ints="repeat")
def importance_wide(spark, sf):
    return metrics.importance_wide(_importance(spark, sf), ["station"], ["f_AF", "f_AO", "f_NO", "f_RF"])


@query("p01_projection", "SELECT layer, lat_i, lon_i, time, swvl2 FROM grid_layers", floats="swvl2", dates="time")
def projection(spark, sf):
    return b.grid_layers(spark, sf).select("layer", "lat_i", "lon_i", "time", "swvl2")


@query("p02_rename", """SELECT station_id, latitude AS lat, longitude AS lon FROM station_meta""", floats="lat lon")
def rename(spark, sf):
    meta = b.station_meta(spark, sf).select("station_id", "latitude", "longitude")
    return schema.rename(meta, {"latitude": "lat", "longitude": "lon"})


@query("p03_recode", """SELECT l_linestatus AS status, CASE l_returnflag WHEN 'A' THEN 'AutoML' WHEN 'N' THEN 'GLDAS' END AS exp,
    count(*) AS n FROM lineitem GROUP BY ALL""")
def recode_values(spark, sf):
    li = b.table(spark, sf, "lineitem")
    return li.groupBy(
        F.col("l_linestatus").alias("status"), recode(F.col("l_returnflag"), {"A": "AutoML", "N": "GLDAS"}).alias("exp")
    ).agg(F.count(F.lit(1)).alias("n"))


@query("p04_qc_mask", """SELECT event_id, station_id, CASE WHEN soil_moisture_flag = 'G' THEN soil_moisture END AS soil_moisture
    FROM station_raw""", floats="soil_moisture")
def qc_mask(spark, sf):
    masked = clean.mask_quality(b.station_raw(spark, sf), "soil_moisture", "soil_moisture_flag")
    return masked.select("event_id", "station_id", "soil_moisture")


@query("p05_time_range", """SELECT l_suppkey, l_shipdate, count(*) AS n FROM lineitem
    WHERE l_shipdate BETWEEN TIMESTAMP '2000-01-01 00:00:00' AND TIMESTAMP '2022-12-31 23:00:00' GROUP BY ALL""")
def time_range(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate")
    kept = clean.between_time(li, "l_shipdate", "2000-01-01 00:00:00", "2022-12-31 23:00:00")
    return kept.groupBy("l_suppkey", "l_shipdate").agg(F.count(F.lit(1)).alias("n"))


@query("p06_month_selection", """SELECT l_suppkey, sum(l_quantity) AS q FROM lineitem WHERE year(l_shipdate) = 1999
    AND month(l_shipdate) = 12 GROUP BY ALL""", floats="q")
def month_selection(spark, sf):
    li = b.table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity")
    return clean.sel_period(li, "l_shipdate", 1999, 12).groupBy("l_suppkey").agg(F.sum("l_quantity").alias("q"))


@query("p07_day_slice", "SELECT lat_i, lon_i, time, sm FROM grid_daily WHERE time = DATE '1998-03-05'", floats="sm", dates="time")
def day_slice(spark, sf):
    return clean.sel_day(b.grid_daily(spark, sf), "time", date(1998, 3, 5)).select("lat_i", "lon_i", "time", "sm")


@query("p08_sentinels", "SELECT lat_i, lon_i, nullif(value, -999e0) AS value FROM grid_soil", floats="value")
def sentinels(spark, sf):
    return clean.null_sentinels(b.grid_soil(spark, sf), {"value": -999.0}).select("lat_i", "lon_i", "value")


@query("p09_validity_rules", """SELECT lat_i, lon_i, CASE WHEN value <> -999 THEN value * 0.01e0 END AS BD,
    CASE WHEN value - 100 <> -100 THEN value - 100 END AS CLAY, CASE WHEN value / 10 <> -100 THEN value / 10 END AS GRAV,
    CASE WHEN value <> -100 THEN value END AS SAND, CASE WHEN -100 * depth <> -100 THEN -100e0 * depth END AS SILT,
    CASE WHEN depth BETWEEN 1 AND 24 THEN depth END AS LAND_COVER, CASE WHEN value / 700 BETWEEN 0 AND 10 THEN value / 700 END AS MODIS_LAI,
    CASE WHEN value / 100 >= 0 THEN value / 100 END AS ERA5_LAND_lai_lv, CASE WHEN value - 500 >= 0 THEN value - 500 END AS ERA5_LAND_lai_hv,
    CASE WHEN value <> 9999 AND value BETWEEN -407 AND 8752 THEN value END AS DEM FROM grid_soil""",
       floats="BD CLAY GRAV SAND SILT LAND_COVER MODIS_LAI ERA5_LAND_lai_lv ERA5_LAND_lai_hv DEM")
def validity_rules(spark, sf):
    v, depth = F.col("value"), F.col("depth")
    inputs = {
        "BD": v, "CLAY": v - 100, "GRAV": v / 10, "SAND": v, "SILT": depth * -100.0, "LAND_COVER": depth, "MODIS_LAI": v / 700,
        "ERA5_LAND_lai_lv": v / 100, "ERA5_LAND_lai_hv": v - 500, "DEM": v,
    }
    soil = b.grid_soil(spark, sf).select("lat_i", "lon_i", *[c.alias(name) for name, c in inputs.items()])
    return clean.apply_validity(soil, schema.VALIDITY_RULES)


@query("p10_scale", """SELECT layer, lat_i, lon_i, time, SoilMoi0_10cm_inst * (1 / 100e0) AS SoilMoi0_10cm_inst,
    SoilMoi10_40cm_inst * (1 / 300e0) AS SoilMoi10_40cm_inst, SoilMoi40_100cm_inst * (1 / 600e0) AS SoilMoi40_100cm_inst,
    SMCI * 0.001e0 AS SMCI FROM grid_layers""",
       floats="SoilMoi0_10cm_inst SoilMoi10_40cm_inst SoilMoi40_100cm_inst SMCI", digits=8, dates="time")
def scale(spark, sf):
    factors = {**schema.GLDAS_SCALES, "SMCI": schema.SMCI_SCALE}
    return clean.scale(b.grid_layers(spark, sf), factors).select("layer", "lat_i", "lon_i", "time", *factors)


@query("p11_drop_any", """SELECT station_idx, count(*) AS n FROM scores_wide WHERE pred_a IS NOT NULL AND pred_b IS NOT NULL
    AND pred_c IS NOT NULL AND "true" IS NOT NULL GROUP BY ALL""")
def drop_any(spark, sf):
    kept = clean.drop_any(b.scores_wide(spark, sf).select("station_idx", "pred_a", "pred_b", "pred_c", "true"))
    return kept.groupBy("station_idx").agg(F.count(F.lit(1)).alias("n"))


@query("p12_drop_all", """SELECT station_idx, count(*) AS n FROM (SELECT station_idx, pred_c,
    CASE WHEN pred_b > 0.5e0 THEN pred_b END AS b FROM scores_wide) WHERE pred_c IS NOT NULL OR b IS NOT NULL GROUP BY ALL""")
def drop_all(spark, sf):
    wide = b.scores_wide(spark, sf).select(
        "station_idx", "pred_c", F.when(F.col("pred_b") > 0.5, F.col("pred_b")).alias("b")
    )
    return clean.drop_all(wide, ["pred_c", "b"]).groupBy("station_idx").agg(F.count(F.lit(1)).alias("n"))


@query("p13_null_safe_score", f"""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt AS "day",
    CASE WHEN l_tax > 0 THEN {b.LINEAR_SQL} END AS pred FROM features""", floats="pred", digits=4, dates="day")
def null_safe_score(spark, sf):
    table = b.features(spark, sf).withColumn("l_tax", F.when(F.col("l_tax") > 0, F.col("l_tax")))
    return clean.null_safe_score(table, b.FEATURES, b.LINEAR).select(*b.KEYS, "pred")


@query("p14_drop_features", """SELECT l_suppkey, avg(l_quantity) AS l_quantity, avg(s_acctbal) AS s_acctbal FROM features
    GROUP BY ALL""", floats="l_quantity s_acctbal")
def drop_features(spark, sf):
    kept = schema.drop_features(b.features(spark, sf).select("l_suppkey", *b.FEATURES), ["p_", "tax", "disc"])
    return kept.groupBy("l_suppkey").agg(*[F.avg(c).alias(c) for c in kept.columns if c != "l_suppkey"])


@query("p15_required_columns", "SELECT sm, time, lon_i, lat_i FROM grid_daily", floats="sm", dates="time")
def required_columns(spark, sf):
    return schema.require_columns(b.grid_daily(spark, sf).select("lat_i", "lon_i", "time", "sm"), ["sm", "time", "lon_i", "lat_i"])


FILLED_SQL = """, span AS (SELECT station_id, min(date_time) AS a, max(date_time) AS z FROM station_daily GROUP BY ALL),
    days AS (SELECT station_id, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS date_time FROM span)
    SELECT d.station_id, d.date_time, s.soil_moisture, CAST(s.soil_moisture IS NOT NULL AS INT) AS Is_valid FROM days d
    LEFT JOIN station_daily s USING (station_id, date_time)"""


@query("p16_valid_rows", "SELECT station_id, count(*) AS n FROM station_daily GROUP BY ALL")
def valid_rows(spark, sf):
    filled = series.fill_days(b.station_daily(spark, sf), ["station_id"], "date_time", ["soil_moisture"])
    return filled.where(F.col("Is_valid") == 1).groupBy("station_id").agg(F.count(F.lit(1)).alias("n"))


@query("p17_clip", """SELECT station_idx, date_time, l_orderkey, l_linenumber, l_partkey,
    CASE WHEN pred_c IS NULL THEN NULL ELSE least(greatest(pred_c - 0.2e0, 0), 0.5e0) END AS pred FROM scores_wide""", floats="pred", dates="date_time")
def clip_scores(spark, sf):
    wide = b.scores_wide(spark, sf)
    return wide.select(
        "station_idx", "date_time", "l_orderkey", "l_linenumber", "l_partkey",
        clip(F.col("pred_c") - F.lit(0.2), 0.0, 0.5).alias("pred"),
    )


@query("p18_region_mask", """SELECT lat_i, lon_i, time, sm * band1 AS sm FROM grid_daily LEFT JOIN grid_mask USING (lat_i, lon_i)""", floats="sm", dates="time")
def region_mask(spark, sf):
    return grid.apply_mask(b.grid_daily(spark, sf).select("lat_i", "lon_i", "time", "sm"), b.grid_mask(spark, sf), ["sm"])


@query("p19_daily_check", """SELECT * FROM (SELECT station_id, min(date_time) AS first_day, max(date_time) AS last_day,
    count(*) AS n_rows, max(date_time) - min(date_time) + 1 AS expected FROM station_daily GROUP BY ALL)
    WHERE expected <> n_rows""", ints="expected", dates="first_day last_day")
def daily_check(spark, sf):
    return series.check_daily(b.station_daily(spark, sf), ["station_id"], "date_time")


@query("p20_row_counts", """SELECT * FROM (SELECT lat_i, lon_i, count(*) AS left_rows, count(*) FILTER (tp > 0.01e0) AS right_rows
    FROM grid_daily GROUP BY ALL) WHERE left_rows <> right_rows""")
def row_counts(spark, sf):
    daily = b.grid_daily(spark, sf)
    return clean.check_rows(daily, daily.where(F.col("tp") > 0.01), ["lat_i", "lon_i"])


@query("p21_null_audit", """SELECT 'station_idx' AS "column", count(*) FILTER (station_idx IS NULL) AS n_null FROM scores_wide
    UNION ALL SELECT 'pred_a', count(*) FILTER (pred_a IS NULL) FROM scores_wide
    UNION ALL SELECT 'pred_c', count(*) FILTER (pred_c IS NULL) FROM scores_wide""")
def null_audit(spark, sf):
    return clean.null_audit(b.scores_wide(spark, sf).select("station_idx", "pred_a", "pred_c"))


@query("p22_lat_window", "SELECT station_id, latitude FROM station_meta WHERE latitude BETWEEN 25 AND 42.5e0", floats="latitude")
def lat_window(spark, sf):
    return grid.lat_window(b.station_meta(spark, sf).select("station_id", "latitude"), "latitude")


@query("f16_wrap_longitude", """SELECT station_id, CASE WHEN x >= 180 THEN x - 360 ELSE x END AS lon FROM
    (SELECT station_id, longitude + 37 * (station_id % 7) AS x FROM station_meta)""", floats="lon")
def wrap(spark, sf):
    east = F.col("longitude") + F.col("station_id") % 7 * 37
    return b.station_meta(spark, sf).select("station_id", wrap_longitude(east).alias("lon"))
