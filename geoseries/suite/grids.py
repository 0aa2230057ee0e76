"""Joins of stations and grids, regridding, climatologies, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoseries import schema
from geoseries.operators import compare, grid
from geoseries.suite import bindings as b
from geoseries.suite.registry import query



def _statics(spark, sf):
    base = b.grid_static(spark, sf)
    return [
        base.select("lat_i", "lon_i", "value"),
        base.select("lat_i", "lon_i", (F.col("depth") * 1.5).alias("depth_value")),
        base.select("lat_i", "lon_i", (F.col("lat_i") + F.col("lon_i")).alias("cell_sum")),
    ]


@query("j01_join_static", """SELECT lat_i, lon_i, value, depth * 1.5e0 AS depth_value, lat_i + lon_i AS cell_sum FROM grid_static""",
       floats="value depth_value")
def join_static(spark, sf):
    return grid.join_static(_statics(spark, sf))


@query("j02_assemble_features", """, t AS (SELECT lat_i, lon_i, time, tp FROM grid_daily WHERE tp > 0.02e0)
    SELECT g.lat_i, g.lon_i, g.time, g.sm, t.tp, s.value, s.depth * 1.5e0 AS depth_value, s.lat_i + s.lon_i AS cell_sum
    FROM grid_daily g JOIN t ON g.lat_i = t.lat_i AND g.lon_i = t.lon_i AND g.time = t.time
    JOIN grid_static s ON s.lat_i = g.lat_i AND s.lon_i = g.lon_i""", floats="sm tp value depth_value", dates="time")
def assemble(spark, sf):
    daily = b.grid_daily(spark, sf)
    moisture = daily.select("lat_i", "lon_i", "time", "sm")
    rain = daily.where(F.col("tp") > 0.02).select("lat_i", "lon_i", "time", "tp")
    return grid.assemble_features(_statics(spark, sf), [moisture, rain])


NEAREST_SQL = """, la AS (SELECT station_id, lat_i FROM (SELECT m.station_id, a.lat_i, row_number() OVER (PARTITION BY m.station_id
        ORDER BY abs(a.lat - m.latitude), a.lat_i) AS rn, m.latitude BETWEEN min(a.lat) OVER () - 0.25e0 AND max(a.lat) OVER () + 0.25e0 AS ok
        FROM station_meta m CROSS JOIN lat_axis a) WHERE rn = 1 AND ok),
    lo AS (SELECT station_id, lon_i FROM (SELECT m.station_id, a.lon_i, row_number() OVER (PARTITION BY m.station_id
        ORDER BY abs(a.lon - m.longitude), a.lon_i) AS rn FROM station_meta m CROSS JOIN lon_axis a) WHERE rn = 1)"""


@query("j03_nearest_cell", NEAREST_SQL + " SELECT m.station_id, lat_i, lon_i FROM station_meta m LEFT JOIN la USING (station_id) LEFT JOIN lo USING (station_id)",
       ints="lat_i lon_i")
def nearest(spark, sf):
    placed = grid.nearest_cell(b.station_meta(spark, sf), "latitude", "longitude", b.LAT_AXIS, b.lon_axis(spark, sf))
    return placed.select("station_id", "lat_i", "lon_i")


@query("j04_extract_points", NEAREST_SQL + """ SELECT station_id, time, sm, tp FROM grid_daily JOIN la USING (lat_i)
    JOIN lo USING (station_id, lon_i)""", floats="sm tp", dates="time")
def extract(spark, sf):
    series = grid.extract_points(
        b.station_meta(spark, sf), b.grid_daily(spark, sf), "station_id", "latitude", "longitude", b.LAT_AXIS, b.lon_axis(spark, sf)
    )
    return series.select("station_id", "time", "sm", "tp")


@query("j05_reconcile", """, raw AS (SELECT lat_i, lon_i, time, sm FROM grid_daily WHERE tp > 0.01e0),
    st AS (SELECT lat_i, lon_i, time, sm + CASE WHEN day(time) = 7 THEN 0.01e0 ELSE 0 END AS sm FROM grid_daily WHERE tp < 0.09e0)
    SELECT lat_i, lon_i, time, raw.sm AS raw, st.sm AS stored, raw.sm - st.sm AS diff, CASE WHEN st.sm IS NULL THEN 'not stored'
    WHEN raw.sm IS NULL THEN 'not in raw' WHEN abs(raw.sm - st.sm) <= 1e-6 THEN 'match' ELSE 'differs' END AS status
    FROM raw FULL JOIN st USING (lat_i, lon_i, time)""", floats="raw stored diff", dates="time")
def reconcile(spark, sf):
    daily = b.grid_daily(spark, sf)
    raw = daily.where(F.col("tp") > 0.01)
    stored = daily.where(F.col("tp") < 0.09).withColumn("sm", F.col("sm") + F.when(F.dayofmonth("time") == 7, 0.01).otherwise(0.0))
    return compare.reconcile(raw, stored, ["lat_i", "lon_i", "time"], "sm")


@query("j05_soil_profile", """SELECT c_custkey, 1 + c_nationkey % 8 AS depth, CASE WHEN (1 + c_nationkey % 8) // 5 >= 1 THEN 2 ELSE 1 END AS file,
    (4 + (1 + c_nationkey % 8) % 4 - 1) % 4 AS level FROM customer""", ints="depth file level")
def soil_profile(spark, sf):
    depth = 1 + F.col("c_nationkey") % 8
    file, level = compare.profile_position(depth)
    return b.table(spark, sf, "customer").select("c_custkey", depth.alias("depth"), file.alias("file"), level.alias("level"))


@query("j06_regrid_bilinear", """, src AS (SELECT lat_i, lon_i, CASE WHEN value > -800 THEN value END AS value FROM grid_static),
    n AS (SELECT max(lon_i) + 1 AS n FROM src),
    tl AS (SELECT i, -1e0 + 0.75e0 * i AS y FROM (SELECT unnest(range(15)) AS i)),
    tn AS (SELECT j, 0.3e0 + 1.25e0 * j AS x FROM (SELECT unnest(range(CAST(n AS BIGINT))) AS j FROM n)),
    bl AS (SELECT i, y, CAST(greatest(least(floor(y), 8), 0) AS BIGINT) AS lo, y BETWEEN 0 AND 9 AS ok FROM tl),
    bn AS (SELECT j, x, CAST(greatest(least(floor(x), n - 2), 0) AS BIGINT) AS lo, x BETWEEN 0 AND n - 1 AS ok FROM tn CROSS JOIN n),
    z AS (SELECT i AS lat_i, j AS lon_i, y AS lat, x AS lon, bl.ok AND bn.ok AS ok, y - bl.lo AS v, x - bn.lo AS u, a.value AS a, c.value AS c,
        d.value AS d, e.value AS e
        FROM bl CROSS JOIN bn LEFT JOIN src a ON a.lat_i = bl.lo AND a.lon_i = bn.lo LEFT JOIN src c ON c.lat_i = bl.lo AND c.lon_i = bn.lo + 1
        LEFT JOIN src d ON d.lat_i = bl.lo + 1 AND d.lon_i = bn.lo LEFT JOIN src e ON e.lat_i = bl.lo + 1 AND e.lon_i = bn.lo + 1)
    SELECT lat_i, lon_i, lat, lon, CASE WHEN ok THEN (1 - v) * (1 - u) * a + (1 - v) * u * c + v * (1 - u) * d + v * u * e END AS value
    FROM z""", floats="lat lon value", digits=5)
def regrid(spark, sf):
    src = b.grid_static(spark, sf).withColumn("value", F.when(F.col("value") > -800, F.col("value")))
    n_lon = src.agg(F.max("lon_i")).first()[0] + 1
    return grid.regrid_bilinear(
        src, grid.Axis(0.0, 1.0, 10), grid.Axis(0.0, 1.0, n_lon), grid.Axis(-1.0, 0.75, 15), grid.Axis(0.3, 1.25, n_lon), ["value"], by=[]
    )


def _products(spark, sf):
    layers = b.grid_layers(spark, sf)
    keys = ["layer", "lat_i", "lon_i", "time"]
    return {
        "era5": layers.where(F.col("swvl1") > 0.2).select(*keys, "swvl1"),
        "gldas": layers.where(F.col("SoilMoi0_10cm_inst") < 40).select(*keys, "SoilMoi0_10cm_inst"),
        "smci": layers.where(F.col("layer") != "layer1").select(*keys, "SMCI"),
    }


@query("j07_merge_products", """SELECT layer, lat_i, lon_i, time, era5, gldas, smci FROM
    (SELECT layer, lat_i, lon_i, time, swvl1 AS era5 FROM grid_layers WHERE swvl1 > 0.2e0)
    FULL JOIN (SELECT layer, lat_i, lon_i, time, SoilMoi0_10cm_inst AS gldas FROM grid_layers WHERE SoilMoi0_10cm_inst < 40) USING (layer, lat_i, lon_i, time)
    FULL JOIN (SELECT layer, lat_i, lon_i, time, SMCI AS smci FROM grid_layers WHERE layer <> 'layer1') USING (layer, lat_i, lon_i, time)""",
       floats="era5 gldas smci", dates="time")
def merge(spark, sf):
    cols = {"era5": "swvl1", "gldas": "SoilMoi0_10cm_inst", "smci": "SMCI"}
    return grid.merge_products(_products(spark, sf), ["layer", "lat_i", "lon_i", "time"], cols)


@query("j11_semi_available", """SELECT station_id, date_time, soil_moisture FROM station_daily WHERE station_id IN
    (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)""", floats="soil_moisture", dates="date_time")
def semi(spark, sf):
    product = b.table(spark, sf, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 60))
    return compare.semi_available(b.station_daily(spark, sf), product.select(F.col("user_id").alias("station_id")), ["station_id"])


@query("j11_missing_report", """SELECT DISTINCT station_id FROM station_daily WHERE station_id NOT IN
    (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 60)""")
def missing(spark, sf):
    product = b.table(spark, sf, "events").where((F.col("event_type") == "purchase") & (F.col("value") > 60))
    stations = b.station_daily(spark, sf).select("station_id").distinct()
    return compare.missing_from(stations, product.select(F.col("user_id").alias("station_id")), ["station_id"])


@query("j12_swap_source", """SELECT s.station_id, s.date_time, p.v AS soil_moisture FROM station_daily s JOIN
    (SELECT user_id AS station_id, CAST(ts AS DATE) AS date_time, max(value) AS v FROM events WHERE event_type = 'view' GROUP BY ALL) p
    USING (station_id, date_time)""", floats="soil_moisture", dates="date_time")
def swap(spark, sf):
    product = (
        b.table(spark, sf, "events").where(F.col("event_type") == "view")
        .groupBy(F.col("user_id").alias("station_id"), F.to_date("ts").alias("date_time"))
        .agg(F.max("value").alias("soil_moisture"))
    )
    return compare.swap_source(b.station_daily(spark, sf), product, ["station_id", "date_time"], "soil_moisture")


@query("j13_depth_layer", """SELECT station_id, CASE WHEN depth_from >= 0 - 1e-9 AND depth_to <= 0.1e0 + 1e-9 THEN 'layer1'
    WHEN depth_from >= 0.1e0 - 1e-9 AND depth_to <= 0.3e0 + 1e-9 THEN 'layer2' WHEN depth_from >= 0.3e0 - 1e-9 AND depth_to <= 0.5e0 + 1e-9 THEN 'layer3'
    WHEN depth_from >= 0.5e0 - 1e-9 AND depth_to <= 0.8e0 + 1e-9 THEN 'layer4' WHEN depth_from >= 0.8e0 - 1e-9 AND depth_to <= 1.1e0 + 1e-9 THEN 'layer5'
    END AS layer FROM station_meta""")
def depth_layer(spark, sf):
    return b.station_meta(spark, sf).select(
        "station_id", compare.assign_layer(F.col("depth_from"), F.col("depth_to")).alias("layer")
    )


@query("j14_layer_variable", """SELECT layer, lat_i, lon_i, time, CASE layer WHEN 'layer1' THEN swvl1 WHEN 'layer2' THEN swvl2 ELSE swvl3 END AS era5,
    CASE layer WHEN 'layer1' THEN SoilMoi0_10cm_inst WHEN 'layer2' THEN SoilMoi10_40cm_inst WHEN 'layer3' THEN SoilMoi10_40cm_inst
    ELSE SoilMoi40_100cm_inst END AS gldas FROM grid_layers""", floats="era5 gldas", dates="time")
def layer_variable(spark, sf):
    layer = F.col("layer")
    return b.grid_layers(spark, sf).select(
        "layer", "lat_i", "lon_i", "time",
        compare.pick_layer_var(layer, schema.ERA5_LAYER_VARS).alias("era5"),
        compare.pick_layer_var(layer, schema.GLDAS_LAYER_VARS).alias("gldas"),
    )


@query("j15_compare_group", """, g AS (SELECT station_id // 3 AS group_id, date_time, avg(soil_moisture) AS averaged FROM station_daily GROUP BY ALL)
    SELECT s.station_id, s.date_time, s.soil_moisture, g.averaged, s.soil_moisture - g.averaged AS diff FROM station_daily s JOIN g
    ON g.group_id = s.station_id // 3 AND g.date_time = s.date_time""", floats="soil_moisture averaged diff", dates="date_time")
def compare_group(spark, sf):
    daily = b.station_daily(spark, sf).withColumn("group_id", F.floor(F.col("station_id") / 3))
    means = daily.groupBy("group_id", "date_time").agg(F.avg("soil_moisture").alias("soil_moisture"))
    return compare.compare_group(daily, means, ["group_id", "date_time"], "soil_moisture").drop("group_id")


@query("a03_grid_average", NEAREST_SQL + """, cell AS (SELECT station_id, lat_i, lon_i FROM la JOIN lo USING (station_id)),
    num AS (SELECT lat_i, lon_i, count(*) AS members, row_number() OVER (ORDER BY lat_i, lon_i) - 1 AS group_id FROM cell GROUP BY lat_i, lon_i),
    gr AS (SELECT station_id, group_id, members FROM cell JOIN num USING (lat_i, lon_i)),
    av AS (SELECT group_id, date_time, avg(soil_moisture) AS soil_moisture FROM station_daily JOIN gr USING (station_id) WHERE members > 1 GROUP BY ALL)
    SELECT gr.station_id, gr.group_id, date_time, soil_moisture FROM av JOIN gr USING (group_id)
    UNION ALL SELECT station_id, group_id, date_time, soil_moisture FROM station_daily JOIN gr USING (station_id) WHERE members = 1
    AND date_time BETWEEN DATE '2000-01-01' AND DATE '2024-01-20'""", floats="soil_moisture", dates="date_time")
def grid_average(spark, sf):
    return grid.grid_average(
        b.station_daily(spark, sf), b.station_meta(spark, sf), "station_id", "date_time", "soil_moisture",
        b.LAT_AXIS, b.lon_axis(spark, sf), end="2024-01-20",
    )


@query("a04_monthly_climatology", """SELECT layer, lat_i, lon_i, month(time) AS month, avg(sm) AS sm, avg(swvl1) AS swvl1 FROM grid_layers
    GROUP BY ALL""", floats="sm swvl1", ints="month")
def monthly(spark, sf):
    return grid.climatology(b.grid_layers(spark, sf), "time", ["sm", "swvl1"], ["layer", "lat_i", "lon_i"], "month")


@query("a05_yearly_mean", """SELECT layer, lat_i, lon_i, year(time) AS year, avg(sm) AS sm FROM grid_layers GROUP BY ALL""", floats="sm", ints="year")
def yearly(spark, sf):
    return grid.climatology(b.grid_layers(spark, sf), "time", ["sm"], ["layer", "lat_i", "lon_i"], "year")


SMCI_SQL = """, smci AS (SELECT l_suppkey % 5 AS lat_i, l_suppkey // 5 AS lon_i, CAST(l_shipdate AS DATE) AS time, 10 * (1 + p_size % 10) AS depth,
    l_tax * 5000 AS SMCI FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT CASE WHEN depth <= 20 THEN 'layer2' WHEN depth <= 40 THEN 'layer3' WHEN depth <= 70 THEN 'layer4' ELSE 'layer5' END AS layer,
    lat_i, lon_i, {part}(time) AS {part}, avg(SMCI) AS SMCI FROM smci GROUP BY ALL"""


def _smci(spark, sf):
    li, part = b.table(spark, sf, "lineitem"), b.table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(
        *b.supplier_cells(), F.to_date("l_shipdate").alias("time"), (10 * (1 + F.col("p_size") % 10)).alias("depth"),
        (F.col("l_tax") * 5000).alias("SMCI"),
    )


@query("a06_depths_monthly", SMCI_SQL.replace("{part}", "month"), floats="SMCI", ints="month")
def depths_monthly(spark, sf):
    return grid.climatology_depths(_smci(spark, sf), "time", "SMCI", "depth", schema.SMCI_LAYER_DEPTHS, ["lat_i", "lon_i"], "month")


@query("a06_depths_yearly", SMCI_SQL.replace("{part}", "year"), floats="SMCI", ints="year")
def depths_yearly(spark, sf):
    return grid.climatology_depths(_smci(spark, sf), "time", "SMCI", "depth", schema.SMCI_LAYER_DEPTHS, ["lat_i", "lon_i"], "year")


@query("a07_depth_mean", """SELECT lat_i, lon_i // 4 AS lon_i, avg(nullif(value, -999e0)) AS value FROM grid_soil GROUP BY ALL""", floats="value")
def depth_mean(spark, sf):
    profile = b.grid_soil(spark, sf).withColumn("lon_i", F.floor(F.col("lon_i") / 4))
    return grid.depth_mean(profile, {"value": -999.0}, ["lat_i", "lon_i"])


@query("a08_long_term_mean", "SELECT lat_i, lon_i, avg(tp) AS tp_mean FROM grid_daily GROUP BY ALL", floats="tp_mean")
def long_term(spark, sf):
    return schema.rename(grid.time_mean(b.grid_daily(spark, sf), ["tp"], ["lat_i", "lon_i"]), {"tp": "tp_mean"})


@query("u01_union", """SELECT 'first' AS source, station_id, count(*) AS n FROM station_daily GROUP BY ALL UNION ALL
    SELECT 'second', l_suppkey, count(*) FROM lineitem GROUP BY ALL""")
def union(spark, sf):
    a = b.station_daily(spark, sf).select(F.lit("first").alias("source"), "station_id")
    c = b.table(spark, sf, "lineitem").select(F.lit("second").alias("source"), F.col("l_suppkey").alias("station_id"))
    return a.unionByName(c).groupBy("source", "station_id").agg(F.count(F.lit(1)).alias("n"))


@query("u02_union_missing_columns", """SELECT station_id AS key, latitude, NULL::DOUBLE AS s_acctbal FROM station_meta UNION ALL
    SELECT s_suppkey, NULL, s_acctbal FROM supplier""", floats="latitude s_acctbal")
def union_missing(spark, sf):
    a = b.station_meta(spark, sf).select(F.col("station_id").alias("key"), "latitude")
    c = b.table(spark, sf, "supplier").select(F.col("s_suppkey").alias("key"), "s_acctbal")
    return a.unionByName(c, allowMissingColumns=True)


@query("u03_o01_time_concat", """SELECT station_id, date_time, soil_moisture FROM station_daily""", floats="soil_moisture", dates="date_time")
def time_concat(spark, sf):
    daily = b.station_daily(spark, sf)
    cut = F.lit("2024-01-16").cast("date")
    parts = daily.where(F.col("date_time") >= cut).unionByName(daily.where(F.col("date_time") < cut))
    return parts.sort("date_time", "station_id")


@query("u04_distinct_coordinates", "SELECT DISTINCT lat_i, lon_i FROM li_cell")
def distinct_coordinates(spark, sf):
    return b.table(spark, sf, "lineitem").select(*b.supplier_cells()).dropDuplicates(["lon_i", "lat_i"])


@query("u05_coordinate_equality", """SELECT lat_i, lon_i, 'left' AS only_in FROM (SELECT lat_i, lon_i FROM li_cell EXCEPT SELECT lat_i, lon_i FROM grid_static)
    UNION ALL SELECT lat_i, lon_i, 'right' FROM (SELECT lat_i, lon_i FROM grid_static EXCEPT SELECT lat_i, lon_i FROM li_cell)""")
def equality(spark, sf):
    left = b.table(spark, sf, "lineitem").select(*b.supplier_cells())
    return grid.same_coordinates(left, b.grid_static(spark, sf), ["lat_i", "lon_i"])
