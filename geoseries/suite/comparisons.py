"""Comparison maps and metric collections."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoseries import schema
from geoseries.operators import states
from geoseries.operators.grid import apply_mask
from geoseries.plans import comparison, evaluation
from geoseries.session import scratch_path
from geoseries.suite import bindings as b
from geoseries.suite import grids as g
from geoseries.suite.registry import query
from geoseries.suite.scores import ALL, PAIRS, R, RMSE, UB


SMCI_LAYERS = list(schema.SMCI_LAYER_DEPTHS)


def _states(spark, sf):
    """States of the prediction and all products, from one scan of the facts."""
    moisture = ["sm", "swvl1", "swvl2", "swvl3", "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst", "SoilMoi40_100cm_inst"]
    # The depth product has no daily mean: its rows are summed as they are, apart for each layer of depths.
    depths = {f"smci_{name}": F.col("depth").isin(list(group)) for name, group in schema.SMCI_LAYER_DEPTHS.items()}
    key = ["layer", "lat_i", "lon_i", "time"]
    sums = [s for c, at in depths.items() for s in (F.sum(F.when(at, F.col("SMCI"))).alias(f"sum_{c}"), F.count(F.when(at, F.col("SMCI"))).alias(f"n_{c}"))]
    daily = b.grid_layer_rows(spark, sf).groupBy(*key).agg(*[F.avg(c).alias(c) for c in moisture], *sums)
    parts = [s for c in moisture for s in (F.sum(c).alias(f"sum_{c}"), F.count(c).alias(f"n_{c}"))]
    parts += [F.sum(f"{p}{c}").alias(f"{p}{c}") for c in depths for p in ("sum_", "n_")]
    return daily.groupBy("layer", "lat_i", "lon_i", F.year("time").alias("year"), F.month("time").alias("month")).agg(*parts)


def _maps(spark, sf, part):
    picks = {
        name: {
            "pred": ("sm", 1.0), "era5": (schema.ERA5_LAYER_VARS[name], 1.0), "gldas": (schema.GLDAS_LAYER_VARS[name], 0.01),
            **({"smci": (f"smci_{name}", schema.SMCI_SCALE)} if name in SMCI_LAYERS else {}),
        }
        for name in schema.ERA5_LAYER_VARS
    }
    maps = states.layered_means(_states(spark, sf), part, picks, ["sm"], ["lat_i", "lon_i"])
    return comparison.difference_maps_of(maps, ["era5", "gldas", "smci"], b.grid_mask(spark, sf))


MAPS = g.SMCI_SQL.replace("SELECT CASE", ", sm AS (SELECT CASE") + """),
    lay(layer, e, s) AS (VALUES ('layer1', 'swvl1', 'SoilMoi0_10cm_inst'), ('layer2', 'swvl2', 'SoilMoi10_40cm_inst'),
        ('layer3', 'swvl3', 'SoilMoi10_40cm_inst'), ('layer4', 'swvl3', 'SoilMoi40_100cm_inst'), ('layer5', 'swvl3', 'SoilMoi40_100cm_inst')),
    cl AS (SELECT lat_i, lon_i, {part}(time) AS {part}, avg(swvl1) AS swvl1, avg(swvl2) AS swvl2, avg(swvl3) AS swvl3, avg(SoilMoi0_10cm_inst) AS g1,
        avg(SoilMoi10_40cm_inst) AS g2, avg(SoilMoi40_100cm_inst) AS g3 FROM grid_layers GROUP BY ALL),
    pr AS (SELECT layer, lat_i, lon_i, {part}(time) AS {part}, avg(sm) AS pred FROM grid_layers GROUP BY ALL),
    pd AS (SELECT layer, lat_i, lon_i, {part}, CASE e WHEN 'swvl1' THEN swvl1 WHEN 'swvl2' THEN swvl2 ELSE swvl3 END AS era5,
        0.01e0 * CASE s WHEN 'SoilMoi0_10cm_inst' THEN g1 WHEN 'SoilMoi10_40cm_inst' THEN g2 ELSE g3 END AS gldas FROM cl CROSS JOIN lay),
    mg AS (SELECT layer, lat_i, lon_i, {part}, pred, era5, gldas, SMCI * 0.001e0 AS smci FROM pr FULL JOIN pd USING (layer, lat_i, lon_i, {part})
        FULL JOIN sm USING (layer, lat_i, lon_i, {part}))
    SELECT layer, lat_i, lon_i, {part}, pred * band1 AS pred, (era5 - pred) * band1 AS era5_diff, (gldas - pred) * band1 AS gldas_diff,
    (smci - pred) * band1 AS smci_diff FROM mg LEFT JOIN grid_mask USING (lat_i, lon_i)"""
DIFFS = "pred era5_diff gldas_diff smci_diff"


@query("c01_monthly_maps", MAPS.replace("{part}", "month"), floats=DIFFS, ints="month")
def monthly_maps(spark, sf):
    return _maps(spark, sf, "month")


@query("c02_yearly_maps", MAPS.replace("{part}", "year"), floats=DIFFS, ints="year")
def yearly_maps(spark, sf):
    return _maps(spark, sf, "year")


@query("f17_difference", """SELECT layer, lat_i, lon_i, time, swvl1 - sm AS diff FROM grid_layers""", floats="diff", dates="time")
def difference(spark, sf):
    return b.grid_layers(spark, sf).select("layer", "lat_i", "lon_i", "time", (F.col("swvl1") - F.col("sm")).alias("diff"))


THREE = """SELECT layer, lat_i, lon_i, {part}(time) AS {part}, avg(sm) * any_value(band1) AS base, avg(swvl1) * any_value(band1) AS best,
    avg((sm + swvl1) / 2) * any_value(band1) AS ensemble FROM grid_layers LEFT JOIN grid_mask USING (lat_i, lon_i) GROUP BY ALL"""


def _three(spark, sf, part):
    layers = b.grid_layers(spark, sf).select("layer", "lat_i", "lon_i", "time", F.col("sm").alias("base"), F.col("swvl1").alias("best"), ((F.col("sm") + F.col("swvl1")) / 2).alias("ensemble"))
    names, key = ["base", "best", "ensemble"], ["layer", "lat_i", "lon_i"]
    maps = states.merged_means(states.month_states(layers, "time", names, key), [*key, part], names)
    return apply_mask(maps, b.grid_mask(spark, sf), names)


@query("c03_monthly_predictions", THREE.replace("{part}", "month"), floats="base best ensemble", ints="month")
def monthly_predictions(spark, sf):
    return _three(spark, sf, "month")


@query("c03_yearly_predictions", THREE.replace("{part}", "year"), floats="base best ensemble", ints="year")
def yearly_predictions(spark, sf):
    return _three(spark, sf, "year")


@query("c07_means_of_written_states", """SELECT layer, lat_i, lon_i, year(time) AS year, avg(sm) AS sm, avg(swvl1) AS swvl1 FROM grid_layers GROUP BY ALL
    UNION ALL SELECT layer, lat_i, lon_i, 0, avg(sm), avg(swvl1) FROM grid_layers GROUP BY ALL""", floats="sm swvl1", ints="year")
def written_states(spark, sf):
    """States are written without one month, that month is added twice, and means are read back; year 0 is the long-term mean."""
    key, cols, path = ["layer", "lat_i", "lon_i"], ["sm", "swvl1"], scratch_path(spark, "states")
    found = states.month_states(b.grid_layers(spark, sf), "time", cols, key)
    late = (F.col("year") == 1997) & (F.col("month") == 3)
    states.write_states(found.where(~late), path)
    for _ in range(2):
        states.write_states(found.where(late), path)
    held = states.read_states(spark, path)
    yearly = states.merged_means(held, [*key, "year"], cols)
    return yearly.unionByName(states.merged_means(held, key, cols).withColumn("year", F.lit(0)))


KEPT = f"SELECT * FROM ({PAIRS}) WHERE NOT (exp = 'c' AND layer = 'layer1')"


@query("c04_metric_collection", f"""SELECT exp, split_method, layer, m.r, m.rmse, m.ubrmse, g.r2 AS r2_total, g.r AS r_total, g.rmse AS rmse_total,
    g.ubrmse AS ubrmse_total FROM (SELECT exp, split_method, layer, avg(rmse) AS rmse, avg(r) AS r, avg(ubrmse) AS ubrmse FROM
    (SELECT exp, split_method, layer, station_idx, {ALL} FROM ({KEPT}) GROUP BY exp, split_method, layer, station_idx) GROUP BY ALL) m
    JOIN (SELECT exp, split_method, layer, {ALL} FROM ({KEPT}) GROUP BY exp, split_method, layer) g USING (exp, split_method, layer)""",
       floats="r rmse ubrmse r2_total r_total rmse_total ubrmse_total")
def collection(spark, sf):
    return evaluation.metric_collection(b.scores_long(spark, sf), {"c": ["layer1"]})


@query("c05_insitu_collection", f"""SELECT CASE exp WHEN 'a' THEN 'ERA5-Land' WHEN 'b' THEN 'GLDAS-2.1' ELSE 'SMCI1.0_9km' END AS exp, split_method, layer,
    station_idx, {RMSE} AS rmse, {R} AS r, {UB} AS ubrmse, count(*) AS "count" FROM ({KEPT}) GROUP BY exp, split_method, layer, station_idx""",
       floats="rmse r ubrmse")
def insitu(spark, sf):
    names = {"a": "ERA5-Land", "b": "GLDAS-2.1", "c": "SMCI1.0_9km"}
    return evaluation.insitu_collection(b.scores_long(spark, sf), names, {"c": ["layer1"]})


ENSEMBLE = "(coalesce(pred_a, 0) + coalesce(pred_b, 0) + coalesce(pred_c, 0)) / (CASE WHEN pred_c IS NULL THEN 2e0 ELSE 3e0 END)"
NAMES = ["pred_a", "pred_b", "pred_c", "ensemble"]
RUNS = ["base", *NAMES]


@query("c06_discussion_summary", f""", lg AS (SELECT split_method, layer, station_idx, "true",
    unnest(['base', 'pred_a', 'pred_b', 'pred_c', 'ensemble']) AS exp, unnest([0, 1, 2, 3, 4]) AS pos,
    unnest([0.25e0 * pred_a + 0.5e0 * pred_b, pred_a, pred_b, pred_c, {ENSEMBLE}]) AS pred FROM scores_wide),
    st AS (SELECT split_method, layer, station_idx, exp, pos, {RMSE} AS rmse, {R} AS r, {UB} AS ubrmse FROM lg WHERE pred IS NOT NULL GROUP BY split_method, layer, station_idx, exp, pos),
    ok AS (SELECT split_method, layer, station_idx FROM st GROUP BY ALL HAVING count(*) = 5),
    al AS (SELECT * FROM st JOIN ok USING (split_method, layer, station_idx)),
    bs AS (SELECT layer, exp FROM (SELECT *, row_number() OVER (PARTITION BY split_method, layer, station_idx ORDER BY r DESC, pos) AS rn FROM al WHERE r IS NOT NULL) WHERE rn = 1
        UNION ALL SELECT layer, exp FROM (SELECT *, row_number() OVER (PARTITION BY split_method, layer, station_idx ORDER BY rmse, pos) AS rn FROM al) WHERE rn = 1
        UNION ALL SELECT layer, exp FROM (SELECT *, row_number() OVER (PARTITION BY split_method, layer, station_idx ORDER BY ubrmse, pos) AS rn FROM al) WHERE rn = 1),
    c AS (SELECT layer, count(*)::DOUBLE AS n, {", ".join(f"count(*) FILTER (exp = '{n}')::DOUBLE AS {n}" for n in RUNS)} FROM bs GROUP BY layer)
    SELECT layer, 'count' AS kind, {", ".join(RUNS)} FROM c UNION ALL SELECT layer, 'share', {", ".join(f"{n} / n" for n in RUNS)} FROM c""",
       floats=" ".join(RUNS))
def discussion(spark, sf):
    wide = b.scores_wide(spark, sf).withColumn("base", F.col("pred_a") * 0.25 + F.col("pred_b") * 0.5)
    return evaluation.discussion_summary(wide, NAMES[:3], NAMES[:3], base=["base"])
