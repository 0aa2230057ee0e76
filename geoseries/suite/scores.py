"""Score tables, metrics, rankings."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoseries.operators import compare, metrics, splits
from geoseries.suite import bindings as b
from geoseries.suite.registry import query
from geoseries.suite.timeseries import SPATIAL_SQL

R2 = '1 - sum(("true" - pred) * ("true" - pred)) / nullif(var_pop("true") * count(*), 0)'
R = 'covar_pop("true", pred) / nullif(stddev_pop("true") * stddev_pop(pred), 0)'
RMSE = 'sqrt(avg(("true" - pred) * ("true" - pred)))'
UB = 'stddev_pop("true" - pred)'
ALL = f"{R2} AS r2, {R} AS r, {RMSE} AS rmse, {UB} AS ubrmse"
PAIRS = 'SELECT * FROM scores_long WHERE pred IS NOT NULL AND "true" IS NOT NULL'


@query("a09_pooled_metrics", f"""SELECT exp, layer, {R2} AS r2_total, {R} AS r_total, {RMSE} AS rmse_total, {UB} AS ubrmse_total
    FROM ({PAIRS}) GROUP BY ALL""", floats="r2_total r_total rmse_total ubrmse_total")
def pooled(spark, sf):
    return metrics.pooled_metrics(b.scores_long(spark, sf), ["exp", "layer"])


STATIONS = f"""SELECT exp, station_idx, {RMSE} AS rmse, {R} AS r, {UB} AS ubrmse, count(*) AS "count", {R2} AS r2 FROM ({PAIRS}) GROUP BY ALL"""


@query("a10_station_metrics", STATIONS, floats="rmse r ubrmse r2")
def per_station(spark, sf):
    return metrics.station_metrics(b.scores_long(spark, sf), ["exp", "station_idx"])


@query("a11_macro_metrics", f"SELECT exp, avg(rmse) AS rmse, avg(r) AS r, avg(ubrmse) AS ubrmse FROM ({STATIONS}) GROUP BY exp",
       floats="rmse r ubrmse")
def macro(spark, sf):
    return metrics.macro_metrics(metrics.station_metrics(b.scores_long(spark, sf), ["exp", "station_idx"]), ["exp"])


@query("a12_run_metrics", """SELECT avg((t - pred) * (t - pred)) AS mse, sqrt(avg((t - pred) * (t - pred))) AS rmse, avg(abs(t - pred)) AS mae,
    1 - sum((t - pred) * (t - pred)) / (var_pop(t) * count(*)) AS r2, covar_pop(t, pred) / (stddev_pop(t) * stddev_pop(pred)) AS r,
    stddev_pop(t - pred) AS ubrmse, 1 - sum((o - pred) * (o - pred)) / (var_pop(o) * count(*)) AS origin_r2, 'a' AS exp, 'all' AS layer
    FROM (SELECT "true" AS o, "true" * 0.5e0 + 0.2e0 AS t, pred_a AS pred FROM scores_wide)""",
       floats="mse rmse mae r2 r ubrmse origin_r2")
def run_record(spark, sf):
    rows = b.scores_wide(spark, sf).select(
        F.col("true").alias("origin"), (F.col("true") * 0.5 + 0.2).alias("true"), F.col("pred_a").alias("pred")
    )
    return metrics.run_metrics(rows, {"exp": "a", "layer": "all"}, origin="origin")


VALID = 'SELECT station_idx, "true", pred_b AS pred, CAST(l_linenumber < 6 AS INT) AS Is_valid FROM scores_wide'


@query("a13_combined_metrics", f"""SELECT m.*, g.* FROM (SELECT avg(r2) AS r2, avg(rmse) AS rmse, avg(r) AS r, avg(ubrmse) AS ubrmse FROM
    (SELECT station_idx, {ALL} FROM ({VALID}) WHERE Is_valid = 1 GROUP BY station_idx)) m,
    (SELECT {R2} AS global_r2, {RMSE} AS global_rmse, {R} AS global_r, {UB} AS global_ubrmse FROM ({VALID}) WHERE Is_valid = 1) g""",
       floats="r2 rmse r ubrmse global_r2 global_rmse global_r global_ubrmse")
def combined(spark, sf):
    rows = b.scores_wide(spark, sf).select(
        "station_idx", "true", F.col("pred_b").alias("pred"), (F.col("l_linenumber") < 6).cast("int").alias("Is_valid")
    )
    return metrics.combined_metrics(rows)


@query("a14_metric_medians", f"""SELECT exp, median(rmse) AS rmse, median(r) AS r, median(ubrmse) AS ubrmse FROM ({STATIONS}) GROUP BY exp""",
       floats="rmse r ubrmse")
def medians(spark, sf):
    return metrics.metric_medians(metrics.station_metrics(b.scores_long(spark, sf), ["exp", "station_idx"]), ["exp"])


LAYER_STATIONS = f"""SELECT exp, layer, station_idx, {RMSE} AS rmse, {R} AS r, {UB} AS ubrmse FROM ({PAIRS}) GROUP BY ALL"""
WIDE = f"""SELECT layer, station_idx, {", ".join(f"max({m}) FILTER (exp = '{e}') AS {e}_{m}" for e in "abc" for m in metrics.METRICS)}
    FROM ({LAYER_STATIONS}) GROUP BY ALL HAVING count(*) = 3"""


def _wide(spark, sf):
    stations = metrics.station_metrics(b.scores_long(spark, sf), ["exp", "layer", "station_idx"])
    tables = {e: stations.where(F.col("exp") == e) for e in "abc"}
    return metrics.merge_metrics(tables, ["layer", "station_idx"])


WIDE_COLS = " ".join(f"{e}_{m}" for e in "abc" for m in metrics.METRICS)


@query("j08_merge_metrics", WIDE, floats=WIDE_COLS)
def merge_metrics(spark, sf):
    return _wide(spark, sf)


def _pick(metric: str, order: str) -> str:
    cols = ", ".join(f"('{e}', {i}, {e}_{metric})" for i, e in enumerate("abc"))
    return f"""(SELECT name FROM (VALUES {cols}) t(name, pos, v) WHERE v IS NOT NULL ORDER BY v {order}, pos LIMIT 1)"""


BEST = f"""SELECT layer, station_idx, {_pick('r', 'DESC')} AS best_r, {_pick('rmse', 'ASC')} AS best_rmse, {_pick('ubrmse', 'ASC')} AS best_ubrmse
    FROM ({WIDE})"""


def _best(spark, sf):
    wide = _wide(spark, sf)
    for m in metrics.METRICS:
        wide = metrics.best_estimator(wide, list("abc"), m, f"best_{m}")
    return wide.select("layer", "station_idx", "best_r", "best_rmse", "best_ubrmse")


@query("o03_best_estimator", BEST)
def best(spark, sf):
    return _best(spark, sf)


LONG_BEST = f"""SELECT layer, unnest([best_r, best_rmse, best_ubrmse]) AS best FROM ({BEST})"""


def _long_best(spark, sf):
    return _best(spark, sf).select("layer", F.explode(F.array("best_r", "best_rmse", "best_ubrmse")).alias("best"))


@query("a15_winner_table", f""", c AS (SELECT layer, count(*)::DOUBLE AS n, count(*) FILTER (best = 'a')::DOUBLE AS a, count(*) FILTER (best = 'b')::DOUBLE AS b,
    count(*) FILTER (best = 'c')::DOUBLE AS c FROM ({LONG_BEST}) WHERE best IS NOT NULL GROUP BY layer)
    SELECT layer, 'count' AS kind, a, b, c FROM c UNION ALL SELECT layer, 'share', a / n, b / n, c / n FROM c""", floats="a b c")
def winners(spark, sf):
    return metrics.winner_table(_long_best(spark, sf), ["layer"], list("abc"))


@query("o05_best_per_layer", f"""SELECT layer, best, wins FROM (SELECT layer, best, count(*) AS wins, row_number() OVER (PARTITION BY layer
    ORDER BY count(*) DESC, best) AS rn FROM ({LONG_BEST}) WHERE best IS NOT NULL GROUP BY layer, best) WHERE rn = 1""")
def best_layer(spark, sf):
    return metrics.best_per_layer(_long_best(spark, sf))


def _corr(i: str, j: str) -> str:
    both = f'FILTER ({i} IS NOT NULL AND {j} IS NOT NULL)'
    return f"covar_pop({i}, {j}) {both} / nullif(stddev_pop({i}) {both} * stddev_pop({j}) {both}, 0)"


CORR_COLS = ["pred_a", "pred_b", "pred_c", "true"]


@query("a16_corr_matrix", " UNION ALL ".join(
    f"""SELECT '{a}' AS a, '{c}' AS b, {_corr('"' + a + '"', '"' + c + '"')} AS r FROM scores_wide"""
    for i, a in enumerate(CORR_COLS) for c in CORR_COLS[:i]
), floats="r")
def corr(spark, sf):
    return metrics.corr_matrix(b.scores_wide(spark, sf), CORR_COLS)


@query("a17_box_stats", """, q AS (SELECT layer, quantile_cont("true", 0.25) AS q1, quantile_cont("true", 0.5) AS median, quantile_cont("true", 0.75) AS q3
    FROM scores_wide GROUP BY ALL),
    s AS (SELECT *, "true" BETWEEN q1 - 0.4e0 * (q3 - q1) AND q3 + 0.4e0 * (q3 - q1) AS ok FROM scores_wide JOIN q USING (layer))
    SELECT layer, least(min("true") FILTER (ok), q1) AS whisker_low, q1, median, q3, greatest(max("true") FILTER (ok), q3) AS whisker_high,
    count(*) AS n, count(*) FILTER (NOT ok) AS n_outliers FROM s GROUP BY layer, q1, median, q3""",
       floats="whisker_low q1 median q3 whisker_high")
def box(spark, sf):
    return metrics.box_stats(b.scores_wide(spark, sf), ["layer"], "true", whis=0.4)


@query("a18_masked_mse", f"""SELECT station_idx, sum(("true" - pred) * ("true" - pred) * Is_valid) / nullif(sum(Is_valid), 0) AS masked_mse
    FROM ({VALID}) GROUP BY ALL""", floats="masked_mse")
def masked(spark, sf):
    rows = b.scores_wide(spark, sf).select(
        "station_idx", "true", F.col("pred_b").alias("pred"), (F.col("l_linenumber") < 6).cast("int").alias("Is_valid")
    )
    return metrics.masked_mse(rows, ["station_idx"])


@query("a19_standardize", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt AS "day",
    (l_quantity - avg(l_quantity) OVER ()) / stddev_pop(l_quantity) OVER () AS l_quantity,
    (p_size - avg(p_size) OVER ()) / stddev_pop(p_size) OVER () AS p_size FROM features""", floats="l_quantity p_size", dates="day")
def standardize(spark, sf):
    return metrics.standardize(b.features(spark, sf).select(*b.KEYS, "l_quantity", "p_size"), ["l_quantity", "p_size"])


@query("a20_accuracy", """SELECT avg(acc) AS accuracy FROM (SELECT l_linenumber, avg(CASE WHEN (l_returnflag = 'A') = (l_linestatus = 'F')
    THEN 1e0 ELSE 0e0 END) AS acc FROM lineitem GROUP BY ALL)""", floats="accuracy")
def accuracy(spark, sf):
    rows = b.table(spark, sf, "lineitem").select(
        "l_linenumber", (F.col("l_returnflag") == "A").alias("label"), (F.col("l_linestatus") == "F").alias("pred")
    )
    return metrics.accuracy(rows, "label", "pred", "l_linenumber")


MEMBERS = ["pred_a", "pred_b", "pred_c"]
ENSEMBLE = "(coalesce(pred_a, 0) + coalesce(pred_b, 0) + coalesce(pred_c, 0)) / (CASE WHEN pred_c IS NULL THEN 2e0 ELSE 3e0 END)"


@query("a21_ensemble_mean", f"""SELECT station_idx, date_time, l_orderkey, l_linenumber, l_partkey, {ENSEMBLE} AS pred FROM scores_wide""", floats="pred", dates="date_time")
def ensemble(spark, sf):
    return metrics.ensemble_mean(b.scores_wide(spark, sf), MEMBERS).select(
        "station_idx", "date_time", "l_orderkey", "l_linenumber", "l_partkey", "pred"
    )


SWEEP = f"""SELECT layer, station_idx, "true", 'pred_a' AS exp, pred_a AS pred FROM scores_wide
    UNION ALL SELECT layer, station_idx, "true", 'pred_b', pred_b FROM scores_wide
    UNION ALL SELECT layer, station_idx, "true", 'pred_c', pred_c FROM scores_wide WHERE pred_c IS NOT NULL
    UNION ALL SELECT layer, station_idx, "true", 'ensemble', {ENSEMBLE} FROM scores_wide"""
SWEEP_METRICS = f"""SELECT exp, layer, m.r2, m.r, m.rmse, m.ubrmse, g.r2 AS r2_total, g.r AS r_total, g.rmse AS rmse_total, g.ubrmse AS ubrmse_total
    FROM (SELECT exp, layer, avg(r2) AS r2, avg(r) AS r, avg(rmse) AS rmse, avg(ubrmse) AS ubrmse FROM
    (SELECT exp, layer, station_idx, {ALL} FROM ({SWEEP}) GROUP BY exp, layer, station_idx) GROUP BY exp, layer) m
    JOIN (SELECT exp, layer, {ALL} FROM ({SWEEP}) GROUP BY exp, layer) g USING (exp, layer)"""


# The earlier runs come with station means only, under their published name.
@query("a22_sweep_metrics", f"""SELECT * FROM ({SWEEP_METRICS}) UNION ALL SELECT 'base', layer, NULL, r, rmse, ubrmse, NULL, NULL, NULL, NULL
    FROM ({SWEEP_METRICS}) WHERE exp = 'pred_b'""", floats="r2 r rmse ubrmse r2_total r_total rmse_total ubrmse_total")
def sweep(spark, sf):
    wide = b.scores_wide(spark, sf)
    earlier = metrics.station_metrics(wide.select("layer", "station_idx", "true", F.col("pred_b").alias("pred")), ["layer", "station_idx"])
    earlier = earlier.groupBy("layer").agg(*[F.avg(m).alias(m) for m in metrics.METRICS])
    return metrics.sweep_metrics(wide, MEMBERS, ["layer"], base=metrics.with_labels(earlier, {"exp": "base"}))


@query("j09_align_predictions", """SELECT l_orderkey, l_linenumber, l_partkey, station_idx, date_time, "true", pred_a AS a, pred_c AS c FROM scores_wide""",
       floats="true a c", dates="date_time")
def align(spark, sf):
    wide = b.scores_wide(spark, sf)
    key = ["l_orderkey", "l_linenumber", "l_partkey", "station_idx", "date_time"]
    tables = {n: wide.select(*key, "true", F.col(f"pred_{n}").alias("pred")) for n in ("a", "c")}
    return metrics.align_preds(tables, key)


@query("j10_labelled_record", f"""SELECT m.rmse, m.r, m.ubrmse, g.r2_total, 'pred_a' AS exp, 'all' AS layer FROM
    (SELECT avg(rmse) AS rmse, avg(r) AS r, avg(ubrmse) AS ubrmse FROM ({STATIONS}) WHERE exp = 'a') m,
    (SELECT {R2} AS r2_total FROM ({PAIRS}) WHERE exp = 'a') g""", floats="rmse r ubrmse r2_total")
def labelled(spark, sf):
    rows = b.scores_wide(spark, sf).select("station_idx", "true", F.col("pred_a").alias("pred"))
    log = metrics.macro_metrics(metrics.station_metrics(rows))
    total = metrics.pooled_metrics(rows).select("r2_total")
    return metrics.with_labels(metrics.beside(log, total), {"exp": "pred_a", "layer": "all"})


IMPORTANCE = """SELECT l_suppkey AS station, l_linenumber AS repeat, unnest(['lon', 'month_1', 'l_tax', 'l_discount', 'l_quantity']) AS feature,
    unnest([avg(l_extendedprice) / 1000, 9e0, avg(l_tax), avg(l_discount), avg(l_quantity) / 500]) AS value FROM lineitem GROUP BY l_suppkey, l_linenumber"""


def _importance(spark, sf):
    wide = b.table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("station"), F.col("l_linenumber").alias("repeat")).agg(
        (F.avg("l_extendedprice") / 1000).alias("lon"), F.lit(9.0).alias("month_1"), F.avg("l_tax").alias("l_tax"),
        F.avg("l_discount").alias("l_discount"), (F.avg("l_quantity") / 500).alias("l_quantity"),
    )
    return wide.unpivot(["station", "repeat"], ["lon", "month_1", "l_tax", "l_discount", "l_quantity"], "feature", "value")


@query("o02_rank_features", f"""SELECT feature, avg(value) AS importance, row_number() OVER (ORDER BY avg(value), feature) AS position
    FROM ({IMPORTANCE}) WHERE feature NOT LIKE 'month%' GROUP BY feature""", floats="importance")
def rank(spark, sf):
    return metrics.rank_features(_importance(spark, sf))


@query("o04_top_feature", f"""SELECT station, feature AS variable, value FROM (SELECT station, feature, avg(value) AS value,
    row_number() OVER (PARTITION BY station ORDER BY avg(value) DESC, feature) AS rn FROM ({IMPORTANCE})
    WHERE feature NOT LIKE 'month%' AND feature NOT IN ('lon', 'lat') GROUP BY station, feature) WHERE rn = 1""", floats="value")
def top(spark, sf):
    means = _importance(spark, sf).groupBy("station", "feature").agg(F.avg("value").alias("importance"))
    return metrics.top_feature(means, ["station"])


@query("o06_select_seed", """SELECT layer, seed, accuracy FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY abs(accuracy - 0.5e0), seed) AS rn
    FROM seed_log) WHERE rn = 1""", floats="accuracy")
def seed(spark, sf):
    return metrics.select_seed(b.seed_log(spark, sf))


@query("m13_product_baseline", SPATIAL_SQL.replace("station_raw", "scores_wide").replace("station_id", "station_idx") + f""",
    rows AS (SELECT station_idx, "true", CASE layer WHEN 'layer1' THEN pred_a WHEN 'layer2' THEN pred_b ELSE pred_c END AS pred
        FROM scores_wide JOIN sp USING (station_idx) WHERE status = 'test')
    SELECT station_idx, {RMSE} AS rmse, {R} AS r, {UB} AS ubrmse, count(*) AS "count", {R2} AS r2 FROM rows WHERE pred IS NOT NULL
    GROUP BY ALL""", floats="rmse r ubrmse r2")
def baseline(spark, sf):
    split = splits.spatial_split(b.scores_wide(spark, sf), "station_idx", 42)
    names = {"layer1": "pred_a", "layer2": "pred_b", "layer3": "pred_c", "layer4": "pred_c", "layer5": "pred_c"}
    pred = compare.pick_layer_var(F.col("layer"), names)
    rows = compare.product_baseline(split.where(F.col("status") == "test"), pred, "station_idx", "date_time", "true")
    return metrics.station_metrics(rows)


@query("flagship_station_scores", f""", r AS (SELECT *, row_number() OVER (PARTITION BY station_id ORDER BY date_time) AS rn,
    count(*) OVER (PARTITION BY station_id) AS n FROM station_daily),
    m AS (SELECT station_id, avg(soil_moisture) AS pred FROM r WHERE rn <= floor(n * (1 - 0.2e0)) GROUP BY ALL),
    t AS (SELECT r.station_id AS station_idx, m.pred, r.soil_moisture AS "true" FROM r JOIN m USING (station_id) WHERE rn > floor(n * (1 - 0.2e0)))
    SELECT station_idx, {RMSE} AS rmse, {UB} AS ubrmse, count(*) AS "count", {R2} AS r2 FROM t GROUP BY ALL""", floats="rmse ubrmse r2")
def flagship(spark, sf):
    """Mask, daily means, temporal hold-out, train-mean baseline, station scores."""
    split = splits.temporal_split(b.station_daily(spark, sf), "station_id", "date_time")
    means = split.where(F.col("status") == "train").groupBy("station_id").agg(F.avg("soil_moisture").alias("mean"))
    test = split.where(F.col("status") == "test").join(means, "station_id")
    rows = compare.product_baseline(test, F.col("mean"), "station_id", "date_time", "soil_moisture")
    return metrics.station_metrics(rows).drop("r")


