"""Model jobs and explanation jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from geoseries.operators import explain, models, permutation, splits
from geoseries.plans.training import train_and_score
from geoseries.session import scratch_path, written
from geoseries.suite import bindings as b
from geoseries.suite.registry import query

FEATURES, KEYS, LABEL = b.FEATURES, b.KEYS, b.LABEL
COEF = dict(b.LINEAR.coefficients)
R2 = "1 - sum((l_extendedprice - p) * (l_extendedprice - p)) / nullif(var_pop(l_extendedprice) * count(*), 0)"


def _split(spark, sf, seed=42):
    return splits.spatial_split(b.features(spark, sf), "l_suppkey", seed)


def _forest(spark, sf, rows=None):
    return models.fit_family(b.features(spark, sf) if rows is None else rows, FEATURES, LABEL, "rf", numTrees=10, maxDepth=5)


def _stored(spark, sf):
    """The feature table joined once, for jobs that read it several times."""
    return written(b.features(spark, sf), "features")


@query("m04_build_features", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, dt AS "day", l_quantity, l_discount, l_tax, p_size, p_retailprice,
    s_acctbal, """ + ", ".join(f"CAST(month(dt) = {m} AS INT) AS month_{m}" for m in range(1, 13)) + " FROM features",
       floats="l_quantity l_discount l_tax p_size p_retailprice s_acctbal", ints=" ".join(f"month_{m}" for m in range(1, 13)), dates="day")
def feature_table(spark, sf):
    table, names = models.build_features(b.features(spark, sf).withColumn("LAND_COVER", F.lit(1)), "day", LABEL)
    return table.select(*dict.fromkeys([*KEYS, *names]))


# Two-valued features have closed-form fits: a logistic one predicts each group's share, a tree of one split each group's mean.

def _low_line():
    return (F.col("l_linenumber") <= 3).cast("double")


SPLIT_SQL = """, sp AS (SELECT f.*, CASE WHEN rn <= ceil(n * 0.2e0) THEN 1 ELSE 0 END AS is_test, l_linenumber <= 3 AS low FROM features f
    JOIN (SELECT l_suppkey, row_number() OVER (ORDER BY md5(concat('42:', l_suppkey))) AS rn, count(*) OVER () AS n FROM
    (SELECT DISTINCT l_suppkey FROM features)) s USING (l_suppkey))"""


def _exact_fit():
    return {"maxIter": 200, "tol": 1e-12}


@query("m05_weights_two_groups", SPLIT_SQL + """ SELECT low, (SELECT avg(is_test) FROM sp a WHERE a.low = b.low) AS weight, count(*) AS n
    FROM sp b WHERE is_test = 0 GROUP BY low""", floats="weight", digits=4)
def weights_two_groups(spark, sf):
    split = _split(spark, sf).withColumn("low", _low_line())
    weighted = models.adversarial_weights(split, ["low"], "lr", params=_exact_fit())
    return weighted.groupBy((F.col("low") > 0).alias("low")).agg(F.avg("weight").alias("weight"), F.count(F.lit(1)).alias("n"))


@query("m06_accuracy_two_groups", SPLIT_SQL + """ SELECT avg(CASE WHEN (share > 0.5e0) = (is_test = 1) THEN 1e0 ELSE 0 END) AS accuracy
    FROM sp JOIN (SELECT low, avg(is_test) AS share FROM sp GROUP BY low) USING (low)""", floats="accuracy")
def accuracy_two_groups(spark, sf):
    return models.adversarial_accuracy(_split(spark, sf).withColumn("low", _low_line()), ["low"], "lr", params=_exact_fit()).toDF("accuracy")


@query("m10_line_fit", "SELECT regr_r2(l_extendedprice, l_quantity) AS r2 FROM features", floats="r2")
def line_fit(spark, sf):
    rows = b.features(spark, sf)
    return models.train_r2(models.fit_family(rows, ["l_quantity"], LABEL, "lr"), rows, LABEL)


@query("m10_line_fit_with_gaps", """SELECT regr_r2(l_extendedprice, x) AS r2 FROM (SELECT l_extendedprice, CASE WHEN l_linenumber NOT IN (2, 4) THEN l_quantity END AS x FROM features)""", floats="r2")
def line_fit_with_gaps(spark, sf):
    gap = F.when(F.col("l_linenumber") == 2, F.lit(None)).when(F.col("l_linenumber") == 4, F.lit(float("nan"))).otherwise(F.col("l_quantity"))
    rows = b.features(spark, sf).withColumn("x", gap)
    scorer = models.fit_family(rows, ["x"], LABEL, "lr", missing="skip")
    return models.train_r2(scorer, rows.where(F.col("x").isNotNull() & ~F.isnan("x")), LABEL)


@query("m10_tree_two_groups", """SELECT 1 - sum((l_extendedprice - m) * (l_extendedprice - m)) / (var_pop(l_extendedprice) * count(*)) AS r2
    FROM (SELECT l_extendedprice, avg(l_extendedprice) OVER (PARTITION BY l_linenumber <= 3) AS m FROM features)""", floats="r2")
def tree_two_groups(spark, sf):
    rows = b.features(spark, sf).withColumn("low", _low_line())
    return models.train_r2(models.fit_family(rows, ["low"], LABEL, "dt", maxDepth=1), rows, LABEL)


@query("m12_final_line", "SELECT regr_r2(l_extendedprice, l_quantity) AS r2 FROM features", floats="r2")
def final_line(spark, sf):
    split = _split(spark, sf)
    train, test = split.where(F.col("status") == "train"), split.where(F.col("status") == "test")
    return models.train_r2(models.fit_final(train, test, ["l_quantity"], LABEL, "lr", {}), split, LABEL)


@query("m17_saved_line", "SELECT regr_r2(l_extendedprice, l_quantity) AS r2 FROM features", floats="r2")
def saved_line(spark, sf):
    rows, path = b.features(spark, sf), scratch_path(spark, "line")
    models.save_model(models.fit_family(rows, ["l_quantity"], LABEL, "lr"), path)
    return models.train_r2(models.load_model(path), rows, LABEL)


@query("m05_adversarial_weights")
def weights(spark, sf):
    return models.adversarial_weights(_split(spark, sf), FEATURES).select(*KEYS, "weight")


@query("m06_adversarial_accuracy")
def adversarial_accuracy(spark, sf):
    return models.adversarial_accuracy(_split(spark, sf), FEATURES)


@query("m07_adversarial_cv")
def adversarial_cv(spark, sf):
    return models.adversarial_cv(_split(spark, sf), FEATURES, KEYS, 5, "lr")


@query("m07_cv_two_groups", SPLIT_SQL + """, fd AS (SELECT *, (row_number() OVER (PARTITION BY is_test ORDER BY md5(concat_ws(':', '2023', id)), low) - 1) % 5 AS fold FROM sp),
    sh AS (SELECT t.fold, low, avg(is_test) AS share FROM fd JOIN (SELECT unnest(range(5)) AS fold) t ON t.fold <> fd.fold GROUP BY t.fold, low)
    SELECT fold, avg(CASE WHEN (share > 0.5e0) = (is_test = 1) THEN 1e0 ELSE 0e0 END) AS accuracy FROM fd JOIN sh USING (fold, low) GROUP BY fold""",
       floats="accuracy", ints="fold")
def cv_two_groups(spark, sf):
    return models.adversarial_cv(_split(spark, sf).withColumn("low", _low_line()), ["low"], KEYS, 5, "lr")


SEEDS = list(range(1, 21))


@query("m08_seed_sweep")
def seed_sweep(spark, sf):
    return models.seed_sweep(b.features(spark, sf), "l_suppkey", FEATURES, KEYS, SEEDS, k=5)


@query("m08_sweep_two_groups", f""", sd AS (SELECT unnest(range(1, {SEEDS[-1] + 1})) AS seed),
    st AS (SELECT seed, l_suppkey, row_number() OVER (PARTITION BY seed ORDER BY md5(concat(seed, ':', l_suppkey))) <= ceil(count(*) OVER (PARTITION BY seed) * 0.2e0) AS held
        FROM (SELECT DISTINCT l_suppkey FROM features), sd),
    fd AS (SELECT seed, held, l_linenumber <= 3 AS low, CAST('0x' || substr(md5(concat_ws(':', seed || ':fold', id)), 1, 8) AS BIGINT) % 5 AS fold FROM features JOIN st USING (l_suppkey)),
    ct AS (SELECT seed, fold, low, count(*) AS n, count(*) FILTER (WHERE held) AS k FROM fd GROUP BY ALL),
    sh AS (SELECT seed, fold, low, n, k, (sum(k) OVER w - k) / (sum(n) OVER w - n) AS share FROM ct WINDOW w AS (PARTITION BY seed, low)),
    ac AS (SELECT seed, fold, sum(CASE WHEN share > 0.5e0 THEN k ELSE n - k END) / sum(n) AS accuracy FROM sh GROUP BY seed, fold)
    SELECT avg(accuracy) AS accuracy, 'spatial' AS split_method, seed FROM ac GROUP BY seed""", floats="accuracy", ints="seed")
def sweep_two_groups(spark, sf):
    rows = b.features(spark, sf).withColumn("low", _low_line())
    return models.seed_sweep(rows, "l_suppkey", ["low"], KEYS, SEEDS, k=5).drop("layer")


@query("m09_fit_best")
def fit_best(spark, sf):
    split = written(_split(spark, sf), "split")  # joined once for the weights and the folds
    weighted = models.adversarial_weights(split, FEATURES, "lr")
    families = {"lr": {"regParam": [0.0, 0.1]}, "dt": {"maxDepth": [3, 5]}, "rf": {"numTrees": [10], "maxDepth": [5]}}
    return models.fit_best(weighted, FEATURES, LABEL, KEYS, families, "weight", folds=10)[1]


@query("m10_families")
def families(spark, sf):
    split = written(_split(spark, sf), "split")  # joined once for all fits and scores
    train, test = split.where(F.col("status") == "train"), split.where(F.col("status") == "test")
    params = {"lr": {}, "glr": {}, "dt": {}, "rf": {"numTrees": 10}, "gbt": {"maxIter": 5}}
    result = None
    for name, options in params.items():
        scorer = models.fit_family(train, FEATURES, LABEL, name, **options)
        part = models.train_r2(scorer, test, LABEL).withColumn("family", F.lit(name))
        result = part if result is None else result.unionByName(part)
    return result


@query("m11_forest_tuned")
def forest_tuned(spark, sf):
    train = _split(spark, sf).where(F.col("status") == "train")
    return models.fit_rf_tuned(train, FEATURES, LABEL, KEYS)[1]


# Both candidates are a tree of one split on a two-valued feature, so each round's score is that of the two group means.
@query("m11_halving_two_groups", """, h AS (SELECT l_extendedprice AS y, l_linenumber <= 3 AS low, CAST('0x' || substr(md5(concat_ws(':', '2023', id)), 1, 8) AS BIGINT) % 4 AS fold,
        CAST('0x' || substr(md5(concat_ws(':', '2023:share', id)), 1, 8) AS BIGINT) AS part FROM features),
    rd AS (SELECT i AS round, 1e0 / 2 ** (1 - i) AS share, i = 1 AS final FROM range(2) t(i)),
    us AS (SELECT round, share, final, y, low, fold FROM h JOIN rd ON final OR part < 2147483648),
    mn AS (SELECT u.round, f.fold, u.low, avg(u.y) AS m FROM us u JOIN (SELECT unnest(range(4)) AS fold) f ON f.fold <> u.fold WHERE final OR f.fold = 0 GROUP BY ALL),
    sc AS (SELECT round, share, fold, sqrt(avg((y - m) * (y - m))) AS rmse FROM us JOIN mn USING (round, fold, low) GROUP BY ALL),
    av AS (SELECT round, share, avg(rmse) AS score FROM sc GROUP BY ALL)
    SELECT round, share, depth, score, round = 0 OR depth = 1 AS survives FROM av, (SELECT unnest([1, 2, 3]) AS depth) WHERE round = 0 OR depth <= 2""".replace("round = 0 OR depth = 1 AS", "(round = 0 AND depth <= 2 OR depth = 1) AS"),
       floats="share score", ints="round depth", digits=4)
def halving_two_groups(spark, sf):
    rows = b.features(spark, sf).withColumn("low", _low_line())
    table = models.fit_halving(rows, ["low"], LABEL, KEYS, {"dt": {"maxDepth": [1, 2, 3]}}, None, 4, "rmse_total", shrink=2)[1]
    return table.select("round", "share", F.regexp_extract("params", r"(\d+)", 1).cast("long").alias("depth"), "score", "survives")


@query("m12_fit_final")
def fit_final(spark, sf):
    split = _split(spark, sf)
    scorer = models.fit_final(
        split.where(F.col("status") == "train"), split.where(F.col("status") == "test"), FEATURES, LABEL, "rf", {"numTrees": 10}
    )
    return models.train_r2(scorer, split, LABEL)


@query("m17_saved_model")
def saved_model(spark, sf):
    path = scratch_path(spark, "model")
    models.save_model(_forest(spark, sf), path)
    return models.train_r2(models.load_model(path), b.features(spark, sf), LABEL)


@query("m18_train_and_score")
def train_score(spark, sf):
    stations = b.features(spark, sf).withColumnRenamed("l_suppkey", "station_id")
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "station_id", "day"]
    trained = train_and_score(
        stations, "temporal", 42, LABEL, keys, {"lr": {"regParam": [0.0]}, "rf": {"numTrees": [10]}}, time="day"
    )
    return trained.metrics


@query("m18_test_scores_linear", f"""SELECT l_suppkey AS station_idx, dt AS date_time, {b.LINEAR_SQL} AS pred, l_extendedprice AS "true" FROM features
    JOIN (SELECT l_suppkey, row_number() OVER (ORDER BY md5(concat('42:', l_suppkey))) AS rn, count(*) OVER () AS n FROM
    (SELECT DISTINCT l_suppkey FROM features)) s USING (l_suppkey) WHERE rn <= ceil(n * 0.2e0)""", floats="pred true", digits=4, dates="date_time")
def test_scores(spark, sf):
    test = _split(spark, sf).where(F.col("status") == "test")
    return models.score_test(b.LINEAR, test, "l_suppkey", "day", LABEL)


@query("m19_train_r2_linear", f"""SELECT {R2} AS r2 FROM (SELECT l_extendedprice, {b.LINEAR_SQL} AS p FROM features)""", floats="r2")
def train_r2(spark, sf):
    return models.train_r2(b.LINEAR, b.features(spark, sf), LABEL)


GRID = models.LinearScorer({"value": 0.00001, "tp": 2.0, "swvl1": 0.5, "month_1": 0.1, "month_7": -0.1}, 0.05)
GRID_B = models.LinearScorer({"value": 0.00002, "tp": 1.0, "swvl1": 0.25, "month_1": 0.0, "month_7": -0.2}, 0.1)
GRID_SQL = """0.05e0 + 0.00001e0 * value + 2e0 * tp + 0.5e0 * swvl1 + 0.1e0 * CAST(month(time) = 1 AS INT) - 0.1e0 * CAST(month(time) = 7 AS INT)"""
GRID_B_SQL = """0.1e0 + 0.00002e0 * value + 1e0 * tp + 0.25e0 * swvl1 - 0.2e0 * CAST(month(time) = 7 AS INT)"""
GRID_FROM = """(SELECT lat_i, lon_i, time, swvl1, CASE WHEN tp > 0.01e0 THEN tp END AS tp, value FROM grid_daily
    JOIN (SELECT lat_i, lon_i, value FROM grid_static) USING (lat_i, lon_i))"""


def _grid_inputs(spark, sf):
    daily = b.grid_daily(spark, sf)
    static = [b.grid_static(spark, sf).select("lat_i", "lon_i", "value")]
    rain = daily.select("lat_i", "lon_i", "time", F.when(F.col("tp") > 0.01, F.col("tp")).alias("tp"))
    return static, [daily.select("lat_i", "lon_i", "time", "swvl1"), rain]


GRID_NAMES = ["value", "tp", "swvl1", "month_1", "month_7"]


def _grid_rows(spark, sf):
    """Training rows: the cells themselves, moisture and its covariates."""
    static, dynamic = _grid_inputs(spark, sf)
    moisture = b.grid_daily(spark, sf).select("lat_i", "lon_i", "time", "sm")
    covered = models.assemble_features(static, [*dynamic, moisture]).where(F.col("tp").isNotNull())
    return models.build_features(covered, "time", "sm", drop=[])[0].select(*GRID_NAMES, "sm")


def _grid_forest(rows, seed=2023):
    """Fitted on the cells themselves: moisture from the covariates."""
    return models.fit_family(rows, GRID_NAMES, "sm", "rf", seed=seed, numTrees=5, maxDepth=4)


@query("m14_predict_grid_linear", f"SELECT lat_i, lon_i, time, {GRID_SQL} AS sm FROM {GRID_FROM}", floats="sm", dates="time")
def predict_grid_linear(spark, sf):
    return models.predict_grid(GRID, *_grid_inputs(spark, sf))


@query("m14_predict_grid")
def predict_grid(spark, sf):
    return models.predict_grid(_grid_forest(_grid_rows(spark, sf)), *_grid_inputs(spark, sf))


@query("m15_predict_ensemble_linear", f"SELECT lat_i, lon_i, time, (({GRID_SQL}) + ({GRID_B_SQL})) / 2 AS sm FROM {GRID_FROM}", floats="sm", dates="time")
def predict_ensemble_linear(spark, sf):
    return models.predict_ensemble({"a": GRID, "b": GRID_B}, *_grid_inputs(spark, sf))


@query("m15_predict_ensemble")
def predict_ensemble(spark, sf):
    rows = written(_grid_rows(spark, sf), "cells")  # joined once for both fits
    members = {"one": _grid_forest(rows, 1), "two": _grid_forest(rows, 2)}
    return models.predict_ensemble(members, *_grid_inputs(spark, sf))


@query("m16_predict_best_linear", f"""SELECT 'layer1' AS layer, lat_i, lon_i, time, {GRID_SQL} AS sm FROM {GRID_FROM}
    UNION ALL SELECT 'layer2', lat_i, lon_i, time, {GRID_B_SQL} FROM {GRID_FROM}""", floats="sm", dates="time")
def predict_best(spark, sf):
    return models.predict_best({"a": GRID, "b": GRID_B}, {"layer1": "a", "layer2": "b"}, *_grid_inputs(spark, sf))


# Explanations. The linear scorer has closed forms, stated in SQL; the forest has none.

LONG = ", lg AS (" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS x FROM features" for f in FEATURES) + ")"
COEFS = "cf(feature, c) AS (VALUES " + ", ".join(f"('{f}', {c}::DOUBLE)" for f, c in COEF.items()) + ")"
POINTS = 100
GRIDS = LONG + f""", {COEFS}, srt AS (SELECT feature, x, row_number() OVER (PARTITION BY feature ORDER BY x) - 1 AS k, count(*) OVER (PARTITION BY feature) AS n FROM lg),
    few AS (SELECT feature, count(DISTINCT x) AS u FROM lg GROUP BY feature),
    ends AS (SELECT feature, p, greatest(least(n * p + 0.4e0 + p * 0.2e0 - 1, n - 1), 0) AS pos FROM (SELECT DISTINCT feature, n FROM srt), (VALUES (0.05e0), (0.95e0)) t(p)),
    ev AS (SELECT e.feature, e.p, a.x + (z.x - a.x) * (e.pos - floor(e.pos)) AS v FROM ends e JOIN srt a ON a.feature = e.feature AND a.k = floor(e.pos)
        JOIN srt z ON z.feature = e.feature AND z.k = ceil(e.pos)),
    rng AS (SELECT feature, min(v) AS a, max(v) AS z FROM ev GROUP BY feature),
    gr AS (SELECT feature, i AS point, a + (z - a) * i / 99e0 AS grid_value FROM rng JOIN few USING (feature), range({POINTS}) t(i) WHERE u >= {POINTS}
        UNION ALL SELECT feature, row_number() OVER (PARTITION BY feature ORDER BY x) - 1, x FROM (SELECT DISTINCT feature, x FROM lg JOIN few USING (feature) WHERE u < {POINTS}))"""


@query("x01_partial_dependence", GRIDS + f""", av AS (SELECT feature, avg(x) AS m FROM lg GROUP BY feature), mp AS (SELECT avg({b.LINEAR_SQL}) AS p FROM features)
    SELECT feature, point, grid_value, p + c * (grid_value - m) AS pd FROM gr JOIN av USING (feature) JOIN cf USING (feature), mp""",
       floats="grid_value pd", ints="point", digits=4)
def pdp_linear(spark, sf):
    return explain.pdp(b.LINEAR, b.features(spark, sf), FEATURES, POINTS)


@query("x01_partial_dependence_forest")
def pdp_forest(spark, sf):
    return explain.pdp(_forest(spark, sf), b.features(spark, sf), FEATURES, POINTS, exclude=["l_tax"])


@query("x02_ice", GRIDS + """, st AS (SELECT feature, grid_value AS g0 FROM gr WHERE point = 0), nn AS (SELECT count(*) AS n FROM features)
    SELECT feature, point, grid_value, n, c * (grid_value - g0) AS mean, c * (grid_value - g0) AS lowest, c * (grid_value - g0) AS highest
    FROM gr JOIN cf USING (feature) JOIN st USING (feature), nn""", floats="grid_value mean lowest highest", ints="point", digits=4)
def ice_linear(spark, sf):
    return explain.ice_summary(explain.ice(b.LINEAR, b.features(spark, sf), KEYS, FEATURES, POINTS))


@query("x02_ice_forest")
def ice_forest(spark, sf):
    rows = _stored(spark, sf)
    return explain.ice_summary(explain.ice(_forest(spark, sf, rows), rows, KEYS, FEATURES, POINTS))


@query("x03_accumulated_effects", LONG + f""", {COEFS}, q AS (SELECT feature, unnest(quantile_cont(x, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])) AS edge FROM lg GROUP BY feature),
    num AS (SELECT feature, edge, row_number() OVER (PARTITION BY feature ORDER BY edge) - 1 AS bin FROM (SELECT DISTINCT feature, edge FROM q)),
    w AS (SELECT *, lag(edge) OVER (PARTITION BY feature ORDER BY bin) AS lo, min(edge) OVER (PARTITION BY feature) AS e0 FROM num),
    ct AS (SELECT feature, bin, any_value(edge) AS edge, any_value(lo) AS lo, any_value(e0) AS e0, count(lg.x) AS n FROM w LEFT JOIN lg ON w.bin > 0 AND lg.feature = w.feature
        AND lg.x <= w.edge AND (lg.x > w.lo OR (w.bin = 1 AND lg.x = w.lo)) GROUP BY w.feature, bin),
    ce AS (SELECT feature, sum(n * c * ((edge + lo) / 2 - e0)) / sum(n) AS centre FROM ct JOIN cf USING (feature) WHERE bin > 0 GROUP BY feature)
    SELECT feature, bin, edge, c * (edge - e0) - centre AS ale, n FROM ct JOIN ce USING (feature) JOIN cf USING (feature)""".replace("SELECT feature, bin, any_value", "SELECT w.feature, bin, any_value"),
       floats="edge ale", ints="bin", digits=4)
def ale_linear(spark, sf):
    return explain.ale(b.LINEAR, b.features(spark, sf), FEATURES, 10)


@query("x03_accumulated_effects_forest")
def ale_forest(spark, sf):
    return explain.ale(_forest(spark, sf), b.features(spark, sf), FEATURES, 10)


TIES = ", ".join(FEATURES)


def _donors(seed: int, repeats: int, by: str = "") -> str:
    """`bs`: rows with their position in the seeded order; `dn`: the position each is sent to in each repeat."""
    part = f"PARTITION BY {by} " if by else ""
    window = f"OVER ({part}ORDER BY md5(concat_ws(':', '{seed}:base', id)), {TIES})"

    def mixed(x, factor, key):
        y = f"(({x}) * {factor} + {key}) % {permutation.PRIME}"
        return f"((({y}) * ({y})) % {permutation.PRIME})"

    rows = f"""SELECT *, CAST(floor(sqrt(n)) AS BIGINT) AS ga, n // CAST(floor(sqrt(n)) AS BIGINT) AS gb, pos - 1 AS gx,
        ({permutation.seed_number(seed)} + r * 1000003) % {permutation.PRIME} AS gk FROM bs, rp"""
    for turn, rounds in zip(permutation.TURNS, permutation.ROUNDS):
        rows = f"SELECT * REPLACE ((gx + {mixed('gk', turn, turn)}) % n AS gx) FROM ({rows})"
        rows = f"SELECT *, gx // gb AS gu, gx % gb AS gv FROM ({rows})"
        for i, factor in enumerate(rounds):
            moved, other, size = ("gv", "gu", "gb") if i % 2 == 0 else ("gu", "gv", "ga")
            rows = f"SELECT * REPLACE (({moved} + {mixed(other, factor, 'gk')}) % {size} AS {moved}) FROM ({rows})"
        rows = f"SELECT * EXCLUDE (gu, gv) REPLACE (CASE WHEN gx < ga * gb THEN gu * gb + gv ELSE gx END AS gx) FROM ({rows})"
    return f""", rp AS (SELECT unnest(range({repeats})) AS r),
    bs AS (SELECT *, {b.LINEAR_SQL} AS p, row_number() {window} AS pos, count(*) OVER ({part}) AS n FROM features),
    dn AS (SELECT * REPLACE (gx + 1 AS pos) FROM ({rows}))"""


def _delta(alias: str = "d") -> str:
    return ", ".join(f"{COEF[f]}::DOUBLE * (b.{f} - {alias}.{f})" for f in FEATURES)


NAMES_SQL = "[" + ", ".join(f"'{f}'" for f in FEATURES) + "]"


@query("x04_permutation_importance", _donors(11, 5) + f""", {COEFS},
    s AS (SELECT d.r, b.l_extendedprice, b.p, unnest({NAMES_SQL}) AS feature, unnest([{_delta()}]) AS delta FROM bs b JOIN dn d ON b.pos = d.pos),
    b0 AS (SELECT {R2} AS base FROM bs),
    v AS (SELECT feature, r, {R2} AS r2 FROM (SELECT feature, r, l_extendedprice, p - delta AS p FROM s) GROUP BY feature, r)
    SELECT feature, avg(base - r2) AS importance, stddev_pop(base - r2) AS importance_std FROM v, b0 GROUP BY feature""",
       floats="importance importance_std", digits=5)
def permutation_linear(spark, sf):
    return explain.permutation_importance(b.LINEAR, _stored(spark, sf), KEYS, LABEL, 5, 11)


@query("x04_permutation_importance_forest")
def permutation_forest(spark, sf):
    rows = _stored(spark, sf)
    return explain.permutation_importance(_forest(spark, sf, rows), rows, KEYS, LABEL, 5)


@query("x05_shapley_linear_exact", f""", m AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)} FROM features)
    SELECT feature, avg(abs(phi)) AS importance FROM (SELECT unnest({NAMES_SQL}) AS feature,
    unnest([{", ".join(f"{COEF[f]}::DOUBLE * ({f} - m_{f})" for f in FEATURES)}]) AS phi FROM features, m) GROUP BY feature""", floats="importance", digits=4)
def shapley_exact(spark, sf):
    values = explain.linear_shapley(b.LINEAR, b.features(spark, sf), KEYS)
    return values.groupBy("feature").agg(F.avg(F.abs("phi")).alias("importance"))


@query("x05_shapley_importance", f""", m AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)} FROM features)
    SELECT l_suppkey, feature, avg(abs(phi)) AS importance FROM (SELECT l_suppkey, unnest({NAMES_SQL}) AS feature,
    unnest([{", ".join(f"{COEF[f]}::DOUBLE * ({f} - m_{f})" for f in FEATURES)}]) AS phi FROM features, m) GROUP BY l_suppkey, feature""", floats="importance", digits=4)
def shapley_linear(spark, sf):
    return explain.shapley_importance(b.LINEAR, b.features(spark, sf), KEYS, by=["l_suppkey"])


@query("x05_shapley_tree_two_groups", """SELECT 'low' AS feature, avg(abs(m - (SELECT avg(l_extendedprice) FROM features))) AS importance
    FROM (SELECT avg(l_extendedprice) OVER (PARTITION BY l_linenumber <= 3) AS m FROM features)""", floats="importance", digits=4)
def shapley_tree(spark, sf):
    rows = b.features(spark, sf).withColumn("low", _low_line())
    return explain.shapley_importance(models.fit_family(rows, ["low"], LABEL, "dt", maxDepth=1), rows, KEYS)


@query("x05_shapley_importance_forest")
def shapley_forest(spark, sf):
    return explain.shapley_importance(_forest(spark, sf), b.features(spark, sf), KEYS)


@query("x06_station_top_features", _donors(17, 5, "l_suppkey") + f""", m AS (SELECT {", ".join(f"avg({f}) AS m_{f}" for f in FEATURES)} FROM features),
    s AS (SELECT b.l_suppkey, d.r, b.id, b.l_extendedprice, b.p, unnest({NAMES_SQL}) AS feature, unnest([{_delta()}]) AS delta FROM bs b
        JOIN dn d ON b.l_suppkey = d.l_suppkey AND b.pos = d.pos),
    b0 AS (SELECT l_suppkey, {R2} AS base FROM bs GROUP BY l_suppkey),
    v AS (SELECT l_suppkey, feature, r, {R2} AS r2 FROM (SELECT l_suppkey, feature, r, l_extendedprice, p - delta AS p FROM s) GROUP BY l_suppkey, feature, r),
    pi AS (SELECT l_suppkey, feature, avg(base - r2) AS pi FROM v JOIN b0 USING (l_suppkey) GROUP BY l_suppkey, feature),
    si AS (SELECT l_suppkey, feature, avg(abs(phi)) AS si FROM (SELECT l_suppkey, unnest({NAMES_SQL}) AS feature,
        unnest([{", ".join(f"{COEF[f]}::DOUBLE * ({f} - m_{f})" for f in FEATURES)}]) AS phi FROM features, m) GROUP BY l_suppkey, feature),
    a AS (SELECT l_suppkey, feature AS pi_variable, pi AS pi_value FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY pi DESC, feature) AS rn FROM pi) WHERE rn = 1),
    z AS (SELECT l_suppkey, feature AS si_variable, si AS si_value FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY si DESC, feature) AS rn FROM si) WHERE rn = 1)
    SELECT * FROM a FULL JOIN z USING (l_suppkey)""", floats="pi_value si_value", digits=4)
def station_top(spark, sf):
    return explain.station_top_features(b.LINEAR, _stored(spark, sf), KEYS, LABEL, "l_suppkey", seed=17)


@query("x06_station_top_features_forest")
def station_top_forest(spark, sf):
    rows = _stored(spark, sf)
    return explain.station_top_features(_forest(spark, sf, rows), rows, KEYS, LABEL, "l_suppkey")


