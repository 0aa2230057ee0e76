import pytest
from pyspark.sql import functions as F

from geoseries.operators import models
from geoseries.plans.training import train_and_score


@pytest.fixture(scope="module")
def stations(spark):
    """A known function of the covariates, with noise from a hash, over 20 stations."""
    day = F.date_add(F.lit("2020-01-01").cast("date"), (F.col("id") % 100).cast("int"))
    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    return (
        spark.range(2000)
        .select(
            F.floor(F.col("id") / 100).alias("station_id"), day.alias("date_time"), F.col("id").alias("row"),
            unit(1).alias("tp"), unit(2).alias("lai"), unit(3).alias("noise"), F.lit(5).alias("LAND_COVER"),
        )
        .withColumn("soil_moisture", F.lit(0.3) + F.col("tp") * 0.5 - F.col("lai") * 0.2 + F.col("noise") * 0.01)
        .drop("noise")
        .cache()
    )


def test_feature_table_is_joint_and_complete(stations):
    table, names = models.build_features(stations.withColumn("status", F.lit("train")), "date_time", "soil_moisture")
    assert [n for n in names if n.startswith("month_")] == [f"month_{m}" for m in range(1, 13)]
    assert "LAND_COVER" not in names and "status" not in names and "status" in table.columns


def test_families_learn_a_known_function(stations):
    for family, params, floor in [("lr", {}, 0.99), ("glr", {}, 0.99), ("dt", {}, 0.9), ("rf", {"numTrees": 10}, 0.85), ("gbt", {"maxIter": 10}, 0.9)]:
        scorer = models.fit_family(stations, ["tp", "lai"], "soil_moisture", family, **params)
        assert models.train_r2(scorer, stations, "soil_moisture").first().r2 > floor


def test_selection_prefers_the_right_family(stations):
    families = {"dt": {"maxDepth": [1]}, "lr": {"regParam": [0.0, 10.0]}}
    scorer, table = models.fit_best(stations, ["tp", "lai"], "soil_moisture", ["row"], families, folds=3)
    best = table.orderBy(F.col("score").desc()).first()
    assert best.family == "lr" and "0.0" in best.params and table.count() == 3
    assert models.train_r2(scorer, stations, "soil_moisture").first().r2 > 0.99
    tuned, scores = models.fit_rf_tuned(stations, ["tp", "lai"], "soil_moisture", ["row"], [5], [2, 5], 5, 2)
    low = scores.orderBy("score").first()
    assert "'maxDepth': 5" in low.params and tuned.model.getNumTrees == 5


def test_weights_follow_the_shift(spark):
    df = spark.range(400).select(
        F.col("id"), F.when(F.col("id") < 300, "train").otherwise("test").alias("status"),
        F.when(F.col("id") < 200, 0.0).otherwise(1.0).alias("x"),
    )
    got = models.adversarial_weights(df, ["x"]).groupBy("x").agg(F.avg("weight").alias("w"), F.count("*").alias("n")).collect()
    weight = {r.x: r.w for r in got}
    assert weight[1.0] > weight[0.0] and sum(r.n for r in got) == 300
    assert models.adversarial_accuracy(df, ["x"]).first().accuracy >= 0.74
    folds = models.adversarial_cv(df, ["x"], ["id"], 3, "lr").collect()
    assert len(folds) == 3 and all(0.5 <= r.accuracy <= 1 for r in folds)


def test_seed_log(spark):
    df = spark.range(300).select(
        "id", (F.col("id") % 10).alias("s"), (F.col("id") % 7).cast("double").alias("x"), F.concat(F.lit("layer"), F.col("id") % 2 + 1).alias("layer")
    )
    log = models.seed_sweep(df, "s", ["x"], ["id"], [1, 2], "layer", k=2)
    assert {(r.layer, r.seed) for r in log.collect()} == {(l, s) for l in ("layer1", "layer2") for s in (1, 2)}


def test_model_round_trip_keeps_feature_order(stations, tmp_path):
    scorer = models.fit_family(stations, ["lai", "tp"], "soil_moisture", "rf", numTrees=3)
    models.save_model(scorer, str(tmp_path / "m"))
    again = models.load_model(str(tmp_path / "m"))
    assert list(again.features) == ["lai", "tp"]
    both = again(scorer(stations), out="again")
    assert both.where(F.col("pred") != F.col("again")).count() == 0


def test_final_fit_uses_all_rows(stations):
    parts = stations.where("row < 1000"), stations.where("row >= 1000")
    scorer = models.fit_final(*parts, ["tp", "lai"], "soil_moisture", "lr", {})
    assert scorer.model.summary.numInstances == 2000


@pytest.mark.parametrize("method", ["spatial", "temporal"])
def test_train_and_score(stations, method):
    got = train_and_score(stations, method, 7, "soil_moisture", ["row"], {"lr": {}}, folds=2)
    assert got.metrics.first().rmse < 0.01
    assert got.scores.count() == 400
    if method == "spatial":
        assert {r.station_idx for r in got.scores.select("station_idx").distinct().collect()} == {16, 17, 18, 19}


def grid_inputs(spark):
    static = [spark.createDataFrame([(0, 0, 1.0), (0, 1, 2.0)], "lat_i int, lon_i int, DEM double")]
    rows = [(i, j, d, v) for (i, j) in ((0, 0), (0, 1)) for d, v in (("2020-01-01", 0.5), ("2020-02-01", None if j else 0.25))]
    dynamic = [spark.createDataFrame(rows, "lat_i int, lon_i int, time string, tp double").withColumn("time", F.to_date("time"))]
    return static, dynamic


def test_grid_predictions(spark):
    a = models.LinearScorer({"DEM": 1.0, "tp": 2.0, "month_2": 10.0})
    c = models.LinearScorer({"DEM": 3.0, "tp": 2.0, "month_2": 10.0})
    value = lambda df: {(r.lon_i, r.time.month): r.sm for r in df.collect()}
    assert value(models.predict_grid(a, *grid_inputs(spark))) == {(0, 1): 2.0, (1, 1): 3.0, (0, 2): 11.5, (1, 2): None}
    assert value(models.predict_ensemble({"a": a, "c": c}, *grid_inputs(spark)))[(0, 1)] == 3.0
    best = models.predict_best({"a": a, "c": c}, {"layer1": "c", "layer2": "a", "layer3": "a"}, *grid_inputs(spark))
    got = {(r.layer, r.lon_i, r.time.month): r.sm for r in best.collect()}
    assert len(got) == 12 and got[("layer1", 1, 1)] == 7.0 and got[("layer3", 1, 1)] == 3.0
    with pytest.raises(ValueError):
        models.predict_ensemble({"a": a, "d": models.LinearScorer({"DEM": 1.0})}, *grid_inputs(spark))
    with pytest.raises(ValueError):
        models.predict_grid(models.LinearScorer({"DEM": 1.0}), *grid_inputs(spark))


def test_missing_covariates_are_a_choice(spark):
    rows = [(i, float(i % 7), None if i % 10 == 0 else float("nan") if i % 10 == 1 else float(i % 3), 2.0 * (i % 7), "test" if i % 4 == 0 else "train") for i in range(200)]
    table = spark.createDataFrame(rows, "id long, a double, b double, y double, status string")
    with pytest.raises(Exception):
        models.fit_family(table, ["a", "b"], "y", "lr")
    fitted = models.fit_family(table, ["a", "b"], "y", "lr", missing="skip")
    assert fitted(table.where("b is not null and not isnan(b)")).where("abs(pred - y) > 1e-3").count() == 0
    weighted = models.adversarial_weights(table, ["a", "b"], "lr", missing="skip")
    assert weighted.count() == sum(1 for r in rows if r[4] == "train" and r[0] % 10 > 1)
    assert models.fit_best(table, ["a", "b"], "y", ["id"], {"lr": {}}, folds=3, missing="skip")[1].first().score > 0.99


def test_logistic_fits_together_equal_single_fits(spark):
    """Every model of one call has the coefficients of a fit of its own rows."""
    from pyspark.ml.classification import LogisticRegression

    from geoseries.operators.logistic import fit_logistic

    unit = lambda salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(1000)) / 1000.0
    rows = spark.range(900).select((F.col("id") % 3).cast("int").alias("model"), unit(1).alias("a"), (unit(2) * 50 + 7).alias("b"), unit(3).alias("u"))
    rows = rows.withColumn("y", (F.col("u") < 1 / (1 + F.exp(-(F.col("model") + 2 * F.col("a") - F.col("b") / 30)))).cast("int")).cache()
    fits = fit_logistic(rows, ["a", "b"], 3)
    for k in range(3):
        part = models.assembled(rows.where(F.col("model") == k).withColumn("y", F.col("y").cast("double")), ["a", "b"], ["y"])
        own = LogisticRegression(labelCol="y", maxIter=500, tol=1e-14).fit(part)
        slopes = fits.coefficients[k, 1:] / fits.scales
        assert list(slopes) == pytest.approx(list(own.coefficients), rel=1e-3)
        assert fits.coefficients[k, 0] - (slopes * fits.means).sum() == pytest.approx(own.intercept, rel=1e-3, abs=1e-3)


def test_logistic_fits_end_where_classes_are_apart(spark):
    rows = spark.range(100).select(F.lit(0).alias("model"), F.col("id").cast("double").alias("x"), (F.col("id") >= 40).cast("int").alias("y"))
    from geoseries.operators.logistic import fit_logistic

    fits = fit_logistic(rows, ["x"], 1)
    margin = rows.select("y", *[x.alias(f"_x{i}") for i, x in enumerate(fits.inputs())]).withColumn("m", fits.margin(F.lit(0), [F.col("_x0"), F.col("_x1")]))
    assert margin.where((F.col("m") > 0).cast("int") != F.col("y")).count() == 0
    with pytest.raises(ValueError, match="missing"):
        fit_logistic(rows.withColumn("x", F.when(F.col("y") == 1, F.col("x"))), ["x"], 1)


def test_halving_keeps_the_right_candidates(stations):
    families = {"lr": {"regParam": [0.0, 1.0, 100.0]}, "dt": {"maxDepth": [1, 2]}}
    scorer, table = models.fit_halving(stations, ["tp", "lai"], "soil_moisture", ["row"], families, folds=3, shrink=2)
    rows = table.collect()
    rounds = [[r for r in rows if r.round == i] for i in range(3)]
    assert [len(x) for x in rounds] == [5, 3, 2] and [sum(r.survives for r in x) for x in rounds] == [3, 2, 1]
    assert [{r.share for r in x} for x in rounds] == [{0.25}, {0.5}, {1.0}]
    winner = next(r for r in rounds[2] if r.survives)
    assert winner.family == "lr" and "0.0" in winner.params
    assert models.train_r2(scorer, stations, "soil_moisture").first().r2 > 0.99


def test_rows_are_not_repeated_for_the_models_of_a_sweep(spark, monkeypatch):
    """All folds of all seeds meet a row in its task: as many rows go into the sums as the table has."""
    from geoseries.operators import logistic

    plans = []
    summed = logistic._summed
    monkeypatch.setattr(logistic, "_summed", lambda rows, *rest: plans.append(rows.count()) or summed(rows, *rest))
    df = spark.range(200).select("id", (F.col("id") % 10).alias("s"), (F.col("id") % 7).cast("double").alias("x"))
    got = {r.seed: r.accuracy for r in models.seed_sweep(df, "s", ["x"], ["id"], [1, 2, 3], k=4).collect()}
    assert set(got) == {1, 2, 3} and all(0.5 < a <= 1 for a in got.values())
    assert set(plans) == {200}


def test_rows_of_one_file_are_spread_over_tasks(spark, tmp_path):
    from geoseries.session import spread

    spark.range(1000).coalesce(1).write.parquet(str(tmp_path / "one"))
    name = "spark.sql.adaptive.coalescePartitions.minPartitionSize"
    spark.conf.set(name, "1b")
    try:
        rows = spread(models.assembled(spark.read.parquet(str(tmp_path / "one")), ["id"], ["id"]), "spread")
    finally:
        spark.conf.unset(name)
    assert rows.rdd.getNumPartitions() > 1 and rows.count() == rows.select("id").distinct().count() == 1000


def test_fits_compute_their_rows_once(spark, stations):
    """What lies below the rows, such as joins, must not run again in each pass of a fit."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    def below(df):
        return df.mapInArrow(counted, df.schema)

    models.fit_family(below(stations), ["tp", "lai"], "soil_moisture", "rf", numTrees=2, maxDepth=2)
    assert seen.value == 2000
    split = stations.withColumn("status", F.when(F.col("row") % 5 == 0, "test").otherwise("train"))
    assert models.adversarial_accuracy(below(split), ["tp", "lai"]).count() == 1
    assert seen.value == 4000
