import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from geoseries.operators import compare, metrics, splits
from geoseries.plans import evaluation

PAIR = "station_idx int, true double, pred double"


def by_numpy(true, pred):
    true, pred = np.array(true), np.array(pred)
    spread = true.std() * pred.std()
    return {
        "rmse": np.sqrt(np.mean((true - pred) ** 2)),
        "ubrmse": np.sqrt(np.mean(((true - true.mean()) - (pred - pred.mean())) ** 2)),
        "r": np.mean((true - true.mean()) * (pred - pred.mean())) / spread if spread else None,
        "r2": 1 - np.sum((true - pred) ** 2) / np.sum((true - true.mean()) ** 2) if true.std() else None,
    }


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.tuples(st.integers(0, 3), st.integers(0, 20), st.integers(0, 20)), min_size=1, max_size=40))
def test_station_metrics_match_numpy(spark, data):
    df = spark.createDataFrame([(s, t / 10, p / 10) for s, t, p in data], PAIR)
    got = {r.station_idx: r for r in metrics.station_metrics(df).collect()}
    local = pd.DataFrame(data, columns=["s", "t", "p"])
    for s, part in local.groupby("s"):
        want = by_numpy(part.t / 10, part.p / 10)
        assert got[s]["count"] == len(part)
        for m, value in want.items():
            assert got[s][m] == (None if value is None else pytest.approx(value, abs=1e-6))
        bias = float((part.t / 10).mean() - (part.p / 10).mean())
        assert got[s].ubrmse ** 2 == pytest.approx(got[s].rmse ** 2 - bias**2, abs=1e-9)


def test_constant_and_single_rows_are_undefined_not_errors(spark):
    df = spark.createDataFrame([(1, 1.0, 0.5), (1, 1.0, 0.7), (2, 0.3, 0.4), (3, None, 0.4), (4, 0.1, 0.2), (4, 0.3, 0.2)], PAIR)
    got = {r.station_idx: r for r in metrics.station_metrics(df).collect()}
    assert set(got) == {1, 2, 4}
    assert got[1].r is None and got[1].r2 is None and got[2].r is None and got[4].r is None and got[4].r2 is not None
    macro = metrics.macro_metrics(metrics.station_metrics(df)).first()
    assert macro.r is None and macro.rmse is not None


def test_levels_equal_separate_aggregates(spark):
    rng = np.random.default_rng(2)
    data = [(int(s), float(t), float(t + e)) for s, t, e in zip(rng.integers(0, 5, 200), rng.random(200), rng.normal(0, 0.1, 200))]
    df = spark.createDataFrame(data, PAIR).withColumn("exp", F.lit("x"))
    row = metrics.metric_levels(df, ["exp"]).first()
    stations, pooled = metrics.station_metrics(df), metrics.pooled_metrics(df).first()
    macro = metrics.macro_metrics(stations, cols=["rmse", "r", "ubrmse", "r2"]).first()
    for m in ("rmse", "r", "ubrmse", "r2"):
        assert row[m] == pytest.approx(macro[m]) and row[f"{m}_total"] == pytest.approx(pooled[f"{m}_total"])


def test_masked_error_and_accuracy(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1), (1.0, 9.0, 0)], "true double, pred double, Is_valid int")
    assert metrics.masked_mse(df).first()[0] == 1.0
    assert metrics.masked_mse(df.where("Is_valid = 0")).first()[0] is None
    acc = spark.createDataFrame([(0, 1, 1), (0, 1, 0), (1, 0, 0)], "fold int, l int, p int")
    assert metrics.accuracy(acc, "l", "p").first()[0] == pytest.approx(2 / 3)
    assert metrics.accuracy(acc, "l", "p", "fold").first()[0] == pytest.approx(0.75)


def test_best_estimator_ties_and_nulls(spark):
    df = spark.createDataFrame([(1, 0.5, 0.5, 0.4), (2, None, 0.1, 0.9), (3, None, None, None)], "station_idx int, a_r double, b_r double, c_r double")
    got = {r.station_idx: r.best for r in metrics.best_estimator(df, ["a", "b", "c"], "r").collect()}
    assert got == {1: "a", 2: "c", 3: None}
    low = df.toDF("station_idx", "a_rmse", "b_rmse", "c_rmse")
    got = {r.station_idx: r.best for r in metrics.best_estimator(low, ["a", "b", "c"], "rmse").collect()}
    assert got == {1: "c", 2: "b", 3: None}


def test_merge_keeps_common_stations(spark):
    a = spark.createDataFrame([(1, 0.1, 0.9, 0.1), (2, 0.2, None, 0.2)], "station_idx int, rmse double, r double, ubrmse double")
    b = spark.createDataFrame([(2, 0.3, 0.5, 0.3), (3, 0.2, 0.8, 0.2)], "station_idx int, rmse double, r double, ubrmse double")
    got = metrics.merge_metrics({"a": a, "b": b}).collect()
    assert len(got) == 1 and got[0].station_idx == 2 and got[0].a_r is None and got[0].b_rmse == 0.3


def test_winner_table_and_top(spark):
    best = spark.createDataFrame([("l1", "a"), ("l1", "b"), ("l1", "b"), ("l1", None), ("l2", "a")], "layer string, best string")
    got = {(r.layer, r.kind): (r.a, r.b) for r in metrics.winner_table(best, ["layer"], ["a", "b"]).collect()}
    assert got[("l1", "count")] == (1.0, 2.0) and got[("l1", "share")] == (pytest.approx(1 / 3), pytest.approx(2 / 3)) and got[("l2", "share")] == (1.0, 0.0)
    tie = best.unionByName(spark.createDataFrame([("l2", "b")], "layer string, best string"))
    assert {r.layer: r.best for r in metrics.best_per_layer(tie).collect()} == {"l1": "b", "l2": "a"}


def test_corr_matrix_is_pairwise_complete(spark):
    local = pd.DataFrame({"a": [1.0, 2.0, 3.0, 4.0], "b": [2.0, None, 1.0, 7.0], "c": [1.0, 1.0, 1.0, 1.0]})
    df = spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in local.itertuples(index=False)], "a double, b double, c double")
    got = {(r.a, r.b): r.r for r in metrics.corr_matrix(df, ["a", "b", "c"]).collect()}
    assert set(got) == {("b", "a"), ("c", "a"), ("c", "b")}
    assert got[("b", "a")] == pytest.approx(local.corr().loc["a", "b"]) and got[("c", "a")] is None


def test_box_stats(spark):
    df = spark.createDataFrame([("g", float(x)) for x in [1, 2, 3, 4, 100]] + [("h", None)], "k string, x double")
    r = metrics.box_stats(df, ["k"], "x").collect()
    assert len(r) == 1 and (r[0].q1, r[0].median, r[0].q3) == (2.0, 3.0, 4.0)
    assert (r[0].whisker_low, r[0].whisker_high, r[0].n, r[0].n_outliers) == (1.0, 4.0, 5, 1)
    wide = metrics.box_stats(df.where("k = 'g'"), [], "x", whis=100).first()
    assert wide.whisker_high == 100.0


def test_standardize_deviations(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "x double, c double")
    assert sorted(r.x for r in metrics.standardize(df, ["x", "c"]).collect()) == [-1.0, 1.0]
    assert all(r.c is None for r in metrics.standardize(df, ["c"]).collect())
    assert max(r.x for r in metrics.standardize(df, ["x"], ddof=1).collect()) == pytest.approx(2**-0.5)


def test_ensemble_mean_skips_nulls(spark):
    df = spark.createDataFrame([(1.0, None), (None, None), (1.0, 2.0)], "a double, b double")
    assert [r.pred for r in metrics.ensemble_mean(df, ["a", "b"]).collect()] == [1.0, None, 1.5]


def test_seed_and_features(spark):
    log = spark.createDataFrame([(0.6, "l", 9), (0.4, "l", 3), (0.7, "l", 1)], "accuracy double, layer string, seed int")
    assert metrics.select_seed(log).first().seed in (3, 9)
    exact = spark.createDataFrame([(0.75, "l", 9), (0.25, "l", 3)], "accuracy double, layer string, seed int")
    assert metrics.select_seed(exact).first().seed == 3
    imp = spark.createDataFrame([("s", "lon", 9.0), ("s", "month_3", 8.0), ("s", "tp", 2.0), ("s", "lai", 2.0)], "station string, feature string, importance double")
    top = metrics.top_feature(imp, ["station"]).first()
    assert (top.variable, top.value) == ("lai", 2.0)


def test_temporal_cuts(spark):
    df = spark.createDataFrame([("a", f"2020-01-{i:02d}") for i in range(1, 31)] + [("b", "2020-01-01")], "s string, d string").withColumn("d", F.to_date("d"))
    got = {(r.s, r.status): r["count"] for r in splits.temporal_split(df, "s", "d").groupBy("s", "status").count().collect()}
    assert got == {("a", "train"): 24, ("a", "test"): 6, ("b", "test"): 1}
    three = {(r.s, r.status): r["count"] for r in splits.temporal_split3(df, "s", "d").groupBy("s", "status").count().collect()}
    n1, n2 = int(30 * (1 - (0.2 + 0.1))), int(30 * 0.1)
    assert three == {("a", "train"): n1, ("a", "val"): n2, ("a", "test"): 30 - n1 - n2, ("b", "test"): 1}


def test_match_moments(spark):
    df = spark.createDataFrame([("a", 1.0, 10.0), ("a", 2.0, 14.0), ("a", 6.0, 15.0), ("b", 1.0, 3.0)], "s string, y double, m double")
    got = splits.match_moments(df, ["s"], "y", "m")
    stats = got.where("s = 'a'").agg(F.avg("y"), F.stddev_samp("y"), F.avg("m"), F.stddev_samp("m")).first()
    assert stats[0] == pytest.approx(stats[2]) and stats[1] == pytest.approx(stats[3])
    assert got.where("s = 'b'").first().y is None and got.where("s = 'b'").first().y_origin == 1.0


def test_one_station_per_group(spark):
    df = spark.createDataFrame([("t", 1, 5, 0), ("t", 1, 6, 2), ("t", 2, 7, 0), ("c", 1, 8, 0), ("c", 1, 9, 3)], "source string, g int, s int, n int")
    got = {(r.source, r.g, r.s) for r in splits.dedup_groups(df, "g", "s", "source", "n", ["t"]).collect()}
    assert got == {("t", 1, 6), ("c", 1, 8)}


def test_baseline_and_collections(spark):
    df = spark.createDataFrame(
        [(1, "2020-01-01", "layer1", 0.1, 0.2, 0.15), (1, "2020-01-02", "layer2", 0.3, None, 0.4)],
        "station int, d string, layer string, swvl1 double, swvl2 double, sm double",
    )
    pred = compare.pick_layer_var(F.col("layer"), {"layer1": "swvl1", "layer2": "swvl2"})
    assert [r.pred for r in compare.product_baseline(df, pred, "station", "d", "sm").collect()] == [0.1]
    scores = spark.createDataFrame(
        [(e, "spatial", l, s, float(i), float(i) + (0.5 if e == "SMCI" else 0.0)) for e in ("ERA5", "SMCI") for l in ("layer1", "layer2") for s in (1, 2) for i in range(3)],
        "exp string, split_method string, layer string, station_idx int, true double, pred double",
    )
    got = {(r.exp, r.layer): r.rmse_total for r in evaluation.metric_collection(scores, {"SMCI": ["layer1"]}).collect()}
    assert got == {("ERA5", "layer1"): 0.0, ("ERA5", "layer2"): 0.0, ("SMCI", "layer2"): 0.5}
    names = {r.exp for r in evaluation.insitu_collection(scores, {"ERA5": "ERA5-Land"}).collect()}
    assert names == {"ERA5-Land", None}


def test_one_row_tables_side_by_side(spark):
    a = spark.range(1).select(F.lit(1).alias("a"))
    b = spark.range(1).select(F.lit(2).alias("b"))
    row = metrics.with_labels(metrics.beside(a, b), {"exp": "x"}).first()
    assert (row.a, row.b, row.exp) == (1, 2, "x")


def test_wide_station_metrics_match_the_long_ones(spark, rows):
    data = [("l", i % 4, i / 7, i * i / 50, None if i % 3 == 0 else i / 9, None if i % 4 == 1 else 1.0) for i in range(40)] + [("l", 9, 1.0, None, 2.0, 3.0), (None, 9, 1.0, 1.0, 2.0, 3.0)]
    df = spark.createDataFrame(data, "layer string, station_idx int, true double, a double, b double, c double")
    keys, names = ["layer", "station_idx"], ["a", "b", "c"]
    long = df.unpivot([*keys, "true"], names, "exp", "pred")
    want = metrics.pivot_metrics(metrics.station_metrics(long, [*keys, "exp"]), names, keys)
    got = metrics.wide_station_metrics(df, names, keys)
    assert got.count() == 4  # station 1 has no c, station 9 of the layer no a
    for x, y in zip(rows(want), rows(got, *want.columns), strict=True):
        assert x == pytest.approx(y, abs=1e-12)
