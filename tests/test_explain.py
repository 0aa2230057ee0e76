"""Explanations of a linear model have closed forms; permutations must be exact even for one hot station."""

import math
import time
from itertools import permutations
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoseries.operators import boxes, explain
from geoseries.operators.models import LinearScorer, fit_family
from geoseries.session import shared_dir

LINEAR = LinearScorer({"a": 2.0, "b": -1.0, "c": 0.0}, 5.0)


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(0)
    data = [
        (i, "hot" if i % 3 == 0 else f"s{i % 5}", float(a), float(b), float(c), float(2 * a - b + e))
        for i, (a, b, c, e) in enumerate(zip(rng.random(600), rng.normal(size=600), rng.integers(0, 3, 600), rng.normal(0, 0.1, 600)))
    ]
    return spark.createDataFrame(data, "id long, s string, a double, b double, c double, y double").cache()


def test_dependence_is_a_line(table):
    got = explain.pdp(LINEAR, table, ["a", "b", "c"], points=20, exclude=["b"]).collect()
    assert {r.feature for r in got} == {"a", "c"}
    line = sorted((r.point, r.grid_value, r.pd) for r in got if r.feature == "a")
    assert len(line) == 20
    slopes = {round((y[2] - x[2]) / (y[1] - x[1]), 6) for x, y in zip(line, line[1:])}
    assert slopes == {2.0}
    assert sorted(r.grid_value for r in got if r.feature == "c") == [0.0, 1.0, 2.0]


def test_dependence_of_an_opaque_model_is_the_same(table):
    class Opaque:
        features = LINEAR.features

        def __call__(self, *args):
            return LINEAR(*args)

    gaps = table.withColumn("b", F.when(F.col("id") % 5 > 0, F.col("b")))
    got, want = ({(r.feature, r.point): r.pd for r in explain.pdp(m, gaps, ["a", "b"], points=7).collect()} for m in (LINEAR, Opaque()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)


def test_curves_start_at_zero(table):
    got = explain.ice(LINEAR, table, ["id"], ["a", "b"], points=5)
    assert got.select("id").distinct().count() == 600 and got.count() == 600 * 2 * 5
    assert got.where("point = 0 and ice <> 0").count() == 0
    last = explain.ice_summary(got).where("feature = 'b'").sort("point").collect()
    assert last[4].n == 600 and last[4].lowest == pytest.approx(-(last[4].grid_value - last[0].grid_value)) == last[4].highest
    some = explain.ice(LINEAR, table, ["id"], ["b"], points=2, fraction=0.25)
    assert 100 < some.select("id").distinct().count() < 200


def test_accumulated_effects_are_centred_lines(table):
    got = explain.ale(LINEAR, table, ["a", "b", "c"], bins=8).collect()
    for feature, slope in LINEAR.coefficients.items():
        line = sorted((r.bin, r.edge, r.ale, r.n) for r in got if r.feature == feature)
        assert sum(r[3] for r in line) == 600
        for x, y in zip(line, line[1:]):
            assert y[2] - x[2] == pytest.approx(slope * (y[1] - x[1]))
        middle = sum(y[3] * (x[2] + y[2]) / 2 for x, y in zip(line, line[1:])) / 600
        assert middle == pytest.approx(0, abs=1e-9)


@pytest.mark.parametrize("by", [[], ["s"]])
def test_permutation_is_exact(table, by):
    got = explain.with_donors(table, ["id"], ["a"], 2, 3, by)
    assert got.count() == 1200
    for repeat in (0, 1):
        part = got.where(F.col("repeat") == repeat).toPandas()
        for _, group in part.groupby("s") if by else [(0, part)]:
            assert sorted(group.a) == sorted(group.donor_a)
        assert (part.a != part.donor_a).mean() > 0.9


def test_permutation_importance_orders_features(table):
    got = {r.feature: r for r in explain.permutation_importance(LINEAR, table, ["id"], "y", 3).collect()}
    assert got["b"].importance > got["a"].importance > 0
    assert got["c"].importance == pytest.approx(0, abs=1e-9) and got["c"].importance_std == pytest.approx(0, abs=1e-9)


def test_sampled_shapley_converges_to_the_closed_form(table):
    class Opaque:
        features = LINEAR.features

        def __call__(self, *args):
            return LINEAR(*args)

    exact = {(r.id, r.feature): r.phi for r in explain.shapley_values(LINEAR, table, ["id"]).collect()}
    got = {(r.id, r.feature): r.phi for r in explain.shapley_values(Opaque(), table, ["id"], 64, 5).collect()}
    assert got.keys() == exact.keys()
    assert np.mean([abs(got[k] - exact[k]) for k in got]) < 0.15 * np.mean([abs(v) for v in exact.values()])


def test_shapley_values_add_up(table):
    """Drawn values to the difference from the drawn row, exact ones to that from the mean prediction."""
    forest = fit_family(table, ["a", "b", "c"], "y", "rf", numTrees=5)

    class Opaque:
        features = forest.features

        def __call__(self, *args):
            return forest(*args)

    total = explain.shapley_values(Opaque(), table, ["id"], 1, 5).groupBy("id").agg(F.sum("phi").alias("total"))
    donors = explain.with_donors(table, ["id"], ["a", "b", "c"], 1, 5)
    both = forest(forest(donors), {f: F.col(f"donor_{f}") for f in "abc"}, "other")
    checked = both.join(total, "id").where(F.abs(F.col("pred") - F.col("other") - F.col("total")) > 1e-9)
    assert total.count() == 600 and checked.count() == 0
    exact = explain.shapley_values(forest, table, ["id"]).groupBy("id").agg(F.sum("phi").alias("total"))
    mean = forest(table).agg(F.avg("pred")).first()[0]
    assert forest(table).join(exact, "id").where(F.abs(F.col("pred") - mean - F.col("total")) > 1e-9).count() == 0
    assert explain.shapley_values(forest, table.where("id < 0"), ["id"]).count() == 0


def plain_shapley(predict, rows, features):
    """Mean over all other rows and all feature orders of the change that each feature makes."""
    out = np.zeros((len(rows), len(features)))
    for i, x in enumerate(rows):
        for z in rows:
            for order in permutations(range(len(features))):
                mixed = list(z)
                for j in order:
                    before = predict(mixed)
                    mixed[j] = x[j]
                    out[i, j] += predict(mixed) - before
    return out / (len(rows) * math.factorial(len(features)))


@pytest.mark.parametrize("family,params", [("dt", {"maxDepth": 4}), ("rf", {"numTrees": 3, "maxDepth": 3}), ("gbt", {"maxIter": 3, "maxDepth": 2})])
def test_tree_values_equal_all_orders(table, family, params):
    few = table.where("id < 14").withColumns({"b": F.round("b"), "a": F.when(F.col("id") == 3, F.lit(0.5)).otherwise(F.round("a", 1))})
    model = fit_family(table, ["a", "b", "c"], "y", family, **params)
    local = sorted((r.id, r.a, r.b, r.c) for r in few.collect())
    trees = [(v, box) for v, box in boxes.leaf_boxes(model)]

    def predict(x):
        of = dict(zip("abc", x))
        return sum(v for v, box in trees if all(low < of[f] <= high for f, (low, high) in box.items()))

    want = plain_shapley(predict, [r[1:] for r in local], "abc")
    got = {(r.id, r.feature): r.phi for r in explain.shapley_values(model, few, ["id"]).collect()}
    assert len(got) == 14 * 3 and np.abs(want).max() > 0.1
    assert all(got[r[0], f] == pytest.approx(want[i, j], abs=1e-9) for i, r in enumerate(local) for j, f in enumerate("abc"))
    for r in model(few).collect():
        assert predict((r.a, r.b, r.c)) == pytest.approx(r.pred)


def test_a_covariate_constant_within_stations_can_win(spark):
    data = [(i, i % 4, 10.0 * (i % 4), float(i % 7), 20.0 * (i % 4) + i % 7) for i in range(200)]
    table = spark.createDataFrame(data, "id long, s int, height double, rain double, y double")
    model = LinearScorer({"height": 2.0, "rain": 1.0}, 0.0)
    got = explain.station_top_features(model, table, ["id"], "y", "s", repeats=1).collect()
    assert {r.s: r.si_variable for r in got} == {0: "height", 1: "height", 2: "height", 3: "height"}
    assert {round(r.si_value, 6) for r in got} == {30.0, 10.0}


def test_exact_linear_shapley(table):
    got = explain.linear_shapley(LINEAR, table, ["id"]).groupBy("feature").agg(F.sum("phi").alias("s"), F.max("phi").alias("m")).collect()
    assert all(r.s == pytest.approx(0, abs=1e-6) for r in got) and {r.feature: r.m > 0 for r in got} == {"a": True, "b": True, "c": False}


def test_station_drivers(table):
    got = explain.station_top_features(LINEAR, table, ["id"], "y", "s", repeats=2)
    stations = {r.s for r in table.select("s").distinct().collect()}
    assert {r.s: (r.pi_variable, r.si_variable) for r in got.collect()} == {s: ("b", "b") for s in stations}


@pytest.mark.parametrize("family,params", [("rf", {"numTrees": 3, "maxDepth": 4}), ("gbt", {"maxIter": 2, "maxDepth": 3})])
def test_dependence_and_curves_of_trees_need_no_copies_of_the_rows(table, family, params):
    """The same as scoring a copy of every row for every grid value, which an opaque model still does."""
    forest = fit_family(table, ["a", "b", "c"], "y", family, **params)
    scored = []

    class Opaque:
        features = forest.features

        def __call__(self, *args):
            return forest(*args)

    class Watched(type(forest)):
        def __call__(self, *args):
            scored.append(args)
            return super().__call__(*args)

    few, watched = table.where("id < 40"), Watched(forest.model, forest.features)
    got, want = ({(r.feature, r.point, r.grid_value): r.pd for r in explain.pdp(m, few, ["a", "c"], points=6).collect()} for m in (watched, Opaque()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in got)
    got, want = ({(r.id, r.feature, r.point, r.grid_value): r.ice for r in explain.ice(m, few, ["id"], ["a", "c"], points=6).collect()} for m in (watched, Opaque()))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in got)
    assert not scored
    with pytest.raises(Exception, match="missing"):
        explain.pdp(forest, few.withColumn("b", F.when(F.col("id") > 3, F.col("b"))), ["a"], points=6)


class Hidden:
    """A scorer that shows neither coefficients nor leaves."""

    def __init__(self, scorer):
        self.scorer, self.features = scorer, scorer.features

    def __call__(self, *args):
        return self.scorer(*args)


def test_curves_of_a_line_need_no_scored_copies(table):
    class Uncalled(LinearScorer):
        def __call__(self, *args):
            raise AssertionError("a copy was scored")

    gaps = table.withColumn("b", F.when(F.col("id") % 7 > 0, F.col("b")))
    want, got = (
        explain.ice_summary(explain.ice(s, gaps, ["id"], ["a", "b", "c"], 20)).sort("feature", "point").collect()
        for s in (Hidden(LINEAR), Uncalled(LINEAR.coefficients, LINEAR.intercept))
    )
    assert len(got) == 43
    for x, y in zip(want, got, strict=True):
        assert tuple(x[:3]) == tuple(y[:3]) and x["n"] == y["n"]
        assert tuple(x[4:]) == pytest.approx(tuple(y[4:]), abs=1e-9)


def test_effects_and_permutations_of_trees_come_from_leaves(table):
    forest = fit_family(table, ["a", "b", "c"], "y", "rf", numTrees=4, maxDepth=4)
    calls = []

    class Counted(type(forest)):
        def __call__(self, *args):
            calls.append(args)
            return super().__call__(*args)

    counted = Counted(forest.model, forest.features)
    want, got = (explain.ale(s, table, ["a", "b", "c"], 5).sort("feature", "bin").collect() for s in (Hidden(forest), counted))
    assert len(got) == 6 + 6 + 3 and not calls
    for x, y in zip(want, got, strict=True):
        assert tuple(x[:3]) == tuple(y[:3]) and x["n"] == y["n"] and x["ale"] == pytest.approx(y["ale"], abs=1e-9)
    for by in ([], ["s"]):
        calls.clear()
        want, got = (
            explain.permutation_scores(s, table, ["id"], "y", 2, 3, by).sort(*by, "feature", "repeat").collect() for s in (Hidden(forest), counted)
        )
        assert len(calls) == 1 and len(got) == 6 * (len(by) * 5 + 1)  # the unchanged rows are scored once
        for x, y in zip(want, got, strict=True):
            assert x[:-1] == y[:-1] and x["value"] == pytest.approx(y["value"], abs=1e-9)


def test_missing_covariates_end_the_job(table):
    forest = fit_family(table, ["a", "b"], "y", "dt", maxDepth=2)
    gaps = table.withColumn("b", F.when(F.col("id") > 3, F.col("b")))
    for job in (lambda: explain.ale(forest, gaps, ["a", "b"], 5), lambda: explain.permutation_importance(forest, gaps, ["id"], "y", 2)):
        with pytest.raises(Exception):
            job().collect()


def test_keys_are_left_behind(table):
    placed = explain.with_donors(table, ["id"], ["a"], 2, 3, ["s"], keep=["y"])
    assert set(placed.columns) == {"s", "y", "a", "donor_a", "repeat"} and placed.count() == 1200


def test_repeats_move_one_after_the_other(spark, table, monkeypatch):
    """What a repeat moved is gone before the next one, and the tables of a job are gone at its end."""
    files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def kept():
        found = files.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    def stored():
        return {p.name for p in folder.iterdir()} if folder.exists() else set()

    folder = Path(shared_dir(spark).removeprefix("file:")) / "geoseries"
    plain, moved, before, old = explain.written, [], kept(), stored()

    def watched(df, name):
        out = plain(df, name)
        for _ in range(50):  # files go in the background
            left = kept() - before
            if not left:
                break
            time.sleep(0.1)
        moved.append((name, len(left)))
        return out

    monkeypatch.setattr(explain, "written", watched)
    got = explain.permutation_scores(LINEAR, table, ["id"], "y", 3, 3).collect()
    assert len(got) == 9 and [name for name, _ in moved] == ["placed", "repeat", "repeat", "repeat"]
    assert len({n for name, n in moved if name == "repeat"}) == 1  # a repeat leaves nothing
    assert sorted(name.split("-")[0] for name in stored() - old) == ["placed", "repeat", "repeat", "repeat"]  # the buckets are gone
    assert not spark.catalog.listTables()


def test_keys_that_repeat_still_give_whole_permutations(spark):
    """Rows of one key have one hash: chunks by its bits would hold them all."""
    rows = spark.range(3000).select(F.lit(7).alias("id"), F.col("id").cast("double").alias("a"), (F.col("id") * 2.0).alias("y"))
    got = explain.with_donors(rows, ["id"], ["a"], 2, 3).groupBy("repeat").agg(F.countDistinct("a"), F.countDistinct("donor_a"), F.count(F.lit(1))).collect()
    assert sorted(tuple(r) for r in got) == [(0, 3000, 3000, 3000), (1, 3000, 3000, 3000)]


@pytest.mark.parametrize("family,params", [("rf", {"numTrees": 5, "maxDepth": 5}), ("dt", {"maxDepth": 9, "minInstancesPerNode": 1}), ("gbt", {"maxIter": 3, "maxDepth": 6}), ("dt", {"maxDepth": 0})])
def test_words_and_bits_of_leaves_say_the_same(table, monkeypatch, family, params):
    """Trees of up to 64 leaves are met by words; those with more, or without a split, by bits."""
    forest = fit_family(table, ["a", "b", "c"], "y", family, **params)
    sizes = [(t.numNodes + 1) // 2 for t in getattr(forest.model, "trees", [forest.model])]
    found = boxes.Reached.of(forest, boxes.Leaves(forest))
    assert (found is not None) == (1 < max(sizes) <= 64) and (found is None or len(found.table) == 64 * sum(n > 1 for n in sizes))
    got = explain.permutation_scores(forest, table, ["id"], "y", 2, 3).sort("feature", "repeat").collect()
    lines = {(r.id, r.feature, r.point): r.ice for r in explain.ice(forest, table.where("id < 30"), ["id"], ["a", "c"], 9).collect()}
    want = explain.permutation_scores(Hidden(forest), table, ["id"], "y", 2, 3).sort("feature", "repeat").collect()
    assert [r["value"] for r in got] == pytest.approx([r["value"] for r in want], abs=1e-9)
    plain = {(r.id, r.feature, r.point): r.ice for r in explain.ice(Hidden(forest), table.where("id < 30"), ["id"], ["a", "c"], 9).collect()}
    assert lines.keys() == plain.keys() and all(lines[k] == pytest.approx(plain[k], abs=1e-9) for k in plain)
