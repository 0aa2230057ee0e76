"""Chunked ranks and exact percentiles against brute force, with one key holding a third of the rows."""

import hashlib
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoseries.operators import quantiles
from geoseries.operators.permutation import permuted, repeat_key
from geoseries.operators.quantiles import exact_percentiles
from geoseries.operators.ranking import chunked_rank, hash_rank, with_balanced_chunks
from geoseries.operators.splits import hash_threshold, spatial_split, spatial_split3, spatial_split_by_source, station_index, stratified_folds


@pytest.fixture(scope="module")
def skewed(spark):
    random.seed(3)
    data = []
    for i in range(3000):
        key = "hot" if i % 3 == 0 else f"k{random.randint(0, 40)}"
        data.append((i, key, random.choice([1.0, 2.0, 2.5]) if i % 5 == 0 else random.gauss(0, 1) ** 3))
    return pd.DataFrame(data, columns=["id", "k", "x"]), spark.createDataFrame(data, "id long, k string, x double").cache()


def test_chunked_rank_equals_row_number(skewed):
    local, df = skewed
    got = chunked_rank(df, ["k"], ["x", "id"], F.floor(F.col("x") * 2), "rn", "n").toPandas()
    want = local.sort_values(["k", "x", "id"]).assign(rn=lambda d: d.groupby("k").cumcount() + 1, n=lambda d: d.groupby("k")["id"].transform("size"))
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == 3000 and (merged.rn == merged.rn_w).all() and (merged.n == merged.n_w).all()


def test_rank_windows_are_cut_by_chunk(skewed):
    plan = chunked_rank(skewed[1], ["k"], ["x"], F.floor("x"), "rn")._jdf.queryExecution().optimizedPlan().toString()
    ranks = [line for line in plan.splitlines() if "row_number()" in line and "windowspecdefinition" in line]
    assert ranks and all("_chunk" in line for line in ranks)


def test_hash_rank_order(skewed):
    local, df = skewed
    got = {r.id: r.rn for r in hash_rank(df.select("id"), [], 9, ["id"]).collect()}
    order = sorted(local.id, key=lambda i: hashlib.md5(f"9:{i}".encode()).hexdigest())
    assert [got[i] for i in order] == list(range(1, 3001))


@pytest.mark.parametrize("alpha,accuracy", [(1.0, 1000), (0.4, 1000), (1.0, 20), (0.4, 7)])
def test_percentiles_match_numpy(skewed, alpha, accuracy):
    """Groups sorted whole, and groups of which only what lies in brackets is sorted."""
    local, df = skewed
    probs = [0.0, 0.05, 0.25, 0.5, 0.9, 1.0]
    method = {1.0: "linear", 0.4: None}[alpha]
    got = {r.k: r.percentiles for r in exact_percentiles(df, ["k"], "x", probs, alpha=alpha, accuracy=accuracy).collect()}
    for key, part in local.groupby("k"):
        x = np.sort(part.x.to_numpy())
        if method:
            want = np.percentile(x, [100 * p for p in probs])
        else:
            place = [min(max(len(x) * p + 0.4 + 0.2 * p - 1, 0), len(x) - 1) for p in probs]
            want = [x[math.floor(q)] + (x[math.ceil(q)] - x[math.floor(q)]) * (q - math.floor(q)) for q in place]
        assert got[key] == pytest.approx(list(want))
    whole = exact_percentiles(df, [], "x", [0.5], accuracy=accuracy).first()[0]
    assert whole == pytest.approx([np.median(local.x)])


def test_only_bracketed_values_are_shuffled(spark):
    df = spark.range(200_000).select(F.hash("id").cast("double").alias("_v"), F.lit("a").alias("k"))
    placed = quantiles._bracketed(df, ["k"], [0.25, 0.5], 0.003, 1000)
    assert placed.count() < 0.02 * 200_000 and placed.agg(F.sum("_c")).first()[0] == 200_000
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("Exchange hashpartitioning") == 2


def test_missed_brackets_are_widened(skewed, monkeypatch):
    """A sketch that is far off costs another pass, not the answer."""
    local, df = skewed
    tried, real = [], quantiles._bracketed

    def off(values, by, probs, spread, accuracy):
        tried.append(spread)
        return real(values, by, [min(p + 0.2, 1.0) for p in probs], spread, accuracy)

    monkeypatch.setattr(quantiles, "_bracketed", off)
    got = exact_percentiles(df, [], "x", [0.25, 0.5], accuracy=50).first()[0]
    assert got == pytest.approx(list(np.percentile(local.x, [25, 50]))) and len(tried) > 1


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 17, 100, 120, 121, 2503])
def test_positions_are_mapped_one_to_one(spark, n):
    df = spark.range(n).withColumn("n", F.lit(n)).withColumn("r", F.explode(F.array(*map(F.lit, range(4)))))
    got = permuted(df, "id", "n", repeat_key(5, F.col("r")), "to").toPandas()
    for _, part in got.groupby("r"):
        assert sorted(part.to) == list(range(n))
    if n > 100:
        same = [(a.to.to_numpy() == b.to.to_numpy()).mean() for _, a in got.groupby("r") for _, b in got.groupby("r") if a is not b]
        assert max(same[1:4]) < 0.2 and (got.id == got.to).mean() < 0.05
        ends = got[got.id < n / 10].to  # neighbours are sent everywhere
        assert 0.35 * n < ends.mean() < 0.65 * n


def test_one_busy_day_is_cut_by_ties(spark):
    """A station with all rows on one day: chunks of bounded size, ranks as of one sort, more than one task."""
    df = spark.range(4000).select(F.lit("hot").alias("s"), F.lit("2024-01-01").cast("date").alias("day"), F.xxhash64("id").alias("tie"))
    chunks = with_balanced_chunks(df, ["s"], ["day", "tie"], 160).groupBy("_chunk").count().collect()
    assert len(chunks) > 12 and max(r["count"] for r in chunks) < 5 * 160 and sum(r["count"] for r in chunks) == 4000
    got = chunked_rank(df, ["s"], ["day", "tie"], None, "rn", "n", rows=160)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    assert got.select(F.spark_partition_id()).distinct().count() > 1
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    pairs = sorted((r.tie, r.rn) for r in got.collect())
    assert [rn for _, rn in pairs] == list(range(1, 4001)) and {r.n for r in got.select("n").distinct().collect()} == {4000}


def test_small_groups_are_one_chunk(skewed):
    assert with_balanced_chunks(skewed[1], ["k"], ["x", "id"]).select("_chunk").distinct().collect() == [(0,)]
    whole = with_balanced_chunks(skewed[1], [], ["x", "id"], 200).groupBy("_chunk").agg(F.min("x").alias("a"), F.max("x").alias("z")).sort("_chunk").collect()
    assert len(whole) > 5 and all(p.z <= q.a for p, q in zip(whole, whole[1:]))


@pytest.mark.parametrize("rows", [7, 100, 100_000])
def test_balanced_ranks_equal_row_number(skewed, rows):
    local, df = skewed
    got = chunked_rank(df, ["k"], ["x", "id"], None, "rn", "n", rows).toPandas()
    want = local.sort_values(["k", "x", "id"]).assign(rn=lambda d: d.groupby("k").cumcount() + 1)
    assert (got.merge(want, on="id", suffixes=("", "_w")).eval("rn == rn_w")).all() and len(got) == 3000


def test_percentiles_skip_nulls_and_single_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", None), ("b", 7.0), ("b", 7.0), ("c", None)], "k string, x double")
    got = {r.k: list(r.percentiles) for r in exact_percentiles(df, ["k"], "x", [0.25, 0.5]).collect()}
    assert got == {"a": [1.0, 1.0], "b": [7.0, 7.0]}


def test_spatial_split_takes_the_first_fifth(spark):
    df = spark.range(103).select((F.col("id") % 31).alias("s"))
    got = {r.s: r.status for r in spatial_split(df, "s", 42).distinct().collect()}
    order = sorted(range(31), key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())
    assert {s for s, st in got.items() if st == "test"} == set(order[: math.ceil(31 * 0.2)])
    assert spatial_split(df, "s", 42).count() == 103
    three = {r.s: r.status for r in spatial_split3(df, "s", 42).distinct().collect()}
    counts = pd.Series(three).value_counts()
    assert counts["test"] == 7 and counts["val"] == math.ceil(24 / 8) and counts["train"] == 21


def test_split_by_source_rules(spark):
    df = spark.range(40).select(F.col("id").alias("s"), F.when(F.col("id") < 10, "t").otherwise("c").alias("src"))
    seeds = {"t": 1, "c": 2}
    def counts(layer):
        out = spatial_split_by_source(df, "s", "src", seeds, layer)
        return {(r.src, r.status): r["count"] for r in out.groupBy("src", "status").count().collect()}
    assert counts("layer2") == {("t", "test"): 2, ("t", "train"): 8, ("c", "test"): 6, ("c", "train"): 24}
    assert counts("layer1") == {("t", "test"): 2, ("t", "train"): 8}
    pooled = counts("layer4")
    assert sum(n for (_, st), n in pooled.items() if st == "test") == 8 and sum(pooled.values()) == 40


def test_threshold_share(spark):
    df = spark.range(15).withColumnRenamed("id", "s")
    assert df.withColumn("h", hash_threshold(df, "s", 1, 0.2)).select("h").distinct().count() == 1


def test_station_numbers_start_with_training(spark):
    df = spark.createDataFrame([(7, "test"), (3, "train"), (9000, "train"), (3, "test")], "s long, status string")
    got = {(r.s, r.status): r.station_idx for r in station_index(df, "s").collect()}
    assert got == {(3, "train"): 0, (9000, "train"): 1, (3, "test"): 2, (7, "test"): 3}


def test_folds_are_balanced_within_labels(spark):
    df = spark.range(101).withColumn("label", (F.col("id") < 20).cast("int"))
    sizes = stratified_folds(df, "label", ["id"], 5, 1).groupBy("label", "fold").count().collect()
    assert {(r.label, r["count"]) for r in sizes} == {(1, 4), (0, 16), (0, 17)}


@pytest.mark.parametrize("kind", ["cuts", "sketches"])
def test_no_group_is_brought_into_one_task(spark, kind):
    """Cuts and sketches go to the rows, whatever the planner guesses about their size."""
    df = spark.range(2000).select((F.col("id") % 2).alias("g"), F.col("id").alias("_v"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        placed = with_balanced_chunks(df, ["g"], ["_v"], 100) if kind == "cuts" else quantiles._bracketed(df, ["g"], [0.5], 0.01, 100)
        plan = placed._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
