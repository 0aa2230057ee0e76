"""Month states: merges equal means of raw rows, and a new month touches its own partition only."""

import os

import pytest
from pyspark.sql import functions as F

from geoseries.operators import states


@pytest.fixture(scope="module")
def days(spark):
    day = F.date_add(F.lit("2020-11-01").cast("date"), (F.col("id") % 120).cast("int"))
    return spark.range(3000).select(
        (F.col("id") % 5).alias("lat_i"), F.when(F.col("id") % 2 == 0, "layer1").otherwise("layer2").alias("layer"), day.alias("time"),
        F.when(F.col("id") % 7 > 0, F.pmod(F.xxhash64("id"), F.lit(1000)) / 10.0).alias("sm"),
    ).cache()


def table(df, *keys):
    return {tuple(r[k] for k in keys): r.sm for r in df.collect()}


@pytest.mark.parametrize("keys", [["lat_i", "year"], ["lat_i", "month"], ["layer"]])
def test_merged_means_equal_means_of_rows(days, keys):
    found = states.merged_means(states.month_states(days, "time", ["sm"], ["lat_i", "layer"]), keys, ["sm"])
    parts = {"year": F.year("time").alias("year"), "month": F.month("time").alias("month")}
    want = days.groupBy(*[parts.get(k, k) for k in keys]).agg(F.avg("sm").alias("sm"))
    got, want = table(found, *keys), table(want, *keys)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_a_new_month_changes_its_partition_only(spark, days, tmp_path):
    path = str(tmp_path / "states")
    made = states.month_states(days, "time", ["sm"], ["lat_i"])
    late = F.col("month") == 2
    states.write_states(made.where(~late), path)

    def files():
        return {f: os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}

    before = files()
    for _ in range(2):  # a job that is run again adds nothing twice
        states.write_states(made.where(late), path)
    after = files()
    assert before.items() <= after.items() and len(after) > len(before)
    got, want = (table(states.merged_means(s, ["lat_i", "year"], ["sm"]), "lat_i", "year") for s in (states.read_states(spark, path), made))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert states.read_states(spark, path, (2021, 2021)).select("year").distinct().collect() == [(2021,)]


def test_layers_share_one_aggregate(days):
    made = states.month_states(days.withColumn("other", F.col("sm") * 2), "time", ["sm", "other"], ["lat_i", "layer"])
    picks = {"layer1": {"pred": ("sm", 1.0), "product": ("other", 0.5)}, "layer2": {"pred": ("sm", 1.0)}}
    found = states.layered_means(made, "month", picks, ["sm"], ["lat_i"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [lat_i") == 2  # the states and their one merge
    own = table(days.groupBy("lat_i", "layer", F.month("time").alias("month")).agg(F.avg("sm").alias("sm")), "lat_i", "layer", "month")
    all_rows = table(days.groupBy("lat_i", F.month("time").alias("month")).agg(F.avg("sm").alias("sm")), "lat_i", "month")
    rows = found.collect()
    assert len(rows) == len(own)
    for r in rows:
        assert r.pred == pytest.approx(own[r.lat_i, r.layer, r.month])
        assert r.product == (pytest.approx(all_rows[r.lat_i, r.month]) if r.layer == "layer1" else None)
