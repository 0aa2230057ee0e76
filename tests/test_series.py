from datetime import date, datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from geoseries.functions.calendar import day_number
from geoseries.operators import series

D0 = date(2024, 1, 1)


def day(i):
    return D0 + timedelta(days=i)


def frame(spark, data):
    return spark.createDataFrame([(s, day(i), v) for s, i, v in data], "s string, d date, v double")


def test_midnight_belongs_to_either_day(spark, rows):
    df = spark.createDataFrame(
        [("a", datetime(2024, 1, 2), 1.0), ("a", datetime(2024, 1, 2, 0, 0, 1), 3.0)], "s string, ts timestamp_ntz, v double"
    )
    assert rows(series.resample_daily(df, ["s"], "ts", ["v"])) == [("a", date(2024, 1, 2), 2.0)]
    assert rows(series.resample_daily(df, ["s"], "ts", ["v"], closed="right")) == [
        ("a", date(2024, 1, 1), 1.0), ("a", date(2024, 1, 2), 3.0)
    ]
    with pytest.raises(ValueError):
        series.resample_daily(df, ["s"], "ts", ["v"], closed="both")


def test_empty_days_are_dropped_or_kept(spark):
    df = spark.createDataFrame([("a", datetime(2024, 1, 2), None)], "s string, ts timestamp_ntz, v double")
    assert series.resample_daily(df, ["s"], "ts", ["v"]).count() == 0
    assert series.resample_daily(df, ["s"], "ts", ["v"], drop_empty=False).count() == 1


@pytest.mark.parametrize("chunk", [7, 10, 366])
def test_rolling_sum_across_chunks(spark, chunk):
    random = np.random.default_rng(1)
    kept = [i for i in range(80) if i not in (20, 21, 50)]
    values = {i: float(random.integers(0, 100)) for i in kept}
    got = series.rolling_sum(frame(spark, [("a", i, values[i]) for i in kept]), ["s"], "d", "v", 7, chunk_days=chunk).toPandas()
    for r in got.itertuples():
        i = (pd.Timestamp(r.d).date() - D0).days
        window = [values.get(j) for j in range(i - 6, i + 1)]
        want = None if None in window else sum(window)
        assert (want is None and pd.isna(r.v_sum7)) or want == r.v_sum7
    assert len(got) == len(kept)


def test_rolling_audit(spark):
    df = frame(spark, [("a", i, float(i)) for i in range(10)])
    stored = df.select("s", "d", F.when(F.dayofmonth("d") == 9, 0.0).otherwise(F.col("v") * 3 - 3).alias("stored"))
    got = {r.d.day: r.ok for r in series.verify_rolling(df, stored, ["s"], "d", "v", "stored", 3).collect()}
    assert got[1] is None and got[2] is None and got[3] is True and got[9] is False


@pytest.mark.parametrize("chunk", [2, 3, 366])
def test_fill_and_interpolate(spark, chunk):
    data = [("a", 0, None), ("a", 2, 2.0), ("a", 5, 8.0), ("a", 7, None), ("b", 3, 1.0)]
    filled = series.fill_days(frame(spark, data), ["s"], "d", ["v"], chunk_days=chunk)
    assert filled.count() == 9
    got = series.interpolate_linear(filled, ["s"], day_number(F.col("d")), ["v"], chunk=chunk).sort("s", "d").collect()
    assert [r.v for r in got] == [None, None, 2.0, 4.0, 6.0, 8.0, 8.0, 8.0, 1.0]
    assert [r.Is_valid for r in got] == [0, 0, 1, 0, 0, 1, 0, 0, 1]


@pytest.mark.parametrize("chunk", [3, 50])
def test_interpolation_matches_pandas(spark, chunk):
    random = np.random.default_rng(5)
    values = [None if random.random() < 0.6 else float(random.normal()) for _ in range(60)]
    df = frame(spark, [("a", i, v) for i, v in enumerate(values)])
    got = [r.v for r in series.interpolate_linear(df, ["s"], day_number(F.col("d")), ["v"], chunk=chunk).sort("d").collect()]
    want = pd.Series(values, dtype=float).interpolate()
    assert [None if pd.isna(w) else pytest.approx(w) for w in want] == got


@pytest.mark.parametrize("chunk", [4, 366])
def test_upsample_composites(spark, chunk):
    got = series.upsample_daily(frame(spark, [("a", 0, 0.0), ("a", 8, 4.0), ("a", 16, 0.0)]), ["s"], "d", ["v"], chunk).sort("d").collect()
    assert [r.v for r in got] == [i / 2 for i in range(9)] + [4 - i / 2 for i in range(1, 9)]
    assert sum(r.Is_valid for r in got) == 3


@pytest.mark.parametrize("n, length, count", [(2, 3, 0), (3, 3, 1), (10, 3, 8), (10, 1, 10)])
def test_sequence_windows(spark, n, length, count):
    df = frame(spark, [("a", i, float(i)) for i in range(n)] + [("b", 0, 1.0)])
    got = series.sequence_windows(df, ["s"], day_number(F.col("d")), ["v"], length, chunk=4).where("s = 'a'").collect()
    assert len(got) == count
    first = day_number(F.lit("2024-01-01").cast("date"))
    base = df.select(first.alias("x")).first()[0]
    assert all([s.v for s in r.steps] == [float(r.start - base + j) for j in range(length)] for r in got)


def test_daily_check_and_gap_truncation(spark, rows):
    df = frame(spark, [("a", 0, 1.0), ("a", 1, 1.0), ("b", 0, 1.0), ("b", 2, 1.0)])
    assert [r.s for r in series.check_daily(df, ["s"], "d").collect()] == ["b"]
    required = frame(spark, [("a", i, 1.0) for i in range(31)] + [("b", i, 1.0) for i in (0, 1, 3, 4)])
    got = rows(series.truncate_at_gap(df, required, ["s"], "d"), "s", "d")
    assert got == [("a", day(0)), ("a", day(1)), ("b", day(0))]


def test_sequence_samples(spark):
    from geoseries.plans.preparation import sequence_samples

    df = spark.createDataFrame(
        [("a", day(0), 1.0, 0.1), ("a", day(2), 3.0, 0.3), ("a", day(3), 5.0, 0.4), ("b", day(0), 1.0, 0.2)],
        "station_id string, date_time date, x double, sm double",
    )
    got = sequence_samples(df, ["x"], "sm", 3).sort("start").collect()
    assert [r.station_id for r in got] == ["a", "a"]
    assert [s.Is_valid for s in got[0].steps] == [1, 0, 1] and got[0].steps[1].sm == pytest.approx(0.2)
    assert all(s.month_1 == 1 and s.month_2 == 0 for r in got for s in r.steps)
    x = np.array([1.0, 2.0, 3.0, 5.0, 1.0])
    assert [s.x for s in got[1].steps] == pytest.approx(list((np.array([2.0, 3.0, 5.0]) - x.mean()) / x.std()))
