from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from geoseries import schema
from geoseries.functions import calendar as cal
from geoseries.functions import values as v
from geoseries.operators import clean


def one(spark, column, **cols):
    names = list(cols)
    return spark.createDataFrame([tuple(cols.values())], names).select(column.alias("x")).first()[0]


def test_quality_flag_masks_missing_flags(spark, rows):
    df = spark.createDataFrame([(1, 0.2, "G"), (2, 0.3, "D"), (3, 0.4, None)], "id int, sm double, flag string")
    assert rows(clean.mask_quality(df, "sm", "flag"), "id", "sm") == [(1, 0.2), (2, None), (3, None)]


def test_clip_keeps_null_and_bounds(spark, rows):
    df = spark.createDataFrame([(None,), (-1.0,), (0.5,), (2.0,)], "x double")
    assert rows(df.select(v.clip(F.col("x"), 0.0, 1.0).alias("y"))) == [(0.0,), (0.5,), (1.0,), (None,)]


def test_recode_unknown_is_null(spark, rows):
    df = spark.createDataFrame([("a",), ("z",), (None,)], "k string")
    assert rows(df.select("k", v.recode(F.col("k"), {"a": "A"}).alias("y"))) == [("a", "A"), ("z", None), (None, None)]


def test_validity_rules(spark):
    df = spark.createDataFrame([(-999.0, 0, 11.0, -0.1, 9999.0), (50.0, 24, 10.0, 0.0, -407.0)],
                               "BD double, LAND_COVER int, MODIS_LAI double, ERA5_LAND_lai_lv double, DEM double")
    got = [tuple(r) for r in clean.apply_validity(df, {c: schema.VALIDITY_RULES[c] for c in df.columns}).collect()]
    assert got == [(None,) * 5, (0.5, 24, 10.0, 0.0, -407.0)]


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,), (None,)], "x double")
    assert clean.nulls_for_nan(df, ["x"]).where("x is null").count() == 2


def test_path_fields(spark):
    from geoseries.sources.stations import path_fields

    df = spark.createDataFrame([("/data/layer2/12_group_3.csv",), ("odd",)], "p string")
    got = path_fields(df, "p", r"([^/]+)/(\d+)_group_(\d+)\.csv$", ["layer", "station", "grp"]).drop("p").collect()
    assert [tuple(r) for r in got] == [("layer2", "12", "3"), (None, None, None)]
    assert one(spark, v.path_part(F.col("p"), -2, "/"), p="a/b/c") == "b"


def test_time_features_by_frequency(spark):
    assert cal.frequency_features("D") == ["month_of_year", "day_of_month", "day_of_year"]
    assert cal.frequency_features("12H") == ["hour_of_day", "day_of_week", "day_of_month", "day_of_year"]
    assert cal.frequency_features("5min")[0] == "minute_of_hour"
    assert cal.frequency_features("A") == []
    assert cal.frequency_features("W") == ["day_of_month", "week_of_year"]
    with pytest.raises(ValueError):
        cal.frequency_features("fortnight")
    ts = datetime(2024, 12, 30, 23, 59, 59)
    df = spark.createDataFrame([(ts,)], "ts timestamp_ntz")
    got = df.select(*[f(F.col("ts")).alias(n) for n, f in cal.FEATURES.items()]).first().asDict()
    assert got["second_of_minute"] == got["minute_of_hour"] == got["hour_of_day"] == 0.5
    assert got["day_of_week"] == -0.5 and got["month_of_year"] == 0.5
    assert got["week_of_year"] == -0.5  # ISO week 1 of the next year
    assert got["day_of_year"] == pytest.approx(364 / 365 - 0.5)


def test_indicators_cover_the_whole_domain(spark):
    df = spark.createDataFrame([(date(2024, 3, 5), 7), (date(2024, 12, 1), None)], "d date, c int")
    months = df.select(*[c.alias(n) for n, c in cal.month_indicators(F.col("d")).items()]).collect()
    assert [sum(r) for r in months] == [1, 1] and months[0]["month_3"] == 1 and len(months[0]) == 12
    cover = df.select(*[c.alias(n) for n, c in cal.category_indicators(F.col("c"), range(1, 25), "lc", True).items()]).collect()
    assert cover[0]["lc_7"] == 1 and sum(cover[1]) == 1 and cover[1]["lc_nan"] == 1


def test_dates(spark):
    assert one(spark, cal.year_doy_date(F.col("y"), F.col("d")), y=2024, d=366) == date(2024, 12, 31)
    assert one(spark, cal.next_month_start(F.col("t")), t=date(2023, 12, 9)) == date(2024, 1, 1)
    assert len(one(spark, cal.month_days(F.col("t")), t=date(2024, 2, 9))) == 29
    assert one(spark, cal.year_month_label(F.col("t")), t=date(2024, 2, 9)) == "2024_02"
    assert one(spark, v.wrap_longitude(F.col("x")), x=180.0) == -180.0


def test_period_filter_is_pushed_down(spark, tmp_path):
    df = spark.createDataFrame([(date(2023, 12, 31), 1), (date(2024, 1, 1), 2), (date(2024, 1, 31), 3), (date(2024, 2, 1), 4)], "t date, x int")
    df.write.parquet(str(tmp_path / "t"))
    got = clean.sel_period(spark.read.parquet(str(tmp_path / "t")), "t", 2024, 1)
    assert sorted(r.x for r in got.collect()) == [2, 3]
    assert "GreaterThanOrEqual(t" in got._jdf.queryExecution().executedPlan().toString()
    year = clean.sel_period(df, "t", 2023)
    assert [r.x for r in year.collect()] == [1]
    december = clean.sel_period(df, "t", 2023, 12)
    assert [r.x for r in december.collect()] == [1]


def test_columns(spark):
    df = spark.createDataFrame([(1, 2, 3)], "b int, a_x int, c int")
    assert schema.require_columns(df, ["c", "b", "a_x"]).columns == ["c", "b", "a_x"]
    with pytest.raises(ValueError):
        schema.require_columns(df, ["c", "b"])
    with pytest.raises(ValueError):
        schema.require_columns(df, ["c", "b", "a_x", "d"])
    assert schema.drop_features(df, ["x"]).columns == ["b", "c"]


def test_null_safe_score_restores_features(spark):
    from geoseries.operators.models import LinearScorer

    df = spark.createDataFrame([(1, 1.0, 2.0), (2, None, 2.0)], "id int, a double, b double")
    got = clean.null_safe_score(df, ["a", "b"], LinearScorer({"a": 1.0, "b": 10.0}))
    assert [tuple(r) for r in got.sort("id").collect()] == [(1, 1.0, 2.0, 21.0), (2, None, 2.0, None)]


def test_audits(spark, rows):
    df = spark.createDataFrame([(1, None), (1, 2), (2, None)], "k int, x int")
    assert rows(clean.null_audit(df)) == [("k", 0), ("x", 2)]
    other = spark.createDataFrame([(1, 0), (3, 0)], "k int, x int")
    assert rows(clean.check_rows(df, other, ["k"])) == [(1, 2, 1), (2, 1, 0), (3, 0, 1)]


def test_config_tables(spark):
    tables = schema.config_tables(spark)
    assert tables["layers"].count() == 5 and tables["products"].count() == 10 and tables["seeds"].count() == 20
    assert tables["depths"].where("layer = 'layer1'").count() == 0
