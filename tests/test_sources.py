import pytest
from pyspark.sql import functions as F

from geoseries.operators.metrics import importance_arrays, importance_table, importance_wide
from geoseries.sources import stations


def test_station_files(spark, tmp_path, rows):
    for layer, name, body in [
        ("layer1", "12_group_3.csv", "date_time,soil_moisture\n2020-01-01,0.25\n2020-01-02,\n"),
        ("layer1", "7_group_0.csv", "date_time,soil_moisture\n2020-01-01,0.5\n"),
        ("layer1", "8_group_0.csv", "date_time,soil_moisture\n"),
        ("layer2", "12_group_3.csv", "date_time,soil_moisture\n2020-01-05,0.75\n"),
    ]:
        folder = tmp_path / layer
        folder.mkdir(exist_ok=True)
        (folder / name).write_text(body)
    got = stations.read_stations(spark, str(tmp_path), "layer1").withColumn("date_time", F.col("date_time").cast("string"))
    assert rows(got) == [
        (12, 3, "layer1", "2020-01-01", 0.25), (12, 3, "layer1", "2020-01-02", None), (7, 0, "layer1", "2020-01-01", 0.5)
    ]
    assert stations.read_stations(spark, str(tmp_path)).count() == 4


def test_unreadable_files_can_be_skipped(spark, tmp_path):
    from geoseries.sources.grids import read_grid, write_grid

    df = spark.createDataFrame([(0, 0, "2000-01-01", 1.0)], "lat_i int, lon_i int, time string, v double").withColumn("time", F.to_date("time"))
    path = tmp_path / "g"
    write_grid(df, str(path))
    (path / "year=2000" / "month=1" / "bad.parquet").write_text("not parquet")
    schema = "lat_i int, lon_i int, time date, v double, year int, month int"
    assert [r.v for r in read_grid(spark, str(path), skip_unreadable=True, schema=schema).collect()] == [1.0]
    with pytest.raises(Exception):
        read_grid(spark, str(path), schema=schema).collect()


def test_log_is_appended(spark, tmp_path):
    path = str(tmp_path / "log")
    for seed in (1, 2):
        stations.append_log(spark.createDataFrame([(0.5, "layer1", seed)], "accuracy double, layer string, seed int"), path)
    assert spark.read.parquet(path).count() == 2
    stations.write_table(spark.read.parquet(path).limit(1), str(tmp_path / "one"))
    assert spark.read.parquet(str(tmp_path / "one")).count() == 1


def test_importance_forms(spark, rows):
    data = [("l", f, r, float(i * 10 + r)) for i, f in enumerate("ab") for r in range(3)]
    df = spark.createDataFrame(data, "layer string, feature string, repeat int, value double")
    arrays = importance_arrays(df, ["layer"])
    assert arrays.first().importances == [[0.0, 1.0, 2.0], [10.0, 11.0, 12.0]]
    assert rows(importance_table(arrays, ["layer"], "features", "importances")) == rows(df)
    assert [tuple(r) for r in importance_wide(df, ["layer"], ["a", "b"]).sort("repeat").collect()] == [
        ("l", 0, 0.0, 10.0), ("l", 1, 1.0, 11.0), ("l", 2, 2.0, 12.0)
    ]


def test_station_files_are_written_by_the_tasks(spark, tmp_path, rows):
    """One file for each station under its name, however its rows lie; every seventh station's is cut short and listed as skipped."""
    from geoseries.suite.scans import _named_files

    data = [(f"layer{s % 2}", s, s % 4, f"2020-01-{d:02d}", s + d / 100) for d in range(1, 11) for s in range(1, 30)]
    df = spark.createDataFrame(data, "layer string, s long, g long, date_time string, soil_moisture double").withColumn("date_time", F.to_date("date_time"))
    path = _named_files(spark, df.repartition(5, "date_time"), str(tmp_path / "named"))
    assert len(list((tmp_path / "named").glob("*/*.parquet"))) == 29
    got = stations.read_stations(spark, path, fmt="parquet", skip_unreadable=True, file="file")
    assert rows(got.select("layer", "station_id", "group_id", F.col("date_time").cast("string"), "soil_moisture")) == sorted(
        (r for r in data if r[1] % 7), key=lambda t: tuple((False, str(v)) for v in t)
    )
    assert [r.station_id for r in stations.skipped_files(spark, path, got, "file").sort("station_id").collect()] == [7, 14, 21, 28]


def test_few_stations_go_to_all_tasks(spark, monkeypatch):
    """The samples are not shuffled for the table of stations, whatever size Spark broadcasts by itself."""
    from geoseries.suite import bindings

    kinds = {
        "lineitem": "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate date, l_quantity double, l_discount double, l_tax double, l_extendedprice double",
        "part": "p_partkey long, p_size int, p_retailprice double",
        "supplier": "s_suppkey long, s_acctbal double",
    }
    rows = {"lineitem": [(1, 1, 1, 1, None, 1.0, 0.0, 0.0, 9.0), (1, 2, 1, None, None, 1.0, 0.0, 0.0, 9.0)], "part": [(1, 5, 2.0)], "supplier": [(1, 3.0), (1, 4.0)]}
    monkeypatch.setattr(bindings, "table", lambda spark, sf, name: spark.createDataFrame(rows[name], kinds[name]))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for most, joins in ((1, 0), (2, 1)):
            monkeypatch.setattr(bindings, "FEW_STATIONS", most)
            got = bindings.features(spark, "")
            assert got._jdf.queryExecution().executedPlan().toString().count("BroadcastHashJoin") == joins
            assert sorted(r["s_acctbal"] for r in got.collect()) == [3.0, 4.0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
