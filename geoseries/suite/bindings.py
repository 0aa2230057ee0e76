"""The domain tables, bound to the test tables, once in Spark and once in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geoseries.operators.grid import Axis
from geoseries.operators.models import LinearScorer

KEYS = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "day"]
FEATURES = ["l_quantity", "l_discount", "l_tax", "p_size", "p_retailprice", "s_acctbal"]
LABEL = "l_extendedprice"

# Fixed linear function used wherever a scorer with a known answer is needed.
LINEAR = LinearScorer(
    {"l_quantity": 900.0, "l_discount": -5000.0, "l_tax": 2500.0, "p_size": 120.0, "p_retailprice": 3.0, "s_acctbal": 0.5},
    1000.0,
)
LINEAR_SQL = (
    "1000e0 + 900e0*l_quantity - 5000e0*l_discount + 2500e0*l_tax + 120e0*p_size + 3e0*p_retailprice + 0.5::DOUBLE*s_acctbal"
)

LAT_AXIS = Axis(25.0, 0.5, 13)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def station_raw(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("user_id").alias("station_id"),
        "ts",
        "event_id",
        F.col("value").alias("soil_moisture"),
        F.when(F.col("event_type") == "error", "D").otherwise("G").alias("soil_moisture_flag"),
    )


def station_meta(spark: SparkSession, sf: str) -> DataFrame:
    ids = table(spark, sf, "events").select(F.col("user_id").alias("station_id")).distinct()
    g = F.floor(F.col("station_id") / 3)
    k = F.col("station_id") % 3
    low = (F.col("station_id") % 5) * F.lit(0.2)
    return ids.select(
        "station_id",
        (F.lit(25.0) + (g % 13) * F.lit(0.5) + k * F.lit(0.03)).alias("latitude"),
        (F.lit(75.0) + F.floor(g / 13) * F.lit(0.5) + F.lit(0.07)).alias("longitude"),
        low.alias("depth_from"),
        (low + F.lit(0.1)).alias("depth_to"),
    )


def lon_axis(spark: SparkSession, sf: str) -> Axis:
    top = table(spark, sf, "events").agg(F.max("user_id")).first()[0]
    groups = top // 3 + 1
    return Axis(75.0, 0.5, -(-groups // 13) + 1)


def station_daily(spark: SparkSession, sf: str) -> DataFrame:
    """Daily means of the good samples."""
    from geoseries.operators.clean import mask_quality
    from geoseries.operators.series import resample_daily

    masked = mask_quality(station_raw(spark, sf), "soil_moisture", "soil_moisture_flag")
    return resample_daily(masked, ["station_id"], "ts", ["soil_moisture"])


def supplier_cells() -> list:
    return [(F.col("l_suppkey") % 5).alias("lat_i"), F.floor(F.col("l_suppkey") / 5).alias("lon_i")]


def grid_daily(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .select(
            *supplier_cells(),
            F.to_date("l_shipdate").alias("time"),
            (F.col("l_quantity") / 50).alias("sm"),
            F.col("l_discount").alias("tp"),
            (F.col("l_extendedprice") / 105000).alias("swvl1"),
        )
        .groupBy("lat_i", "lon_i", "time")
        .agg(*[F.avg(c).alias(c) for c in ("sm", "tp", "swvl1")])
    )


MOISTURE = ["sm", "swvl1", "swvl2", "swvl3", "SoilMoi0_10cm_inst", "SoilMoi10_40cm_inst", "SoilMoi40_100cm_inst", "SMCI"]


def grid_layer_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows of the gridded products: layer, depth, cell and day with the variables of three products."""
    li, part = table(spark, sf, "lineitem"), table(spark, sf, "part")
    return li.join(part, li.l_partkey == part.p_partkey).select(*_layer_columns(), (10 * (1 + F.col("p_size") % 10)).alias("depth"))


def _layer_columns() -> list:
    return [
        F.concat(F.lit("layer"), (1 + (F.col("l_linenumber") - 1) % 5).cast("string")).alias("layer"),
        *supplier_cells(),
        F.to_date("l_shipdate").alias("time"),
        (F.col("l_quantity") / 50).alias("sm"),
        (F.col("l_extendedprice") / 105000).alias("swvl1"),
        (F.col("l_discount") * 4).alias("swvl2"),
        (F.col("l_tax") * 6).alias("swvl3"),
        F.col("l_quantity").alias("SoilMoi0_10cm_inst"),
        (F.col("l_quantity") * 3).alias("SoilMoi10_40cm_inst"),
        (F.col("l_discount") * 2000).alias("SoilMoi40_100cm_inst"),
        (F.col("l_tax") * 5000).alias("SMCI"),
    ]


def grid_layers(spark: SparkSession, sf: str) -> DataFrame:
    """Daily grid per soil layer with the variables of three products."""
    rows = table(spark, sf, "lineitem").select(*_layer_columns())
    return rows.groupBy("layer", "lat_i", "lon_i", "time").agg(*[F.avg(c).alias(c) for c in MOISTURE])


def grid_static(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        (F.col("c_custkey") % 10).alias("lat_i"),
        F.floor(F.col("c_custkey") / 10).alias("lon_i"),
        F.col("c_acctbal").alias("value"),
        (F.col("c_nationkey") % 8).alias("depth"),
    )


def grid_soil(spark: SparkSession, sf: str) -> DataFrame:
    """Static grid with stored sentinels in place of missing values."""
    return grid_static(spark, sf).withColumn(
        "value", F.when(F.col("value") < 0, F.lit(-999.0)).otherwise(F.col("value"))
    )


def grid_mask(spark: SparkSession, sf: str) -> DataFrame:
    """1 inside the region, null outside (southernmost cells)."""
    cell = [(F.col("s_suppkey") % 5).alias("lat_i"), F.floor(F.col("s_suppkey") / 5).alias("lon_i")]
    return table(spark, sf, "supplier").select(*cell).distinct().withColumn("band1", F.when(F.col("lat_i") != 0, F.lit(1.0)))


def scores_wide(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select(
        F.col("l_suppkey").alias("station_idx"),
        F.to_date("l_shipdate").alias("date_time"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.concat(F.lit("layer"), (1 + (F.col("l_linenumber") - 1) % 5).cast("string")).alias("layer"),
        F.when(F.col("l_returnflag") == "A", "spatial").otherwise("temporal").alias("split_method"),
        (F.col("l_quantity") / 50).alias("true"),
        (F.col("l_extendedprice") / 105000).alias("pred_a"),
        (F.col("l_discount") * 10).alias("pred_b"),
        F.when(F.col("l_linenumber") != 7, F.col("l_tax") * 12).alias("pred_c"),
    )


def scores_long(spark: SparkSession, sf: str) -> DataFrame:
    wide = scores_wide(spark, sf)
    keep = ["station_idx", "date_time", "layer", "split_method", "true"]
    return wide.select(*keep, F.col("pred_a").alias("a"), F.col("pred_b").alias("b"), F.col("pred_c").alias("c")).unpivot(
        keep, ["a", "b", "c"], "exp", "pred"
    )


#: Rows of a table of stations up to which it goes to all tasks, so that the samples are not shuffled and sorted for it.
FEW_STATIONS = 500_000


def features(spark: SparkSession, sf: str) -> DataFrame:
    li, part, supplier = (table(spark, sf, n) for n in ("lineitem", "part", "supplier"))
    if supplier.count() <= FEW_STATIONS:
        supplier = F.broadcast(supplier)
    return (
        li.join(part, li.l_partkey == part.p_partkey)
        .join(supplier, li.l_suppkey == supplier.s_suppkey)
        .select(
            "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.to_date("l_shipdate").alias("day"),
            "l_quantity", "l_discount", "l_tax", F.col("p_size").cast("double").alias("p_size"), "p_retailprice",
            "s_acctbal", LABEL,
        )
    )


def composites(spark: SparkSession, sf: str) -> DataFrame:
    """Sparse series: eight-day means stamped with the first day of their period."""
    period = F.floor(F.datediff("date_time", F.lit("2024-01-01").cast("date")) / 8)
    return (
        station_daily(spark, sf)
        .groupBy("station_id", F.date_add(F.lit("2024-01-01").cast("date"), (period * 8).cast("int")).alias("date_time"))
        .agg(F.avg("soil_moisture").alias("lai"))
    )


def seed_log(spark: SparkSession, sf: str) -> DataFrame:
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.concat(F.lit("layer"), F.col("l_linenumber").cast("string")).alias("layer"), F.col("l_partkey").alias("seed")
        )
        .agg(F.avg(F.when(F.col("l_returnflag") == "A", 1.0).otherwise(0.0)).alias("accuracy"))
    )


# The same tables in SQL; each entry may use the ones above it.
VIEWS = {
    "station_raw": """SELECT user_id AS station_id, ts, event_id, value AS soil_moisture,
        CASE WHEN event_type = 'error' THEN 'D' ELSE 'G' END AS soil_moisture_flag FROM events""",
    "station_meta": """SELECT station_id,
        25e0 + (station_id // 3 % 13) * 0.5::DOUBLE + (station_id % 3) * 0.03::DOUBLE AS latitude,
        75e0 + (station_id // 39) * 0.5::DOUBLE + 0.07::DOUBLE AS longitude,
        (station_id % 5) * 0.2::DOUBLE AS depth_from, (station_id % 5) * 0.2::DOUBLE + 0.1::DOUBLE AS depth_to
        FROM (SELECT DISTINCT user_id AS station_id FROM events)""",
    "lat_axis": "SELECT i AS lat_i, 25e0 + 0.5::DOUBLE * i AS lat FROM range(13) t(i)",
    "lon_axis": """SELECT i AS lon_i, 75e0 + 0.5::DOUBLE * i AS lon FROM (SELECT unnest(range(
        CAST(ceil((max(user_id) // 3 + 1) / 13e0) AS BIGINT) + 1)) AS i FROM events)""",
    "station_daily": """SELECT station_id, CAST(ts AS DATE) AS date_time, avg(soil_moisture) AS soil_moisture
        FROM station_raw WHERE soil_moisture_flag = 'G' GROUP BY ALL""",
    "li_cell": """SELECT *, l_suppkey % 5 AS lat_i, l_suppkey // 5 AS lon_i, CAST(l_shipdate AS DATE) AS dt,
        'layer' || (1 + (l_linenumber - 1) % 5) AS layer FROM lineitem""",
    "grid_daily": """SELECT lat_i, lon_i, dt AS time, avg(l_quantity / 50) AS sm, avg(l_discount) AS tp,
        avg(l_extendedprice / 105000) AS swvl1 FROM li_cell GROUP BY ALL""",
    "grid_layers": """SELECT layer, lat_i, lon_i, dt AS time, avg(l_quantity / 50) AS sm,
        avg(l_extendedprice / 105000) AS swvl1, avg(l_discount * 4) AS swvl2, avg(l_tax * 6) AS swvl3,
        avg(l_quantity) AS SoilMoi0_10cm_inst, avg(l_quantity * 3) AS SoilMoi10_40cm_inst,
        avg(l_discount * 2000) AS SoilMoi40_100cm_inst, avg(l_tax * 5000) AS SMCI FROM li_cell GROUP BY ALL""",
    "grid_static": """SELECT c_custkey % 10 AS lat_i, c_custkey // 10 AS lon_i, c_acctbal AS value,
        c_nationkey % 8 AS depth FROM customer""",
    "grid_soil": """SELECT lat_i, lon_i, CASE WHEN value < 0 THEN -999e0 ELSE value END AS value, depth
        FROM grid_static""",
    "grid_mask": "SELECT DISTINCT s_suppkey % 5 AS lat_i, s_suppkey // 5 AS lon_i, CASE WHEN s_suppkey % 5 <> 0 THEN 1e0 END AS band1 FROM supplier",
    "scores_wide": """SELECT l_suppkey AS station_idx, dt AS date_time, l_orderkey, l_linenumber, l_partkey, layer,
        CASE WHEN l_returnflag = 'A' THEN 'spatial' ELSE 'temporal' END AS split_method,
        l_quantity / 50 AS "true", l_extendedprice / 105000 AS pred_a, l_discount * 10 AS pred_b,
        CASE WHEN l_linenumber <> 7 THEN l_tax * 12 END AS pred_c FROM li_cell""",
    "scores_long": """SELECT station_idx, date_time, layer, split_method, "true", 'a' AS exp, pred_a AS pred FROM scores_wide
        UNION ALL SELECT station_idx, date_time, layer, split_method, "true", 'b', pred_b FROM scores_wide
        UNION ALL SELECT station_idx, date_time, layer, split_method, "true", 'c', pred_c FROM scores_wide""",
    "features": """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS dt, l_quantity,
        l_discount, l_tax, CAST(p_size AS DOUBLE) AS p_size, p_retailprice, s_acctbal, l_extendedprice,
        concat_ws(':', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE)) AS id
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey""",
    "composites": """SELECT station_id,
        DATE '2024-01-01' + CAST(floor((date_time - DATE '2024-01-01') / 8e0) * 8 AS INTEGER) AS date_time,
        avg(soil_moisture) AS lai FROM station_daily GROUP BY ALL""",
    "seed_log": """SELECT 'layer' || l_linenumber AS layer, l_partkey AS seed,
        avg(CASE WHEN l_returnflag = 'A' THEN 1e0 ELSE 0e0 END) AS accuracy FROM lineitem GROUP BY ALL""",
}


def sql(body: str) -> str:
    """`body` with the views it uses in front of it."""
    import re

    needed, todo = set(), [body]
    while todo:
        text = todo.pop()
        for name, view in VIEWS.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(view)
    views = ", ".join(f"{n} AS ({v})" for n, v in VIEWS.items() if n in needed)
    body = body.strip()
    if body.startswith(","):
        return f"WITH {views}{body}" if views else f"WITH {body[1:]}"
    return f"WITH {views} {body}" if views else body
